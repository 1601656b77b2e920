"""Exact duplicates by progressive refinement: length, then prefix hash, then the hash of the full text.

A first scan writes two numbers a row: the length of the normalised text and a hash of its first characters. Lengths
are counted first, and rows alone in theirs are done; the others are grouped by length and prefix hash, and those alone
there are done too. The keys that go on are folded into a bitmap (sized by their number, up to a fixed bound), which
every task gets; a second scan hashes the full text of rows whose bit is set and of no others. A bit that two keys
share only costs a hash. Text is never shuffled.

The group of a copied text may hold a third of all rows: groups are aggregated before their shuffle, and joined back
through a broadcast of checked size or else a join by the hash alone, which Spark's skewed-join handling splits.

Defined results. Null text counts as empty; empty texts equal each other. Ties in length go to the smallest id, null
ids last, then to the largest hash of the text. Repeated rows: one output row for each input row, all alike;
exact_dedup() keeps one of them. Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, mark, pick, small, survivors

#: The bitmap has 2^LEAST_BITS to 2^MOST_BITS bits (32 MB), 16 for each key where that fits.
LEAST_BITS, MOST_BITS, PREFIX = 18, 28, 64


def normalised(text: Column) -> Column:
    """text without ASCII white space."""
    return F.regexp_replace(text, f"[{SPACE}]+", "")


def _bitmap(keys: DataFrame, bits: int) -> DataFrame:
    """keys (LONG column key) as (bucket, bits): at most 2^bits / 32768 rows of 4 KB."""
    slot = F.pmod("key", F.lit(1 << bits))
    return keys.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))


def _bit(bits: Column, slot: Column) -> Column:
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """(id, keep_id, group_size, kept, full_hash, mark), one row for each row of docs. full_hash is the SHA-256 of the
    normalised text; null for rows that an earlier step settled, unless digest_all asks for every row's."""
    base = pick(docs, {"id": F.col(id_col).cast("long"), "text": F.coalesce(F.col(text_col), F.lit("")), "mark": mark(text_col)})
    norm = normalised(F.col("text"))
    key = F.xxhash64("n", "prefix")
    shaped = base.select("id", "mark", F.length("text").alias("points"), norm.alias("norm")).select("id", "mark", "points", "norm", F.length("norm").alias("n"), F.substring("norm", 1, PREFIX).alias("prefix"))
    slim = cut(shaped.select("n", key.alias("key")))
    lengths = cut(slim.groupBy("n").count().where("count > 1").select("n"))
    going_on = cut(slim.join(small(lengths, 8), "n", "left_semi").groupBy("n", "key").count().where("count > 1").select("key"))
    size = min(MOST_BITS, max(LEAST_BITS, (16 * going_on.count()).bit_length()))
    bits = F.broadcast(cut(_bitmap(going_on, size)))
    slot = F.pmod(key, F.lit(1 << size))
    marked = shaped.withColumn("bucket", F.bitmap_bucket_number(slot)).join(bits, "bucket", "left").withColumn("goes_on", _bit(F.col("bits"), slot))
    digest = F.sha2("norm", 256)
    rows = cut(marked.select("id", "mark", "points", "goes_on", (digest if digest_all else F.when(F.col("goes_on"), digest)).alias("full_hash")))
    best = F.max(F.struct("points", (-F.col("id")).alias("neg"), "mark")).alias("best")
    groups = rows.where("goes_on").groupBy("full_hash").agg(best, F.count("*").alias("size")).where("size > 1")
    groups = groups.select("full_hash", "size", (-F.col("best.neg")).alias("keep"), F.col("best.points").alias("most"), F.col("best.mark").alias("best_mark"))
    alone = rows.where("not goes_on").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "full_hash", "mark")
    out = rows.where("goes_on").join(small(cut(groups), 120), "full_hash", "left")
    single = F.col("size").isNull()
    stays = single | (F.col("id").eqNullSafe(F.col("keep")) & (F.col("points") == F.col("most")) & (F.col("mark") == F.col("best_mark")))
    found = out.select("id", F.when(single, F.col("id")).otherwise(F.col("keep")).alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), stays.alias("kept"), "full_hash", "mark")
    return found.unionByName(alone)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts."""
    return survivors(docs, cut(exact_groups(docs, id_col, text_col)), id_col, text_col)

"""Mixing sources to target weights along a time-varying curriculum.

Method. Sources in code point order (null last) weigh 5, 2, 1, repeating, and share the words of all documents; a
target stops at `most` times its source's size and the excess is shared out by weight again (water filling, in closed
form by a window over sources sorted by size for weight). A source's schedule is target * (1 + slope * (2t - 1)) over
training time t in [0, 1]: heavy sources come early, light ones late, and its integral is the target. A source's
documents stand in a fixed pseudo-random order and repeat; a copy that begins after c words is trained on when the
integrated schedule reaches the middle of the copy, which the quadratic formula inverts. Documents are range-sorted by
the position of their first copy.

Running sums of a source go over ranges of `run` rows of its order: sums of ranges first, then inside each range, so
that a source with a third of all rows isn't one task.

Defined results. Null text: size 0, taken 0. Sizes of 0 are never taken. A copy is taken if its middle comes before
the target, so that a source's taken words miss its target by at most half a document. Repeated rows: one output row
each. All sizes 0: targets 0. Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, cut, mark, once_each, pick, small

WEIGHTS, MOST, SLOPES = (5, 2, 1), 3, (-0.5, 0.0, 0.5)


def order_key(id_col: Column) -> Column:
    """A fixed pseudo-random LONG below 2^60 for an id."""
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """sources: source, source_size, rows. Adds weight, slope and target; one row for each source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(WEIGHTS)
    at = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), turn + 1)
    s = sources.select("*", at(WEIGHTS).cast("long").alias("weight"), at(SLOPES).alias("slope"))
    full = Window.orderBy((most * F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, on = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(full.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    left = (total - F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0))).cast("double")
    level = left / F.sum("weight").over(on)  # words for each unit of weight if all sources before this one are full
    s = s.select("*", level.alias("level"), (F.col("weight") * level > most * F.col("source_size")).alias("is_full"))
    open_level = F.min(F.when(~F.col("is_full"), F.struct((most * F.col("source_size") / F.col("weight")).alias("k"), "level"))).over(Window.partitionBy())
    share = F.when(F.col("is_full"), (most * F.col("source_size")).cast("double")).otherwise(F.least((most * F.col("source_size")).cast("double"), F.col("weight") * open_level["level"]))
    return s.select("source", "source_size", "rows", "weight", "slope", F.coalesce(share, F.lit(0.0)).alias("target"))


def position(words: Column, target: Column, slope: Column) -> Column:
    """The time at which a source's integrated schedule reaches `words`."""
    u, b = words / target, 1 - slope
    return F.when(target <= 0, None).when(slope == 0, u).otherwise((F.sqrt(b * b + 4 * slope * u) - b) / (2 * slope))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = MOST, run: int = 4096) -> DataFrame:
    """(id, size, source_size, target, taken, positions, mark), one row for each row of docs, range-sorted by first
    position; positions: the training time of each copy that the mix takes, in order."""
    sized = F.coalesce(F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")
    base = cut(pick(docs, {"id": F.col(id_col).cast("long"), "source": F.col(source_col), "size": sized, "key": order_key(F.col(id_col)), "mark": mark(text_col)}))
    sources = small(cut(targets(base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), most)), 200)
    named = base.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    ranged = named.withColumn("range", F.floor(F.col("key") / F.lit(float(1 << 60)) * F.ceil(F.col("rows") / run)))
    sums = ranged.groupBy("source", "range").agg(F.sum("size").alias("words"))
    past = F.sum("words").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = small(cut(sums.select(F.col("source").alias("s2"), F.col("range").alias("r2"), F.coalesce(past, F.lit(0)).alias("start"))), 64)
    inside = F.sum("size").over(Window.partitionBy("source", "range").orderBy("key", "id", "size", "mark").rowsBetween(Window.unboundedPreceding, -1))
    placed = ranged.withColumn("inside", F.coalesce(inside, F.lit(0))).join(starts, F.col("source").eqNullSafe(F.col("s2")) & (F.col("range") == F.col("r2")))
    middle = lambda k: F.col("start") + F.col("inside") + F.lit(k).cast("long") * F.col("source_size") + F.col("size") / 2
    copies = F.array(*[F.when((F.col("size") > 0) & (middle(k) <= F.col("target")), position(middle(k), F.col("target"), F.col("slope"))) for k in range(most)])
    out = placed.withColumn("positions", F.filter(copies, lambda x: x.isNotNull()))
    out = out.withColumn("first", F.coalesce(F.try_element_at("positions", F.lit(1)), 1 + F.col("key") / F.lit(float(1 << 60))))
    out = out.repartitionByRange("first", "id").sortWithinPartitions("first", "id")
    return out.select("id", "size", "source_size", "target", (F.col("size") * F.size("positions")).alias("taken"), "positions", "mark")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = MOST) -> DataFrame:
    """The mix itself: rows of docs in training order, each as many times as the mix takes it."""
    from_mix = cut(mix(docs, id_col, text_col, source_col, most).where("taken > 0").select("id", "mark", "positions"))
    repeated = cut(from_mix.groupBy("id", "mark").count().where("count > 1").select("id", "mark"))
    plan = from_mix.select(F.col("id").alias("__id"), F.col("mark").alias("__mark"), F.explode("positions").alias("__at"))
    once = once_each(docs, repeated, id_col, text_col)  # the plan has the copies of all repeated rows
    out = once.join(plan, once[id_col].cast("long").eqNullSafe(F.col("__id")) & (mark(text_col) == F.col("__mark")))
    return out.repartitionByRange("__at", "__id").sortWithinPartitions("__at", "__id").drop("__id", "__mark", "__at")

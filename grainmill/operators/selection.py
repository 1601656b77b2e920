"""Books from metadata: filters, categories, best formats, priorities and the byte budget.

Null texts hold no word; null sizes and years count as unknown and add nothing; books that tie are told apart by the
order named with each rule; repeated rows are books of their own until they are deduplicated; empty tables stay empty."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from .shared import small, written


def keyword_reject(df: DataFrame, text: Column, lexicon: Sequence[str] = L.SCIENCE) -> DataFrame:
    """Adds rejected: a lexicon word occurs as a substring."""
    return df.withColumn("rejected", T.has_any(text, lexicon))


def categorise(df: DataFrame, text: Column, astronomy: Sequence[str] = L.ASTRONOMY, philosophy: Sequence[str] = L.NATURAL_PHILOSOPHY, banned: Sequence[str] = L.BANNED) -> DataFrame:
    """Adds category (astronomy before natural_philosophy before other) and the sorted matches; banned books are other
    with no matches."""
    a, p, bad = T.hits(text, astronomy), T.hits(text, philosophy), T.has_any(text, banned)
    none = F.array().cast("array<string>")
    return df.withColumn("category", F.when(bad, "other").when(F.size(a) > 0, "astronomy").when(F.size(p) > 0, "natural_philosophy").otherwise("other")).withColumn("matched_keywords", F.when(bad, none).otherwise(F.array_sort(F.array_union(a, p))))


def early_plain_text(books: DataFrame, before: int = 1543) -> DataFrame:
    """English books with a plain-text format whose earliest creator died before a year; unknown years go."""
    has_text = F.exists("formats", lambda f: T.mime_parts(f["mime"])["base"] == "text/plain")
    return books.where((F.col("death_year") < before) & T.is_english(F.col("languages")) & has_text)


def best_format(formats: Column) -> Column:
    """Of plain-text formats the largest by (UTF-8 first, extent, url)."""
    plain = F.filter(formats, lambda f: T.mime_parts(f["mime"])["base"] == "text/plain")
    keyed = F.transform(plain, lambda f: F.struct(F.when(T.mime_parts(f["mime"])["charset"] == "utf-8", 2).otherwise(1).alias("p"), f["extent"].alias("extent"), f["url"].alias("url"), f["mime"].alias("mime")))
    return F.array_max(keyed)


def dedupe_candidates(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row for each key: the largest by the order columns. Aggregates before the shuffle."""
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), F.struct(*order)).alias("__r")).select(key, "__r.*")


def min_death_year(years: Column) -> Column:
    return F.array_min(years)


def priority_order(df: DataFrame, priority: DataFrame, id_col: str) -> DataFrame:
    """Adds rank_key: listed ids by their place, then the others by numeric id. priority: id and pos."""
    p = priority.groupBy("id").agg(F.min("pos").alias("pos"))
    return df.join(p, df[id_col].cast("string") == p["id"].cast("string"), "left").drop("id")


def forced_first(df: DataFrame, forced: DataFrame, id_col: str, only: bool = False) -> DataFrame:
    """Forced rows first (in their order), then all others; or the forced ones only."""
    f = forced.select(F.col(id_col).alias("__f"), F.col("pos").alias("forced_pos"))
    joined = df.join(f, df[id_col] == F.col("__f"), "inner" if only else "left").drop("__f")
    return joined.withColumn("is_forced", F.col("forced_pos").isNotNull())


def running_total(df: DataFrame, value: str, order: Sequence[str | Column], group: str | None = None, run: int = 100_000) -> DataFrame:
    """Adds before: the sum of value over all rows ahead in the order, of all rows or of the row's group. Rows are dealt to
    ranges of about `run` of them and summed in two levels, ranges first, then inside each; a group with most of the rows
    is many ranges. Rows that tie in the order stand in any order, but each has its own place. Null values add nothing;
    an empty table stays empty. The ranges are written once, so that they don't move."""
    keys = [*([group] if group else []), *order]
    whole = written(df)
    ranged = written(whole.repartitionByRange(-(-whole.count() // run) or 1, *keys).withColumn("__p", F.spark_partition_id()))
    by = ["__p", *([group] if group else [])]
    sums = ranged.groupBy(*by).agg(F.sum(value).alias("__v"))
    ahead = (Window.partitionBy(group) if group else Window).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = small(written(sums.select(F.col("__p").alias("__q"), *[F.col(group).alias("__g") for _ in by[1:]], F.coalesce(F.sum("__v").over(ahead), F.lit(0)).alias("__start"))), 64)
    inside = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("__p") == F.col("__q")
    summed = ranged.withColumn("__in", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(starts, same & F.col(group).eqNullSafe(F.col("__g")) if group else same)
    return summed.withColumn("before", F.col("__start") + F.col("__in")).drop("__p", "__q", "__g", "__start", "__in")


def byte_budget(df: DataFrame, size: str, order: Sequence[str | Column], target: int, initial: int = 0, most: int | None = None) -> DataFrame:
    """Takes rows in order while the bytes so far are under the target (checked before each row, so it may overshoot by
    one); at most `most` rows."""
    out = running_total(df, size, order).where(F.col("before") + initial < target)
    return out.orderBy(*order).limit(most) if most is not None else out


def category_totals(df: DataFrame, category: str, size: str, categories: Sequence[str]) -> DataFrame:
    """Books, bytes and estimated tokens (four bytes each) for each of the categories, in their order."""
    spark = df.sparkSession
    names = spark.createDataFrame([(c, i) for i, c in enumerate(categories)], "category string, pos int")
    sums = df.groupBy(F.col(category).alias("category")).agg(F.count("*").alias("n_books"), F.sum(size).alias("n_bytes"))
    full = names.join(sums, "category", "left").select("pos", "category", F.coalesce("n_books", F.lit(0)).alias("n_books"), F.coalesce("n_bytes", F.lit(0)).alias("n_bytes"))
    return full.withColumn("est_tokens", F.expr("n_bytes div 4")).orderBy("pos")


def size_totals(df: DataFrame, key: str, size: Column) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n_files"), F.sum(size).alias("n_bytes")).withColumn("est_tokens", F.expr("n_bytes div 4"))

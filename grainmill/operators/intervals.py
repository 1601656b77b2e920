"""Points in intervals, joined by an equality on bins: no nested loop, whatever lengths and hot places there are.

An interval of length L goes to a level whose bins are at least as wide, and which it so touches twice at most; a point goes to
its one bin at each level. Levels are the widest that is needed and every STEP-th power of two below it that has intervals, so a
point is repeated 22 times at most, and an interval is in bins of no more than four times the least power of two above its
length. So long intervals aren't spread over many bins and short ones don't share wide ones. Bins with more than HOT points are
split: their points are dealt by a hash to as many parts as they fill, and the few intervals of such a bin are repeated for each
part. They are looked for among the widest bins first, as each narrower one is in one of these.

Defined results. Null keys, points and ends match nothing, as do intervals that end at or before their start. Repeated rows
match each by itself. Empty sides give no rows; columns besides the named ones are passed on and must not share names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small, written

#: Points of a bin that one task takes; powers of two between levels.
HOT, STEP = 50_000, 3


def _level(length: Column) -> Column:
    """The least k with 2^k >= length."""
    return F.length(F.bin(length - 1)) * (length > 1).cast("int")


def _bin(at: Column, level: Column) -> Column:
    return F.call_function("shiftright", at, level)


def point_in_interval(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, stop: str, hot: int = HOT) -> DataFrame:
    """points (key, at, ...) with each interval (key, start, stop, ...) of the same key that has start <= at < stop; whole
    numbers. Points without an interval are left out."""
    spans = intervals.where(F.col(key).isNotNull() & (F.col(start) < F.col(stop)))
    needed = _level(F.col(stop).cast("long") - F.col(start).cast("long")).cast("int")
    found = [r[0] for r in written(spans.select(needed.alias("level")).distinct()).collect()]  # 64 numbers at most
    top = max(found, default=0)
    spans = spans.withColumn("__level", (F.lit(top) - F.floor((F.lit(top) - needed) / STEP) * STEP).cast("int"))
    levels = sorted({top - (top - k) // STEP * STEP for k in found})
    spans = spans.withColumn("__bin", F.explode(F.array_distinct(F.array(_bin(F.col(start).cast("long"), F.col("__level")), _bin(F.col(stop).cast("long") - 1, F.col("__level"))))))
    where = points.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    of = lambda rows: rows.withColumn("__level", F.explode(F.array(*[F.lit(k) for k in levels]).cast("array<int>"))).withColumn("__bin", _bin(F.col(at).cast("long"), F.col("__level")))
    bins, met = [key, "__level", "__bin"], (F.col(start) <= F.col(at)) & (F.col(at) < F.col(stop))
    wide = where.select(key, at, _bin(F.col(at).cast("long"), F.lit(top)).alias("__wide"))
    full = written(wide.groupBy(key, "__wide").count().where(F.col("count") > hot).drop("count"))
    if full.isEmpty():
        return of(where).join(spans, bins).where(met).drop("__level", "__bin")
    counts = of(wide.join(small(full, 64), [key, "__wide"], "left_semi")).groupBy(*bins).count().where(F.col("count") > hot)
    crowded = small(written(counts.select(*bins, F.ceil(F.col("count") / hot).cast("int").alias("__parts"))), 64)
    dealt = of(where).join(crowded, bins, "left").withColumn("__part", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in points.columns]), F.coalesce("__parts", F.lit(1))).cast("int")).drop("__parts")
    spread = spans.join(crowded, bins, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return dealt.join(spread, [*bins, "__part"]).where(met).drop("__level", "__bin", "__part")

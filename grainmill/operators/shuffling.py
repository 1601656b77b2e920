"""A seeded shuffle as arithmetic: where a row goes, and which row stands at a place, without sorting or drawing.

Row numbers 0 to n-1 are written with two digits in a mixed radix (about the square root of n) and go through ROUNDS of adding to one digit a
hash of the other, which is a bijection whatever the hash. Results beyond n-1 (fewer than the root of n) go through again until they aren't. So
the n-th row of the shuffle is known from its number alone: a run resumes at any place, tasks read their parts of the order
by themselves, and the inverse says which rows these are.

Defined results. Null numbers give null. Numbers outside of 0 to n-1 are an error. The same seed, n and number give the same
place on every machine.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rounds, and walks through them at most; a walk is needed with probability 1 / root of n.
ROUNDS, WALKS = 4, 64


def _digits(n: int) -> tuple[int, int]:
    a = max(1, isqrt(max(0, n - 1)) + 1)
    return a, -(-n // a) or 1


def _hash(seed: int, step: int, digit: Column) -> Column:
    """Fifteen hexadecimal digits of MD5 as a number."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(step)), digit.cast("string"))), 1, 15), 16, 10).cast("bigint")


def _through(x: Column, n: int, seed: int, sign: int) -> Column:
    """x after all rounds, forwards or backwards."""
    a, b = _digits(n)
    moved = lambda digit, step, other, size: F.pmod(digit + sign * F.pmod(_hash(seed, step, other), F.lit(size).cast("bigint")), F.lit(size).cast("bigint"))

    def round_(step: int):
        if step % 2 == 0:
            return lambda p: F.struct(moved(p["l"], step, p["r"], a).alias("l"), p["r"].alias("r"))
        return lambda p: F.struct(p["l"].alias("l"), moved(p["r"], step, p["l"], b).alias("r"))

    pair = F.struct((F.floor((x - F.pmod(x, F.lit(b).cast("bigint"))) / b)).cast("bigint").alias("l"), F.pmod(x, F.lit(b).cast("bigint")).alias("r"))
    for step in range(ROUNDS) if sign > 0 else reversed(range(ROUNDS)):
        pair = F.transform(F.array(pair), round_(step))[0]  # a lambda's argument is computed once and used twice
    return F.transform(F.array(pair), lambda p: p["l"] * b + p["r"])[0]


def _walked(x: Column, n: int, seed: int, sign: int) -> Column:
    outside = F.lit(-1).cast("bigint")
    start = F.when(x.isNull(), None).when((x < 0) | (x >= n), F.raise_error(F.lit(f"a row number outside of 0 to {n - 1}"))).otherwise(x.cast("bigint"))
    once = lambda v: _through(v, n, seed, sign)
    state = F.struct(start.alias("at"), outside.alias("found"))
    step = lambda s, _: F.when(s["found"] >= 0, s).otherwise(F.transform(F.array(once(s["at"])), lambda y: F.struct(y.alias("at"), F.when(y < n, y).otherwise(outside).alias("found")))[0])
    found = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), state, step)["found"]
    return F.when(x.isNotNull(), found)


def place_of(number: Column, n: int, seed: int = 1337) -> Column:
    """Where row `number` of n stands in the shuffle."""
    return _walked(number, n, seed, 1)


def row_at(place: Column, n: int, seed: int = 1337) -> Column:
    """The number of the row that stands at a place."""
    return _walked(place, n, seed, -1)


def shuffled_part(rows: DataFrame, number: str, n: int, start: int, stop: int, seed: int = 1337) -> DataFrame:
    """The rows that stand from start to before stop of the shuffle, with their place. The wanted numbers are computed and joined,
    so what is read of a table that is bucketed or pruned by number is the part alone."""
    wanted = rows.sparkSession.range(start, min(stop, n)).select(F.col("id").alias("place"), row_at(F.col("id"), n, seed).alias("__number"))
    return rows.join(wanted, rows[number] == F.col("__number")).drop("__number")

"""Rates, intervals and tests as Column expressions over counts."""

from __future__ import annotations

from math import erfc, sqrt

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def rate0(n: Column, d: Column) -> Column:
    """n / d; 0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))


def rate(n: Column, d: Column) -> Column:
    """n / d; null where there is nothing to divide by."""
    return F.try_divide(n.cast("double"), d.cast("double"))


def count_true(c: Column) -> Column:
    return F.count_if(F.coalesce(c, F.lit(False)))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval, not clipped; null for n = 0."""
    k, n = k.cast("double"), F.nullif(n, F.lit(0)).cast("double")
    p, zz = k / n, z * z
    centre, span = p + zz / (2 * n), z * F.sqrt((p * (1 - p) + zz / (4 * n)) / n)
    return (centre - span) / (1 + zz / n), (centre + span) / (1 + zz / n)


def mcnemar(b: Column, c: Column) -> Column:
    """Chi-square with continuity correction; null if there are no discordant pairs."""
    total = F.nullif(b + c, F.lit(0)).cast("double")
    return F.pow(F.abs(b - c) - 1, 2).cast("double") / total


@F.pandas_udf(DoubleType())
def chi2_p(x: pd.Series) -> pd.Series:
    """Upper tail of chi-square with one degree of freedom."""
    return x.map(lambda v: None if pd.isna(v) else erfc(sqrt(v / 2)))


def percent(r: Column) -> Column:
    return F.format_string("%.2f%%", 100 * r)


def decimal6(r: Column) -> Column:
    return F.format_string("%.6f", r)


def round6(r: Column) -> Column:
    return F.round(r, 6)

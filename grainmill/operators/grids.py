"""Task grids and resuming them.

Null keys are keys of their own and match null keys; repeated tasks stay repeated unless they are done; empty tables give
empty grids. A limit takes the first rows of a total order, so reruns take the same."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import sample_seed


def task_grid(models: DataFrame, prompts: DataFrame, samples: int, most: int = 10_000) -> DataFrame:
    """models x prompts x sample numbers: the grid itself is the result. models is a registry; one of more than `most`
    rows is an error. Repeated models or prompts repeat their tasks."""
    if (n := models.count()) > most:
        raise ValueError(f"{n} models: the registry may have {most}")
    return prompts.join(F.broadcast(models)).withColumn("sample_id", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))


def with_seed(grid: DataFrame, *keys: str) -> DataFrame:
    return grid.withColumn("sample_seed", sample_seed(*[F.col(k) for k in keys]))


def first_of(df: DataFrame, most: int | None, *order: str) -> DataFrame:
    """The first `most` rows in an order (a limit that the caller asks for); all of them if it is None."""
    return df if most is None else df.orderBy(*order).limit(most)


def not_done(tasks: DataFrame, done: DataFrame, keys: Sequence[str], most: int | None = None) -> DataFrame:
    """Tasks that aren't written yet, in key order at most `most` of them: rows that are done count for no limit. Null keys
    match null keys. Rows with errors count as written."""
    d = done.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    left = tasks.join(d, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]), "left_anti")
    return first_of(left, most, *keys)


def identity(df: DataFrame, keys: Sequence[str], present_only: bool = True) -> DataFrame:
    """Adds identity: JSON of the key fields; with present_only null ones are left out, and a row without any is
    identified by all it has."""
    fields = F.struct(*[F.col(k) for k in sorted(keys) if k in df.columns])
    if not present_only:
        return df.withColumn("identity", F.to_json(fields, {"ignoreNullFields": "false"}))
    some = reduce(lambda a, b: a | b, [F.col(k).isNotNull() for k in keys if k in df.columns], F.lit(False))
    return df.withColumn("identity", F.when(some, F.to_json(fields)).otherwise(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]))))


def number_prompts(lines: DataFrame, text: str, category: str, order: str, cap: int | None = None) -> DataFrame:
    """Prompt lines of each category: stripped, a leading 'N. ' dropped, blank ones left out, ids category_000 on."""
    from pyspark.sql import Window

    from ..functions.text import strip

    clean = strip(F.regexp_replace(strip(F.col(text)), r"^\d+\. ", ""))
    kept = lines.withColumn("prompt_text", clean).where(F.col("prompt_text") != "")
    d = kept.withColumn("prompt_idx", F.row_number().over(Window.partitionBy(category).orderBy(order)) - 1)
    d = d.withColumn("prompt_id", F.format_string("%s_%03d", F.col(category), F.col("prompt_idx")))
    return d.where(F.col("prompt_idx") < cap) if cap is not None else d

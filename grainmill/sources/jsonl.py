"""JSON lines read tolerantly: no row is lost, and two label dialects never meet in one inferred schema.

Blank lines are counted, not parsed; lines that are no object are kept as they are. Repeated lines and files named twice are rows of
their own; lines go by file and number. An empty file gives no rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .corpus import numbered_lines


def lines(spark: SparkSession, specs: Sequence[str]) -> DataFrame:
    """(alias, path, line_no, value) of files given as path or alias=path."""
    out = None
    for spec in specs:
        alias, eq, path = spec.partition("=")
        d = numbered_lines(spark, path if eq else spec).withColumn("alias", F.lit(alias if eq else None).cast("string"))
        out = d if out is None else out.unionByName(d)
    return out


def parsed(rows: DataFrame, text: str = "value") -> DataFrame:
    """Adds v (VARIANT, null if no object) and is_object; blank lines go."""
    v = F.try_parse_json(F.col(text))
    ok = F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))
    return rows.where(F.trim(text) != "").withColumn("is_object", ok).withColumn("v", F.when(ok, v))


def error_rows(rows: DataFrame, judge_model: str, text: str = "value") -> DataFrame:
    """Rows for lines that hold no object: judge_model, judge_error, raw_line."""
    return parsed(rows, text).where("not is_object").select(F.lit(judge_model).alias("judge_model"), F.lit("invalid JSON object").alias("judge_error"), F.col(text).alias("raw_line"))

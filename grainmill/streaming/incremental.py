"""Incremental JSON lines: new files are read once, rows with a known identity are dropped, results appended."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.grids import identity


def append_new(spark: SparkSession, source: str, schema: str, keys: Sequence[str], target: str, checkpoint: str, step: Callable[[DataFrame], DataFrame] = lambda d: d) -> StreamingQuery:
    """Reads what is new under source, drops rows whose identity was seen in any earlier run (kept in the state store under
    the checkpoint), applies step, and appends JSON lines to target. Stops when all is read; a later call resumes. A batch
    is written to its own folder in overwrite mode, so a batch that is run again after a failure isn't doubled."""
    rows = identity(spark.readStream.schema(schema).json(source), keys, present_only=False).dropDuplicates(["identity"])

    def write(batch: DataFrame, number: int) -> None:
        step(batch.drop("identity")).write.mode("overwrite").json(f"{target}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

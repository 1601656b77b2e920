"""Runs that call out for each row, in passes: transient errors are tried again later, and a run that was killed goes on.

A pass calls the function for every row that isn't done and writes what came of it under a number of its own; a log entry, written
last, makes the pass count. A row is done if its call went through, failed for good, or failed as often as allowed. The next
pass takes the others, after a wait that doubles from pass to pass. The driver waits, so that no task sleeps on a slot, and a task
that ran twice, or a pass that was cut off, leaves no row twice: only what a logged pass holds is read.

Defined results. A null request is called as an empty one. Rows that share a key are one row (the smallest request). Rows whose key
is null are left out. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUTCOME = "attempt int, answer string, error string, again boolean"


def _logged(df: DataFrame, folder: str) -> list[int]:
    """Numbers of the passes that count."""
    spark = df.sparkSession
    try:
        return sorted(r.number for r in spark.read.schema("number int").json(f"{folder}/log/*").collect())
    except Exception as e:  # no log yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []


def outcomes(df: DataFrame, key: str, folder: str) -> DataFrame:
    """(key, attempt, answer, error, again) of all logged passes; df gives the key's type."""
    kind = dict(df.dtypes)[key]
    found = [df.sparkSession.read.schema(f"`{key}` {kind}, {OUTCOME}").parquet(f"{folder}/pass={n}") for n in _logged(df, folder)]
    empty = df.sparkSession.createDataFrame([], f"`{key}` {kind}, {OUTCOME}")
    return reduce(DataFrame.unionByName, found, empty)


def one_pass(df: DataFrame, key: str, call: Callable[[str, int], str], folder: str, transient: tuple[type[Exception], ...] = (TimeoutError, ConnectionError), attempts: int = 3) -> int:
    """Calls for the rows of df (key, request) that aren't done; returns how many there were. call: (request, attempt)."""
    number = max(_logged(df, folder), default=-1) + 1
    before = outcomes(df, key, folder)
    tried = before.groupBy(F.col(key).alias("__key")).agg(F.count("*").cast("int").alias("__tried"), F.min(F.when(~F.col("again"), 0).otherwise(1)).alias("__open"))
    rows = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.coalesce("request", F.lit(""))).alias("request"))
    rows = rows.join(tried, F.col(key) == F.col("__key"), "left").where(F.coalesce("__open", F.lit(1)) == 1)
    todo = rows.select(key, "request", F.coalesce("__tried", F.lit(0)).alias("attempt"))

    def one(request: str, attempt: int) -> tuple[str | None, str | None, bool]:
        try:
            return call(request, attempt), None, False
        except transient as e:
            return None, f"{type(e).__name__}: {e}", attempt + 1 < attempts
        except Exception as e:  # a row's failure is its result
            return None, f"{type(e).__name__}: {e}", False

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = pd.DataFrame([one(r, a) for r, a in zip(b["request"], b["attempt"], strict=True)], columns=["answer", "error", "again"], index=b.index)
            yield pd.concat([b.drop(columns="request"), done], axis=1)

    todo.mapInPandas(run, f"`{key}` {dict(df.dtypes)[key]}, {OUTCOME}").write.mode("overwrite").parquet(f"{folder}/pass={number}")
    count = df.sparkSession.read.parquet(f"{folder}/pass={number}").count()
    if count:
        df.sparkSession.createDataFrame([(number,)], "number int").coalesce(1).write.mode("overwrite").json(f"{folder}/log/{number}")
    return count


def resumable(df: DataFrame, key: str, call: Callable[[str, int], str], folder: str, transient: tuple[type[Exception], ...] = (TimeoutError, ConnectionError), attempts: int = 3, first_wait: float = 1.0) -> DataFrame:
    """(key, attempts, answer, error), a row for each key, once all are done. A folder with logged passes of an earlier run is
    gone on with. Waits before the second pass first_wait seconds, and twice as long before each further one."""
    wait = first_wait
    while one_pass(df, key, call, folder, transient, attempts):
        if outcomes(df, key, folder).groupBy(key).agg(F.bool_and("again").alias("open")).where("open").isEmpty():
            continue
        time.sleep(wait)
        wait *= 2
    last = outcomes(df, key, folder).groupBy(key).agg(F.count("*").cast("int").alias("attempts"), F.max_by(F.struct("answer", "error"), "attempt").alias("o"))
    return last.select(key, "attempts", "o.answer", "o.error")

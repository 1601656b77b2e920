"""Small helpers that the corpus operators share: lineage cuts, checked broadcasts, Arrow maps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Largest side, in bytes, that is sent to every executor; anything above goes through a shuffle.
BROADCAST_LIMIT = 16 << 20

#: ASCII white space as the contracts define it; bytes.split() splits on exactly these.
SPACE = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Only a local master may do without: it gets a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="checkpoints-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again, so that a lost executor costs no recomputation
    and later steps start from this table. Spark's own checkpoint() keeps rows uncompressed; these are column files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/grainmill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """df marked for broadcast if its row count times row_bytes is within the limit, else df itself.
    df should be a cut table, as it is counted here."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def arrow_map(df: DataFrame, batch_fn: Callable[[], Callable[[pa.RecordBatch], Iterator[dict] | dict]], schema: str) -> DataFrame:
    """mapInArrow with per-task setup: batch_fn() runs once in a task and returns the function of a record batch,
    which returns the columns of the output batch by name."""
    out = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, step = to_arrow_schema(out), batch_fn()
        for b in batches:
            cols = step(b)
            yield pa.RecordBatch.from_arrays([x if isinstance(x := cols[f.name], pa.Array) else pa.array(x, f.type) for f in types], schema=types)

    return df.mapInArrow(run, out)


def as_bytes(column: str = "text"):
    """A text column as UTF-8 bytes, null as empty: Python tasks get bytes without a decode."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def pick(docs: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """Only the named inputs under fixed names, so that extra columns of the input cannot clash."""
    return docs.select(*[(F.col(f"`{v}`") if isinstance(v, str) else v).alias(k) for k, v in wanted.items()])


def mark(text_col: str = "text"):
    """A hash that, with the id, names a row: rows alike in both are one document."""
    return F.xxhash64(F.col(text_col))


def keep_rows(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str, how: str) -> DataFrame:
    """docs semi- or anti-joined with a cut table of (id, mark); null ids match null ids. The keys go to all executors
    if they are few, else both sides are shuffled."""
    side = small(keys.select(F.col("id").alias("__id"), F.col("mark").alias("__mark")).distinct(), 24)
    same = docs[id_col].cast("long").eqNullSafe(F.col("__id")) & (mark(text_col) == F.col("__mark"))
    return docs.join(side, same, "left_semi" if how == "semi" else "left_anti")


def once_each(docs: DataFrame, repeated: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with one row for each (id, mark) in `repeated` (a cut table of those that occur more than once); other rows
    stay as they are and are not shuffled."""
    if repeated.isEmpty():
        return docs
    rest = keep_rows(docs, repeated, id_col, text_col, "anti")
    return rest.unionByName(keep_rows(docs, repeated, id_col, text_col, "semi").dropDuplicates([id_col, text_col]))


def survivors(docs: DataFrame, judged: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs without the rows whose (id, mark) isn't kept, and one row of those that repeat. judged: a cut table of id,
    mark and kept for every row of docs; rows alike in id and mark are judged alike."""
    drops = cut(judged.where("not kept").select("id", "mark"))
    repeated = cut(judged.where("kept").groupBy("id", "mark").count().where("count > 1").select("id", "mark"))
    return once_each(keep_rows(docs, drops, id_col, text_col, "anti"), repeated, id_col, text_col)

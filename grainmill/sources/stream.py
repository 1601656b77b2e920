"""Flat streams of 32-bit token ids as a data source: written by tasks side by side, read from any place without a scan.

A stream is a folder of part files of little-endian int32 and a manifest that lays them end to end: for each part its place
in the stream and its number of tokens. Tasks write parts under names of their own; the commit writes the manifest, so that
what failed or repeated tasks left behind is in no stream. A reader cuts the stream into ranges of blocks, and a task reads
the bytes of its range from the parts that hold them.

    write_stream(df, "ids", ["doc_id"], path)                                    # append=True lays new parts behind
    read_stream(spark, path, length=1024, start=first_token, stop=last_token)   # (block_id, ids)

    update_stream(files, "path", "mark", path, encode)                           # rewrites from the first changed part on

An updated stream is a hash tree over its files: each part has the digest of the keys and marks (hashes, or sizes and times) of its files,
the stream that of its parts. An update compares digests part by part, keeps the parts in front of the first that differs, and
encodes and writes only what stands behind them.

Paths are local or shared folders, or anything that pyarrow's file systems open (hdfs://, s3://).

Defined results. Null arrays and null ids take no place; rows that tie in the order come in any order. An empty table gives
an empty stream. A last block that isn't full is left out, or filled up with `pad` if it has more than one token.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

MANIFEST, SIZE = "_stream.json", 4

#: Tokens of a task's range, of a batch that it gives.
RANGE, BATCH = 1 << 24, 1 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def parts_of(path: str) -> list[dict]:
    """The manifest's parts (file, start, tokens) in order; none if there is no manifest."""
    store, root = opened(path)
    name = f"{root.rstrip('/')}/{MANIFEST}"
    if store.get_file_info(name).type == fs.FileType.NotFound:
        return []
    with store.open_input_file(name) as f:
        return json.loads(f.read())["parts"]


@dataclass
class Range(InputPartition):
    """Blocks of a task: the first one's number, the first token and the one behind the last."""

    block: int
    start: int
    stop: int


@dataclass
class Part(WriterCommitMessage):
    """last, files, digest: of a part of an updated stream, the last key, the number of files and the digest."""

    partition: int
    file: str
    tokens: int
    last: str = ""
    files: int = 0
    digest: int = 0


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.length = options["path"], int(options.get("length", 1024))
        self.pad = int(options["pad"]) if "pad" in options else None
        self.parts = parts_of(self.path)
        total = self.parts[-1]["start"] + self.parts[-1]["tokens"] if self.parts else 0
        self.start = min(total, max(0, int(options.get("start", 0))))
        self.stop = min(total, max(self.start, int(options.get("stop", total))))
        self.step = max(1, int(options.get("range", RANGE)) // self.length)

    def partitions(self) -> Sequence[Range]:
        full, rest = divmod(self.stop - self.start, self.length)
        blocks = full + (self.pad is not None and rest > 1)
        ends = [min(b + self.step, blocks) for b in range(0, blocks, self.step)]
        return [Range(b, self.start + b * self.length, min(self.stop, self.start + e * self.length)) for b, e in zip(range(0, blocks, self.step), ends, strict=True)] or [Range(0, 0, 0)]

    def tokens(self, start: int, stop: int) -> bytes:
        """The bytes of tokens start to stop, from the parts that hold them."""
        store, root = opened(self.path)
        out = []
        for p in self.parts:
            a, b = max(start, p["start"]), min(stop, p["start"] + p["tokens"])
            if a < b:
                with store.open_input_file(f"{root.rstrip('/')}/{p['file']}") as f:
                    out.append(f.read_at((b - a) * SIZE, (a - p["start"]) * SIZE))
        return b"".join(out)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        step = max(1, BATCH // self.length) * self.length
        for at in range(partition.start, partition.stop, step):
            raw = self.tokens(at, min(at + step, partition.stop))
            blocks = -(-len(raw) // (self.length * SIZE))
            if missing := blocks * self.length - len(raw) // SIZE:
                raw += int(self.pad).to_bytes(SIZE, "little", signed=True) * missing
            flat = pa.Array.from_buffers(pa.int32(), blocks * self.length, [None, pa.py_buffer(raw)])
            ids = pa.ListArray.from_arrays(pa.array(range(0, len(flat) + 1, self.length), pa.int32()), flat)
            first = partition.block + (at - partition.start) // self.length
            yield pa.RecordBatch.from_arrays([pa.array(range(first, first + blocks), pa.int64()), ids], names=["block_id", "ids"])


#: Digests are sums of 60 bits of SHA-256, so that the order of files in a part doesn't matter, modulo this.
MODULUS = 1 << 61


def _digest(key: str, mark: str) -> int:
    return int(hashlib.sha256(f"{key}|{mark}".encode()).hexdigest()[:15], 16)


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, keep: int | None = None):
        """keep: parts of the stream that stay in front; all, or none if it is overwritten."""
        self.path, self.keep = path, 0 if overwrite and keep is None else keep

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        store, root = opened(self.path)
        partition = TaskContext.get().partitionId()
        name, count = f"part-{partition:06d}-{uuid.uuid4().hex}.bin", 0
        last, files, digest = "", 0, 0
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root.rstrip('/')}/{name}") as f:
            for b in iterator:
                if b.num_columns > 1 and b.num_rows:
                    last, files = b.column(1)[-1].as_py(), files + b.num_rows
                    digest += sum(_digest(k, m) for k, m in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
                for chunk in (b.column(0).slice(k, 4096) for k in range(0, b.num_rows, 4096)):
                    ids = pc.drop_null(chunk.flatten()).cast(pa.int32())
                    f.write(ids.to_numpy(zero_copy_only=False).astype("<i4", copy=False).tobytes())
                    count += len(ids)
        return Part(partition, name, count, last, files, digest % MODULUS)

    def commit(self, messages: list[Part]) -> None:
        """The stream is what this writes; parts of an overwritten stream, and of tasks that didn't count, go afterwards."""
        store, root = opened(self.path)
        parts = parts_of(self.path)[: self.keep]
        at = parts[-1]["start"] + parts[-1]["tokens"] if parts else 0
        for m in sorted((m for m in messages if m and (m.tokens or m.files)), key=lambda m: m.partition):
            parts.append({"file": m.file, "start": at, "tokens": m.tokens} | ({"last": m.last, "files": m.files, "digest": m.digest} if m.files else {}))
            at += m.tokens
        store.create_dir(root, recursive=True)
        new = f"{root.rstrip('/')}/{MANIFEST}.{uuid.uuid4().hex}"
        with store.open_output_stream(new) as f:
            root_digest = hashlib.sha256("|".join(f"{p['files']}:{p['digest']}" for p in parts if "digest" in p).encode()).hexdigest()
            f.write(json.dumps({"parts": parts, "tokens": at, "digest": root_digest}).encode())
        store.move(new, f"{root.rstrip('/')}/{MANIFEST}")
        held = {p["file"] for p in parts}
        for info in store.get_file_info(fs.FileSelector(root)):
            if info.base_name.startswith("part-") and info.base_name not in held:
                store.delete_file(info.path)

    def abort(self, messages: list[Part]) -> None:
        store, root = opened(self.path)
        for m in messages:
            if m:
                store.delete_file(f"{root.rstrip('/')}/{m.file}")


class Int32Stream(DataSource):
    @classmethod
    def name(cls) -> str:
        return "int32_stream"

    def schema(self) -> str:
        return "block_id long, ids array<int>"

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite, int(self.options["keep"]) if "keep" in self.options else None)


def write_stream(df: DataFrame, ids: str, order: Sequence[str], path: str, append: bool = False) -> None:
    """The arrays of df, one behind the other in the order, as a stream at path."""
    df.sparkSession.dataSource.register(Int32Stream)
    sorted_ = df.where(F.col(ids).isNotNull()).repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_.select(F.col(ids).cast("array<int>").alias("ids")).write.format("int32_stream").mode("append" if append else "overwrite").option("path", path).save()


def read_stream(spark: SparkSession, path: str, length: int = 1024, start: int = 0, stop: int | None = None, pad: int | None = None) -> DataFrame:
    """(block_id, ids): blocks of the tokens from start to stop, numbered from 0."""
    spark.dataSource.register(Int32Stream)
    options = {"path": path, "length": length, "start": start} | ({} if stop is None else {"stop": stop}) | ({} if pad is None else {"pad": pad})
    return spark.read.format("int32_stream").options(**options).load()


def update_stream(files: DataFrame, key: str, mark: str, path: str, encode, parts: int | None = None) -> int:
    """Brings the stream at path to the files (key, mark, ...; strings without nulls, keys once each) in the order of their keys, and returns
    how many parts stayed. encode: files -> files with ids (array<int>); it is given only the files behind the parts that stay, and
    must keep key and mark. parts: about how many parts those files are written in."""
    spark = files.sparkSession
    spark.dataSource.register(Int32Stream)
    old = [p for p in parts_of(path) if "digest" in p]
    bounds = F.array(*[F.lit(p["last"]) for p in old]).cast("array<string>")
    number = F.conv(F.substring(F.sha2(F.concat_ws("|", key, mark), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    place = F.size(F.filter(bounds, lambda b: b < F.col(key)))
    found = {r.place: (r.files, int(r.digest) % MODULUS) for r in files.groupBy(place.alias("place")).agg(F.count("*").alias("files"), F.sum(number).alias("digest")).collect()}
    keep = next((k for k, p in enumerate(old) if found.get(k) != (p["files"], p["digest"])), len(old))
    if keep == len(old) and old and keep not in found:
        return keep
    behind = files.where(F.col(key) > old[keep - 1]["last"]) if keep else files
    ordered = encode(behind)
    ordered = (ordered.repartitionByRange(parts, key) if parts else ordered.repartitionByRange(key)).sortWithinPartitions(key)
    columns = [F.coalesce(F.col("ids").cast("array<int>"), F.array().cast("array<int>")).alias("ids"), F.col(key).alias("key"), F.col(mark).alias("mark")]
    ordered.select(*columns).write.format("int32_stream").mode("append").option("path", path).option("keep", keep).save()
    return keep

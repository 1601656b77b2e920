"""Hard negatives by a vertical scan (BOND): dimensions as columns, read in each anchor's order, with bounds on what is left.

Rows are packed into blocks of at most ROWS rows that hold one array for each dimension, with its least and greatest value.
An anchor reads the dimensions of a block in descending order of its own magnitudes. After each few dimensions a row's score
lies between its partial sum plus the least and the greatest contribution that the unread dimensions can make; rows whose
interval can't change the result leave the candidate bitmap. A first scan finds each anchor's positives (the best of its
label), a second one the best rows of other labels within the score windows that these positives set; both end with exact
integer scores of the rows that stay.

Anchors are a stated set (a fiftieth of all rows), so anchors x rows is what is asked for. They are packed into chunks of at
most about ANCHORS, and every block meets every chunk once, in a grid of cells (chunk, range of blocks): both sides are
dealt to cells by a shuffle, so nothing is broadcast or collected, a cell's size is fixed, and neither a label nor a vector
that a third of all rows share makes one cell larger. A cell passes on at most a few rows of each anchor.

Defined results. Rows with a null label or vector, or a null or non-finite component, take no part. A null id is no anchor
and comes last among ties. Repeated rows are rows of their own, as anchors, positives and negatives; an anchor leaves out
only itself. A shorter vector counts as ending in zeros. Sums must fit 64 bits. A negative positive_score has an empty window.
Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import cut, pick

#: Rows of a block, anchors of a chunk, dimensions read before bounds are looked at.
ROWS, ANCHORS, STEP = 1 << 14, 1 << 13, 8

#: A component becomes the floor of SCALE times itself. Every ANCHOR_STEPth id is an anchor.
SCALE, ANCHOR_STEP = 256, 50

BLOCK = "block long, n int, ids binary, nulls binary, labels binary, columns array<binary>, low array<long>, high array<long>"
ANCHOR = "block long, pos int, id long, label long, vector binary"
CHUNK = "chunk long, a_block binary, a_pos binary, a_label binary, a_size array<int>, a_vector binary, a_scores array<array<long>>"
POSITIVE = "a_block long, a_pos int, id long, score long"
NEGATIVE = "a_block long, a_pos int, positive_score long, id long, score long"


def prepared(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, v): rows that take part, with integer components."""
    base = pick(vectors, {"id": F.col(id_col).cast("long"), "label": F.col(label_col).cast("long"), "vector": F.col(vector_col).cast("array<double>")})
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return base.where("label is not null and vector is not null").where(~bad).select("id", "label", F.transform("vector", lambda x: F.floor(x * SCALE).cast("long")).alias("v"))


def _mapped(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """rows: a task's batches -> columns of output batches."""
    out = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = to_arrow_schema(out)
        for cols in rows(batches):
            yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in types], schema=types)

    return df.mapInArrow(run, out)


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """dimensions x rows of a column of integer lists, shorter ones filled up with zeros."""
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes := lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    width = int(sizes.max(initial=0))
    if len(sizes) and sizes.min() == width:
        return flat.reshape(len(sizes), width).T
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(ends - sizes, sizes)] = flat
    return out.T


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows as blocks; inside a block they stand by id, null ids last, so that places break ties."""

    def block(held: list[pa.RecordBatch], number: int) -> dict:
        t = pa.Table.from_batches(held).combine_chunks()
        ids, none = t["id"].fill_null(0).to_numpy(), t["id"].is_null().to_numpy()
        order = np.lexsort((ids, none))
        m = _matrix(t["v"].chunk(0))[:, order]
        cols = {"block": number, "n": len(order), "ids": ids[order].tobytes(), "nulls": none[order].tobytes(), "labels": t["label"].to_numpy()[order].tobytes()}
        cols |= {"columns": [np.ascontiguousarray(c).tobytes() for c in m], "low": m.min(axis=1).tolist(), "high": m.max(axis=1).tolist()}
        return {k: [v] for k, v in cols.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held, count, number = [], 0, TaskContext.get().partitionId() << 32
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS // 4):
                held.append(whole.slice(at, ROWS // 4))
                count += held[-1].num_rows
                if count > ROWS * 3 // 4:
                    yield block(held, number)
                    held, count, number = [], 0, number + 1
        if held:
            yield block(held, number)

    return _mapped(rows, run, BLOCK)


def _decoded(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(block, ids, nulls, labels, dimensions x rows) of each block of a batch."""
    for r in b.to_pylist():
        columns = np.frombuffer(b"".join(r["columns"]), np.int64).reshape(len(r["columns"]), r["n"])
        yield r["block"], np.frombuffer(r["ids"], np.int64), np.frombuffer(r["nulls"], bool), np.frombuffer(r["labels"], np.int64), columns


def _anchors(blocks: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for block, ids, nulls, labels, columns in _decoded(b):
                at = np.nonzero((ids % ANCHOR_STEP == 0) & ~nulls)[0]
                vectors = [columns[:, p].tobytes() for p in at]
                yield {"block": np.full(len(at), block), "pos": at.astype(np.int32), "id": ids[at], "label": labels[at], "vector": vectors}

    return _mapped(blocks, run, ANCHOR)


def _chunks(anchors: DataFrame, n_chunks: int) -> DataFrame:
    """anchors (with scores, an array that may be empty) as chunks, a row for each."""
    dealt = anchors.withColumn("chunk", F.pmod(F.xxhash64("block", "pos"), F.lit(n_chunks)))

    def chunk(number: int, rows: list[dict]) -> dict:
        cols = {"chunk": number, "a_vector": b"".join(r["vector"] for r in rows), "a_size": [len(r["vector"]) // 8 for r in rows], "a_scores": [r["scores"] for r in rows]}
        cols |= {f"a_{k}": np.array([r[k] for r in rows], np.int64).tobytes() for k in ("block", "pos", "label")}
        return {k: [v] for k, v in cols.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        number, held = None, []
        for b in batches:
            for r in b.to_pylist():
                if held and r["chunk"] != number:
                    yield chunk(number, held)
                    held = []
                number = r["chunk"]
                held.append(r)
        if held:
            yield chunk(number, held)

    return _mapped(dealt.repartition(n_chunks, "chunk").sortWithinPartitions("chunk"), run, CHUNK)


def _cells(blocks: DataFrame, chunks: DataFrame, n_blocks: int, n_chunks: int) -> DataFrame:
    """Every block with every chunk, dealt by (chunk, range of blocks)."""
    ranges = n_blocks if n_blocks < 1000 else -(-n_blocks // 4)
    left = blocks.withColumn("range", F.pmod(F.xxhash64("block"), F.lit(ranges))).withColumn("chunk", F.explode(F.expr(f"sequence(0L, {n_chunks - 1}L)")))
    right = chunks.withColumn("range", F.explode(F.expr(f"sequence(0L, {ranges - 1}L)")))
    return left.hint("merge").join(right, ["chunk", "range"])


def bond(columns: np.ndarray, low: np.ndarray, high: np.ndarray, anchor: np.ndarray, at: np.ndarray, stays: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(places, exact scores) of the rows at `at` that stays(lower bounds, upper bounds) never drops from the bitmap.
    Whole numbers in doubles have exact bounds; those of 64-bit integers are doubles with room for rounding."""
    used = min(len(anchor), len(columns))
    order = np.argsort(-np.abs(anchor[:used]), kind="stable")
    ends = np.sort(anchor[order].astype(np.float64) * np.stack((low[order], high[order])), axis=0)
    least, most = np.concatenate((ends[:, ::-1].cumsum(axis=1)[:, ::-1], np.zeros((2, 1))), axis=1)
    if columns.dtype != np.float64:
        room = np.abs(ends).sum() * 1e-12 + 4096
        least, most = least - room, most + room
    sums = np.zeros(len(at), columns.dtype)
    for k in range(0, used, STEP):
        dims = order[k : k + STEP]
        sums += anchor[dims] @ np.take(columns[dims], at, axis=1)
        done = min(k + STEP, used)
        bitmap = stays(sums + least[done], sums + most[done])
        if not bitmap.all():
            at, sums = at[bitmap], sums[bitmap]
    return at, sums


def _best(n: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Keeps rows that can be among the n best; ties stay."""

    def stays(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        if len(lower) <= n:
            return np.ones(len(lower), bool)
        return upper >= np.partition(lower, -n)[-n]

    return stays


def _windows(low: np.ndarray, high: np.ndarray, n: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Keeps rows that can be among the n best of a window [low, high]; n rows that are surely inside raise its floor."""

    def stays(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        keep = np.zeros(len(lower), bool)
        for a, b in zip(low, high, strict=True):
            inside = lower[(lower >= a) & (upper <= b)]
            floor = np.partition(inside, -n)[-n] if len(inside) >= n else a
            keep |= (upper >= floor) & (lower <= b)
        return keep

    return stays


def _scan(cells: DataFrame, one: Callable, schema: str) -> DataFrame:
    """one(columns, low, high, labels, anchor, label, own place or -1, scores): ((place, score, window), ...) of one
    anchor in one block."""

    def cell(b: dict) -> dict:
        n, width = b["n"], len(b["columns"])
        columns = np.frombuffer(b"".join(b["columns"]), np.int64).reshape(width, n)
        ids, nulls, labels = np.frombuffer(b["ids"], np.int64), np.frombuffer(b["nulls"], bool), np.frombuffer(b["labels"], np.int64)
        vectors = np.frombuffer(b["a_vector"], np.int64)
        low, high = np.array(b["low"], np.int64), np.array(b["high"], np.int64)
        if width * float(np.abs(columns).max(initial=1)) * float(np.abs(vectors).max(initial=1)) < 2**53:
            columns, vectors, low, high = (x.astype(np.float64) for x in (columns, vectors, low, high))  # exact, and faster
        starts = np.concatenate(([0], np.cumsum(b["a_size"]))).astype(np.int64)
        a_block, a_pos, a_label = (np.frombuffer(b[k], np.int64) for k in ("a_block", "a_pos", "a_label"))
        out: list[tuple] = []
        for k, scores in enumerate(b["a_scores"]):
            own = a_pos[k] if a_block[k] == b["block"] else -1
            for place, score, window in one(columns, low, high, labels, vectors[starts[k] : starts[k + 1]], a_label[k], own, scores):
                out.append((int(a_block[k]), int(a_pos[k]), window, None if nulls[place] else int(ids[place]), int(score)))
        cols = list(zip(*out, strict=True)) or [()] * 5
        return dict(zip(("a_block", "a_pos", "positive_score", "id", "score"), cols, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for k in range(b.num_rows):
                yield cell(b.slice(k, 1).to_pylist()[0])

    wanted = ["block", "n", "ids", "nulls", "labels", "columns", "low", "high", "a_block", "a_pos", "a_label", "a_size", "a_vector", "a_scores"]
    return _mapped(cells.select(*wanted), run, schema)


def _first(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The n best rows of each key as column rank; tasks cut theirs to n before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def mine(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its
    `positives` best rows of the same label, the `negatives` best rows of other labels that score from least to most percent
    of the positive's score. vectors: label_col as it is to be used."""
    blocks = cut(_blocks(prepared(vectors, id_col, vector_col, label_col)))
    anchors = cut(_anchors(blocks))
    n_blocks, n_chunks = blocks.count(), -(-anchors.count() // ANCHORS)
    if not n_chunks:
        return blocks.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")

    def nearest(columns, low, high, labels, anchor, label, own, scores):
        at = np.nonzero(labels == label)[0]
        at, exact = bond(columns, low, high, anchor, at[at != own], _best(positives))
        return [(at[k], exact[k], None) for k in np.argsort(-exact, kind="stable")[:positives]]

    def within(columns, low, high, labels, anchor, label, own, scores):
        floor, top = (np.array([f(int(p)) for p in scores]) for f in (lambda p: -(-p * least // 100), lambda p: p * most // 100))
        at, exact = bond(columns, low, high, anchor, np.nonzero(labels != label)[0], _windows(floor, top, negatives))
        found = []
        for k in range(len(scores)):
            inside = np.nonzero((exact >= floor[k]) & (exact <= top[k]))[0]
            found += [(at[h], exact[h], int(scores[k])) for h in inside[np.argsort(-exact[inside], kind="stable")[:negatives]]]
        return found

    first = _cells(blocks, _chunks(anchors.withColumn("scores", F.expr("cast(array() as array<long>)")), n_chunks), n_blocks, n_chunks)
    near = cut(_first(_scan(first, nearest, POSITIVE), ["a_block", "a_pos"], positives).withColumnRenamed("score", "positive_score"))
    scores = near.where("positive_score >= 0").groupBy("a_block", "a_pos").agg(F.collect_set("positive_score").alias("scores"))
    asking = anchors.join(scores.withColumnsRenamed({"a_block": "block", "a_pos": "pos"}), ["block", "pos"])
    second = _cells(blocks, _chunks(asking, n_chunks), n_blocks, n_chunks)
    hard = cut(_first(_scan(second, within, NEGATIVE), ["a_block", "a_pos", "positive_score"], negatives))
    named = near.select("a_block", "a_pos", "positive_score", F.col("id").alias("positive_id")).join(anchors.select(F.col("block").alias("a_block"), F.col("pos").alias("a_pos"), F.col("id").alias("anchor_id")), ["a_block", "a_pos"])
    return named.join(hard, ["a_block", "a_pos", "positive_score"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

"""SimHash near-duplicates: exact radius search among distinct fingerprints by tiled XOR and bit counts.

Method. Fingerprints are made once for each text in Arrow batches. Equal fingerprints are one node. Two fingerprints
at most r bits apart agree on at least one of r + 1 blocks of bits, so each node is dealt to the r + 1 buckets of its
block values and compared with the nodes there only; no link is lost. All comparison is by tiles: nodes are sorted by
population count and cut into tiles; a pair of tiles whose population counts are more than r apart is skipped, any
other is one numpy XOR and bit count. Small buckets share tiles, in which only rows of one bucket are linked. A bucket above `hot` nodes is dealt to several tasks as pairs of (population count, salt)
tiles. Each task returns a spanning forest of what it found, never all pairs.

Defined results. Null and empty texts: fingerprint 0, linked like any other. Fewer than three words: one shingle of
all of them. Repeated rows: one output row for each input row. Null ids: the row gets the component's smallest
non-null id. Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, as_bytes, cut, mark, pick, small, survivors
from .components import components

BITS, SEED, TILE = 64, 42, 512
#: Rows of a tile of small buckets, and of the tiles that are packed and sorted together.
PACKED_TILE, PACK = 64, 2048


def fingerprint(text: bytes, width: int = 3) -> int:
    """The 64-bit majority of the XXH64 of all word shingles of text, whose A-Z are lower-cased here."""
    words = text.lower().split()
    if not words:
        return 0
    joined, width = b" ".join(words), min(width, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start, x = end - size, xxhash.xxh64_intdigest
    counts, n = np.zeros(BITS, np.int64), len(words) - width + 1
    for at in range(0, n, 1 << 16):
        upto = min(n, at + (1 << 16))
        h = np.fromiter((x(joined[s:e], SEED) for s, e in zip(start[at:upto].tolist(), end[at + width - 1 : upto + width - 1].tolist())), np.uint64, upto - at)
        counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, mark, fp): fp is the fingerprint's bits as a signed LONG. Narrow; one pass over the text."""

    def setup():
        def step(b: pa.RecordBatch) -> dict:
            fp = np.array([fingerprint(t, width) for t in b.column(2).to_pylist()], np.uint64)
            return {"id": b.column(0), "mark": b.column(1), "fp": pa.array(fp.view(np.int64))}

        return step

    return arrow_map(pick(docs, {"id": F.col(id_col).cast("long"), "mark": mark(text_col), "text": as_bytes(text_col)}), setup, "id long, mark long, fp long")


class Forest:
    """Union-find over the rows of one task; keeps the links that joined two trees."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j


def tile_links(left: np.ndarray, right: np.ndarray | None, radius: int, tile: int = TILE, group: np.ndarray | None = None, tally: list[int] | None = None) -> list[tuple[int, int]]:
    """Spanning links within `radius` inside left (right None) or between left and right: uint64 arrays sorted by
    population count. Compares tile by tile, skipping pairs of tiles whose population counts are too far apart.
    group: only rows of left of one group are linked (right None). tally: [tile pairs compared, skipped] to add to."""
    other = left if right is None else right
    pl, po = np.bitwise_count(left), np.bitwise_count(other)
    forest, out, shift = Forest(len(left) + (0 if right is None else len(other))), [], 0 if right is None else len(left)
    tally = [0, 0] if tally is None else tally
    for i in range(0, len(left), tile):
        a = left[i : i + tile]
        lo, hi = int(pl[i]), int(pl[min(i + tile, len(left)) - 1])
        for j in range(i if right is None else 0, len(other), tile):
            last = min(j + tile, len(other)) - 1
            if int(po[j]) > hi + radius or int(po[last]) < lo - radius:
                tally[1] += 1
                continue
            tally[0] += 1
            near = np.bitwise_count(a[:, None] ^ other[None, j : j + tile]) <= radius
            if group is not None:
                near &= group[i : i + tile, None] == group[None, j : j + tile]
            x, y = np.nonzero(near)
            if right is None:  # each pair once
                once = x + i < y + j
                x, y = x[once], y[once]
            for p, q in zip((x + i).tolist(), (y + j).tolist()):
                if forest.join(p, q + shift):
                    out.append((p, q))
    return out


def packed_links(bucket: np.ndarray, fp: np.ndarray, radius: int, tally: list[int] | None = None) -> list[tuple[int, int]]:
    """Links of many small buckets in one go: their rows, sorted by population count, share tiles of PACKED_TILE rows."""
    order = np.argsort(np.bitwise_count(fp), kind="stable")
    return [(int(order[p]), int(order[q])) for p, q in tile_links(fp[order], None, radius, PACKED_TILE, bucket[order], tally)]


def bucket_links(bucket: np.ndarray, side: np.ndarray, fp: np.ndarray, radius: int, tally: list[int] | None = None) -> np.ndarray:
    """Links (a, b) of complete buckets; rows sorted by bucket, side and population count. Buckets of PACKED_TILE rows and
    fewer that have one side are packed, PACK rows at a time; any other is compared by itself."""
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    size = np.diff(np.append(first, len(fp)))
    two = side[first + size - 1] != side[first]
    little = (size <= PACKED_TILE) & ~two
    at = np.flatnonzero(np.repeat(little & (size > 1), size))
    edges, upto = [], np.cumsum(size[little & (size > 1)])
    begin = 0
    while begin < len(at):  # whole buckets, PACK rows of them or a few more
        k = np.searchsorted(upto, begin + PACK)
        stop = int(upto[min(k, len(upto) - 1)])
        rows = at[begin:stop]
        edges += [(rows[p], rows[q]) for p, q in packed_links(bucket[rows], fp[rows], radius, tally)]
        begin = stop
    for s, k, both in zip(first[~little].tolist(), size[~little].tolist(), two[~little].tolist()):
        if both:
            cut = s + int(np.searchsorted(side[s : s + k], 1))
            edges += [(s + p, cut + q) for p, q in tile_links(fp[s:cut], fp[cut : s + k], radius, tally=tally)]
        else:
            edges += [(s + p, s + q) for p, q in tile_links(fp[s : s + k], None, radius, tally=tally)]
    return fp[np.array(edges, np.int64).reshape(-1, 2)]


def _bucket_links(radius: int):
    """mapInArrow function over rows (bucket, side, fp) sorted by bucket, side and population count: links of each bucket."""

    def found(part: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        e = np.unique(bucket_links(*part, radius), axis=0).view(np.int64)
        if len(e):
            yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            cols[2] = cols[2].view(np.uint64)
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
            stop = int(np.searchsorted(held[0], held[0][-1], "left"))  # the last bucket may go on in the next batch
            if stop:
                yield from found([x[:stop] for x in held])
                held = [x[stop:] for x in held]
        if held is not None:
            yield from found(held)

    return run


def _buckets(nodes: DataFrame, radius: int, hot: int) -> DataFrame:
    """(bucket, side, pop, fp): each node in each of its buckets. The bucket's bits: block, its value, then the tile pair."""
    width = -(-BITS // (radius + 1))
    value = lambda k: F.shiftrightunsigned(F.shiftleft("fp", BITS - min(BITS, (k + 1) * width)), BITS - min(BITS, (k + 1) * width) + k * width)
    keys = F.array(*[F.shiftleft(F.lit(k).cast("long") * F.lit(1 << width) + value(k), 30) for k in range(radius + 1)])
    rows = nodes.select("fp", F.bit_count("fp").cast("int").alias("pop"), F.explode(keys).alias("bucket"))
    sizes = cut(rows.groupBy("bucket").count().where("count > 1"))
    big = sizes.where(F.col("count") > hot)
    plain = rows.join(sizes.where(F.col("count") <= hot).select("bucket"), "bucket", "left_semi").select("bucket", F.lit(0).alias("side"), "pop", "fp")
    if big.isEmpty():
        return plain
    # tiles of a hot bucket: (population count, salt); a pair of tiles is one bucket of two sides, named by a hash (two
    # pairs of one hash are compared together, which finds no wrong link)
    salts = F.ceil(F.col("count") / hot).cast("int")
    mine = rows.join(big.select("bucket", salts.alias("salts")), "bucket").withColumn("salt", F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int"))
    pops = F.sequence(F.col("pop") - radius, F.col("pop") + radius)
    pairs = mine.select("bucket", "pop", "fp", "salt", "salts", F.explode(pops).alias("pop2")).select("*", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt2"))
    code = lambda p, s: F.col(p).cast("long") * F.col("salts") + F.col(s)
    ahead = code("pop", "salt") <= code("pop2", "salt2")
    low, high = F.when(ahead, code("pop", "salt")).otherwise(code("pop2", "salt2")), F.when(ahead, code("pop2", "salt2")).otherwise(code("pop", "salt"))
    tiles = pairs.where("pop2 between 0 and 64").select(F.xxhash64("bucket", low, high).alias("bucket"), F.when(ahead, 0).otherwise(1).alias("side"), "pop", "fp")
    return plain.unionByName(tiles)


def links(nodes: DataFrame, radius: int = 2, hot: int = 20_000) -> DataFrame:
    """nodes: distinct fingerprints (column fp). Returns links (a, b) that join the same components as all pairs at
    most `radius` bits apart do."""
    if not 1 <= radius <= 7:
        raise ValueError("radius: 1 to 7")
    rows = _buckets(nodes, radius, hot).repartition("bucket").sortWithinPartitions("bucket", "side", "pop")
    return rows.select("bucket", "side", "fp").mapInArrow(_bucket_links(radius), "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, hot: int = 20_000) -> DataFrame:
    """(id, mark, fp, component_id, kept), one row for each row of docs. kept: the row is its component's first, by id
    (null last), then by mark."""
    fps = cut(fingerprints(docs, id_col, text_col))
    nodes = cut(fps.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "mark")).alias("first")))
    roots = components(links(nodes, radius, hot)).select(F.col("node").alias("fp"), "root")
    named = nodes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    linked = named.groupBy("root").agg(F.min("first").alias("first"))
    of_fp = named.drop("first").join(linked, "root").select("fp", F.col("first.id").alias("component_id"), F.col("first.mark").alias("first_mark"))
    kept = F.col("id").eqNullSafe(F.col("component_id")) & (F.col("mark") == F.col("first_mark"))
    return fps.join(small(cut(of_fp), 32), "fp").select("id", "mark", "fp", "component_id", kept.alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> DataFrame:
    """docs with one row of each component: its first by id."""
    return survivors(docs, cut(near_groups(docs, id_col, text_col, radius)), id_col, text_col)

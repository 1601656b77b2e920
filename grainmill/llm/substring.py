"""Repeated passages across documents by collinear chaining.

Method. Seeds are k-word windows, thinned to the smallest hash of every `window` neighbours, so that an exact stretch
is covered without holes. Seeds whose hash occurs in one document only are dropped before anything is joined: a first
scan counts hashes, a bitmap of fixed size carries the repeated ones to a second scan. Each occurrence of a seed is
matched with two occurrences only, in the smallest document that has it and in the one of smallest hash, so a passage
in n documents gives at most 2n matches. Matches of a pair of documents on one diagonal merge into anchors; anchors
are chained in order with a gap cost, the best predecessor found in a Fenwick tree over the other document's coordinate, which
anchors enter and leave as the largest gap (MOST_GAP words) moves over them; chains are aligned word by word (gaps by
dynamic programming, ends by extension with a drop limit) and kept if they have `min_words` words on both sides and the asked similarity (twice the matched words over both lengths).

The hubs are a first pass: where a passage's seeds also stand in other documents, its copies may meet different hubs
only. So windows of `min_words` words whose seeds are all repeated, and that have a word outside the passages found, are
then looked up in all documents by a hash of all their words: every word of `min_words` equal words in two documents
is in a reported passage, on one side or the other.

Scale. Counting, hub choice and matching are aggregations and joins on hashes that combine map-side or that Spark's
skewed-join handling splits. A pair's matches are at most one for each seed of its document. Text is shuffled only
for documents that have a chain, or windows to look up.

Defined results. Words are compared after lower-casing A-Z. Equal words count at all of their places: a document is
its own partner where a stretch of `min_words` words stands earlier in it (without overlap). Only for fuzzy copies does
a seed count once in a document, at its first place. Null or short texts have no passage. Rows with a null
id are left out, as a passage is named by its document's id; rows that share an id count as one document (the longest
text). Empty table: empty result. Extra columns are ignored.

Bounds. Chains of fewer than SHORTEST words aren't aligned: a fuzzy passage, part of whose seeds have other hubs, has some
such chain left, which grows to the whole when its ends are extended. Neighbours in a chain are at most MOST_GAP words apart. A chain's ends are extended over at most MARGIN bytes: an
equal stretch has a seed in every k + window - 1 words, so what lies further out has seeds, and a chain, of its own.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, cut, pick, small

K, WINDOW, MIN_WORDS, SIMILARITY = 5, 5, 50, 0.8
GAP_COST, MOST_GAP, DROP, MARGIN = 0.5, 60, 4, 512
#: Words that a chain must span to be aligned; its ends are then extended.
SHORTEST = 16
BITMAP_BITS = 27
MULTIPLIER = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Seeder:
    """Seeds of many texts at once."""

    def __init__(self):
        self.powers = self.back = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if n > len(self.powers):
            size = max(n, 1 << 20)
            self.powers, self.back = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size, m, np.uint64))), dtype=np.uint64) for m in (MULTIPLIER, INVERSE))

    def words(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """raw: the texts' bytes one after another; ends: where each ends. Returns text number, byte offset in raw,
        and hash, of each word."""
        n = len(raw)
        if not n:
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64))
        self.grow(n + 1)
        edge = np.zeros(n + 1, bool)
        edge[ends[ends < n]] = True
        blank = SPACES[raw]
        before = np.concatenate(([True], blank[:-1])) | edge[:n]
        start = np.flatnonzero(~blank & before)
        after = np.concatenate((blank[1:], [True])) | edge[1:]
        after[-1] = True
        stop = np.flatnonzero(~blank & after) + 1
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((LOWER[raw].astype(np.uint64) + np.uint64(1)) * self.powers[:n], dtype=np.uint64)))
        return np.searchsorted(ends, start, "right"), start, mixed((sums[stop] - sums[start]) * self.back[start])

    def seeds(self, raw: np.ndarray, ends: np.ndarray, k: int, window: int) -> tuple[np.ndarray, ...]:
        """raw, ends: as of words. Returns text number, word number, byte offset in the text, and hash, of each seed's
        first place in its text."""
        text, start, word = self.words(raw, ends)
        at, gram = chosen(text, word, k, window)
        at = at[first_places(text, at, gram)]
        first_word = np.searchsorted(text, text[at], "left")
        first_byte = np.concatenate(([0], ends))[text[at]]
        return text[at], at - first_word, start[at] - first_byte, gram[at]


def chosen(text: np.ndarray, word: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers where a seed starts, ascending, and the hashes of all k-word windows."""
    m = len(word) - k + 1
    if m < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    gram = np.zeros(m, np.uint64)
    for j in range(k):
        gram = gram * np.uint64(0xD6E8FEB86659FD93) + word[j : j + m]
    gram = mixed(gram)
    span = k + window - 1  # words of a window of k-word windows
    whole = np.flatnonzero(text[: len(word) - span + 1] == text[span - 1 :])
    if not len(whole):
        return np.zeros(0, np.int64), gram
    least = np.argmin(np.lib.stride_tricks.sliding_window_view(gram, window)[whole], axis=1)
    return np.unique(whole + least), gram


def first_places(text: np.ndarray, at: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Whether each seed is its hash's first place in its text."""
    order = np.lexsort((at, gram[at], text[at]))
    by = at[order]
    fresh = np.ones(len(at), bool)
    fresh[order[1:]] = (gram[by][1:] != gram[by][:-1]) | (text[by][1:] != text[by][:-1])
    return fresh


def stretches(text: np.ndarray, at: np.ndarray, on: np.ndarray, n: int, k: int, window: int) -> np.ndarray:
    """Whether each n-word window (by its first word) lies in one text and has no seed that is off, except those near its
    ends that words outside it may have chosen. n words that are equal in two documents have the same seeds there."""
    if len(text) < n:
        return np.zeros(0, bool)
    inside = text[: len(text) - n + 1] == text[n - 1 :]
    low, high = window - 1, n - window - k + 2
    if high > low:
        off = np.zeros(len(text) + 1, np.int32)
        off[at[~on] + 1] = 1
        off = np.cumsum(off, dtype=np.int32)
        m = len(inside)
        inside &= off[high : high + m] == off[low : low + m]
    return inside


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of True start and stop."""
    step = np.diff(flags.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def window_hashes(word: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-word windows, by doubling."""
    if len(word) < n:
        return np.zeros(0, np.uint64)
    factor = np.uint64(0xD6E8FEB86659FD93)
    part, size, out, done = word, 1, None, 0
    while True:
        if n & size:
            if out is None:
                out, done = part, size
            else:
                m = len(word) - done - size + 1
                out, done = mixed(out[:m] * factor + part[done : done + m]), done + size
        if done == n:
            return out
        m = len(word) - 2 * size + 1
        part, size = mixed(part[:m] * factor + part[size : size + m]), 2 * size


def _parts(b: pa.RecordBatch, limit: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and ends of runs of a batch's texts (its second column), about `limit` bytes each."""
    col = b.column(1)
    offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < len(col):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at + 1 : to + 1] - offsets[at]
        at = to


def _bitmap(spark, repeated: DataFrame) -> np.ndarray:
    slot = F.pmod(F.col("h"), F.lit(1 << BITMAP_BITS)) + 1
    rows = repeated.groupBy(F.bitmap_bucket_number(slot).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()  # 2^27 bits at most
    out = np.zeros((1 << BITMAP_BITS) // 8, np.uint8)
    for r in rows:
        out[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


SEED = "doc long, pos int, at int, h long, n int"


def copies_within(word: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """(start, stop, start of the earlier one) of stretches of at least n words that stand earlier in the same text
    without overlap. word: the text's word hashes. Each stretch found has a word that those before it don't."""
    h = window_hashes(word, n)
    first = np.unique(h, return_index=True, return_inverse=True)
    first = first[1][first[2]]
    again = np.flatnonzero(first <= np.arange(len(h)) - n)
    out, at = [], 0
    while (i := int(np.searchsorted(again, at))) < len(again):
        p = int(again[i])
        f = int(first[p])
        most = min(p - f, len(word) - p)
        size = n
        while size < most:  # by growing pieces, so that a long stretch costs its own length
            step = min(size, most - size)
            same = word[p + size : p + size + step] == word[f + size : f + size + step]
            size += step if same.all() else int(np.argmin(same))
            if not same.all():
                break
        out.append((p, p + size, f))
        at = p + size - n + 1
    return out


def repeated_seeds(base: DataFrame, k: int, window: int, min_words: int) -> DataFrame:
    """Rows of SEED. Where n is null: a seed whose hash may occur in another document. Else n windows of min_words words,
    from word pos on, that may: all of their seeds do, at whatever place; or, where at isn't null, n words from pos on
    that stand earlier in the document, from word at on. base: doc and text as bytes."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeder = Seeder()
        for b in batches:
            for _, raw, ends in _parts(b):
                h = seeder.seeds(raw, ends, k, window)[3]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    counted = base.mapInArrow(hashes, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    bits = base.sparkSession.sparkContext.broadcast(_bitmap(base.sparkSession, counted))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeder = Seeder()
        for b in batches:
            doc = b.column(0).to_numpy(zero_copy_only=False)
            for row, raw, ends in _parts(b):
                text, start, word = seeder.words(raw, ends)
                at, gram = chosen(text, word, k, window)
                on = _in(bits.value, gram[at])
                fresh = first_places(text, at, gram)
                first, last = runs_of(stretches(text, at, on, min_words, k, window))
                inner = []  # the earlier copy has the same seeds, so only texts with such a stretch are looked through
                for t in np.unique(text[np.flatnonzero(stretches(text, at, ~fresh, min_words, k, window))]):
                    x, y = np.searchsorted(text, t, "left"), np.searchsorted(text, t, "right")
                    inner += [(x + p, q - p, f) for p, q, f in copies_within(word[x:y], min_words)]
                inner = np.array(inner, np.int64).reshape(-1, 3)
                seed = at[on & fresh]
                where = np.concatenate((seed, first, inner[:, 0]))
                pos = where - np.searchsorted(text, text[where], "left")
                byte = start[seed] - np.concatenate(([0], ends))[text[seed]]
                ints = lambda x: pa.array(x.astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    pa.array(doc[row + text[where]], pa.int64()), ints(pos),
                    pa.concat_arrays([ints(byte), pa.nulls(len(first), pa.int32()), ints(inner[:, 2])]),
                    pa.concat_arrays([pa.array(gram[seed].view(np.int64)), pa.nulls(len(first) + len(inner), pa.int64())]),
                    pa.concat_arrays([pa.nulls(len(seed), pa.int32()), ints(last - first), ints(inner[:, 1])]),
                ], names=["doc", "pos", "at", "h", "n"])

    return base.mapInArrow(again, SEED)


def _in(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = (h & np.uint64((1 << BITMAP_BITS) - 1)).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def matches(seeds: DataFrame) -> DataFrame:
    """(hub, doc, pos, at, hpos, hat): each occurrence with its hash's two hubs, where these are other documents."""
    by_id, by_hash = F.min(F.struct("doc", "pos", "at")).alias("a"), F.min(F.struct(F.xxhash64("doc").alias("r"), "doc", "pos", "at")).alias("b")
    hubs = cut(seeds.groupBy("h").agg(by_id, by_hash, F.max("doc").alias("last")).where("a.doc <> last").select("h", "a.doc", "a.pos", "a.at", F.struct("b.doc", "b.pos", "b.at").alias("b")))
    pair = lambda p: F.struct(F.col(f"{p}doc").alias("hub"), F.col(f"{p}pos").alias("hpos"), F.col(f"{p}at").alias("hat"))
    hubs = hubs.select("h", pair("").alias("x"), F.struct(F.col("b.doc").alias("hub"), F.col("b.pos").alias("hpos"), F.col("b.at").alias("hat")).alias("y"))
    met = seeds.join(hubs, "h").select("doc", "pos", "at", F.explode(F.array_distinct(F.array("x", "y"))).alias("m"))
    return met.where("m.hub <> doc").select("m.hub", "doc", "pos", "at", "m.hpos", "m.hat")


class Fenwick:
    """Largest of the values that stand in a range of places; a value can be taken away again."""

    NONE = (float("-inf"), -1)

    def __init__(self, n: int):
        self.value, self.best = [self.NONE] * (n + 1), [self.NONE] * (n + 1)

    def put(self, place: int, value: tuple[float, int]) -> None:
        """A node covers the places of its lowest bit; each node above place is made anew from its own value and its parts."""
        i = place + 1
        self.value[i] = value
        while i < len(self.value):
            top, part = self.value[i], 1
            while part < i & -i:
                if self.best[i - part] > top:
                    top = self.best[i - part]
                part <<= 1
            self.best[i] = top
            i += i & -i

    def most(self, start: int, stop: int) -> tuple[float, int]:
        """Over the places from start to before stop."""
        i, top = stop, self.NONE
        while i > start:
            low = i & -i
            if i - low >= start:
                top, i = max(top, self.best[i]), i - low
            else:
                top, i = max(top, self.value[i]), i - 1
        return top


def chain(anchors: list[tuple[int, int, int]], slack: int = K - 1) -> list[list[int]]:
    """anchors: (start, length above slack, start in the hub). Returns chains of anchor numbers in order, best first;
    neighbours in a chain may overlap by `slack` words and are at most MOST_GAP words apart on either side.

    Anchors enter a Fenwick tree over their ends in the hub once they lie ahead of the anchor at hand, and leave it when they lie too
    far behind, so the tree's range holds exactly the predecessors within the gap, and the largest of them is the best."""
    order = sorted(range(len(anchors)), key=lambda i: anchors[i])
    ends = sorted((s + n, i) for i, (s, n, _) in enumerate(anchors))
    by_hub = sorted((h + n, i) for i, (_, n, h) in enumerate(anchors))
    hub_ends, place = [e for e, _ in by_hub], {i: k for k, (_, i) in enumerate(by_hub)}
    tree, score, prior, entered, left = Fenwick(len(anchors)), [0.0] * len(anchors), [-1] * len(anchors), 0, 0
    for i in order:
        s, n, h = anchors[i]
        while entered < len(ends) and ends[entered][0] - slack <= s:
            stop, j = ends[entered]
            if stop >= s - MOST_GAP:
                tree.put(place[j], (score[j] + GAP_COST * (stop + by_hub[place[j]][0]), j))
            entered += 1
        while left < entered and ends[left][0] < s - MOST_GAP:
            tree.put(place[ends[left][1]], Fenwick.NONE)
            left += 1
        value, j = tree.most(bisect_left(hub_ends, h - MOST_GAP), bisect_right(hub_ends, h + slack))
        score[i], gain = float(n), value - GAP_COST * (s + h)
        if gain > 0:
            score[i], prior[i] = n + gain, j
    out, used = [], set()
    for i in sorted(range(len(anchors)), key=lambda i: -score[i]):
        path = []
        while i >= 0 and i not in used:
            path.append(i)
            used.add(i)
            i = prior[i]
        if path:
            out.append(path[::-1])
    return out


CHAIN = "hub long, doc long, start int, start_at int, stop_at int, hstart int, hstart_at int, hstop_at int, rel array<int>, size array<int>, hrel array<int>"


def _chains(k: int, least: int):
    """mapInArrow function over matches sorted by hub, doc, pos: the chains of each pair that span `least` words."""

    def of(cols: list[np.ndarray]) -> list[dict]:
        hub, doc, pos, at, hpos, hat = cols
        diag = pos - hpos
        new = np.ones(len(pos), bool)
        new[1:] = (hub[1:] != hub[:-1]) | (doc[1:] != doc[:-1]) | (diag[1:] != diag[:-1]) | (pos[1:] - pos[:-1] > k)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(pos)) - 1
        size = pos[last] - pos[first] + k
        pair = np.ones(len(first), bool)
        pair[1:] = (hub[first[1:]] != hub[first[:-1]]) | (doc[first[1:]] != doc[first[:-1]])
        begin = np.flatnonzero(pair)
        end = np.append(begin[1:], len(first))
        reach = pos[last[end - 1]] - pos[first[begin]] + k
        out = []
        for b, e in zip(begin[reach >= least].tolist(), end[reach >= least].tolist()):
            anchors = [(int(pos[f]), int(n), int(hpos[f])) for f, n in zip(first[b:e], size[b:e])]
            for path in [[0]] if e - b == 1 else chain(anchors, k - 1):
                x, y = first[b + path[0]], last[b + path[-1]]
                if pos[y] + k - pos[x] < least:
                    continue
                s, h = anchors[path[0]][0], anchors[path[0]][2]
                out.append({"hub": int(hub[x]), "doc": int(doc[x]), "start": s, "start_at": int(at[x]), "stop_at": int(at[y]), "hstart": h, "hstart_at": int(hat[x]), "hstop_at": int(hat[y]), "rel": [anchors[i][0] - s for i in path], "size": [anchors[i][1] for i in path], "hrel": [anchors[i][2] - h for i in path]})
        return out

    schema = pa.schema([(n, {"long": pa.int64(), "int": pa.int32()}.get(t, pa.list_(pa.int32()))) for n, t in (x.split() for x in CHAIN.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
            same = (held[0] == held[0][-1]) & (held[1] == held[1][-1])  # the last pair may go on in the next batch
            stop = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if stop:
                if rows := of([x[:stop] for x in held]):
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                held = [x[stop:] for x in held]
        if held is not None and (rows := of(held)):
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def common_words(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence of two short word lists."""
    if not a or not b:
        return 0
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def extend(a: list[bytes], b: list[bytes], drop: int = DROP) -> tuple[int, int]:
    """How far two word lists go on alike from their start: (words, matches) at the best score before it falls by drop."""
    best, score, found, at, hit = 0, 0, 0, 0, 0
    for i, (x, y) in enumerate(zip(a, b)):
        if x == y:
            score, hit = score + 1, hit + 1
        else:
            score -= 1
        if score > best:
            best, at, found = score, i + 1, hit
        if score <= best - drop:
            break
    return at, found


WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def align(a: bytes, a_from: int, b: bytes, b_from: int, rel: list[int], size: list[int], hrel: list[int]) -> tuple[int, int, int, int, int] | None:
    """a, b: the chain's stretches of both texts with context; a_from, b_from: the byte of the first anchor in each.
    Returns words before the first anchor (a, b), passage words (a, b) and matched words."""
    (at_a, wa), (at_b, wb) = (([m.start() for m in WORD.finditer(t)], t.lower().split()) for t in (a, b))
    i, j = bisect_left(at_a, a_from), bisect_left(at_b, b_from)
    x, y, hits = i, j, 0  # the first words that aren't aligned yet
    for r, n, h in zip(rel, size, hrel):
        s, t = i + r, j + h
        cut_off = max(0, x - s, y - t)  # what an overlap with the anchor before takes away
        s, t, n = s + cut_off, t + cut_off, n - cut_off
        if n <= 0:
            continue
        hits += common_words(wa[x:s], wb[y:t]) + n
        x, y = s + n, t + n
    left, more = extend(wa[:i][::-1], wb[:j][::-1])
    right, again = extend(wa[x:], wb[y:])
    return left, left, x - i + left + right, y - j + left + right, hits + more + again


PASSAGE = "doc long, start_word int, end_word int, partner long, partner_start int, partner_end int, similarity double"


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Rows of PASSAGE: words [start_word, end_word) of doc are a (fuzzy) copy of the partner's. Each document that
    shares a passage is paired with the smallest document that has it or the one of smallest hash, or stands in the
    partner column itself."""
    base = _one_each(pick(docs, {"doc": F.col(id_col).cast("long"), "text": as_bytes(text_col)}).where("doc is not null"))
    scanned = cut(repeated_seeds(base, k, window, min_words))
    seeds = scanned.where("n is null").drop("n")
    least = min(SHORTEST, min_words - 2 * (window - 1) - 2 * k)
    ordered = matches(seeds).repartition("hub", "doc").sortWithinPartitions("hub", "doc", "pos", "hpos")
    found = cut(ordered.mapInArrow(_chains(k, least), CHAIN))
    ids = small(cut(found.select("doc").union(found.select("hub")).distinct()), 16)
    texts = base.join(ids, "doc", "left_semi")
    piece = lambda text, a, b: F.substring(F.col(text), F.greatest(F.col(a) - MARGIN, F.lit(0)) + 1, F.col(b) - F.greatest(F.col(a) - MARGIN, F.lit(0)) + 2 * MARGIN)
    one = found.join(texts, "doc").withColumn("a", piece("text", "start_at", "stop_at")).drop("text")
    both = one.join(texts.select(F.col("doc").alias("hub"), "text"), "hub").withColumn("b", piece("text", "hstart_at", "hstop_at"))
    names = ["hub", "doc", "start", "start_at", "hstart", "hstart_at", "rel", "size", "hrel", "a", "b"]
    schema = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[t]) for n, t in (x.split() for x in PASSAGE.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                left, hleft, n, m, hits = align(r["a"], min(r["start_at"], MARGIN), r["b"], min(r["hstart_at"], MARGIN), r["rel"], r["size"], r["hrel"])
                if min(n, m) >= min_words and 2 * hits >= similarity * (n + m):
                    s, h = r["start"] - left, r["hstart"] - hleft
                    out.append({"doc": r["doc"], "start_word": s, "end_word": s + n, "partner": r["hub"], "partner_start": h, "partner_end": h + m, "similarity": 2 * hits / (n + m)})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    chained = cut(both.select(*names).mapInArrow(run, PASSAGE))
    inner = scanned.where("n is not null and at is not null").select("doc", F.col("pos").alias("start_word"), (F.col("pos") + F.col("n")).alias("end_word"), F.col("doc").alias("partner"), F.col("at").alias("partner_start"), (F.col("at") + F.col("n")).alias("partner_end"), F.lit(1.0).alias("similarity"))
    return chained.unionByName(inner).unionByName(rest(base, scanned.where("n is not null and at is null"), chained, min_words))


LEFT = "doc long, start array<int>, stop array<int>"


def rest(base: DataFrame, runs: DataFrame, found: DataFrame, min_words: int) -> DataFrame:
    """Rows of PASSAGE for what the hubs of single seeds miss: every window of min_words words that has a word outside the
    passages found is looked up in all documents, and each document that has it is paired with the smallest one.

    runs: doc, pos and n of windows that may be repeated. Windows are looked up by a hash of all their words, over a
    bitmap of fixed size, so that only places of the asked windows are shuffled."""
    spark = base.sparkSession
    sides = found.select("doc", "start_word", "end_word").union(found.select("partner", "partner_start", "partner_end"))
    covered = sides.groupBy("doc", "start_word").agg(F.max("end_word").alias("end_word")).groupBy("doc").agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans"))
    asked = runs.groupBy("doc").agg(F.collect_list(F.struct("pos", "n")).alias("runs")).join(covered, "doc", "left")

    def uncovered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc", pa.int64()), ("start", pa.list_(pa.int32())), ("stop", pa.list_(pa.int32()))])
        for b in batches:
            out = []
            for r in b.to_pylist():
                last = max(x["pos"] + x["n"] for x in r["runs"])
                bare = np.ones(last + min_words, np.int32)
                for x in r["spans"] or ():
                    bare[x["start_word"] : x["end_word"]] = 0
                sums = np.concatenate(([0], np.cumsum(bare)))
                wanted = np.zeros(last, bool)
                for x in r["runs"]:
                    wanted[x["pos"] : x["pos"] + x["n"]] = True
                wanted &= sums[min_words : min_words + last] > sums[:last]
                if wanted.any():
                    start, stop = runs_of(wanted)
                    out.append({"doc": r["doc"], "start": start, "stop": stop})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    left = cut(asked.mapInArrow(uncovered, LEFT))
    if left.isEmpty():
        return spark.createDataFrame([], PASSAGE)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeder = Seeder()
        for b in batches:
            for i, (raw, start, stop) in enumerate(zip(b.column("text"), b.column("start").to_pylist(), b.column("stop").to_pylist())):
                raw = np.frombuffer(raw.as_py(), np.uint8)
                h = window_hashes(seeder.words(raw, np.array([len(raw)]))[2], min_words)
                h = np.unique(np.concatenate([h[x:y] for x, y in zip(start, stop)]))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    wanted = base.join(small(left, 64), "doc").select("text", "start", "stop").mapInArrow(hashes, "h long")
    bits = spark.sparkContext.broadcast(_bitmap(spark, wanted))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeder = Seeder()
        for b in batches:
            doc = b.column(0).to_numpy(zero_copy_only=False)
            for row, raw, ends in _parts(b):
                text, _, word = seeder.words(raw, ends)
                h = window_hashes(word, min_words)
                at = np.flatnonzero(_in(bits.value, h) & (text[: len(h)] == text[len(text) - len(h) :]))
                # a window that stands earlier in its text without overlap is in a repeat inside the document
                order = np.lexsort((at, h[at], text[at]))
                by = at[order]
                new = np.ones(len(by), bool)
                new[1:] = (h[by][1:] != h[by][:-1]) | (text[by][1:] != text[by][:-1])
                at = np.sort(by[by - by[new][np.cumsum(new) - 1] < min_words])
                pos = at - np.searchsorted(text, text[at], "left")
                yield pa.RecordBatch.from_arrays([pa.array(doc[row + text[at]], pa.int64()), pa.array(pos.astype(np.int32)), pa.array(h[at].view(np.int64))], names=["doc", "pos", "h"])

    met = cut(base.mapInArrow(places, "doc long, pos int, h long"))
    hubs = met.groupBy("h").agg(F.min(F.struct("doc", "pos")).alias("a"), F.max("doc").alias("last")).where("a.doc <> last")
    links = met.join(hubs, "h").where("doc <> a.doc").select("doc", "pos", F.col("a.doc").alias("partner"), (F.col("pos") - F.col("a.pos")).alias("diag"))
    line = Window.partitionBy("doc", "partner", "diag").orderBy("pos")
    joined = links.withColumn("run", F.col("pos") - F.row_number().over(line)).groupBy("doc", "partner", "diag", "run").agg(F.min("pos").alias("a"), (F.max("pos") + min_words).alias("b"))
    return joined.select("doc", F.col("a").alias("start_word"), F.col("b").alias("end_word"), "partner", (F.col("a") - F.col("diag")).alias("partner_start"), (F.col("b") - F.col("diag")).alias("partner_end"), F.lit(1.0).alias("similarity"))


def _one_each(base: DataFrame) -> DataFrame:
    """base with the longest text only of ids that occur more than once."""
    again = cut(base.groupBy("doc").count().where("count > 1").select("doc"))
    if again.isEmpty():
        return base
    again = small(again, 16)
    longest = cut(base.join(again, "doc", "left_semi").groupBy("doc").agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("text")))
    return base.join(again, "doc", "left_anti").unionByName(longest)


def cut_passages(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the words of passages whose partner has a smaller id or stands earlier in the document, so that one
    copy of each stays. Words that stay keep the white space before them. Null texts stay null."""
    spans = found.where("partner < doc or partner = doc and partner_start < start_word").groupBy(F.col("doc").alias("__doc")).agg(F.collect_set(F.struct("start_word", "end_word")).alias("__spans"))

    @F.pandas_udf("string")
    def without(text, spans):
        def one(t, s):
            if t is None or s is None or not len(s):
                return t
            words = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", t)
            gone = np.zeros(len(words), bool)
            for x in s:
                gone[x["start_word"] : x["end_word"]] = True
            return "".join(w for w, g in zip(words, gone) if not g)

        return text.combine(spans, one)

    joined = docs.join(spans, docs[id_col] == F.col("__doc"), "left")
    return joined.withColumn(text_col, without(F.col(text_col), F.col("__spans"))).select(*docs.columns)

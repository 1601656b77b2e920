"""Byte-pair merges of counted words at full size, in a few rounds over a distributed table of words.

A round takes the most frequent pairs of all words as candidates. Where two neighbours in a word aren't a candidate, nothing
can join them in this round: a pair that merges make stands where a pair stood before, so it is no more frequent than that one,
and younger. So words fall into segments between such places, and only distinct segments of two parts or more, with their
counts, come to the driver. There they are merged with an inverted index, the most frequent pair first, as long as it comes
before the last candidate in the order of all pairs; up to there counts are exact, for no other pair can be that frequent.
The table of words is then written anew, with each segment replaced by what became of it, and the next round begins. The
result is that of merging one pair after another over all words, whatever HEAD is.

The driver holds at most HEAD segments and MOST candidates: there are fewer candidates in a round if there would be more
segments, down to one pair, which needs none.

Defined results. Null words are left out. Equal counts go to the pair whose parts are older (bytes in the order of their
printable characters, then pieces in the order in which they were made). Empty tables give no merges.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Segments on the driver; candidates of the first round, most of a round.
HEAD, FIRST, MOST = 100_000, 128, 65_536

#: Fixed order of bytes: those that print as themselves, then the others.
BYTES = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
BYTES += [b for b in range(256) if b not in set(BYTES)]
PLACE = {b: k for k, b in enumerate(BYTES)}

Pair = tuple[bytes, bytes]
_SHIFT, _LOW = 24, (1 << 24) - 1


def joined(parts: list[int], a: int, b: int, new: int) -> list[int]:
    """parts with a, b replaced by new, from the left."""
    out: list[int] = []
    k, end = 0, len(parts) - 1
    while k <= end:
        if k < end and parts[k] == a and parts[k + 1] == b:
            out.append(new)
            k += 2
        else:
            out.append(parts[k])
            k += 1
    return out


def pair_keys(parts: list[int]) -> list[int]:
    return [a << _SHIFT | b for a, b in zip(parts, parts[1:], strict=False)]


class Head:
    """Counted segments with an inverted index (pair -> segments that hold it) and counts that each merge updates where it
    changes them; the most frequent pair on top, of equal ones the oldest."""

    def __init__(self, segments: list[list[int]], times: list[int]):
        self.segments, self.times = segments, times
        self.where: dict[int, set[int]] = defaultdict(set)
        self.counts: dict[int, int] = defaultdict(int)
        for s, parts in enumerate(segments):
            for key in pair_keys(parts):
                self.counts[key] += times[s]
                self.where[key].add(s)
        self.heap = [(-n, key) for key, n in self.counts.items()]
        heapq.heapify(self.heap)

    def top(self) -> tuple[int, int] | None:
        """(-count, pair) of the most frequent pair."""
        while self.heap and self.counts.get(self.heap[0][1], 0) != -self.heap[0][0]:
            heapq.heappop(self.heap)
        return self.heap[0] if self.heap else None

    def merge(self, key: int, new: int) -> None:
        a, b = key >> _SHIFT, key & _LOW
        changes: dict[int, int] = defaultdict(int)
        for s in self.where.pop(key):
            before = self.segments[s]
            after = joined(before, a, b, new)
            if len(after) == len(before):
                continue
            n = self.times[s]
            for k in pair_keys(before):
                changes[k] -= n
            for k in pair_keys(after):
                changes[k] += n
                if k >> _SHIFT == new or k & _LOW == new:
                    self.where[k].add(s)
            self.segments[s] = after
        for k, change in changes.items():
            if change:
                self.counts[k] = n = self.counts.get(k, 0) + change
                if n > 0:
                    heapq.heappush(self.heap, (-n, k))
                else:
                    del self.counts[k]


def _binary(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """32-bit integers cut into values of so many each."""
    ends = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes * 4, out=ends[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(flat, np.int32))])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(parts of all words of a batch, how many each word has, how often it occurs)."""
    for b in batches:
        if b.num_rows:
            column = b.column("parts")
            ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
            flat = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.int32)
            yield flat, np.diff(ends) // 4, b.column("n").to_numpy()


def _keys(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pair that each part but the last makes with the next one, and whether both are of one word."""
    within = np.ones(len(flat) - 1, bool)
    within[np.cumsum(sizes)[:-1] - 1] = False
    return flat[:-1].astype(np.int64) << _SHIFT | flat[1:], within


def _cut(flat: np.ndarray, sizes: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(size, word) of the segments, in order: a word is cut where neighbours are none of pairs (sorted)."""
    keys, within = _keys(flat, sizes)
    linked = within & (pairs[np.minimum(np.searchsorted(pairs, keys), len(pairs) - 1)] == keys)
    starts = np.concatenate([[0], np.flatnonzero(~linked) + 1])
    return np.diff(np.append(starts, len(flat))), np.searchsorted(np.cumsum(sizes), starts, side="right")


def _summed(values: pa.Array, n: np.ndarray, name: str) -> Iterator[pa.RecordBatch]:
    sums = pa.table({name: values, "n": n}).group_by(name).aggregate([("n", "sum")])
    yield from sums.select([name, "n_sum"]).rename_columns([name, "n"]).to_batches()


def _frequent(table: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, counts) of the most frequent pairs of all words; of equal ones the oldest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for flat, sizes, n in _words(batches):
            keys, within = _keys(flat, sizes)
            yield from _summed(pa.array(keys[within]), np.repeat(n, sizes - 1), "pair")

    found = table.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    top = found.orderBy(F.desc("n"), "pair").limit(most).toArrow()
    return top["pair"].to_numpy(), top["n"].to_numpy()


def _segments(table: DataFrame, pairs: np.ndarray, most: int) -> pa.Table:
    """(parts, n): distinct segments of two parts or more, of all words; `most` at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for flat, sizes, n in _words(batches):
            size, word = _cut(flat, sizes, pairs)
            long = size > 1
            yield from _summed(_binary(flat[np.repeat(long, size)], size[long]), n[word[long]], "parts")

    return table.mapInArrow(run, "parts binary, n long").groupBy("parts").agg(F.sum("n").alias("n")).limit(most).toArrow()


def _rewritten(table: DataFrame, pairs: np.ndarray, became: dict[bytes, bytes], single: tuple[int, int, int] | None) -> DataFrame:
    """The words with each segment replaced by what became of it; or, if given, by what single (a, b, new) makes of it. Words of
    one part go, as no merge can change them."""

    def after(segment: bytes) -> np.ndarray:
        if single:
            return np.array(joined(np.frombuffer(segment, np.int32).tolist(), *single), np.int32)
        return np.frombuffer(became.get(segment, segment), np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for flat, sizes, n in _words(batches):
            size, word = _cut(flat, sizes, pairs)
            coded = _binary(flat, size).dictionary_encode()
            at, made = coded.indices.to_numpy(), [after(s) for s in coded.dictionary.to_pylist()]
            lengths = np.array([len(m) for m in made])
            begin = (np.cumsum(lengths) - lengths)[at]
            new = lengths[at]
            parts = np.concatenate(made)[np.repeat(begin - (np.cumsum(new) - new), new) + np.arange(new.sum())]
            left = np.bincount(word, new, len(sizes)).astype(np.int64)
            keep = left > 1
            yield pa.RecordBatch.from_arrays([_binary(parts[np.repeat(keep, left)], left[keep]), pa.array(n[keep])], names=["parts", "n"])

    return written(table.mapInArrow(run, "parts binary, n long"))


def _numbers(table: DataFrame) -> DataFrame:
    """(parts, n) of (word, n): the numbers of a word's bytes as 32-bit integers."""
    place = np.array([PLACE[b] for b in range(256)], np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [place[np.frombuffer(w, np.uint8)].tobytes() for w in b.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary()), b.column("n")], names=["parts", "n"])

    return table.mapInArrow(run, "parts binary, n long")


def train_merges(counts: DataFrame, pieces: int, least: int = 1, head_words: int = HEAD) -> list[Pair]:
    """The merges, in order, by which words (word, n: how often) come to `pieces` pieces beside the 256 bytes; fewer if no pair
    occurs `least` times any more. At most head_words segments of words come to the driver at once."""
    words = counts.where("word is not null").selectExpr("encode(word, 'UTF-8') as word", "cast(n as bigint) as n").where("octet_length(word) > 1 and n > 0")
    table = written(_numbers(words))
    names = [bytes([b]) for b in BYTES]
    known, size, out, wanted = set(names), pieces + 256, [], FIRST
    while len(names) < size:
        pairs, n = _frequent(table, wanted + 1)
        if not len(pairs) or n[0] < least:
            break
        k = min(wanted, len(pairs))
        while True:
            chosen, last = np.sort(pairs[:k]), (-int(n[k - 1]), int(pairs[k - 1])) if k < len(pairs) else (0, 0)
            found = _segments(table, chosen, head_words + 1)
            if found.num_rows <= head_words or k == 1:
                break
            k = k // 2
        alone = found.num_rows > head_words
        before = found["parts"].to_pylist() if not alone else []
        head = Head([np.frombuffer(s, np.int32).tolist() for s in before], found["n"].to_pylist()) if not alone else None
        done = 0
        while len(names) < size and (top := head.top() if head else (-int(n[0]), int(pairs[0]))) and top <= last and -top[0] >= least:
            a, b = top[1] >> _SHIFT, top[1] & _LOW
            name = names[a] + names[b]
            if name in known and done:  # a piece made in a second way stands for two pairs of before: alone in its round
                break
            new, again = (names.index(name), True) if name in known else (len(names), False)
            out.append((names[a], names[b]))
            done += 1
            if not again:
                names.append(name)
                known.add(name)
            if head:
                head.merge(top[1], new)
            if again or not head:
                break
        became = {s: c for s, parts in zip(before, head.segments, strict=True) if (c := np.array(parts, np.int32).tobytes()) != s} if head else {}
        if len(names) < size:
            table = _rewritten(table, chosen, became, None if head else (a, b, new))
        wanted = min(MOST, max(1, int(k * min(8, max(0.5, 0.7 * head_words / max(1, found.num_rows))))))
    return out

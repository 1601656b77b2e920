"""Token counts by a public byte-level vocabulary, with overlap resynchronisation for huge documents.

Method. A document of at most `chunk` code points is encoded at once. A longer one is cut into overlapping chunks,
which are dealt to tasks as rows and encoded with offsets. Neighbouring chunks are spliced at a boundary that both must
have: white space after a letter, digit or ASCII mark. No piece of the vocabulary's splitting pattern runs from a
non-space into a space, and its only look-ahead is to the right, so what stands before such a boundary never changes
the tokens after it. Where an overlap holds no such boundary it is doubled until it does or the text ends. Each
chunk's own offsets must have the boundaries too; documents with a chunk that lacks one are cut again into wider chunks
with wider overlaps, until all align or the document is one chunk.

One scan counts the usual documents and writes the huge ones' chunks, which are then dealt out, TASK to a task.

A task remembers the counts of up to `remember` distinct pieces, as the library would cut them, so that most of a text
is a table look-up; texts with characters outside Latin and common punctuation go to the library whole.

Defined results. Null text counts as empty: 0 bytes, 0 tokens. Strings of special tokens inside a text are these
tokens, the library's default. Repeated rows: one output row each. Empty table: empty result. Extra columns are
ignored. Texts of any length are counted whole; only huge ones are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import LETTERS, NUMBERS, ODD
from .common import arrow_map, as_bytes, cut, keep_rows, mark, pick

#: The splitting pattern of byte_bpe_50k for characters that ODD doesn't match.
PIECES = re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+")
#: Chunks that one task encodes.
TASK = 64
BOUNDARY = re.compile(r"(?:(?<=[^\W_])|(?<=[!-~]))(?=[ \t\n\r\f\v])")


class Counter:
    """The number of tokens of a text."""

    def __init__(self, content: str, remember: int = 500_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(content)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.known: dict[str, int] = {}
        self.remember = remember

    def plain(self, text: str) -> bool:
        return not ODD.search(text) and not any(s in text for s in self.special)

    def encode(self, texts: list[str]) -> list:
        return self.library.encode_batch_fast(texts, add_special_tokens=False)

    def count(self, texts: list[str]) -> list[int]:
        plain = [self.plain(t) for t in texts]
        pieces = [PIECES.findall(t) if p else None for t, p in zip(texts, plain)]
        if len(self.known) > self.remember:
            self.known = {}
        known = self.known
        new = list({x for p in pieces if p for x in p} - known.keys())
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            known.update(zip(part, (len(e.ids) for e in self.encode(part))))
        odd = iter(self.encode([t for t, p in zip(texts, plain) if not p]))
        return [len(next(odd).ids) if p is None else sum(map(known.__getitem__, p)) for p in pieces]

    def between(self, text: str, start: int, stop: int) -> int | None:
        """Tokens of text[start:stop], where text is its chunk with the context on both sides; None if the chunk's own
        tokens don't have both boundaries."""
        offsets = self.library.encode(text, add_special_tokens=False).offsets
        begins, ends = {s for s, _ in offsets}, {e for _, e in offsets}
        if (start and start not in begins) or (stop < len(text) and stop not in ends):
            return None
        return sum(start <= s < stop for s, _ in offsets)


def boundary(text: str, at: int, overlap: int, stable: re.Pattern = BOUNDARY) -> int:
    """The first stable boundary from `at` on, looked for in windows that double from `overlap`; the end if none."""
    width = overlap
    while at + width < len(text):
        if m := stable.search(text, at, at + width):
            return m.start()
        width *= 2
    m = stable.search(text, at)
    return m.start() if m else len(text)


def chunks(text: str, size: int, overlap: int, stable: re.Pattern = BOUNDARY) -> Iterator[tuple[str, int, int]]:
    """Pieces of about `size` code points between stable boundaries, as (text with context, start, stop)."""
    at = 0
    while at < len(text):
        to = boundary(text, at + size, overlap, stable) if at + size < len(text) else len(text)
        left, right = max(0, at - overlap), min(len(text), to + overlap)
        yield text[left:right], at - left, to - left
        at = to


_counters: dict[str, Counter] = {}


def counter(content: str, key: str) -> Counter:
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(content)
    return _counters[key]


#: What the scan writes: a text's counts, or (part not null) a chunk of a huge one.
SCANNED = "row long, id long, mark long, n_bytes long, n_tokens long, part string, start long, stop long"


def scanned(docs: DataFrame, content, key: str, chunk: int, overlap: int, stable: re.Pattern) -> DataFrame:
    """Rows of SCANNED for docs (id, mark, text as bytes). The text is read once."""
    names = [c.split()[0] for c in SCANNED.split(", ")]
    schema = pa.schema([(n, pa.string() if n == "part" else pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(content.value, key).count
        for b in batches:
            for at in range(0, b.num_rows, 256):
                row, i, mark, raw = (c.to_pylist() for c in b.slice(at, 256).columns)
                texts = [t.decode("utf-8", "replace") for t in raw]
                usual = [k for k, t in enumerate(texts) if len(t) <= chunk]
                n = count([texts[k] for k in usual])
                pick_of = lambda x: [x[k] for k in usual]  # noqa: B023, E731
                none = [None] * len(usual)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((pick_of(row), pick_of(i), pick_of(mark), [len(raw[k]) for k in usual], n, none, none, none), schema)], schema=schema)
                for k, t in enumerate(texts):
                    if len(t) > chunk:
                        for part, start, stop in chunks(t, chunk, overlap, stable):
                            size = len(part[start:stop].encode())
                            yield pa.RecordBatch.from_pylist([dict(zip(names, (row[k], i[k], mark[k], size, None, part, start, stop)))], schema=schema)

    return docs.select(F.monotonically_increasing_id().alias("row"), "id", "mark", as_bytes().alias("text")).mapInArrow(run, SCANNED)


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = 32_768, overlap: int = 256, stable: re.Pattern = BOUNDARY) -> DataFrame:
    """vocabulary: path of a byte-level tokenizer file the driver can read. Returns (id, n_bytes, n_tokens).
    stable: where chunks are spliced, if both have a token boundary there."""
    with open(vocabulary, encoding="utf-8") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())

    def one_chunk():
        def step(b: pa.RecordBatch) -> dict:
            c = counter(content.value, vocabulary)
            n = [c.between(*x) for x in zip(*(b.column(k).to_pylist() for k in (4, 5, 6)))]
            return {"row": b.column(0), "id": b.column(1), "mark": b.column(2), "n_bytes": b.column(3), "n_tokens": n}

        return step

    todo, done = pick(docs, {"id": F.col(id_col).cast("long"), "mark": mark(text_col), "text": F.col(text_col)}), []
    while True:
        rows = cut(scanned(todo, content, vocabulary, chunk, overlap, stable))
        done.append(rows.where("part is null").select("id", "n_bytes", "n_tokens"))
        parts = rows.where("part is not null").select("row", "id", "mark", "n_bytes", "part", "start", "stop")
        n = parts.count()
        if not n:
            break
        counted = arrow_map(parts.repartition(-(-n // TASK)), one_chunk, "row long, id long, mark long, n_bytes long, n_tokens long")
        failed = F.bool_or(F.col("n_tokens").isNull()).alias("failed")
        spliced = cut(counted.groupBy("row").agg(F.first("id").alias("id"), F.first("mark").alias("mark"), F.sum("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"), failed))
        done.append(spliced.where("not failed").select("id", "n_bytes", "n_tokens"))
        again = spliced.where("failed").select("id", "mark").distinct()
        if again.isEmpty():
            break
        todo = keep_rows(todo, again, "id", "text", "semi")
        chunk, overlap = 4 * chunk, 4 * overlap
    return reduce(DataFrame.unionByName, done)

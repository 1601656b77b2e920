"""BPE encoding and decoding with a public vocabulary, through a pair occurrence index.

Method. A task cuts its texts into words, numbers the distinct words it has not met before, and lays their symbols in
one array. The index maps each rank to all positions whose symbol pair has that rank. Active ranks are taken in
ascending order; all of a rank's positions merge in one numpy step, and only the pairs to their left and right get new
entries. A distinct word is encoded once for all texts of the task. Vocabularies come from a file of a public
tokenizer whose content is sent to the tasks: a few MB, whatever the input.

Memory: a task holds at most `window` bytes of text, four bytes a word of it, and the codes of at most
`remember` distinct words; of these it keeps the ones that it used more than once.

Defined results. Null text counts as empty; an empty text has no ids and decodes to the empty string. Strings of
special tokens inside a text become these tokens, as the public library does by default. Repeated rows: one output
row each. Empty table: empty result. Extra columns are ignored. Texts of any length are encoded whole.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, pick

NONE = np.int32(2**31 - 1)

#: Characters whose class, case and composition are the same in every Unicode version: Latin and common punctuation.
PLAIN = r"\t\n\r\x20-\x7e\xa1-ɏ‐-‧‰-⁞€"
ODD = re.compile(f"[^{PLAIN}]")
LETTERS = "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == "L")
NUMBERS = "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == "N")
WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+")


#: Before a word that the library has cut: it is not cut again.
UNCUT = "\x00"


class Numbers(dict):
    """Gives every new key the next number."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = count(256)
    return [chr(b) if b in set(printable) else chr(next(spare)) for b in range(256)]


class PairIndex:
    """Merges the symbols of many words at once."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        alphabet = byte_alphabet()
        self.inner = np.array([vocab[c] for c in alphabet], np.int32)
        self.last = np.array([vocab[c + suffix] for c in alphabet], np.int32)
        self.span = max(vocab.values()) + 1
        left, right = (np.array([vocab[m[i]] for m in merges], np.int64) for i in (0, 1))
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        codes = left * self.span + right
        _, first = np.unique(codes, return_index=True)
        self.codes, self.ranks, self.twin = codes[first], first.astype(np.int32), left == right

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        code = left.astype(np.int64) * self.span + right
        at = np.searchsorted(self.codes, code)
        at[at == len(self.codes)] = 0
        return np.where(self.codes[at] == code, self.ranks[at], NONE)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and each word's number of ids. Words are not empty."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size)
        raw = np.frombuffer(b"".join(words), np.uint8)
        n = len(raw)
        sym = self.inner[raw]
        sym[end - 1] = self.last[raw[end - 1]]
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[end - 1], before[end - size] = -1, -1
        rank = np.full(n, NONE, np.int32)
        inside = np.flatnonzero(after >= 0).astype(np.int32)
        rank[inside] = self.rank(sym[inside], sym[inside + 1])
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(at: np.ndarray) -> None:
            at = at[rank[at] != NONE]
            if not len(at):
                return
            r = rank[at]
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cuts = [0, *(np.flatnonzero(r[1:] != r[:-1]) + 1).tolist(), len(r)]
            for k, s, e in zip(r[cuts[:-1]].tolist(), cuts, cuts[1:]):
                if k in index:
                    index[k].append(at[s:e])
                else:
                    index[k] = [at[s:e]]
                    heapq.heappush(heap, k)

        add(inside)
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[rank[at] == r]
            if not len(at):
                continue
            if self.twin[r] and len(at) > 1:  # in a run of one symbol the leftmost pairs merge
                keep, used = [], -1
                for p in np.sort(at).tolist():
                    if p != used:
                        keep.append(p)
                        used = after[p]
                at = np.array(keep, np.int32)
            right = after[at]
            beyond = after[right]
            sym[at], after[at] = self.made[r], beyond
            alive[right], rank[right] = False, NONE
            on = beyond >= 0
            before[beyond[on]] = at[on]
            rank[at] = NONE
            prior = before[at]
            starts = np.unique(np.concatenate((at[on], prior[prior >= 0])))
            rank[starts] = self.rank(sym[starts], sym[after[starts]])
            add(starts)
        return sym[alive], np.add.reduceat(alive, end - size, dtype=np.int64) if n else np.zeros(0, np.int64)


class Codec:
    """Texts to words, ids and back, for a vocabulary file whose words are lower-cased and carry an end mark."""

    def __init__(self, content: str, remember: int = 300_000):
        from tokenizers import Tokenizer

        spec = json.loads(content)
        model = spec["model"]
        if model["type"] != "BPE" or not model.get("end_of_word_suffix") or spec.get("decoder"):
            raise ValueError("a BPE vocabulary with an end-of-word mark and no decoder is needed")
        self.library = Tokenizer.from_str(content)
        self.vocab = model["vocab"]
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.index = PairIndex(self.vocab, merges, model["end_of_word_suffix"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.names = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.bytes_of = {c: b for b, c in enumerate(byte_alphabet())}
        self.remember = remember
        self.forget()

    def forget(self) -> None:
        self.number = Numbers()  # of a piece: what stands between white space, or a special string
        self.ids: list[str] = []
        self.tokens: list[str] = []
        self.sizes: list[int] = []
        self.uses = np.zeros(0, np.int64)

    def forget_rare(self) -> None:
        """Keeps the pieces used more than once; none if these are still too many."""
        keep = np.flatnonzero(self.uses > 1).tolist()
        old, ids, tokens, sizes = list(self.number), self.ids, self.tokens, self.sizes
        self.forget()
        if len(keep) <= self.remember // 2:
            for i in keep:
                self.number[old[i]] = len(self.ids)
                self.ids.append(ids[i])
                self.tokens.append(tokens[i])
                self.sizes.append(sizes[i])
            self.uses = np.ones(len(keep), np.int64)

    def pieces(self, text: str) -> list[str]:
        """A text cut where no word can continue: at white space, and at special strings, which stay as they stand."""
        if "<|" in text and self.split.search(text):
            return [w for part in self.split.split(text) for w in ([part] if part in self.special else self.pieces(part))]
        if not ODD.search(text):
            return text.split()
        library = self.library
        found = library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text))
        return [UNCUT + bytes(self.bytes_of[c] for c in p).decode("utf-8", "replace") for p, _ in found]

    def words(self, piece: str) -> list[str]:
        return [piece[1:]] if piece[0] == UNCUT else WORDS.findall(piece.lower())

    def learn(self, new: list[str]) -> None:
        """Encodes distinct pieces that have numbers but no codes yet, in the order of their numbers."""
        cut = [[] if p in self.special else self.words(p) for p in new]
        distinct = list({w for ws in cut for w in ws})
        flat, sizes = self.index.encode([w.encode() for w in distinct])
        names, flat, at, codes = self.names, flat.tolist(), 0, {}
        for w, n in zip(distinct, sizes.tolist()):
            codes[w] = flat[at : at + n]
            at += n
        for p, ws in zip(new, cut):
            part = [self.special[p]] if p in self.special else codes[ws[0]] if len(ws) == 1 else [i for w in ws for i in codes[w]]
            self.ids.append(" ".join(map(str, part)))
            self.tokens.append(" ".join([names[i] for i in part]))
            self.sizes.append(len(part))

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """For each text: its number of ids, the ids in decimal with one space between, and the decoded text."""
        if len(self.number) > self.remember:
            self.forget_rare()
        known, coded, number = len(self.ids), [], self.number
        for t in texts:
            p = self.pieces(t)
            coded.append(np.fromiter(map(number.__getitem__, p), np.int32, len(p)))
        if len(number) > known:
            self.learn(list(number)[known:])
        ids, tokens, sizes = self.ids, self.tokens, np.array(self.sizes, np.int64)
        uses = np.zeros(len(ids), np.int64)
        uses[: len(self.uses)] = self.uses
        for c in coded:
            np.add.at(uses, c, 1)
        self.uses = uses
        for c in coded:
            at = c.tolist()
            yield int(sizes[c].sum()), " ".join([ids[i] for i in at]), " ".join([tokens[i] for i in at])


_codecs: dict[str, Codec] = {}  # a Python worker keeps its last codec from task to task


def codec(content: str, key: str) -> Codec:
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(content)
    return _codecs[key]


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", window: int = 12 << 20) -> DataFrame:
    """vocabulary: path of a tokenizer file the driver can read. Returns (id, n_tokens, ids, decoded), one row for
    each row of docs: ids as decimal numbers with one space between, decoded as the library's decode() gives it."""
    with open(vocabulary, encoding="utf-8") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())

    def out(rows: list, texts: list[str]) -> Iterator[pa.RecordBatch]:
        made: tuple[list, list, list, list] = ([], [], [], [])
        held = 0
        for i, row in zip(rows, codec(content.value, vocabulary).encode_batch(texts)):
            for to, x in zip(made, (i, *row)):
                to.append(x)
            held += len(row[1]) + len(row[2])
            if held > 4 << 20:
                yield batch(made)
                made, held = ([], [], [], []), 0
        if made[0]:
            yield batch(made)

    def batch(made: tuple) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(made, types)], names=["id", "n_tokens", "ids", "decoded"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, texts, held = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                rows.append(i)
                texts.append(t.as_py().decode("utf-8", "replace"))
                held += len(texts[-1])
                if held > window:
                    yield from out(rows, texts)
                    rows, texts, held = [], [], 0
        if rows:
            yield from out(rows, texts)

    return pick(docs, {"id": F.col(id_col).cast("long"), "text": as_bytes(text_col)}).mapInArrow(run, "id long, n_tokens long, ids string, decoded string")


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """encoded with a column decoded: the texts of its id strings. Ids that the vocabulary lacks are left out."""
    with open(vocabulary, encoding="utf-8") as f:
        content = encoded.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("string")
    def texts(ids):
        names = codec(content.value, vocabulary).names
        return ids.map(lambda s: " ".join(names[int(i)] for i in (s or "").split() if int(i) in names))

    return encoded.withColumn("decoded", texts(F.col(ids_col)))

r"""Ranked lexical search by bag deduplication: all documents against each item, the best documents of each item.

One scan reduces every document to its bag: the counts of those of its terms that any item has (a few bytes a term), and
its number of terms. Statistics come from the bags. With them a document's length class m is known, and documents with the
same bag and m score alike for every item: bags are hashed with m, rows are grouped by the hash first and by the bag and m
themselves with it, which verifies that rows of one hash are alike. A class is scored once for all items; its best classes
by score and smallest id are enough, since a document among the best brings its class's smallest id along. Only then are the
members of these classes looked up, each class's smallest ids first.

Copies may be a third of all rows: classes are pre-aggregated in each task, and members are cut to the smallest ids in each
task before they are shuffled. Items go through in blocks of about BLOCK terms and ITEMS items, so what tasks get stays bounded whatever
the number of items; each block costs a scan of the documents.

Defined results. Null and empty texts have no terms: such documents count nowhere and score nothing, such items get no rows.
Repeated documents are ranked each by itself; null ids come last among equal scores. Repeated items are ranked each by
itself, under the same id. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, as_bytes, cut, pick, small

#: Terms are runs of ASCII letters and digits and of anything beyond ASCII; bytes that are none become blanks, A-Z small.
_TERM = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()

#: Distinct terms, summed over items, and items of a block; scores and postings that a task holds at a time.
BLOCK, ITEMS, HELD = 200_000, 2_000, 1 << 21


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERM).split()


def _item_terms(items: DataFrame) -> DataFrame:
    """(item, term, times), a row for each distinct term of each item."""

    def start():
        def step(b: pa.RecordBatch) -> dict:
            rows, found, times = [], [], []
            for row, text in zip(b.column("row").to_pylist(), b.column("text").to_pylist(), strict=True):
                for term, n in Counter(terms(text)).items():
                    rows.append(row)
                    found.append(term)
                    times.append(n)
            return {"row": rows, "term": found, "times": times}

        return step

    return arrow_map(items.select("row", as_bytes("text").alias("text")), start, "row long, term binary, times long")


def _bags(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(id, n, bag): n counts all terms; bag has the numbers of those in the vocabulary, ascending, then their counts, as
    pairs of 32-bit integers."""

    def start():
        number = {t: k for k, t in enumerate(vocabulary)}

        def step(b: pa.RecordBatch) -> dict:
            ns, bags = [], []
            for text in b.column("text"):
                words = terms(text.as_py())
                counts = Counter(words)
                hits = sorted((number[t], c) for t, c in counts.items() if t in number)
                ns.append(len(words))
                bags.append(np.array(hits, np.int32).tobytes())
            return {"id": b.column("id"), "n": ns, "bag": bags}

        return step

    return arrow_map(docs, start, "id long, n long, bag binary")


def _frequencies(bags: DataFrame, size: int) -> list[int]:
    """Documents that hold each term of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            held = np.frombuffer(b"".join(b.column("bag").to_pylist()), np.int32).reshape(-1, 2)
            total += np.bincount(held[:, 0], minlength=size)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_pydict({"term": at, "df": total[at]})

    found = bags.select("bag").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    out = [0] * size
    for r in found.toLocalIterator():
        out[r.term] = r.df
    return out


class Scorer:
    """Scores classes (bag, m) for a block of items. Sums are exact: 64-bit integers, in doubles where these hold them."""

    def __init__(self, postings: list[tuple[int, int, int]], weights: list[int], n_items: int):
        """postings: (term, item, times)."""
        table = np.array(sorted(postings), np.int64).reshape(-1, 3)
        self.first = np.searchsorted(table[:, 0], np.arange(len(weights) + 1))
        self.item, self.times = table[:, 1], table[:, 2]
        self.weight, self.n_items = np.array(weights, np.int64), n_items
        per_item = np.bincount(self.item, self.times * self.weight[table[:, 0]], minlength=n_items)
        #: A term contributes at most its weight times 1,000,000.
        self.in_doubles = float(per_item.max(initial=0)) * 1e6 < 2**53

    def scores(self, bags: list[bytes], m: np.ndarray) -> np.ndarray:
        """classes x items."""
        pairs = np.frombuffer(b"".join(bags), np.int32).reshape(-1, 2).astype(np.int64)
        owner = np.repeat(np.arange(len(bags)), [len(b) // 8 for b in bags])
        term, tf = pairs[:, 0], pairs[:, 1]
        part = self.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[owner]))
        fan = self.first[term + 1] - self.first[term]
        if fan.sum() > HELD and len(bags) > 1:
            half = len(bags) // 2
            return np.concatenate((self.scores(bags[:half], m[:half]), self.scores(bags[half:], m[half:])))
        at = np.repeat(self.first[term] - np.concatenate(([0], np.cumsum(fan)[:-1])), fan) + np.arange(fan.sum())
        slot = np.repeat(owner, fan) * self.n_items + self.item[at]
        gain = np.repeat(part, fan) * self.times[at]
        if self.in_doubles:
            flat = np.bincount(slot, gain, minlength=len(bags) * self.n_items).astype(np.int64)
        else:
            flat = np.zeros(len(bags) * self.n_items, np.int64)
            np.add.at(flat, slot, gain)
        return flat.reshape(len(bags), self.n_items)


def _best_classes(classes: DataFrame, scorer: Scorer, top: int) -> DataFrame:
    """(item, hash, bag, m, least, score): each task's best classes of each item; `top` of an item at most, by score, then
    least (the smallest id of the class, nulls last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in range(scorer.n_items)]
        for whole in batches:
            step = max(1, HELD // scorer.n_items)
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                bags, m, hashes = b.column("bag").to_pylist(), b.column("m").to_numpy(), b.column("hash").to_numpy()
                least = b.column("least").to_pylist()
                order = sorted(range(len(bags)), key=lambda k: (least[k] is None, least[k] or 0))
                scores = scorer.scores([bags[k] for k in order], m[order])
                for item in range(scorer.n_items):
                    column, held = scores[:, item], best[item]
                    floor = max(1, -held[-1][0]) if len(held) == top else 1
                    hits = np.nonzero(column >= floor)[0]
                    if len(hits) > top:
                        hits = np.sort(hits[np.argsort(-column[hits], kind="stable")[:top]])
                    for h in hits:
                        k = order[h]
                        held.append((-int(column[h]), least[k] is None, least[k] or 0, int(hashes[k]), bags[k], int(m[k])))
                    held.sort()
                    del held[top:]
        rows = [(item, h, bag, m, None if none else least, -s) for item, held in enumerate(best) for s, none, least, h, bag, m in held]
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["item", "hash", "bag", "m", "least", "score"])

    found = classes.select("hash", "bag", "m", "least").mapInArrow(run, "item long, hash long, bag binary, m long, least long, score long")
    return _first(found, ["item"], [F.desc("score"), F.col("least").asc_nulls_last(), "hash", "bag", "m"], top)


def _first(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each key as column rank; tasks cut theirs to n before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def _search(docs: DataFrame, block: list[tuple[int, bytes, int]], top: int) -> DataFrame:
    """(row, id, score, rank) for one block of (row, term, times)."""
    rows = sorted({r for r, _, _ in block})
    vocabulary = sorted({t for _, t, _ in block})
    item, number = {r: k for k, r in enumerate(rows)}, {t: k for k, t in enumerate(vocabulary)}
    bags = cut(_bags(docs, vocabulary))
    counted = bags.agg(F.coalesce(F.sum((F.col("n") > 0).cast("long")), F.lit(0)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    weights = [math.floor(1000 * math.log((2 * counted.docs + 2) / (2 * df + 1))) for df in _frequencies(bags, len(vocabulary))]
    scorer = Scorer([(number[t], item[r], n) for r, t, n in block], weights, len(rows))
    m = F.expr(f"25L + (75L * n * {counted.docs}L) div {max(1, counted.terms)}L")
    shaped = bags.where("n > 0 and octet_length(bag) > 0").select("id", "bag", m.alias("m")).withColumn("hash", F.xxhash64("bag", "m"))
    classes = shaped.groupBy("hash", "m", "bag").agg(F.min("id").alias("least"))
    best = cut(_best_classes(classes, scorer, top))
    winners = cut(best.select("hash", "m", "bag").distinct())
    heavy = winners.agg(F.coalesce(F.max(F.octet_length("bag")), F.lit(0))).first()[0]
    members = shaped.join(small(winners, 64 + heavy), ["hash", "m", "bag"], "left_semi")
    members = _first(members, ["hash", "m", "bag"], [F.col("id").asc_nulls_last()], top).drop("rank")
    back = F.array(*[F.lit(r) for r in rows])
    pairs = best.drop("rank", "least").join(members, ["hash", "m", "bag"])
    return _first(pairs, ["item"], [F.desc("score"), F.col("id").asc_nulls_last()], top).select(F.element_at(back, F.col("item").cast("int") + 1).alias("row"), "id", "score", "rank")


def ranked(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", top: int = 10) -> DataFrame:
    """(item, rank, id, score): for each row of items (item_col, text) the `top` highest-scoring documents."""
    base = pick(docs, {"id": F.col(id_col).cast("long"), "text": as_bytes(text_col)})
    asked = cut(pick(items, {"item": item_col, "text": "text"}).withColumn("row", F.monotonically_increasing_id()))
    wanted = cut(_item_terms(asked))
    n_blocks = max(1, -(-wanted.count() // BLOCK), -(-asked.count() // ITEMS))
    found = []
    for k in range(n_blocks):
        part = wanted.where(F.pmod(F.xxhash64("row"), F.lit(n_blocks)) == k) if n_blocks > 1 else wanted
        block = [(r.row, bytes(r.term), r.times) for r in part.toLocalIterator()]
        if block:
            found.append(_search(base, block, top))
    if not found:
        return asked.selectExpr("item", "1 as rank", "cast(null as bigint) as id", "cast(null as bigint) as score").limit(0)
    names = small(asked.select("row", "item"), 32)
    return reduce(DataFrame.unionByName, found).join(names, "row").select("item", "rank", "id", "score")

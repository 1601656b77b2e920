"""Toxicity by weak supervision.

Method. From a bounded sample of labelled documents, terms (words and word beginnings) that toxic documents favour
become lexicons. Sixteen voters (lexicon counts and densities, single terms, writing patterns) vote on every document;
their patterns, counted over all documents, are at most 2^16 rows. A generative label model of two classes is fitted
to these counts by expectation-maximisation: the class balance, each voter's rate in either class, and the
correlations of voters within a class, as a tree: each voter depends on the class and on one other voter, the one with
which it shares most given the class, through a rate for either vote of it. Rates, tree and balance are estimated anew
in every round from all documents, labelled or not; the sample's documents count with their labels, which keeps the
classes what the labels mean. The model's posteriors, of the labelled sample and of as many documents without a label, train a linear
classifier (logistic, L2) whose score is the result. Neither labels nor language, source or id is an input.

Bounds: `sample` labelled documents for terms, and with `sample` others for weights (documented parameter); `TERMS`
terms out of the CANDIDATES that most toxic documents of the sample have; 2^16 vote patterns. Everything else covers all
documents and whole texts. The text is read once for all documents.

Defined results. Null and empty texts are scored like any text without a term. Labelled rows with a null label or id,
and held-out rows (crc32 of the id as text, modulo 4, is 2), are never learned from. Of rows that share an id one is learned from. Without a toxic labelled
document every score is 0. Repeated rows: one output row each. Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, as_bytes, cut, keep_rows, mark, pick

SAMPLE, TERMS, CANDIDATES, VOTERS, LEAST_DOCS = 6000, 600, 50_000, 16, 5
STEMS = (4, 5, 6, 7)
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~…“”„«»‘’¡¿"
COUNTS, DENSITIES, SHARES = (1, 2, 3, 4, 6, 9), (0.0025, 0.005, 0.01, 0.02, 0.04, 0.08), (0.02, 0.1, 0.3)
PATTERNS = 3


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def terms_of(token: str) -> list[str]:
    """The terms of a lower-cased token: the word itself and its beginnings."""
    w = token.strip(MARKS)
    return [f"w:{w}", *[f"s:{w[:k]}" for k in STEMS if len(w) > k]] if w else []


class Remembered(dict):
    """The chosen terms' numbers for each token met so far."""

    def __init__(self, chosen: dict[str, int], most: int = 400_000):
        super().__init__()
        self.chosen, self.most = chosen, most

    def __missing__(self, token: str) -> tuple[int, ...]:
        if len(self) > self.most:
            self.clear()
        self[token] = found = tuple(self.chosen[x] for x in terms_of(token) if x in self.chosen)
        return found


@dataclass
class Spec:
    """What a task needs to turn a text into active slots and votes."""

    terms: list[str] = field(default_factory=list)
    lexicons: list[set[int]] = field(default_factory=lambda: [set(), set()])
    voters: list[int] = field(default_factory=list)  # slots

    @property
    def levels(self) -> int:
        return 3 * len(self.terms)

    @property
    def slots(self) -> int:
        return self.levels + 2 * (len(COUNTS) + len(DENSITIES)) + PATTERNS * len(SHARES)

    def active(self, text: str, numbers: Remembered) -> list[int]:
        tokens = text.split()
        n, out = max(1, len(tokens)), []
        hits = [x for x in map(numbers.__getitem__, text.lower().split()) if x]
        for t, c in Counter(t for x in hits for t in x).items():
            out += range(3 * t, 3 * t + min(c, 3))
        at = self.levels
        for lexicon in self.lexicons:
            c = sum(not lexicon.isdisjoint(x) for x in hits)
            out += [at + i for i, k in enumerate(COUNTS) if c >= k]
            out += [at + len(COUNTS) + i for i, k in enumerate(DENSITIES) if c >= k * n and c]
            at += len(COUNTS) + len(DENSITIES)
        shouted = sum(x.isupper() and len(x) > 1 for x in tokens) / n
        stressed = text.count("!") / n
        marked = sum(map(text.count, "#*$%&|<>")) / n
        for share in (shouted, stressed, marked):
            out += [at + i for i, k in enumerate(SHARES) if share >= k]
            at += len(SHARES)
        return out


def choose(positive: dict[str, int], negative: dict[str, int], n: tuple[int, int]) -> Spec:
    """n: clean and toxic documents in the sample; positive and negative: documents with each term."""
    odds = {t: np.log((p + 0.5) / (n[1] + 1)) - np.log((negative.get(t, 0) + 0.5) / (n[0] + 1)) for t, p in positive.items()}
    gain = lambda t: odds[t] * positive[t]
    good = sorted((t for t in odds if odds[t] >= 1.5), key=lambda t: (-gain(t), t))[:TERMS]
    spec = Spec(terms=good)
    for i, t in enumerate(good):
        if odds[t] >= (3.0 if t[0] == "w" else 2.0):
            spec.lexicons[0 if t[0] == "w" else 1].add(i)
    first = spec.levels
    step = len(COUNTS) + len(DENSITIES)
    word, stem, pattern = first, first + step, first + 2 * step
    spec.voters = [word, word + 1, word + 3, word + len(COUNTS) + 2, stem + 1, stem + 2, stem + 4, stem + len(COUNTS) + 2, stem + len(COUNTS) + 3, pattern + 2, pattern + len(SHARES) + 2, pattern + 2 * len(SHARES) + 2]
    spec.voters += [3 * i for i in range(min(len(good), VOTERS - len(spec.voters)))]
    return spec


def tree(both: np.ndarray, least: float = 1e-3) -> list[int]:
    """Each voter's parent (-1: none) in the tree of most mutual information given the class, without links under
    `least` nats. both: counts by class, votes of the first and the second voter, first and second voter."""
    p = both / both.sum((1, 2), keepdims=True)
    alone = p.sum(2, keepdims=True) * p.sum(1, keepdims=True)
    share = both.sum((1, 2), keepdims=True) / both.sum((0, 1, 2))
    gain = (share * p * np.log(p / alone)).sum((0, 1, 2))
    m = gain.shape[0]
    parent, inside, outside = [-1] * m, [0], set(range(1, m))
    while outside:
        g, i, j = max((gain[i, j], -i, -j) for i in inside for j in outside)
        parent[-j] = -i if g >= least else -1
        inside.append(-j)
        outside.remove(-j)
    return parent


def fit_labels(votes: np.ndarray, rows: np.ndarray, seen: np.ndarray, toxic: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, dict]:
    """The generative model. votes: distinct patterns (0/1, one row each), rows: documents with each; seen and toxic:
    votes and labels of the sample. Returns each pattern's posterior and the parameters: rate (class, voter), balance,
    parent and given (class, vote of the parent, voter: rate of the voter)."""
    v, n, m = votes.astype(float), rows.astype(float), votes.shape[1]

    def counts(x: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Documents by votes of two voters: (vote, vote, voter, voter)."""
        y = 1 - x
        return np.array([[(a * w[:, None]).T @ b for b in (y, x)] for a in (y, x)])

    gold = np.array([counts(seen[toxic == c].astype(float), np.ones(int((toxic == c).sum()))) for c in (0, 1)])
    gold_n = np.array([(toxic == c).sum() for c in (0, 1)], float)
    both, balance = gold + 0.25, float((gold_n[1] + 0.5) / (gold_n.sum() + 1))
    posterior = np.zeros(len(v))
    for k in range(rounds):
        parent = tree(both)
        rate = np.array([np.diag(c[1, 1]) / (np.diag(c[1, 1]) + np.diag(c[0, 0])) for c in both])
        given = np.array([[rate[c]] * 2 for c in (0, 1)])
        for i, j in enumerate(parent):
            if j >= 0:
                given[:, :, i] = both[:, 1, :, i, j] / both[:, :, :, i, j].sum(1)
        above = np.array([v[:, j] if j >= 0 else np.zeros(len(v)) for j in parent]).T
        chance = [given[c, 0] * (1 - above) + given[c, 1] * above for c in (0, 1)]
        loglik = [(np.log(q) * v + np.log(1 - q) * (1 - v)).sum(1) for q in chance]
        now = 1 / (1 + np.exp(-np.clip(np.log(balance / (1 - balance)) + loglik[1] - loglik[0], -40, 40)))
        if k and np.abs(now - posterior).max() < 1e-6:
            break
        posterior = now
        both = np.array([counts(v, n * w) for w in (1 - posterior, posterior)]) + gold + 0.25
        balance = float(np.clip((n @ posterior + gold_n[1]) / (n.sum() + gold_n.sum()), 1e-4, 0.95))
    return posterior, {"rate": rate, "balance": balance, "parent": parent, "given": given}


def fit_weights(active: list[list[int]], target: np.ndarray, slots: int, penalty: float = 1.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic weights and intercept for soft targets, by accelerated gradient steps."""
    size = np.array([len(a) + 1 for a in active])
    at = np.fromiter((x for a in active for x in (*a, slots)), np.int64, int(size.sum()))  # the last slot is the intercept
    first = np.cumsum(size) - size
    times = lambda w: np.add.reduceat(w[at], first)
    back = lambda r: np.bincount(at, np.repeat(r, size), slots + 1)
    w = np.zeros(slots + 1)
    ahead, keep = w.copy(), np.append(np.full(slots, penalty), 0)
    u = np.random.default_rng(0).standard_normal(slots + 1)
    for _ in range(15):  # the curvature's bound, for the step
        u = back(times(u))
        norm = float(np.linalg.norm(u))
        u /= norm
    rate = 1 / (0.25 * norm + penalty)
    for k in range(steps):
        p = 1 / (1 + np.exp(-times(ahead)))
        new = ahead - rate * (back(p - target) + keep * ahead)
        ahead, w = new + (k / (k + 3)) * (new - w), new
    return w[:-1], float(w[-1])


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """labels: id and label columns. Returns (id, held_out, score, mark), one row for each row of docs."""
    spark = docs.sparkSession
    base = pick(docs, {"id": F.col(id_col).cast("long"), "mark": mark(text_col), "text": as_bytes(text_col)})
    usable = pick(labels, {"id": F.col(id_col).cast("long"), "toxic": F.col(label_col).cast("int")}).where(F.col("id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("id")))
    one_each = usable.groupBy("id").agg(F.max("toxic").alias("toxic"))
    chosen = cut(one_each.orderBy(F.md5(F.col("id").cast("string")), "id").limit(sample))  # at most `sample` rows
    texts = cut(base.join(F.broadcast(chosen), "id").groupBy("id", "toxic").agg(F.min_by("text", "mark").alias("text")).repartition(spark.sparkContext.defaultParallelism, "id"))
    spec, negative = Spec(), {}
    n = {r.toxic: r["count"] for r in texts.groupBy("toxic").count().collect()}
    if not n.get(1):
        return base.select("id", held_out(F.col("id")).alias("held_out"), F.lit(0.0).alias("score"), "mark")
    found = texts.where("toxic = 1").select("text")

    def terms(wanted: set[str] | None):
        def setup():
            def step(b: pa.RecordBatch) -> dict:
                out: Counter = Counter()
                for t in b.column(0).to_pylist():
                    own = {x for w in set(t.decode("utf-8", "replace").lower().split()) for x in terms_of(w)}
                    out.update(own if wanted is None else own & wanted)
                return {"term": list(out), "n": list(out.values())}

            return step

        return setup

    total = lambda df, wanted: arrow_map(df, terms(wanted), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    positive = {r.term: r.n for r in total(found, None).where(F.col("n") >= LEAST_DOCS).orderBy(F.desc("n"), "term").limit(CANDIDATES).collect()}
    negative = {r.term: r.n for r in total(texts.where("toxic = 0").select("text"), set(positive)).collect()}
    spec = choose(positive, negative, (n.get(0, 0), n[1]))

    def setup():
        numbers = Remembered({t: i for i, t in enumerate(spec.terms)})
        voter = {s: 1 << i for i, s in enumerate(spec.voters)}

        def step(b: pa.RecordBatch) -> dict:
            active = [spec.active(t.as_py().decode("utf-8", "replace"), numbers) for t in b.column(2)]
            return {"id": b.column(0), "mark": b.column(1), "slots": active, "votes": [sum(voter.get(s, 0) for s in a) for a in active]}

        return step

    marked = cut(arrow_map(base, setup, "id long, mark long, slots array<int>, votes int"))
    patterns = marked.groupBy("votes").count().collect()  # at most 2^VOTERS rows
    bits = lambda codes: (np.array(codes, np.int64)[:, None] >> np.arange(len(spec.voters))) & 1
    codes, n_all = [r.votes for r in patterns], sum(r["count"] for r in patterns)
    one = marked.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min_by(F.struct("slots", "votes", "toxic"), "mark").alias("x"))
    learned = one.orderBy(F.md5(F.col("id").cast("string"))).select("x.*").collect()  # at most `sample` rows
    key = F.md5(F.concat_ws(" ", F.coalesce(F.col("id").cast("string"), F.lit("")), "mark"))
    other = marked.join(F.broadcast(chosen.select("id")), "id", "left_anti").where(~held_out(F.col("id"))).select("slots", "votes", key.alias("key"))
    if n_all > 4 * sample:  # tasks sort and send a few samples in all, rather than one each
        other = other.where(F.col("key") < f"{int(4 * sample / n_all * 16**8):08x}")
    unlabelled = other.orderBy("key").limit(sample).collect()
    posterior, _ = fit_labels(bits(codes), np.array([r["count"] for r in patterns]), bits([r.votes for r in learned]), np.array([r.toxic for r in learned]))
    of = dict(zip(codes, posterior))
    used = learned + unlabelled
    weights, intercept = fit_weights([r.slots for r in used], np.array([of[r.votes] for r in used]), spec.slots)

    def scores():
        def step(b: pa.RecordBatch) -> dict:
            lists = b.column(2)
            size = np.diff(lists.offsets.to_numpy())
            owner = np.repeat(np.arange(len(size)), size)
            total = np.bincount(owner, weights[lists.flatten().to_numpy()], len(size)) + intercept
            return {"id": b.column(0), "mark": b.column(1), "score": 1 / (1 + np.exp(-np.clip(total, -40, 40)))}

        return step

    scored = arrow_map(marked.select("id", "mark", "slots"), scores, "id long, mark long, score double")
    return scored.select("id", held_out(F.col("id")).alias("held_out"), "score", "mark")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that score at least `threshold`."""
    bad = cut(toxicity(docs, labels, id_col, text_col).where(F.col("score") >= threshold).select("id", "mark"))
    return keep_rows(docs, bad, id_col, text_col, "anti")

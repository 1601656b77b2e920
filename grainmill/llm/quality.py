"""Quality rules with robust multivariate outliers.

Method. Each text gives counts in one pass. For each language and source, minimum-covariance-determinant estimates of
the transformed counts are found by concentration steps, and a document is rejected if its Mahalanobis distance is
beyond a chi-square quantile. A step is one aggregation over all rows: distances fall into fixed logarithmic bins, and
each (group, bin) keeps its sums; the bins up to `support` of a group's rows are its next subset (the last bin goes in
whole). So a group with a third of all rows is added up map-side and never gathered, and nothing is sampled. Two
starts are tried (median and MAD; mean and covariance), and the one of smaller determinant stays. Covariances are
regularised by a floor in each dimension, since for most groups over half the rows have no symbol or repeat at all.

Groups under `min_group` rows that pass the base rules are pooled by language, then all together; a pool that is still
smaller rejects nothing.

Defined results. Null text: no words, base_failed. Null languages and sources are groups of their own. Rows that fail
the base rules are not in the estimates. Repeated rows: one output row each. Empty table: empty result. Extra columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_LIMIT, arrow_map, as_bytes, cut, pick, small

SYMBOLS = b"#*$%&|<>"
#: Quantiles of chi-square with four degrees of freedom: 0.5 and 0.9999.
MEDIAN_4, CUTOFF_4 = 3.3567, 23.513
#: Smallest standard deviation of each dimension: mean word length, and square roots of three shares. Where nobody in a
#: group has any, each of the shares (3% symbols, 40% repeated lines, 35% repeated words) is at the cut by itself. Counts
#: that are nought for most texts are far from normal: in such groups these shares, not a tail probability, are the cut.
#: A lone line that stands twice in a text of four or five lines isn't beyond it.
FLOORS = (0.25, *((share / CUTOFF_4) ** 0.5 for share in (0.03, 0.4, 0.35)))
DIMS = len(FLOORS)
PAIRS = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]
BINS, PER_DOUBLING = 512, 16
#: A step that lowers no logarithm of a determinant by more is the last.
SETTLED = 0.01


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a three-word window found at least twice."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    w = np.fromiter((number.setdefault(x, len(number)) for x in words), np.int64, len(words))
    pair = np.unique(w[:-1] * len(number) + w[1:], return_inverse=True)[1].astype(np.int64)
    _, at, n = np.unique(pair[:-1] * len(number) + w[2:], return_inverse=True, return_counts=True)
    again = n[at] > 1
    hit = np.zeros(len(words), bool)
    for k in range(3):
        hit[k : k + len(again)] |= again
    return int(hit.sum())


def text_counts(text: bytes) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines with a word."""
    words = text.split()
    raw = np.frombuffer(b"".join(words), np.uint8)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), int(((raw & 0xC0) != 0x80).sum()), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def counts(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    def setup():
        def step(b: pa.RecordBatch) -> dict:
            found = [text_counts(t.as_py()) for t in b.column(3)]
            return {"id": b.column(0), "lang": b.column(1), "source": b.column(2)} | {c: [x[i] for x in found] for i, c in enumerate(COUNTS)}

        return step

    base = pick(docs, {"id": F.col(id_col).cast("long"), "lang": F.col(lang_col).cast("string"), "source": F.col(source_col).cast("string"), "text": as_bytes(text_col)})
    return arrow_map(base, setup, "id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def vector() -> list[Column]:
    share = lambda a, b: F.sqrt(F.least(F.col(a) / F.greatest(F.col(b), F.lit(1)), F.lit(1.0)))
    return [F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)), share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")]


def distance(mean: str, inverse: str) -> Column:
    """Squared Mahalanobis distance of the columns x0.. from array columns of a mean and the upper inverse covariance."""
    d = [F.col(f"x{i}") - F.element_at(mean, i + 1) for i in range(DIMS)]
    return sum(((1 if i == j else 2) * F.element_at(inverse, k + 1) * d[i] * d[j] for k, (i, j) in enumerate(PAIRS)), F.lit(0.0))


def settle(mean: np.ndarray, cov: np.ndarray) -> tuple[list[float], list[float], float]:
    cov = cov + np.diag(np.square(FLOORS))
    inverse = np.linalg.inv(cov)
    return mean.tolist(), [float(inverse[i, j]) for i, j in PAIRS], float(np.linalg.slogdet(cov)[1])


def moments(sums: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    n = sums["n"].sum()
    mean = np.array([sums[f"s{i}"].sum() for i in range(DIMS)]) / n
    cov = np.zeros((DIMS, DIMS))
    for i, j in PAIRS:
        cov[i, j] = cov[j, i] = sums[f"s{i}{j}"].sum() / n - mean[i] * mean[j]
    return mean, cov


def _sums() -> list[Column]:
    return [F.count("*").alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(DIMS)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i, j in PAIRS]]


FIT = "pool string, start int, mean array<double>, inverse array<double>, logdet double, scale double"


def estimates(rows: DataFrame, support: float = 0.75, steps: int = 12) -> DataFrame:
    """rows: pool and x0... Returns a row of FIT for each pool; scale makes the pool's median distance chi-square's.
    Steps end when no pool's least determinant so far falls any more, or after `steps`."""

    def from_moments(pdf: pd.DataFrame) -> pd.DataFrame:
        mean, cov = moments(pdf)
        m, inv, det = settle(mean, cov)
        robust = np.array([pdf[f"m{i}"].iloc[0] for i in range(DIMS)]), np.diag([(1.4826 * pdf[f"d{i}"].iloc[0]) ** 2 for i in range(DIMS)])
        return pd.DataFrame([(pdf["pool"].iloc[0], s, *settle(*mc), 1.0) for s, mc in enumerate(((mean, cov), robust))], columns=[c.split()[0] for c in FIT.split(", ")])

    def concentrate(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        upto = pdf["n"].cumsum()
        total = int(upto.iloc[-1])
        inside = pdf[(upto - pdf["n"]) < support * total]
        middle = int(pdf["bin"][upto >= total / 2].iloc[0])
        typical = 2 ** ((middle + 0.5) / PER_DOUBLING) - 1
        return pd.DataFrame([(pdf["pool"].iloc[0], pdf["start"].iloc[0], *settle(*moments(inside)), max(typical / MEDIAN_4, 1.0))], columns=[c.split()[0] for c in FIT.split(", ")])

    medians = rows.groupBy("pool").agg(*[F.percentile_approx(f"x{i}", 0.5, 1000).alias(f"m{i}") for i in range(DIMS)])
    medians = cut(medians)
    few = medians.count() * 2 * 400 <= BROADCAST_LIMIT  # a fit has two rows of a pool
    sent = lambda df: F.broadcast(df) if few else df
    spread = rows.join(sent(medians), "pool").groupBy("pool").agg(*_sums(), *[F.first(f"m{i}").alias(f"m{i}") for i in range(DIMS)], *[F.percentile_approx(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), 0.5, 1000).alias(f"d{i}") for i in range(DIMS)])
    fit = cut(spread.groupBy("pool").applyInPandas(from_moments, FIT)).withColumn("best", F.lit(float("inf")))
    bin_of = F.least(F.floor(F.log2(1 + F.greatest("d2", F.lit(0.0))) * PER_DOUBLING), F.lit(BINS - 1)).cast("int").alias("bin")
    for _ in range(steps):
        binned = rows.join(sent(fit), "pool").withColumn("d2", distance("mean", "inverse")).groupBy("pool", "start", bin_of).agg(*_sums())
        before = sent(fit.select("pool", "start", F.col("best").alias("before")))
        new = binned.groupBy("pool", "start").applyInPandas(concentrate, FIT).join(before, ["pool", "start"])
        fit = cut(new.select("*", F.least("logdet", "before").alias("best"), (F.col("logdet") < F.col("before") - SETTLED).alias("fell")).drop("before"))
        if fit.where("fell").isEmpty():
            break
        fit = fit.drop("fell")
    return fit.groupBy("pool").agg(F.min_by(F.struct("mean", "inverse", "scale"), F.struct("logdet", "start")).alias("f")).select("pool", "f.*")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_words: int = 50, most_repeats: int = 50, min_group: int = 50, cutoff: float = CUTOFF_4) -> DataFrame:
    """Adds to the counts: base_failed, distance (null where no estimate holds) and kept; one row for each row of docs."""
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))
    rows = cut(counts(docs, id_col, text_col, lang_col, source_col).select("*", failed.alias("base_failed"), *[x.alias(f"x{i}") for i, x in enumerate(vector())]))
    good = rows.where("not base_failed")
    name = lambda *c: F.to_json(F.array(*[F.coalesce(F.concat(F.lit("="), x), F.lit("null")) for x in c]))
    groups = good.groupBy("lang", "source").count().withColumn("of_lang", F.sum(F.when(F.col("count") < min_group, F.col("count"))).over(Window.partitionBy("lang")))
    pool = F.when(F.col("count") >= min_group, name(F.col("lang"), F.col("source"))).when(F.col("of_lang") >= min_group, name(F.col("lang"))).otherwise(F.lit("all"))
    pools = small(cut(groups.select(F.col("lang").alias("l"), F.col("source").alias("s"), pool.alias("pool"))), 200)
    match = F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s"))
    pooled = cut(good.join(pools, match).select("pool", *[f"x{i}" for i in range(DIMS)]))
    big = pooled.groupBy("pool").count().where(F.col("count") >= min_group).select("pool")
    fit = cut(estimates(pooled.join(small(cut(big), 100), "pool", "left_semi")))
    out = rows.join(pools, match, "left").join(small(fit, 300), "pool", "left")
    out = out.withColumn("distance", F.when(~F.col("base_failed"), distance("mean", "inverse") / F.col("scale")))
    return out.select("id", "lang", "source", *COUNTS, "base_failed", "distance", (~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))).alias("kept"))

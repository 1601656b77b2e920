"""Decoding filters over a table of logits: (sample, token, logit).

Null logits take no part: they are never kept, and add nothing. Ties stay together in top_k, and are cut by the smaller
token in nucleus and decode_step. Arrays that are null or shorter than an n-gram ban and repeat nothing. Repeated rows of
a token count as tokens of their own; a sample without tokens, and an empty table, give no rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def repetition_penalty(logits: DataFrame, generated: str, penalty: float) -> DataFrame:
    """Divides positive and multiplies other logits of tokens in the generated array."""
    seen = F.array_contains(generated, F.col("token"))
    worse = F.when(F.col("logit") > 0, F.col("logit") / penalty).otherwise(F.col("logit") * penalty)
    return logits.withColumn("logit", F.when(seen, worse).otherwise(F.col("logit"))) if penalty > 1 else logits


#: Stands for a null token, which equals another one.
NULL_TOKEN = -(2**62)


def _arrays(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of all arrays one behind the other, and where each array starts and stops; null arrays are empty."""
    sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(tokens.flatten().cast(pa.int64()), NULL_TOKEN).to_numpy(zero_copy_only=False)
    stop = np.cumsum(sizes)
    return flat, stop - sizes, stop


def window_hashes(flat: np.ndarray, n: int) -> np.ndarray:
    """A rolling hash of the n tokens from each place on (meaningless in the last n - 1 places), in steps of doubled length."""
    base, power = flat.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
    out, size = np.zeros(len(flat), np.uint64), 0
    part, length, left = base ^ (base >> np.uint64(29)), 1, n
    while left:
        if left & 1:  # the windows so far, then those of this length behind them
            behind = np.concatenate((part[size:], np.zeros(min(size, len(part)), np.uint64)))
            out, size = out * power + behind, size + length
        behind = np.concatenate((part[length:], np.zeros(min(length, len(part)), np.uint64)))
        part, length, left, power = part * power + behind, length * 2, left >> 1, power * power
    return out


def _earlier(flat: np.ndarray, start: np.ndarray, stop: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(array, place) of each n tokens in front of an array's last n that equal these: hashes first, then the tokens."""
    sizes = stop - start
    row = np.repeat(np.arange(len(sizes)), sizes)
    h = window_hashes(flat, n)
    long = sizes > n
    last = np.where(long, stop - n, 0)
    place = np.arange(len(flat))
    hit = np.flatnonzero(long[row] & (place < last[row]) & (h == h[last[row]])) if len(flat) else place
    for k in range(n):
        hit = hit[flat[hit + k] == flat[last[row[hit]] + k]]
    return row[hit], hit


def banned_tokens(tokens: Column, n: int) -> Column:
    """The tokens that would repeat an n-gram of the array after its last n - 1 tokens; sorted and distinct. Costs the
    array's length, whatever n is."""
    if n <= 0:
        return F.array().cast("array<int>")
    if n == 1:
        return F.array_sort(F.array_distinct(tokens))

    @F.arrow_udf("array<int>")
    def banned(tokens: pa.Array) -> pa.Array:
        flat, start, stop = _arrays(tokens)
        row, at = _earlier(flat, start, stop, n - 1)
        pairs = np.unique(np.stack((row, flat[at + n - 1]), axis=1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
        pairs = pairs[pairs[:, 1] != NULL_TOKEN]
        ends = np.searchsorted(pairs[:, 0], np.arange(len(tokens) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(pairs[:, 1].astype(np.int32)), mask=tokens.is_null())

    return banned(tokens)


def repeats_last(tokens: Column, n: int) -> Column:
    """Whether the last n tokens stand anywhere before (null for a null array). Costs the array's length, whatever n is."""

    @F.arrow_udf("boolean")
    def repeats(tokens: pa.Array) -> pa.Array:
        flat, start, stop = _arrays(tokens)
        found = np.zeros(len(tokens), bool)
        found[_earlier(flat, start, stop, n)[0]] = True
        return pa.array(found, mask=tokens.is_null().to_numpy(zero_copy_only=False))

    return repeats(tokens)


def top_k(logits: DataFrame, sample: str, k: int) -> DataFrame:
    """Tokens whose logit is at least the k-th largest; ties stay."""
    return logits.withColumn("__r", F.rank().over(Window.partitionBy(sample).orderBy(F.desc("logit")))).where(F.col("__r") <= k).drop("__r")


def softmax(logits: DataFrame, sample: str) -> DataFrame:
    w = Window.partitionBy(sample)
    d = logits.withColumn("__e", F.exp(F.col("logit") - F.max("logit").over(w)))
    return d.withColumn("prob", F.col("__e") / F.sum("__e").over(w)).drop("__e")


def nucleus(probs: DataFrame, sample: str, p: float) -> DataFrame:
    """Tokens in falling order while the probability before them is at most p; the first stays in any case."""
    w = Window.partitionBy(sample).orderBy(F.desc("prob"), F.asc("token")).rowsBetween(Window.unboundedPreceding, -1)
    return probs.withColumn("__b", F.coalesce(F.sum("prob").over(w), F.lit(0.0))).where(F.col("__b") <= p).drop("__b") if p < 1 else probs


def decode_step(logits: DataFrame, sample: str, generated: str, temperature: float = 1.0, penalty: float = 1.0, ngram: int = 0, k: int = 0, p: float = 1.0, seed: int = 0) -> DataFrame:
    """One sampling step in the order temperature, repetition, ban, top-k, top-p, softmax, sample: the chosen token of
    each sample, by the largest of log-probability plus seeded Gumbel noise."""
    d = repetition_penalty(logits.withColumn("logit", F.col("logit") / temperature), generated, penalty)
    if ngram > 0:
        d = d.where(~F.array_contains(banned_tokens(F.col(generated), ngram), F.col("token")))
    if k > 0:
        d = top_k(d, sample, k)
    d = softmax(nucleus(softmax(d, sample), sample, p), sample)
    u = (F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(sample).cast("string"), F.col("token").cast("string")), 256), 1, 12), 16, 10).cast("double") + 1) / float(16**12 + 2)
    return d.groupBy(sample).agg(F.max_by("token", F.log("prob") - F.log(-F.log(u))).alias("token"))

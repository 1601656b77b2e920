"""The pipeline's stages against brute force on the smallest tables."""

import hashlib
import math
import os
import re
import sys

from conftest import DATA

import corpus_pipeline
from grainmill.llm import queries
from grainmill.llm.simhash import Forest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_operators import slow_fingerprint  # noqa: E402


def one_of_each(rows):
    """The smallest id of each component of fingerprints at most two bits apart, all pairs compared."""
    fps = {i: slow_fingerprint(r.text) for i, r in rows.items()}
    ids = sorted(fps)
    forest = Forest(len(ids))
    for i in range(len(ids)):
        for j in range(i):
            if (fps[ids[i]] ^ fps[ids[j]]).bit_count() <= 2:
                forest.join(i, j)
    return {ids[i] for i in range(len(ids)) if forest.root(i) == i}


def training_order(rows):
    """The ids of the mix in order: targets by repeated sharing, a source's documents by hash, copies by position."""
    by, weight, slope = {}, {}, {}
    for r in rows.values():
        by.setdefault(r.source, []).append((len(re.findall("[^\x20\x09-\x0d]+", r.text or "")), r.doc_id))
    for k, s in enumerate(sorted(by)):
        weight[s], slope[s] = (5, 2, 1)[k % 3], (-0.5, 0.0, 0.5)[k % 3]
    size = {s: sum(n for n, _ in v) for s, v in by.items()}
    full, total = set(), sum(size.values())
    while True:
        left = total - sum(3 * size[s] for s in full)
        open_weight = sum(weight[s] for s in by if s not in full)
        over = {s for s in by if s not in full and left * weight[s] / open_weight > 3 * size[s]}
        if not over:
            break
        full |= over
    out = []
    for s, docs in by.items():
        target, at = 3 * size[s] if s in full else left * weight[s] / open_weight, 0
        for n, i in sorted(docs, key=lambda x: (int(hashlib.md5(str(x[1]).encode()).hexdigest()[:15], 16), x[1])):
            for k in range(3):
                middle = at + k * size[s] + n / 2
                if n and middle <= target:
                    u, b = middle / target, 1 - slope[s]
                    out.append((u if slope[s] == 0 else (math.sqrt(b * b + 4 * slope[s] * u) - b) / (2 * slope[s]), i))
            at += n
    return [i for _, i in sorted(out)]


def test_odd_rows(spark):
    """Nulls in every column, repeated rows and clashing columns go through all stages."""
    from test_operators import ROWS, frame

    docs = frame(spark)
    columns, seen = docs.columns, None
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    assert labels.count() > 0
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, DATA))
        if name == "bpe":
            break
        assert docs.columns == columns
        seen = sorted((str(r.doc_id) for r in docs.collect()))
        if name in ("exact_dedup", "simhash_near_dedup"):
            assert len(seen) == len(set(seen))
    assert seen and len(seen) <= 3 * len(ROWS) and docs.where("n_tokens > 0").count() == len(seen)


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.cut(stage(spark, docs, DATA))
        rows = {r.doc_id: r for r in docs.collect()}
        if name == "toxicity":
            scores = {r.doc_id: r.predicted for r in queries.op1_toxicity(spark, DATA).collect()}
            assert {r.doc_id for r in out.collect()} == {i for i in rows if not scores[i]}
        elif name == "exact_dedup":
            best = {}
            for r in rows.values():
                k = re.sub("[\x20\x09-\x0d]+", "", r.text)
                best[k] = min(best.get(k, (0, 0)), (-len(r.text), r.doc_id)) if k in best else (-len(r.text), r.doc_id)
            assert {r.doc_id for r in out.collect()} == {i for _, i in best.values()}
        elif name == "simhash_near_dedup":
            assert {r.doc_id for r in out.collect()} == one_of_each(rows)
        elif name == "mixing":
            assert [r.doc_id for r in out.collect()] == training_order(rows)
        if name != "bpe":
            assert out.columns == columns
        else:
            assert out.count() == docs.count()
        seen[name], docs = out.count(), out
    assert seen["toxicity"] >= seen["exact_dedup"] >= seen["simhash_near_dedup"] > 0
    assert corpus_pipeline.run(spark, DATA).count() == seen["bpe"]


def test_empty(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert docs.count() == 0

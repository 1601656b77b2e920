"""The corpus operators against brute force, and their defined results for odd inputs."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from conftest import DATA, canonical
from pyspark.sql import functions as F

from grainmill.llm import bpe, common, components, exact_dedup, htmltext, linededup, mixing, quality, queries, simhash, substring, tokencount, toxicity

WS = "[\x20\x09-\x0d]+"
LONG = "word and more words " * 12_000

#: Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns with clashing names.
ROWS = [(1, "The same text here", "en", "a"), (2, "The same  text here", "en", "a"), (2, "The same  text here", "en", "a"), (3, "", "en", None), (4, None, None, "b"), (None, "no id at all", "fr", "a"), (None, None, None, None), (5, LONG, "de", "b"), (6, "é 😀 日本 x\x85y <|endoftext|>", "es", "b"), (7, " \n\t ", "en", "c")]


def frame(spark, rows=ROWS):
    d = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("id", "norm", "n", "key", "h", "fp", "size", "rows", "pos", "at", "target", "row", "part", "k", "pool", "x0", "kept", "host", "lines", "votes", "slots", "doc", "start", "bucket", "side", "first", "range", "positions"):
        d = d.withColumn(c, F.lit("clash"))
    return d


def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA).toPandas()
    table = "pages" if name.startswith(("op6_", "op10_")) else "documents"
    if name.startswith(("op11_", "op12_", "op13_")):
        assert len(got)
    elif name != "op3_substring_dedup":
        assert len(got) == duck.sql(f"select count(*) from {table}").fetchall()[0][0]
    if name in queries.ORACLES:
        want = duck.sql(queries.ORACLES[name]).df()
        assert canonical(got) == canonical(want)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(200, 300)] + [(rng.randrange(200), rng.randrange(200)) for _ in range(90)] + [(7, 7), (None, 3)]
    forest = simhash.Forest(400)
    for a, b in edges:
        if a is not None:
            forest.join(a, b)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for i in range(301):
        assert got.get(i, i) == forest.root(i)


def slow_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_simhash_brute_force(spark):
    docs = documents(spark)
    rows = docs.select("doc_id", "text").collect()
    want = {r.doc_id: slow_fingerprint(r.text) for r in rows}
    ids = sorted(want)
    forest = simhash.Forest(len(ids))
    for i in range(len(ids)):
        for j in range(i):
            if (want[ids[i]] ^ want[ids[j]]).bit_count() <= 2:
                forest.join(i, j)
    for hot in (20_000, 2):
        got = {r.id: (r.fp % 2**64, r.component_id) for r in simhash.near_groups(docs, hot=hot).collect()}
        assert got == {d: (want[d], ids[forest.root(i)]) for i, d in enumerate(ids)}


def test_tiles_find_all_links():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, np.uint64)
    fps = np.unique(np.concatenate([base ^ np.uint64(1 << int(k)) for k in rng.integers(0, 63, 12)] + [base]))
    fps = fps[np.argsort(np.bitwise_count(fps), kind="stable")]
    forest = simhash.Forest(len(fps))
    for p, q in simhash.tile_links(fps, None, 2, tile=16):
        assert (int(fps[p]) ^ int(fps[q])).bit_count() <= 2
        forest.join(p, q)
    for i in range(len(fps)):
        for j in range(i):
            if (int(fps[i]) ^ int(fps[j])).bit_count() <= 2:
                assert forest.root(i) == forest.root(j)


def test_every_bucket_goes_through_tiles():
    """Small buckets share tiles, with tile pairs skipped by population count; links are those of all pairs of a bucket."""
    import pyarrow.parquet as pq

    texts = pq.read_table(f"{DATA.replace('0.001', '0.01')}/documents.parquet", columns=["text"]).column(0).to_pylist()
    nodes = np.unique(np.array([simhash.fingerprint((t or "").encode()) for t in texts], np.uint64))
    nodes = np.unique(np.concatenate([nodes, nodes[:40] ^ np.uint64(5), nodes[:40] ^ np.uint64(1 << 40)]))
    for bits, sides in ((22, 1), (6, 1), (4, 2), (2, 1)):  # ever larger buckets
        bucket = (nodes & np.uint64((1 << bits) - 1)).astype(np.int64)
        side = (nodes >> np.uint64(30)).astype(np.int64) % sides
        order = np.lexsort((np.bitwise_count(nodes), side, bucket))
        b, s, fp, tally = bucket[order], side[order], nodes[order], [0, 0]
        forest, want = simhash.Forest(len(fp)), simhash.Forest(len(fp))
        at = {int(x): i for i, x in enumerate(fp)}
        for x, y in simhash.bucket_links(b, s, fp, 2, tally).tolist():
            assert (x ^ y).bit_count() <= 2
            forest.join(at[x], at[y])
        two = {int(x) for x in b if len(set(s[b == x].tolist())) == 2} if sides == 2 else set()
        for i in range(len(fp)):
            near = np.flatnonzero((np.bitwise_count(fp[:i] ^ fp[i]) <= 2) & (b[:i] == b[i]))
            for j in near.tolist():
                if int(b[i]) not in two or s[i] != s[j]:
                    want.join(i, j)
        assert [forest.root(i) for i in range(len(fp))] == [want.root(i) for i in range(len(fp))]
        assert tally[0] > 0
    texts = pq.read_table(f"{DATA.replace('0.001', '0.1')}/documents.parquet", columns=["text"]).column(0).to_pylist()
    nodes, tally = np.unique(np.array([simhash.fingerprint((t or "").encode()) for t in texts], np.uint64)), [0, 0]
    for k in range(3):  # the production buckets
        bucket = ((nodes >> np.uint64(22 * k)) & np.uint64((1 << 22) - 1)).astype(np.int64)
        order = np.lexsort((np.bitwise_count(nodes), bucket))
        simhash.bucket_links(bucket[order], np.zeros(len(nodes), np.int64), nodes[order], 2, tally)
    assert tally[0] > 0 and tally[1] > 0


def test_simhash_radius(spark):
    nodes = spark.createDataFrame([(x,) for x in (0, 1, 3, 7, 1 << 63 - 1, -1, -2, 0b11111)], "fp long")
    for radius, hot in ((1, 100), (1, 1), (3, 100), (3, 1)):
        got = {frozenset((r.a, r.b)) for r in simhash.links(nodes, radius, hot).collect()}
        assert all(((a % 2**64) ^ (b % 2**64)).bit_count() <= radius for a, b in map(tuple, got))
        assert frozenset((0, 1)) in got or frozenset((1, 3)) in got


def test_simhash_edges(spark):
    got = sorted(((r.id, r.component_id) for r in simhash.near_groups(frame(spark)).collect()), key=str)
    assert len(got) == len(ROWS)
    assert [c for i, c in got if i in (3, 4, 7)] == [3, 3, 3]
    assert simhash.near_groups(frame(spark).limit(0)).count() == 0
    kept = simhash.near_dedup(frame(spark))
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == frame(spark).columns and len(ids) == len(set(ids)) and {1, 3, 5, 6} <= set(ids)


def test_exact_edges(spark):
    for all_rows in (True, False):
        got = exact_dedup.exact_groups(frame(spark), digest_all=all_rows).collect()
        assert len(got) == len(ROWS)
        by = {r.id: r for r in got if r.id is not None}
        assert by[1].keep_id == by[2].keep_id == 2 and by[1].group_size == 3 and not by[1].kept
        assert by[3].keep_id == by[4].keep_id == by[7].keep_id == 7 and by[3].group_size == 4
        assert by[5].kept and by[5].group_size == 1
    text = dict(zip([r[0] for r in ROWS], [r[1] or "" for r in ROWS]))
    for r in exact_dedup.exact_groups(frame(spark), digest_all=True).where("id is not null").collect():
        assert r.full_hash == hashlib.sha256(re.sub(WS, "", text[r.id]).encode()).hexdigest()
    assert exact_dedup.exact_groups(frame(spark).limit(0)).count() == 0
    kept = exact_dedup.exact_dedup(frame(spark))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [2, 5, 6, 7, None]


def test_bpe_against_library(spark):
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = documents(spark).select("doc_id", "text").collect()
    texts = {r.doc_id: r.text for r in rows} | {100_000 + i: t for i, t in enumerate(["", "Ab<|startoftext|>c <|endoftext|>", "Σίσυφος ΟΔΟΣ ﬁ 日本", "it's WE'LL o'brien 12 ½", "aaaa aaaaa aaaaaaa", "İstanbul ǅ ẞ a\x85b\x1cc", "😀 naïve​", LONG[:3000]])}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in bpe.decode(bpe.encode(df, path, window=2000).withColumnRenamed("decoded", "first"), path).collect():
        e = library.encode(texts[r.id], add_special_tokens=False)
        assert r.ids == " ".join(map(str, e.ids)) and r.n_tokens == len(e.ids)
        assert r.first == r.decoded == library.decode(e.ids, skip_special_tokens=False)


def test_bpe_edges(spark):
    got = bpe.encode(frame(spark), queries.vocabulary("word_bpe_49k.json")).collect()
    assert len(got) == len(ROWS) and {r.id: r.n_tokens for r in got if r.id in (3, 4, 7)} == {3: 0, 4: 0, 7: 0}
    assert bpe.encode(frame(spark).limit(0), queries.vocabulary("word_bpe_49k.json")).count() == 0


def test_token_counts_against_library(spark):
    from tokenizers import Tokenizer

    path = queries.vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [r.text for r in documents(spark).select("text").collect()] + [r[1] or "" for r in ROWS] + [" " * 900 + "a", "x" * 3000, "a  b\n\n c\t", "<|endoftext|> a" * 90, "日本語" * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for chunk, overlap in ((32_768, 256), (300, 8)):
        got = {r.id: (r.n_bytes, r.n_tokens) for r in tokencount.token_counts(df, path, chunk=chunk, overlap=overlap).collect()}
        assert got == {i: (len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for i, t in enumerate(texts)}
    # boundaries anywhere, also inside tokens: chunks that don't align are cut wider
    usual = documents(spark).where("length(text) between 300 and 20000").limit(40)
    wide = tokencount.token_counts(usual, path, chunk=150, overlap=60, stable=re.compile("(?s)(?=.)"))
    want = {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) for r in usual.collect()}
    assert {r.id: r.n_tokens for r in wide.collect()} == want
    c = tokencount.counter(open(path, encoding="utf-8").read(), path)
    assert c.between("several words here", 3, 10) is None and c.between("several words here", 7, 13) == 1
    got = tokencount.token_counts(frame(spark), path, chunk=1000).collect()
    assert len(got) == len(ROWS) and sum(r.n_tokens == 0 for r in got) == 3
    assert tokencount.token_counts(frame(spark).limit(0), path).count() == 0


def test_mixing(spark):
    got = mixing.mix(frame(spark)).collect()
    assert len(got) == len(ROWS) and all(r.taken <= 3 * r.size for r in got)
    rows = mixing.mix(documents(spark), run=16).collect()
    again = {r.id: r.taken for r in mixing.mix(documents(spark).repartition(7)).collect()}
    assert {r.id: r.taken for r in rows} == again
    source = {r.doc_id: r.source for r in documents(spark).collect()}
    per = {}
    for r in rows:
        t = per.setdefault(source[r.id], [0, r.target, r.source_size, 0])
        t[0] += r.taken
        t[3] = max(t[3], r.size)
    total, targets = sum(t[2] for t in per.values()), sum(t[1] for t in per.values())
    assert abs(total - targets) < 1e-6 * total
    for taken, target, size, largest in per.values():
        assert target <= 3 * size and abs(taken - target) <= largest / 2 + 1e-6
    at = [p for r in rows for p in r.positions]
    assert all(0 <= p <= 1 for p in at)
    first = [r.positions[0] for r in rows if r.positions]
    assert first == sorted(first)
    assert mixing.mix(frame(spark).limit(0)).count() == 0
    small = spark.createDataFrame([(1, "a b c", "s"), (2, "d", "t"), (3, "e f", None)], "doc_id long, text string, source string")
    assert mixing.mixed_documents(small).columns == small.columns


def test_water_filling(spark):
    rows = [("a", 10), ("b", 1000), ("c", 5), (None, 7)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame([(s, n, 1) for s, n in rows], "source string, source_size long, rows long")).collect()}
    weight = {"a": 5, "b": 2, "c": 1, None: 5}
    full, total = set(), sum(n for _, n in rows)
    while True:
        left = total - sum(3 * n for s, n in rows if s in full)
        share = {s: left * weight[s] / sum(weight[x] for x, _ in rows if x not in full) for s, _ in rows if s not in full}
        over = {s for s, n in rows if s not in full and share[s] > 3 * n}
        if not over:
            break
        full |= over
    for s, n in rows:
        assert abs(got[s] - (3 * n if s in full else share[s])) < 1e-9 * total


def slow_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines)


def test_quality(spark):
    for t in [r.text for r in documents(spark).select("text").limit(40).collect() if len(r.text) < 6000] + ["", "a b c a b c a", "é # é\n\n \né # é", "x x x x x"]:
        assert quality.text_counts(t.encode()) == slow_counts(t)
    got = quality.judge(frame(spark)).collect()
    assert len(got) == len(ROWS) and not any(r.kept for r in got if r.n_words < 50)
    assert quality.judge(frame(spark).limit(0)).count() == 0
    rng = random.Random(2)
    clean = [(i, " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(80)), "en", "s") for i in range(120)]
    junk = [(1000 + i, " ".join("".join(rng.choices("abcdefgh", k=4)) + "%%%" for _ in range(80)), "en", "s") for i in range(12)]
    out = {r.id: r.kept for r in quality.judge(frame(spark, clean + junk)).collect()}
    assert all(out[i] for i, *_ in clean) and not any(out[i] for i, *_ in junk)


def test_quality_each_dimension_rejects(spark):
    """Among texts without symbols and repeats, an outlier in one dimension alone is rejected."""
    rng = random.Random(3)
    some = lambda n, k=(2, 9): ["".join(rng.choices("abcdefgh", k=rng.randint(*k))) for _ in range(n)]
    lines = lambda n: [" ".join(some(8)) for _ in range(n)]
    symbols = [" ".join(x + "%" * (i % 3 == 0) for i, x in enumerate(some(80)))]
    twice = lines(40)
    for i in range(1, 40):
        if i % 2:
            twice[i] = "ab"  # short lines: hardly a word of the text repeats
    phrase = some(20)
    words = [" ".join(some(60) + phrase + some(20) + phrase + some(20) + phrase)]
    outliers = symbols + ["\n".join(twice)] + words + [" ".join(some(80, (12, 14)))]
    rows = [(i, "\n".join(lines(12)), "en", "s") for i in range(200)] + [(1000 + i, t, "en", "s") for i, t in enumerate(outliers)]
    got = {r.id: r for r in quality.judge(frame(spark, rows)).collect()}
    assert all(got[i].kept for i in range(200)) and not any(got[1000 + i].base_failed for i in range(4))
    assert [got[1000 + i].kept for i in range(4)] == [False] * 4


def slow_mcd(x, support, starts=60):
    """Mean, inverse covariance and scale of the subset of smallest determinant, from random starts; no bins."""
    rng, h, best = np.random.default_rng(0), int(np.ceil(support * len(x))), None
    floor = np.diag(np.square(quality.FLOORS))
    for _ in range(starts):
        inside, last = rng.choice(len(x), 6, replace=False), np.inf
        while True:
            mean, cov = x[inside].mean(0), np.cov(x[inside].T, bias=True) + floor
            inverse, det = np.linalg.inv(cov), np.linalg.slogdet(cov)[1]
            d2 = np.einsum("ij,jk,ik->i", x - mean, inverse, x - mean)
            if len(inside) == h and det >= last - 1e-12:
                break
            last, inside = (det if len(inside) == h else np.inf), np.argsort(d2, kind="stable")[:h]
        if best is None or det < best[0]:
            best = det, mean, inverse, max(np.median(d2) / quality.MEDIAN_4, 1.0)
    return best[1:]


def test_quality_against_slow_mcd(spark):
    rng = np.random.default_rng(8)
    rows, data = [], {}
    for pool, far, share in (("a", 4, 0.1), ("b", -3, 0.2), ("c", 0, 0.0)):
        x = np.abs(rng.normal(0, 1, (300, 4)) @ np.array([[1, 0.1, 0, 0], [0, 0.15, 0.05, 0], [0, 0, 0.1, 0.1], [0, 0, 0, 0.2]]))
        out = rng.random(300) < share
        x[out] += np.array([far, 0.6, 0.5, 0.7])
        data[pool] = x
        rows += [(pool, *map(float, r)) for r in x]
    df = spark.createDataFrame(rows, "pool string, " + ", ".join(f"x{i} double" for i in range(4)))
    verdict = lambda x, mean, inverse, scale: np.einsum("ij,jk,ik->i", x - mean, inverse, x - mean) / scale > quality.CUTOFF_4
    for r in quality.estimates(df).collect():
        inverse = np.zeros((4, 4))
        for k, (i, j) in enumerate(quality.PAIRS):
            inverse[i, j] = inverse[j, i] = r.inverse[k]
        mean, slow_inverse, slow_scale = slow_mcd(data[r.pool], 0.75)
        assert np.abs(np.array(r.mean) - mean).max() < 0.1
        mine, slow = verdict(data[r.pool], np.array(r.mean), inverse, r.scale), verdict(data[r.pool], mean, slow_inverse, slow_scale)
        assert (mine != slow).sum() <= 3 and (slow.sum() > 20) == (r.pool != "c")


def test_line_dedup(spark):
    pages = [(i, f"https://a.org/{i}", f"<nav>Home</nav><p>Own {i}<p>Shared<br>x{i}<script>var a='<p>Home</p>'</script>") for i in range(20)]
    pages += [(50, "https://b.org/", "<p>Home</p>"), (51, None, "<p>Home</p>"), (52, "/rel", None), (53, "HTTPS://A.org/x", "Home<li>Own 3")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("lines", F.lit("clash")).withColumn("host", F.lit("clash"))
    got = {r.id: r for r in linededup.line_dedup(df).collect()}
    assert got[3].text == "Own 3\nx3" and (got[3].n_lines, got[3].n_dropped) == (4, 2)
    assert got[50].text == got[51].text == "Home" and got[52].text == "" and got[53].text == "Own 3"
    assert linededup.line_dedup(df.limit(0)).count() == 0


HTML = """<!DOCTYPE html><html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>One</a><li><a href=/>Two</a></ul></nav>
<div class="cookie-notice">We use cookies. Please accept.</div><article><h1>Head &amp; more</h1><p>First  para
with <b>bold</b> text, long enough to count.<p>Second para &eacute; is here as well, it ends.<div class="ad">Buy this now!</div><p>Third para closes the article, as it should.</p>
<section class="comments"><p>Reader says hello, a long comment that ends.</p></section></article><aside>Side words here.</aside><form><p>Your mail</p></form><footer>&copy; x</footer></body></html>"""


def test_html_rules():
    text = htmltext.main_text(HTML)
    assert text.split("\n") == ["Head & more", "First para with bold text, long enough to count.", "Second para é is here as well, it ends.", "Third para closes the article, as it should."]


PARA = "This is a long enough paragraph of text, which says something about a subject, and then it ends here."

#: Pages that are valid HTML, and the lines of their main text.
VALID = [
    (f"<html><head><meta charset=x><title>T</title><script>a='<p>no</p>'</script><body><article><p>{PARA}<p>Two.</article>", [PARA, "Two."]),
    (f"<html><head><title>T</title><article><p>{PARA}</p></article>", [PARA]),
    (f"<article><p>{PARA}</p><svg viewBox='0'/><p>{PARA}</p><svg><title>x</title></svg></article>", [PARA, PARA]),
    (f"<div id=top><a href=/>Home</a> <a href=/x>About us</a> <a href=/y>Contact</a></div><div><div><h1>Title of it</h1><p>{PARA}</p><p>Short.</p><p>{PARA}</p></div></div><div>&copy; 2024 Example. All rights reserved.</div>", ["Title of it", PARA, "Short.", PARA]),
    (f"<article><p>{PARA} <a title='x > y' href=/q>linked</a> word</p></article>", [f"{PARA} linked word"]),
    (f"<div/><article><p>{PARA} <a href=/>link</a> tail</p></article></div>", [f"{PARA} link tail"]),
    (f"<body class='has-sidebar'><div class='main-content'><p>{PARA}</p></div><div class=sidebar><p>{PARA}</p></div>", [PARA]),
    (f"<div class=post><header class=entry-header><h1 class=entry-title>A title</h1></header><p>{PARA}</p></div>", ["A title", PARA]),
    (f"<form id=f><nav><a href=x>Home</a></nav><main><p>{PARA}</p><p>ok</p></main></form>", [PARA, "ok"]),
    (f"<article><p>{PARA}</p></article><section id=comments><article class=comment><p>{PARA}</p></article><article><p>{PARA}</p></article></section>", [PARA]),
    (f"<main><p>{PARA}</p></main><aside><article><h2>Other</h2><p>{PARA}</p></article></aside>", [PARA]),
    ("<article><h1>Nd.</h1><p><b>Nd.<br></article><footer>&copy; x</footer>", ["Nd.", "Nd."]),
    (f"<!--><p>{PARA}</p><!-- <p>no</p> --!><p>Two&nbsp;words</p><p unfinished=", [PARA, "Two words"]),
    ("Text alone", ["Text alone"]),
    ("<nav><a href=/>Home</a></nav>", []),
]


@pytest.mark.parametrize("html, want", VALID)
def test_html_valid_pages(html, want):
    assert htmltext.main_text(html) == "\n".join(want)


def test_minimum_cut_is_minimal():
    rng = random.Random(4)
    for _ in range(80):
        n = rng.randint(1, 8)
        odds = [rng.uniform(-2, 2) for _ in range(rng.randint(1, n))]
        ties = [(i, j, rng.uniform(0, 1.5)) for i in range(n) for j in range(-2, i) if rng.random() < 0.4]
        side = lambda x, i: x[i] if i >= 0 else i == -1
        cost = lambda x: sum(max(-o, 0) if c else max(o, 0) for o, c in zip(odds, x)) + sum(w for i, j, w in ties if x[i] != side(x, j))  # noqa: B023, E731
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert abs(cost(htmltext.minimum_cut(odds, ties, n)) - best) < 1e-9


def test_html_edges(spark):
    rows = [(1, "u", HTML), (1, "u", HTML), (2, None, None), (3, "u", ""), (None, "u", "<p>x"), (4, "u", "<article><p>" + "Long words here. " * 20_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("id", F.lit("clash")).withColumn("text", F.lit("clash"))
    got = htmltext.extract(df).collect()
    assert len(got) == len(rows) and {r.id: r.text for r in got}[2] == "" and len({r.id: r.text for r in got}[4]) > 300_000
    assert htmltext.extract(df.limit(0)).count() == 0


def test_html_articles(spark, monkeypatch):
    """All pages against the markup that the generator of the test tables writes; the cut is what decides."""
    import html as h

    pages = {r.page_id: r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = queries.op6_html(spark, DATA).collect()
    assert len(got) == len(pages)
    for r in got:
        body = re.split("</article>|<footer", pages[r.page_id].html.split("<article>")[1])[0]
        parts = [" ".join(h.unescape(re.sub("<[^>]*>", " " if "<br" in p else "", p)).split()) for p in re.split("</?(?:p|h1)>", body)]
        assert r.text == "\n".join(p for p in parts if p)
        assert r.n_chars == len(r.text) and 0 <= r.n_cut <= r.n_blocks
    calls = []
    monkeypatch.setattr(htmltext, "max_flow", lambda *a, flow=htmltext.max_flow: calls.append(a) or flow(*a))
    moved = sum(sum(c != a for c, a in zip(*htmltext.labelled(p.html, htmltext.PRIOR)[1:])) for p in pages.values())
    assert len(calls) == len(pages) and moved > 0


def test_toxicity_held_out(spark):
    sf = DATA.replace("0.001", "0.1")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.op1_toxicity(spark, sf).join(labels, "doc_id").where("held_out").toPandas()
    hit = got[got.predicted == 1]
    assert (hit.toxic == 1).mean() > 0.95 and (got[got.toxic == 1].predicted == 1).mean() > 0.9
    rank = got.score.rank().to_numpy()
    y = got.toxic.to_numpy()
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (1 - y).sum())
    assert auc > 0.95


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(1, 0), (5, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(frame(spark), labels).collect()
    assert len(got) == len(ROWS) and all(r.score == 0.0 for r in got)
    real = spark.read.parquet(f"{DATA}/labels.parquet")
    mixed = frame(spark).select("doc_id", "text").unionByName(documents(spark).select("doc_id", "text"))
    scores = toxicity.toxicity(mixed, real).collect()
    assert len(scores) == len(ROWS) + documents(spark).count() and all(0 <= r.score <= 1 for r in scores)
    assert toxicity.toxicity(frame(spark).limit(0), real).count() == 0


def test_label_model_recovers_rates():
    rng = np.random.default_rng(5)
    y = rng.random(20_000) < 0.2
    rates = np.array([[0.02, 0.05, 0.1, 0.01], [0.8, 0.7, 0.6, 0.5]])
    votes = (rng.random((len(y), 4)) < rates[y.astype(int)]).astype(int)
    patterns, back, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior, model = toxicity.fit_labels(patterns, n, votes[:200], y[:200].astype(int))
    assert np.abs(model["rate"] - rates).max() < 0.06 and abs(model["balance"] - 0.2) < 0.03
    assert ((posterior[back] > 0.5) == y).mean() > 0.95


def test_label_model_learns_correlations():
    """Five copies of one weak voter don't outvote two independent good ones."""
    rng = np.random.default_rng(6)
    y = rng.random(30_000) < 0.3
    draw = lambda low, high: rng.random(len(y)) < np.where(y, high, low)
    weak = draw(0.25, 0.6)
    votes = np.array([draw(0.05, 0.85), draw(0.06, 0.8), weak, *[weak ^ (rng.random(len(y)) < 0.02) for _ in range(4)]]).T.astype(int)
    patterns, back, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior, model = toxicity.fit_labels(patterns, n, votes[:300], y[:300].astype(int))
    assert sum(j >= 2 for j in model["parent"][3:]) >= 3 or sum(j >= 2 for j in model["parent"][2:]) >= 4
    rate = model["rate"]
    score = np.log(rate[1] / rate[0]) * votes + np.log((1 - rate[1]) / (1 - rate[0])) * (1 - votes)
    naive = 1 / (1 + np.exp(-(score.sum(1) + np.log(0.3 / 0.7))))
    loss = lambda p: -np.log(np.where(y, p, 1 - p)).mean()
    assert ((posterior[back] > 0.5) == y).mean() > 0.92 and loss(posterior[back]) < 0.8 * loss(naive)


def planted(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(3, 9)))
    passage = [word() for _ in range(60)]
    fuzzy = [w if rng.random() > 0.06 else word() for w in passage]
    gap = passage[:30] + [word() for _ in range(3)] + passage[30:]
    rows = [(i, " ".join([word() for _ in range(rng.randint(5, 120))] + (p or []) + [word() for _ in range(rng.randint(5, 90))])) for i, p in enumerate([None, passage, None, fuzzy, gap, passage, None, passage[:40], None])]
    return passage, spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")


def test_passages(spark):
    passage, docs = planted(spark)
    got = substring.passages(docs).collect()
    assert {r.doc for r in got} | {r.partner for r in got} == {1, 3, 4, 5}
    text = {r.doc_id: r.text.split() for r in docs.collect()}
    for r in got:
        assert r.similarity >= 0.8 and min(r.end_word - r.start_word, r.partner_end - r.partner_start) >= 50
        if r.similarity == 1:
            assert text[r.doc][r.start_word : r.end_word] == text[r.partner][r.partner_start : r.partner_end] == passage
    left = {r.doc_id: r.text.split() for r in substring.cut_passages(docs, substring.passages(docs)).collect()}
    assert left[1] == text[1] and len(left[5]) == len(text[5]) - 60 and left[0] == text[0]


def test_passages_edges(spark):
    got = substring.passages(frame(spark, ROWS + [(8, LONG, "en", "b"), (9, LONG.upper(), "en", "b")])).collect()
    assert all(r.doc is not None for r in got)
    assert substring.passages(frame(spark).limit(0)).count() == 0


def test_chain_prefers_collinear():
    anchors = [(0, 20, 100), (22, 20, 122), (10, 5, 400), (45, 20, 145)]
    assert substring.chain(anchors)[0] == [0, 1, 3]
    assert substring.common_words(list("abcde"), list("axcye")) == 3 and substring.extend(list("aabb"), list("aaxb"), 2) == (2, 2)


def test_chain_after_long_stretch():
    """A long stretch that is too far behind doesn't hide a near predecessor; gaps count on both sides."""
    anchors = [(0, 200, 0), (290, 12, 290), (305, 12, 305), (320, 12, 320), (335, 12, 335)]
    assert substring.chain(anchors) == [[0], [1, 2, 3, 4]]
    assert substring.chain([(0, 200, 0), (203, 12, 265)]) == [[0], [1]]


def test_edited_passage_after_long_stretch(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=8))
    long, passage = [word() for _ in range(200)], [word() for _ in range(60)]
    edited = [word() if i % 13 == 12 else w for i, w in enumerate(passage)]
    rows = [(i, " ".join(long + [word() for _ in range(100)] + p + [word() for _ in range(40)]), "en", "s") for i, p in enumerate((passage, edited))]
    got = {(r.doc, r.start_word, r.end_word) for r in substring.passages(frame(spark, rows)).collect()}
    assert any(d == 1 and a == 300 and b >= 359 for d, a, b in got)


def test_passage_whose_parts_have_other_hubs(spark):
    """Documents of small ids hold only part of a passage: those that share all of it are still found."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=8))
    around = lambda p: " ".join([word() for _ in range(rng.randint(20, 60))] + p + [word() for _ in range(30)])
    passage = [word() for _ in range(60)]
    rows = [(i, around(passage[:35] if i < 20 else passage if i in (20, 30) else []), "en", "s") for i in range(40)]
    found = substring.passages(frame(spark, rows)).collect()
    text = {i: t.split() for i, t, _, _ in rows}
    assert {r.doc for r in found} | {r.partner for r in found} == {20, 30}
    assert any(text[r.doc][r.start_word : r.end_word] == text[r.partner][r.partner_start : r.partner_end] == passage for r in found)


def test_later_places_in_a_document(spark):
    """A teaser before the whole passage, and second copies inside one document."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=8))
    some = lambda n: [word() for _ in range(n)]
    passage, own = some(60), some(70)
    texts = {1: some(30) + passage + some(20), 2: passage[:35] + some(100) + passage + some(20), 3: some(10) + own + some(90) + own + some(5) + own[:55] + some(9), 4: some(300)}
    docs = frame(spark, [(i, " ".join(t), "en", "s") for i, t in texts.items()])
    found = substring.passages(docs)
    got = {(r.doc, r.start_word, r.end_word, r.partner, r.partner_start) for r in found.collect()}
    assert {(2, 135, 195, 1, 30), (3, 170, 240, 3, 10), (3, 245, 300, 3, 10)} <= got and not any(4 in (d, p) for d, _, _, p, _ in got)
    left = {r.doc_id: r.text.split() for r in substring.cut_passages(docs, found).collect()}
    assert left[1] == texts[1] and left[2] == texts[2][:135] + texts[2][195:] and left[3] == texts[3][:170] + texts[3][240:245] + texts[3][300:]


def test_copies_within_brute_force():
    rng = random.Random(9)
    for trial in range(60):
        pool = [rng.randrange(1 << 60) for _ in range(40)]
        words = []
        for _ in range(12):
            a = rng.randrange(30)
            words += pool[a : a + rng.randint(3, 10)] if trial % 2 else pool[:3] * rng.randint(1, 5) + pool[a : a + 2]
        got = substring.copies_within(np.array(words, np.uint64), 5)
        assert all(f + q - p <= p and words[p:q] == words[f : f + q - p] and q - p >= 5 for p, q, f in got)
        covered = {x for p, q, _ in got for x in range(p, q)}
        for p in range(len(words) - 4):
            if any(words[f : f + 5] == words[p : p + 5] for f in range(p - 4)):
                assert set(range(p, p + 5)) <= covered


def test_exact_stretches_brute_force(spark):
    """Every word of 50 equal words in two documents is in a passage found; texts are spliced from shared pieces."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=8))
    pool = [word() for _ in range(400)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(1, 5)):
            a = rng.randrange(340)
            words += pool[a : a + rng.randint(20, 60)] + [word() for _ in range(rng.randint(0, 9))]
        rows.append((i, " ".join(words), "en", "s"))
    covered, holders = set(), {}
    for r in substring.passages(frame(spark, rows)).collect():
        covered |= {(r.doc, p) for p in range(r.start_word, r.end_word)} | {(r.partner, p) for p in range(r.partner_start, r.partner_end)}
    for i, t, _, _ in rows:
        w = t.split()
        for p in range(len(w) - 49):
            holders.setdefault(tuple(w[p : p + 50]), []).append((i, p))
    want = {(i, p + j) for places in holders.values() if len({i for i, _ in places}) > 1 for i, p in places for j in range(50)}
    assert len(want) > 1000 and want <= covered


def all_pairs_passages(rows):
    """Passages of every pair of documents that share a seed, without hubs: chains of all their matches, aligned."""
    import pyarrow as pa

    text, seeder, places = {i: (t or "").encode() for i, t in rows}, substring.Seeder(), {}
    for i, raw in text.items():
        _, pos, at, h = seeder.seeds(np.frombuffer(raw, np.uint8), np.array([len(raw)]), substring.K, substring.WINDOW)
        for p, b, x in zip(pos.tolist(), at.tolist(), h.tolist()):
            places.setdefault(x, []).append((i, p, b))
    met = sorted((a[0], b[0], b[1], a[1], b[2], a[2]) for v in places.values() for a in v for b in v if a[0] < b[0])
    hub, doc, pos, hpos, at, hat = (np.array(x) for x in zip(*met))
    kinds = ((hub, pa.int64()), (doc, pa.int64()), *((x, pa.int32()) for x in (pos, at, hpos, hat)))
    batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in kinds], names=list("abcdef"))
    for b in substring._chains(substring.K, 50 - 2 * (substring.WINDOW - 1) - 2 * substring.K)([batch]):
        for r in b.to_pylist():
            left, hleft, n, m, hits = substring.align(text[r["doc"]], r["start_at"], text[r["hub"]], r["hstart_at"], r["rel"], r["size"], r["hrel"])
            if min(n, m) >= 50 and 2 * hits >= 0.8 * (n + m):
                yield r["doc"], r["start"] - left, n, r["hub"], r["hstart"] - hleft, m


def test_passages_against_all_pairs(spark):
    """What the comparison of all pairs finds is covered on both sides, and its pairs are linked; nothing else is reported
    but repeats inside a document."""
    docs = documents(spark)
    covered, forest, found = {}, simhash.Forest(100_000), substring.passages(docs).collect()
    for r in found:
        covered.setdefault(r.doc, set()).update(range(r.start_word, r.end_word))
        covered.setdefault(r.partner, set()).update(range(r.partner_start, r.partner_end))
        forest.join(r.doc, r.partner)
    want = list(all_pairs_passages([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]))
    sides = [x[:3] for x in want] + [x[3:] for x in want]
    recall = sum(len(covered.get(d, set()) & set(range(a, a + n))) >= 0.8 * n for d, a, n in sides) / len(sides)
    linked = sum(forest.root(x[0]) == forest.root(x[3]) for x in want) / len(want)
    assert len(want) > 20 and recall >= 0.95 and linked >= 0.95
    assert {r.doc for r in found if r.doc != r.partner} <= {d for d, _, _ in sides}


def test_pairs_beside_a_shorter_hub(spark):
    """In each group the smallest id holds the first 40 of 60 words: the two that hold all are paired over all of them."""
    rng = random.Random(11)
    some = lambda n: ["".join(rng.choices("abcdefghij", k=rng.randint(5, 9))) for _ in range(n)]
    rows = []
    for g in range(40):
        p = some(60)
        rows += [(3 * g + j, " ".join(some(rng.randint(20, 80)) + x + some(rng.randint(20, 80))), "en", "s") for j, x in enumerate((p[:40], p, p))]
    got = {(r.doc, r.partner) for r in substring.passages(frame(spark, rows)).collect() if r.end_word - r.start_word >= 60}
    assert sum((3 * g + 1, 3 * g + 2) in got or (3 * g + 2, 3 * g + 1) in got for g in range(40)) == 40


def test_seeds_cover_exact_stretches():
    rng = random.Random(7)
    seeder = substring.Seeder()
    words = ["".join(rng.choices("abcdef", k=rng.randint(1, 8))) for _ in range(400)]
    raw = " ".join(words).encode() + b" Extra" + " ".join(words[100:200]).upper().encode()
    ends = np.array([len(" ".join(words)), len(raw)])
    text, pos, at, h = seeder.seeds(np.frombuffer(raw, np.uint8), ends, 5, 5)
    mine = dict(zip(h[text == 0].tolist(), pos[text == 0].tolist()))
    shared = [(p, mine[x]) for p, x in zip(pos[text == 1].tolist(), h[text == 1].tolist()) if x in mine]
    assert shared and all(q - p == 100 for p, q in shared)
    steps = np.diff([p for p, _ in shared])
    assert steps.max() <= 5 and shared[0][0] <= 6


def test_mix_of_repeated_rows(spark):
    rows = [(1, "a b", "en", "s"), (1, "a b", "en", "s"), (None, "c d", "en", "s"), (None, "e f g", "en", "s"), (2, "h", "en", "t")]
    plan = {}
    for r in mixing.mix(frame(spark, rows)).collect():
        plan[(r.id, r.size)] = plan.get((r.id, r.size), 0) + len(r.positions)
    got = {}
    for r in mixing.mixed_documents(frame(spark, rows)).collect():
        k = (r.doc_id, len(r.text.split()))
        got[k] = got.get(k, 0) + 1
    assert got == {k: n for k, n in plan.items() if n}


def test_shuffled_ways_agree(spark, monkeypatch):
    """Beyond the broadcast limit the same rows come out through shuffles."""
    docs = documents(spark).unionByName(frame(spark).select(*documents(spark).columns))
    pages = spark.read.parquet(f"{DATA}/pages.parquet")

    def all_rows():
        found = [simhash.near_groups(docs), exact_dedup.exact_groups(docs, digest_all=True), simhash.near_dedup(docs), exact_dedup.exact_dedup(docs), mixing.mix(docs).drop("positions"), mixing.mixed_documents(docs), quality.judge(docs).select("id", "n_words", "kept"), substring.passages(docs), linededup.line_dedup(pages)]
        return [canonical(f.toPandas()) for f in found]

    sent = all_rows()
    monkeypatch.setattr(common.small, "__defaults__", (0,))
    monkeypatch.setattr(linededup, "BROADCAST_LIMIT", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert all_rows() == sent
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

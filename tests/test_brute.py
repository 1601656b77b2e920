"""Queries that SQL can't express, against slow versions over all rows of the smallest tables."""

import hashlib
import json
import math
import random
import re
import statistics
import time
import unicodedata
from collections import Counter

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from grainmill.operators import contamination as R
from grainmill.operators import judging as J
from grainmill.operators import packing as P
from grainmill.operators import vocabulary
from grainmill.operators.vocabulary import train_merges
from grainmill.plans.corpus import review_documents, review_lexicon
from grainmill.plans.registry import QUERIES


def rows(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet").collect()


def slow_sentences(text):
    """(start, stop) by walking: a sentence is what stands before a run of terminators that ends its word, or the line."""
    out, base = [], 0
    for line in text.split("\n"):
        at = 0
        while at < len(line):
            if line[at] in ".!?":
                at += 1
                continue
            end = at
            while end < len(line) and line[end] not in ".!?":
                end += 1
            stop = end
            while stop < len(line) and line[stop] in ".!?":
                stop += 1
            if stop == len(line) or line[stop].isspace():
                if line[at:stop].strip():
                    out.append((base + at, base + stop))
                at = stop
            else:
                at = end  # the terminators are inside a word
        base += len(line) + 1
    return out


def test_sentence_spans(spark):
    want = sorted((r.doc_id, a, b, r.text[a:b]) for r in rows(spark, "documents") for a, b in slow_sentences(r.text))
    assert sorted(map(tuple, QUERIES["sentence_spans"](spark, DATA).select("doc_id", "start", "stop", "text").collect())) == want


def is_word(c):
    return c == "_" or unicodedata.category(c)[0] in "LN"


def slow_near(text, a, b, words=5):
    """Places of a that have b after up to five words; matches don't overlap."""
    t, at, out = text.lower(), 0, []
    while (at := t.find(a, at)) >= 0:
        ends, pos = [], at + len(a)
        for _ in range(words + 1):
            gap = pos
            while gap < len(t) and not is_word(t[gap]):
                gap += 1
            if gap == pos:
                break
            if t.startswith(b, gap):
                ends.append(gap + len(b))
            pos = gap
            while pos < len(t) and is_word(t[pos]):
                pos += 1
        if ends:
            out.append(at)
            at = max(ends)
        else:
            at += 1
    return out


def test_sentence_findings(spark):
    want = set()
    phrases, pairs = review_lexicon(spark, DATA)
    for r in review_documents(spark, DATA).collect():
        spans, found = slow_sentences(r.text), {}
        hits = [(m.start(), p, "exact") for p in phrases for m in re.finditer(re.escape(p), r.text, re.I)]
        hits += [(at, f"{a} [0-5 words] {b}", "proximity") for a, b in pairs for at in slow_near(r.text, a, b)]
        for at, trigger, source in hits:
            inside = [s for s in spans if s[0] <= at < s[1]]
            line = (r.text.rfind("\n", 0, at) + 1, (r.text + "\n").index("\n", at))
            t, s = found.setdefault(inside[0] if inside else line, (set(), set()))
            t.add(trigger)
            s.add(source)
        want |= {(r.doc_id, a, b, tuple(sorted(t)), tuple(sorted(s))) for (a, b), (t, s) in found.items()}
    found = QUERIES["sentence_findings"](spark, DATA).collect()
    assert len(want) > 100 and {(r.doc_id, r.start, r.stop, tuple(r.triggers), tuple(r.sources)) for r in found} == want
    assert {r.label for r in found} == {"DEFINITE", "HISTORICAL", "BORDERLINE", "FIGURATIVE", "FALSE_POSITIVE"}
    assert any(len(t) > 80 for r in found for t in r.triggers), "whole benchmark items are found"


def test_near_words_and_phrases():
    """The automaton's matches are those of one pattern for each phrase and pair."""
    rng = random.Random(8)
    pairs = [("earth", "moves"), ("moves", "earth"), ("a", "a"), ("go", "go")]
    phrases = ["aa", "a a", "earth", "EARTH moves", "ss", "x"]
    finder = R.Finder(phrases, pairs)
    parts = ["earth", "Earth", "moves", "MOVES", "a", "aa", "aaa", "go", "é", "ſs", "İ", "x_", "_", "-", ".", "\n", " ", " ", " ", "ß", "1"]
    for _ in range(3000):
        t = "".join(rng.choices(parts, k=rng.randrange(1, 40)))
        want = [(m.start(), "exact", p) for p in phrases for m in re.finditer(re.escape(p), t, re.I)]
        want += [(m.start(), "proximity", f"{a} [0-5 words] {b}") for a, b in pairs for m in re.finditer(rf"{a}(?:\W+\w+){{0,5}}\W+{b}", t, re.I)]
        assert sorted(finder.hits(t)) == sorted(want), t


def test_front_matter(spark):
    got = {r.doc_id: r.text for r in QUERIES["front_matter_trim"](spark, DATA).collect()}
    for r in rows(spark, "documents"):
        text = "A TITLE\n\nby one\n\n" + r.text.replace("\n", "\n\n")
        want = text
        for m in re.finditer(r"(?:(?!(?:\r?\n[ \t]*){2}).)+", text, re.S):
            p = m.group()
            letters = [c for c in p if c.isalpha()]
            upper = sum(c.isupper() for c in letters)
            if letters and upper >= 0.6 * len(letters):
                continue
            if "." in p and any(c.islower() for c in p) and len(" ".join(p.split())) >= 200:
                want = text[m.start() :].lstrip("\n")
                break
        assert got[r.doc_id].lstrip("\n") == want


def slow_kind(line):
    s = line.strip()
    if not s:
        return "blank"
    entry = re.search(r"^\s*((chapter|book|part|section)\s+[ivxlcdm0-9]+[a-z]?[.:)]?|[ivxlcdm0-9]+\.\s+|(preface|introduction|appendix|prologue|epilogue)\b)", s, re.I)
    if entry or re.search(r"\.{2,}\s*\d+\s*$", s) or (len(s) < 90 and re.search(r"\s\d+\s*$", s)):
        return "entry"
    if len(s) >= 70 and len(re.findall("[A-Za-z]+", s)) >= 10:
        return "prose"
    return "short" if len(s) <= 60 else "other"


def slow_block(kinds):
    """Lines of the block after a header, by looking at every prefix."""
    stop = next((i for i, k in enumerate(kinds) if k == "other"), len(kinds))
    since = lambda e: kinds[max([j for j in range(e) if kinds[j] == "entry"], default=-1) + 1 : e].count("prose")
    stop = next((e for e in range(1, stop + 1) if since(e) == 2), stop)
    like = sum(k in ("entry", "short") for k in kinds[:stop])
    return stop - since(stop) if like >= 2 else 0


def test_toc_blocks(spark):
    got = {r.doc_id: (r.toc_removed, r.n_lines) for r in QUERIES["toc_blocks"](spark, DATA).collect()}
    for r in rows(spark, "documents"):
        lines = ["Chapter I. x", "", "Preface ... 3", *r.text.split("\n")]
        removed = 1 + slow_block([slow_kind(x) for x in lines[:300]])
        assert not any(re.match(r"\s*(table of contents|contents?|index)\s*[:.]?\s*$", x, re.I) for x in lines)
        assert got[r.doc_id] == (removed, 1 + len(lines) - removed)


def test_json_repair(spark):
    texts = ['{"a": 1}', ' {"a": 1} ', '```json\n{"a": 2}\n```', 'so {"a": "}", "b": {"c": 1}} end', "[1]", "3", "no", '{"a": 1', 'x {"a": "\\""} {"b": 2}', "", "{bad} {\"a\": 1}"]

    def slow(t):
        for c in (t, t.strip(), re.sub(r"\s*```$", "", re.sub(r"^```[A-Za-z]*\s*", "", t.strip())).strip()):
            try:
                v = json.loads(c)
                return v if isinstance(v, dict) else None
            except ValueError:
                continue
        for end in range(len(t) + 1):  # the first stretch from the first brace that balances
            start = t.find("{")
            if start < 0 or end <= start:
                continue
            bare = re.sub(r'"(?:[^"\\]|\\.)*"', "", t[start:end])
            if bare.count('"') == 0 and bare.count("{") == bare.count("}"):
                try:
                    v = json.loads(t[start:end])
                    return v if isinstance(v, dict) else None
                except ValueError:
                    return None
        return None

    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: json.loads(r.v) if r.v else None for r in df.select("i", F.to_json(J.parse_answer(F.col("t"))).alias("v")).collect()}
    assert got == {i: slow(t) for i, t in enumerate(texts)}


def test_decode_step(spark):
    got = {r["sample"]: r.token for r in QUERIES["decode_step"](spark, DATA).collect()}
    for e in rows(spark, "embeddings")[:80]:
        z = {t: math.floor(abs(x * 8) * 10 + 0.5) / 10 * (1 if x >= 0 else -1) / 0.8 for t, x in enumerate(map(float, e.embedding))}
        z = {t: (v / 1.1 if v > 0 else v * 1.1) if t in (1, 2, 3) else v for t, v in z.items()}
        edge = sorted(z.values(), reverse=True)[19]
        z = {t: v for t, v in z.items() if v >= edge - 1e-12}

        def soft(z):
            top = max(z.values())
            total = sum(math.exp(v - top) for v in z.values())
            return {t: math.exp(v - top) / total for t, v in z.items()}

        keep, before = {}, 0.0
        for t, p in sorted(soft(z).items(), key=lambda x: (-x[1], x[0])):
            if before <= 0.95:
                keep[t] = z[t]
            before += p
        noise = lambda t: (int(hashlib.sha256(f"5|{e.vec_id}|{t}".encode()).hexdigest()[:12], 16) + 1) / (16**12 + 2)  # noqa: B023, E731
        score = {t: math.log(p) - math.log(-math.log(noise(t))) for t, p in soft(keep).items()}
        assert got[e.vec_id] == max(score, key=score.get)


def joined(parts, pair):
    """parts with the pair joined wherever it stands."""
    out, k = [], 0
    while k < len(parts):
        step = 2 if tuple(parts[k : k + 2]) == pair else 1
        out.append(type(parts[0])().join(parts[k : k + step]))
        k += step
    return out


def slow_merges(counts, n):
    """Plain training: every pair counted anew for every merge; ties to the older parts."""
    age = {bytes([b]): k for k, b in enumerate([*range(33, 127), *range(161, 173), *range(174, 256), *range(33), *range(127, 161), 173])}
    words = {w: [bytes([b]) for b in w.encode()] for w in counts}
    out = []
    while len(age) < 256 + n:
        pairs = Counter()
        for w, p in words.items():
            for x in zip(p, p[1:]):
                pairs[x] += counts[w]
        if not pairs:
            break
        best = min(pairs, key=lambda x: (-pairs[x], age[x[0]], age[x[1]]))
        out.append(best)
        age.setdefault(best[0] + best[1], len(age))
        words = {w: joined(p, best) for w, p in words.items()}
    return out


@pytest.mark.parametrize("head", [1, 40, 300, 10**6])
def test_vocabulary_training_is_exact_for_any_head(spark, head):
    """Guessing on few words and verifying on all gives what plain training gives, to the last merge."""
    texts = " ".join(r.text for r in rows(spark, "documents")[:40])
    counts = Counter(re.findall(r" ?[^\W\d_]+|aaaa+|\s+", texts + " aaaaaaa aaaaaa abcabc bcabca " * 3))
    counts = dict(sorted(counts.items())[::7])
    frame = spark.createDataFrame([*counts.items(), (None, 5)], "word string, n long")
    n = {1: 40, 40: 80}.get(head, 400)
    assert train_merges(frame, n, head_words=head) == slow_merges(counts, n)
    assert train_merges(frame.limit(0), 10, head_words=head) == []


def test_vocabulary_rounds_are_few(spark, monkeypatch):
    """Words that don't fit the driver cost a few rounds over their table, not one for every few merges."""
    counts = Counter(w for r in rows(spark, "documents")[:60] for w in re.findall(r" ?[^\W\d_]+", r.text))
    rounds, frequent = [], vocabulary._frequent
    monkeypatch.setattr(vocabulary, "_frequent", lambda *a: rounds.append(a[1]) or frequent(*a))
    merges = train_merges(spark.createDataFrame([*counts.items()], "word string, n long"), 500, head_words=len(counts) // 4)
    assert merges == slow_merges(counts, 500) and len(rounds) <= 20


def test_word_as_long_as_a_text(spark):
    """The ids of a word of 60,000 characters, which cost the square of its length before."""
    vocab, ranks = {c: i for i, c in enumerate(["a", "b", "ab", "abab", "aa"])}, {("a", "b"): 0, ("ab", "ab"): 1, ("a", "a"): 2}
    begin = time.perf_counter()
    assert P.bpe_ids("ab" * 30_001, vocab, ranks) == [3] * 15_000 + [2]
    assert P.bpe_ids("a" * 5 + "b", vocab, ranks) == [4, 4, 2]
    assert time.perf_counter() - begin < 10


def test_vocabulary_merges_the_most_frequent_pair(spark):
    texts = [r.text for r in rows(spark, "documents")][:60]
    docs = spark.createDataFrame([(t,) for t in texts], "t string")
    vocab, merges = P.train_vocabulary(docs, "t", size=256 + 4 + 80)
    assert len(merges) == 80 and len(vocab) == 340
    pieces = Counter(w for t in texts for w in re.findall(r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+", t.strip()))
    words = {w: [chr(b) for b in w.encode()] for w in pieces}
    for pair in merges:
        counts = Counter()
        for w, p in words.items():
            for x in zip(p, p[1:]):
                counts[x] += pieces[w]
        assert counts[pair] == max(counts.values())
        words = {w: joined(p, pair) for w, p in words.items()}
    assert sum(len(p) * pieces[w] for w, p in words.items()) + len(texts) > 0
    ids = {t: r.ids for t, r in zip(texts, P.encode(docs.withColumn("i", F.monotonically_increasing_id()), "t", vocab, merges).orderBy("i").collect())}
    names = {i: x for x, i in vocab.items()}
    for t in texts:
        assert "".join(names[i] for i in ids[t][1:]).encode("latin-1").decode() == " " + t.strip(" ")


def test_glyph_lines(spark):
    pages = {}
    for r in rows(spark, "lineitem"):
        x = round(math.fmod(r.l_extendedprice, 500), 1)
        pages.setdefault((r.l_orderkey, 0 if x < 250 else 1), []).append((r.l_quantity, x, r.l_returnflag))
    got = Counter((r.page, r.col) for r in QUERIES["glyph_lines"](spark, DATA).collect())
    for key, glyphs in pages.items():
        n, anchor = 0, None
        for top, _, _ in sorted(glyphs):
            if anchor is None or abs(top - anchor) > 2:
                n, anchor = n + 1, top
        assert got[key] == n


def test_flip_p_values(spark):
    got = QUERIES["flip_p_values"](spark, DATA).collect()
    seen = 0
    for r in got:
        d = r.asDict()
        chi, p = d.get("chi2_stat"), d.get("p_value")
        if chi is not None and p is not None:
            x, steps = math.sqrt(chi), 20_000  # twice the normal tail by the trapezoid rule
            h = 12 / steps
            tail = sum(math.exp(-((x + i * h) ** 2) / 2) * (0.5 if i in (0, steps) else 1) for i in range(steps + 1)) * h
            assert abs(p - 2 * tail / math.sqrt(2 * math.pi)) < 1e-5
            seen += 1
    assert seen or got


def test_permutation_compat(spark):
    langs = {r.doc_id: r.lang for r in rows(spark, "documents")}
    by = {}
    for r in sorted(rows(spark, "labels"), key=lambda r: r.doc_id):
        if r.doc_id in langs and r.quality is not None and r.toxic is not None:
            by.setdefault(langs[r.doc_id], []).append(float(r.quality - r.toxic))
    for r in QUERIES["permutation_test_compat"](spark, DATA).collect():
        values, draw = by[r.scope], random.Random(12345).random
        hits = 0
        for _ in range(10_000):
            total = 0.0
            for x in values:
                total += x if draw() < 0.5 else -x
            hits += abs(total / len(values)) >= abs(statistics.mean(values))
        assert (r.n_pairs, r.p_value) == (len(values), hits / 10_000)


def test_evaluation_report(spark):
    text = "\n".join(r.value for r in QUERIES["evaluation_report"](spark, DATA).orderBy("line_no").collect())
    heads = re.findall(r"^## (.*)$", text, re.M)
    assert heads[:2] == ["Overall Comparison", "Category Comparison"] and sum(h.startswith("Top ") for h in heads) == 3
    assert heads[-3:] == ["Prompt-level paired permutation tests", "Hedge phrases, overall by model", "Hedge phrases, by model and category"]

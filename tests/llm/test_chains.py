"""Chaining by the Fenwick tree against plain quadratic loops, and passages against a comparison of plain words."""

import random
from difflib import SequenceMatcher

from conftest import DATA

from grainmill.llm import substring


def slow_chain(anchors, slack, gap):
    """Best scores by looking at every earlier anchor; then the same reading off of chains."""
    score, prior = {}, {}
    order = sorted(range(len(anchors)), key=lambda i: anchors[i])
    for i in order:
        s, n, h = anchors[i]
        found = [(0.0, -1)]
        for j in score:
            sj, nj, hj = anchors[j]
            dx, dy = s - sj - nj, h - hj - nj
            if sj < s and -slack <= dx <= gap and -slack <= dy <= gap:
                found.append((score[j] - substring.GAP_COST * (dx + dy), j))
        value, j = max(found)
        score[i], prior[i] = n + max(0.0, value), j if value > 0 else -1
    out, used = [], set()
    for i in sorted(range(len(anchors)), key=lambda i: -score[i]):
        path = []
        while i >= 0 and i not in used:
            used.add(i)
            path.insert(0, i)
            i = prior[i]
        if path:
            out.append(path)
    return out


def test_chain_against_every_predecessor():
    rng = random.Random(6)
    for trial in range(400):
        spread = rng.choice((30, 120, 600))
        anchors = sorted({(rng.randrange(spread), rng.randrange(5, 30), rng.randrange(spread)) for _ in range(rng.randrange(1, 40))})
        assert substring.chain(anchors) == slow_chain(anchors, substring.K - 1, substring.MOST_GAP), trial


def test_tree_takes_values_away():
    rng = random.Random(7)
    for _ in range(200):
        n = rng.randrange(1, 20)
        tree, plain = substring.Fenwick(n), [substring.Fenwick.NONE] * n
        for _ in range(60):
            at, value = rng.randrange(n), rng.choice((substring.Fenwick.NONE, (float(rng.randrange(9)), rng.randrange(9))))
            tree.put(at, value)
            plain[at] = value
            a, b = sorted((rng.randrange(n + 1), rng.randrange(n + 1)))
            assert tree.most(a, b) == max(plain[a:b], default=substring.Fenwick.NONE)


def test_fuzzy_copies_among_other_hubs(spark):
    """Documents of small ids hold half of a passage, two others all of it, one with every 13th word changed."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=8))
    around = lambda p: " ".join([word() for _ in range(rng.randint(20, 60))] + p + [word() for _ in range(30)])
    rows = []
    for g in range(40):
        passage = [word() for _ in range(80)]
        rows += [(g * 5 + i, around(passage[:40])) for i in range(5)]
        rows += [(1000 + 2 * g, around(passage)), (1001 + 2 * g, around([word() if i % 13 == 12 else w for i, w in enumerate(passage)]))]
    found = substring.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    pairs = {tuple(sorted((r.doc, r.partner))) for r in found}
    assert sum((1000 + 2 * g, 1001 + 2 * g) in pairs for g in range(40)) >= 36


def plain_passages(words, k=5, gap=60):
    """Of each pair of documents: runs of shared k-word windows (first places), chained greedily by place, as plain words;
    at least 50 words on both sides and similar by 0.8 in the sense of difflib. Shares no code with the operator."""
    places = {}
    for d, w in words.items():
        seen = set()
        for i in range(len(w) - k + 1):
            g = tuple(w[i : i + k])
            if g not in seen:
                seen.add(g)
                places.setdefault(g, []).append((d, i))
    met = {}
    for v in places.values():
        for x, (d, i) in enumerate(v):
            for e, j in v[x + 1 :]:
                met.setdefault((d, e), []).append((i, j))
    for (d, e), at in met.items():
        runs = []
        for i, j in sorted(at):
            for r in runs:
                if 0 <= i - r[1] <= gap and 0 <= j - r[3] <= gap:
                    r[1], r[3] = i, j
                    break
            else:
                runs.append([i, i, j, j])
        for a, b, p, q in runs:
            left, right = words[d][a : b + k], words[e][p : q + k]
            if min(len(left), len(right)) >= 50 and SequenceMatcher(None, left, right, autojunk=False).ratio() >= 0.8:
                yield d, a, b + k, e, p, q + k


def test_passages_against_plain_words(spark):
    """At least nine of ten words of what plain words show are in reported passages, and the operator's passages are similar by
    the same plain measure."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    words = {r.doc_id: (r.text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\r", " ").split(" ") for r in docs}
    words = {d: [x for part in w for x in part.replace("\n", " ").replace("\t", " ").split(" ") if x] for d, w in words.items()}
    found = substring.passages(spark.read.parquet(f"{DATA}/documents.parquet")).collect()
    covered = {}
    for r in found:
        covered.setdefault(r.doc, set()).update(range(r.start_word, r.end_word))
        covered.setdefault(r.partner, set()).update(range(r.partner_start, r.partner_end))
        left, right = words[r.doc][r.start_word : r.end_word], words[r.partner][r.partner_start : r.partner_end]
        assert min(len(left), len(right)) >= 50 and SequenceMatcher(None, left, right, autojunk=False).ratio() >= 0.75
    asked = hit = 0
    for d, a, b, e, p, q in plain_passages(words):
        for doc, x, y in ((d, a, b), (e, p, q)):
            asked += y - x
            hit += len(covered.get(doc, set()) & set(range(x, y)))
    assert asked > 2000 and hit >= 0.9 * asked, (hit, asked)

"""Chat formatting, hard negatives and ranked search against brute force, with odd rows."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from grainmill.llm import chatformat, hardneg, lexical, queries, template

CLASH = ("id", "row", "n", "bag", "m", "hash", "item", "rank", "score", "block", "pos", "chunk", "range", "v", "a_block", "part", "spans", "label2")


def clashing(df):
    for c in CLASH:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("clash"))
    return df


def render(source, scope=None, **constants):
    return "".join(p for p in template.compile_template(source, constants=constants)(scope or {}) if isinstance(p, str))


def test_template_language():
    loop = "{% for x in xs %}{{ loop.index }}{{ x.name | default('?') | upper }}{% if not loop.last %}, {% endif %}{% endfor %}"
    assert render(loop, {"xs": iter([{"name": "a"}, {}, {"name": "c"}])}) == "1A, 2?, 3C"
    assert render("{{ 1 + 2 - 3 if false else 7 // 2 % 2 }}") == "1"
    assert render("a {#- gone -#} b {%- set x = 'q' ~ 1 -%} {{ x }}") == "abq1"
    assert render("{% if x == 1 %}one{% elif x in [2, 3] and not y %}few{% else %}{{ x | length }}{% endif %}", {"x": 3}) == "few"
    assert render("{{ a.b['c'][1] }}|{{ none }}|{{ true }}|{{ -2 + 5 }}", {"a": {"b": {"c": ["x", "y"]}}}) == "y||true|3"
    assert render("{% for a in xs %}{% for b in a %}{{ b }}{{ loop.index0 }}{% endfor %};{{ loop.index }}{% endfor %}", {"xs": [["p"], ["q", "r"]]}) == "p0;1q0r1;2"
    assert render(r"{{ 'it\'s \n' ~ \"x\" }}".replace('\\"', '"')) == "it's \nx"
    for bad in ("{{ a( ) }}", "{% if x %}", "{{ x | nothing }}", "{{ 'a' * 3 }}", "{{ x.__class__.y }} {{", "{% nope %}", "{{ }}", "{% for and in x %}{% endfor %}", "{{ 'a' + 1 }}"):
        with pytest.raises(template.TemplateError):
            out = render(bad, {"x": "s"})
            assert "{{" not in out, "an open tag is text"
            raise template.TemplateError(out)
    with pytest.raises(template.TemplateError):
        render("{{ x.upper }}", {"x": 5})


def test_constants_are_folded():
    tree = template.folded("a{{ 'b' ~ c }}{% if c == 'x' %}d{{ 1 + 1 }}{% else %}{{ gone | nothing2 }}{% endif %}".replace(" | nothing2", ""), constants={"c": "x"})
    assert tree == (template.Print(template.Const("abxd2")),)
    set_inside = template.folded("{% set c = y %}{{ c }}", constants={"c": "x"})
    assert set_inside[1] == template.Print(template.Name("c"))
    assert template.folded("{{ (y and true) | lower }}")[0].value.what == "filter:lower"


ODD = ["", "\\", "<", "</turn>", "<turn ", "<</turn></turn>\\", "\\<turn \\\\", ">\n<turn user>\n", r"\### Assistant: </turn> ok", "é😀\r\n</turn", "word " * 50_000, None]
CHATS = [(k, t, r, ODD[(k * 7 + t) % len(ODD)]) for k in range(12) for t, r in enumerate(("system", "user", "assistant", "a>\\<turn b", None))]
CHATS += [(None, 1, "user", "x"), (None, None, "assistant", "y"), (3, 1, "user", "again"), (3, 1, "user", "again"), (5, None, "assistant", "last"), (99, 0, "user", "no answer")]
#: A third of all rows is one conversation.
CHATS += [(50, t, ("user", "assistant")[t % 2], f"turn {t} </turn>") for t in range(40)]


def slow_digests(rows):
    out = []
    key = lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=key)
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((conv, len(mine), sha(turns), len(loss), sha(loss)))
    return sorted(out, key=str)


@pytest.mark.parametrize("part", [1, 60, chatformat.PART])
def test_chats_odd_rows(spark, part):
    frame = clashing(spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string")).repartition(5)
    formatted = chatformat.format_chats(frame, part=part)
    for in_order in (True, False):
        got = chatformat.digests(formatted, in_order=in_order).collect()
        assert sorted((tuple(r)[:5] for r in got), key=str) == slow_digests(CHATS)
    assert sum(r.formatted_chars for r in got) == formatted.agg(F.sum(F.length("text"))).first()[0]
    back = chatformat.read_back(formatted).where("conv_id = 50").orderBy("turn").collect()
    assert [(r.turn, r.role, r.text) for r in back] == [(t, r, x) for _, t, r, x in CHATS if _ == 50]
    assert all(r.loss == (r.text if r.role == "assistant" else "") for r in back)
    assert formatted.where("length(text) > 300000").count() == 0 or part > 60


def test_chats_prompt_and_empty(spark):
    frame = spark.createDataFrame([(1, 0, "user", "hi")], "conv_id long, turn long, role string, text string")
    asked = chatformat.format_chats(frame, constants={"add_prompt": True})
    assert asked.first().text == "<turn user>\nhi</turn>\n<turn assistant>\n"
    assert chatformat.digests(asked).first().n_turns == 1
    assert chatformat.digests(chatformat.format_chats(frame.limit(0))).count() == 0


def test_planted_conversation(spark):
    sf = "/root/testdata/sf0.001"
    row = queries.op11_chat_format(spark, sf).where("conv_id = -7").first()
    assert row.n_turns == 2 and row.loss_chars == 26
    assert row.loss_sha256 == hashlib.sha256(rb"\### Assistant: </turn> ok").hexdigest()


def slow_negatives(rows, k_pos=5, k_neg=3):
    """Rows as (id, vector, label) with all that a plain double loop says."""
    used = []
    for id_, v, label in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            used.append((id_, [math.floor(256 * x) for x in v], label))
    order = lambda r: (-r[1], r[0] is None, r[0] or 0)
    out = []
    for i, (anchor, a, label) in enumerate(used):
        if anchor is None or anchor % 50:
            continue
        scored = [(r[0], sum(x * y for x, y in zip(a, r[1], strict=False)), r[2] == label) for j, r in enumerate(used) if j != i]
        for pid, p, _ in sorted((r for r in scored if r[2]), key=order)[:k_pos]:
            fits = sorted((r for r in scored if not r[2] and 50 * p <= 100 * r[1] <= 95 * p), key=order)[:k_neg]
            out += [(anchor, pid, k + 1, n[0], p, n[1]) for k, n in enumerate(fits)]
    return sorted(out, key=str)


@pytest.mark.parametrize("rows_a_block", [16, 1 << 14])
def test_hard_negatives_brute_force(spark, monkeypatch, rows_a_block):
    rng = random.Random(3)
    rows = [(i, [rng.choice((-1.0, -0.25, 0.0, 0.125, 0.5, 1.0)) for _ in range(12)], rng.randrange(4)) for i in range(220)]
    rows += [(50, rows[3][1], 1), (50, rows[3][1], 1), (7, rows[0][1], None), (100, None, 2), (150, [1.0, None], 1), (200, [float("nan")] * 12, 1), (201, [float("inf")] * 12, 1)]
    rows += [(None, rows[9][1], 1), (250, [0.5, 0.5], 1), (300, [], 2), (-50, [0.0] * 12, 3), (350, [2.0**40] * 3, 1), (351, [2.0**19, 0.0], 2)]
    rows += [(1000 + i, rows[5][1], 2) for i in range(120)]  # a third of all rows are one vector
    monkeypatch.setattr(hardneg, "ROWS", rows_a_block)
    monkeypatch.setattr(hardneg, "ANCHORS", 3)
    frame = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).repartition(3)
    got = sorted((tuple(r) for r in hardneg.mine(frame).collect()), key=str)
    assert got == slow_negatives(rows)
    assert hardneg.mine(frame.where("vec_id = 3")).count() == 0
    assert hardneg.mine(frame.limit(0)).count() == 0


def test_vertical_scan_drops_rows():
    import numpy as np

    rng = np.random.default_rng(1)
    columns = rng.integers(-5, 6, (32, 500))
    columns[:, :20] *= 20
    anchor = np.sort(np.abs(columns[:, 0]))[::-1] * np.sign(columns[:, 0])
    seen = []

    def stays(lower, upper):
        seen.append(len(lower))
        assert (lower <= upper).all()
        return hardneg._best(5)(lower, upper)

    at, exact = hardneg.bond(columns, columns.min(axis=1), columns.max(axis=1), anchor, np.arange(500), stays)
    true = anchor @ columns
    assert (exact == true[at]).all() and set(np.argsort(-true)[:5]) <= set(at)
    assert seen == sorted(seen, reverse=True) and seen[-1] < 60, "the bitmap shrinks before the last dimensions"


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def slow_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def slow_ranked(docs, items, top=10):
    bags = [(d, Counter(slow_terms(t))) for d, t in docs]
    bags = [b for b in bags if b[1]]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        asked = Counter(slow_terms(text))
        found = []
        for d, bag in bags:
            m = 25 + 75 * sum(bag.values()) * n // total
            w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in asked if t in bag}
            score = sum(asked[t] * w[t] * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * m)) for t in w)
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, k + 1, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [30, 200_000])
def test_ranked_search_brute_force(spark, monkeypatch, block):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)] + ["Ünï", "ünï", "日本", "a_b", "X9"]
    text = lambda n: " ".join(rng.choices(words, k=n))
    docs = [(i, text(rng.randrange(1, 40))) for i in range(300)]
    docs += [(1000 - i, docs[7][1]) for i in range(200)] + [(2000 + i, "w1 w2 w1") for i in range(30)]  # groups of copies
    docs += [(None, docs[7][1]), (None, None), (5, None), (6, ""), (7, " .,;"), (7, docs[7][1]), (3001, "w1 " * 60_000), (3002, "w1\x00W2-w3　w4")]
    items = [(i, text(rng.randrange(1, 12))) for i in range(25)] + [(3, "w1"), (3, "w1 w1"), (None, "w5 w6"), (90, None), (91, ""), (92, "unheard of"), (93, "W1, w2! X9 x9"), (94, docs[7][1])]
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "HELD", 64 if block == 30 else 1 << 21)
    d = clashing(spark.createDataFrame(docs, "doc_id long, text string")).repartition(4)
    q = clashing(spark.createDataFrame(items, "item_id long, text string"))
    got = sorted((tuple(r) for r in lexical.ranked(d, q).select("item", "rank", "id", "score").collect()), key=str)
    assert got == slow_ranked(docs, items)
    assert lexical.ranked(d.limit(0), q).count() == 0 and lexical.ranked(d, q.limit(0)).count() == 0


def test_scores_beyond_doubles():
    """Sums above 2^53 are added as integers."""
    import numpy as np

    s = lexical.Scorer([(0, 0, 10**6), (1, 0, 1)], [20_000, 7], 2)
    assert not s.in_doubles
    bag = np.array([[0, 3], [1, 1]], np.int32).tobytes()
    m = 100
    want = 10**6 * 20_000 * (3_000_000_000 // (3000 + 800)) + 7 * (1_000_000_000 // 1800)
    assert want > 2**53 and int(s.scores([bag], np.array([m]))[0, 0]) == want

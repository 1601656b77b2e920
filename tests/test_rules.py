"""Small fixtures, one for each branch of a rule."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from grainmill.functions import stats as S
from grainmill.functions import text as T
from grainmill.operators import cleaning as C
from grainmill.operators import contamination as R
from grainmill.operators import decoding as D
from grainmill.operators import evaluation as E
from grainmill.operators import grids as G
from grainmill.operators import judging as J
from grainmill.operators import layout as Y
from grainmill.operators import packing as P
from grainmill.plans.registry import ORACLES, QUERIES


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("r")).first()[0]


def test_published_numbers(spark):
    low, high = S.wilson(F.lit(141), F.lit(560))
    assert round(one(spark, S.rate(F.lit(141), F.lit(560))), 6) == 0.251786
    assert one(spark, low) < 0.251786 < one(spark, high)
    chi = one(spark, S.mcnemar(F.lit(19), F.lit(2)))
    assert round(chi, 4) == 12.1905
    assert math.isclose(one(spark, S.chi2_p(F.lit(chi))), 4.8e-4, rel_tol=0.01)
    assert one(spark, S.mcnemar(F.lit(0), F.lit(0))) is None
    assert one(spark, S.rate(F.lit(0), F.lit(0))) is None and one(spark, S.rate0(F.lit(0), F.lit(0))) == 0.0
    assert one(spark, T.sample_seed(F.lit("A"), F.lit("astro"), F.lit("astro_000"), F.lit(3))) == 1026929643


def test_sentences(spark):
    spans = one(spark, R.sentence_spans(F.col("t")), t="Pi is 3.14 today. X\n\nNo end\nWhat?! Él 😀 va.")
    assert [s["text"] for s in spans] == ["14 today.", " X", "No end", "What?!", " Él 😀 va."]
    found = R.Finder(("b",), ()).find("a.b c\n\nlast b")
    assert found == [(2, 5, "b c", ["b"], ["exact"]), (7, 13, "last b", ["b"], ["exact"])]
    assert R.Finder(("a",), ()).find("x\na.b c\n") == [(2, 7, "a.b c", ["a"], ["exact"])]


@pytest.mark.parametrize(
    "text, label, action",
    [
        ("The earth shook.", "FIGURATIVE", "KEEP"),
        ("An epicycle carries it.", "FALSE_POSITIVE", "KEEP"),
        ("Kepler wrote a song.", "HISTORICAL", "REMOVE"),
        ("The earth orbits the sun.", "DEFINITE", "REMOVE"),
        ("The earth moves.", "BORDERLINE", "REVIEW"),
        ("Plain words.", "FALSE_POSITIVE", "KEEP"),
    ],
)
def test_sentence_rules(spark, text, label, action):
    r = one(spark, R.classify(F.col("t")), t=text)
    assert (r["label"], r["action"]) == (label, action)


def test_findings_and_decisions(spark):
    docs = spark.createDataFrame([(1, "Kepler saw it. The earth moves.\nAll is well."), (2, "nothing"), (3, None)], "i int, t string")
    found = R.findings(docs, "i", "t").orderBy("start").collect()
    assert [(r.i, r.sentence_text, r.action) for r in found] == [(1, "Kepler saw it.", "REMOVE"), (1, "The earth moves.", "REVIEW")]
    assert found[1].triggers == ["earth [0-5 words] moves", "earth moves"] and found[1].sources == ["exact", "proximity"]
    rows = [(0, 0, 0), (1, 1, 0), (5, 3, 0), (5, 4, 1), (5, 5, 0), (3, 0, 1)]
    c = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, total_matched_sentences int, removable_sentences int, review_sentences int")
    out = R.triage(R.decide(c)).orderBy("i").collect()
    assert [r.decision for r in out] == ["KEEP", "REMOVE_SENTENCE", "REMOVE_FILE", "REMOVE_FILE", "REMOVE_FILE", "KEEP"]
    assert [r.triage_bucket for r in out] == ["KEEP", "SINGLE_SENTENCE", "AUTO_REMOVE", "MANUAL_REVIEW", "AUTO_REMOVE", "MANUAL_REVIEW"]


def test_span_removal(spark):
    docs = spark.createDataFrame([(1, "abcdefghij"), (2, "same  \n\n\n\n")], "i int, t string")
    spans = spark.createDataFrame([(1, 0, 2), (1, 2, 4), (1, 3, 5), (1, 8, 9)], "i int, start int, stop int")
    assert {r.i: r.t for r in R.remove_spans(docs, spans, "i", "t").collect()} == {1: "fghj\n", 2: "same  \n\n\n\n"}
    s = spark.createDataFrame([(1, "cd"), (1, "bcde"), (1, "zz")], "i int, sentence string")
    r = {x.i: x for x in R.remove_sentences(docs, s, "i", "t").collect()}
    assert (r[1].t, r[1].sentences_found, r[1].sentences_missing, r[2].t) == ("afghij", 1, 2, "same  \n\n\n\n")


def test_markers(spark):
    start, end = "*** START OF THE PROJECT GUTENBERG EBOOK ***", "*** END OF THIS PROJECT GUTENBERG EBOOK ***"
    for lines, want in (([start, "a", end, "b"], (["a"], 1, 2)), (["x", "a"], (["x", "a"], 0, 0)), ([end, start, "a"], (["a"], 2, 0)), (["a", end], (["a"], 0, 1)), ([start], ([], 1, 0))):
        r = one(spark, C.strip_markers(F.col("l")), l=lines)
        assert (r["lines"], r["head"], r["foot"]) == want
    assert one(spark, C.strip_boilerplate(F.col("t")), t="x *** start y\nbody\n*** END z") == "body"
    assert one(spark, C.core_text(F.col("t")), t=f"h\r\n{start}\r\nbody\r\n{end}\r\nz") == "body"
    text = "A TITLE\n\nshort. one\n\n" + "Real prose here. " * 15 + "\n\nrest"
    assert one(spark, C.drop_front_matter(F.col("t")), t=text).startswith("Real prose")
    assert one(spark, C.drop_front_matter(F.col("t")), t="NO\n\nprose") == "NO\n\nprose"


def test_leading_metadata(spark):
    for lines, want in ((["Title: x", "words"], 0), (["Title: x", "", "Author: y", "goes on", "Ends here."], 4), (["x" * 41, "Title: x", "Author: y"], 0), (["", "Title: x", "www.a.b", "", "z" * 130], 4)):
        assert one(spark, C.leading_metadata(F.col("l")), l=lines) == want


def test_toc(spark):
    prose = "a word " * 12

    def strip(*lines):
        r = C.strip_toc(spark.createDataFrame([(list(lines),)], "l array<string>"), "l").first()
        return r.l, r.toc_removed

    assert strip("Contents", "Chapter I. A", "Preface", "", "p" * 61 + ".") == (["p" * 61 + "."], 4)
    assert strip("Contents", "Chapter I. A", "x" * 65) == (["Contents", "Chapter I. A", "x" * 65], 0)
    assert strip("Index", "a 1", "b 2", prose, prose, "z") == ([prose, prose, "z"], 3)
    assert strip() == ([], 0) and strip("no header", "a 1") == (["no header", "a 1"], 0)
    # two blocks, and a header inside one
    assert strip("x" * 65, "Contents", "a 1", "Index", "y" * 65, "Index:", "b 1", "c 2", "y" * 65) == (["x" * 65, "y" * 65, "y" * 65], 6)
    # the block ends with its limit
    assert strip("Contents", *[f"{i} x {i}" for i in range(305)]) == ([f"{i} x {i}" for i in range(300, 305)], 301)


def test_whitespace_and_annotations(spark):
    for text, want, n in (("a \r\nb\t\n\n\n\nc", "a\nb\n\nc\n", 1), (" \n\n", "", 0), ("a\n\n\nb\n\n\n\n\nc", "a\n\nb\n\nc\n", 2)):
        r = one(spark, C.clean_whitespace(F.col("t")), t=text)
        assert (r["text"], r["n"]) == (want, n)
    r = one(spark, C.inline_annotations(F.col("t")), t="a[12] b[Note: x] c(see figure 2) d[1234]")
    assert (r["text"], r["n"]) == ("a b c d[1234]", 3)
    assert one(spark, C.fix_spacing(F.col("t")), t="oneTwo.three,four?five  six") == "one Two. three, four? five six"


def test_full_clean(spark):
    text = "*** START OF THE PROJECT GUTENBERG EBOOK ***\nTitle: x\nAuthor: y\nContents\nChapter I. A\nChapter II. B\n" + "long prose line with many more words than ten in it so that it counts as prose.\n" * 2 + "CHAPTER I\nend[3]\n*** END OF THE PROJECT GUTENBERG\n"
    r = C.clean(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert r.t.endswith("prose.\nend\n") and r.t.startswith("long prose")
    assert (r.metadata_lines_removed, r.gutenberg_footer_lines_removed, r.structural_lines_removed, r.inline_annotations_removed) == (6, 2, 1, 1) or r.toc_lines_removed == 3
    assert r.chars_before == len(text) and r.chars_after == len(r.t)


def test_answers(spark):
    cases = {'{"a": 1}': '{"a":1}', "```json\n{\"a\": 2}\n```": '{"a":2}', 'Sure {"a": "}"} ok': '{"a":"}"}', "[1]": None, "x": None, '{"a"': None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", F.to_json(J.parse_answer(F.col("t"))).alias("r")).collect()
    assert {r.t: r.r for r in rows} == cases


def test_validation(spark):
    full = '{"quality_score": "2", "earth_motion_mention": "yes", "explicit_earth_motion_label": 1, "proto_heliocentric_label": "none", "stance": "heliocentric", "refined_stance": "ambiguous", "off_topic_or_drift": false, "repetition_or_looping": 0, "premodern_register": " Weak ", "refined_proto_heliocentric_label": true, "earth_motion_context": "none", "hybrid_or_contradictory_frame": true, "modern_explanatory_frame": "no", "premodern_explanatory_frame": 1, "rationale": " why "}'
    rows = spark.createDataFrame([(1, full), (2, '{"stance": "x"}'), (3, full.replace("ambiguous", "odd"))], "i int, t string").withColumn("raw", F.try_parse_json("t")).withColumn("r", J.coerce_result(F.col("raw")))
    out = {r.i: r for r in rows.select("i", "r", J.validation_errors(rows).alias("e")).collect()}
    assert out[1].e == [] and out[2].e[0].startswith("Missing fields: earth_motion_context") and out[3].e == ["Invalid refined_stance"]
    c = J.consistent_2(rows.where("i = 1").select("r.*")).first()
    assert (c.stance, c.proto_heliocentric_label, c.refined_stance, c.earth_motion_context, c.earth_motion_mention, c.reason) == ("heliocentric_or_earth_moves", "strong", "hybrid_or_contradictory", "ambiguous_or_mixed", True, "why")


def test_judge_loop(spark):
    df = spark.createDataFrame([(1, "ok"), (2, "again"), (3, "bad")], "i int, request string")

    def fn(r):
        if r == "again":
            raise TimeoutError("slow")
        if r == "bad":
            raise ValueError("no")
        return "{}"

    out = {r.i: (r.answer, r.judge_error) for r in J.judge(df, fn, attempts=2).collect()}
    assert out == {1: ("{}", None), 2: (None, "TimeoutError: slow"), 3: (None, "ValueError: no")}
    g = J.generate(df, lambda row: 1 / 0 if row["i"] == 2 else "t").orderBy("i").collect()
    assert [r.output_text for r in g] == ["t", None, "t"] and "ZeroDivisionError" in g[1].generation_error


def test_keys_and_flatten(spark):
    df = spark.createDataFrame([(None, "", None, 1, (2, None))], "model_name string, prompt_category string, adapter_dir string, sample_id int, judge_result struct<quality_score:int,stance:string>")
    r = J.keys(df).first()
    assert (r.model_name, r.prompt_category, r.adapter_dir, r.sample_id) == ("UNKNOWN_MODEL", "UNKNOWN_CATEGORY", "BASE", "1")
    assert J.flatten(df.withColumn("stance", F.lit("x")), "judge_result", ["quality_score", "stance", "reason"]).select("quality_score", "stance", "reason").first() == (2, "x", None)


def test_permutation(spark):
    d = spark.createDataFrame([("s", "m", 1, 0), ("s", "m", 2, 0), ("o", "m", 1, 1), ("o", "m", 2, 3), ("o", "m", 3, 5)], "scope string, metric string, k int, x int")
    r = {x.scope: x for x in E.permutation_test(d, "scope", "metric", ["k"], "x", 200).collect()}
    assert r["s"].p_value == 1.0 and r["o"].n_pairs == 3 and 0.1 < r["o"].p_value < 0.45
    c = {x.scope: x for x in E.permutation_test_compat(d.withColumn("x", F.col("x").cast("double")), "scope", "metric", ["k"], "x", 200).collect()}
    assert c["s"].p_value == 1.0 and 0.1 < c["o"].p_value < 0.45
    assert E.choose_pair(d, "scope")[0] == ("o", "s")


def test_grids(spark):
    t = spark.createDataFrame([("m", None, 1), ("m", "a", 1)], "m string, adapter_dir string, k int")
    assert G.not_done(t, t.where("adapter_dir is null"), ["m", "adapter_dir", "k"]).count() == 1
    assert G.identity(t, ["m", "zz"]).first().identity == '{"m":"m"}'


def test_packing(spark):
    d = spark.createDataFrame([(0, [1, 2, 3]), (1, []), (2, [4, 5, 6, 7])], "i int, ids array<int>").withColumn("n_tokens", F.size("ids").cast("bigint"))
    at = P.offsets(d, ["i"])
    assert sorted(r.ids for r in P.pack(at, 3).collect()) == [[1, 2, 3], [4, 5, 6]]
    assert sorted(r.ids for r in P.pack(at, 5, pad=0).collect()) == [[1, 2, 3, 4, 5], [6, 7, 0, 0, 0]]
    splits = {n: P.split_tokens(spark.createDataFrame([(list(range(n)),)], "ids array<int>")).select(F.size("train_ids"), F.size("val_ids")).first() for n in (0, 1, 2, 10, 11)}
    assert {n: tuple(v) for n, v in splits.items()} == {0: (0, 0), 1: (1, 0), 2: (1, 1), 10: (9, 1), 11: (9, 2)}
    with pytest.raises(ValueError):
        P.check_sizes(5, 3, 4)


def test_vocabulary(spark):
    docs = spark.createDataFrame([("low lower lowest low",), ("newer wider é",)], "t string")
    vocab, merges = P.train_vocabulary(docs, "t", size=270)
    assert len(set(vocab.values())) == len(vocab) <= 270 and [vocab[x] for x in ("<doc>", "<pad>", "<bos>", "<eos>", "!")] == [0, 1, 2, 3, 4]
    ids = P.encode(docs, "t", vocab, merges).orderBy("t").first().ids
    names = {i: p for p, i in vocab.items()}
    assert "".join(names[i] for i in ids[1:]).encode("latin-1").decode() == " low lower lowest low"


def test_decoding(spark):
    assert one(spark, D.banned_tokens(F.col("t"), 3), t=[1, 2, 3, 1, 2, 4, 1, 2]) == [3, 4]
    assert one(spark, D.banned_tokens(F.col("t"), 1), t=[2, 1, 2]) == [1, 2]
    assert one(spark, D.banned_tokens(F.col("t"), 4), t=[1]) == []
    assert one(spark, D.repeats_last(F.col("t"), 2), t=[1, 2, 3, 1, 2]) is True
    p = spark.createDataFrame([(0, 0, 0.6), (0, 1, 0.3), (0, 2, 0.1)], "s int, token int, prob double")
    assert [r.token for r in D.nucleus(p, "s", 0.5).collect()] == [0]


def test_layout(spark):
    g = [(1, 100.0, 10.0, 0.0, 5.0, 10.0, "a"), (1, 100.0, 11.5, 9.0, 14.0, 10.0, "b"), (1, 100.0, 12.5, 0.0, 5.0, 10.0, "c"), (1, 100.0, 10.0, 60.0, 65.0, 10.0, "d"), (1, 100.0, 10.0, 66.0, 70.0, 10.0, "e"), (1, 100.0, 10.0, 0.0, 5.0, 8.0, "small")]
    lines = Y.glyph_lines(spark.createDataFrame(g, "page int, page_width double, top double, x0 double, x1 double, size double, text string"))
    assert sorted((r.col, r.line, r.text) for r in lines.collect()) == [(0, 0, "a b"), (0, 1, "c"), (1, 0, "de")]
    t = spark.createDataFrame([(x,) for x in ("Book IV", "12", "40 to 3 - 4", "(open", "text stays")], "t string")
    assert [r.t for r in t.where(~Y.skip_line(F.col("t"))).collect()] == ["text stays"]
    f = spark.createDataFrame([("12 / x",), ("Figure 2",), ("H72 words",), ("B",), ("77",)], "t string")
    assert [r.t for r in Y.filter_lines(f, "t", **Y.FULL).collect()] == ["words"]


def test_phrase_flags(spark):
    assert one(spark, T.phrase_flags(F.col("t"), ("some say", "it seems")), t=" Some\n SAY so ") == [True, False]
    assert one(spark, T.run_name(F.col("t")), t=" my run! ") == "my-run" and isinstance(pd.__version__, str)


def test_bundle(spark):
    docs = spark.createDataFrame([(i, "some words to learn from here " * 3) for i in range(6)], "i int, t string")
    vocab, merges = P.train_vocabulary(docs, "t", size=280)
    full = sum(r.n for r in P.encode(docs, "t", vocab, merges).select(F.size("ids").alias("n")).collect())
    b = P.dataset_bundle(docs, "i", "t", vocab, merges, length=4)
    n = {k: sum(len(r.ids) for r in v.collect()) for k, v in b.items()}
    assert n["train"] + n["val"] <= full < n["train"] + n["val"] + 8 and n["val"] > 0
    with pytest.raises(ValueError):
        P.check_specials({"<pad>": 0})


def test_seeded_permutation():
    names = [f"{i}.txt" for i in range(20)]
    places = P.seeded_permutation(names, 7)
    assert sorted(places.values()) == list(range(20)) and places == P.seeded_permutation(names[::-1], 7) != P.seeded_permutation(names, 8)


def test_cleaning_report_cleans_once(spark, tmp_path):
    """Rows, their order and totals come from one pass over the texts."""
    from grainmill.sources import sinks

    passes = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(t):
        passes.add(1)
        return t

    docs = spark.createDataFrame([(f"{i}.txt", f"text {i}\n\n\n\nb") for i in range(7)], "relative_path string, text string")
    cleaned = C.clean(docs.coalesce(1), "text").withColumn("relative_path", seen("relative_path"))
    totals = sinks.cleaning_report(cleaned, f"{tmp_path}/r")
    assert passes.value == 7 and totals["files"] == 7 and totals["blank_line_reductions"] == 7
    assert spark.read.option("header", True).csv(f"{tmp_path}/r/rows_csv").count() == spark.read.json(f"{tmp_path}/r/rows").count() == 7


def test_bundle_moves_ids_once(spark, monkeypatch):
    """Blocks in shuffled order over many ranges; ids are written once and not sorted."""
    monkeypatch.setattr(P, "RANGE", 7)
    monkeypatch.setattr(P, "WORDS", 11)
    tables, written = [], P.written
    monkeypatch.setattr(P, "written", lambda df: tables.append(df.columns) or written(df))
    texts = {i: f"document {i} " + "x" * (i * 7 % 40) for i in range(50)} | {50: "", 51: None}
    docs = spark.createDataFrame([*texts.items()], "i int, t string").repartition(5)
    vocab = {s: i for i, s in enumerate([*P.SPECIALS, *map(chr, range(256))])}
    blocks = P.dataset_bundle(docs, "i", "t", vocab, [], length=16)
    order = [r.i for r in P.shuffled_positions(docs, F.col("i")).orderBy("shuffle_key").collect()]
    full = {r.i: r.ids for r in P.encode(docs, "t", vocab, []).collect()}
    for part, keep in (("train", lambda x: x[: _cut_at(len(x))]), ("val", lambda x: x[_cut_at(len(x)) :])):
        stream = [t for i in order for t in keep(full[i])]
        got = [r.ids for r in blocks[part].orderBy("block_id").collect()]
        assert got == [stream[k : k + 16] for k in range(0, len(stream) - 15, 16)]
    assert sum(any("ids" in c for c in columns) for columns in tables) == 1


def _cut_at(n):
    return n if n <= 1 else min(max(int(0.9 * n), 1), n - 1)


def test_sentences_in_pieces(spark):
    """A task turns a bounded number of bytes into strings at once, in order and with null texts."""
    import pyarrow as pa

    texts = ["a. b." * 100, None, "é! x", "", "z" * (3 * R.CHARS)] * 50
    pieces = list(R._pieces(iter([pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["i", "t"])])))
    assert [t for _, p in pieces for t in p] == texts and [i for p, _ in pieces for i in p.to_pylist()] == [*range(len(texts))]
    assert max(sum(len(t or "") for t in p) for _, p in pieces) <= 4 * R.CHARS
    got = R.sentences(spark.createDataFrame([*enumerate(texts[:4])], "i int, t string"), "i", "t").collect()
    assert [tuple(r) for r in got if r.i == 2] == [(2, 0, 2, "é!"), (2, 2, 4, " x")] and {r.i for r in got} == {0, 2}


def test_permutations_of_uneven_differences(spark):
    """Whole differences and others, against the generator's own draws, in a time that plain loops don't keep."""
    import random
    import time
    from functools import reduce

    values = {"whole": [float(i % 5 - 2) for i in range(50)], "other": [i % 7 * 0.1 - 0.25 for i in range(50)], "many": [float(i % 3 - 1) for i in range(20_000)]}
    frame = spark.createDataFrame([(k, "m", i, x) for k, v in values.items() for i, x in enumerate(v)], "scope string, metric string, i int, x double")
    begin = time.perf_counter()
    got = {r.scope: r for r in E.permutation_test_compat(frame, "scope", "metric", ["i"], "x", 700).collect()}
    assert time.perf_counter() - begin < 60
    for scope in ("whole", "other"):
        draw, v = random.Random(12345).random, values[scope]
        sums = [reduce(lambda a, b: a + b, [x if draw() < 0.5 else -x for x in v], 0.0) / len(v) for _ in range(700)]
        assert got[scope].p_value == sum(abs(x) >= abs(got[scope].mean_diff) for x in sums) / 700
    assert got["many"].n_pairs == 20_000


def test_documents_with_markers_of_their_own(spark, tmp_path):
    """strip_markers gives a document back whole, as its SQL does, if the document says what ends a text."""
    import duckdb

    texts = ["one*** enden two\n", "***", "a\n*** END OF THE PROJECT GUTENBERG EBOOK ***\nb", "x **** START y\n *****End", f"{T.SENTINEL}a {T.SENTINEL}s*** end{T.SENTINEL}"]
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    expected = con.sql(ORACLES["strip_markers"]).fetchall()
    assert sorted(map(tuple, QUERIES["strip_markers"](spark, str(tmp_path)).collect())) == sorted(expected)

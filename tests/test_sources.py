import json

import pytest
from pyspark.sql import functions as F

from grainmill.operators import selection as SEL
from grainmill.sources import corpus as C
from grainmill.sources import jsonl as J
from grainmill.sources import rdf as R
from grainmill.sources import sinks as K
from grainmill.streaming import incremental as I

RDF = """<?xml version="1.0"?><rdf:RDF xmlns:rdf="r" xmlns:dcterms="d" xmlns:pgterms="p">
<pgterms:ebook rdf:about="ebooks/0012"><dcterms:title> A Book </dcterms:title>
<dcterms:language><rdf:Description><rdf:value>EN</rdf:value></rdf:Description></dcterms:language>
<dcterms:subject><rdf:Description><rdf:value>{subject}</rdf:value></rdf:Description></dcterms:subject>
<dcterms:creator><pgterms:agent rdf:about="agents/1"><pgterms:name>X</pgterms:name><pgterms:deathdate>-322</pgterms:deathdate></pgterms:agent></dcterms:creator>
<dcterms:hasFormat><pgterms:file rdf:about="u1"><dcterms:format><rdf:Description><rdf:value>text/plain</rdf:value></rdf:Description></dcterms:format><dcterms:extent>9</dcterms:extent></pgterms:file></dcterms:hasFormat>
<dcterms:hasFormat rdf:resource="u2"/>
</pgterms:ebook>
<pgterms:file rdf:about="u2"><dcterms:format><rdf:Description><rdf:value>text/plain; charset=UTF_8</rdf:value></rdf:Description></dcterms:format><dcterms:extent>1,234</dcterms:extent></pgterms:file>
</rdf:RDF>"""


def test_text_files(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir(), b.mkdir()
    (a / "2.txt").write_bytes(b"x\xffy\r\nz")
    (a / "1.txt").write_text("  \n")
    (b / "0.txt").write_text("last")
    (a / "n.md").write_text("no")
    rows = C.documents(spark, [str(b), str(a)]).orderBy("doc_pos").collect()
    assert [(r.name, r.text) for r in rows] == [("0.txt", "last"), ("2.txt", "xy\nz")]
    with pytest.raises(Exception):
        C.documents(spark, [str(tmp_path / "none")]).count()
    raw = spark.createDataFrame([(b"caf\xe9", "x-none"), ("é".encode(), ""), (b"\xe9", "latin-1")], "c binary, s string")
    assert [r[0] for r in raw.select(C.decode_any(F.col("c"), F.col("s"))).collect()] == ["café", "é", "é"]
    assert len(C.path_glob(spark, f"{a}/*.txt")) == 2


def test_rdf(spark, tmp_path):
    (tmp_path / "12.RDF").write_text(RDF.format(subject="History"))
    (tmp_path / "13.rdf").write_text(RDF.format(subject="Absorbed in orbs").replace("0012", "13"))
    (tmp_path / "bad.rdf").write_text("<rdf:RDF")
    books = {r.book_id: r for r in R.books(spark, str(tmp_path)).collect()}
    b = books["12"]
    assert (b.title, b.languages, b.subjects, b.death_year) == ("A Book", ["en"], ["History"], -322)
    assert sorted((f.url, f.extent) for f in b.formats) == [("u1", 9), ("u2", 1234)]
    c = R.candidates(R.books(spark, str(tmp_path))).collect()
    assert [(r.book_id, r.url, r.charset, r.extent) for r in c] == [("12", "u2", "utf-8", 1234)]
    assert R.candidates(R.books(spark, str(tmp_path)), filters=False).count() == 2


def test_csv_and_lists(spark, tmp_path):
    (tmp_path / "a.csv").write_text('book_id,death_year,extent\n"007",-322,"1,000"\n7,1500,5\nx,1,1\n8,,2\n')
    d = C.csv_rows(spark, [str(tmp_path / "a.csv")], ["book_id"]).withColumn("line_no", F.monotonically_increasing_id())
    assert [(r.book_id, r.death_year, r.extent) for r in C.qualifying_books(d).collect()] == [("7", 1500, 5)]
    assert [(r.id, r.pos) for r in C.priority_ids(d.select("book_id", F.col("line_no"))).orderBy("pos").collect()] == [("7", 0), ("8", 3)]
    with pytest.raises(ValueError):
        C.csv_rows(spark, [str(tmp_path / "a.csv")], ["nope"])
    lines = spark.createDataFrame([("- remove A_1.TXT now b.txt",), ("none",)], "value string")
    assert [r.filename for r in C.decision_list(lines).collect()] == ["A_1.TXT"]
    (tmp_path / "p.txt").write_text("1. First\n\n 2. Second \nThird\n")
    p = C.prompts(spark, {"astro": str(tmp_path / "p.txt")}, 2).orderBy("prompt_idx").collect()
    assert [(r.prompt_id, r.prompt_text) for r in p] == [("astro_000", "First"), ("astro_001", "Second")]
    (tmp_path / "q.txt").write_text("q1\na1\n\nq2\na2\n\n")
    assert C.blocks(spark, str(tmp_path / "q.txt")).count() == 2
    t = C.load_or_build(spark, str(tmp_path / "cache"), lambda: spark.range(3))
    assert t.count() == 3 and C.load_or_build(spark, str(tmp_path / "cache"), lambda: 1 / 0).count() == 3


def test_config(spark):
    assert C.config('{"a": {"b": 1}}', ["a.b=2", "c.d=x"]) == {"a": {"b": 2}, "c": {"d": "x"}}
    assert C.model_registry(spark, '{"A": "p"}').collect() == [("A", "p")]
    with pytest.raises(ValueError):
        C.model_registry(spark, "[]")


def test_lines_keep_their_order(spark, tmp_path):
    (tmp_path / "x.txt").write_text("".join(f"line {i}\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        rows = C.numbered_lines(spark, str(tmp_path / "x.txt"))
        assert rows.rdd.getNumPartitions() > 3
        assert [r.value for r in rows.orderBy("path", "line_no").collect()] == [f"line {i}" for i in range(3000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_jsonl(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n[2]\n{bad\n')
    rows = J.lines(spark, [f"base={tmp_path / 'x.jsonl'}"])
    assert [(r.alias, r.is_object) for r in J.parsed(rows).orderBy("line_no").collect()] == [("base", True), ("base", False), ("base", False)]
    assert [r.raw_line for r in J.error_rows(rows, "m").orderBy("raw_line").collect()] == ["[2]", "{bad"]


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("a", 0.5, None)], "k string, r double, s string")
    K.csv(d, str(tmp_path / "c"), ["r", "k", "s"], single=True)
    text = next((tmp_path / "c").glob("part-*")).read_text()
    assert text == "r,k,s\n0.500000,a,\n" or text == 'r,k,s\n0.500000,a,""\n'
    assert "| a | 0.500000 |  |" in K.markdown(d, "T")
    with pytest.raises(ValueError):
        K.markdown(spark.range(5), "T", limit=3)
    assert json.loads(K.manifest({"b": 1})) == {"b": 1}
    assert K.token_stream(spark.range(2), str(tmp_path / "t"), "f") is True
    assert K.token_stream(spark.range(2), str(tmp_path / "t"), "f") is False
    assert K.token_stream(spark.range(3), str(tmp_path / "t"), "g", n=3) is True
    assert K.read_manifest(spark, str(tmp_path / "t/manifest")) == {"fingerprint": "g", "n": 3}
    with pytest.raises(ValueError):
        K.output_mode(spark, str(tmp_path / "t"), overwrite=True, resume=True)
    with pytest.raises(FileExistsError):
        K.output_mode(spark, str(tmp_path / "t"))
    assert K.output_mode(spark, str(tmp_path / "new")) == "overwrite" and K.output_mode(spark, str(tmp_path / "t"), resume=True) == "append"


def test_reports(spark, tmp_path):
    pairs = spark.createDataFrame([(2, ["b", "a"], ["1", "2"]), (1, ["c", "a"], ["3", "4"])], "i int, k array<string>, v array<string>")
    rows = pairs.select("i", F.map_from_arrays("k", "v").alias("m"))
    K.dynamic_csv(rows, "m", "i", str(tmp_path / "d"))
    assert next((tmp_path / "d").glob("part-*")).read_text().split("\n")[:3] == ["c,a,b", "3,4,", ",2,1"]
    K.dynamic_csv(rows.limit(0), "m", "i", str(tmp_path / "e"))
    assert "".join(p.read_text() for p in (tmp_path / "e").glob("part-*")).strip() == ""
    odd = spark.createDataFrame([(float("inf"),), (0.5,), (None,)], "x double")
    assert [r.x for r in K.fixed(odd, ["x"]).collect()] == ["Infinity", "0.500000", None]
    one, two = (K.run_folder(spark, str(tmp_path), "n", "t", {"a": 1}) for _ in range(2))
    assert two == one + "_2" and K.read_manifest(spark, f"{two}/config") == {"a": 1}
    K.samples(spark.createDataFrame([(2, "p", "x\ny"), (1, None, "z")], "step int, prompt string, generated_text string"), one)
    text = "".join(p.read_text() for p in sorted((tmp_path / "t_n" / "samples").glob("part-*")))
    assert text.startswith("step: 1\nprompt: \ngenerated:\nz\n=====") and "generated:\nx\ny\n====" in text
    assert K.report("R", [("A", "words"), ("B", rows.select("i").limit(0)), ("C", rows.select("i"))]).count("## ") == 3


def test_selection(spark):
    b = spark.createDataFrame([(i, s) for i, s in enumerate([5, 0, 5, 3])], "i int, n int")
    assert [r.i for r in SEL.byte_budget(b, "n", ["i"], 10).orderBy("i").collect()] == [0, 1, 2]
    assert [r.i for r in SEL.byte_budget(b, "n", ["i"], 11).orderBy("i").collect()] == [0, 1, 2, 3]
    assert [r.i for r in SEL.byte_budget(b, "n", ["i"], 100, most=2).orderBy("i").collect()] == [0, 1]
    assert SEL.byte_budget(b, "n", ["i"], 10, initial=10).count() == 0


def test_incremental(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "1.jsonl").write_text('{"m": "a", "k": 1}\n{"m": "a", "k": 1}\n{"k": 2}\n')
    args = (spark, str(src), "m string, k int", ["m", "k"], str(tmp_path / "out"), str(tmp_path / "ck"))
    I.append_new(*args).awaitTermination()
    (src / "2.jsonl").write_text('{"k": 2}\n{"m": "b", "k": 3}\n')
    I.append_new(*args).awaitTermination()
    assert sorted((r.m or "", r.k) for r in spark.read.schema("m string, k int").json(str(tmp_path / "out")).collect()) == [("", 2), ("a", 1), ("b", 3)]

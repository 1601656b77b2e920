"""Prefix scans, interval joins, phrase automata and flat streams against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from grainmill.operators import intervals, reports
from grainmill.operators.judging import balanced_object


def slow_report(lines, corpus):
    inside, pattern, out = False, None, []
    for number, line in lines:
        s = (line or "").strip()
        if s.startswith("CORPUS:"):
            inside, pattern = s[7:].strip() == corpus, None
        elif inside and s.startswith("Pattern:"):
            pattern = s[8:].strip().strip("'")
        elif inside and s.startswith("Regex:") and pattern is None:
            pattern = s[6:].strip()
        elif inside and (s.startswith("---") or s.startswith("Summary for")):
            pattern = None
        elif inside and (m := re.match(r"^\[(\d+)\s+matches\]\s+(.+)$", s)):
            out.append((number, m[2].strip(), int(m[1]), pattern))
    return out


@pytest.mark.parametrize("fan", [2, 7, 1024])
def test_report_scan(spark, monkeypatch, fan):
    """Cut anywhere, at several levels of groups, a report reads as line by line."""
    monkeypatch.setattr(reports, "FAN", fan)
    rng = random.Random(fan)
    kinds = ["CORPUS: general", "CORPUS: other", "Pattern: 'sun'", "Pattern:", "Regex: m.n", " Regex: x", "-----", "Summary for y", "[3 matches] a.txt", "[12  matches]  b c.txt", "text", None]
    files = {p: [(i, rng.choice(kinds if p else kinds[2:])) for i in range(n)] for p, n in enumerate((150, 400, 0, 1))}
    files[9] = [(i, "[1 matches] q" if i % 50 else ("CORPUS: general" if i == 0 else "Regex: r%d" % i)) for i in range(300)]
    rows = [(p, i, v) for p, ls in files.items() for i, v in ls]
    frame = spark.createDataFrame(rows, "path int, line_no int, value string").repartition(4)
    got = {p: [] for p in files}
    for r in reports.report_hits(frame, "general").orderBy("path", "line_no").collect():
        got[r.path].append((r.line_no, r.filename, r.n, r.pattern))
    assert got == {p: slow_report(ls, "general") for p, ls in files.items()}
    assert reports.report_hits(frame.limit(0), "general").count() == 0


def test_points_are_repeated_for_few_levels(spark):
    """Lengths of 1 to 64 are three levels, not seven."""
    p = spark.createDataFrame([(1, i) for i in range(200)], "k int, at int")
    s = spark.createDataFrame([(1, 3 * i, 3 * i + i % 64 + 1) for i in range(64)], "k int, start int, stop int")
    met = intervals.point_in_interval(p, s, "k", "at", "start", "stop")
    assert sorted(map(tuple, met.collect())) == sorted((1, i, 3 * j, 3 * j + j % 64 + 1) for i in range(200) for j in range(64) if 3 * j <= i < 3 * j + j % 64 + 1)
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "array(0, 3, 6)" in plan or "[0,3,6]" in plan


@pytest.mark.parametrize("hot", [3, 50_000])
def test_points_in_intervals(spark, hot):
    rng = random.Random(hot)
    spans = [(rng.choice("aab"), a := rng.randrange(-60, 60), a + rng.choice((0, 1, 1, 2, 5, 8, 40, 1000)), i) for i in range(150)]
    spans += [(None, 0, 5, 900), ("a", None, 5, 901), ("a", 5, None, 902), ("a", 5, 3, 903), ("b", -(2**40), 2**41, 904), spans[0]]
    points = [(rng.choice("aab"), rng.randrange(-70, 70), i) for i in range(200)] + [("a", 7, 500 + i) for i in range(100)]  # a hot place
    points += [(None, 1, 1), ("a", None, 2), ("b", 2**40, 3), ("c", 1, 4), points[0]]
    p = spark.createDataFrame(points, "k string, at long, point int")
    s = spark.createDataFrame(spans, "k string, start long, stop long, span int")
    met = intervals.point_in_interval(p, s, "k", "at", "start", "stop", hot=hot)
    want = sorted((x[2], y[3]) for x in points for y in spans if None not in (x[0], x[1], *y[:3]) and x[0] == y[0] and y[1] <= x[1] < y[2])
    assert sorted((r.point, r.span) for r in met.collect()) == want and len(want) > 500
    assert "NestedLoop" not in met._jdf.queryExecution().toString() and "CartesianProduct" not in met._jdf.queryExecution().toString()
    assert intervals.point_in_interval(p, s.limit(0), "k", "at", "start", "stop").count() == 0


def test_balanced_objects():
    rng = random.Random(4)

    def slow(t):
        """The shortest stretch from the first brace whose braces, strings taken out, come out even."""
        at = t.find("{")
        for end in range(at + 1, len(t) + 1) if at >= 0 else ():
            bare = re.sub(r'"(?:[^"\\]|\\.)*"', "", t[at:end], flags=re.S)
            if '"' not in bare and bare.count("{") == bare.count("}"):
                return t[at:end]
        return None

    for _ in range(3000):
        t = "".join(rng.choices('{{}}"\\a ', k=rng.randrange(14)))
        assert balanced_object(t) == slow(t), t


def test_flat_stream(spark, tmp_path, monkeypatch):
    """Parts laid end to end are the stream, from any place to any other, whatever tasks wrote."""
    from grainmill.sources import stream

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    monkeypatch.setattr(stream, "RANGE", 500)
    rng = random.Random(2)
    arrays = [(i, None if i % 17 == 0 else [rng.choice((None, -5, 0, 7, 2**31 - 1)) if rng.random() < 0.05 else rng.randrange(50_000) for _ in range(rng.randrange(60))]) for i in range(300)]
    flat = [x for _, a in arrays for x in a or () if x is not None]
    frame = spark.createDataFrame(arrays, "i int, ids array<int>").repartition(7)
    for path in (str(tmp_path / "a"), (tmp_path / "b").as_uri()):
        stream.write_stream(frame, "ids", ["i"], path)
        for length, start, stop, pad in ((64, 0, None, None), (10, 137, 2001, None), (7, 5, 5, None), (64, 100, None, -1), (100_000, 0, None, 3), (3, 10**9, None, 0)):
            part = flat[start:stop]
            want = [part[k : k + length] for k in range(0, len(part), length)]
            if want and len(want[-1]) < length:
                want[-1] = want[-1] + [pad] * (length - len(want[-1])) if pad is not None and len(want[-1]) > 1 else None
            got = stream.read_stream(spark, path, length, start, stop, pad).orderBy("block_id").collect()
            assert [(r.block_id, list(r.ids)) for r in got] == [(k, w) for k, w in enumerate(want) if w is not None]
    parts = stream.parts_of(path)
    assert len(parts) > 1
    raw = b"".join((tmp_path / "b" / p["file"]).read_bytes() for p in parts)
    assert raw == b"".join(x.to_bytes(4, "little", signed=True) for x in flat)
    stream.write_stream(frame.where("i < 20"), "ids", ["i"], path, append=True)
    more = flat + [x for i, a in arrays if i < 20 for x in a or () if x is not None]
    assert [x for r in stream.read_stream(spark, path, 1).orderBy("block_id").collect() for x in r.ids] == more
    stream.write_stream(frame.limit(0), "ids", ["i"], path)
    assert stream.read_stream(spark, path).count() == 0
    assert [p.name for p in (tmp_path / "b").iterdir() if p.suffix == ".bin"] == []
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_shuffle_as_arithmetic(spark, n):
    """A permutation, undone by its inverse, with every part of the order readable by itself; other seeds give other ones."""
    from grainmill.operators import shuffling

    rows = spark.range(n).select(F.col("id").alias("number"))
    got = rows.select("number", shuffling.place_of(F.col("number"), n, 5).alias("place"), shuffling.place_of(F.col("number"), n, 6).alias("other"))
    places = {r.number: r.place for r in got.collect()}
    assert sorted(places.values()) == list(range(n))
    back = rows.select("number", shuffling.row_at(F.col("number"), n, 5).alias("row")).collect()
    assert all(places[r.row] == r.number for r in back)
    part = shuffling.shuffled_part(rows, "number", n, n // 3, n // 3 + 20, 5).collect()
    assert {r.place: r.number for r in part} == {p: k for k, p in places.items() if n // 3 <= p < n // 3 + 20}
    if n > 90:
        assert sum(r.place != r.other for r in got.collect()) > 0.9 * n and sum(k != p for k, p in places.items()) > 0.9 * n
    assert rows.select(shuffling.place_of(F.lit(None).cast("long"), n).alias("x")).first().x is None
    with pytest.raises(Exception, match="outside"):
        spark.range(n, n + 1).select(shuffling.place_of(F.col("id"), n)).collect()


def test_repeated_ngrams_against_slices(spark):
    from grainmill.operators import decoding as D

    rng = random.Random(12)
    arrays = [[rng.choice((1, 2, 3, None) if rng.random() < 0.05 else (1, 2, 3)) for _ in range(rng.randrange(60))] for _ in range(300)] + [None, [], [None], [1] * 500]
    frame = spark.createDataFrame(list(enumerate(arrays)), "i int, t array<int>").repartition(3)
    for n in (1, 2, 3, 5, 8):
        got = frame.select("i", D.banned_tokens(F.col("t"), n).alias("b"), D.repeats_last(F.col("t"), n).alias("r")).collect()
        for r in got:
            t = arrays[r.i]
            if t is None:
                assert r.b is None and r.r is None
                continue
            if n > 1:
                want = {t[k + n - 1] for k in range(len(t) - n + 1) if t[k : k + n - 1] == t[len(t) - n + 1 :]}
                assert r.b == sorted(x for x in want if x is not None), (n, t)
            assert r.r == (len(t) > n and any(t[k : k + n] == t[len(t) - n :] for k in range(len(t) - n))), (n, t)


def test_updated_stream(spark, tmp_path):
    """One changed file rewrites its part and those behind it; the stream is always that of all files."""
    from grainmill.sources import stream

    rng = random.Random(9)
    files = {f"f{k:03d}": [rng.randrange(1000) for _ in range(rng.randrange(9))] for k in range(120)}
    path, encoded = str(tmp_path / "s"), []

    def update():
        rows = [(k, str(hash(tuple(v)))) for k, v in files.items()]
        frame = spark.createDataFrame(rows, "path string, mark string").repartition(3)
        arrays = spark.createDataFrame([(k, v) for k, v in files.items()], "path string, ids array<int>")

        def encode(behind):
            encoded.append(behind.count())
            return behind.join(arrays, "path")

        kept = stream.update_stream(frame, "path", "mark", path, encode, parts=6)
        flat = [x for k in sorted(files) for x in files[k]]
        assert [x for r in stream.read_stream(spark, path, 1).orderBy("block_id").collect() for x in r.ids] == flat
        return kept, stream.parts_of(path)

    kept, first = update()
    assert kept == 0 and encoded == [120] and len(first) > 3 and sum(p["files"] for p in first) == 120
    assert update() == (len(first), first) and encoded == [120], "nothing changed, nothing is written"
    third = first[2]["last"]
    files[third] = files[third] + [7]
    kept, second = update()
    assert kept == 2 and second[:2] == first[:2] and encoded[1] == 120 - first[0]["files"] - first[1]["files"]
    files["f999"] = [1, 2]
    kept, after = update()
    assert kept == len(second) and after[:-1] == second and encoded[2] == 1
    del files["f000"]
    assert update()[0] == 0
    files.clear()
    files["a"] = []
    update()

"""Report files read in parallel: a state machine over lines as a prefix scan of transition maps.

What a stretch of lines does to the reader's state is itself a small value, whatever the state before it: a line of a new
corpus sets everything, a pattern or a separator fixes the pattern, a regex counts only where there is none. Such maps compose,
so a file is cut into stretches of FAN lines that are folded side by side, stretches into groups of FAN stretches, and so on,
until one group is left; then states go down again, and each stretch is read with the state at its start. Every array has at
most FAN entries, so a file of any length is read by many tasks.

Defined results. Null lines are lines without a meaning. Lines of one file go by number; of lines that share a number, any may
come first. Repeated files (the same path and numbers) aren't allowed. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .shared import written

#: Lines of a stretch, stretches of a group.
FAN = 1024

#: What lines do to the state. corpus: inside the wanted corpus from here on (null: as before). fixed: pattern holds whatever
#: was before. fallback: the pattern if there was none before.
MAP = "struct<corpus:boolean,fixed:boolean,pattern:string,fallback:string>"
STATE = "struct<inside:boolean,pattern:string>"
EVENT = "struct<line_no:bigint,kind:string,value:string,n:bigint>"


def _struct(kind: str, **fields: Column) -> Column:
    return F.struct(*[c.alias(k) for k, c in fields.items()]).cast(kind)


def nothing() -> Column:
    return F.lit(None)


def _identity() -> Column:
    return _struct(MAP, corpus=nothing(), fixed=F.lit(False), pattern=nothing(), fallback=nothing())


def _line(m: Column, e: Column) -> Column:
    """Map m followed by a line."""
    fix = lambda pattern: _struct(MAP, corpus=m["corpus"], fixed=F.lit(True), pattern=pattern, fallback=nothing())
    unless = lambda held: F.coalesce(held, e["value"])
    regex = F.when(m["fixed"], fix(unless(m["pattern"]))).otherwise(_struct(MAP, corpus=m["corpus"], fixed=F.lit(False), pattern=nothing(), fallback=unless(m["fallback"])))
    start = _struct(MAP, corpus=e["n"] == 1, fixed=F.lit(True), pattern=nothing(), fallback=nothing())
    outside = F.coalesce(~m["corpus"], F.lit(False))
    return F.when(e["kind"] == "corpus", start).when(outside | (e["kind"] == "hit"), m).when(e["kind"] == "pattern", fix(e["value"])).when(e["kind"] == "reset", fix(nothing())).otherwise(regex)


def _composed(m: Column, after: Column) -> Column:
    """Map m followed by map after."""
    both = lambda fixed, pattern, fallback: _struct(MAP, corpus=m["corpus"], fixed=F.lit(fixed), pattern=pattern, fallback=fallback)
    outside = F.coalesce(~m["corpus"], F.lit(False))
    later = F.when(m["fixed"], both(True, F.coalesce(m["pattern"], after["fallback"]), nothing())).otherwise(both(False, nothing(), F.coalesce(m["fallback"], after["fallback"])))
    return F.when(after["corpus"].isNotNull(), after).when(outside, m).when(after["fixed"], both(True, after["pattern"], nothing())).otherwise(later)


def _reached(state: Column, m: Column) -> Column:
    """The state after map m."""
    inside = _struct(STATE, inside=F.lit(True), pattern=F.when(m["fixed"], m["pattern"]).otherwise(F.coalesce(state["pattern"], m["fallback"])))
    anew = _struct(STATE, inside=m["corpus"], pattern=F.when(m["corpus"], m["pattern"]))
    return F.when(m["corpus"].isNotNull(), anew).when(state["inside"], inside).otherwise(state)


def _running(items: Column, start: Column, step, kind: str, item: str) -> Column:
    """[(item, what was reached before it)] of an array."""
    pair = f"struct<item:{item},before:{kind}>"
    empty = F.lit(None).cast(f"array<{pair}>")
    zero = F.struct(start.alias("now"), F.coalesce(empty, F.expr(f"cast(array() as array<{pair}>)")).alias("seen"))
    add = lambda acc, x: F.struct(step(acc["now"], x).alias("now"), F.concat(acc["seen"], F.array(F.struct(x.alias("item"), acc["now"].alias("before")).cast(pair))).alias("seen"))
    return F.aggregate(items, zero, add)["seen"]


def states(maps: DataFrame) -> DataFrame:
    """(path, part, state): the state in front of each part of a file. maps: (path, part, map), parts numbered in order."""
    item = f"struct<part:bigint,map:{MAP}>"
    grouped = maps.groupBy("path", F.expr(f"part div {FAN}").cast("bigint").alias("group")).agg(F.sort_array(F.collect_list(F.struct("part", "map"))).alias("items"))
    groups = written(grouped.withColumn("map", F.aggregate("items", _identity(), lambda m, x: _composed(m, x["map"]))))
    if groups.where("group > 0").isEmpty():
        begun = groups.withColumn("state", _struct(STATE, inside=F.lit(False), pattern=nothing()))
    else:
        above = states(groups.select("path", F.col("group").alias("part"), "map")).withColumnRenamed("part", "group")
        begun = groups.join(above, ["path", "group"])
    seen = _running(F.col("items"), F.col("state"), lambda s, x: _reached(s, x["map"]), STATE, item)
    return begun.select("path", F.explode(seen).alias("x")).select("path", F.col("x.item.part").alias("part"), F.col("x.before").alias("state"))


def events(lines: DataFrame, corpus: str, order: str = "line_no", text: str = "value") -> DataFrame:
    """(path, part, line_no, kind, value, n): the lines that mean something. n: a hit's matches, or 1 for the wanted corpus."""
    v = T.strip(F.col(text))
    named = lambda label: F.regexp_extract(v, rf"(?s)^{label}:\s*(.*)$", 1)
    at = lambda word: F.startswith(v, F.lit(word))
    hit = r"^\[(\d+)\s+matches\]\s+(.+)$"
    kind = F.when(at("CORPUS:"), "corpus").when(at("Pattern:"), "pattern").when(at("Regex:"), "regex").when(at("---") | at("Summary for"), "reset").when(F.rlike(v, F.lit(hit)), "hit")
    value = F.when(kind == "pattern", F.regexp_replace(named("Pattern"), "^'+|'+$", "")).when(kind == "regex", named("Regex")).when(kind == "hit", F.regexp_extract(v, hit, 2))
    n = F.when(kind == "hit", F.regexp_extract(v, hit, 1).cast("bigint")).when(kind == "corpus", (named("CORPUS") == corpus).cast("bigint"))
    number = F.col(order).cast("bigint")
    found = lines.select("path", number.alias("line_no"), kind.alias("kind"), value.alias("value"), n.alias("n")).where("kind is not null")
    return found.withColumn("part", F.expr(f"line_no div {FAN}"))


def report_hits(lines: DataFrame, corpus: str, order: str = "line_no", text: str = "value") -> DataFrame:
    """(path, line_no, filename, n, pattern): the match lines of one corpus with the pattern that holds there (null: none).
    lines: (path, line number, text)."""
    of_part = events(lines, corpus, order, text).groupBy("path", "part").agg(F.sort_array(F.collect_list(F.struct("line_no", "kind", "value", "n"))).alias("events"))
    parts = written(of_part.withColumn("map", F.aggregate("events", _identity(), _line)))
    begun = parts.select("path", "part", "events").join(states(parts.select("path", "part", "map")), ["path", "part"])
    seen = _running(F.col("events"), F.col("state"), lambda s, e: _reached(s, _line(_identity(), e)), STATE, EVENT)
    hits = begun.select("path", F.explode(seen).alias("x")).where("x.item.kind = 'hit' and x.before.inside")
    return hits.select("path", "x.item.line_no", F.col("x.item.value").alias("filename"), "x.item.n", "x.before.pattern")

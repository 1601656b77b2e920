"""Text cleaning: documents to cleaned documents with counts of what went. All steps are column functions.

Null texts stay null, with null counts; empty texts stay empty. Rows are cleaned one by one, so repeated rows stay, and
an empty table gives one. Columns of an input keep their values; those that a step adds replace ones of their name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T


def first_line(lines: Column, pattern: str) -> Column:
    """The 1-based place of the first line that a pattern finds; 0 if none."""
    return F.coalesce(F.array_position(F.transform(lines, lambda x: F.rlike(x, F.lit(pattern))), True), F.lit(0)).cast("int")


def strip_markers(lines: Column, start: str = L.START_LINE, end: str = L.END_LINE) -> Column:
    """struct(lines, head, foot): lines after the first start marker and before the first end marker after it."""
    at = first_line(lines, start)
    rest = F.slice(lines, at + 1, F.greatest(F.size(lines), F.lit(1)))
    stop = first_line(rest, end)
    return F.struct(F.when(stop > 0, F.slice(rest, 1, F.greatest(stop - 1, F.lit(0)))).otherwise(rest).alias("lines"), at.alias("head"), F.when(stop > 0, F.size(rest) - stop + 1).otherwise(0).alias("foot"))


def leading_metadata(lines: Column, scan: int = 400) -> Column:
    """Number of leading lines that are metadata: at least two lines hit the pattern among the first `scan`. Blank lines
    after a hit belong to it; after two hits so do short lines without a terminator; prose ends the scan."""
    start = F.struct(F.lit(0).alias("hits"), F.lit(0).alias("cut"), F.lit(0).alias("i"), F.lit(False).alias("done"))

    def step(acc, line):
        s = T.strip(line)
        i = acc["i"] + 1
        blank, hit = s == "", F.rlike(s, F.lit(L.METADATA))
        goes_on = (acc["hits"] >= 2) & (F.length(s) < 120) & ~F.rlike(s, F.lit("[.!?]$"))
        stop = ~blank & ~hit & F.when(acc["hits"] >= 2, ~goes_on).otherwise(F.length(s) > 40)
        cut = F.when((blank & (acc["hits"] > 0)) | (~blank & hit) | (~blank & ~hit & goes_on), i).otherwise(acc["cut"])
        new = F.struct((acc["hits"] + (~blank & hit).cast("int")).alias("hits"), cut.alias("cut"), i.alias("i"), stop.alias("done"))
        return F.when(acc["done"], acc).otherwise(new)

    return F.aggregate(F.slice(lines, 1, scan), start, step, lambda a: F.when(a["hits"] >= 2, a["cut"]).otherwise(0))


#: Kinds of a line of a table of contents.
BLANK, ENTRY, PROSE, SHORT, OTHER = range(5)


def toc_kind(line: Column) -> Column:
    """The kind of a line: entries have a chapter's name, a dotted leader or, in under 90 characters, a number at their
    end; short lines have at most 60 characters."""
    s = T.strip(line)
    has = lambda p: F.rlike(s, F.lit(p))
    entry = has(L.TOC_ENTRY) | has(L.TOC_DOTTED) | ((F.length(s) < 90) & has(L.TOC_NUMBER))
    return F.when(s == "", BLANK).when(entry, ENTRY).when(T.is_prose_line(s), PROSE).when(F.length(s) <= 60, SHORT).otherwise(OTHER)


def toc_end(kinds: Column, header: Column, limit: int) -> Column:
    """Where the block of the header line at a place (from 0) ends; the header's place if it heads none. A block goes on up
    to a line of no kind, to the second line of prose since an entry, or for `limit` lines; it has at least two entries or
    short lines, and as many lines less as there was prose since its last entry."""
    begin = F.struct(F.lit(0).alias("read"), F.lit(0).alias("like"), F.lit(0).alias("prose"), F.lit(True).alias("on"))

    def step(b: Column, kind: Column) -> Column:
        prose = F.when(kind == ENTRY, 0).otherwise(b["prose"] + (kind == PROSE).cast("int"))
        more = F.struct((b["read"] + 1).alias("read"), (b["like"] + kind.isin(ENTRY, SHORT).cast("int")).alias("like"), prose.alias("prose"), (prose < 2).alias("on"))
        over = F.struct(b["read"].alias("read"), b["like"].alias("like"), b["prose"].alias("prose"), F.lit(False).alias("on"))
        return F.when(~b["on"], b).when(kind == OTHER, over).otherwise(more)

    lines = lambda b: header + 1 + b["read"] - b["prose"]
    return F.aggregate(F.slice(kinds, header + 2, F.lit(limit)), begin, step, lambda b: F.when((b["like"] >= 2) & (lines(b) > header), lines(b)).otherwise(header))


def toc_spans(lines: Column, limit: int = 300) -> Column:
    """array<struct(start, stop)>: the tables of contents in lines, in order, none within another."""
    kinds = F.transform(lines, toc_kind)
    headers = F.filter(F.transform(lines, lambda x, i: F.when(F.rlike(T.strip(x), F.lit(L.TOC_HEADER)), i)), lambda i: i.isNotNull())
    blocks = F.transform(headers, lambda i: F.struct(i.alias("start"), toc_end(kinds, i, limit).alias("stop")))
    none = F.array().cast("array<struct<start:int,stop:int>>")
    return F.aggregate(blocks, none, lambda found, b: F.when((b["stop"] > b["start"]) & (F.coalesce(F.try_element_at(found, F.lit(-1))["stop"], F.lit(0)) <= b["start"]), F.concat(found, F.array(b))).otherwise(found))


def strip_toc(df: DataFrame, lines_col: str, limit: int = 300) -> DataFrame:
    """Replaces the lines column by the lines outside tables of contents and adds toc_removed. Lines are only looked at one
    by one where one of them is a header. Null lines stay null with 0 removed."""
    has = F.exists(lines_col, lambda x: F.rlike(x, F.lit(L.TOC_HEADER)))
    d = df.withColumn("__toc", F.when(has, toc_spans(F.col(lines_col), limit)))
    size = F.aggregate("__toc", F.lit(0), lambda n, s: n + s["stop"] - s["start"])
    left = F.filter(lines_col, lambda x, i: ~F.exists("__toc", lambda s: (s["start"] <= i) & (i < s["stop"])))
    return d.withColumn("toc_removed", F.coalesce(size, F.lit(0))).withColumn(lines_col, F.when(F.col("__toc").isNull(), F.col(lines_col)).otherwise(left)).drop("__toc")


def drop_structural(lines: Column) -> Column:
    return F.filter(lines, lambda x: ~F.rlike(T.strip(x), F.lit(L.STRUCTURAL)))


def inline_annotations(text: Column) -> Column:
    """struct(text, n): without bracketed, then parenthesised annotations."""
    once = F.regexp_replace(text, L.BRACKETED, "")
    return F.struct(F.regexp_replace(once, L.PARENTHESISED, "").alias("text"), (F.regexp_count(text, F.lit(L.BRACKETED)) + F.regexp_count(once, F.lit(L.PARENTHESISED))).alias("n"))


def clean_whitespace(text: Column) -> Column:
    """struct(text, n): LF line ends, no blanks at line ends, runs of three or more line feeds (n of them) folded to two,
    stripped, one final line feed unless empty."""
    lines = T.rstrip_lines(T.newlines(text))
    body = T.strip(F.regexp_replace(lines, "\n{3,}", "\n\n"))
    return F.struct(F.when(body == "", "").otherwise(F.concat(body, F.lit("\n"))).alias("text"), F.regexp_count(lines, F.lit("\n{3,}")).alias("n"))


REPORT = ("chars_before", "chars_after", "metadata_lines_removed", "gutenberg_footer_lines_removed", "toc_lines_removed", "structural_lines_removed", "inline_annotations_removed", "blank_line_reductions")


def clean(docs: DataFrame, text_col: str, scan: int = 400, toc: int = 300) -> DataFrame:
    """All cleaning steps in order; replaces the text and adds the REPORT columns. Narrow."""
    d = docs.withColumn("chars_before", F.length(text_col)).withColumn("__m", strip_markers(F.split(T.newlines(F.col(text_col)), "\n")))
    d = d.withColumn("__lead", leading_metadata(F.col("__m.lines"), scan)).withColumn("__lines", F.slice("__m.lines", F.col("__lead") + 1, F.greatest(F.size("__m.lines"), F.lit(1))))
    d = strip_toc(d, "__lines", toc).withColumn("__kept", drop_structural(F.col("__lines")))
    d = d.withColumn("__inline", inline_annotations(F.concat_ws("\n", "__kept"))).withColumn("__white", clean_whitespace(F.col("__inline.text")))
    counts = [F.length("__white.text").alias("chars_after"), (F.col("__m.head") + F.col("__lead")).alias("metadata_lines_removed"), F.col("__m.foot").alias("gutenberg_footer_lines_removed"), F.col("toc_removed").alias("toc_lines_removed"), (F.size("__lines") - F.size("__kept")).alias("structural_lines_removed"), F.col("__inline.n").alias("inline_annotations_removed"), F.col("__white.n").alias("blank_line_reductions")]
    return d.select(*[c for c in docs.columns if c != text_col], F.col("__white.text").alias(text_col), "chars_before", *counts)


def clean_totals(cleaned: DataFrame) -> DataFrame:
    return cleaned.agg(F.count("*").alias("files"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in REPORT])


def strip_boilerplate(text: Column) -> Column:
    """What stands between the line of the first *** START and the first *** END after it."""
    at = F.regexp_instr(text, F.lit(L.ANY_START))
    after = F.substring(text, at, F.length(text))
    newline = F.instr(after, "\n")
    body = F.when(at == 0, text).when(newline == 0, "").otherwise(F.substring(after, newline + 1, F.length(text)))
    stop = F.regexp_instr(body, F.lit(L.ANY_END))
    return F.regexp_replace(F.when(stop > 0, F.substring(body, F.lit(1), stop - 1)).otherwise(body), "^[﻿\r\n ]+|[﻿\r\n ]+$", "")


def core_text(text: Column) -> Column:
    """As strip_boilerplate, for marker lines written out in full, with looser ones as a fallback."""
    t = T.newlines(text)

    def after(c: Column, pattern: str) -> Column:
        hit = F.regexp_extract(c, pattern, 0)
        return F.when(F.regexp_instr(c, F.lit(pattern)) > 0, F.substring(c, F.regexp_instr(c, F.lit(pattern)) + F.length(hit), F.length(c)))

    def upto(c: Column, pattern: str) -> Column:
        at = F.regexp_instr(c, F.lit(pattern))
        return F.when(at > 0, F.substring(c, F.lit(1), at - 1))

    body = F.coalesce(after(t, L.CORE_START), after(t, L.CORE_START_LOOSE), t)
    return T.strip(F.coalesce(upto(body, L.CORE_END), upto(body, L.CORE_END_LOOSE), body))


def drop_front_matter(text: Column, least: int = 200) -> Column:
    """From the first paragraph of real prose on: with a period, a lower-case letter, not mostly capitals and at least
    `least` characters; the text itself if there is none."""
    breaks = r"(?:\r?\n[ \t]*){2,}"
    marked = F.split(F.regexp_replace(F.replace(text, F.lit(T.SENTINEL), F.lit(" ")), breaks, f"{T.SENTINEL}$0{T.SENTINEL}"), T.SENTINEL)
    folded = lambda p: F.regexp_replace(T.strip(p), rf"(?U){T.WS}+", " ")
    good = F.transform(marked, lambda p, i: (i % 2 == 0) & ~T.mostly_upper(p) & F.contains(p, F.lit(".")) & F.rlike(p, F.lit(r"\p{Ll}")) & (F.length(folded(p)) >= least))
    at = F.coalesce(F.array_position(good, True), F.lit(0)).cast("int")
    return F.when(at == 0, text).otherwise(F.concat_ws("", F.slice(marked, at, F.size(marked))))


def fix_spacing(line: Column) -> Column:
    """Spaces that scanned text often lacks: between cases, before quotes and brackets, after marks."""
    for pattern, put in ((r"(?<=[a-z])(?=[A-Z])", " "), ("(?<=[A-Za-z])(?=[‘’“”'\"(\\[])", " "), (r"(?<=[A-Za-z0-9])\.(?=[A-Za-z])", ". "), (r"(?<=[A-Za-z0-9]),(?=[A-Za-z])", ", "), (r"(?<=[A-Za-z0-9])\?(?=[A-Za-z])", "? "), (r"(?<=[A-Za-z0-9])!(?=[A-Za-z])", "! "), (r"(?U)\s{2,}", " ")):
        line = F.regexp_replace(line, pattern, put)
    return T.strip(line)

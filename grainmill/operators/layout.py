"""Page layout: glyphs and words to lines, columns, and line filters.

Glyphs without a size or place are dropped; null texts add nothing to a line; glyphs that tie in their place stand in the
order of their texts; repeated glyphs are drawn twice; pages without glyphs, and empty tables, have no lines. A page, not
a book, is what one task holds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import lexicons as L
from ..functions import text as T
from .cleaning import fix_spacing


def skip_line(line: Column) -> Column:
    """Headings, numbers, short 'book' lines, ranges of numbers and unclosed parentheses."""
    s = T.strip(line)
    out = s == ""
    for p in L.HEADINGS:
        out = out | F.rlike(s, F.lit(p))
    count = lambda c: F.length(s) - F.length(F.replace(s, F.lit(c), F.lit("")))
    return out | F.rlike(s, F.lit(r"^\d+$")) | ((F.length(s) <= 6) & F.contains(F.lower(s), F.lit("book"))) | F.rlike(s, F.lit(r"\d+\s*[–-]\s*\d+$")) | ((count("(") == 1) & (count(")") == 0) & (F.length(s) < 40))


def filter_lines(lines: DataFrame, text: str, skip: tuple[str, ...], marker: str, least: int = 1) -> DataFrame:
    """Lines without those that a skip pattern finds at their start, without their leading marker, and without numbers and
    lines shorter than `least`."""
    d = lines.withColumn(text, T.strip(F.col(text))).where(F.col(text) != "")
    for p in skip:
        d = d.where(~F.rlike(F.col(text), F.lit(p)))
    d = d.withColumn(text, F.regexp_replace(text, marker, ""))
    return d.where(~F.rlike(F.col(text), F.lit(r"^\d+$")) & (F.length(text) >= least))


#: Skip patterns and leading markers of four readers of one book.
BOOK = dict(skip=(r"^\d+\s*/", r"^(Figure|TABLE|Table|Fig\.|FIG\.)\b", r"^[A-Z]{1,2}\s*$"), marker=r"^(?:[A-Z]{1,2}\d+\s+)?(?:[0-9]+\s+)?")
BOOK_TEXT = dict(skip=(r"^\s*\d+\s*/", r"(?i)^(Figure|Fig\.|Table|TAB)\b", r"^[A-Z]$"), marker=r"^[A-Z]?\d{2,3}\s+")
FULL = dict(skip=(r"^\s*\d+\s*/", r"(?i)^(Figure|Fig\.|Table|TAB|TABLE)\b", r"^[A-Z]$", r"^\d+\s+\d+\.\s+"), marker=r"^[A-Z]{0,2}\d{2,4}\s+", least=2)


def glyph_lines(glyphs: DataFrame, tolerance: float = 2.0, gap: float = 0.6, small: float = 9.5) -> DataFrame:
    """glyphs (page, page_width, top, x0, x1, size, text) as (page, col, line, text): small glyphs dropped, left column
    before right, a new line where the top leaves the line's first glyph by more than the tolerance, a space where the gap
    exceeds a share of the glyph before. A line's anchor depends on the glyphs ahead: pages are dealt to tasks, sorted, and
    numbered in one pass that keeps only the anchor."""
    d = glyphs.where(F.col("size") >= small).withColumn("col", F.when(F.col("x0") < F.col("page_width") / 2, 0).otherwise(1))

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group = anchor = line = None
        for b in batches:
            out = []
            for key, top in zip(zip(b["page"], b["col"]), b["top"]):
                if key != group:
                    group, anchor, line = key, top, 0
                elif abs(top - anchor) > tolerance:
                    anchor, line = top, line + 1
                out.append(line)
            yield b.assign(line=out)

    ordered = d.repartition("page", "col").sortWithinPartitions("page", "col", "top", "x0")
    numbered = ordered.mapInPandas(lines, StructType([*d.schema.fields, StructField("line", IntegerType())]))
    w = Window.partitionBy("page", "col", "line").orderBy("x0")
    before, width = F.lag("x1").over(w), F.greatest(F.lag("x1").over(w) - F.lag("x0").over(w), F.lit(1e-3))
    part = F.concat(F.when(F.col("x0") - before > width * gap, " ").otherwise(""), F.col("text"))
    spaced = numbered.withColumn("part", part)
    joined = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("x0", "part"))), lambda x: x["part"]))
    return spaced.groupBy("page", "col", "line").agg(joined.alias("text"))


def two_columns(glyphs: DataFrame) -> DataFrame:
    """glyph_lines without skipped lines, with spacing repaired; runs of blank lines folded per page."""
    return glyph_lines(glyphs).where(~skip_line(F.col("text"))).withColumn("text", fix_spacing(F.col("text")))


def collapse_blanks(lines: DataFrame, text: str, group: str, order: str) -> DataFrame:
    """Drops blank lines that follow a blank line."""
    blank = T.strip(F.col(text)) == ""
    before = F.lag(blank).over(Window.partitionBy(group).orderBy(order))
    return lines.withColumn("__drop", blank & F.coalesce(before, F.lit(False))).where(~F.col("__drop")).drop("__drop")


def bucket_lines(words: DataFrame, page: str = "page") -> DataFrame:
    """Words (page, top, x0, text) as lines: rounded tops, words by x, joined by spaces."""
    line = F.bround("top", 0)
    joined = F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda x: x["text"]))
    return words.groupBy(page, line.alias("y")).agg(joined.alias("text"))


def size_histogram(glyphs: DataFrame) -> DataFrame:
    return glyphs.groupBy(F.round("size", 1).alias("size")).count().orderBy(F.desc("count"), "size")

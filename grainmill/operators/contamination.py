"""Contamination review: matches, the sentences that hold them, rules, decisions and removal.

Null texts have no findings and stay null where spans or sentences are removed; documents without findings get no
decision; documents that tie in a list stand by their id; repeated findings of one sentence are one; empty tables give
empty results."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions import lexicons as L
from ..functions import text as T
from .shared import small, written

#: A line's sentences: up to terminators before white space, or to the line's end.
SENTENCE = re.compile(r"[^\n.!?]+(?:[.!?]+(?=\s|$)|$)", re.M)
WORD = re.compile(r"\w+")

#: Bytes of texts that a task has as strings at once.
CHARS = 1 << 20


def sentences_of(text: str) -> list[tuple[int, int]]:
    """(start, stop) of the sentences of a text with more than white space, line by line. What stands before a period
    inside a token belongs to no sentence."""
    return [m.span() for m in SENTENCE.finditer(text) if m.group().strip()]


@F.pandas_udf(ArrayType(StructType().add("start", "integer").add("stop", "integer").add("text", "string")))
def sentence_spans(text: pd.Series) -> pd.Series:
    """The sentences of each text, in order; null texts have none (null). For rows of all sentences take sentences()."""
    return text.map(lambda t: None if t is None else [{"start": a, "stop": b, "text": t[a:b]} for a, b in sentences_of(t)])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """(ids, texts) of a batch's (id, text) rows, CHARS bytes of texts at a time, so that a task holds few of them as strings."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // CHARS)) + 1).tolist(), b.num_rows]
        for at, stop in zip(cuts, cuts[1:], strict=False):
            part = b.slice(at, stop - at)
            yield part.column(0), part.column(1).to_pylist()


def sentences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, start, stop, text): the sentences of each text, in order. Null texts have none."""
    texts = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("__text")).where("__text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _pieces(batches):
            spans = [sentences_of(t) for t in texts]
            of = np.repeat(np.arange(len(texts)), [len(x) for x in spans])
            places = np.array([p for x in spans for p in x], np.int32).reshape(-1, 2)
            cut = pa.array([t[a:b] for t, x in zip(texts, spans, strict=True) for a, b in x], pa.string())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(of)), pa.array(places[:, 0]), pa.array(places[:, 1]), cut], names=[id_col, "start", "stop", "text"])

    return texts.mapInArrow(run, f"`{id_col}` {dict(texts.dtypes)[id_col]}, start int, stop int, text string")


def proximity_pattern(a: str, b: str, words: int = 5) -> str:
    return rf"(?iuU){a}(?:\W+\w+){{0,{words}}}\W+{b}"


def classify(sentence: Column) -> Column:
    """struct(label, action, reason) of a sentence; the rules apply in this order."""
    s = T.strip(sentence)
    has = lambda p: F.rlike(s, F.lit(p))
    strong, historical, weak = has(L.STRONG), has(L.HISTORICAL), has(L.WEAK)
    plain = ~(strong | historical)
    out = lambda label, action, reason: F.struct(F.lit(label).alias("label"), F.lit(action).alias("action"), F.lit(reason).alias("reason"))
    return (
        F.when(has(L.FIGURATIVE) & plain, out("FIGURATIVE", "KEEP", "Likely figurative/non-astronomical usage"))
        .when(has(L.TECHNICAL) & plain, out("FALSE_POSITIVE", "KEEP", "Likely geocentric/technical false positive"))
        .when(historical, out("HISTORICAL", "REMOVE", "Historical heliocentric reference"))
        .when(strong, out("DEFINITE", "REMOVE", "Direct heliocentric statement"))
        .when(weak & has(L.CONTEXT), out("BORDERLINE", "REVIEW", "Weak heliocentric signal; needs manual review"))
        .when(weak, out("FIGURATIVE", "KEEP", "Weak pattern without clear astronomy context"))
        .otherwise(out("FALSE_POSITIVE", "KEEP", "Pattern overlap without contamination signal"))
    )


class _Fold(dict):
    """Characters to one form of their cases, one for one, so that places stay; filled in as texts bring them."""

    def __missing__(self, code: int) -> int:
        other = chr(code).upper().lower()
        self[code] = ord(other) if len(other) == 1 else code
        return self[code]


def is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


class Finder:
    """Finds the sentences of a text that hold a phrase or a pair of near words.

    All phrases and words are in one Aho-Corasick automaton, so a text is read once, however many there are. Case doesn't
    matter. A phrase's matches don't overlap each other; a pair's second word is the last one within reach, and the next
    match of the pair starts behind it."""

    def __init__(self, phrases: Sequence[str], pairs: Sequence[tuple[str, str]], words: int = 5):
        import ahocorasick

        self.fold = _Fold({0x130: ord("i")})
        self.words = words
        self.phrases = list(dict.fromkeys(p for p in phrases if p))
        self.pairs = list(dict.fromkeys(pairs))
        places: dict[str, list[tuple[str, int]]] = {}
        for k, p in enumerate(self.phrases):
            places.setdefault(p.translate(self.fold), []).append(("phrase", k))
        for k, pair in enumerate(self.pairs):
            for side, word in zip(("left", "right"), pair, strict=True):
                places.setdefault(word.translate(self.fold), []).append((side, k))
        self.machine = ahocorasick.Automaton()
        for word, uses in places.items():
            self.machine.add_word(word, (len(word), uses))
        if places:
            self.machine.make_automaton()

    def hits(self, text: str) -> list[tuple[int, str, str]]:
        """(place, source, trigger) of each match."""
        if not len(self.machine):
            return []
        out: list[tuple[int, str, str]] = []
        free: dict[int, int] = {}
        sides: dict[str, dict[int, list[tuple[int, int]]]] = {"left": {}, "right": {}}
        end = len(text)
        for last, (size, uses) in self.machine.iter(text.translate(self.fold)):
            at = last + 1 - size
            for kind, k in uses:
                if kind == "phrase":
                    if at >= free.get(k, 0):
                        free[k] = at + size
                        out.append((at, "exact", self.phrases[k]))
                elif kind == "left" and at + size < end and not is_word(text[at + size]) or kind == "right" and at and not is_word(text[at - 1]):
                    sides[kind].setdefault(k, []).append((at, at + size))
        both = sides["left"].keys() & sides["right"].keys()
        starts = [m.start() for m in WORD.finditer(text)] if both else []
        for k in both:
            a, b = self.pairs[k]
            out += [(at, "proximity", f"{a} [0-5 words] {b}") for at in self._near(sides["left"][k], sides["right"][k], starts)]
        return out

    def _near(self, left: list[tuple[int, int]], right: list[tuple[int, int]], starts: list[int]) -> Iterator[int]:
        """Where a left word has a right one behind it, with at most so many whole words between. starts: of all words."""
        begins, free = [at for at, _ in right], 0
        for at, stop in left:
            if at < free:
                continue
            beyond = bisect_left(starts, stop) + self.words
            k = (bisect_right(begins, starts[beyond]) if beyond < len(starts) else len(begins)) - 1
            if k >= 0 and begins[k] > stop:
                free = right[k][1]
                yield at

    def find(self, text: str) -> list[tuple[int, int, str, list[str], list[str]]]:
        """(start, stop, text, triggers, sources) of each sentence with a match. A match outside all sentences counts for
        its whole line."""
        hits = self.hits(text)
        if not hits:
            return []
        spans = sentences_of(text)
        starts, found = [a for a, _ in spans], {}
        for at, source, trigger in hits:
            k = bisect_right(starts, at) - 1
            if k >= 0 and at < spans[k][1]:
                span = spans[k]
            else:
                stop = text.find("\n", at)
                span = text.rfind("\n", 0, at) + 1, len(text) if stop < 0 else stop
            triggers, sources = found.setdefault(span, (set(), set()))
            triggers.add(trigger)
            sources.add(source)
        return [(a, b, text[a:b], sorted(t), sorted(s)) for (a, b), (t, s) in sorted(found.items())]


def findings(docs: DataFrame, id_col: str, text_col: str, phrases: Sequence[str] = L.EXACT_PHRASES, pairs: Sequence[tuple[str, str]] = L.PROXIMITY_PAIRS) -> DataFrame:
    """A row for each sentence with a match: id, start, stop, sentence_text, triggers, sources, label, action, reason.

    Narrow: a document's matches, sentences and lines are found where it is. phrases and pairs are a lexicon, held by every
    task (phrase_hits takes a table of phrases). Null texts have no findings; repeated rows have their own; an empty table
    gives none."""
    likely = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("__text")).where("__text is not null")
    kind = dict(likely.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(phrases, pairs)
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
        for ids, texts in _pieces(batches):
            rows = [(i, *x) for i, t in enumerate(texts) for x in finder.find(t)]
            if rows:
                of, *columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(of)), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=[id_col, "start", "stop", "raw", "triggers", "sources"])

    found = likely.mapInArrow(run, f"`{id_col}` {kind}, start int, stop int, raw string, triggers array<string>, sources array<string>")
    return found.withColumn("sentence_text", T.strip(F.col("raw"))).withColumn("c", classify(F.col("raw"))).select(id_col, "start", "stop", "sentence_text", "triggers", "sources", "c.*")


def folded(text: Column) -> Column:
    """Lower case, with white space folded to single spaces and none at the ends."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def phrase_hits(docs: DataFrame, phrases: DataFrame, id_col: str, text_col: str, phrase_id: str, phrase_col: str) -> DataFrame:
    """(id, phrase id): each document and each phrase whose words stand in it, one after another; case and white space
    don't matter. A phrase counts once for a document.

    Phrases may be many: a text's windows of 1, 2, 4 and 8 words are compared by hash with the first words of each phrase
    (as many of these as it has), and texts are looked at again only where a hash meets. The hashes go to all executors while their counted size allows, else windows
    are shuffled. Null and empty phrases match nothing; documents that share an id are one."""
    words = F.split(folded(F.col(phrase_col)), " ")
    asked = written(phrases.withColumn("__size", F.size(words)).select(F.col(phrase_id).alias("__item"), folded(F.col(phrase_col)).alias("__phrase"), words.alias("__w"), F.expr("cast(least(8, shiftleft(1, length(bin(__size)) - 1)) as int)").alias("__n")).where("__phrase <> ''"))
    lengths = [r[0] for r in asked.select("__n").distinct().orderBy("__n").collect()]  # four at most
    if not lengths:
        return docs.select(F.col(id_col), F.lit(None).cast(dict(phrases.dtypes)[phrase_id]).alias(phrase_id)).limit(0)
    hash_at = lambda n, i: F.xxhash64(*[F.get("__w", i + k) for k in range(n)])
    own = F.coalesce(*[F.when(F.col("__n") == n, hash_at(n, F.lit(0))) for n in lengths])
    side = small(asked.select("__item", "__phrase", own.alias("__h")), 200)
    window = lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.size("__w") - n, F.lit(0))), lambda i: hash_at(n, i))
    hashes = F.array_distinct(F.concat(*[window(n) for n in lengths]))
    text = folded(F.col(text_col))
    met = docs.select(F.col(id_col).alias("__id"), F.split(text, " ").alias("__w")).select("__id", F.explode(hashes).alias("__h")).join(side, "__h")
    likely = small(written(met.select("__id", "__item", "__phrase").distinct()), 200)
    spaced = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    checked = docs.select(F.col(id_col), text.alias("__text")).join(likely, F.col(id_col) == F.col("__id")).where(F.contains(spaced(F.col("__text")), spaced(F.col("__phrase"))))
    return checked.select(id_col, F.col("__item").alias(phrase_id)).distinct()


def decide(counts: DataFrame, threshold: int = 5, science_heavy: bool = True) -> DataFrame:
    """Adds decision and manual_review to counts of found, removable and review sentences."""
    n, r = F.col("total_matched_sentences"), F.col("removable_sentences")
    heavy = (n >= threshold) & (r >= F.greatest(F.lit(3), (F.lit(0.6) * n).cast("int")))
    decision = F.when(r >= threshold, "REMOVE_FILE").when(F.lit(science_heavy) & heavy, "REMOVE_FILE").when(r > 0, "REMOVE_SENTENCE").otherwise("KEEP")
    return counts.withColumn("decision", decision).withColumn("manual_review", F.col("review_sentences") > 0)


def assess(found: DataFrame, id_col: str, threshold: int = 5, science_heavy: bool = True) -> DataFrame:
    """A row for each document with findings: counts by action, decision, manual_review."""
    count = lambda a: F.count_if(F.col("action") == a)
    counts = found.groupBy(id_col).agg(F.count("*").alias("total_matched_sentences"), count("REMOVE").alias("removable_sentences"), count("REVIEW").alias("review_sentences"), count("KEEP").alias("keep_sentences"))
    return decide(counts, threshold, science_heavy)


def triage(assessed: DataFrame) -> DataFrame:
    d = F.col("decision")
    single = (d == "REMOVE_SENTENCE") & (F.col("removable_sentences") <= 2) & ~F.col("manual_review")
    return assessed.withColumn("triage_bucket", F.when((d == "REMOVE_FILE") & ~F.col("manual_review"), "AUTO_REMOVE").when(single, "SINGLE_SENTENCE").when(F.col("manual_review"), "MANUAL_REVIEW").when(d == "REMOVE_SENTENCE", "REMOVE_SENTENCE_BATCH").otherwise("KEEP"))


def top_contaminated(assessed: DataFrame, id_col: str, k: int = 40) -> DataFrame:
    return assessed.orderBy(F.desc("removable_sentences"), F.asc(id_col)).limit(k)


def merge_spans(spans: DataFrame, id_col: str) -> DataFrame:
    """Merges overlapping and touching (start, stop) spans of each id."""
    w = Window.partitionBy(id_col).orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("__new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    numbered = marked.withColumn("__island", F.sum("__new").over(w))
    return numbered.groupBy(id_col, "__island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("__island")


def remove_spans(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with the merged spans cut out of their texts, runs of line feeds folded to two and a final one; documents
    without spans stay as they are."""
    merged = merge_spans(spans, id_col).groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("__spans"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, s: F.struct(s["stop"].alias("at"), F.concat(acc["out"], F.substring(F.col(text_col), acc["at"] + 1, s["start"] - acc["at"])).alias("out"))
    rest = F.aggregate("__spans", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col(text_col), acc["at"] + 1, F.length(text_col))))
    tidy = F.concat(T.strip(F.regexp_replace(rest, "\n{3,}", "\n\n")), F.lit("\n"))
    joined = docs.join(merged, id_col, "left")
    return joined.withColumn(text_col, F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(tidy)).select(*docs.columns)


def remove_sentences(docs: DataFrame, sentences: DataFrame, id_col: str, text_col: str, sentence_col: str = "sentence") -> DataFrame:
    """Deletes listed sentences literally, longest first (ties by text), with counts of found and missing ones. Blanks at
    line ends and runs of blank lines are tidied in changed texts only."""
    lists = sentences.where(F.col(sentence_col) != "").groupBy(id_col).agg(F.collect_set(sentence_col).alias("__list"))
    ordered = F.transform(F.array_sort(F.transform("__list", lambda s: F.struct((-F.length(s)).alias("n"), s.alias("s")))), lambda x: x["s"])
    start = F.struct(F.col(text_col).alias("t"), F.lit(0).alias("found"), F.lit(0).alias("missing"))

    def step(acc, s):
        hit = F.contains(acc["t"], s)
        return F.struct(F.replace(acc["t"], s, F.lit("")).alias("t"), (acc["found"] + hit.cast("int")).alias("found"), (acc["missing"] + (~hit).cast("int")).alias("missing"))

    done = F.aggregate(F.coalesce(ordered, F.array().cast("array<string>")), start, step)
    joined = docs.join(lists, id_col, "left").withColumn("__r", done)
    tidy = F.regexp_replace(F.regexp_replace(F.col("__r.t"), r"[ \t]+\n", "\n"), "\n{3,}", "\n\n")
    kept = [c for c in docs.columns if c != text_col]
    return joined.select(*kept, F.when(F.col("__r.t") != F.col(text_col), tidy).otherwise(F.col(text_col)).alias(text_col), F.col("__r.found").alias("sentences_found"), F.col("__r.missing").alias("sentences_missing"))


def apply_removals(docs: DataFrame, remove: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(docs that stay, listed ids that aren't in docs)."""
    ids = remove.select(id_col).distinct()
    return docs.join(ids, id_col, "left_anti"), ids.join(docs.select(id_col), id_col, "left_anti")


def merge_reports(exact: DataFrame, proximity: DataFrame) -> DataFrame:
    """Full outer merge of two reports (filename, matches, patterns map<string,bigint>)."""
    a = exact.select("filename", F.col("matches").alias("m1"), F.col("patterns").alias("p1"))
    b = proximity.select("filename", F.col("matches").alias("m2"), F.col("patterns").alias("p2"))
    none = F.create_map().cast("map<string,bigint>")
    patterns = F.map_zip_with(F.coalesce("p1", none), F.coalesce("p2", none), lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))
    types = F.array_compact(F.array(F.when(F.col("m1").isNotNull(), "exact"), F.when(F.col("m2").isNotNull(), "proximity")))
    return a.join(b, "filename", "full_outer").select("filename", F.coalesce("m1", F.lit(0)).alias("exact_report_matches"), F.coalesce("m2", F.lit(0)).alias("proximity_report_matches"), patterns.alias("patterns"), types.alias("report_types"))

"""Results as files. Small reports are one file; data tables stay as many files as they have partitions. All files are
written by Spark, so a path may be in any store that it reaches; a document is a folder with one part file."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import written
from .corpus import path_glob

#: Columns of the review package and of the cleaning report.
FILE_SUMMARY = ("filename", "decision", "manual_review", "total_matched_sentences", "removable_sentences", "review_sentences", "keep_sentences", "exact_report_matches", "proximity_report_matches", "path")
FINDINGS = ("filename", "decision", "manual_review", "sentence_label", "sentence_action", "reason", "triggers", "sentence_text")
REVIEW_QUEUE = ("filename", "decision", "removable_sentences", "review_sentences", "path")
TRIAGE = ("filename", "triage_bucket", "decision", "manual_review", "removable_sentences", "review_sentences", "path")
CLEANING = ("relative_path", "chars_before", "chars_after", "metadata_lines_removed", "gutenberg_footer_lines_removed", "toc_lines_removed", "structural_lines_removed", "inline_annotations_removed", "blank_line_reductions")
#: Columns of candidate lists and of the training log.
CANDIDATES = ("book_id", "title", "url", "extent", "charset")
METRICS = ("step", "epoch", "train_loss", "val_loss", "learning_rate", "tokens_processed", "time_elapsed")


def output_mode(spark: SparkSession, path: str, overwrite: bool = False, resume: bool = False) -> str:
    """The write mode for a path: what is there already is an error unless it may be overwritten or gone on with, and it
    can't be both."""
    if overwrite and resume:
        raise ValueError("overwrite and resume exclude each other")
    if not (overwrite or resume) and path_glob(spark, path):
        raise FileExistsError(path)
    return "append" if resume else "overwrite"


def cell(c: Column, kind: str) -> Column:
    """A value as reports print it: finite floats with six places, nulls stay null."""
    if kind not in ("double", "float"):
        return c
    odd = F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(odd, c.cast("string")).otherwise(F.format_string("%.6f", c))


def fixed(df: DataFrame, columns: Sequence[str], optional: Sequence[str] = ()) -> DataFrame:
    """Columns in a fixed order, floats with six places, optional ones only where they exist."""
    kinds = dict(df.dtypes)
    cols = [c for c in columns if c in kinds or c not in optional]
    return df.select(*[F.when(F.col(c).isNotNull(), cell(F.col(c), kinds[c])).alias(c) for c in cols])


def csv(df: DataFrame, path: str, columns: Sequence[str] | None = None, mode: str = "errorifexists", single: bool = False, sep: str = ",", header: bool = True) -> None:
    """A CSV, each task's rows in a file of its own, in the order of df; nulls are empty. single: one file, for what is small by
    construction."""
    out = fixed(df, columns or df.columns)
    w = (out.coalesce(1) if single else out).write.mode(mode)
    w.option("header", str(header).lower()).option("nullValue", "").option("escape", '"').option("sep", sep).csv(path)


def first_seen_keys(rows: DataFrame, fields: str, order: str) -> list[str]:
    """The keys of a map column in the order in which the rows (by `order`) first have them. Keys are a report's columns:
    few, whatever the rows."""
    each = rows.select(order, F.posexplode(F.map_keys(fields)).alias("at", "key"))
    first = each.groupBy("key").agg(F.min(F.struct(order, "at")).alias("first"))
    return [r.key for r in first.orderBy("first").collect()]


def dynamic_csv(rows: DataFrame, fields: str, order: str, path: str, mode: str = "errorifexists") -> None:
    """Rows of maps as a CSV whose header is the keys in first-seen order; a key that a row lacks is empty. No rows: an
    empty file."""
    keys = first_seen_keys(rows, fields, order)
    if not keys:
        return document(rows.sparkSession, "", path, mode)
    csv(rows.orderBy(order).select(*[F.col(fields)[k].alias(k) for k in keys]), path, mode=mode)


def jsonl(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def document(spark: SparkSession, text: str, path: str, mode: str = "errorifexists") -> None:
    """A small text."""
    spark.createDataFrame([(text.removesuffix("\n"),)], "value string").coalesce(1).write.mode(mode).text(path)


def manifest(values: dict) -> str:
    return json.dumps(values, indent=2, sort_keys=True, ensure_ascii=False)


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """What manifest() wrote with document(); None if nothing is there or it can't be read as one."""
    if not path_glob(spark, path):
        return None
    try:
        return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
    except ValueError:
        return None


def counted(df: DataFrame, column: str) -> dict[str, int]:
    """Rows for each value of a column of few values, as a document holds them."""
    return {r[0]: r[1] for r in df.groupBy(column).count().orderBy(column).collect()}


def quick_summary(assessed: DataFrame, top: int = 40) -> DataFrame:
    """(value): the lines of the review's summary in order, for write.text. Totals, then files to remove, files of few
    sentences, files to review, and the `top` by removable sentences."""
    spark = assessed.sparkSession
    totals = assessed.agg(F.count("*"), F.coalesce(F.sum("removable_sentences"), F.lit(0)), F.count_if("manual_review")).first()
    pairs = lambda c: ", ".join(f"{k}={v}" for k, v in counted(assessed, c).items())
    head = ["# Contamination Quick Summary", "", f"- Assessed files: {totals[0]}", f"- Decision counts: {pairs('decision')}", f"- Triage buckets: {pairs('triage_bucket')}", f"- Manual review files: {totals[2]}", f"- Total removable sentences: {totals[1]}"]
    lines = spark.createDataFrame([(0, i, "", x) for i, x in enumerate(head)], "part int, place int, name string, value string")
    removed = [F.lit("removable="), F.col("removable_sentences").cast("string")]
    review = [F.lit(", review="), F.col("review_sentences").cast("string")]
    decision = [F.lit("decision="), F.col("decision"), F.lit(", ")]
    few = "decision = 'REMOVE_SENTENCE' and removable_sentences <= 2 and not manual_review"
    most = assessed.where("removable_sentences > 0").orderBy(F.desc("removable_sentences"), "filename").limit(top)
    parts = [("Auto Remove (REMOVE_FILE)", assessed.where("decision = 'REMOVE_FILE'"), [*removed, *review]), ("Single Sentence Candidates", assessed.where(few), [*removed, *review]), ("Manual Review Queue", assessed.where("manual_review"), [*decision, *removed, *review]), ("Top Files By Removable Sentence Count", most, [*decision, *removed, *review])]
    for k, (title, rows, words) in enumerate(parts, 1):
        place = -F.col("removable_sentences").cast("int") if rows is most else F.lit(0)
        heads = spark.createDataFrame([(k, -(2**31), "0", ""), (k, -(2**31), "1", f"## {title}")], lines.schema)
        lines = lines.unionByName(heads).unionByName(rows.select(F.lit(k).alias("part"), place.alias("place"), F.col("filename").alias("name"), F.concat(F.lit("- "), "filename", F.lit(": "), *words).alias("value")))
    return lines.orderBy("part", "place", "name").select("value")


def review_package(assessed: DataFrame, found: DataFrame, folder: str, mode: str = "errorifexists") -> dict:
    """The review's artefacts, each in its own folder; returns the run summary, which is one of them. assessed: the columns
    of FILE_SUMMARY and triage_bucket; found: findings with filename."""
    spark = assessed.sparkSession
    csv(assessed.select(*FILE_SUMMARY).orderBy("filename"), f"{folder}/file_summary", mode=mode)
    joined = found.join(assessed.select("filename", "decision", "manual_review"), "filename")
    rows = joined.select("filename", "decision", "manual_review", F.col("label").alias("sentence_label"), F.col("action").alias("sentence_action"), "reason", F.array_join("triggers", " | ").alias("triggers"), "sentence_text", "start")
    csv(rows.orderBy("filename", "start").select(*FINDINGS), f"{folder}/sentence_findings", mode=mode)
    csv(assessed.where("manual_review").select(*REVIEW_QUEUE).orderBy("filename"), f"{folder}/manual_review_queue", mode=mode)
    csv(assessed.select(*TRIAGE).orderBy("filename"), f"{folder}/triage_buckets", mode=mode)
    one = F.struct("start", F.col("sentence_text").alias("sentence"), "label", "action", "reason", "triggers")
    lists = found.groupBy("filename").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x.dropFields("start")).alias("findings"))
    none = F.array().cast(dict(lists.dtypes)["findings"])
    assessed.select(*FILE_SUMMARY).join(lists, "filename", "left").withColumn("findings", F.coalesce("findings", none)).write.mode(mode).json(f"{folder}/decisions")
    quick_summary(assessed).write.mode(mode).text(f"{folder}/quick_summary")
    n, removable, review = assessed.agg(F.count("*"), F.coalesce(F.sum("removable_sentences"), F.lit(0)), F.count_if("manual_review")).first()
    paths = {k: f"{folder}/{k}" for k in ("file_summary", "sentence_findings", "manual_review_queue", "triage_buckets", "quick_summary", "decisions")}
    summary = {"assessed_files": n, "decision_counts": counted(assessed, "decision"), "triage_counts": counted(assessed, "triage_bucket"), "manual_review_files": review, "total_removed_sentences": removable, "paths": paths}
    document(spark, manifest(summary), f"{folder}/run_summary", mode)
    return summary


def markdown(rows: DataFrame, title: str, limit: int = 1000, level: int = 2) -> str:
    """A small result as a Markdown table; more rows than the limit are an error, not cut."""
    data = rows.limit(limit + 1).collect()
    if len(data) > limit:
        raise ValueError(f"more than {limit} rows: not a report")
    text = lambda v: "" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    return "\n".join(["#" * level + f" {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns), *("| " + " | ".join(text(v) for v in r) + " |" for r in data)]) + "\n"


def report(title: str, sections: Sequence[tuple[str, DataFrame | str]], limit: int = 1000) -> str:
    """A Markdown report of sections, each a small table or a paragraph; one without rows says so."""
    out = [f"# {title}\n"]
    for name, body in sections:
        if isinstance(body, str):
            out.append(f"## {name}\n\n{body}\n")
        else:
            out.append(markdown(body, name, limit) if not body.isEmpty() else f"## {name}\n\nNo rows.\n")
    return "\n".join(out)


def cleaned_tree(df: DataFrame, path: str, mode: str = "errorifexists", partition: str | None = None) -> None:
    """Cleaned or quarantined documents, keyed by their relative path."""
    w = df.write.mode(mode)
    (w.partitionBy(partition) if partition else w).parquet(path)


def cleaning_report(cleaned: DataFrame, folder: str, mode: str = "errorifexists") -> dict:
    """Rows of CLEANING as CSV and as JSON lines, and their totals as a document; returns the totals. Texts are cleaned once:
    what is sorted, written and added up are the counts."""
    rows = written(cleaned.select(*CLEANING))
    csv(rows.orderBy("relative_path"), f"{folder}/rows_csv", mode=mode)
    rows.write.mode(mode).json(f"{folder}/rows")
    totals = rows.agg(F.count("*").alias("files"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in CLEANING[1:]]).first().asDict()
    document(cleaned.sparkSession, manifest(totals), f"{folder}/totals", mode)
    return totals


def token_stream(blocks: DataFrame, folder: str, fingerprint: str, **facts) -> bool:
    """Writes blocks and then a manifest with the fingerprint and the facts. Returns False, writing nothing, if a manifest
    of the same fingerprint says that they are there. The manifest comes last, so a run that fails leaves none that holds."""
    spark = blocks.sparkSession
    if (read_manifest(spark, f"{folder}/manifest") or {}).get("fingerprint") == fingerprint:
        return False
    document(spark, manifest({}), f"{folder}/manifest", "overwrite")
    blocks.write.mode("overwrite").parquet(f"{folder}/blocks")
    document(spark, manifest({"fingerprint": fingerprint} | facts), f"{folder}/manifest", "overwrite")
    return True


def run_folder(spark: SparkSession, root: str, name: str, time: str, config: dict) -> str:
    """A new folder under root for a run, named by its time and name, with a number where that is taken; it has a copy of
    the config. The name is one that run_name() made."""
    k, path = 1, f"{root.rstrip('/')}/{time}_{name}"
    while path_glob(spark, path if k == 1 else f"{path}_{k}"):
        k += 1
    path = path if k == 1 else f"{path}_{k}"
    document(spark, manifest(config), f"{path}/config")
    return path


def metrics(df: DataFrame, folder: str) -> None:
    """Appends rows of METRICS (val_loss may be null) as JSON lines and as CSV."""
    rows = df.select(*METRICS)
    rows.write.mode("append").json(f"{folder}/metrics")
    csv(rows, f"{folder}/metrics_csv", mode="append")


def samples(df: DataFrame, folder: str) -> None:
    """Appends generated samples (step, prompt, generated_text) as text, one entry for each."""
    entry = F.concat(F.lit("step: "), F.col("step").cast("string"), F.lit("\nprompt: "), F.coalesce("prompt", F.lit("")), F.lit("\ngenerated:\n"), F.coalesce("generated_text", F.lit("")), F.lit("\n" + "=" * 80))
    df.orderBy("step").select(entry.alias("value")).write.mode("append").text(f"{folder}/samples")


def candidates_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Candidate books in the order of their numeric ids; ids that aren't numbers come last."""
    csv(df.orderBy(F.col("book_id").try_cast("bigint").asc_nulls_last(), "book_id"), path, CANDIDATES, mode)


def file_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size) of all files under a folder, by relative path. Contents aren't read."""
    root = path_glob(spark, folder)
    if len(root) != 1:
        raise FileNotFoundError(folder)
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root[0])
    return d.select(F.substring("path", F.lit(len(root[0]) + 2), F.length("path")).alias("path"), F.col("length").alias("size")).orderBy("path")


def size_report(spark: SparkSession, folder: str, path: str, mode: str = "errorifexists") -> None:
    """file_sizes as tab-separated lines without a header."""
    csv(file_sizes(spark, folder), path, mode=mode, sep="\t", header=False)

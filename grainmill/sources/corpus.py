"""Text corpora, prompts, registries and CSV inputs as DataFrames.

Empty files are empty texts and give no lines; empty folders give no rows. A file that several patterns name is read once; rows that
repeat stay, but for last_per_id, which keeps the last of an id in the order given (of rows that tie there, any one). Null cells stay
null."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T
from ..operators.reports import report_hits


def path_glob(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a glob finds in any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(s.getPath().toString() for s in found or [])


def text_files(spark: SparkSession, folders: Sequence[str], glob: str = "*.txt", recursive: bool = False) -> DataFrame:
    """(corpus, path, name, content): files of folders in argument order. Nothing found is an error."""
    parts = []
    for i, folder in enumerate(folders):
        d = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(folder)
        parts.append(d.select(F.lit(i).alias("corpus"), "path", F.element_at(F.split("path", "/"), -1).alias("name"), "content", "length", "modificationTime"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if out.isEmpty():
        raise FileNotFoundError(f"no {glob} in {', '.join(folders)}")
    return out


@F.pandas_udf(StringType())
def _dropping_invalid(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))


def decode_utf8(content: Column) -> Column:
    """UTF-8 without invalid bytes, with LF line ends. Only invalid contents go through Python."""
    valid = F.is_valid_utf8(content.cast("string"))
    return T.newlines(F.when(valid, content.cast("string")).otherwise(_dropping_invalid(F.when(~valid, content))))


def decode_any(content: Column, charset: Column) -> Column:
    """The given charset if it decodes, else UTF-8 (a byte-order mark goes), else Latin-1, which always does."""

    @F.pandas_udf("string")
    def cascade(b: pd.Series, cs: pd.Series) -> pd.Series:
        def one(raw, name):
            if raw is None:
                return None
            for c in [name, "utf-8", "utf-8-sig", "latin-1"]:
                try:
                    return bytes(raw).decode(c) if c else 1 / 0
                except (UnicodeDecodeError, LookupError, ZeroDivisionError):
                    continue

        return pd.Series([one(x, y) for x, y in zip(b, cs)])

    return cascade(content, charset)


def documents(spark: SparkSession, folders: Sequence[str], glob: str = "*.txt", recursive: bool = False) -> DataFrame:
    """(doc_pos, corpus, path, name, text) of files with text: by folder, then path. doc_pos orders; it isn't dense."""
    d = text_files(spark, folders, glob, recursive).select("corpus", "path", "name", decode_utf8(F.col("content")).alias("text"))
    return d.where(T.strip(F.col("text")) != "").withColumn("doc_pos", F.struct("corpus", "path"))


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """Question and answer blocks of a file: stretches between blank lines."""
    return spark.read.option("lineSep", "\n\n").text(path).select(F.trim("value").alias("block")).where("block <> ''")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, value) of text files. line_no orders a file's lines: the start of the split that a line was read
    from, then the line's place there, so that a large file is read by many tasks. It isn't dense."""
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), place.alias("line_no"), "value")


def prompts(spark: SparkSession, files: dict[str, str], cap: int | None = None) -> DataFrame:
    from ..operators.grids import number_prompts

    out = None
    for category, path in files.items():
        d = numbered_lines(spark, path).withColumn("category", F.lit(category))
        out = d if out is None else out.unionByName(d)
    return number_prompts(out, "value", "category", "line_no", cap)


def model_registry(spark: SparkSession, text: str) -> DataFrame:
    """(model_id, checkpoint_path) of a JSON object of strings."""
    models = json.loads(text)
    if not isinstance(models, dict) or not models or not all(isinstance(v, str) and v for v in models.values()):
        raise ValueError("the registry must be a JSON object of non-empty strings")
    return spark.createDataFrame(sorted(models.items()), "model_id string, checkpoint_path string")


def config(text: str, overrides: Sequence[str] = ()) -> dict:
    """A JSON config with dotted key=value overrides; values are JSON or else plain strings."""
    out = json.loads(text)
    if not isinstance(out, dict):
        raise ValueError("the config must be a JSON object")
    for item in overrides:
        key, eq, value = item.partition("=")
        if not eq:
            raise ValueError(f"override without =: {item}")
        at = out
        *path, last = key.split(".")
        for k in path:
            at = at.setdefault(k, {})
        try:
            at[last] = json.loads(value)
        except ValueError:
            at[last] = value
    return out


def csv_rows(spark: SparkSession, paths: Sequence[str], required: Sequence[str], multi_line: bool = True) -> DataFrame:
    """CSV files with a header, quoted line feeds and doubled quotes; missing columns are an error. multi_line: values may
    have line feeds, for which a file is read by one task; without, large files are split."""
    d = spark.read.option("header", "true").option("multiLine", str(multi_line).lower()).option("escape", '"').csv(list(paths))
    if missing := sorted(set(required) - set(d.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return d


def last_per_id(df: DataFrame, id_col: str, order: str) -> DataFrame:
    """Canonical ids; blank ones go; the last row of an id stays."""
    d = df.withColumn(id_col, T.first_id(F.col(id_col))).where(F.col(id_col) != "")
    rest = [c for c in d.columns if c != id_col]
    return d.groupBy(id_col).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(id_col, "__r.*")


def qualifying_books(df: DataFrame) -> DataFrame:
    """(book_id, death_year, extent): last row of an id, with a death year."""
    d = df.withColumn("death_year", T.signed_or_null(F.col("death_year"))).withColumn("extent", T.signed_or_null(F.col("extent")))
    return last_per_id(d, "book_id", "line_no").where("death_year is not null").select("book_id", "death_year", "extent")


def priority_ids(df: DataFrame, order: str = "line_no") -> DataFrame:
    """(id, pos): ids of the column book_id, else of the first one, each at its first place."""
    col = "book_id" if "book_id" in df.columns else next(c for c in df.columns if c != order)
    return df.select(T.first_id(F.col(col)).alias("id"), order).where("id <> ''").groupBy("id").agg(F.min(order).alias("pos"))


def decision_list(lines: DataFrame, text: str = "value") -> DataFrame:
    """(filename): the first *.txt token of each line."""
    name = F.regexp_extract(text, r"(?i)([A-Za-z0-9_.-]+\.txt)\b", 1)
    return lines.select(name.alias("filename")).where("filename <> ''").distinct()


def load_or_build(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at path, or what build() returns, written there first."""
    if not path_glob(spark, path):
        build().write.parquet(path)
    return spark.read.parquet(path)


def report_lines(lines: DataFrame, corpus: str, report: str, order: str = "line_no", text: str = "value") -> DataFrame:
    """A contamination report as (filename, matches, patterns, report_type) of one corpus. Sections set the corpus and the
    pattern; a separator or summary resets the pattern; Regex counts only where no pattern is set."""
    found = report_hits(lines, corpus, order, text).select("filename", "n", F.coalesce("pattern", F.lit("")).alias("pattern"))
    sums = found.groupBy("filename", "pattern").agg(F.sum("n").alias("n"))
    patterns = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("pattern") != "", F.struct("pattern", "n")))))
    return sums.groupBy("filename").agg(F.sum("n").alias("matches"), patterns.alias("patterns")).withColumn("report_type", F.lit(report))

"""Book metadata in RDF/XML through Spark's XML reader, one row for each file.

A file that can't be read as XML, and an empty one, gives no book; a book that several files hold has a row for each; of formats
that tie, the one of the larger address is taken. Missing elements are null or empty lists; an empty folder gives no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.selection import best_format

VALUE = "struct<`rdf:value`:string,`rdf:Description`:struct<`rdf:value`:string>>"
FILE = f"struct<`_rdf:about`:string,`dcterms:format`:array<{VALUE}>,`dcterms:extent`:string>"
AGENT = "struct<`_rdf:about`:string,`pgterms:name`:string,`pgterms:deathdate`:string>"
SCHEMA = (
    f"`pgterms:ebook` array<struct<`_rdf:about`:string,`dcterms:title`:string,`dcterms:language`:array<{VALUE}>,`dcterms:subject`:array<{VALUE}>,`pgterms:bookshelf`:array<{VALUE}>,"
    f"`dcterms:creator`:array<struct<`_rdf:resource`:string,`pgterms:agent`:{AGENT}>>,`dcterms:hasFormat`:array<struct<`_rdf:resource`:string,`pgterms:file`:array<{FILE}>>>>>,"
    f"`pgterms:file` array<{FILE}>,`pgterms:agent` array<{AGENT}>"
)


def value(node: Column) -> Column:
    """The first non-empty value, direct or under a description."""
    clean = lambda c: F.nullif(T.strip(c), F.lit(""))
    return F.coalesce(clean(node["rdf:value"]), clean(node["rdf:Description"]["rdf:value"]))


def values(nodes: Column, lower: bool = False) -> Column:
    out = F.array_compact(F.transform(F.coalesce(nodes, F.array().cast(f"array<{VALUE}>")), value))
    return F.transform(out, F.lower) if lower else out


def books(spark: SparkSession, path: str, needs_url: bool = True, glob: str = "*.[rR][dD][fF]") -> DataFrame:
    """book_id, title, languages, subjects, bookshelves, death_year and formats of each file that parses. Unused columns
    are pruned, nested ones too. needs_url: formats without a url go."""
    raw = spark.read.format("xml").schema(SCHEMA).option("rowTag", "rdf:RDF").option("mode", "DROPMALFORMED").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    d = raw.select(F.try_element_at("pgterms:ebook", F.lit(1)).alias("e"), F.col("pgterms:file").alias("files"), F.col("pgterms:agent").alias("agents"), F.col("_metadata.file_name").alias("file")).where("e is not null")
    none = F.array().cast(f"array<{FILE}>")
    about = lambda x: T.strip(x["_rdf:about"])
    inline = lambda h: F.when(F.size(F.coalesce(h["pgterms:file"], none)) > 0, h["pgterms:file"]).otherwise(F.filter(F.coalesce(F.col("files"), none), lambda f: about(f) == T.strip(h["_rdf:resource"])))
    nodes = F.flatten(F.transform(F.coalesce(F.col("e.`dcterms:hasFormat`"), F.array().cast(f"array<struct<`_rdf:resource`:string,`pgterms:file`:array<{FILE}>>>")), inline))
    extent = lambda f: T.count_or_zero(f["dcterms:extent"]) if needs_url else T.signed_or_null(f["dcterms:extent"])
    formats = F.transform(nodes, lambda f: F.struct(T.strip(F.coalesce(f["_rdf:about"], F.lit(""))).alias("url"), F.lower(F.try_element_at(values(f["dcterms:format"]), F.lit(-1))).alias("mime"), extent(f).alias("extent")))
    formats = F.filter(formats, lambda f: F.coalesce(f["mime"], F.lit("")).__ne__("") & (F.lit(not needs_url) | (f["url"] != "")))
    agent = lambda c: F.coalesce(c["pgterms:agent"], F.try_element_at(F.filter(F.coalesce(F.col("agents"), F.array().cast(f"array<{AGENT}>")), lambda a: (about(a) == T.strip(c["_rdf:resource"])) | (T.first_id(about(a)) == T.first_id(c["_rdf:resource"]))), F.lit(1)))
    years = F.array_compact(F.transform(F.coalesce(F.col("e.`dcterms:creator`"), F.array().cast(f"array<struct<`_rdf:resource`:string,`pgterms:agent`:{AGENT}>>")), lambda c: T.signed_or_null(agent(c)["pgterms:deathdate"])))
    book_id = F.coalesce(F.nullif(T.first_id(F.col("e.`_rdf:about`")), F.lit("")), F.nullif(T.first_id(F.regexp_replace("file", r"\.[^.]*$", "")), F.lit("")))
    out = d.select(book_id.alias("book_id"), T.strip(F.coalesce(F.col("e.`dcterms:title`"), F.lit(""))).alias("title"), values(F.col("e.`dcterms:language`"), lower=True).alias("languages"), values(F.col("e.`dcterms:subject`")).alias("subjects"), values(F.col("e.`pgterms:bookshelf`")).alias("bookshelves"), F.array_min(years).cast("int").alias("death_year"), formats.alias("formats"))
    return out.where("book_id is not null")


def candidates(found: DataFrame, filters: bool = True) -> DataFrame:
    """(book_id, title, url, charset, extent): English books without science words that have a plain text; the best
    format of each id."""
    d = found
    if filters:
        words = F.concat_ws(" ", "title", F.array_join("subjects", " "), F.array_join("bookshelves", " "))
        from ..functions.lexicons import SCIENCE

        d = d.where(T.is_english(F.col("languages")) & ~T.has_any(words, SCIENCE))
    d = d.withColumn("b", best_format(F.col("formats"))).where("b is not null")
    one = d.groupBy("book_id").agg(F.max_by(F.struct("title", "b"), "b").alias("r")).select("book_id", "r.*")
    return one.select("book_id", "title", "b.url", T.mime_parts(F.col("b.mime"))["charset"].alias("charset"), "b.extent")

"""Queries over sources and sinks: tables are written to the shared folder, read back by the reader, and compared with
the tables themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import attempts as A
from ..operators import cleaning as C
from ..operators import contamination as R
from ..operators import evaluation as E
from ..operators import grids as G
from ..operators import judging as J
from ..operators import packing as P
from ..operators.shared import new_path
from ..sources import corpus as SRC
from ..sources import jsonl as JL
from ..sources import rdf as RDF
from ..sources import sinks as K
from ..sources.stream import read_stream, update_stream, write_stream
from .base import JUDGED_SQL, judged, query, table
from .corpus import COUNTS_SQL, assessed
from .tokens import TOKENS, token_blocks, tokens


def _files(df, key: str, text: str) -> str:
    """A folder of text files, one for each key."""
    path = new_path(df.sparkSession)
    df.select(key, F.col(text).alias("value")).write.partitionBy(key).text(path)
    return path


def _id_of(key: str):
    return F.regexp_extract("path", rf"{key}=(\d+)", 1).cast("bigint").alias(key)


@query("text_files", r"SELECT item_id, concat(text, chr(10)) AS text, length(text) + 1 AS n FROM benchmark WHERE length(trim(text)) > 0")
def text_files(spark, d):
    folder = _files(table(spark, d, "benchmark"), "item_id", "text")
    return SRC.documents(spark, [folder], "*.txt", recursive=True).select(_id_of("item_id"), "text", F.length("text").cast("bigint").alias("n"))


@query("text_blocks", "SELECT n_name AS block FROM nation UNION ALL SELECT r_name FROM region")
def text_blocks(spark, d):
    names = table(spark, d, "nation").select("n_name").union(table(spark, d, "region").select("r_name"))
    path = new_path(spark)
    names.select(F.concat(F.lit("\n"), F.col("n_name"), F.lit("\n")).alias("value")).coalesce(1).write.text(path)
    return SRC.blocks(spark, path).select(F.trim(F.regexp_replace("block", "\n", "")).alias("block")).where("block <> ''")


@query("prompt_files", "SELECT printf('nation_%03d', CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INT)) AS prompt_id, n_name AS prompt_text FROM nation QUALIFY row_number() OVER (ORDER BY n_nationkey) <= 20")
def prompt_files(spark, d):
    path = new_path(spark)
    table(spark, d, "nation").orderBy("n_nationkey").select(F.concat((F.col("n_nationkey") + 1).cast("string"), F.lit(". "), "n_name").alias("value")).coalesce(1).write.text(path)
    return SRC.prompts(spark, {"nation": path}, 20).select("prompt_id", "prompt_text")


@query("csv_last_per_id", "SELECT CAST(o_custkey AS VARCHAR) AS book_id, CAST(arg_max(o_orderkey, o_orderkey) AS VARCHAR) AS extent, CAST(max(o_orderkey) AS BIGINT) AS line_no FROM orders GROUP BY o_custkey")
def csv_last_per_id(spark, d):
    path = new_path(spark)
    rows = table(spark, d, "orders").select(F.concat(F.lit("ebooks/00"), F.col("o_custkey").cast("string"), F.lit(", \"x\"\n")).alias("book_id"), F.col("o_orderkey").cast("string").alias("extent"), F.col("o_orderkey").alias("line_no"))
    K.csv(rows, path)
    back = SRC.csv_rows(spark, [path], ["book_id", "extent"]).withColumn("line_no", F.col("line_no").cast("bigint"))
    return SRC.last_per_id(back, "book_id", "line_no")


@query("qualifying_books", "SELECT CAST(s_suppkey AS VARCHAR) AS book_id, CAST(-s_suppkey AS BIGINT) AS death_year, CAST(1000 + s_suppkey % 9 AS BIGINT) AS extent FROM supplier WHERE s_suppkey % 4 <> 0 AND s_suppkey > 0")
def qualifying_books(spark, d):
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").where("s_suppkey > 0").select(k.cast("string").alias("book_id"), F.when(k % 4 != 0, F.concat(F.lit("-"), k.cast("string"))).alias("death_year"), F.concat(F.lit("1,00"), (k % 9).cast("string")).alias("extent"), k.alias("line_no"))
    path = new_path(spark)
    K.csv(rows, path)
    return SRC.qualifying_books(SRC.csv_rows(spark, [path], ["book_id", "death_year"]).withColumn("line_no", F.col("line_no").cast("bigint")))


@query("priority_list", "SELECT CAST(o_custkey AS VARCHAR) AS id, CAST(min(o_orderkey) AS BIGINT) AS pos FROM orders WHERE o_custkey > 0 GROUP BY o_custkey")
def priority_list(spark, d):
    rows = table(spark, d, "orders").where("o_custkey > 0").select(F.col("o_custkey").cast("string").alias("book_id"), F.col("o_orderkey").alias("line_no"))
    return SRC.priority_ids(rows)


@query("decision_list", "SELECT DISTINCT concat('b_', l_suppkey, '.txt') AS filename FROM lineitem WHERE l_linenumber = 1")
def decision_list(spark, d):
    lines = table(spark, d, "lineitem").select(F.when(F.col("l_linenumber") == 1, F.concat(F.lit("- [x] b_"), F.col("l_suppkey").cast("string"), F.lit(".txt: remove, see other.txt"))).otherwise("nothing here").alias("value"))
    return SRC.decision_list(lines)


@query("model_registry", "SELECT n_name AS model_id, concat('runs/', n_regionkey, '/', n_nationkey) AS checkpoint_path FROM nation")
def model_registry(spark, d):
    """A registry file of all nations, written and read back."""
    rows = table(spark, d, "nation").select("n_name", F.concat_ws("/", F.lit("runs"), "n_regionkey", "n_nationkey").alias("p"))
    text = rows.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", "p"))))).first()[0]
    return SRC.model_registry(spark, text)


XML = """<?xml version="1.0"?><rdf:RDF xmlns:rdf="r" xmlns:dcterms="d" xmlns:pgterms="p"><pgterms:ebook rdf:about="ebooks/00%s"><dcterms:title> %s </dcterms:title><dcterms:language><rdf:Description><rdf:value>EN</rdf:value></rdf:Description></dcterms:language><dcterms:creator><pgterms:agent rdf:about="agents/1"><pgterms:deathdate>-%s</pgterms:deathdate></pgterms:agent></dcterms:creator><dcterms:hasFormat rdf:resource="u%s"/></pgterms:ebook><pgterms:file rdf:about="u%s"><dcterms:format><rdf:Description><rdf:value>text/plain; charset=UTF_8</rdf:value></rdf:Description></dcterms:format><dcterms:extent>1,00%s</dcterms:extent></pgterms:file></rdf:RDF>"""


def _books(spark, d):
    k = (F.col("n_nationkey") + 1).cast("string")
    rows = table(spark, d, "nation").select("n_nationkey", F.format_string(XML, k, F.col("n_name"), k, k, k, (F.col("n_nationkey") % 10).cast("string")).alias("xml"))
    return RDF.books(spark, _files(rows, "n_nationkey", "xml"), glob="*.txt")


@query("rdf_books", "SELECT CAST(n_nationkey + 1 AS VARCHAR) AS book_id, n_name AS title, 'en' AS languages, CAST(-(n_nationkey + 1) AS INT) AS death_year, concat('u', n_nationkey + 1) AS url, 'text/plain; charset=utf_8' AS mime, CAST(1000 + n_nationkey % 10 AS BIGINT) AS extent FROM nation")
def rdf_books(spark, d):
    b = _books(spark, d).select("book_id", "title", F.array_join("languages", ",").alias("languages"), "death_year", F.explode("formats").alias("f"))
    return b.select("book_id", "title", "languages", "death_year", "f.url", "f.mime", F.col("f.extent").cast("bigint").alias("extent"))


@query("rdf_candidates", "SELECT CAST(n_nationkey + 1 AS VARCHAR) AS book_id, n_name AS title, concat('u', n_nationkey + 1) AS url, 'utf-8' AS charset, CAST(1000 + n_nationkey % 10 AS VARCHAR) AS extent FROM nation")
def rdf_candidates(spark, d):
    """Candidates, written in the order of their ids and read back."""
    path = new_path(spark)
    K.candidates_csv(RDF.candidates(_books(spark, d)), path)
    return SRC.csv_rows(spark, [path], K.CANDIDATES)


@query("jsonl_rows", "SELECT conv_id, turn, role, length(text) AS n FROM conversations")
def jsonl_rows(spark, d):
    path = new_path(spark)
    K.jsonl(table(spark, d, "conversations"), path)
    rows = JL.parsed(JL.lines(spark, [f"base={path}"])).where("is_object and alias = 'base'")
    get = lambda k, t: F.try_variant_get("v", f"$.{k}", t).alias(k)
    return rows.select(get("conv_id", "bigint"), get("turn", "bigint"), get("role", "string"), F.length(F.try_variant_get("v", "$.text", "string")).cast("bigint").alias("n"))


@query("jsonl_errors", "SELECT 'judge' AS judge_model, 'invalid JSON object' AS judge_error, concat('{bad ', item_id) AS raw_line FROM benchmark")
def jsonl_errors(spark, d):
    path = new_path(spark)
    b = table(spark, d, "benchmark").select(F.concat(F.lit("{bad "), F.col("item_id").cast("string")).alias("value"))
    b.union(table(spark, d, "benchmark").select(F.to_json(F.struct("item_id")))).union(spark.createDataFrame([(" ",)], "value string")).write.text(path)
    return JL.error_rows(JL.lines(spark, [path]), "judge")


@query("summary_csv", f"""WITH {JUDGED_SQL} SELECT model_id, CAST(count(*) AS VARCHAR) AS n_judged, printf('%.6f', count(*) FILTER (quality_score >= 1) * CAST(1 AS DOUBLE) / count(*)) AS rate FROM judged WHERE usable GROUP BY model_id""")
def summary_csv(spark, d):
    """A report with fixed columns, floats with six places; an optional column that isn't there is left out."""
    rows = judged(spark, d).where("usable").groupBy("model_id").agg(F.count("*").alias("n_judged"), (F.count_if(F.col("quality_score") >= 1) / F.count("*")).alias("rate"))
    path = new_path(spark)
    K.csv(K.fixed(rows, ["model_id", "n_judged", "rate", "mention"], ["mention"]), path)
    return SRC.csv_rows(spark, [path], ["model_id"])


@query("dynamic_header", "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS place, n_name AS key, CAST(n_nationkey AS VARCHAR) AS id, 'x' || n_regionkey AS cell FROM nation")
def dynamic_header(spark, d):
    """A CSV whose columns are the keys of its rows, in the order in which rows have them first."""
    rows = table(spark, d, "nation").select("n_nationkey", F.create_map(F.lit("id"), F.col("n_nationkey").cast("string"), F.col("n_name"), F.concat(F.lit("x"), F.col("n_regionkey").cast("string"))).alias("fields"))
    path = new_path(spark)
    K.dynamic_csv(rows, "fields", "n_nationkey", path)
    back = SRC.csv_rows(spark, [path], ["id"])
    cells = [F.struct(F.lit(k).cast("bigint").alias("place"), F.lit(c).alias("key"), "id", F.col(f"`{c}`").alias("cell")) for k, c in enumerate(x for x in back.columns if x != "id")]
    return back.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where("cell is not null")


def _review(spark, d):
    """The review package of the lines query, and where it is."""
    a = assessed(spark, d).withColumn("filename", F.format_string("%08d.txt", "doc_id"))
    one = a.select("*", F.lit(0).cast("bigint").alias("exact_report_matches"), F.col("total_matched_sentences").alias("proximity_report_matches"), F.concat(F.lit("in/"), "filename").alias("path"))
    lines = table(spark, d, "documents").select(F.format_string("%08d.txt", "doc_id").alias("filename"), F.posexplode(F.split("text", "\n")).alias("start", "sentence_text")).where(F.contains("sentence_text", F.lit("tion")))
    action = F.when(F.contains("sentence_text", F.lit("enn")), "REMOVE").when(F.length("sentence_text") > 600, "REVIEW").otherwise("KEEP")
    found = lines.select("*", action.alias("action"), F.lit("X").alias("label"), F.lit("why").alias("reason"), F.array(F.lit("b"), F.lit("a, c")).alias("triggers"))
    folder = new_path(spark)
    return K.review_package(R.triage(one), found, folder), folder


@query("review_package", f"WITH {COUNTS_SQL} SELECT printf('%08d.txt', doc_id) AS filename, decision, CAST(manual_review AS VARCHAR) AS manual_review, CAST(total_matched_sentences AS VARCHAR) AS total_matched_sentences, CAST(removable_sentences AS VARCHAR) AS removable_sentences, triage_bucket, total_matched_sentences AS n_findings FROM tri")
def review_package(spark, d):
    """File summary, triage buckets and decisions, read back and joined."""
    _, folder = _review(spark, d)
    files = SRC.csv_rows(spark, [f"{folder}/file_summary"], K.FILE_SUMMARY).select("filename", "decision", "manual_review", "total_matched_sentences", "removable_sentences")
    buckets = SRC.csv_rows(spark, [f"{folder}/triage_buckets"], K.TRIAGE).select("filename", "triage_bucket")
    decisions = spark.read.json(f"{folder}/decisions").select("filename", F.size("findings").cast("bigint").alias("n_findings"))
    return files.join(buckets, "filename").join(decisions, "filename")


@query("review_findings", """SELECT printf('%08d.txt', doc_id) AS filename, line AS sentence_text, CASE WHEN contains(line, 'enn') THEN 'REMOVE' WHEN length(line) > 600 THEN 'REVIEW' ELSE 'KEEP' END AS sentence_action, 'b | a, c' AS triggers
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE contains(line, 'tion')""")
def review_findings(spark, d):
    _, folder = _review(spark, d)
    return SRC.csv_rows(spark, [f"{folder}/sentence_findings"], K.FINDINGS).select("filename", "sentence_text", "sentence_action", "triggers")


@query("review_summary", f"WITH {COUNTS_SQL} SELECT 'decision ' || decision AS k, count(*) AS n FROM tri GROUP BY decision UNION ALL SELECT 'bucket ' || triage_bucket, count(*) FROM tri GROUP BY triage_bucket UNION ALL SELECT 'removed', CAST(sum(removable_sentences) AS BIGINT) FROM tri UNION ALL SELECT 'review', count(*) FILTER (manual_review) FROM tri")
def review_summary(spark, d):
    _, folder = _review(spark, d)
    s = K.read_manifest(spark, f"{folder}/run_summary")
    rows = [(f"decision {k}", n) for k, n in s["decision_counts"].items()] + [(f"bucket {k}", n) for k, n in s["triage_counts"].items()]
    return spark.createDataFrame([*rows, ("removed", s["total_removed_sentences"]), ("review", s["manual_review_files"])], "k string, n bigint")


@query("quick_summary", f"WITH {COUNTS_SQL} SELECT printf('%08d.txt', doc_id) AS filename, removable_sentences AS removable, review_sentences AS review FROM tri WHERE decision = 'REMOVE_FILE'")
def quick_summary(spark, d):
    """The files that the written summary lists for removal."""
    _, folder = _review(spark, d)
    lines = SRC.numbered_lines(spark, f"{folder}/quick_summary").withColumn("part", F.last(F.when(F.startswith("value", F.lit("## ")), F.col("value")), ignorenulls=True).over(_in_file()))
    at = lambda i: F.regexp_extract("value", r"^- (\S+): removable=(\d+), review=(\d+)$", i)
    return lines.where("part = '## Auto Remove (REMOVE_FILE)' and value like '- %'").select(at(1).alias("filename"), at(2).cast("bigint").alias("removable"), at(3).cast("bigint").alias("review"))


def _in_file():
    from pyspark.sql import Window

    return Window.partitionBy("path").orderBy("line_no")


@query("cleaned_tree", "SELECT doc_id, lang, text FROM documents")
def cleaned_tree(spark, d):
    """Documents under their relative paths; a second write without leave is an error."""
    path = new_path(spark)
    K.cleaned_tree(table(spark, d, "documents").select("doc_id", "lang", "text"), path, partition="lang")
    try:
        K.output_mode(spark, path)
    except FileExistsError:
        return spark.read.parquet(path).select("doc_id", "lang", "text")
    raise AssertionError("an existing path was taken for free")


@query("cleaning_files", "SELECT concat(doc_id, '.txt') AS relative_path, CAST(length(text) AS VARCHAR) AS chars_before FROM documents UNION ALL SELECT 'totals', CAST(CAST(sum(length(text)) AS BIGINT) AS VARCHAR) FROM documents")
def cleaning_files(spark, d):
    """Rows and totals of the cleaning report as they are on disk."""
    docs = table(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("relative_path"), "text")
    folder = new_path(spark)
    K.cleaning_report(C.clean(docs, "text"), folder)
    rows = SRC.csv_rows(spark, [f"{folder}/rows_csv"], K.CLEANING).select("relative_path", "chars_before")
    total = K.read_manifest(spark, f"{folder}/totals")["chars_before"]
    return rows.union(spark.createDataFrame([("totals", str(total))], "relative_path string, chars_before string"))


@query("token_stream", f"WITH {TOKENS}, st AS (SELECT id, row_number() OVER (ORDER BY doc_id, i) - 1 AS p FROM (SELECT doc_id, unnest(ids) AS id, unnest(range(len(ids))) AS i FROM tok)) SELECT CAST(p // 1024 AS BIGINT) AS block_id, CAST(sum(id) AS BIGINT) AS total, true AS first, false AS again FROM st GROUP BY 1 HAVING count(*) = 1024")
def token_stream(spark, d):
    """Blocks written behind a fingerprint: the second call with the same one writes nothing."""
    folder, blocks = new_path(spark), token_blocks(spark, d)
    files = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("size"), F.lit(0).alias("mtime"))
    print_ = P.fingerprint(files, "1024")
    first, again = K.token_stream(blocks, folder, print_, length=1024), K.token_stream(blocks, folder, P.fingerprint(files.orderBy("size"), "1024"), length=1024)
    total = F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total")
    return spark.read.parquet(f"{folder}/blocks").select("block_id", total, F.lit(first).alias("first"), F.lit(again).alias("again"))


@query("stream_blocks", f"WITH {TOKENS}, st AS (SELECT id, row_number() OVER (ORDER BY doc_id, i) - 1 AS p FROM (SELECT doc_id, unnest(ids) AS id, unnest(range(len(ids))) AS i FROM tok)), cut AS (SELECT id, p - 5000 AS p FROM st WHERE p >= 5000) SELECT CAST(p // 1000 AS BIGINT) AS block_id, CAST(sum(id) AS BIGINT) AS total, CAST(arg_min(id, p) AS INT) AS first_id, CAST(arg_max(id, p) AS INT) AS last_id FROM cut GROUP BY 1 HAVING count(*) = 1000")
def stream_blocks(spark, d):
    """All documents as one flat stream, read in blocks from its 5,000th token on."""
    path = new_path(spark)
    write_stream(tokens(spark, d), "ids", ["doc_id"], path)
    b = read_stream(spark, path, 1000, start=5000)
    total = F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total")
    return b.select("block_id", total, F.get("ids", F.lit(0)).alias("first_id"), F.get("ids", F.lit(999)).alias("last_id"))


@query("updated_stream", f"WITH {TOKENS}, st AS (SELECT id, row_number() OVER (ORDER BY doc_id, i) - 1 AS p FROM (SELECT doc_id, unnest(ids) AS id, unnest(range(len(ids))) AS i FROM tok)) SELECT CAST(p // 1000 AS BIGINT) AS block_id, CAST(sum(id) AS BIGINT) AS total, CAST(arg_max(id, p) AS INT) AS last_id, true AS some_stayed FROM st GROUP BY 1 HAVING count(*) = 1000")
def updated_stream(spark, d):
    """A stream of all documents of which the last one changed since: the parts in front of it stay."""
    path, docs = new_path(spark), tokens(spark, d).withColumn("path", F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    files = docs.select("path", F.sha2(F.array_join(F.transform("ids", lambda x: x.cast("string")), " "), 256).alias("mark"))
    last = files.agg(F.max("path")).first()[0]
    before = files.withColumn("mark", F.when(F.col("path") == last, "older").otherwise(F.col("mark")))
    encode = lambda behind: behind.join(docs.select("path", "ids"), "path")
    update_stream(before, "path", "mark", path, encode, parts=8)
    stayed = update_stream(files, "path", "mark", path, encode, parts=8)
    total = F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total")
    return read_stream(spark, path, 1000).select("block_id", total, F.get("ids", F.lit(999)).alias("last_id"), F.lit(stayed > 0).alias("some_stayed"))


LOG_SQL = "SELECT event_id AS step, event_id // 100 AS epoch, CAST(value AS DOUBLE) AS train_loss, CASE WHEN event_id % 10 = 0 THEN CAST(value AS DOUBLE) / 2 END AS val_loss FROM events"


def _log(spark, d):
    e = table(spark, d, "events")
    val = F.when(F.col("event_id") % 10 == 0, F.col("value") / 2).alias("val_loss")
    return e.select(F.col("event_id").alias("step"), F.expr("event_id div 100").alias("epoch"), F.col("value").cast("double").alias("train_loss"), val, F.lit(0.001).alias("learning_rate"), (F.col("event_id") * 32).alias("tokens_processed"), F.lit(1.5).alias("time_elapsed"))


@query("metrics_log", f"SELECT step, round(train_loss, 6) AS train_loss, round(val_loss, 6) AS val_loss, 2 AS copies FROM ({LOG_SQL})")
def metrics_log(spark, d):
    """A training log appended to twice, as JSON lines and as CSV."""
    folder = K.run_folder(spark, new_path(spark), "my-run", "20240102-030405", {"seed": 1})
    K.metrics(_log(spark, d), folder)
    K.metrics(_log(spark, d), folder)
    rows = spark.read.schema("step bigint, train_loss double, val_loss double").json(f"{folder}/metrics").groupBy("step").agg(F.max("train_loss").alias("a"), F.max("val_loss").alias("b"), F.count("*").cast("int").alias("copies"))
    table_ = SRC.csv_rows(spark, [f"{folder}/metrics_csv"], K.METRICS).groupBy(F.col("step").cast("bigint").alias("step")).agg(F.max(F.col("train_loss").cast("double")).alias("train_loss"), F.max(F.col("val_loss").cast("double")).alias("val_loss"))
    same = F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("train_loss", F.lit(0.0))) < 1e-5
    return rows.join(table_, "step").where(same).select("step", F.round("train_loss", 6).alias("train_loss"), F.round("val_loss", 6).alias("val_loss"), "copies")


@query("mean_loss", f"SELECT epoch, count(train_loss) AS steps, round(avg(train_loss), 6) AS mean_loss FROM ({LOG_SQL}) GROUP BY epoch")
def mean_loss(spark, d):
    return E.mean_loss(_log(spark, d), "epoch", loss="train_loss").withColumn("mean_loss", F.round("mean_loss", 6))


@query("size_files", "SELECT item_id, octet_length(encode(text)) + 1 AS size FROM benchmark")
def size_files(spark, d):
    """Sizes of files by relative path, through the tab-separated report."""
    folder, path = _files(table(spark, d, "benchmark"), "item_id", "text"), new_path(spark)
    K.size_report(spark, folder, path)
    rows = spark.read.option("sep", "\t").schema("path string, size bigint").csv(path).where("path like '%.txt'")
    return rows.select(_id_of("item_id"), "size")


@query("next_tasks", "SELECT b.item_id AS prompt_id, CAST(k.k AS INT) AS sample_id FROM benchmark b, range(3) k(k) WHERE b.item_id % 2 = 1 ORDER BY 1, 2 LIMIT 25")
def next_tasks(spark, d):
    """The next tasks of a resumed run: done ones don't count for the limit."""
    tasks = table(spark, d, "benchmark").select(F.col("item_id").alias("prompt_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("sample_id"))
    return G.not_done(tasks, tasks.where("prompt_id % 2 = 0"), ["prompt_id", "sample_id"], most=25)


@query("capped_shuffle", "SELECT doc_id FROM documents ORDER BY sha256(concat('1337|', doc_id)) LIMIT 50")
def capped_shuffle(spark, d):
    return P.shuffled_positions(table(spark, d, "documents").select("doc_id"), F.col("doc_id"), most=50).select("doc_id")


@query("judge_requests", r"SELECT conv_id, turn, concat('Rate it.', chr(10), chr(10), 'PROMPT:', chr(10), role, chr(10), chr(10), 'COMPLETION:', chr(10), text) AS request FROM conversations")
def judge_requests(spark, d):
    return J.requests(table(spark, d, "conversations"), "Rate it.", "role", "text").select("conv_id", "turn", "request")


@query("flattened", "SELECT doc_id, quality AS quality_score, CASE WHEN toxic = 1 THEN 'geocentric' ELSE 'top' END AS stance FROM labels")
def flattened(spark, d):
    """A nested result wins; the row's own field fills its gaps."""
    inner = F.struct(F.col("quality").alias("quality_score"), F.when(F.col("toxic") == 1, "geocentric").alias("stance"))
    rows = table(spark, d, "labels").select("doc_id", inner.alias("judge_result"), F.lit("top").alias("stance"), F.lit(None).cast("int").alias("quality_score"))
    return J.flatten(rows, "judge_result", ["quality_score", "stance"]).select("doc_id", "quality_score", "stance")


@query("run_names", "SELECT item_id, concat('run-', item_id) AS name, printf('%.2f%%', 100 * (item_id % 17) / 16) AS percent, printf('%.6f', (item_id % 17) / 16) AS decimal FROM benchmark")
def run_names(spark, d):
    from ..functions import stats as S

    rate = F.col("item_id") % 17 / 16
    name = T.run_name(F.concat(F.lit(" --run !"), F.col("item_id").cast("string"), F.lit(" . ")))
    return table(spark, d, "benchmark").select("item_id", name.alias("name"), S.percent(rate).alias("percent"), S.decimal6(rate).alias("decimal"))


def _answer(request: str, attempt: int) -> str:
    """An outer service that fails for some: for a while, always, or for good."""
    n = int(request.split()[-1])
    if n % 7 == 3:
        raise ValueError("refused")
    if n % 9 == 0 or n % 4 == 0 and attempt < 2:
        raise TimeoutError("busy")
    return f"judged {n}"


@query("resumed_judging", """SELECT doc_id, CAST(CASE WHEN doc_id % 7 = 3 THEN 1 WHEN doc_id % 9 = 0 OR doc_id % 4 = 0 THEN 3 ELSE 1 END AS INT) AS attempts,
  CASE WHEN doc_id % 7 <> 3 AND doc_id % 9 <> 0 THEN concat('judged ', doc_id) END AS answer,
  CASE WHEN doc_id % 7 = 3 THEN 'ValueError: refused' WHEN doc_id % 9 = 0 THEN 'TimeoutError: busy' END AS error FROM labels""")
def resumed_judging(spark, d):
    """A run that was cut off in its second pass, and went on: the rows are those of one run."""
    folder = new_path(spark)
    asked = table(spark, d, "labels").select("doc_id", F.format_string("rate document %d", "doc_id").alias("request"))
    A.one_pass(asked, "doc_id", _answer, folder)
    asked.select("doc_id", F.lit(9).alias("attempt"), F.lit("half").alias("answer"), F.lit(None).cast("string").alias("error"), F.lit(False).alias("again")).write.parquet(f"{folder}/pass=1")
    return A.resumable(asked, "doc_id", _answer, folder)


@query("model_pair", f"""WITH {JUDGED_SQL}, m AS (SELECT model_id, row_number() OVER (ORDER BY model_id) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT model_id FROM judged WHERE model_id IS NOT NULL))
SELECT kept, max(CASE WHEN k = 1 AND (n = 2 OR kept = 2) THEN model_id END) AS first_model, max(CASE WHEN k = 2 AND (n = 2 OR kept = 2) THEN model_id END) AS second_model
FROM m, (SELECT unnest([2, 3]) AS kept) WHERE k <= kept GROUP BY kept""")
def model_pair(spark, d):
    """The pair that is compared where two and where three of the models are there."""
    rows = judged(spark, d)
    names = sorted(r[0] for r in rows.select("model_id").distinct().collect() if r[0] is not None)
    pairs = [(k, *(E.choose_pair(rows.where(F.col("model_id").isin(names[:k])), "model_id")[0] or (None, None))) for k in (2, 3)]
    return spark.createDataFrame(pairs, "kept int, first_model string, second_model string")


@query("evaluation_report")
def evaluation_report(spark, d):
    """The Markdown report over two models, line by line."""
    two = judged(spark, d).withColumn("model_id", F.when(F.col("row_id") % 2 == 0, "A").otherwise("B"))
    text = K.report("Evaluation Summary Report", E.report_sections(two))
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "line_no int, value string")

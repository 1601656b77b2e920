"""What the plan modules share: table access, the registry, and judged rows made from the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Labelled documents as judged generations: the source is the model, the language the category, doc_id % 28 the prompt.
JUDGED_SQL = """judged AS (
  SELECT d.doc_id AS row_id, d.source AS model_id, d.lang AS category, d.doc_id % 28 AS prompt_id, d.doc_id % 17 <> 0 AS usable,
         l.quality AS quality_score, CAST(d.doc_id % 3 = 0 AS INT) AS earth_motion_mention, l.toxic AS explicit_earth_motion_label,
         CAST(d.doc_id % 5 = 0 AS INT) AS proto_heliocentric_label,
         CASE d.doc_id % 4 WHEN 0 THEN 'geocentric' WHEN 1 THEN 'ambiguous' WHEN 2 THEN 'no_relevant_claim' ELSE 'heliocentric_or_earth_moves' END AS stance_label,
         d.text AS prompt
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").drop("n_chars"), "doc_id")
    m = lambda k: F.col("doc_id") % k
    return d.select(F.col("doc_id").alias("row_id"), F.col("source").alias("model_id"), F.col("lang").alias("category"), m(28).alias("prompt_id"), (m(17) != 0).alias("usable"), F.col("quality").alias("quality_score"), (m(3) == 0).cast("int").alias("earth_motion_mention"), F.col("toxic").alias("explicit_earth_motion_label"), (m(5) == 0).cast("int").alias("proto_heliocentric_label"), F.when(m(4) == 0, "geocentric").when(m(4) == 1, "ambiguous").when(m(4) == 2, "no_relevant_claim").otherwise("heliocentric_or_earth_moves").alias("stance_label"), F.col("text").alias("prompt"))


def pick_sql(column: str, values: tuple[str, ...], step: int) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE (e.event_id // {step}) % {len(values)} {whens} END AS {column}"


#: Events as phase-2 judged samples: (user, type) is the prompt, the event's place the variant; labels follow its number.
EXPLICIT, PROTO = ("none", "earth_moves", "earth_stationary", "unclear"), ("none", "weak", "strong", "unclear")
STANCE = ("geocentric", "heliocentric_or_earth_moves", "ambiguous", "no_relevant_claim")
REFINED = ("geocentric", "heliocentric", "ambiguous", "hybrid_or_contradictory", "irrelevant_or_unclear")
CONTEXT = ("none", "clear_heliocentric", "rotation_only", "ambiguous_or_mixed", "premodern_sphere_context", "unclear")
REGISTER = ("none", "weak", "strong")
LABELS_2 = (("explicit_earth_motion_label", EXPLICIT, 2), ("proto_heliocentric_label", PROTO, 3), ("refined_proto_heliocentric_label", PROTO, 5), ("stance", STANCE, 7), ("refined_stance", REFINED, 11), ("earth_motion_context", CONTEXT, 13), ("premodern_register", REGISTER, 17))
FLAGS_2 = (("earth_motion_mention", 20.0), ("off_topic_or_drift", 95.0), ("repetition_or_looping", 90.0), ("hybrid_or_contradictory_frame", 80.0), ("modern_explanatory_frame", 30.0), ("premodern_explanatory_frame", 60.0))
VARIANTS = ("qwen_base", "qwen_lora500", "qwen_lora1000")

JUDGED_2_SQL = f"""judged AS (
  SELECT e.event_id AS row_id, CASE e.event_id % 3 WHEN 0 THEN 'qwen_base' WHEN 1 THEN 'qwen_lora500' ELSE 'qwen_lora1000' END AS variant_label,
         'qwen' AS model_name, e.event_type AS prompt_category, e.user_id AS prompt_id, e.event_id // 3 % 5 AS sample_id,
         e.event_id % 23 <> 0 AS usable, CAST(e.event_id % 3 AS INT) AS quality_score,
         {', '.join(pick_sql(*x) for x in LABELS_2)},
         {', '.join(f"coalesce(e.value > {t} AND e.event_id % 2 = {i % 2}, false) AS {n}" for i, (n, t) in enumerate(FLAGS_2))}
  FROM events e)"""


def judged_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    i = F.col("event_id")

    def pick(values: tuple[str, ...], step: int):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (F.expr(f"event_id div {step}") % len(values) + 1).cast("int"))

    flags = [F.coalesce((F.col("value") > t) & (i % 2 == k % 2), F.lit(False)).alias(n) for k, (n, t) in enumerate(FLAGS_2)]
    return e.select(i.alias("row_id"), F.when(i % 3 == 0, "qwen_base").when(i % 3 == 1, "qwen_lora500").otherwise("qwen_lora1000").alias("variant_label"), F.lit("qwen").alias("model_name"), F.col("event_type").alias("prompt_category"), F.col("user_id").alias("prompt_id"), (F.expr("event_id div 3") % 5).alias("sample_id"), (i % 23 != 0).alias("usable"), (i % 3).cast("int").alias("quality_score"), *[pick(v, s).alias(n) for n, v, s in LABELS_2], *flags)


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    """Doubles with six places, as reports print them."""
    return df.select(*[F.round(F.col(c), 6).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])

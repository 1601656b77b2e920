"""Judged generations: requests, answers as JSON, coercion, validation and consistency of labels.

Null texts are requests with an empty part, and answers without an object; null fields are missing ones, coerced to null. Repeated
rows are judged each by itself; of alternatives that could all be meant, the first in the order given decides. Empty tables
give empty results."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import lexicons as L

#: Spellings of booleans and aliases of labels.
TRUE, FALSE = ("true", "1", "yes"), ("false", "0", "no")
EXPLICIT_ALIASES = {"moves": "earth_moves", "earth_move": "earth_moves", "earth_moving": "earth_moves"}
PROTO_ALIASES = {"proto": "strong", "present": "strong"}
STANCE_ALIASES = {"heliocentric": "heliocentric_or_earth_moves", "irrelevant_or_unclear": "no_relevant_claim"}
REQUIRED_2 = ("quality_score", "earth_motion_mention", "explicit_earth_motion_label", "proto_heliocentric_label", "stance", "refined_stance", "off_topic_or_drift", "repetition_or_looping", "premodern_register", "refined_proto_heliocentric_label", "earth_motion_context", "hybrid_or_contradictory_frame", "modern_explanatory_frame", "premodern_explanatory_frame", "rationale")
REQUIRED_1 = ("quality_score", "stance_label", "earth_motion_mention", "explicit_earth_motion_label", "proto_heliocentric_label", "reason")


def field(v: Column, name: str) -> Column:
    """A field of a JSON object as VARIANT; null if missing or JSON null."""
    return F.try_variant_get(v, f"$.{name}", "variant")


def kind(v: Column) -> Column:
    """The JSON type of a VARIANT: BOOLEAN, BIGINT, STRING, DOUBLE, ..."""
    return F.schema_of_variant(v)


def as_text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _zero_one(v: Column) -> Column:
    """1, 0 or null: numbers equal to one of these, and booleans, which count as numbers here."""
    number = F.when(kind(v).isin("BIGINT", "BOOLEAN", "DOUBLE") | F.startswith(kind(v), F.lit("DECIMAL")), F.try_variant_get(v, "$", "double"))
    return F.when(number.isin(0.0, 1.0), number.cast("int"))


def coerce_bool(v: Column) -> Column:
    """BOOLEAN, or null where the value is no boolean in any spelling."""
    word = F.when(kind(v) == "STRING", F.lower(F.trim(as_text(v))))
    return F.when(kind(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean")).when(_zero_one(v).isNotNull(), _zero_one(v) == 1).when(word.isin(*TRUE), True).when(word.isin(*FALSE), False)


def coerce_label(v: Column, labels: Sequence[str], aliases: dict[str, str] | None = None, one: str | None = None) -> Column:
    """A label of the set, or null. aliases map spellings; `one` is what the number 1 means (0 means none)."""
    word = F.when(kind(v) == "STRING", F.lower(F.trim(as_text(v))))
    for a, b in (aliases or {}).items():
        word = F.when(word == a, b).otherwise(word)
    named = F.when(word.isin(*labels), word)
    return named if one is None else F.when(_zero_one(v) == 1, one).when(_zero_one(v) == 0, "none").otherwise(named)


def coerce_result(v: Column) -> Column:
    """All fields of a phase-2 answer, each null where it is invalid."""
    get = lambda n: field(v, n)
    flag = lambda n: coerce_bool(get(n)).alias(n)
    quality = F.coalesce(F.when(kind(get("quality_score")) == "STRING", as_text(get("quality_score")).try_cast("int")), F.try_variant_get(get("quality_score"), "$", "double").cast("int"))
    register = F.lower(F.trim(as_text(get("premodern_register"))))
    return F.struct(
        F.when(quality.isin(0, 1, 2), quality).alias("quality_score"),
        flag("earth_motion_mention"),
        coerce_label(get("explicit_earth_motion_label"), L.EXPLICIT, EXPLICIT_ALIASES, "earth_moves").alias("explicit_earth_motion_label"),
        coerce_label(get("proto_heliocentric_label"), L.PROTO, PROTO_ALIASES, "strong").alias("proto_heliocentric_label"),
        coerce_label(get("stance"), L.STANCE, STANCE_ALIASES).alias("stance"),
        coerce_label(get("refined_stance"), L.REFINED).alias("refined_stance"),
        flag("off_topic_or_drift"),
        flag("repetition_or_looping"),
        F.when(register.isin(*L.REGISTER), register).alias("premodern_register"),
        coerce_label(get("refined_proto_heliocentric_label"), L.PROTO, PROTO_ALIASES, "strong").alias("refined_proto_heliocentric_label"),
        coerce_label(get("earth_motion_context"), L.MOTION_CONTEXT).alias("earth_motion_context"),
        flag("hybrid_or_contradictory_frame"),
        flag("modern_explanatory_frame"),
        flag("premodern_explanatory_frame"),
        F.trim(as_text(get("rationale"))).alias("rationale"),
    )


def validation_errors(df: DataFrame, raw: str = "raw", coerced: str = "r") -> Column:
    """array<string> of failed rules of a phase-2 answer: missing fields first, then invalid ones. raw: VARIANT."""
    keys = F.json_object_keys(F.to_json(F.col(raw)))
    missing = F.array_sort(F.array_except(F.array(*[F.lit(x) for x in REQUIRED_2]), F.coalesce(keys, F.array().cast("array<string>"))))
    invalid = F.array_compact(F.array(*[F.when(F.col(f"{coerced}.{n}").isNull(), F.lit(f"Invalid {n}")) for n in REQUIRED_2]))
    return F.when(F.size(missing) > 0, F.array(F.concat(F.lit("Missing fields: "), F.array_join(missing, ", ")))).otherwise(invalid)


def phase1_errors(df: DataFrame) -> Column:
    """array<string> of failed rules of a phase-1 answer in flat columns."""
    bad = lambda c, ok: F.when(~F.coalesce(ok, F.lit(False)), F.lit(f"Invalid {c}"))
    col = F.col
    return F.array_compact(F.array(bad("quality_score", col("quality_score").isin(0, 1, 2)), bad("stance_label", col("stance_label").isin(*L.STANCE)), *[bad(c, col(c).isin(0, 1)) for c in ("earth_motion_mention", "explicit_earth_motion_label", "proto_heliocentric_label")]))


def consistent_1(df: DataFrame, mention: bool = True) -> DataFrame:
    """Phase-1 rules: an explicit label implies proto (and mention) and the heliocentric stance; that stance implies
    proto."""
    helio = "heliocentric_or_earth_moves"
    explicit = F.col("explicit_earth_motion_label") == 1
    d = df.withColumn("stance_label", F.when(explicit, helio).otherwise(F.col("stance_label")))
    d = d.withColumn("proto_heliocentric_label", F.when(explicit | (F.col("stance_label") == helio), 1).otherwise(F.col("proto_heliocentric_label")))
    return d.withColumn("earth_motion_mention", F.when(explicit, 1).otherwise(F.col("earth_motion_mention"))) if mention else d


def consistent_2(df: DataFrame) -> DataFrame:
    """Phase-2 rules, in order, and the derived columns."""
    c, helio = F.col, "heliocentric_or_earth_moves"
    explicit = c("explicit_earth_motion_label")
    d = df.withColumn("__moves", explicit == "earth_moves")
    d = d.withColumn("earth_motion_mention", F.col("__moves") | c("earth_motion_mention"))
    d = d.withColumn("proto_heliocentric_label", F.when(c("__moves") & c("proto_heliocentric_label").isin("none", "unclear"), "strong").otherwise(c("proto_heliocentric_label")))
    d = d.withColumn("stance", F.when(c("__moves"), helio).otherwise(c("stance")))
    d = d.withColumn("stance", F.when((explicit == "earth_stationary") & c("stance").isin(helio, "no_relevant_claim"), "geocentric").otherwise(c("stance")))
    d = d.withColumn("stance", F.when(c("proto_heliocentric_label").isin("weak", "strong") & (c("stance") == "no_relevant_claim"), helio).otherwise(c("stance")))
    d = d.withColumn("stance", F.when((c("proto_heliocentric_label") == "none") & (c("stance") == helio), F.when(explicit == "earth_stationary", "geocentric").otherwise("ambiguous")).otherwise(c("stance")))
    refined = c("refined_proto_heliocentric_label").isin("weak", "strong")
    d = d.withColumn("earth_motion_context", F.when(refined & (c("earth_motion_context") == "none"), "ambiguous_or_mixed").otherwise(c("earth_motion_context")))
    d = d.withColumn("refined_stance", F.when(c("hybrid_or_contradictory_frame") & ~c("refined_stance").isin("hybrid_or_contradictory", "irrelevant_or_unclear"), "hybrid_or_contradictory").otherwise(c("refined_stance")))
    names = F.create_map(*[F.lit(x) for kv in L.STANCE_NAMES.items() for x in kv])
    return d.select("*", c("stance").alias("stance_label"), names[c("stance")].alias("stance_normalized"), c("__moves").alias("explicit_earth_motion_binary"), c("proto_heliocentric_label").isin("weak", "strong").alias("proto_heliocentric_binary"), refined.alias("refined_proto_heliocentric_binary"), c("rationale").alias("reason")).drop("__moves")


#: Whole strings (one that isn't closed goes to the end), which hide their braces, and braces.
BRACES = re.compile(r'"(?:[^"\\]|\\.|\\\Z)*(?:"|\Z)|([{}])', re.S)


def balanced_object(text: str) -> str | None:
    """From the first brace to where braces outside strings come out even; None if they never do."""
    braces = [m for m in BRACES.finditer(text, text.find("{")) if m[1]] if "{" in text else []
    depth = list(accumulate(1 if m[1] == "{" else -1 for m in braces))
    return text[braces[0].start() : braces[depth.index(0)].end()] if 0 in depth else None


@F.pandas_udf(StringType())
def balanced(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else balanced_object(t))


def parse_answer(text: Column) -> Column:
    """A model's answer as a JSON object (VARIANT), or null: the text, stripped, without code fences, then the first
    balanced object; the first of these that parses decides, and must be an object."""
    stripped = F.trim(text)
    bare = F.trim(F.regexp_replace(F.regexp_replace(stripped, r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))
    first = F.coalesce(F.try_parse_json(text), F.try_parse_json(stripped), F.try_parse_json(bare))
    found = F.coalesce(first, F.try_parse_json(balanced(F.when(first.isNull(), text))))
    return F.when(F.startswith(F.schema_of_variant(found), F.lit("OBJECT")), found)


def usable(error: Column, result: Column) -> Column:
    return (F.coalesce(error, F.lit("")) == "") & result.isNotNull()


def keys(df: DataFrame) -> DataFrame:
    """Model, category, prompt and sample keys with their defaults; a blank or 'null' adapter is BASE."""
    named = lambda c, d: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(d)).alias(c)
    adapter = F.when(F.lower(F.trim(F.coalesce("adapter_dir", F.lit("")))).isin("", "null"), "BASE").otherwise(F.col("adapter_dir")).alias("adapter_dir")
    own = {"model_name": named("model_name", "UNKNOWN_MODEL"), "prompt_category": named("prompt_category", "UNKNOWN_CATEGORY"), "prompt_id": named("prompt_id", "UNKNOWN_PROMPT"), "sample_id": named("sample_id", "UNKNOWN_SAMPLE"), "adapter_dir": adapter}
    return df.select(*[own.get(c, F.col(c)) for c in df.columns])


def variant_label(explicit: Column, stem: Column, adapter: Column) -> Column:
    """The variant a row belongs to: as given, else by file name, else by adapter folder."""
    s, a = F.lower(F.coalesce(stem, F.lit(""))), F.coalesce(adapter, F.lit("BASE"))
    by = lambda c: F.when(F.contains(c, F.lit("lora500")) | F.contains(c, F.lit("500")), "qwen_lora500").when(F.contains(c, F.lit("lora1000")) | F.contains(c, F.lit("1000")), "qwen_lora1000")
    base = F.when(F.contains(s, F.lit("base")), "qwen_base")
    last = F.element_at(F.split(F.regexp_replace(a, "/+$", ""), "/"), -1)
    return F.coalesce(F.nullif(F.trim(explicit), F.lit("")), by(s), base, F.when(a == "BASE", "qwen_base"), by(F.lower(a)), last)


def flatten(df: DataFrame, result: str, names: Sequence[str]) -> DataFrame:
    """Adds the named fields: from the nested result, else from the row itself."""
    inner = set(df.schema[result].dataType.names)
    own = [n for n in df.columns if n not in names]
    pick = lambda n: F.coalesce(*[F.col(x) for x in ([f"{result}.{n}"] if n in inner else []) + ([n] if n in df.columns else [])], F.lit(None)).alias(n)
    return df.select(*own, *[pick(n) for n in names])


def requests(df: DataFrame, rubric: str, prompt: str = "prompt", completion: str = "completion") -> DataFrame:
    """Adds request: what a judge is sent for a row. The rubric is a parameter; a stricter one is another text."""
    return df.withColumn("request", F.format_string("%s\n\nPROMPT:\n%s\n\nCOMPLETION:\n%s", F.lit(rubric), F.coalesce(prompt, F.lit("")), F.coalesce(completion, F.lit(""))))


def judge(df: DataFrame, judge_fn: Callable[[str], str], transient: tuple[type[Exception], ...] = (TimeoutError, ConnectionError), attempts: int = 3, repair_fn: Callable[[str], str] | None = None, wait: Callable[[int], None] = lambda k: time.sleep(2**k)) -> DataFrame:
    """Adds answer and judge_error: judge_fn on each request, again on transient errors up to `attempts` times (wait(k)
    before the k-th retry: 1 s, then twice as long each time), then repair_fn on an answer that isn't a JSON object. A failed row keeps its error."""

    def one(request: str) -> tuple[str | None, str | None]:
        for k in range(attempts):
            try:
                answer = judge_fn(request)
                if repair_fn and balanced_object(answer or "") is None:
                    answer = repair_fn(answer)
                return answer, None
            except transient as e:
                error = f"{type(e).__name__}: {e}"
                wait(k)
            except Exception as e:  # a row's failure is its result
                return None, f"{type(e).__name__}: {e}"
        return None, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [one(r) for r in b["request"]]
            yield b.assign(answer=[d[0] for d in done], judge_error=[d[1] for d in done])

    schema = StructType([*df.drop("answer", "judge_error").schema.fields, StructField("answer", StringType()), StructField("judge_error", StringType())])
    return df.drop("answer", "judge_error").mapInPandas(run, schema)


def generate(tasks: DataFrame, generate_fn: Callable[[dict], str], keep_errors: bool = True) -> DataFrame:
    """Adds output_text and generation_error to a task grid. With keep_errors a failed row is written with a null
    output; without, the failure ends the run and a later one resumes by anti-join."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, errors = [], []
            for row in b.to_dict("records"):
                try:
                    texts.append(generate_fn(row))
                    errors.append(None)
                except Exception as e:
                    if not keep_errors:
                        raise
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield b.assign(output_text=texts, generation_error=errors)

    return tasks.mapInPandas(run, StructType([*tasks.schema.fields, StructField("output_text", StringType()), StructField("generation_error", StringType())]))


#: The four-field answer of the one-row smoke judge.
SMOKE_SCHEMA = "quality_score int, stance_label string, explicit_earth_motion_label int, proto_heliocentric_label int"

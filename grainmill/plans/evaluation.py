"""Queries over judged rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats as S
from ..operators import evaluation as E
from ..operators import grids as G
from ..operators import judging as J
from . import base as B
from .base import query, rounded, table

N1 = {"earth_motion_mention": "earth_motion_mention", "explicit_earth_motion": "explicit_earth_motion_label", "proto_heliocentric": "proto_heliocentric_label"}
R0 = "coalesce(round(CAST({0} AS DOUBLE) / nullif({1}, 0), 6), 0.0)"


def _rate(a: str, b: str) -> str:
    return R0.format(a, b)


SUMMARY_1 = f"""WITH {B.JUDGED_SQL},
g AS (
  SELECT model_id, CASE WHEN grouping(category) = 1 THEN 'ALL' ELSE category END AS category, count(*) AS n_total,
         count(*) FILTER (usable) AS n_judged, count(*) FILTER (usable AND quality_score >= 1) AS n_quality_ge_min,
         count(*) FILTER (usable AND quality_score = 2) AS n_quality_2,
         {', '.join(f"count(*) FILTER (usable AND {c} = 1) AS n_{k}, count(*) FILTER (usable AND quality_score >= 1 AND {c} = 1) AS n_{k}_quality_ge_min" for k, c in N1.items())},
         {', '.join(f"count(*) FILTER (usable AND stance_label = '{s}') AS n_{s}" for s in ("geocentric", "ambiguous", "no_relevant_claim"))}
  FROM judged GROUP BY GROUPING SETS ((model_id), (model_id, category)))
SELECT *, {', '.join(f"{_rate(f'n_{k}', 'n_judged')} AS rate_{k}_overall, {_rate(f'n_{k}_quality_ge_min', 'n_quality_ge_min')} AS rate_{k}_given_quality_ge_min" for k in N1)},
       {_rate('n_quality_ge_min', 'n_judged')} AS rate_quality_ge_min, {_rate('n_quality_2', 'n_judged')} AS rate_quality_2,
       {_rate('n_geocentric', 'n_judged')} AS rate_geocentric_overall, {_rate('n_ambiguous', 'n_judged')} AS rate_ambiguous_overall
FROM g"""


@query("judged_summary", SUMMARY_1)
def judged_summary(spark, d):
    return rounded(E.summary_1(B.judged(spark, d)))


PROMPTS = f"""WITH {B.JUDGED_SQL},
p AS (
  SELECT model_id, category, prompt_id, count(*) AS n_judged, coalesce(arg_min(prompt, row_id) FILTER (prompt <> ''), '') AS prompt_text,
         round(avg(quality_score), 6) AS avg_quality, round(count(*) FILTER (explicit_earth_motion_label = 1) / CAST(count(*) AS DOUBLE), 6) AS rate_explicit,
         round(count(*) FILTER (earth_motion_mention = 1) / CAST(count(*) AS DOUBLE), 6) AS rate_mention
  FROM judged WHERE usable GROUP BY model_id, category, prompt_id)"""


def _prompts(spark, d):
    flags = {"explicit": F.col("explicit_earth_motion_label") == 1, "mention": F.col("earth_motion_mention") == 1}
    return rounded(E.prompt_rates(B.judged(spark, d).where("usable"), ["model_id", "category", "prompt_id"], flags))


@query("prompt_rates", PROMPTS + " SELECT * FROM p")
def prompt_rates(spark, d):
    return _prompts(spark, d)


@query("top10_prompts", PROMPTS + """ SELECT model_id, category, prompt_id, n_judged, avg_quality, rate_mention, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY model_id ORDER BY rate_mention DESC, avg_quality DESC, n_judged DESC, category, prompt_id) AS INT) AS rank FROM p) WHERE rank <= 10""")
def top10_prompts(spark, d):
    return E.top_prompts(_prompts(spark, d), "rate_mention", "model_id", "category", "prompt_id").select("model_id", "category", "prompt_id", "n_judged", "avg_quality", "rate_mention", "rank")


WORDS = ("the", "and", "tion", "die", "que", "license")


@query("phrase_rates", f"""WITH t AS (SELECT source, lang, lower(regexp_replace(trim(text), '\\s+', ' ', 'g')) AS t FROM documents WHERE trim(text) <> ''),
g AS (SELECT source, grouping(lang) AS a, lang, count(*) AS n, count(*) FILTER ({' OR '.join(f"contains(t, '{w}')" for w in WORDS)}) AS n_any,
      {', '.join(f"count(*) FILTER (contains(t, '{w}')) AS n_{w}" for w in WORDS)} FROM t GROUP BY GROUPING SETS ((source), (source, lang)))
{' UNION ALL '.join(f'''SELECT CASE WHEN a = 1 THEN 'overall' ELSE 'category' END AS scope, source, CASE WHEN a = 1 THEN 'ALL' ELSE lang END AS lang, '{w}' AS phrase,
n AS n_total_texts, n_{w} AS n_phrase_present, round(n_{w} / CAST(n AS DOUBLE), 6) AS rate_phrase_present, n_any AS n_any_hedge, round(n_any / CAST(n AS DOUBLE), 6) AS rate_any_hedge FROM g''' for w in WORDS)}""")
def phrase_rates(spark, d):
    return rounded(E.phrase_rates(table(spark, d, "documents"), "source", "lang", "text", WORDS))


def _cond(v) -> str:
    name, column, values = v
    return column if values is True else f"{column} IN ({', '.join(repr(x) for x in values)})"


COUNTS_2 = [f"count(*) FILTER (usable AND {_cond(v)}) AS n_{v[0]}" for v in E.SUMMARY_2]
NAMES_2 = ["n_quality_ge_min", "n_quality_2", *[f"n_{v[0]}" for v in E.SUMMARY_2], "n_hybrid_explanatory_frame"]


@query("judged_summary_2", f"""WITH {B.JUDGED_2_SQL},
g AS (SELECT variant_label, model_name, CASE WHEN grouping(prompt_category) = 1 THEN 'ALL' ELSE prompt_category END AS prompt_category, count(*) AS n_total,
  count(*) FILTER (usable) AS n_judged, count(*) FILTER (usable AND quality_score >= 1) AS n_quality_ge_min, count(*) FILTER (usable AND quality_score = 2) AS n_quality_2,
  {', '.join(COUNTS_2)}, count(*) FILTER (usable AND modern_explanatory_frame AND premodern_explanatory_frame) AS n_hybrid_explanatory_frame
  FROM judged GROUP BY GROUPING SETS ((variant_label, model_name), (variant_label, model_name, prompt_category)))
SELECT *, {', '.join(f"{_rate(n, 'n_judged')} AS rate_{n[2:]}" for n in NAMES_2)} FROM g""")
def judged_summary_2(spark, d):
    return rounded(E.summary_2(B.judged_2(spark, d), ["variant_label", "model_name"], "prompt_category"))


FLAGS = {"mention": "earth_motion_mention", "earth_moves": "explicit_earth_motion_label = 'earth_moves'", "proto": "proto_heliocentric_label IN ('weak', 'strong')", "helio": "refined_stance = 'heliocentric'", "modern": "modern_explanatory_frame", "premodern": "premodern_explanatory_frame"}
PROMPTS_2 = f"""WITH {B.JUDGED_2_SQL}, p AS (SELECT variant_label, prompt_category, prompt_id, count(*) AS n_judged, round(avg(quality_score), 6) AS avg_quality,
  {', '.join(f"round(count(*) FILTER ({c}) / CAST(count(*) AS DOUBLE), 6) AS rate_{k}" for k, c in FLAGS.items())} FROM judged WHERE usable GROUP BY ALL)"""


def _prompts_2(spark, d):
    rows = B.judged_2(spark, d).where("usable").withColumn("prompt", F.lit(""))
    return rounded(E.prompt_rates(rows, ["variant_label", "prompt_category", "prompt_id"], {k: F.expr(c) for k, c in FLAGS.items()}).drop("prompt_text"))


@query("prompt_rates_2", PROMPTS_2 + " SELECT * FROM p")
def prompt_rates_2(spark, d):
    return _prompts_2(spark, d)


@query("variant_pair_diffs", PROMPTS_2 + f""" SELECT a.variant_label AS reference_variant_label, b.variant_label AS comparison_variant_label, a.prompt_category, a.prompt_id,
  {', '.join(f"a.rate_{k} AS left_rate_{k}, b.rate_{k} AS right_rate_{k}, round(b.rate_{k} - a.rate_{k}, 6) AS diff_rate_{k}" for k in FLAGS)}
  FROM p a JOIN p b ON a.prompt_category = b.prompt_category AND a.prompt_id = b.prompt_id
   AND (a.variant_label, b.variant_label) IN (('qwen_base', 'qwen_lora500'), ('qwen_base', 'qwen_lora1000'), ('qwen_lora500', 'qwen_lora1000'))""")
def variant_pair_diffs(spark, d):
    return rounded(E.pair_diffs(_prompts_2(spark, d), "variant_label", ["prompt_category", "prompt_id"], [f"rate_{k}" for k in FLAGS]))


def _wilson(k: str, n: str) -> str:
    p = f"(CAST({k} AS DOUBLE) / nullif({n}, 0))"
    centre, span = f"({p} + 3.8416 / (2 * {n}))", f"(1.96 * sqrt(({p} * (1 - {p}) + 3.8416 / (4 * {n})) / {n}))"
    # a bound of zero may come out as -0.0 here; Spark's round() has no negative zero
    return f"round({p}, 6) AS rate, round(({centre} - {span}) / (1 + 3.8416 / {n}), 6) + CAST(0 AS DOUBLE) AS ci_lower, round(({centre} + {span}) / (1 + 3.8416 / {n}), 6) AS ci_upper"


_M, _P, _H, _E = "modern_explanatory_frame", "premodern_explanatory_frame", "hybrid_or_contradictory_frame", "earth_motion_mention"
_S = "refined_stance = '{}'"
COND = [(f"refined_stance_{s}_given_model", f"P(refined_stance = {s} | model)", "true", _S.format(s)) for s in ("geocentric", "heliocentric", "hybrid_or_contradictory")]
COND += [(f"{n}_true_given_model", f"P({n} = true | model)", "true", n) for n in (_P, _M, _H)]
COND += [
    (f"refined_stance_geocentric_given_{_P}_true", f"P(refined_stance = geocentric | {_P} = true, model)", _P, _S.format("geocentric")),
    (f"refined_stance_heliocentric_given_{_M}_true", f"P(refined_stance = heliocentric | {_M} = true, model)", _M, _S.format("heliocentric")),
    (f"{_H}_true_given_{_E}_true", f"P({_H} = true | {_E} = true, model)", _E, _H),
    (f"refined_stance_geocentric_given_{_E}_true", f"P(refined_stance = geocentric | {_E} = true, model)", _E, _S.format("geocentric")),
]
COND += [(f"{n}_true_given_premodern_register_strong", f"P({n} = true | premodern_register = strong, model)", "premodern_register = 'strong'", n) for n in (_P, _M)]
COND += [(f"{n}_true_given_model", f"P({n} = true | model)", "true", n) for n in ("off_topic_or_drift", "repetition_or_looping")]


@query("conditional_probabilities", f"WITH {B.JUDGED_2_SQL}, " + "c AS (" + " UNION ALL ".join(f"SELECT variant_label, prompt_category, '{m}' AS metric_id, '{t}' AS definition, count(*) FILTER ({den} AND {num}) AS numerator, count(*) FILTER ({den}) AS denominator FROM judged WHERE usable GROUP BY variant_label, prompt_category" for m, t, den, num in COND) + f") SELECT *, {_wilson('numerator', 'denominator')} FROM c")
def conditional_probabilities(spark, d):
    return rounded(E.conditionals(B.judged_2(spark, d).where("usable"), ["variant_label", "prompt_category"], E.conditional_specs()))


@query("wilson_ci", f"WITH {B.JUDGED_SQL}, c AS (SELECT model_id, count(*) FILTER (explicit_earth_motion_label = 1) AS numerator, count(*) AS denominator FROM judged GROUP BY 1) SELECT *, {_wilson('numerator', 'denominator')} FROM c")
def wilson_ci(spark, d):
    c = B.judged(spark, d).groupBy("model_id").agg(S.count_true(F.col("explicit_earth_motion_label") == 1).alias("numerator"), F.count("*").alias("denominator"))
    low, high = S.wilson(F.col("numerator"), F.col("denominator"))
    return rounded(c.select("*", S.rate(F.col("numerator"), F.col("denominator")).alias("rate"), low.alias("ci_lower"), high.alias("ci_upper")))


PAIR_SQL = f"""{B.JUDGED_2_SQL},
f AS (SELECT * FROM judged WHERE usable QUALIFY row_number() OVER (PARTITION BY variant_label, prompt_category, prompt_id, sample_id ORDER BY row_id) = 1),
pr AS (SELECT a.variant_label AS reference_variant_label, b.variant_label AS comparison_variant_label, a.prompt_category, a.prompt_id, a.sample_id,
  {', '.join(f"a.{n} AS reference_{n}, b.{n} AS comparison_{n}" for n in E.PAIRED)}
  FROM f a JOIN f b USING (prompt_category, prompt_id, sample_id)
  WHERE (a.variant_label, b.variant_label) IN (('qwen_base', 'qwen_lora500'), ('qwen_base', 'qwen_lora1000'), ('qwen_lora500', 'qwen_lora1000')))"""
FLIPS = {
    "modern_to_premodern_frame_flip": f"reference_{_M} AND comparison_{_P}",
    "premodern_to_modern_frame_flip": f"reference_{_P} AND comparison_{_M}",
    "heliocentric_to_geocentric_refined_stance_flip": "reference_refined_stance = 'heliocentric' AND comparison_refined_stance = 'geocentric'",
    "geocentric_to_heliocentric_refined_stance_flip": "reference_refined_stance = 'geocentric' AND comparison_refined_stance = 'heliocentric'",
    "modern_suppression": f"reference_{_M} AND NOT comparison_{_M}",
    "premodern_activation": f"NOT reference_{_P} AND comparison_{_P}",
    "hybridization_activation": f"NOT reference_{_H} AND comparison_{_H}",
    "earth_motion_suppression": f"reference_{_E} AND NOT comparison_{_E}",
    "earth_motion_activation": f"NOT reference_{_E} AND comparison_{_E}",
}
PAIR_KEYS = ["reference_variant_label", "comparison_variant_label"]
PAIRS = (("qwen_base", "qwen_lora500"), ("qwen_base", "qwen_lora1000"), ("qwen_lora500", "qwen_lora1000"))


def _pairs(spark, d):
    keys = ["prompt_category", "prompt_id", "sample_id"]
    first = E.first_rows(B.judged_2(spark, d).where("usable").select("variant_label", *keys, "row_id", *E.PAIRED), ["variant_label", *keys], ["row_id"])
    return E.pair_rows(first, "variant_label", keys, E.PAIRED, PAIRS).drop("pair_id")


@query("paired_samples", f"WITH {PAIR_SQL} SELECT *, {', '.join(f'({c}) AS {k}' for k, c in FLIPS.items())} FROM pr")
def paired_samples(spark, d):
    return _pairs(spark, d).select("*", *[f.alias(k) for k, f in E.flips().items()])


FLIP_SQL = f"WITH {PAIR_SQL}, c AS (" + " UNION ALL ".join(f"SELECT reference_variant_label, comparison_variant_label, '{k}' AS metric_id, count(*) FILTER ({c}) AS \"count\", count(*) AS denominator FROM pr GROUP BY 1, 2" for k, c in FLIPS.items()) + f"), r AS (SELECT *, {_wilson('\"count\"', 'denominator')} FROM c)"


@query("flip_rates", FLIP_SQL + " SELECT * FROM r")
def flip_rates(spark, d):
    return rounded(E.flip_rates(_pairs(spark, d), PAIR_KEYS))


@query("flip_stats_mcnemar", FLIP_SQL + """ SELECT r.*, b."count" AS reverse_count,
  round(CAST(pow(abs(r."count" - b."count") - 1, 2) AS DOUBLE) / nullif(r."count" + b."count", 0), 6) AS chi2_stat FROM r LEFT JOIN (VALUES
  ('modern_to_premodern_frame_flip', 'premodern_to_modern_frame_flip'), ('heliocentric_to_geocentric_refined_stance_flip', 'geocentric_to_heliocentric_refined_stance_flip'),
  ('earth_motion_suppression', 'earth_motion_activation')) v(m, back) ON r.metric_id = v.m
  LEFT JOIN r b ON b.metric_id = v.back AND b.reference_variant_label = r.reference_variant_label AND b.comparison_variant_label = r.comparison_variant_label""")
def flip_stats_mcnemar(spark, d):
    return rounded(E.flip_tests(E.flip_rates(_pairs(spark, d), PAIR_KEYS), PAIR_KEYS).drop("p_value"))


@query("flip_p_values")
def flip_p_values(spark, d):
    return E.flip_tests(E.flip_rates(_pairs(spark, d), PAIR_KEYS), PAIR_KEYS).where("chi2_stat is not null").select(*PAIR_KEYS, "metric_id", "chi2_stat", "p_value")


def _frac(c: str) -> str:
    return f"round(count(*) FILTER ({c}) / CAST(count(*) AS DOUBLE), 6)"


@query("prompt_susceptibility", f"""WITH {PAIR_SQL} SELECT prompt_category, prompt_id, count(*) AS n_paired_samples,
  {', '.join(f"{_frac(FLIPS[k])} AS fraction_{k}" for k in ("modern_to_premodern_frame_flip", "premodern_activation", "modern_suppression", "hybridization_activation"))},
  {', '.join(f"{_frac(f"{s}_refined_stance = 'geocentric'")} AS {s}_geocentric_rate, {_frac(f'{s}_{_P}')} AS {s}_premodern_rate, {_frac(f'{s}_{_M}')} AS {s}_modern_rate" for s in ("reference", "comparison"))}
  FROM pr WHERE reference_variant_label = 'qwen_base' AND comparison_variant_label = 'qwen_lora1000' GROUP BY 1, 2""")
def prompt_susceptibility(spark, d):
    p = _pairs(spark, d).where("reference_variant_label = 'qwen_base' and comparison_variant_label = 'qwen_lora1000'")
    return rounded(E.susceptibility(p, ["prompt_category", "prompt_id"]))


PERM = 10_000


#: Sums of the differences d (scope, metric, k, x) under each permutation: a bit of a hash of 256 of them is a pair's sign.
FLIPPED = f"""h AS (SELECT scope, metric, x, b, sha256(concat_ws('|', '12345', CAST(b AS VARCHAR), k)) AS h FROM d, range({(PERM + 255) // 256}) r(b)),
digits AS (SELECT scope, metric, x, b, a, strpos('0123456789abcdef', substr(h, a + 1, 1)) - 1 AS v FROM h, range(64) t(a)),
s AS (SELECT scope, metric, b, a, j, sum(CASE WHEN (v >> j) & 1 = 1 THEN x ELSE -x END) AS s FROM digits, range(4) u(j) WHERE b * 256 + a * 4 + j < {PERM} GROUP BY ALL)"""


@query("permutation_test", f"""WITH d AS (SELECT lang AS scope, CAST(doc_id % 2 AS VARCHAR) AS metric, CAST(doc_id AS VARCHAR) AS k, CAST(quality - toxic AS BIGINT) AS x FROM labels JOIN documents USING (doc_id)),
o AS (SELECT scope, metric, count(*) AS n_pairs, CAST(sum(x) AS BIGINT) AS total FROM d GROUP BY 1, 2),
{FLIPPED}
SELECT o.scope, o.metric, n_pairs, total, count(*) FILTER (abs(s) >= abs(total)) AS extreme, count(*) FILTER (abs(s) >= abs(total)) / CAST({PERM} AS DOUBLE) AS p_value
FROM o JOIN s ON o.scope = s.scope AND o.metric = s.metric GROUP BY o.scope, o.metric, n_pairs, total""")
def permutation_test(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").select(F.col("lang").alias("scope"), (F.col("doc_id") % 2).cast("string").alias("metric"), "doc_id", (F.col("quality") - F.col("toxic")).alias("x"))
    return E.permutation_test(rows, "scope", "metric", ["doc_id"], "x", PERM)


@query("permutation_scopes", f"""WITH c AS (SELECT source, lang, doc_id // 20 % 5 AS p, sum(quality) AS q, sum(toxic) AS t FROM labels JOIN documents USING (doc_id) WHERE source IN ('src0', 'src1') GROUP BY ALL),
j AS (SELECT a.lang, a.p, b.q - a.q AS dq, b.t - a.t AS dt FROM c a JOIN c b ON a.lang = b.lang AND a.p = b.p AND a.source = 'src0' AND b.source = 'src1'),
sc AS (SELECT unnest(['overall', lang]) AS scope, concat_ws('|', lang, p) AS k, dq, dt FROM j),
d AS (SELECT scope, 'q' AS metric, k, CAST(dq AS BIGINT) AS x FROM sc UNION ALL SELECT scope, 't', k, CAST(dt AS BIGINT) FROM sc),
o AS (SELECT scope, metric, count(*) AS n_pairs, CAST(sum(x) AS BIGINT) AS total FROM d GROUP BY 1, 2),
{FLIPPED}
SELECT o.scope, o.metric, n_pairs, total, count(*) FILTER (abs(s) >= abs(total)) AS extreme, count(*) FILTER (abs(s) >= abs(total)) / CAST({PERM} AS DOUBLE) AS p_value
FROM o JOIN s ON o.scope = s.scope AND o.metric = s.metric GROUP BY o.scope, o.metric, n_pairs, total""")
def permutation_scopes(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id").where(F.col("source").isin("src0", "src1"))
    counts = rows.groupBy("source", "lang", (F.expr("doc_id div 20") % 5).alias("p")).agg(F.sum("quality").alias("q"), F.sum("toxic").alias("t"))
    diffs = E.paired_differences(counts, "source", ("src0", "src1"), "lang", "p", ["q", "t"])
    return E.permutation_test(diffs, "scope", "metric", ["pair_key"], "diff", PERM)


@query("permutation_test_compat")
def permutation_test_compat(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").select(F.col("lang").alias("scope"), F.lit("quality").alias("metric"), "doc_id", (F.col("quality") - F.col("toxic")).cast("double").alias("x"))
    return E.permutation_test_compat(rows, "scope", "metric", ["doc_id"], "x", PERM)


@query("load_counters", """WITH l AS (SELECT CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 11 = 1 THEN '{bad' WHEN event_id % 11 = 2 THEN '[1]'
   WHEN event_id % 11 = 3 THEN '{"judge_error": "x", "judge_result": {"a": 1}}' WHEN event_id % 11 = 4 THEN '{"judge_result": {"a": 1}}' ELSE props END AS v, event_id % 11 AS m, props FROM events)
SELECT count(*) AS n_lines, count(*) FILTER (trim(v) = '') AS n_blank, count(*) FILTER (m IN (0, 1, 2)) AS n_malformed, count(*) FILTER (m > 2) AS n_parsed,
  count(*) FILTER (m = 3) AS n_error, count(*) FILTER (m > 4) AS n_missing_result, count(*) FILTER (m = 4) AS n_usable FROM l""")
def load_counters(spark, d):
    m = F.col("event_id") % 11
    v = F.when(m == 0, "").when(m == 1, "{bad").when(m == 2, "[1]").when(m == 3, '{"judge_error": "x", "judge_result": {"a": 1}}').when(m == 4, '{"judge_result": {"a": 1}}').otherwise(F.col("props"))
    return E.load_counters(table(spark, d, "events").select(v.alias("value")))


@query("label_consistency", f"""WITH {B.JUDGED_SQL}, a AS (SELECT row_id, quality_score, earth_motion_mention AS m, explicit_earth_motion_label AS e, proto_heliocentric_label AS p,
  CASE WHEN explicit_earth_motion_label = 1 THEN 'heliocentric_or_earth_moves' ELSE stance_label END AS stance_label FROM judged)
SELECT row_id, stance_label, CASE WHEN e = 1 THEN 1 ELSE m END AS earth_motion_mention, e AS explicit_earth_motion_label,
  CASE WHEN e = 1 OR stance_label = 'heliocentric_or_earth_moves' THEN 1 ELSE p END AS proto_heliocentric_label FROM a""")
def label_consistency(spark, d):
    return J.consistent_1(B.judged(spark, d)).select("row_id", "stance_label", "earth_motion_mention", "explicit_earth_motion_label", "proto_heliocentric_label")


H = "heliocentric_or_earth_moves"


@query("label_consistency_2", f"""WITH {B.JUDGED_2_SQL},
a AS (SELECT *, explicit_earth_motion_label = 'earth_moves' AS mv FROM judged),
b AS (SELECT *, CASE WHEN mv AND proto_heliocentric_label IN ('none', 'unclear') THEN 'strong' ELSE proto_heliocentric_label END AS p1, CASE WHEN mv THEN '{H}' ELSE stance END AS s1 FROM a),
c AS (SELECT *, CASE WHEN explicit_earth_motion_label = 'earth_stationary' AND s1 IN ('{H}', 'no_relevant_claim') THEN 'geocentric' ELSE s1 END AS s2 FROM b),
e AS (SELECT *, CASE WHEN p1 IN ('weak', 'strong') AND s2 = 'no_relevant_claim' THEN '{H}' ELSE s2 END AS s3 FROM c),
f AS (SELECT *, CASE WHEN p1 = 'none' AND s3 = '{H}' THEN CASE WHEN explicit_earth_motion_label = 'earth_stationary' THEN 'geocentric' ELSE 'ambiguous' END ELSE s3 END AS s4 FROM e)
SELECT row_id, mv OR earth_motion_mention AS earth_motion_mention, p1 AS proto_heliocentric_label, s4 AS stance,
  CASE s4 WHEN 'geocentric' THEN 'geocentric' WHEN '{H}' THEN 'heliocentric' WHEN 'ambiguous' THEN 'ambiguous' ELSE 'irrelevant_or_unclear' END AS stance_normalized,
  CASE WHEN hybrid_or_contradictory_frame AND refined_stance NOT IN ('hybrid_or_contradictory', 'irrelevant_or_unclear') THEN 'hybrid_or_contradictory' ELSE refined_stance END AS refined_stance,
  CASE WHEN refined_proto_heliocentric_label IN ('weak', 'strong') AND earth_motion_context = 'none' THEN 'ambiguous_or_mixed' ELSE earth_motion_context END AS earth_motion_context,
  mv AS explicit_earth_motion_binary, p1 IN ('weak', 'strong') AS proto_heliocentric_binary, refined_proto_heliocentric_label IN ('weak', 'strong') AS refined_proto_heliocentric_binary FROM f""")
def label_consistency_2(spark, d):
    rows = J.consistent_2(B.judged_2(spark, d).withColumn("rationale", F.lit("")))
    return rows.select("row_id", "earth_motion_mention", "proto_heliocentric_label", "stance", "stance_normalized", "refined_stance", "earth_motion_context", "explicit_earth_motion_binary", "proto_heliocentric_binary", "refined_proto_heliocentric_binary")


COERCE = [("true", True, None, None), ("1", True, "earth_moves", "strong"), ("0", False, "none", "none"), ('"yes"', True, None, None), ('" No "', False, None, None), ('"maybe"', None, None, None), ("null", None, None, None), ('"moves"', None, "earth_moves", None), ('"Proto"', None, None, "strong"), ('"none"', None, "none", "none"), ("2", None, None, None), ('"weak"', None, None, "weak")]
COERCE[0] = ("true", True, "earth_moves", "strong")


def _lit(v) -> str:
    return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else f"'{v}'"


@query("label_coercion", "WITH c AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {_lit(j)}, CAST({_lit(b)} AS BOOLEAN), CAST({_lit(e)} AS VARCHAR), CAST({_lit(p)} AS VARCHAR))" for k, (j, b, e, p) in enumerate(COERCE)) + f") t(k, raw, as_bool, as_explicit, as_proto)) SELECT event_id, raw, as_bool, as_explicit, as_proto FROM events JOIN c ON event_id % {len(COERCE)} = k")
def label_coercion(spark, d):
    """Events with every spelling of a label in turn."""
    raw = F.element_at(F.array(*[F.lit(r[0]) for r in COERCE]), (F.col("event_id") % len(COERCE) + 1).cast("int"))
    v = table(spark, d, "events").select("event_id", raw.alias("raw")).withColumn("v", F.try_parse_json("raw"))
    return v.select("event_id", "raw", J.coerce_bool(F.col("v")).alias("as_bool"), J.coerce_label(F.col("v"), B.EXPLICIT, J.EXPLICIT_ALIASES, "earth_moves").alias("as_explicit"), J.coerce_label(F.col("v"), B.PROTO, J.PROTO_ALIASES, "strong").alias("as_proto"))


@query("json_repair", """WITH a AS (SELECT conv_id, turn, turn % 5 AS kind FROM conversations)
SELECT conv_id, turn, CASE WHEN kind < 3 THEN conv_id END AS c, CASE WHEN kind < 3 THEN turn END AS t, CASE WHEN kind < 3 THEN '}"{' END AS s FROM a""")
def json_repair(spark, d):
    """Turns as answers: whole objects, fenced ones, ones inside prose with braces in their strings, and answers without one."""
    bare = F.translate(F.coalesce("text", F.lit("")), '{}"', "()")
    inner = F.concat(F.lit('{"c": '), F.col("conv_id").cast("string"), F.lit(', "in": {"s": "}\\"{", "t": '), F.col("turn").cast("string"), F.lit("}}"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", (F.col("turn") % 5).alias("kind"), inner.alias("object"), bare.alias("prose"))
    prose, thing, kind = F.col("prose"), F.col("object"), F.col("kind")
    answer = F.when(kind == 0, F.concat(F.lit(" "), thing)).when(kind == 1, F.concat(F.lit("```json\n"), thing, F.lit("\n```")))
    answer = answer.when(kind == 2, F.concat(prose, thing, prose, F.lit("{} }"))).when(kind == 3, prose).otherwise(F.concat(prose, F.lit('{"c": 1')))
    found = J.parse_answer(answer)
    of = lambda path, kind: F.try_variant_get(found, path, kind)
    return rows.select("conv_id", "turn", of("$.c", "bigint").alias("c"), of("$.in.t", "bigint").alias("t"), of("$.in.s", "string").alias("s"))


@query("variant_labels", """SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'mine' || user_id WHEN 1 THEN 'qwen_lora500' WHEN 2 THEN 'qwen_lora1000' WHEN 3 THEN 'qwen_base'
  WHEN 4 THEN 'qwen_lora500' WHEN 5 THEN 'qwen_base' ELSE 'ckpt_' || event_type END AS variant_label FROM events""")
def variant_labels(spark, d):
    """Events as rows that name their variant outright, by a file's name, or by an adapter's folder."""
    k = F.col("event_id") % 7
    label = F.when(k == 0, F.concat(F.lit(" mine"), F.col("user_id").cast("string"))).when(k == 2, " ")
    stem = F.when(k == 1, "judged_LoRA500").when(k == 2, "out_1000").when(k == 3, "Base_run").otherwise("x")
    adapter = F.when(k == 3, "a/b").when(k == 4, "run/lora500").when(k == 6, F.concat(F.lit("a/ckpt_"), "event_type", F.lit("//")))
    return table(spark, d, "events").select("event_id", J.variant_label(label, stem, adapter).alias("variant_label"))


@query("phase1_errors", """SELECT doc_id, concat_ws(', ', CASE WHEN quality = 1 AND doc_id % 7 = 0 THEN 'Invalid quality_score' END, CASE WHEN toxic = 1 THEN 'Invalid stance_label' END,
  CASE WHEN doc_id % 5 = 0 THEN 'Invalid proto_heliocentric_label' END) AS errors FROM labels""")
def phase1_errors(spark, d):
    i = F.col("doc_id")
    rows = table(spark, d, "labels").select(i, F.when((F.col("quality") == 1) & (i % 7 == 0), 3).otherwise(F.col("quality")).alias("quality_score"), F.when(F.col("toxic") == 1, "odd").otherwise("geocentric").alias("stance_label"), F.col("quality").alias("earth_motion_mention"), F.col("toxic").alias("explicit_earth_motion_label"), F.when(i % 5 != 0, 1).alias("proto_heliocentric_label"))
    return rows.select("doc_id", F.array_join(J.phase1_errors(rows), ", ").alias("errors"))


@query("identities", """SELECT conv_id, turn, CASE WHEN role = 'user' THEN concat('{"conv_id":', conv_id, '}') ELSE concat('{"conv_id":', conv_id, ',"turn":', turn, '}') END AS identity FROM conversations""")
def identities(spark, d):
    """The identity of a row leaves out the keys that are null."""
    rows = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("n"), F.when(F.col("role") != "user", F.col("turn")).alias("turn"))
    return G.identity(rows, ["turn", "conv_id", "absent"]).select("conv_id", F.col("n").alias("turn"), "identity")


@query("smoke_answers", "SELECT doc_id, quality AS quality_score, 'ambiguous' AS stance_label, toxic AS explicit_earth_motion_label, CAST(NULL AS INT) AS proto_heliocentric_label FROM labels")
def smoke_answers(spark, d):
    """Answers of the four-field judge, as JSON text, read by its schema."""
    text = F.to_json(F.struct(F.col("quality").alias("quality_score"), F.lit("ambiguous").alias("stance_label"), F.col("toxic").alias("explicit_earth_motion_label"), F.lit("x").alias("other")))
    return table(spark, d, "labels").select("doc_id", F.from_json(text, J.SMOKE_SCHEMA).alias("r")).select("doc_id", "r.*")

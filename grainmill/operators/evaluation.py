"""Statistics of judged rows. Rates are wide aggregates (one shuffle for all metrics); long forms are stacked after.

Null flags and labels count as not so; null keys are a group; repeated rows count as often as they are there; an empty
table gives no groups. Where rows tie in an order, first_rows and top_prompts say by what they are told apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import stats as S
from ..functions import text as T
from .shared import small, written

true = S.count_true


def summary_1(df: DataFrame, model: str = "model_id", category: str = "category", min_quality: int = 1, mention: bool | None = None) -> DataFrame:
    """Phase-1 counts and rates for each model (category ALL) and each model and category. df: usable (BOOLEAN),
    quality_score, stance_label, earth_motion_mention, explicit_earth_motion_label, proto_heliocentric_label."""
    c, ok = F.col, F.col("usable")
    good = ok & (c("quality_score") >= min_quality)
    one = lambda n: ok & (c(n) == 1)
    both = lambda n: good & (c(n) == 1)
    stance = lambda s: ok & (c("stance_label") == s)
    flags = {"earth_motion_mention": "earth_motion_mention", "explicit_earth_motion": "explicit_earth_motion_label", "proto_heliocentric": "proto_heliocentric_label"}
    if mention is False:
        flags.pop("earth_motion_mention")
    aggs = [F.count("*").alias("n_total"), true(ok).alias("n_judged"), true(good).alias("n_quality_ge_min"), true(ok & (c("quality_score") == 2)).alias("n_quality_2")]
    aggs += [x for k, n in flags.items() for x in (true(one(n)).alias(f"n_{k}"), true(both(n)).alias(f"n_{k}_quality_ge_min"))]
    aggs += [true(stance(s)).alias(f"n_{s}") for s in ("geocentric", "ambiguous", "no_relevant_claim")]
    sets = df.groupingSets([[c(model)], [c(model), c(category)]], c(model), c(category)).agg(*aggs, F.grouping(category).alias("__all"))
    r = lambda a, b: S.rate0(c(a), c(b))
    rates = [x for k in flags for x in (r(f"n_{k}", "n_judged").alias(f"rate_{k}_overall"), r(f"n_{k}_quality_ge_min", "n_quality_ge_min").alias(f"rate_{k}_given_quality_ge_min"))]
    rates += [r("n_quality_ge_min", "n_judged").alias("rate_quality_ge_min"), r("n_quality_2", "n_judged").alias("rate_quality_2"), r("n_geocentric", "n_judged").alias("rate_geocentric_overall"), r("n_ambiguous", "n_judged").alias("rate_ambiguous_overall")]
    counts = [x for x in sets.columns if x.startswith("n_")]
    return sets.select(c(model), F.when(c("__all") == 1, "ALL").otherwise(c(category)).alias(category), *counts, *rates)


def has_key(df: DataFrame, column: str) -> bool:
    """Whether any usable row carries a column's value: decides on the driver which columns a report has."""
    return bool(df.agg(F.bool_or(F.col("usable") & F.col(column).isNotNull())).first()[0])


def prompt_rates(df: DataFrame, keys: Sequence[str], flags: dict[str, Column], quality: str = "quality_score", text: str = "prompt", order: Sequence[str] = ("row_id",)) -> DataFrame:
    """Counts, mean quality, rates of the flags and the first non-empty prompt text for each key."""
    first = F.min_by(F.when(F.col(text) != "", F.col(text)), F.when(F.col(text) != "", F.struct(*order)))
    return df.groupBy(*keys).agg(F.count("*").alias("n_judged"), F.coalesce(first, F.lit("")).alias("prompt_text"), F.avg(quality).alias("avg_quality"), *[S.rate0(true(f), F.count("*")).alias(f"rate_{k}") for k, f in flags.items()])


def top_prompts(rates: DataFrame, metric: str, model: str, category: str, prompt: str, k: int = 10) -> DataFrame:
    """The k prompts of each model with the largest metric; ties by mean quality, count, category, prompt."""
    w = Window.partitionBy(model).orderBy(F.desc(metric), F.desc("avg_quality"), F.desc("n_judged"), F.asc(category), F.asc(prompt))
    return rates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def phrase_rates(df: DataFrame, model: str, category: str, text: str, phrases: Sequence[str] = L.HEDGES) -> DataFrame:
    """Long form: a row for each scope and phrase: texts, texts with it, texts with any, and rates. Blank texts don't
    count. Flags are summed wide, so rows aren't multiplied by phrases."""
    norm = df.where(T.strip(F.coalesce(F.col(text), F.lit(""))) != "").withColumn("__t", T.normalise(F.col(text)))
    has = [F.contains("__t", F.lit(p)) for p in phrases]
    any_of = has[0]
    for h in has[1:]:
        any_of = any_of | h
    sets = norm.groupingSets([[F.col(model)], [F.col(model), F.col(category)]], F.col(model), F.col(category)).agg(F.count("*").alias("n_total_texts"), true(any_of).alias("n_any_hedge"), F.array(*[F.struct(F.lit(p).alias("phrase"), true(h).alias("n")) for p, h in zip(phrases, has)]).alias("__p"), F.grouping(category).alias("__all"))
    long = sets.select(F.when(F.col("__all") == 1, "overall").otherwise("category").alias("scope"), F.col(model), F.when(F.col("__all") == 1, "ALL").otherwise(F.col(category)).alias(category), F.explode("__p").alias("p"), "n_total_texts", "n_any_hedge")
    return long.select("scope", model, category, "p.phrase", "n_total_texts", F.col("p.n").alias("n_phrase_present"), S.rate0(F.col("p.n"), F.col("n_total_texts")).alias("rate_phrase_present"), "n_any_hedge", S.rate0(F.col("n_any_hedge"), F.col("n_total_texts")).alias("rate_any_hedge"))


def mean_loss(log: DataFrame, *keys: str, loss: str = "loss") -> DataFrame:
    """(keys, steps, mean_loss): the mean of a log's losses, for each key or over all. Null losses count as no step; a key
    (or a log) of none has a null mean."""
    return log.groupBy(*keys).agg(F.count(loss).alias("steps"), F.avg(loss).alias("mean_loss"))


def report_sections(df: DataFrame, model: str = "model_id", category: str = "category", prompt: str = "prompt_id", text: str = "prompt", k: int = 10, phrases: Sequence[str] = L.HEDGES) -> list[tuple[str, DataFrame | str]]:
    """Sections of the phase-1 report over judged rows: summaries, the k first prompts of each model by each flag (mentions
    only where any row has them), permutation tests between the chosen pair of models, phrases and notes. df: as of
    summary_1."""
    mention = has_key(df, "earth_motion_mention")
    sums = summary_1(df, model, category, mention=mention)
    flags = ({"Earth-motion Mention": "earth_motion_mention"} if mention else {}) | {"Explicit Earth-motion": "explicit_earth_motion_label", "Proto-heliocentric Suggestion": "proto_heliocentric_label"}
    rates = prompt_rates(df.where("usable"), [model, category, prompt], {c: F.col(c) == 1 for c in flags.values()}, text=text)
    out: list[tuple[str, DataFrame | str]] = [("Overall Comparison", sums.where(F.col(category) == "ALL").orderBy(model)), ("Category Comparison", sums.where(F.col(category) != "ALL").orderBy(category, model))]
    for title, c in flags.items():
        top = top_prompts(rates, f"rate_{c}", model, category, prompt, k).orderBy(model, "rank")
        out.append((f"Top {title} Prompts Per Model", top.select(model, "rank", category, prompt, "n_judged", F.col(f"rate_{c}").alias("rate"), "avg_quality", T.preview(F.col("prompt_text")).alias("prompt_text"))))
    pair, note = choose_pair(df, model)
    if pair:
        counts = df.where("usable").groupBy(model, category, prompt).agg(*[true(F.col(c) == 1).alias(c) for c in flags.values()])
        diffs = paired_differences(counts, model, pair, category, prompt, list(flags.values()))
        out.append(("Prompt-level paired permutation tests", permutation_test(diffs, "scope", "metric", ["pair_key"], "diff").orderBy("scope", "metric")))
    else:
        out.append(("Prompt-level paired permutation tests", note))
    found = phrase_rates(df, model, category, text, phrases).orderBy("phrase", category, model)
    out += [("Hedge phrases, overall by model", found.where("scope = 'overall'")), ("Hedge phrases, by model and category", found.where("scope = 'category'"))]
    return out


#: Phase-2 counts: name, column, and the values it counts (True: a strict boolean).
SUMMARY_2 = (
    [("earth_motion_mention", "earth_motion_mention", True)]
    + [(f"explicit_{v}", "explicit_earth_motion_label", (v,)) for v in ("earth_moves", "earth_stationary", "unclear")]
    + [(f"{p}proto_{n}", f"{p}proto_heliocentric_label", v) for p in ("", "refined_") for n, v in (("heliocentric_any", ("weak", "strong")), ("weak", ("weak",)), ("strong", ("strong",)), ("unclear", ("unclear",)))]
    + [(f"stance_{v}", "stance", (v,)) for v in L.STANCE]
    + [(f"refined_stance_{v}", "refined_stance", (v,)) for v in L.REFINED]
    + [(n, n, True) for n in ("off_topic_or_drift", "repetition_or_looping", "hybrid_or_contradictory_frame", "modern_explanatory_frame", "premodern_explanatory_frame")]
    + [(f"earth_motion_context_{v}", "earth_motion_context", (v,)) for v in L.MOTION_CONTEXT]
    + [(f"premodern_register_{v}", "premodern_register", (v,)) for v in L.REGISTER]
)


def holds(column: str, values: bool | tuple) -> Column:
    return F.coalesce(F.col(column), F.lit(False)) if values is True else F.coalesce(F.col(column).isin(*values), F.lit(False))


def summary_2(df: DataFrame, keys: Sequence[str], category: str, min_quality: int = 1) -> DataFrame:
    """Phase-2 counts and their rates of judged rows, for each key (category ALL) and each key and category."""
    ok = F.col("usable")
    aggs = [F.count("*").alias("n_total"), true(ok).alias("n_judged"), true(ok & (F.col("quality_score") >= min_quality)).alias("n_quality_ge_min"), true(ok & (F.col("quality_score") == 2)).alias("n_quality_2")]
    aggs += [true(ok & holds(c, v)).alias(f"n_{n}") for n, c, v in SUMMARY_2]
    aggs += [true(ok & holds("modern_explanatory_frame", True) & holds("premodern_explanatory_frame", True)).alias("n_hybrid_explanatory_frame")]
    ks = [F.col(k) for k in keys]
    sets = df.groupingSets([ks, [*ks, F.col(category)]], *ks, F.col(category)).agg(*aggs, F.grouping(category).alias("__all"))
    counts = [x for x in sets.columns if x.startswith("n_")]
    rates = [S.rate0(F.col(n), F.col("n_judged")).alias(f"rate_{n[2:]}") for n in counts if n not in ("n_total", "n_judged")]
    return sets.select(*keys, F.when(F.col("__all") == 1, "ALL").otherwise(F.col(category)).alias(category), *counts, *rates)


#: The conditional probabilities as (metric_id, what is counted, its condition; '' for all judged rows).
CONDITIONALS = (
    ("refined_stance_geocentric_given_model", "refined_stance = geocentric", ""),
    ("refined_stance_heliocentric_given_model", "refined_stance = heliocentric", ""),
    ("refined_stance_hybrid_or_contradictory_given_model", "refined_stance = hybrid_or_contradictory", ""),
    ("premodern_explanatory_frame_true_given_model", "premodern_explanatory_frame = true", ""),
    ("modern_explanatory_frame_true_given_model", "modern_explanatory_frame = true", ""),
    ("hybrid_or_contradictory_frame_true_given_model", "hybrid_or_contradictory_frame = true", ""),
    ("refined_stance_geocentric_given_premodern_explanatory_frame_true", "refined_stance = geocentric", "premodern_explanatory_frame = true"),
    ("refined_stance_heliocentric_given_modern_explanatory_frame_true", "refined_stance = heliocentric", "modern_explanatory_frame = true"),
    ("hybrid_or_contradictory_frame_true_given_earth_motion_mention_true", "hybrid_or_contradictory_frame = true", "earth_motion_mention = true"),
    ("refined_stance_geocentric_given_earth_motion_mention_true", "refined_stance = geocentric", "earth_motion_mention = true"),
    ("premodern_explanatory_frame_true_given_premodern_register_strong", "premodern_explanatory_frame = true", "premodern_register = strong"),
    ("modern_explanatory_frame_true_given_premodern_register_strong", "modern_explanatory_frame = true", "premodern_register = strong"),
    ("off_topic_or_drift_true_given_model", "off_topic_or_drift = true", ""),
    ("repetition_or_looping_true_given_model", "repetition_or_looping = true", ""),
)


def conditional_specs() -> list[tuple[str, str, Column, Column]]:
    """(metric_id, definition, denominator, numerator) of CONDITIONALS."""

    def is_so(test: str) -> Column:
        column, _, value = test.partition(" = ")
        return holds(column, True if value == "true" else (value,))

    out = []
    for name, what, cond in CONDITIONALS:
        den = is_so(cond) if cond else F.lit(True)
        out.append((name, f"P({what} | {cond}, model)" if cond else f"P({what} | model)", den, is_so(what) & den))
    return out


def conditionals(df: DataFrame, keys: Sequence[str], specs: Sequence[tuple[str, str, Column, Column]]) -> DataFrame:
    """Long form: numerator, denominator, rate (null without a denominator) and Wilson bounds for each key and metric."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric_id"), F.lit(d).alias("definition"), true(num & den).alias("numerator"), true(den).alias("denominator")) for m, d, den, num in specs])
    long = df.groupBy(*keys).agg(cells.alias("__c")).select(*keys, F.explode("__c").alias("c")).select(*keys, "c.*")
    low, high = S.wilson(F.col("numerator"), F.col("denominator"))
    return long.select("*", S.rate(F.col("numerator"), F.col("denominator")).alias("rate"), low.alias("ci_lower"), high.alias("ci_upper"))


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key: the first in file order. Aggregates before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*keys, "__r.*")


def pair_rows(df: DataFrame, variant: str, keys: Sequence[str], values: Sequence[str], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """df (one row for each variant and key) joined with itself for each (reference, comparison) pair of variants. The
    join is on the keys and the pair; rows are exploded by the few pairs they take part in, not crossed."""
    roles = F.create_map(*[x for v in {v for p in pairs for v in p} for x in (F.lit(v), F.array(*[F.lit(f"{a}|{b}") for a, b in pairs if a == v] or [F.lit(None).cast("string")]))])
    seconds = F.create_map(*[x for v in {v for p in pairs for v in p} for x in (F.lit(v), F.array(*[F.lit(f"{a}|{b}") for a, b in pairs if b == v] or [F.lit(None).cast("string")]))])
    side = lambda m, name: df.select(F.explode(F.try_element_at(m, F.col(variant))).alias("pair_id"), *keys, *[F.col(v).alias(f"{name}_{v}") for v in values]).where("pair_id is not null")
    joined = side(roles, "reference").join(side(seconds, "comparison"), ["pair_id", *keys])
    part = lambda i: F.element_at(F.split("pair_id", r"\|"), i)
    return joined.withColumn("reference_variant_label", part(1)).withColumn("comparison_variant_label", part(2))


def pair_diffs(rates: DataFrame, variant: str, keys: Sequence[str], metrics: Sequence[str], pairs: Sequence[tuple[str, str]] = L.VARIANT_PAIRS) -> DataFrame:
    """left, right and difference (right - left) of prompt rates for each pair of variants."""
    j = pair_rows(rates, variant, keys, metrics, pairs)
    return j.select("reference_variant_label", "comparison_variant_label", *keys, *[x for m in metrics for x in (F.col(f"reference_{m}").alias(f"left_{m}"), F.col(f"comparison_{m}").alias(f"right_{m}"), (F.col(f"comparison_{m}") - F.col(f"reference_{m}")).alias(f"diff_{m}"))])


PAIRED = ("refined_stance", "modern_explanatory_frame", "premodern_explanatory_frame", "hybrid_or_contradictory_frame", "earth_motion_mention")


def flips() -> dict[str, Column]:
    """The nine flip flags of a pair row with reference_ and comparison_ columns of PAIRED."""
    r, c = (lambda n: holds(f"reference_{n}", True)), (lambda n: holds(f"comparison_{n}", True))
    modern, old, mixed, motion = "modern_explanatory_frame", "premodern_explanatory_frame", "hybrid_or_contradictory_frame", "earth_motion_mention"
    turn = lambda a, b: holds("reference_refined_stance", (a,)) & holds("comparison_refined_stance", (b,))
    return {
        "modern_to_premodern_frame_flip": r(modern) & c(old),
        "premodern_to_modern_frame_flip": r(old) & c(modern),
        "heliocentric_to_geocentric_refined_stance_flip": turn("heliocentric", "geocentric"),
        "geocentric_to_heliocentric_refined_stance_flip": turn("geocentric", "heliocentric"),
        "modern_suppression": r(modern) & ~c(modern),
        "premodern_activation": ~r(old) & c(old),
        "hybridization_activation": ~r(mixed) & c(mixed),
        "earth_motion_suppression": r(motion) & ~c(motion),
        "earth_motion_activation": ~r(motion) & c(motion),
    }


REVERSE = {"modern_to_premodern_frame_flip": "premodern_to_modern_frame_flip", "heliocentric_to_geocentric_refined_stance_flip": "geocentric_to_heliocentric_refined_stance_flip", "earth_motion_suppression": "earth_motion_activation"}


def flip_rates(pairs: DataFrame, keys: Sequence[str], metrics: dict[str, Column] | None = None) -> DataFrame:
    """Long form: count, denominator, rate and Wilson bounds of each flip for each key."""
    metrics = metrics or flips()
    cells = F.array(*[F.struct(F.lit(m).alias("metric_id"), true(f).alias("count")) for m, f in metrics.items()])
    long = pairs.groupBy(*keys).agg(F.count("*").alias("denominator"), cells.alias("__c")).select(*keys, F.explode("__c").alias("c"), "denominator").select(*keys, "c.*", "denominator")
    low, high = S.wilson(F.col("count"), F.col("denominator"))
    return long.select("*", S.rate(F.col("count"), F.col("denominator")).alias("rate"), low.alias("ci_lower"), high.alias("ci_upper"))


def flip_tests(rates: DataFrame, keys: Sequence[str], reverse: dict[str, str] = REVERSE) -> DataFrame:
    """Adds reverse_count, chi2_stat and p_value (McNemar) to the directional flips; null for the others. Counts of a
    key are gathered in a map (nine entries) by a window, so nothing is joined."""
    w = Window.partitionBy(*keys)
    counts = F.map_from_entries(F.collect_list(F.struct("metric_id", "count")).over(w))
    back = F.create_map(*[F.lit(x) for kv in reverse.items() for x in kv])
    d = rates.withColumn("__counts", counts).withColumn("reverse_count", F.try_element_at("__counts", F.try_element_at(back, F.col("metric_id")))).drop("__counts")
    d = d.withColumn("chi2_stat", S.mcnemar(F.col("count"), F.col("reverse_count")))
    return d.withColumn("p_value", S.chi2_p(F.col("chi2_stat")))


def susceptibility(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For each prompt: paired samples, four flip fractions and six rates."""
    f = flips()
    frac = lambda c: S.rate0(true(c), F.count("*"))
    rates = [frac(holds(f"{s}_refined_stance", ("geocentric",))).alias(f"{s}_geocentric_rate") for s in ("reference", "comparison")]
    rates += [frac(holds(f"{s}_{n}_explanatory_frame", True)).alias(f"{s}_{n}_rate") for n in ("premodern", "modern") for s in ("reference", "comparison")]
    return pairs.groupBy(*keys).agg(F.count("*").alias("n_paired_samples"), *[frac(f[m]).alias(f"fraction_{m}") for m in ("modern_to_premodern_frame_flip", "premodern_activation", "modern_suppression", "hybridization_activation")], *rates)


def permutation_test(diffs: DataFrame, scope: str, metric: str, pair: Sequence[str], diff: str, n: int = 10_000, seed: int = 12345) -> DataFrame:
    """Two-sided paired sign-flip test for each scope and metric. Differences are integers (numerators over one
    denominator), so ties are exact. Signs of 256 permutations are the bits of one SHA-256 of (seed, number of the 256,
    pair), four to a hexadecimal digit; a digit's four sums are added up map-side. Null differences count as 0."""
    d = diffs.select(scope, metric, F.concat_ws("|", *[F.col(p).cast("string") for p in pair]).alias("__pair"), F.coalesce(F.col(diff).cast("bigint"), F.lit(0)).alias("__d"))
    observed = written(d.groupBy(scope, metric).agg(F.count("*").alias("n_pairs"), F.sum("__d").alias("total")))
    hashed = d.select(scope, metric, "__d", "__pair", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // 256))).alias("__b"))
    bits = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("__b").cast("string"), "__pair"), 256)
    digits = hashed.select(scope, metric, "__d", "__b", F.posexplode(F.split(bits, "(?<=.)(?=.)")).alias("__at", "__digit"))
    value = F.instr(F.lit("0123456789abcdef"), F.col("__digit")) - 1
    signed = lambda j: F.sum(F.when(F.getbit(value, F.lit(j)) == 1, F.col("__d")).otherwise(-F.col("__d")))
    four = digits.groupBy(scope, metric, "__b", "__at").agg(F.array(*[signed(j) for j in range(4)]).alias("__sums"))
    sums = four.select(scope, metric, "__b", "__at", F.posexplode("__sums").alias("__j", "s")).where(F.col("__b") * 256 + F.col("__at") * 4 + F.col("__j") < n)
    tail = sums.join(small(observed, 100), [scope, metric]).groupBy(scope, metric).agg(F.count_if(F.abs("s") >= F.abs("total")).alias("extreme"))
    return observed.join(tail, [scope, metric]).select(scope, metric, "n_pairs", "total", "extreme", (F.col("extreme") / F.lit(n)).alias("p_value"))


def permutation_test_compat(diffs: DataFrame, scope: str, metric: str, order: Sequence[str], diff: str, n: int = 10_000, seed: int = 12345) -> DataFrame:
    """The same test with one generator re-seeded for each test, differences in key order and float sums: for comparing
    with published p-values. A test's differences are in one task (one number for each prompt), as its draws are one
    sequence; they are made and added up as arrays. Null differences are no pairs; a test whose rows are all null has 0 pairs,
    mean 0 and p 1."""
    import pandas as pd

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        import random
        import statistics

        import numpy as np

        values = pdf.dropna(subset=[diff]).sort_values(list(order))[diff].to_numpy(float)
        observed, p = 0.0, 1.0
        if len(values):
            observed = statistics.mean(values.tolist())  # exact, as published
            state = random.Random(seed).getstate()[1]
            draws = np.random.RandomState()
            draws.set_state(("MT19937", state[:-1], state[-1]))  # the same numbers as the generator's
            whole = bool((values == np.floor(values)).all()) and float(np.abs(values).sum()) < 2.0**53  # then any order gives the same sum
            block, extreme = max(1, (1 << 20) // len(values)), 0
            for at in range(0, n, block):
                signed = np.where(draws.random_sample((min(block, n - at), len(values))) < 0.5, values, -values)
                sums = signed.sum(axis=1) if whole else np.add.accumulate(signed, axis=1)[:, -1]  # plain float sums, in order
                extreme += int((np.abs(sums / len(values)) >= abs(observed)).sum())
            p = extreme / n
        return pd.DataFrame([(pdf[scope].iloc[0], pdf[metric].iloc[0], len(values), observed, p)], columns=[scope, metric, "n_pairs", "mean_diff", "p_value"])

    return diffs.groupBy(scope, metric).applyInPandas(test, f"{scope} string, {metric} string, n_pairs long, mean_diff double, p_value double")


def paired_differences(counts: DataFrame, model: str, pair: tuple[str, str], category: str, prompt: str, metrics: Sequence[str]) -> DataFrame:
    """(scope, metric, pair_key, diff): counts of the second model less those of the first for each prompt both have, for
    all prompts and for each category. counts: one row for each model, category and prompt."""
    side = lambda m, tag: counts.where(F.col(model) == m).select(category, prompt, *[F.col(x).alias(f"{tag}_{x}") for x in metrics])
    both = side(pair[0], "a").join(side(pair[1], "b"), [category, prompt])
    cells = F.array(*[F.struct(F.lit(x).alias("metric"), (F.col(f"b_{x}") - F.col(f"a_{x}")).cast("bigint").alias("diff")) for x in metrics])
    key = F.concat_ws("|", F.col(category).cast("string"), F.col(prompt).cast("string")).alias("pair_key")
    scopes = F.explode(F.array(F.lit("overall"), F.col(category))).alias("scope")
    return both.select(key, scopes, cells.alias("c")).select("pair_key", "scope", F.explode("c").alias("c")).select("scope", "c.metric", "pair_key", "c.diff")


def choose_pair(df: DataFrame, model: str) -> tuple[tuple[str, str] | None, str]:
    """The two models to compare: A and B if both are there, else the only two, else none; and a note."""
    models = sorted(r[0] for r in df.select(model).where(F.col(model).isNotNull()).distinct().limit(3).collect())
    if {r[0] for r in df.where(F.col(model).isin("A", "B")).select(model).distinct().collect()} == {"A", "B"}:
        return ("A", "B"), "comparing A and B"
    if len(models) == 2:
        return (models[0], models[1]), f"comparing {models[0]} and {models[1]}"
    return None, f"needs A and B or exactly two models; found {len(models)}{' or more' if len(models) == 3 else ''}"


def load_counters(lines: DataFrame, text: str = "value", include_errors: bool = False) -> DataFrame:
    """Counters of a JSON-lines table: lines, blank, malformed (no JSON object), objects, with an error, without a
    result, usable."""
    v = F.try_parse_json(F.col(text))
    obj = F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
    blank = F.trim(F.coalesce(F.col(text), F.lit(""))) == ""
    error = F.coalesce(F.try_variant_get(v, "$.judge_error", "string"), F.lit("")) != ""
    result = F.startswith(F.schema_of_variant(F.try_variant_get(v, "$.judge_result", "variant")), F.lit("OBJECT"))
    is_obj, has_result = F.coalesce(obj & ~blank, F.lit(False)), F.coalesce(result, F.lit(False))
    good = is_obj & has_result & (~error if not include_errors else F.lit(True))
    return lines.agg(F.count("*").alias("n_lines"), true(blank).alias("n_blank"), true(~is_obj).alias("n_malformed"), true(is_obj).alias("n_parsed"), true(is_obj & error).alias("n_error"), true(is_obj & ~has_result).alias("n_missing_result"), true(good).alias("n_usable"))

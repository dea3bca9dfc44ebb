"""Audits: does an observed field equal, or tell about, an outcome still to come?

All of them put field observations on the time line of outcomes once and reduce to
one row per (path, target) before anything is compared across targets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators.temporal import assign_interval
from tidemark.plans.ordering import number
from tidemark.plans.quantiles import fits_one_task, in_seconds, summarise

# Fragments of a path that sound like an outcome.
OUTCOME_TERMS = [
    "nextmultiplier", "finalmultiplier", "resultmultiplier", "crashmultiplier", "crashpoint",
    "payoutmultiplier", "coefficient", "coef", "multiplier",
]
PATH = ["series", "path"]


def outcome_like(path: Column) -> Column:
    plain = F.regexp_replace(F.lower(path), r"[^\p{L}\p{N}]", "")
    return plain.rlike("|".join(OUTCOME_TERMS))


def _with_onsets(outcomes: DataFrame, onsets: DataFrame) -> DataFrame:
    """Outcomes with the onset of the interval they end, if one was found."""
    found = onsets.select("series", F.col("target_ts").alias("ts"), "onset_ts")
    rows = outcomes.select("series", "ts", "outcome_id", "value")
    return rows.join(found, ["series", "ts"], "left")


def _lead(from_: str, to: str) -> Column:
    return C.seconds(C.micros(to) - C.micros(from_))


def exact_match_hits(outcomes: DataFrame, onsets: DataFrame, fields: DataFrame) -> DataFrame:
    """Per (path, target) seen: the earliest field value equal to the target, if any."""
    numeric = fields.where(F.col("number").isNotNull())
    numeric = numeric.select("series", "ts", "obs_id", "path", "number", "obs_kind", "url")
    inside = assign_interval(_with_onsets(outcomes, onsets), numeric, carry=["onset_ts"])
    target = F.col("target_value")
    tolerance = F.greatest(
        F.lit("0.001").cast("decimal(38,18)"),
        (F.abs(target).cast("decimal(28,8)") * F.lit("0.000001").cast("decimal(7,6)")).cast("decimal(38,18)"),
    )
    same = F.abs(F.col("number").cast("decimal(38,18)") - target) <= tolerance
    match = F.struct("ts", "obs_id", "number", "obs_kind", "url")
    return inside.groupBy(*PATH, "target_ts", "target_id", "target_value", "onset_ts").agg(
        F.min(F.when(same, match)).alias("earliest")
    ).withColumns(
        {
            "lead_seconds": _lead("earliest.ts", "target_ts"),
            "before_onset": F.coalesce(F.col("earliest.ts") < F.col("onset_ts"), F.lit(False)),
        }
    )


def exact_match_leak_audit(
    outcomes: DataFrame, onsets: DataFrame, fields: DataFrame
) -> DataFrame:
    """Per field path: how often, how early and whether before the onset it equalled
    the outcome that followed, with a verdict."""
    hits = exact_match_hits(outcomes, onsets, fields)
    lead, matched = F.col("lead_seconds"), F.col("earliest").isNotNull()
    aggregates = [
        F.count("*").alias("target_intervals_seen"),
        F.count_if(matched).alias("exact_match_targets"),
        F.count_if(lead >= 0.25).alias("exact_matches_ge_025s"),
        F.count_if(lead >= 1.0).alias("exact_matches_ge_1s"),
        F.count_if(lead >= 2.0).alias("exact_matches_ge_2s"),
        F.count_if(lead >= 5.0).alias("exact_matches_ge_5s"),
        F.count_if(matched & F.col("before_onset")).alias("exact_matches_before_onset"),
        C.places(F.max(lead)).alias("maximum_lead_seconds"),
    ]
    lead_us = C.micros("target_ts") - C.micros("earliest.ts")
    report = summarise(hits, PATH, aggregates, {"m": lead_us}, fits_one_task(fields))
    counts = fields.where(F.col("number").isNotNull()).groupBy(*PATH).agg(
        F.count("*").alias("observations")
    )
    names = [
        "target_intervals_seen", "exact_match_targets", "exact_matches_ge_025s",
        "exact_matches_ge_1s", "exact_matches_ge_2s", "exact_matches_ge_5s",
        "exact_matches_before_onset",
    ]
    verdict = (
        F.when(F.col("exact_matches_before_onset") > 0, "POTENTIAL_PRESTART_DISCLOSURE")
        .when(F.col("exact_matches_ge_5s") > 0, "POTENTIAL_EARLY_DISCLOSURE")
        .when(F.col("exact_matches_ge_1s") > 0, "REVIEW_TIMING")
        .otherwise("NO_DIRECT_LEAK")
    )
    return (
        counts.join(report, PATH, "left")
        .withColumn("median_lead_seconds", in_seconds("m"))
        .drop("m")
        .fillna(0, names)
        .withColumns({"outcome_like_path": outcome_like(F.col("path")), "verdict": verdict})
    )


def exact_match_examples(hits: DataFrame, limit: int = 30) -> DataFrame:
    """The clearest matches: those before the onset first, then by lead."""
    found = hits.where(F.col("earliest").isNotNull())
    return found.orderBy(F.desc("before_onset"), F.desc("lead_seconds"), "path", "target_ts").limit(limit)


def identifier_exposure(outcomes: DataFrame, onsets: DataFrame, fields: DataFrame) -> DataFrame:
    """Per identifier path: sightings, distinct hashes, and intervals seen before the onset."""
    hashed = fields.where(F.col("identifier").isNotNull())
    hashed = hashed.select("series", "ts", "obs_id", "path", "identifier")
    inside = assign_interval(_with_onsets(outcomes, onsets), hashed, carry=["onset_ts"])
    per_target = inside.groupBy(*PATH, "target_ts").agg(
        F.max(F.coalesce(F.col("ts") < F.col("onset_ts"), F.lit(False))).alias("early")
    )
    intervals = per_target.groupBy(*PATH).agg(
        F.count("*").alias("target_intervals_seen"),
        F.count_if("early").alias("intervals_with_preonset"),
    )
    counts = hashed.groupBy(*PATH).agg(
        F.count("*").alias("observations"), F.count_distinct("identifier").alias("unique_hashes")
    )
    return counts.join(intervals, PATH, "left").fillna(
        0, ["target_intervals_seen", "intervals_with_preonset"]
    )


def _before_cutoff(
    outcomes: DataFrame, onsets: DataFrame, rows: DataFrame, margin_seconds: float
) -> DataFrame:
    """Rows in (previous outcome, onset - margin] of intervals that have an onset."""
    inside = assign_interval(_with_onsets(outcomes, onsets), rows, carry=["onset_ts"])
    cutoff = C.micros("onset_ts") - C.to_micros(margin_seconds)
    return inside.where(
        F.col("onset_ts").isNotNull() & (C.micros("ts") <= cutoff) & (cutoff > C.micros("prev_ts"))
    )


def any_last_match_audit(
    outcomes: DataFrame,
    onsets: DataFrame,
    fields: DataFrame,
    margin_seconds: float = 0.5,
    tolerance: float = 0.001,
) -> DataFrame:
    """Per path: does any value, or the last one, before the onset equal the outcome?"""
    numeric = fields.where(F.col("number").isNotNull())
    numeric = numeric.select("series", "ts", "obs_id", "path", "number", "field_no")
    seen = _before_cutoff(outcomes, onsets, numeric, margin_seconds)
    same = F.abs(F.col("number") - F.col("target_value").cast("double")) <= tolerance
    per_target = seen.withColumn("same", same).groupBy(*PATH, "target_ts", "onset_ts").agg(
        F.max("same").alias("any"),
        F.max(F.struct("ts", "obs_id", "field_no", "same")).alias("last"),
    ).withColumn("lead", _lead("last.ts", "onset_ts"))
    n = F.count("*")
    aggregates = [
        n.alias("rounds_observed"),
        F.count_if("any").alias("any_exact_matches"),
        F.count_if("last.same").alias("last_exact_matches"),
        C.ratio(F.count_if("any"), n).alias("any_match_rate"),
        C.ratio(F.count_if("last.same"), n).alias("last_match_rate"),
        C.places(F.min("lead")).alias("minimum_last_lead_seconds"),
    ]
    distinct = seen.groupBy(*PATH).agg(F.count_distinct("number").alias("distinct_values"))
    lead_us = C.micros("onset_ts") - C.micros("last.ts")
    report = summarise(per_target, PATH, aggregates, {"m": lead_us}, fits_one_task(fields))
    severe = (F.col("rounds_observed") >= 5) & (F.col("last_match_rate") >= 0.8)
    return (
        report.join(distinct, PATH)
        .withColumn("median_last_lead_seconds", in_seconds("m"))
        .drop("m")
        .withColumn("severity", F.when(severe, "DIRECT_LEAK_CANDIDATE").otherwise("REVIEW"))
    )


def identifier_rounds(
    outcomes: DataFrame, onsets: DataFrame, fields: DataFrame, margin_seconds: float = 0.5
) -> DataFrame:
    """Identifier paths seen before the cutoff: intervals and distinct hashes."""
    hashed = fields.where(F.col("identifier").isNotNull())
    hashed = hashed.select("series", "ts", "obs_id", "path", "identifier")
    seen = _before_cutoff(outcomes, onsets, hashed, margin_seconds)
    return seen.groupBy(*PATH).agg(
        F.count_distinct("target_ts").alias("rounds_observed"),
        F.count_distinct("identifier").alias("unique_hashes"),
    )


def _event_fields(events: DataFrame) -> DataFrame:
    return events.select(
        "series", "ts", "obs_id", F.posexplode("fields").alias("field_no", "field")
    ).select(
        "series", "ts", "obs_id", "field_no",
        F.col("field.path").alias("path"),
        F.when(F.col("field.kind") == "numeric", F.col("field.value")).alias("number"),
        F.when(F.col("field.kind") == "identifier_hash", F.col("field.sha256_24")).alias("identifier"),
    ).where(F.col("path").isNotNull())


def disclosure_audit(
    outcomes: DataFrame,
    onsets: DataFrame,
    events: DataFrame,
    margin_seconds: float = 2.0,
    tolerance: float = 0.01,
) -> DataFrame:
    """Per numeric path: how often it equals the coming outcome rather than the last one.

    A field that repeats the previous outcome is an echo, not a disclosure.
    """
    rows = _event_fields(events)
    # NaN and infinities are no numbers here.
    finite = F.col("number").isNotNull() & (F.abs("number") < float("inf")) & ~F.isnan("number")
    seen = _before_cutoff(outcomes, onsets, rows.where(finite).drop("identifier"), margin_seconds)

    def close(name: str) -> Column:
        return F.abs(F.col("number") - F.col(name).cast("double")) <= tolerance

    seen = seen.withColumn("lead", _lead("ts", "onset_ts"))
    aggregates = [
        F.count("*").alias("observations"),
        F.count_distinct("target_ts").alias("rounds"),
        F.count_if(close("target_value")).alias("target_matches"),
        F.count_if(close("prev_value")).alias("previous_matches"),
        C.places(F.min("lead")).alias("minimum_lead_seconds"),
    ]
    target = F.col("target_matches") / F.col("observations")
    previous = F.col("previous_matches") / F.col("observations")
    leak = (F.col("target_matches") >= 3) & (target >= 0.8) & (target >= previous + 0.2)
    lead_us = C.micros("onset_ts") - C.micros("ts")
    report = summarise(seen, PATH, aggregates, {"m": lead_us}, fits_one_task(events))
    return report.withColumns(
        {
            "median_lead_seconds": in_seconds("m"),
            "target_match_rate": C.ratio("target_matches", "observations"),
            "previous_match_rate": C.ratio("previous_matches", "observations"),
            "verdict": F.when(leak, "CANDIDATE_PRE_ROUND_DISCLOSURE").otherwise("NO_DIRECT_DISCLOSURE"),
        }
    ).drop("m")


def identifier_leads(
    outcomes: DataFrame, onsets: DataFrame, events: DataFrame, margin_seconds: float = 2.0
) -> DataFrame:
    """Per identifier path before the cutoff: sightings, intervals, hashes, median lead."""
    rows = _event_fields(events).where(F.col("identifier").isNotNull()).drop("number")
    seen = _before_cutoff(outcomes, onsets, rows, margin_seconds)
    seen = seen.withColumn("lead", _lead("ts", "onset_ts"))
    aggregates = [
        F.count("*").alias("observations"),
        F.count_distinct("target_ts").alias("rounds"),
        F.count_distinct("identifier").alias("unique_hashes"),
    ]
    lead_us = C.micros("onset_ts") - C.micros("ts")
    report = summarise(seen, PATH, aggregates, {"m": lead_us}, fits_one_task(events))
    return report.withColumn("median_lead_seconds", in_seconds("m")).drop("m")


def eligible_intervals(onsets: DataFrame, outcomes: DataFrame, margin_seconds: float) -> DataFrame:
    """Onset intervals long enough for the margin, numbered by onset, with their target."""
    targets = outcomes.select("series", F.col("ts").alias("target_ts"), F.col("value").alias("target_value"))
    rows = onsets.select("series", "prev_ts", "target_ts", "onset_ts").where(
        C.micros("onset_ts") - C.to_micros(margin_seconds) > C.micros("prev_ts")
    )
    rows = rows.join(targets, ["series", "target_ts"]).withColumn("_at", F.col("onset_ts"))
    return number(rows, ["series"], ["_at", "target_ts"], "rank").drop("_at")


def _interval_tokens(
    outcomes: DataFrame, onsets: DataFrame, events: DataFrame, margin_seconds: float
) -> DataFrame:
    """Distinct ``path=value`` tokens per interval."""
    words = events.select("series", "ts", "obs_id", F.explode("categories").alias("c"))
    named = (F.col("c.path") != "") & (F.col("c.value") != "")
    words = words.where(named).select(
        "series", "ts", "obs_id", F.concat_ws("=", "c.path", "c.value").alias("token")
    )
    seen = _before_cutoff(outcomes, onsets, words, margin_seconds)
    return seen.select("series", "target_ts", "token").distinct()


def category_holdout(
    outcomes: DataFrame,
    onsets: DataFrame,
    events: DataFrame,
    margin_seconds: float = 2.0,
    discovery_fraction: float = 0.60,
    minimum_support: int = 5,
    thresholds: Sequence[str] = ("1.5", "2", "5"),
    top: int = 20,
) -> DataFrame:
    """Tokens whose intervals had unusual outcomes early on, measured again later.

    Lift is the hit rate with the token less the overall rate of the same part; the
    20 tokens with the largest abs(lift) * sqrt(support) of the discovery part are
    kept per threshold, ties by the larger token.
    """
    intervals = eligible_intervals(onsets, outcomes, margin_seconds)
    sizes = intervals.groupBy("series").agg(F.count("*").alias("n"))
    n = F.col("n")
    split = F.when(
        n > 1, F.greatest(F.lit(1), F.least(n - 1, F.floor(n * F.lit(discovery_fraction)).cast("bigint")))
    ).otherwise(0)
    limits = F.explode(C.number_list(thresholds, "decimal(18,6)"))
    labelled = (
        intervals.join(sizes, "series")
        .withColumn("discovery", F.col("rank") < split)
        .select("series", "target_ts", "target_value", "discovery", limits.alias("threshold"))
        .withColumn("hit", C.hit("target_value", "threshold"))
    )
    key = ["series", "threshold"]

    def rate(discovery: bool) -> Column:
        part = F.col("discovery") if discovery else ~F.col("discovery")
        return F.avg(F.when(part, F.col("hit").cast("double")))

    overall = labelled.groupBy(*key).agg(rate(True).alias("early"), rate(False).alias("late"))
    tokens = _interval_tokens(outcomes, onsets, events, margin_seconds)
    joined = labelled.join(tokens, ["series", "target_ts"])
    stats = joined.groupBy(*key, "token").agg(
        F.count_if("discovery").alias("discovery_support"),
        rate(True).alias("discovery_rate"),
        F.count_if(~F.col("discovery")).alias("holdout_support"),
        rate(False).alias("holdout_rate"),
    ).where(F.col("discovery_support") >= minimum_support)
    stats = stats.join(overall.where("early is not null and late is not null"), key)
    lift = F.col("discovery_rate") - F.col("early")
    later = F.col("holdout_rate") - F.col("late")
    score = F.abs(lift) * F.sqrt(F.col("discovery_support").cast("double"))
    order = Window.partitionBy(*key).orderBy(F.desc("_score"), F.desc("token"))
    best = stats.withColumn("_score", score).withColumn("_r", F.row_number().over(order))
    same = (lift == 0) | (later == 0) | ((lift > 0) == (later > 0))
    return best.where(F.col("_r") <= top).select(
        *key, "token", "discovery_support",
        C.places(F.col("discovery_rate")).alias("discovery_positive_rate"),
        C.places(lift).alias("discovery_lift"),
        "holdout_support",
        C.places(F.col("holdout_rate")).alias("holdout_positive_rate"),
        C.places(later).alias("holdout_lift"),
        F.coalesce(same, F.lit(False)).alias("direction_consistent"),
    )


def interval_coverage(
    outcomes: DataFrame, onsets: DataFrame, events: DataFrame, margin_seconds: float = 2.0
) -> DataFrame:
    """Eligible intervals, those with metadata, messages in them and distinct tokens."""
    intervals = eligible_intervals(onsets, outcomes, margin_seconds)
    rows = events.select("series", "ts", "obs_id", (F.size("categories") > 0).alias("worded"))
    seen = _before_cutoff(outcomes, onsets, rows, margin_seconds)
    counts = intervals.groupBy("series").agg(F.count("*").alias("eligible_intervals"))
    inside = seen.groupBy("series").agg(
        F.count_distinct("target_ts").alias("metadata_intervals"),
        F.count("*").alias("json_events"),
        F.count_if("worded").alias("categorical_events"),
    )
    tokens = _interval_tokens(outcomes, onsets, events, margin_seconds)
    unique = tokens.groupBy("series").agg(F.count_distinct("token").alias("unique_tokens"))
    return counts.join(inside, "series", "left").join(unique, "series", "left").fillna(0)

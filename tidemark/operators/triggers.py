"""Signatures that precede onsets: discovery on early onsets, use on later ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators.temporal import assign_interval
from tidemark.plans.ordering import number
from tidemark.plans.quantiles import fits_one_task, median_seconds

SPAN = ["prev_ts", "target_ts"]


def rank_onsets(onsets: DataFrame, discovery_fraction: float) -> DataFrame:
    """Number onsets by time and mark the early fraction as discovery."""
    rows = onsets.withColumn("_at", F.col("onset_ts"))
    ranked = number(rows, ["series"], ["_at", "target_ts"], "rank").drop("_at")
    sizes = onsets.groupBy("series").agg(F.count("*").alias("onsets"))
    n = F.col("onsets")
    split = F.greatest(
        F.lit(1), F.least(n - 1, F.floor(n * F.lit(discovery_fraction)).cast("bigint"))
    )
    return ranked.join(sizes, "series").withColumn("discovery", F.col("rank") < split)


def _around_onsets(onsets: DataFrame, observations: DataFrame, extra: list[str]) -> DataFrame:
    """Observations inside the interval of an onset, with that onset's columns.

    Interval ends are the outcomes; a target without an onset still closes its
    interval, because every onset also contributes the outcome it starts from.
    """
    ends = onsets.select(
        "series", F.col("target_ts").alias("ts"), F.lit("0").alias("outcome_id"),
        F.lit(None).cast("decimal(18,6)").alias("value"), F.col("prev_ts").alias("begin_ts"),
        "onset_ts", *extra,
    )
    begins = onsets.select("series", F.col("prev_ts").alias("ts"), F.lit("1").alias("outcome_id"))
    line = ends.unionByName(begins, allowMissingColumns=True)
    inside = assign_interval(line, observations, carry=["begin_ts", "onset_ts", *extra])
    # An instant that ends one interval and begins the next occurs twice; the end sorts
    # first, so an observation before it finds its own interval.
    return inside.where(
        F.col("onset_ts").isNotNull()
        & (F.col("ts") > F.col("begin_ts"))
        & (F.col("ts") < F.col("onset_ts"))
    ).drop("prev_ts", "prev_id", "prev_value", "target_id", "target_value").withColumnRenamed(
        "begin_ts", "prev_ts"
    )


def discover_triggers(
    onsets: DataFrame,
    observations: DataFrame,
    discovery_fraction: float = 0.55,
    lookback_seconds: float = 2.5,
    minimum_lead_seconds: float = 0.20,
    minimum_hits: int = 4,
    minimum_hit_rate: float = 0.12,
    minimum_enrichment: float = 1.5,
    max_signatures: int = 12,
) -> DataFrame:
    """Signatures that occur shortly before onsets more often than in the background.

    ``observations`` needs a ``signature`` column. Only discovery onsets count; rates
    divide by all of them, also those too close to their outcome to be searched. Ties
    in the ranking go to the smaller signature.
    """
    if lookback_seconds <= minimum_lead_seconds or minimum_lead_seconds <= 0:
        raise ValueError("lookback_seconds must exceed a positive minimum lead.")
    lookback, lead_min = C.to_micros(lookback_seconds), C.to_micros(minimum_lead_seconds)
    early = rank_onsets(onsets, discovery_fraction).where("discovery")
    prev, onset = C.micros("prev_ts"), C.micros("onset_ts")
    near_left, near_right = F.greatest(prev, onset - lookback), onset - lead_min
    searched = (onset > prev) & (near_right > near_left)
    totals = early.groupBy("series").agg(
        F.count("*").alias("discovery_onsets"),
        F.sum(F.when(searched, near_left - prev).otherwise(0)).alias("background_us"),
    )
    seen = _around_onsets(
        early.where(searched).select("series", *SPAN, "onset_ts"),
        observations.select("series", "ts", "obs_id", "signature"), [],
    )
    at = C.micros("ts")
    near = (at >= near_left) & (at <= near_right)
    behind = ~near & (at < near_left)
    per_onset = seen.groupBy("series", "signature", "target_ts").agg(
        F.count_if(near).alias("near"),
        F.count_if(behind).alias("background"),
        F.min(F.when(near, onset - at)).alias("lead"),
    )
    rows = per_onset.groupBy("series", "signature").agg(
        F.count_if(F.col("near") > 0).alias("hits"),
        F.sum("near").alias("near"),
        F.sum("background").alias("background"),
        (F.min("lead") / 1e6).alias("minimum_lead"),
    ).where((F.col("hits") >= minimum_hits) & (F.col("minimum_lead") >= minimum_lead_seconds))
    rows = rows.join(totals, "series")
    n = F.col("discovery_onsets")
    hit_rate = F.col("hits") / n
    near_rate = F.col("near") / F.greatest(
        F.lit(1e-9), F.lit(lookback_seconds - minimum_lead_seconds) * n
    )
    background_rate = F.when(
        F.col("background_us") > 0, F.col("background") / (F.col("background_us") / 1e6)
    ).otherwise(0.0)
    enrichment = (near_rate + 1e-6) / (background_rate + 1e-6)
    rows = rows.withColumns({"hit_rate": hit_rate, "enrichment": enrichment}).where(
        (F.col("hit_rate") >= minimum_hit_rate) & (F.col("enrichment") >= minimum_enrichment)
    )
    score = F.col("hit_rate") * F.log1p("enrichment") * F.log1p(F.col("hits").cast("double"))
    rows = rows.withColumn("score", C.places(score)).withColumns(
        {
            "hit_rate": C.places(F.col("hit_rate")),
            "enrichment": C.places(F.col("enrichment")),
            "minimum_lead": C.places(F.col("minimum_lead")),
        }
    )
    order = Window.partitionBy("series").orderBy(
        F.desc("score"), F.desc("hit_rate"), F.desc("enrichment"), F.desc("minimum_lead"), "signature"
    )
    best = rows.withColumn("rank", (F.row_number().over(order) - 1).cast("bigint")).where(
        F.col("rank") < max_signatures
    )
    leads = {"m": onset - at}
    middle = median_seconds(seen.where(near), ["series", "signature"], leads, fits_one_task(observations))
    return best.join(middle, ["series", "signature"]).select(
        "series", "signature", "rank", "discovery_onsets", "hits", "hit_rate",
        F.col("near").alias("occurrences_near_onset"),
        F.col("background").alias("background_occurrences"),
        "enrichment", F.col("m").alias("median_lead_seconds"),
        F.col("minimum_lead").alias("minimum_lead_seconds"), "score",
    )


def apply_triggers(
    onsets: DataFrame,
    observations: DataFrame,
    signatures: DataFrame,
    minimum_lead_seconds: float = 0.20,
) -> DataFrame:
    """First observation per onset interval that carries a frozen signature.

    ``onsets`` are those to apply to, usually the later fraction. The lead to the
    onset is checked, so this judges signatures afterwards; live use goes by age.
    """
    frozen = signatures.select("series", "signature", "score", "rank")
    marked = observations.join(frozen, ["series", "signature"])
    seen = _around_onsets(onsets.select("series", *SPAN, "onset_ts"), marked, [])
    lead = C.micros("onset_ts") - C.micros("ts")
    seen = seen.where(lead >= C.to_micros(minimum_lead_seconds))
    kept = [c for c in seen.columns if c not in ("series", *SPAN, "onset_ts")]
    first = F.min_by(F.struct(*kept), F.struct("ts", "obs_id"))
    found = seen.groupBy("series", *SPAN, "onset_ts").agg(first.alias("f"))
    gap = lambda a, b: C.places(C.seconds(C.micros(a) - C.micros(b)))
    return found.select(
        "series", *SPAN, "onset_ts",
        F.col("f.ts").alias("trigger_ts"),
        *[F.col(f"f.{c}").alias(c) for c in kept if c != "ts"],
        gap("onset_ts", "f.ts").alias("lead_seconds"),
        gap("f.ts", "prev_ts").alias("age_seconds"),
    )


def trigger_coverage(triggers: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Share of the evaluated onsets with a trigger, and its leads and ages."""
    counts = evaluated.groupBy("series").agg(F.count("*").alias("evaluated"))
    found = triggers.groupBy("series").agg(
        F.count("*").alias("triggers"), F.min("lead_seconds").alias("minimum_lead_seconds")
    )
    middle = median_seconds(
        triggers, ["series"],
        {
            "median_lead_seconds": C.micros("onset_ts") - C.micros("trigger_ts"),
            "median_age_seconds": C.micros("trigger_ts") - C.micros("prev_ts"),
        },
        fits_one_task(triggers),
    )
    joined = counts.join(found, "series", "left").join(middle, "series", "left")
    return joined.withColumns(
        {
            "triggers": F.coalesce("triggers", F.lit(0)),
            "coverage": C.ratio(F.coalesce("triggers", F.lit(0)), "evaluated"),
        }
    )


def recent_trigger_refresh(
    onsets: DataFrame, observations: DataFrame, recent: int = 48, **config
) -> DataFrame:
    """Discovery on the last ``recent`` onsets of each series with looser limits."""
    order = Window.partitionBy("series").orderBy(F.desc("onset_ts"), F.desc("target_ts"))
    latest = onsets.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= recent)
    sizes = latest.groupBy("series").agg(F.count("*").alias("_n")).where(F.col("_n") >= 3)
    latest = latest.drop("_r").join(sizes.select("series"), "series", "left_semi")
    settings = {
        "discovery_fraction": 0.80, "lookback_seconds": 2.5, "minimum_lead_seconds": 0.20,
        "minimum_hits": 3, "minimum_hit_rate": 0.10, "minimum_enrichment": 1.25,
        "max_signatures": 16, **config,
    }
    return discover_triggers(latest, observations, **settings)


def onset_gap_summary(onsets: DataFrame) -> DataFrame:
    """Median time from outcome to onset and from onset to the next outcome."""

    counts = onsets.groupBy("series").agg(F.count("*").alias("onsets"))
    spans = {
        "median_outcome_to_onset": C.micros("onset_ts") - C.micros("prev_ts"),
        "median_onset_to_outcome": C.micros("target_ts") - C.micros("onset_ts"),
    }
    return counts.join(median_seconds(onsets, ["series"], spans, fits_one_task(onsets)), "series")

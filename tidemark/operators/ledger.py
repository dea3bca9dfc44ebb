"""Queries over append-only forecast ledgers, ordered by (series, seq)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators.evaluate import brier_loss

# Event names of the two ledgers.
FORECAST = {
    "id": "lock_id", "armed": "prediction_armed", "locked": "prediction_locked",
    "scored": "prediction_scored", "invalidated": "prediction_invalidated",
    "gap": "prediction_gap",
}
SNAPSHOT = {
    "id": "snapshot_id", "armed": "prospective_capture_armed",
    "locked": "pre_round_snapshot_locked", "scored": "pre_round_snapshot_scored",
    "invalidated": "pre_round_snapshot_invalidated",
}


def _known(value: Column) -> Column:
    number = value.try_cast("decimal(38,18)")
    return F.when(number >= 1, number)


def lock_score_pairing(ledger: DataFrame, names: dict = FORECAST) -> DataFrame:
    """Scores with the latest lock of the same id before them.

    A score counts unless its id was invalidated earlier in the ledger. One grouping
    by id does it: an id has a handful of events.
    """
    key = names["id"]
    of = lambda kind: F.col("event") == names[kind]
    rows = ledger.where(F.col(key).isNotNull() & F.col("event").isin(
        names["locked"], names["scored"], names["invalidated"]
    ))
    dead = rows.where(of("invalidated")).groupBy("series", key).agg(F.min("seq").alias("dead_seq"))
    scores = rows.where(of("scored")).select(
        "series", key, F.col("seq").alias("scored_seq"),
        _known(F.col("actual_multiplier")).alias("actual"),
    )
    locks = rows.where(of("locked"))
    pairs = locks.join(scores, ["series", key]).where(F.col("seq") < F.col("scored_seq"))
    kept = [c for c in locks.columns if c not in ("series", key)]
    latest = pairs.groupBy("series", key, "scored_seq", "actual").agg(
        F.max_by(F.struct(*kept), F.col("seq")).alias("lock")
    )
    alive = F.col("dead_seq").isNull() | (F.col("dead_seq") > F.col("scored_seq"))
    return (
        latest.join(dead, ["series", key], "left")
        .where(alive & F.col("actual").isNotNull())
        .select("series", key, "scored_seq", "actual", "lock")
    )


def open_locks(ledger: DataFrame, names: dict = FORECAST) -> DataFrame:
    """The latest lock per series that is neither scored nor invalidated anywhere."""
    key = names["id"]
    locks = ledger.where((F.col("event") == names["locked"]) & F.col(key).isNotNull())
    closed = ledger.where(F.col("event").isin(names["scored"], names["invalidated"]))
    free = locks.join(closed.select("series", key), ["series", key], "left_anti")
    kept = [c for c in ledger.columns if c != "series"]
    latest = free.groupBy("series").agg(F.max_by(F.struct(*kept), F.col("seq")).alias("lock"))
    return latest.select("series", "lock.*")


def latest_arm(ledger: DataFrame, session: str | None = None, names: dict = FORECAST) -> DataFrame:
    """The last arm event per series and session."""
    arms = ledger.where(F.col("event") == names["armed"])
    if session is not None:
        arms = arms.where(F.col("collector_session_id") == session)
    last = arms.groupBy("series", "collector_session_id").agg(
        F.max_by(
            F.struct("seq", "armed_at", "history_count", "history_last_round_id"), F.col("seq")
        ).alias("arm")
    )
    return last.select("series", "collector_session_id", "arm.*")


def _probability(text: Column) -> Column:
    number = text.try_cast("decimal(18,6)")
    return F.when((number >= 0) & (number <= 1), number)


def score_forecasts(pairs: DataFrame) -> DataFrame:
    """Per lock and threshold: outcome, the Brier loss of the chosen, baseline and raw
    candidate probability, and the error of the point forecast."""
    actual = F.col("actual")
    details = "lock.threshold_model_details"
    rows = pairs.select(
        "series", "lock_id", "scored_seq", "actual", "lock",
        F.explode("lock.threshold_probabilities").alias("threshold_text", "chosen_text"),
    ).withColumn("detail", F.col(details)[F.col("threshold_text")])
    threshold = F.col("threshold_text").try_cast("decimal(18,6)")
    outcome = C.hit(actual, "threshold")
    point = F.col("lock.predicted_multiplier").try_cast("decimal(18,6)")
    error = F.bround(F.abs(point - actual.cast("decimal(24,6)")), 2)
    low = F.col("lock.prediction_interval.lower").try_cast("decimal(18,6)")
    high = F.col("lock.prediction_interval.upper").try_cast("decimal(18,6)")

    def loss(name: str) -> Column:
        return F.bround(brier_loss(F.col(name), F.col("outcome")), 6)

    return (
        rows.withColumn("threshold", threshold)
        .where(F.col("threshold").isNotNull())
        .withColumns(
            {
                "outcome": outcome,
                "chosen": _probability(F.col("chosen_text")),
                "baseline": _probability(F.col("detail.baseline_probability")),
                "candidate": _probability(F.col("detail.raw_candidate_probability")),
                "source": F.col("detail.source"),
                "absolute_error": error,
                "relative_error": F.bround(error.cast("double") / actual.cast("double"), 6),
                "within_interval": actual.between(low, high),
            }
        )
        .withColumns({f"{n}_brier": loss(n) for n in ("chosen", "baseline", "candidate")})
        .drop("lock", "detail", "threshold_text", "chosen_text")
    )


def live_forecast_audit(ledger: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per threshold: mean Briers, skills on comparable rows, selection rate, calibration."""
    by = [*by, "threshold"]
    rows = score_forecasts(lock_score_pairing(ledger)).where(F.col("chosen").isNotNull())
    both = F.col("baseline_brier").isNotNull() & F.col("candidate_brier").isNotNull()
    picked = F.coalesce(F.col("source") == "gated_logistic_challenger", F.lit(False))

    def mean(name: str, where: Column | None = None) -> Column:
        value = F.col(name).cast("decimal(18,6)")
        value = value if where is None else F.when(where, value)
        return C.mean_of(F.sum(value), F.count(value))

    n = F.count("*")
    report = rows.groupBy(*by).agg(
        n.alias("scored_forecasts"),
        F.count_if(picked).alias("challenger_selected"),
        C.ratio(F.count_if(picked), n).alias("challenger_selection_rate"),
        mean("chosen_brier").alias("mean_chosen_brier"),
        mean("baseline_brier").alias("mean_baseline_brier"),
        mean("candidate_brier", both).alias("mean_raw_candidate_brier"),
        mean("baseline_brier", both).alias("_comparable"),
        F.count_if(both).alias("comparable_candidate_rows"),
        mean("chosen").alias("average_forecast"),
        C.ratio(F.sum("outcome"), n).alias("observed_rate"),
    )
    return report.withColumns(
        {
            "chosen_skill_vs_baseline_pct": C.skill_pct(F.col("mean_baseline_brier"), F.col("mean_chosen_brier")),
            "raw_candidate_skill_vs_baseline_pct": C.skill_pct(F.col("_comparable"), F.col("mean_raw_candidate_brier")),
            "calibration_gap": F.bround(
                F.col("observed_rate").cast("decimal(18,6)") - F.col("average_forecast").cast("decimal(18,6)"), 6
            ),
        }
    ).drop("_comparable")


def ledger_totals(ledger: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Scored and invalidated locks and unpredicted outcomes."""
    by = list(by)
    scored = lock_score_pairing(ledger).groupBy(*by).agg(F.count("*").alias("scored_locks"))
    other = ledger.groupBy(*by).agg(
        F.count_distinct(
            F.when(F.col("event") == FORECAST["invalidated"], F.struct("series", "lock_id"))
        ).alias("invalidated_locks"),
        F.coalesce(
            F.sum(
                F.when(
                    (F.col("event") == FORECAST["gap"]) & (F.col("unpredicted_rounds") > 0),
                    F.col("unpredicted_rounds"),
                )
            ),
            F.lit(0),
        ).alias("unpredicted_outcomes"),
    )
    joined = other.join(scored, by, "left") if by else other.crossJoin(F.broadcast(scored))
    return joined.withColumn("scored_locks", F.coalesce("scored_locks", F.lit(0)))


def performance_summary(ledger: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The audit in the order it is read, with totals and a status on every line."""
    totals = ledger_totals(ledger, by)
    audit = live_forecast_audit(ledger, by).drop(
        "comparable_candidate_rows", "raw_candidate_skill_vs_baseline_pct"
    )
    by = list(by)
    if not by:  # one row of totals beside a line per threshold
        totals, audit = totals.withColumn("_all", F.lit(0)), audit.withColumn("_all", F.lit(0))
    joined = totals.join(audit, by or ["_all"], "left").drop("_all")
    status = F.when(F.col("scored_locks") > 0, "COMPLETE").otherwise("NO_SCORED_PREDICTIONS")
    return joined.withColumn("status", status)


def current_forecast(ledger: DataFrame) -> DataFrame:
    """The open lock of each series, or that it waits for the next one."""
    series = ledger.select("series").distinct()
    lock = open_locks(ledger).select(
        "series", "seq", "lock_id", "locked_at", "history_count", "history_last_timestamp",
        "threshold_probabilities", "predicted_multiplier", "prediction_interval",
    )
    status = F.when(F.col("lock_id").isNotNull(), "LOCKED").otherwise("WAITING_FOR_NEXT_LOCK")
    return series.join(lock, "series", "left").withColumn("status", status)


def snapshot_samples(ledger: DataFrame, thresholds: Sequence[str], bins: int = 24) -> DataFrame:
    """Scored snapshots with complete priors, ready for the feature audit.

    Locks are paired with their scores; those without features, trigger or a valid
    prior per threshold are left out.
    """
    from tidemark.operators.features import hashed_features

    pairs = lock_score_pairing(ledger, SNAPSHOT)
    rows = pairs.select("series", "snapshot_id", "scored_seq", "actual", "lock.*")
    priors = F.array(
        *[_probability(F.col("forecast.historical_probabilities")[str(t)]) for t in thresholds]
    )
    rows = rows.withColumn("priors", priors).where(
        ~F.exists("priors", lambda p: p.isNull())
        & F.col("locked_at").isNotNull()
        & F.col("trigger_signature").isNotNull()
    )
    return hashed_features(rows, bins).select(
        "series", "snapshot_id", F.col("scored_seq").alias("seq"), "trigger_signature",
        F.col("actual").cast("double").alias("actual"),
        F.transform("priors", lambda p: p.cast("double")).alias("priors"),
        "vector",
    )

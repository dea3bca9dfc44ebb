"""Walk-forward and prequential evaluation of forecasts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators.blocks import run_blocks
from tidemark.operators.features import SERIES
from tidemark.operators.forecast import MIN_COHORT, THRESHOLDS, check_thresholds, frequency_forecast
from tidemark.operators.online import (
    FACTORS,
    HIGH,
    LOW,
    candidate_losses,
    champion_selection,
    clipped,
    online_rls,
)
from tidemark.operators.ridge import (
    CHUNK,
    PrefixMoments,
    moment_steps,
    point_forecast,
    solve,
    stacked,
    start_of,
    state_schema,
)
from tidemark.plans.ordering import Layout, number, plan_layout, scan
from tidemark.plans.lineage import settle
from tidemark.plans.quantiles import fits_one_task, summarise


def brier_loss(probability: Column, outcome: Column) -> Column:
    """Exact squared error of a published (6 place) probability."""
    miss = probability.cast("decimal(7,6)") - outcome.cast("decimal(1,0)")
    return (miss * miss).cast("decimal(16,12)")


def walk_forward_frequency(
    outcomes: DataFrame,
    thresholds: Sequence[str] = THRESHOLDS,
    mode: str = "expanding",
    window: int | None = None,
    min_history: int = 50,
    layout: Layout | None = None,
) -> DataFrame:
    """Brier score and calibration error of the frequency forecast, per threshold.

    Scores use the rounded probability, the one that would have been published.
    """
    rows = frequency_forecast(outcomes, thresholds, mode, window, min_history, layout)
    ready = F.col("status") == "READY"
    loss = F.when(ready, brier_loss(F.col("probability"), F.col("actual")))
    n = F.count_if(ready)
    rate = F.sum(F.when(ready, F.col("actual").cast("decimal(18,0)")))
    total = F.sum(F.when(ready, F.col("probability").cast("decimal(7,6)")))
    report = rows.groupBy("series", "threshold").agg(
        F.count("*").alias("outcomes"),
        n.alias("predictions"),
        F.coalesce(rate, F.lit(0)).cast("bigint").alias("positives"),
        C.mean_of(F.sum(loss), n, scale=12).alias("brier_score"),
        C.mean_of(F.abs(total - rate), n).alias("calibration_error"),
    )
    return report.withColumn("skipped", F.col("outcomes") - F.col("predictions")).drop("outcomes")


def walk_forward_point(outcomes: DataFrame, **config) -> DataFrame:
    """Error, coverage and comparison with the recent median of the point forecast."""
    rows = point_forecast(outcomes, **config)
    digits = "decimal(18,6)"
    actual = F.col("actual").cast(digits)
    error = F.abs(F.col("predicted").cast(digits) - actual)
    base = F.abs(F.col("recent_median").cast(digits) - actual)
    inside = (F.col("lower").cast(digits) <= actual) & (actual <= F.col("upper").cast(digits))
    small = fits_one_task(outcomes)
    rows = rows if small else settle(rows)  # read twice
    done = F.col("status") == "READY"
    scored = rows.select(
        "series",
        done.alias("done"),
        F.when(done, error).alias("error"),
        F.when(done, base).alias("base"),
        F.coalesce(done & inside, F.lit(False)).alias("inside"),
    )
    n = F.count_if("done")
    aggregates = [
        F.count_if(~F.col("done")).alias("skipped_targets"),
        n.alias("evaluated_targets"),
        C.places(F.avg("error")).alias("mae"),
        C.places(F.avg("base")).alias("recent_median_mae"),
        C.ratio(F.count_if(F.col("error") <= 0.5), n).alias("within_half_rate"),
        C.ratio(F.count_if(F.col("error") <= 1.0), n).alias("within_one_rate"),
        C.ratio(F.count_if("inside"), n).alias("interval_coverage"),
    ]
    report = summarise(scored, ["series"], aggregates, {"m": F.col("error")}, small)
    status = F.when(F.col("evaluated_targets") > 0, "COMPLETE").otherwise("INSUFFICIENT_DATA")
    return report.withColumns(
        {"median_absolute_error": C.places(F.col("m")), "status": status}
    ).drop("m")


# --- state samples -------------------------------------------------------------------------

STATE_ROWS = (
    "series string, outcome_id string, target_index bigint, pos bigint, actual double, "
    "baseline double, history_log double, state_log double, hybrid_log double, actual_log double"
)


def ordered_samples(samples: DataFrame) -> DataFrame:
    """Number the samples of a series; evaluation counts positions in this list."""
    rows = samples.withColumn("_at", F.col("target_index"))
    return number(rows, SERIES, ["_at"]).drop("_at")


def state_predictions(
    samples: DataFrame,
    min_training: int = 40,
    validation_rows: int = 12,
    alphas: Sequence[float] = (1.0, 10.0, 100.0),
    layout: Layout | None = None,
) -> DataFrame:
    """History, state and hybrid ridge forecasts of each sample from earlier samples.

    The penalty is chosen on the last part of the training rows by a model fitted on
    the rows before it; both fits come from running moments of the hybrid vector.
    """
    if min_training < 20 or validation_rows < 3:
        raise ValueError("min_training must be at least 20 and validation_rows at least 3.")
    rows = ordered_samples(samples).select(
        "series", "outcome_id", "target_index", "pos", "actual", "baseline",
        C.log_value("actual").alias("y"),
        F.size("history").alias("width"),
        F.concat("history", "state").alias("x"),
    )
    layout = layout if layout is not None else plan_layout(rows, SERIES, "pos")

    def kernel(pdf: pd.DataFrame, state: pd.DataFrame | None) -> pd.DataFrame:
        columns = [c.split()[0] for c in STATE_ROWS.split(", ")]
        if pdf.empty:
            return pd.DataFrame(columns=columns)
        x, y, pos = stacked(pdf, "x"), pdf["y"].to_numpy(float), pdf["pos"].to_numpy()
        width, total = int(pdf["width"].iloc[0]), x.shape[1]
        moments = PrefixMoments(x, y, start_of(state, "x", total))
        targets = np.flatnonzero(pdf["_home"].to_numpy(bool) & (pos >= min_training))
        families = {
            "history": np.arange(width),
            "state": np.arange(width, total),
            "hybrid": np.arange(total),
        }
        found = {name: np.empty(len(targets)) for name in families}
        for low in range(0, len(targets), CHUNK):
            at = targets[low : low + CHUNK]
            count = pos[at]
            v = np.minimum(validation_rows, np.maximum(3, count // 4))
            slots = np.arange(validation_rows)[None, :]
            used = slots < v[:, None]
            val = at[:, None] - v[:, None] + np.minimum(slots, v[:, None] - 1)
            train, full = moments.before(at - v), moments.before(at)
            for name, features in families.items():
                pick = np.concatenate([[0], features + 1, [total + 1]])
                part = np.ix_(np.arange(len(at)), pick, pick)
                b0, b = solve(train[part], alphas)
                guess = b0[:, :, None] + np.einsum("mkd,mvd->mkv", b, x[val][:, :, features])
                miss = np.where(used[:, None, :], np.abs(guess - y[val][:, None, :]), 0.0)
                best = np.argmin(miss.sum(axis=2) / v[:, None], axis=1)
                f0, f = solve(full[part], alphas)
                each = np.arange(len(at))
                found[name][low : low + len(at)] = f0[each, best] + (
                    f[each, best] * x[at][:, features]
                ).sum(axis=1)
        base = pdf.iloc[targets].reset_index(drop=True)
        out = base[["series", "outcome_id", "target_index", "pos", "actual", "baseline"]].assign(
            **{f"{name}_log": values for name, values in found.items()}, actual_log=base["y"]
        )
        return out[columns]

    summarise, combine = moment_steps(["x"], SERIES)
    schema = state_schema(["x"], "series string")
    return run_blocks(
        rows, SERIES, layout, STATE_ROWS, kernel, schema, summarise, combine, schema,
        halo=validation_rows,
    )


def walk_forward_state(samples: DataFrame, **config) -> DataFrame:
    """Do state features add to history features? Errors of the three ridge models."""
    small = fits_one_task(samples)
    rows = state_predictions(samples, **config)
    rows = rows if small else settle(rows)  # read twice
    digits = "decimal(18,6)"

    def shown(name: str) -> Column:
        value = F.greatest(F.lit(1.0), F.least(F.lit(1000.0), F.exp(name)))
        return F.bround(value, 2).cast(digits)

    actual = F.col("actual").cast(digits)
    kinds = ["history", "state", "hybrid"]
    errors = rows.select(
        "series",
        *[F.abs(shown(f"{k}_log") - actual).alias(f"{k}_error") for k in kinds],
        F.abs(F.col("baseline").cast(digits) - actual).alias("baseline_error"),
        *[F.abs(F.col(f"{k}_log") - F.col("actual_log")).alias(f"{k}_miss") for k in kinds],
    )
    n = F.count("*")
    aggregates = [
        n.alias("evaluated_targets"),
        *[C.places(F.avg(f"{k}_error")).alias(f"{k}_mae") for k in kinds],
        C.places(F.avg("baseline_error")).alias("recent_median_mae"),
        C.ratio(F.count_if(F.col("hybrid_error") <= 0.5), n).alias("hybrid_within_half_rate"),
        C.ratio(F.count_if(F.col("hybrid_error") <= 1.0), n).alias("hybrid_within_one_rate"),
        C.ratio(F.count_if(F.col("hybrid_error") < F.col("history_error")), n).alias("hybrid_win_rate"),
        C.skill_pct(F.avg("history_error"), F.avg("hybrid_error"), "zero").alias("hybrid_improvement_pct"),
        *[C.places(F.avg(f"{k}_miss")).alias(f"{k}_log_mae") for k in kinds],
    ]
    report = summarise(errors, ["series"], aggregates, {"m": F.col("hybrid_error")}, small)
    aligned = samples.groupBy("series").agg(F.count("*").alias("aligned_samples"))
    return (
        aligned.join(report, "series", "left")
        .withColumn("hybrid_median_error", C.places(F.col("m")))
        .drop("m")
        .withColumn(
            "status", F.when(F.col("evaluated_targets") > 0, "COMPLETE").otherwise("INSUFFICIENT_DATA")
        )
    )


# --- blocks and switches -------------------------------------------------------------------


def block_of(position: Column, count: Column, blocks: int) -> Column:
    """Block of a 0-based position when block b covers [b*n//k, (b+1)*n//k)."""
    return F.floor(((position + 1) * blocks - 1) / count).cast("int")


def block_wins(
    rows: DataFrame, by: Sequence[str], position: str, left: str, right: str, blocks: int = 4
) -> DataFrame:
    """In how many of ``blocks`` equal spans the left losses are smaller in the mean.

    ``rows`` are numbered 0..n-1 within the group by ``position``; ``left`` and
    ``right`` are loss columns.
    """
    by = list(by)
    counts = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    placed = rows.join(counts, by) if by else rows.crossJoin(F.broadcast(counts))
    placed = placed.withColumn("_block", block_of(F.col(position), F.col("_n"), blocks))
    means = placed.groupBy(*by, "_block").agg(F.avg(left).alias("l"), F.avg(right).alias("r"))
    return means.groupBy(*by).agg(F.count_if(F.col("l") < F.col("r")).alias("block_wins"))


def switches(rows: DataFrame, by: Sequence[str], position: str, name: str) -> DataFrame:
    """How often the name changes from one row to the next."""
    seen = scan(rows, by, [position], prev={"_before": F.col(name)})
    return seen.groupBy(*by).agg(F.count_if(F.col(name) != F.col("_before")).alias("switches"))


MODES = ("history", "state", "hybrid")
AUDIT_THRESHOLDS = ("1.5", "2", "5", "10")


def _hits(value: str, thresholds: Sequence[str]) -> Column:
    return F.array(
        *[C.hit(F.col(value).cast("decimal(38,6)"), F.lit(t).cast("decimal(18,6)")) for t in thresholds]
    )


def prequential_predictions(
    samples: DataFrame,
    thresholds: Sequence[str] = AUDIT_THRESHOLDS,
    min_training: int = 40,
    selection_window: int = 16,
    factors: Sequence[float] = FACTORS,
) -> DataFrame:
    """Per target and threshold: champion, best of each mode, and the running baseline."""
    thresholds = check_thresholds(thresholds)
    rows = ordered_samples(samples).withColumn("hits", _hits("actual", thresholds))
    families = F.explode(
        F.array(
            F.struct(F.lit("history").alias("mode"), clipped(F.col("history")).alias("x")),
            F.struct(F.lit("state").alias("mode"), clipped(F.col("state")).alias("x")),
            F.struct(
                F.lit("hybrid").alias("mode"), clipped(F.concat("history", "state")).alias("x")
            ),
        )
    )
    spread = rows.select("series", "pos", "hits", families.alias("f"))
    predictions = online_rls(spread.select("series", "f.mode", "pos", "f.x", "hits"), factors)
    name = F.concat_ws(":ff=", F.col("mode"), F.format_number("factor", 2))
    losses = candidate_losses(predictions, thresholds, selection_window, name)
    # Every candidate has the same number of past losses, so all become eligible at
    # once; before that all compete as well.
    chosen = champion_selection(losses.where(F.col("at") >= min_training), MODES)
    limits = F.explode(C.number_list(thresholds, "decimal(18,6)"))
    targets = rows.select("series", F.col("pos").alias("at"), "actual", limits.alias("threshold"))
    targets = targets.withColumn("hit", C.hit(F.col("actual").cast("decimal(38,6)"), "threshold"))
    base = scan(targets, ["series", "threshold"], ["at"], sums={"won": F.col("hit").cast("bigint")})
    share = F.when(F.col("at") > 0, F.col("won") / F.col("at")).otherwise(0.5)
    base = base.select("series", "threshold", "at", C.clip(share, LOW, HIGH).alias("baseline"))
    return chosen.join(base, ["series", "threshold", "at"])


def prequential_adaptive_audit(
    samples: DataFrame,
    thresholds: Sequence[str] = AUDIT_THRESHOLDS,
    min_training: int = 40,
    selection_window: int = 16,
    factors: Sequence[float] = FACTORS,
    blocks: int = 4,
) -> DataFrame:
    """Does switching between online models beat the running frequency, and history alone?"""
    if min_training < 20 or selection_window < 6 or blocks < 2:
        raise ValueError("min_training >= 20, selection_window >= 6 and blocks >= 2 are required.")
    rows = prequential_predictions(samples, thresholds, min_training, selection_window, factors)
    rows = settle(rows)  # the models run once; four summaries read their choices

    def loss(probability: str) -> Column:
        return F.pow(F.col(probability) - F.col("actual"), 2)

    rows = rows.withColumns(
        {
            "rank": F.col("at") - min_training,
            "champion_name": F.col("champion.name"),
            "champion_loss": loss("champion.probability"),
            "baseline_loss": loss("baseline"),
            **{f"{m}_loss": loss(f"best_{m}.probability") for m in MODES},
        }
    )
    by = ["series", "threshold"]
    n = F.count("*")
    report = rows.groupBy(*by).agg(
        n.alias("evaluated_targets"),
        F.sum("actual").cast("bigint").alias("positives"),
        C.ratio(F.sum("actual"), n).alias("prevalence"),
        C.places(F.avg("baseline_loss")).alias("baseline_brier"),
        *[C.places(F.avg(f"{m}_loss")).alias(f"{m}_adaptive_brier") for m in MODES],
        C.places(F.avg("champion_loss")).alias("champion_brier"),
        C.skill_pct(F.avg("baseline_loss"), F.avg("champion_loss"), "zero").alias("champion_skill_vs_baseline_pct"),
        C.skill_pct(F.avg("history_loss"), F.avg("champion_loss"), "zero").alias("champion_skill_vs_history_pct"),
        C.ratio(F.count_if(F.col("champion.factor") <= 0.95), n).alias("fast_forgetting_selection_rate"),
        C.ratio(F.count_if(F.col("champion.mode") != "history"), n).alias("state_or_hybrid_selection_rate"),
    )
    wins = block_wins(rows, by, "rank", "champion_loss", "history_loss", blocks)
    changed = switches(rows, by, "rank", "champion_name")
    selected = selection_counts(rows, by, "champion_name")
    return report.join(wins, by).join(changed, by).join(selected, by)


def selection_counts(rows: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """Array of (name, n) per group, most selected first; there are few candidates."""
    counts = rows.groupBy(*by, name).agg(F.count("*").alias("n"))
    listed = F.array_sort(
        F.collect_list(F.struct((-F.col("n")).alias("neg"), F.col(name).alias("name"), "n"))
    )
    return counts.groupBy(*by).agg(
        F.transform(listed, lambda e: F.struct(e["name"].alias("name"), e["n"].alias("n"))).alias(
            "selected_counts"
        )
    )


# --- locked snapshots ----------------------------------------------------------------------


def prospective_feature_audit(
    samples: DataFrame,
    thresholds: Sequence[str] = THRESHOLDS,
    min_training: int = 40,
    selection_window: int = 20,
    factors: Sequence[float] = (0.95, 0.98, 1.0),
    blocks: int = 4,
    prior_strength: float = 20.0,
) -> DataFrame:
    """Prior, trigger-conditioned and feature forecasts of locked snapshots compared.

    ``samples`` has (series, seq, trigger_signature, actual, priors ARRAY<DOUBLE> in
    threshold order, vector ARRAY<DOUBLE>), ordered by seq.
    """
    if min_training < 20 or selection_window < 6 or blocks < 2:
        raise ValueError("min_training >= 20, selection_window >= 6 and blocks >= 2 are required.")
    thresholds = check_thresholds(thresholds)
    rows = number(samples, SERIES, ["seq"]).withColumn("hits", _hits("actual", thresholds))
    predictions = online_rls(
        rows.select("series", F.lit("features").alias("mode"), "pos", F.col("vector").alias("x"), "hits"),
        factors, regularization=20.0,
    )
    name = F.concat(F.lit("ff="), F.format_number("factor", 2))
    losses = candidate_losses(predictions, thresholds, selection_window, name)
    chosen = champion_selection(losses.where(F.col("at") >= min_training))
    limits = C.number_list(thresholds, "decimal(18,6)")
    each = F.explode(
        F.transform(
            "hits",
            lambda h, i: F.struct(
                F.get(limits, i).alias("threshold"), h.alias("hit"), F.get("priors", i).alias("prior")
            ),
        )
    )
    targets = rows.select("series", "trigger_signature", F.col("pos").alias("at"), each.alias("e"))
    targets = targets.select("series", "trigger_signature", "at", "e.*")
    by = ["series", "threshold"]
    won = F.col("hit").cast("bigint")
    targets = scan(targets, by, ["at"], sums={"all_hits": won})
    targets = scan(
        targets, [*by, "trigger_signature"], ["at"],
        sums={"same_hits": won, "same_n": F.lit(1).cast("bigint")},
    )
    same = F.col("same_n") >= MIN_COHORT
    n = F.when(same, F.col("same_n")).otherwise(F.col("at"))
    k = F.when(same, F.col("same_hits")).otherwise(F.col("all_hits"))
    trigger = (F.col("prior") * prior_strength + k) / (n + prior_strength)
    targets = targets.withColumn("trigger", C.clip(trigger, LOW, HIGH))
    rows = settle(chosen.join(targets, [*by, "at"]))  # read by four summaries
    rows = rows.withColumn("rank", F.col("at") - min_training)

    def loss(probability: str) -> Column:
        return F.pow(F.col(probability) - F.col("actual"), 2)

    rows = rows.withColumns(
        {
            "prior_loss": loss("prior"),
            "trigger_loss": loss("trigger"),
            "feature_loss": loss("champion.probability"),
            "champion_name": F.col("champion.name"),
        }
    )
    report = rows.groupBy(*by).agg(
        F.count("*").alias("evaluated_targets"),
        F.sum("actual").cast("bigint").alias("positives"),
        C.places(F.avg("prior_loss")).alias("prior_brier"),
        C.places(F.avg("trigger_loss")).alias("trigger_conditioned_brier"),
        C.skill_pct(F.avg("prior_loss"), F.avg("trigger_loss"), "zero").alias("trigger_skill_pct"),
        C.places(F.avg("feature_loss")).alias("feature_brier"),
        C.skill_pct(F.avg("prior_loss"), F.avg("feature_loss"), "zero").alias("feature_skill_pct"),
        C.places(F.stddev_pop("champion.probability")).alias("prediction_stddev"),
    )
    trigger_wins = block_wins(rows, by, "rank", "trigger_loss", "prior_loss", blocks)
    feature_wins = block_wins(rows, by, "rank", "feature_loss", "prior_loss", blocks)
    report = (
        report.join(trigger_wins.withColumnRenamed("block_wins", "trigger_block_wins"), by)
        .join(feature_wins.withColumnRenamed("block_wins", "feature_block_wins"), by)
        .join(selection_counts(rows, by, "champion_name"), by)
    )
    trigger_edge = (F.col("trigger_skill_pct") > 0) & (F.col("trigger_block_wins") >= 3)
    feature_edge = (F.col("feature_skill_pct") > 0) & (F.col("feature_block_wins") >= 3)
    verdict = (
        F.when(trigger_edge & feature_edge, "TRIGGER_AND_FEATURE_CANDIDATE_EDGE")
        .when(trigger_edge, "TRIGGER_CONDITIONED_CANDIDATE_EDGE")
        .when(feature_edge, "FEATURE_CANDIDATE_EDGE")
        .otherwise("NO_DEMONSTRATED_EDGE")
    )
    return report.withColumn("verdict", verdict)

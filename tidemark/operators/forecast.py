"""Forecasts from earlier outcomes and from scored forecasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators.features import ORDER, SERIES, prefix_counts
from tidemark.operators.temporal import history_as_of
from tidemark.plans.ordering import DEFAULT_TASK_ROWS, HOME, SLICE, Layout, plan_layout, rolling, scan, with_halo

THRESHOLDS = ("1.5", "2", "5")
PRIOR_STRENGTH = 20
MIN_COHORT = 6
GATE_MIN, GATE_WINDOW, GATE_SKILL = 16, 60, 5.0


def check_thresholds(thresholds: Sequence[str]) -> list[str]:
    numbers = [float(t) for t in thresholds]
    if not numbers or numbers != sorted(set(numbers)) or numbers[0] < 1:
        raise ValueError("thresholds must be at least 1, unique and strictly increasing.")
    return [str(t) for t in thresholds]


def with_next(outcomes: DataFrame) -> DataFrame:
    """Add one row per series for the outcome still to come (null id and value)."""
    last = outcomes.groupBy("series").agg(F.max("ts").alias("ts"))
    step = F.timestamp_micros(F.unix_micros("ts") + 1)
    return outcomes.unionByName(
        last.select("series", step.alias("ts")), allowMissingColumns=True
    )


def frequency_forecast(
    outcomes: DataFrame,
    thresholds: Sequence[str] = THRESHOLDS,
    mode: str = "expanding",
    window: int | None = None,
    min_history: int = 50,
    layout: Layout | None = None,
) -> DataFrame:
    """P(value >= t) for every outcome and threshold from the outcomes before it.

    Expanding counts are running sums. Rolling counts are the difference between the
    running sum here and ``window`` rows back, whatever the window length.
    """
    thresholds = check_thresholds(thresholds)
    if mode not in ("expanding", "rolling") or (mode == "rolling") != (window is not None):
        raise ValueError("mode is 'expanding' without a window, or 'rolling' with one.")
    if window is not None and window < min_history:
        raise ValueError("rolling window cannot be smaller than min_history.")
    rows = outcomes.select("series", "outcome_id", "ts", "value")
    layout = layout if layout is not None else plan_layout(rows, SERIES, "ts")
    rows = prefix_counts(rows, thresholds, layout).withColumn("available", F.col("n"))
    hits = [f"hits_{i}" for i in range(len(thresholds))]
    if mode == "rolling":
        counts = ["n", *hits]
        rows = rolling(
            rows,
            SERIES,
            ORDER,
            window,
            lambda w: {f"old_{c}": F.coalesce(F.lag(c, window).over(w), F.lit(0)) for c in counts},
            layout,
        )
        rows = rows.withColumns({c: F.col(c) - F.col(f"old_{c}") for c in counts})
    nested = C.all_of([F.lit(True), *[F.col(a) >= F.col(b) for a, b in zip(hits, hits[1:])]])
    guard = F.assert_true(nested, "threshold probabilities must be non-increasing")
    rows = rows.where(guard.isNull())
    ready = F.col("n") >= min_history
    forecasts = F.array(
        *[
            F.struct(
                F.lit(t).cast("decimal(18,6)").alias("threshold"),
                F.col(h).alias("hits"),
                F.when(ready, C.ratio(F.col(h), "n")).alias("probability"),
                C.hit("value", F.lit(t).cast("decimal(18,6)")).alias("actual"),
            )
            for t, h in zip(thresholds, hits)
        ]
    )
    return rows.select(
        "series",
        "outcome_id",
        "ts",
        "value",
        "available",
        F.col("n").alias("sample_count"),
        F.when(ready, "READY").otherwise("INSUFFICIENT_DATA").alias("status"),
        F.explode(forecasts).alias("f"),
    ).select(
        "series", "outcome_id", "ts", "value", "available", "sample_count", "status", "f.*"
    )


def prior_forecast(
    outcomes: DataFrame, thresholds: Sequence[str] = THRESHOLDS, layout: Layout | None = None
) -> DataFrame:
    """The forecast available as soon as an outcome completes: counts through it."""
    thresholds = check_thresholds(thresholds)
    rows = prefix_counts(outcomes.select("series", "outcome_id", "ts", "value"), thresholds, layout)
    probabilities = F.array(
        *[
            F.struct(
                F.lit(t).cast("decimal(18,6)").alias("threshold"),
                C.ratio(
                    F.col(f"hits_{i}") + C.hit("value", F.lit(t).cast("decimal(18,6)")),
                    F.col("n") + 1,
                ).alias("probability"),
            )
            for i, t in enumerate(thresholds)
        ]
    )
    return rows.select(
        "series",
        F.col("outcome_id").alias("previous_id"),
        F.col("ts").alias("previous_ts"),
        (F.col("n") + 1).alias("historical_outcomes"),
        F.explode(probabilities).alias("p"),
    ).select("series", "previous_id", "previous_ts", "historical_outcomes", "p.*")


def support_level(scored: Column, cohort: Column) -> Column:
    """Describes how many samples stand behind a forecast, not how right it is."""
    return (
        F.when((scored >= 150) & (cohort >= 50), "HIGH")
        .when((scored >= 60) & (cohort >= 20), "MEDIUM")
        .otherwise("LOW")
    )


def cohort_posterior(
    scored: DataFrame, prior_strength: int = PRIOR_STRENGTH, layout: Layout | None = None
) -> DataFrame:
    """Shrink the prior towards the hit rate of earlier scored forecasts.

    ``scored`` has one row per (series, seq, threshold) with ``trigger_signature``,
    ``prior`` and ``outcome`` (null while open). Only rows scored earlier in ledger
    order count. The cohort is the same trigger once it has 6 scored rows, else all.
    """
    done = F.col("outcome").isNotNull().cast("bigint")
    won = F.coalesce(F.col("outcome"), F.lit(0)).cast("bigint")
    layout = layout if layout is not None else plan_layout(scored, ["series", "threshold"], "seq")
    rows = scan(
        scored, ["series", "threshold"], ["seq"],
        sums={"all_n": done, "all_hits": won}, layout=layout,
    )
    rows = scan(
        rows, ["series", "threshold", "trigger_signature"], ["seq"],
        sums={"same_n": done, "same_hits": won}, layout=layout,
    )
    same = F.col("same_n") >= MIN_COHORT
    n = F.when(same, F.col("same_n")).otherwise(F.col("all_n"))
    hits = F.when(same, F.col("same_hits")).otherwise(F.col("all_hits"))
    strength = F.lit(prior_strength).cast("decimal(18,0)")
    top = F.col("prior").cast("decimal(18,6)") * strength + hits.cast("decimal(18,0)")
    posterior = F.bround(
        top.cast("decimal(24,6)") / (strength + n.cast("decimal(18,0)")).cast("decimal(18,0)"), 6
    )
    return rows.withColumns(
        {
            "cohort_kind": F.when(same, "same_trigger").otherwise("global"),
            "cohort_samples": n,
            "scored_samples": F.col("all_n"),
            "candidate": F.greatest(F.lit(0), F.least(F.lit(1), posterior)),
            "support": support_level(F.col("all_n"), n),
        }
    ).drop("all_n", "all_hits", "same_n", "same_hits")


def forward_gate(forecasts: DataFrame, layout: Layout | None = None) -> DataFrame:
    """Decide per forecast whether its candidate may replace the prior.

    ``forecasts`` is the output of ``cohort_posterior`` with the stored ``candidate``.
    The last 60 comparable rows of the same cohort are compared; at least 16 are
    needed and the candidate must win by 5 percent.
    """
    keys = ["series", "threshold", "_cohort"]
    comparable = (
        F.col("outcome").isNotNull() & F.col("candidate").isNotNull() & F.col("prior").isNotNull()
    )
    # A row is judged within its own cohort but counts in both cohorts it belongs to.
    homes = F.array(
        F.struct(F.lit("").alias("c"), (F.col("cohort_kind") == "global").alias("judged")),
        F.struct(
            F.coalesce("trigger_signature", F.lit("-")).alias("c"),
            (F.col("cohort_kind") == "same_trigger").alias("judged"),
        ),
    )
    rows = forecasts.withColumn("_h", F.explode(homes)).withColumns(
        {"_cohort": F.col("_h.c"), "_judged": F.col("_h.judged")}
    )

    def loss(name: str) -> Column:
        miss = F.col(name).cast("decimal(7,6)") - F.col("outcome").cast("decimal(1,0)")
        return F.when(comparable, (miss * miss).cast("decimal(16,12)"))

    one = comparable.cast("bigint")
    layout = layout if layout is not None else plan_layout(rows, keys, "seq")
    sums = {
        "_n": one,
        "_cand": F.coalesce(loss("candidate"), F.lit(0).cast("decimal(16,12)")),
        "_prior": F.coalesce(loss("prior"), F.lit(0).cast("decimal(16,12)")),
    }
    rows = scan(rows, keys, ["seq"], sums=sums, layout=layout)
    # The totals 60 comparable rows back. Rows of one running number have the same totals, as
    # rows that are not comparable add nothing, so the frame is the value 60 below.
    back, cut = keys, []
    if not layout.whole:
        rows = with_halo(rows, "_n", max(int(layout.block_rows or DEFAULT_TASK_ROWS), 2 * GATE_WINDOW), GATE_WINDOW)
        back, cut = [*keys, SLICE], [SLICE, HOME]
    frame = Window.partitionBy(*back).orderBy("_n").rangeBetween(-GATE_WINDOW, -GATE_WINDOW)
    rows = rows.withColumns({f"_old{name}": F.first(name).over(frame) for name in ("_cand", "_prior")})
    rows = rows.where("_judged" if layout.whole else f"_judged AND {HOME}").drop(*cut)
    n = F.least(F.col("_n"), F.lit(GATE_WINDOW))
    enough = n >= GATE_MIN

    def brier(name: str) -> Column:
        total = F.col(name) - F.coalesce(F.col(f"_old{name}"), F.lit(0))
        return F.when(enough, (total.cast("decimal(32,12)") / n.cast("decimal(10,0)")))

    candidate, prior = brier("_cand"), brier("_prior")
    skill = F.when(
        enough, F.when(prior > 0, F.bround((prior - candidate).cast("double") / prior.cast("double") * 100, 6)).otherwise(0.0)
    )
    return rows.select(
        *forecasts.columns,
        n.alias("validation_samples"),
        F.bround(candidate, 6).alias("candidate_brier"),
        F.bround(prior, 6).alias("prior_brier"),
        skill.alias("candidate_skill_pct"),
        F.when(skill >= GATE_SKILL, "prospective_adjusted").otherwise("historical_prior").alias("source"),
    )


def selected_probabilities(gated: DataFrame) -> DataFrame:
    """The chosen probability per threshold, clamped so that it never rises with t."""
    chosen = F.when(F.col("source") == "prospective_adjusted", F.col("candidate")).otherwise(
        F.col("prior").cast("decimal(18,6)")
    )
    nested = Window.partitionBy("series", "seq").orderBy("threshold").rowsBetween(
        Window.unboundedPreceding, 0
    )
    return gated.withColumn("probability", F.min(chosen).over(nested))


def reconstruct_prior(
    locks: DataFrame, outcomes: DataFrame, thresholds: Sequence[str] = THRESHOLDS
) -> DataFrame:
    """Fill missing historical priors of locks from the history through the named outcome.

    Rebuilt rows are flagged; a lock that names no known outcome is left as it is.
    """
    thresholds = check_thresholds(thresholds)
    missing = F.col("forecast.historical_probabilities").isNull()
    named = locks.withColumn("outcome_id", F.when(missing, F.col("previous_round_id")))
    counted = history_as_of(named, outcomes, thresholds).drop("outcome_id")
    rebuilt = F.map_from_entries(
        F.transform(
            "counts",
            lambda e: F.struct(
                e["threshold"], C.ratio(e["hits"], F.col("n")).cast("decimal(7,6)").cast("string")
            ),
        )
    )
    possible = missing & F.col("counts").isNotNull()
    kept = F.col("forecast")
    forecast = F.when(
        possible,
        F.struct(
            rebuilt.alias("historical_probabilities"),
            F.col("forecast.probabilities").alias("probabilities"),
            F.col("forecast.candidate_probabilities").alias("candidate_probabilities"),
            F.lit(True).alias("prior_reconstructed_for_audit"),
        ),
    ).otherwise(kept)
    return counted.withColumn("forecast", forecast).drop("counts", "n")

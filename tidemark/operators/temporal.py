"""Joins in time, formulated without range joins.

Observations and outcomes are put on one time line, sorted once, and each row takes
what it needs from the nearest earlier and later row of the other side. Sums over
overlapping trailing windows are differences of running sums on that time line, so
their cost does not depend on how many observations a window holds.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.plans.ordering import Layout, plan_layout, scan

# Order of rows at the same instant: an observation belongs to the interval that
# ends there, so it sorts before the outcome; query points come last of all.
OBSERVATION, OUTCOME = 0, 1

INTERVAL = ["prev_ts", "prev_id", "prev_value", "target_ts", "target_id", "target_value"]


def outcome_pairs(outcomes: DataFrame, layout: Layout | None = None) -> DataFrame:
    """Consecutive outcomes of a series: one row per target with its predecessor."""
    here = F.struct(
        F.col("ts").alias("prev_ts"),
        F.col("outcome_id").alias("prev_id"),
        F.col("value").alias("prev_value"),
    )
    rows = scan(
        outcomes.select("series", "ts", "outcome_id", "value"),
        ["series"],
        ["ts", "outcome_id"],
        sums={"target_index": F.lit(1).cast("bigint")},
        prev={"_prev": here},
        layout=layout,
    )
    return rows.select(
        "series",
        "target_index",
        "_prev.*",
        F.col("ts").alias("target_ts"),
        F.col("outcome_id").alias("target_id"),
        F.col("value").alias("target_value"),
    ).where(F.col("prev_ts") < F.col("target_ts"))


def assign_interval(
    outcomes: DataFrame,
    observations: DataFrame,
    tie: str = "obs_id",
    by: Sequence[str] = ("series",),
    carry: Sequence[str] = (),
    layout: Layout | None = None,
) -> DataFrame:
    """Each observation with the pair (previous outcome, next outcome] it lies in.

    Observations before the first or after the last outcome are left out. ``carry``
    names further columns of ``outcomes`` to bring along from the target. One sort
    per series; no join between the two sides.
    """
    by, carry = list(by), list(carry)
    kept = [c for c in observations.columns if c not in (*by, "ts")]
    outcome = F.struct(
        F.col("ts"),
        F.col("outcome_id").cast("string").alias("id"),
        F.col("value").cast("decimal(38,18)").alias("value"),
        *carry,
    )
    outcome_type = outcomes.select(outcome.alias("o")).schema["o"].dataType
    obs = observations.select(
        *by,
        "ts",
        F.lit(OBSERVATION).alias("_side"),
        F.col(tie).cast("string").alias("_tie"),
        F.struct(*kept).alias("_obs"),
        F.lit(None).cast(outcome_type).alias("_out"),
    )
    out = outcomes.select(
        *by,
        "ts",
        F.lit(OUTCOME).alias("_side"),
        F.col("outcome_id").cast("string").alias("_tie"),
        F.lit(None).cast(obs.schema["_obs"].dataType).alias("_obs"),
        outcome.alias("_out"),
    )
    line = scan(
        obs.unionByName(out),
        by,
        ["ts", "_side", "_tie"],
        prev={"_prev": F.col("_out")},
        next={"_next": F.col("_out")},
        layout=layout,
    )
    return (
        line.where((F.col("_side") == OBSERVATION) & (F.col("_prev.ts") < F.col("_next.ts")))
        .select(
            *by,
            "ts",
            "_obs.*",
            F.col("_prev.ts").alias("prev_ts"),
            F.col("_prev.id").alias("prev_id"),
            F.col("_prev.value").alias("prev_value"),
            F.col("_next.ts").alias("target_ts"),
            F.col("_next.id").alias("target_id"),
            F.col("_next.value").alias("target_value"),
            *[F.col(f"_next.{c}").alias(c) for c in carry],
        )
    )


def sums_as_of(
    facts: DataFrame,
    points: DataFrame,
    measures: Mapping[str, Column],
    at: Mapping[str, Column],
    keys: Sequence[str],
    *,
    by: Sequence[str] = ("series",),
    last: Mapping[str, Column] | None = None,
    following: Mapping[str, Column] | None = None,
    before: Sequence[str] = (),
    layout: Layout | None = None,
) -> DataFrame:
    """Running values of ``facts`` read at several instants per row of ``points``.

    ``measures`` are expressions over ``facts`` (with time ``us`` in microseconds);
    ``at`` names instants in microseconds per point. The result has one row per
    point: its ``keys``, and for every instant a struct of totals over facts with
    time at or before it (strictly before for the names in ``before``). ``last`` and
    ``following`` add the nearest non-null value up to, or after, the instant.
    Totals are exact as long as the measures are integers or decimals.
    """
    by, keys, last, following = list(by), list(keys), dict(last or {}), dict(following or {})
    exprs = {**measures, **last, **following}
    inner = {n: f"_m{i}" for i, n in enumerate(exprs)}
    fact_rows = facts.select(
        *by,
        F.col("us"),
        F.lit(1).alias("_side"),
        *[e.alias(inner[n]) for n, e in exprs.items()],
    )
    marks = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(n).alias("_name"),
                    us.cast("bigint").alias("us"),
                    F.lit(0 if n in before else 2).alias("_side"),
                )
                for n, us in at.items()
            ]
        )
    )
    point_rows = points.select(*by, F.struct(*keys).alias("_key"), marks.alias("_p")).select(
        *by, "_p.us", "_p._side", "_p._name", "_key"
    )
    line = scan(
        fact_rows.unionByName(point_rows, allowMissingColumns=True),
        by,
        ["us", "_side"],
        sums={f"_t{n}": F.col(inner[n]) for n in measures},
        prev={f"_t{n}": F.col(inner[n]) for n in last},
        next={f"_t{n}": F.col(inner[n]) for n in following},
        layout=layout,
    )
    read = F.struct(*[F.col(f"_t{n}").alias(n) for n in exprs])
    line = line.where(F.col("_name").isNotNull()).select(*by, "_key", "_name", read.alias("_r"))
    wide = line.groupBy(*by, "_key").agg(
        F.map_from_entries(F.collect_list(F.struct("_name", "_r"))).alias("_r")
    )
    return wide.select(*by, "_key.*", *[F.col("_r")[n].alias(n) for n in at])


def window_totals(
    facts: DataFrame,
    points: DataFrame,
    measures: Mapping[str, Column],
    spans: Sequence[tuple[Column, Column]],
    keys: Sequence[str],
    *,
    by: Sequence[str] = ("series",),
    levels: Mapping[str, Column] | None = None,
    last: Mapping[str, Column] | None = None,
    following: Mapping[str, Column] | None = None,
    layout: Layout | None = None,
) -> DataFrame:
    """Totals of ``facts`` in (low, high] of every point and span, one row each.

    A span is read at its two ends; the running totals there, with opposite signs,
    add up to the total inside. ``levels`` are running totals as of the upper end.
    ``last_<n>`` and ``first_<n>`` are the values of ``last`` at the upper end and of
    ``following`` at the lower end, ``before_<n>`` the value of ``last`` at the lower.
    """
    by, keys = list(by), list(keys)
    levels, last, following = dict(levels or {}), dict(last or {}), dict(following or {})
    exprs = {**measures, **levels, **last, **following}
    inner = {n: f"_m{i}" for i, n in enumerate(exprs)}
    fact_rows = facts.select(
        *by, F.col("us"), F.lit(1).alias("_side"), *[e.alias(inner[n]) for n, e in exprs.items()]
    )
    ends = [
        F.struct(
            F.lit(i).alias("span"), us.cast("bigint").alias("us"), F.lit(sign).alias("sign")
        )
        for i, span in enumerate(spans)
        for us, sign in zip(span, (-1, 1))
    ]
    marks = points.select(*by, F.struct(*keys).alias("_key"), F.explode(F.array(*ends)).alias("_p"))
    marks = marks.select(
        *by, "_p.us", F.lit(2).alias("_side"), "_key", "_p.span", "_p.sign"
    )
    line = scan(
        fact_rows.unionByName(marks, allowMissingColumns=True),
        by,
        ["us", "_side"],
        sums={f"_t{n}": F.col(inner[n]) for n in [*measures, *levels]},
        prev={f"_t{n}": F.col(inner[n]) for n in last},
        next={f"_t{n}": F.col(inner[n]) for n in following},
        layout=layout,
    ).where(F.col("sign").isNotNull())
    high, low = F.col("sign") == 1, F.col("sign") == -1
    aggs = [F.sum(F.when(high, F.col(f"_t{n}")).otherwise(-F.col(f"_t{n}"))).alias(n) for n in measures]
    aggs += [F.max(F.when(high, F.col(f"_t{n}"))).alias(n) for n in levels]
    aggs += [F.max(F.when(high, F.col(f"_t{n}"))).alias(f"last_{n}") for n in last]
    aggs += [F.max(F.when(low, F.col(f"_t{n}"))).alias(f"before_{n}") for n in last]
    aggs += [F.max(F.when(low, F.col(f"_t{n}"))).alias(f"first_{n}") for n in following]
    wide = line.select(*by, "_key.*", "span", "sign", *[f"_t{n}" for n in exprs])
    return wide.groupBy(*by, *keys, "span").agg(*aggs)


def trailing_window_join(
    targets: DataFrame,
    observations: DataFrame,
    window_seconds: float,
    measures: Mapping[str, Column] | None = None,
    keys: Sequence[str] = ("outcome_id",),
    cutoff: str = "ts",
    layout: Layout | None = None,
) -> DataFrame:
    """Totals of the observations in (cutoff - w, cutoff] of every target.

    Windows may overlap. Every target appears, with zeros if its window is empty;
    ``observations`` is the count, further totals come from ``measures``.
    """
    measures = {"observations": F.lit(1).cast("bigint"), **(measures or {})}
    facts = observations.withColumn("us", C.micros("ts"))
    end = C.micros(cutoff)
    read = window_totals(
        facts,
        targets,
        measures,
        [(end - C.to_micros(window_seconds), end)],
        [*keys, cutoff],
        layout=layout,
    )
    return read.select("series", *keys, cutoff, *measures)


def onset_lookup(pairs: DataFrame, onsets: DataFrame) -> DataFrame:
    """Outcome pairs with the onset found between them, if the pair is the same one."""
    found = onsets.select("series", "prev_ts", "target_ts", "onset_ts", "onset_value")
    return pairs.join(found, ["series", "prev_ts", "target_ts"])


def first_match_in_interval(
    outcomes: DataFrame,
    observations: DataFrame,
    wanted: Column,
    tie: str = "obs_id",
    layout: Layout | None = None,
) -> DataFrame:
    """The first observation of each interval for which ``wanted`` holds."""
    inside = assign_interval(outcomes, observations.where(wanted), tie, layout=layout)
    kept = [c for c in inside.columns if c not in ("series", *INTERVAL)]
    first = F.min_by(F.struct(*kept), F.struct("ts", F.col(tie).cast("string")))
    return inside.groupBy("series", *INTERVAL).agg(first.alias("_f")).select(
        "series", *INTERVAL, "_f.*"
    )


def history_as_of(
    named: DataFrame, outcomes: DataFrame, thresholds: Sequence[str], through: bool = True
) -> DataFrame:
    """Prefix counts of the history of a named outcome, through it or strictly before.

    ``named`` has (series, outcome_id) and any other columns. The history is not
    gathered: its counts come from a table of running counts joined on the key.
    """
    hits = {f"hits_{i}": C.hit("value", F.lit(t).cast("decimal(18,6)")) for i, t in enumerate(thresholds)}
    counts = scan(
        outcomes.select("series", "ts", "outcome_id", "value"),
        ["series"],
        ["ts", "outcome_id"],
        sums={"n": F.lit(1).cast("bigint"), **{k: v.cast("bigint") for k, v in hits.items()}},
    )
    if through:
        own = {k: F.col(k) + v for k, v in hits.items()}
        counts = counts.withColumns({"n": F.col("n") + 1, **own})
    rows = F.array(
        *[
            F.struct(F.lit(str(t)).alias("threshold"), F.col(f"hits_{i}").alias("hits"))
            for i, t in enumerate(thresholds)
        ]
    )
    flat = counts.select("series", "outcome_id", "n", rows.alias("counts"))
    return named.join(flat, ["series", "outcome_id"], "left")


__all__ = [
    "assign_interval",
    "first_match_in_interval",
    "history_as_of",
    "onset_lookup",
    "outcome_pairs",
    "plan_layout",
    "sums_as_of",
    "trailing_window_join",
    "window_totals",
]

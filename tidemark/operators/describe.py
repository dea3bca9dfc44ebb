"""Descriptive statistics and data quality of outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.plans.quantiles import fits_one_task, medians

# Lower edges of the value buckets; the last one is open.
BUCKET_EDGES = ("1", "2", "5", "10")
PAYLOADS = ("pre_data", "post_data", "raw_data")


def _beside(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join two reports on their group; without a group both are single rows."""
    return left.join(right, list(by), "left") if by else left.crossJoin(F.broadcast(right))


def numeric_summary(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Min, max, mean (6 places, half even) and exact median of a decimal column."""
    value = F.col(column)
    moments = df.groupBy(*by).agg(
        F.count(value).alias("n"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.sum(value.cast("decimal(32,6)")).alias("total"),
    )
    moments = moments.withColumn("mean", C.mean_of(F.col("total"), F.col("n")))
    return _beside(moments.drop("total"), medians(df, by, {"median": value}), by)


def _inside(i: int, edges: Sequence[str]) -> Column:
    value, inside = F.col("value"), F.lit(True)
    if i > 0:
        inside = value >= F.lit(edges[i]).cast("decimal(18,6)")
    if i + 1 < len(edges):
        inside = inside & (value < F.lit(edges[i + 1]).cast("decimal(18,6)"))
    return inside


def _bucket_counts(edges: Sequence[str]) -> list[Column]:
    return [F.count_if(_inside(i, edges)).alias(f"bucket_{i}") for i in range(len(edges))]


def bucket_histogram(
    outcomes: DataFrame, by: Sequence[str] = (), edges: Sequence[str] = BUCKET_EDGES
) -> DataFrame:
    """Counts and percentages (2 places) of half-open value buckets, zeros kept."""
    counts = outcomes.groupBy(*by).agg(*_bucket_counts(edges), F.count("*").alias("n"))
    buckets = F.array(
        *[
            F.struct(
                F.lit(lower).cast("double").alias("lower"),
                F.lit(edges[i + 1] if i + 1 < len(edges) else None).cast("double").alias("upper"),
                F.col(f"bucket_{i}").alias("count"),
            )
            for i, lower in enumerate(edges)
        ]
    )
    return counts.select(*by, "n", F.explode(buckets).alias("b")).select(
        *by, "b.*", C.ratio(F.col("b.count") * 100, "n", 2).alias("pct")
    )


def _filled(name: str) -> Column:
    return F.coalesce(F.size(F.json_object_keys(F.col(name))) > 0, F.lit(False))


def _coverage() -> list[Column]:
    return [
        F.count("started_at").alias("with_started_at"),
        F.count("pre_observed_at").alias("with_pre_observed_at"),
        *[F.count_if(_filled(n)).alias(f"with_{n}") for n in PAYLOADS],
    ]


COVERAGE = ["with_started_at", "with_pre_observed_at", *[f"with_{n}" for n in PAYLOADS]]


def metadata_coverage(outcomes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """How many outcomes carry each optional field."""
    return outcomes.groupBy(*by).agg(F.count("*").alias("outcomes"), *_coverage())


def repeated_timestamps(outcomes: DataFrame, by_series: bool = False) -> DataFrame:
    """Outcomes beyond the first at the same instant of the same series."""
    per_time = outcomes.groupBy("series", "ts").count()
    by = ["series"] if by_series else []
    return per_time.groupBy(*by).agg(
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("repeated_timestamps")
    )


def _delay() -> Column:
    gap = C.micros("collection_ts") - C.micros("ts")
    return (gap.cast("decimal(18,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)")


def collection_delay(outcomes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Summary of collection time minus result time, in seconds, exact to the microsecond."""
    return numeric_summary(outcomes.select(*by, _delay().alias("delay")), "delay", by)


def range_and_series_count(selected: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """First and last instant, number of series, stored and selected rows, status."""
    report = selected.agg(
        F.count("*").alias("selected"),
        F.count_distinct("series").alias("series_count"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )
    total = (stored if stored is not None else selected).agg(F.count("*").alias("stored"))
    # Both sides are single rows.
    return report.crossJoin(F.broadcast(total)).withColumn("status", _status("selected"))


def _status(count: str) -> Column:
    return F.when(F.col(count) > 0, "COMPLETE").otherwise("NO_DATA")


def outcome_report(outcomes: DataFrame) -> DataFrame:
    """Everything above for the whole selection (``series`` null) and per series.

    Rows are reduced once to one per (series, ts), which also shows repeated instants;
    the reports per series and overall are sums of those. The overall row exists even
    when the selection is empty.
    """
    rows = outcomes.withColumn("delay", _delay())
    buckets = [f"bucket_{i}" for i in range(len(BUCKET_EDGES))]
    totals = ["value_total", "delay_total", *buckets, *COVERAGE]
    per_instant = rows.groupBy("series", "ts").agg(
        F.count("*").alias("selected"),
        F.min("value").alias("value_min"),
        F.max("value").alias("value_max"),
        F.min("delay").alias("delay_min"),
        F.max("delay").alias("delay_max"),
        F.sum(F.col("value").cast("decimal(32,6)")).alias("value_total"),
        F.sum(F.col("delay").cast("decimal(32,6)")).alias("delay_total"),
        *_bucket_counts(BUCKET_EDGES),
        *_coverage(),
    )
    lows, highs = ["value_min", "delay_min"], ["value_max", "delay_max"]

    def merge(repeated: Column, series: Column, first: str, last: str) -> list[Column]:
        return [
            F.coalesce(F.sum("selected"), F.lit(0)).alias("selected"),
            series.alias("series_count"),
            F.min(first).alias("first_ts"),
            F.max(last).alias("last_ts"),
            *[F.min(n).alias(n) for n in lows],
            *[F.max(n).alias(n) for n in highs],
            *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in totals],
            F.coalesce(repeated, F.lit(0)).alias("repeated_timestamps"),
        ]

    per_series = per_instant.groupBy("series").agg(
        *merge(F.sum(F.col("selected") - 1), F.lit(1).cast("bigint"), "ts", "ts")
    )
    overall = per_series.agg(
        *merge(F.sum("repeated_timestamps"), F.count("*"), "first_ts", "last_ts")
    )
    small = fits_one_task(outcomes)
    wanted = {"value_median": F.col("value"), "delay_median": F.col("delay")}
    per_series = _beside(per_series, medians(rows, ["series"], wanted, small), ["series"])
    overall = _beside(overall, medians(rows, [], wanted, small), []).withColumn(
        "series", F.lit(None).cast("string")
    )
    report = overall.unionByName(per_series)
    shares = {f"{b}_pct": C.ratio(F.col(b) * 100, "selected", 2) for b in buckets}
    means = {
        "value_mean": C.mean_of(F.col("value_total"), F.col("selected")),
        "delay_mean": C.mean_of(F.col("delay_total"), F.col("selected")),
    }
    report = report.withColumns({**shares, **means, "status": _status("selected")})
    return report.drop("value_total", "delay_total")

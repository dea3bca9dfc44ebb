"""Exact percentiles of groups of any size.

The built-in exact percentile keeps all distinct values of a group on one task. That
is right while a whole table fits a task, and is used then. Beyond, values are first
counted, the counts are accumulated with sliced scans in value order, and only the
one or two middle values of each group survive.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.lineage import settle
from tidemark.plans.ordering import SMALL_ROW_BYTES, scan, stored_bytes, task_rows

SLICES_PER_DOUBLING = 64
# Rows of a report that every task may hold.
BROADCAST_ROWS = 100_000


def fits_one_task(df: DataFrame) -> bool:
    """True if the stored tables behind ``df`` are small enough for one task together.

    A session's layout says nothing here: it is about the largest series, and a table of
    many small series may be of any size. Where nothing is known the table is large.
    """
    stored = stored_bytes(df)
    return stored is not None and stored <= task_rows(df) * SMALL_ROW_BYTES


def percentiles(
    df: DataFrame,
    by: Sequence[str],
    wanted: Mapping[str, tuple[Column, float]],
    small: bool | None = None,
) -> DataFrame:
    """One row per group with the interpolated percentile of each named expression."""
    small = fits_one_task(df) if small is None else small
    exact = {n: _decimal(df, e) for n, (e, q) in wanted.items() if q == 0.5}
    if small:
        return df.groupBy(*by).agg(
            *[_middle(e, exact[n], n) if exact.get(n) else F.percentile(e.cast("double"), q).alias(n) for n, (e, q) in wanted.items()]
        )
    result = None
    for name, (expr, q) in wanted.items():
        one = _percentile(df, by, expr, q, name, exact.get(name))
        if result is None:
            result = one
        elif by:
            result = result.join(one, list(by), "full")
        else:
            result = result.crossJoin(F.broadcast(one))  # single rows
    return result


def _decimal(df: DataFrame, expr: Column) -> T.DecimalType | None:
    """The type of an expression, if it is a decimal: its median is then one too."""
    kind = df.select(expr.alias("_v")).schema["_v"].dataType
    return kind if isinstance(kind, T.DecimalType) else None


def _mean(lower: Column, upper: Column, kind: T.DecimalType) -> Column:
    """The mean of two decimals: equal ones keep every digit, others get one more place.

    Where 38 digits do not allow that (more than 28 before and behind the point), the mean of
    unequal ones has as many places as there is room for.
    """
    places = min(kind.scale + 1, 35 - (kind.precision - kind.scale))
    wide = f"decimal(38,{max(places, kind.scale)})"
    half = (lower + upper).cast(f"decimal(36,{places - 1 if places > kind.scale else places})") * F.lit("0.5").cast("decimal(1,1)")
    return F.when(lower == upper, lower.cast(wide)).otherwise(half.cast(wide))


def _middle(expr: Column, kind: T.DecimalType, name: str) -> Column:
    """The exact median of a group's decimals, which one task holds, as the percentile would."""
    values = F.array_sort(F.collect_list(expr))
    n = F.size(values)
    lower, upper = F.get(values, F.floor((n - 1) / 2).cast("int")), F.get(values, F.floor(n / 2).cast("int"))
    return F.when(n > 0, _mean(lower, upper, kind)).alias(name)


def medians(
    df: DataFrame, by: Sequence[str], wanted: Mapping[str, Column], small: bool | None = None
) -> DataFrame:
    return percentiles(df, by, {n: (e, 0.5) for n, e in wanted.items()}, small)


def weighted_medians(
    df: DataFrame, by: Sequence[str], value: str, weight: str, name: str, total: str, small: bool
) -> DataFrame:
    """Median (``name``) of a double column whose rows count ``weight`` times, and the sum of weights.

    Rows of a large ``df`` are never shuffled: totals per narrow relative span of value say in
    which spans the two middle ranks lie, and only values of those spans are then counted. ``by``
    is never null. ``df`` is read twice; the report has a row per group.
    """
    by = list(by)
    if small:
        return df.groupBy(*by).agg(
            F.sum(weight).alias(total), F.percentile(F.col(value), F.lit(0.5), F.col(weight)).alias(name)
        )
    v = F.col(value)
    span = F.floor(F.signum(v) * F.log2(F.abs(v) + 1) * SLICES_PER_DOUBLING)
    spans = df.groupBy(*by, span.alias("_span")).agg(F.sum(weight).alias("_c"))
    rising = Window.partitionBy(*by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    ranked = spans.withColumns(
        {"_below": F.coalesce(F.sum("_c").over(rising), F.lit(0)), "_n": F.sum("_c").over(Window.partitionBy(*by))}
    )
    low, high = F.floor((F.col("_n") - 1) / 2).cast("bigint"), F.ceil((F.col("_n") - 1) / 2).cast("bigint")

    def holds(rank: Column) -> Column:
        return (F.col("_below") <= rank) & (rank < F.col("_below") + F.col("_c"))

    middle = settle(ranked.where(holds(low) | holds(high)).select(*by, "_span", "_below", "_n"))
    wanted = F.broadcast(middle) if middle.count() <= BROADCAST_ROWS else middle
    values = df.withColumn("_span", span).join(wanted, [*by, "_span"])
    counted = values.groupBy(*by, "_span", "_below", "_n", value).agg(F.sum(weight).alias("_c"))
    inside = Window.partitionBy(*by, "_span").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("_below", F.col("_below") + F.coalesce(F.sum("_c").over(inside), F.lit(0)))
    lower, upper = F.max(F.when(holds(low), v)), F.max(F.when(holds(high), v))
    mixed = F.when(lower == upper, lower).otherwise(lower * 0.5 + upper * 0.5)
    return counted.where(holds(low) | holds(high)).groupBy(*by).agg(
        F.max("_n").alias(total), mixed.alias(name)
    )


def summarise(
    df: DataFrame,
    by: Sequence[str],
    aggregates: Sequence[Column],
    wanted: Mapping[str, Column],
    small: bool,
) -> DataFrame:
    """Aggregates and medians of the same groups: one pass where a task holds all rows,
    a pass per median beside the aggregates otherwise."""
    if small:
        kinds = {n: _decimal(df, e) for n, e in wanted.items()}
        exact = [_middle(e, kinds[n], n) if kinds[n] else F.percentile(e.cast("double"), 0.5).alias(n) for n, e in wanted.items()]
        return df.groupBy(*by).agg(*aggregates, *exact)
    report = df.groupBy(*by).agg(*aggregates)
    return report.join(medians(df, by, wanted, small), list(by), "left")


def in_seconds(name: str) -> Column:
    """Seconds to 6 places of a median in microseconds, ties to even."""
    return F.bround(name, 0) / F.lit(1e6)


def median_seconds(
    df: DataFrame, by: Sequence[str], wanted: Mapping[str, Column], small: bool | None = None
) -> DataFrame:
    """Medians of durations given in whole microseconds, in seconds to 6 places.

    Half microseconds are exact before they are rounded, half to even.
    """
    found = medians(df, by, wanted, small)
    return found.withColumns({n: in_seconds(n) for n in wanted})


def _percentile(df: DataFrame, by: Sequence[str], expr: Column, q: float, name: str, kind: T.DecimalType | None) -> DataFrame:
    values = df.select(*by, (expr if kind else expr.cast("double")).alias("_v")).where(F.col("_v").isNotNull())
    counts = values.groupBy(*by, "_v").agg(F.count("*").alias("_c"))
    keys = list(by) or ["_all"]
    if not by:
        counts = counts.withColumn("_all", F.lit(0))
    # Slices are narrow relative spans of value, so no look at the data is needed.
    size = F.col("_v").cast("double")
    slices = F.floor(F.signum(size) * F.log2(F.abs(size) + 1) * SLICES_PER_DOUBLING)
    ranked = scan(counts, keys, ["_v"], sums={"_below": F.col("_c")}, slices=slices)
    totals = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    position = (F.col("_n") - 1) * F.lit(q)
    low, high = F.floor(position), F.ceil(position)

    def holds(rank: Column) -> Column:
        return (F.col("_below") <= rank) & (rank < F.col("_below") + F.col("_c"))

    middle = ranked.join(totals, keys).where(holds(low) | holds(high))
    weight = F.max(position - low)
    lower = F.max(F.when(holds(low), F.col("_v")))
    upper = F.max(F.when(holds(high), F.col("_v")))
    mixed = _mean(lower, upper, kind) if kind else F.when(weight == 0, lower).otherwise(lower * (1 - weight) + upper * weight)
    # Without keys there is one row, of null where there are no values.
    return middle.groupBy(*by).agg(mixed.alias(name)).select(*by, name)

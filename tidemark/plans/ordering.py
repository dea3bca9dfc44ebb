"""Ordered scans over series of any size.

A window over ``partitionBy(series)`` puts one series on one task, which fails when
a single series holds a third of all rows. The helpers here cut a large series into
slices that many tasks share and hand each slice what it needs of its neighbours:

* ``scan``     running sums, and the nearest earlier / later non-null value. Slices
  are spans of time, or ranges of the whole order where one instant has too many rows;
  each gets a carry computed from one summary row per slice.
* ``number``   position of a row in its series, from the same carries.
* ``rolling``  frames over the last ``back`` rows. Slices are blocks of row numbers;
  each block also receives the last ``back`` rows of the block before it.

Whether slicing is needed is a ``Layout``. Set for a session with ``use_layout``, it
costs nothing; otherwise small inputs are recognised by their stored size and larger
ones are counted. Small series run as plain windows: one exchange and no join.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.lineage import settle

TASK_ROWS_CONF = "tidemark.task.rows"
LAYOUT_CONF = "tidemark.layout"
DEFAULT_TASK_ROWS = 250_000  # a task may hold several windows over them, of kilobytes a row
GRID_CELLS = 4096
DEFAULT_SLICE_US = 3_600_000_000  # an hour, where nothing better is known
# Inputs below this many stored bytes per row of a task are taken as small unseen.
SMALL_ROW_BYTES = 32

SLICE = "_slice"
TIE = "_equal_rows"
HOME = "_home"


@dataclass(frozen=True)
class Layout:
    """How one series is cut: width of a time slice, rows of a block (None: whole).

    With ``parts``, no width of time is narrow enough, as one instant has more rows than a
    task: slices are then ranges of the whole order, ties included.
    """

    slice_us: int | None = None
    block_rows: int | None = None
    parts: int | None = None

    @property
    def whole(self) -> bool:
        return self.block_rows is None


WHOLE = Layout()


def use_layout(spark: SparkSession, layout: Layout | None) -> None:
    """Make a layout the default of all operators of the session (None: decide anew).

    Planned once on the stored tables, it spares the operators from counting the
    rows of what they are given.
    """
    if layout is None:
        spark.conf.unset(LAYOUT_CONF)
    else:
        spark.conf.set(LAYOUT_CONF, f"{layout.slice_us or 0},{layout.block_rows or 0},{layout.parts or 0}")


def task_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(TASK_ROWS_CONF, str(DEFAULT_TASK_ROWS)))


def declared_layout(df: DataFrame) -> Layout | None:
    """The layout that needs no look at the data: the session's, or whole if small."""
    text = df.sparkSession.conf.get(LAYOUT_CONF, "")
    if text:
        return Layout(*(int(part) or None for part in text.split(",")))
    stored = stored_bytes(df)
    if stored is not None and stored <= task_rows(df) * SMALL_ROW_BYTES:
        return WHOLE
    return None


def stored_bytes(df: DataFrame) -> int | None:
    """Bytes of the tables a DataFrame reads, from their file listing; no job runs."""
    if getattr(df, "_jdf", None) is None or df.isStreaming:
        return None  # no estimate here: the caller counts rows
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    sizes = [leaves.apply(i).stats().sizeInBytes() for i in range(leaves.size())]
    return sum(int(str(size)) for size in sizes)


def _is_time(df: DataFrame, name: str) -> bool:
    return name in ("us", "ts") or isinstance(df.schema[name].dataType, T.TimestampType)


def _time_us(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, T.TimestampType):
        return F.unix_micros(F.col(name))
    return F.col(name).cast("bigint")


def plan_layout(df: DataFrame, by: Sequence[str], order: str) -> Layout:
    """The layout to scan ``df`` with: the declared one, else one made by counting.

    Series ordered by a position or sequence number need no counts, because blocks of
    numbers are blocks of rows.
    """
    declared = declared_layout(df)
    if declared is not None:
        return declared
    if not _is_time(df, order):
        return Layout(block_rows=task_rows(df))
    return measure_layout(df, by, order)


def measure_layout(df: DataFrame, by: Sequence[str], time: str) -> Layout:
    """Choose slices so that no slice of one series exceeds the rows of a task.

    Runs at most three jobs over two columns; each returns a single row.
    """
    limit = task_rows(df)
    at = _time_us(df, time)
    span = df.agg(F.count("*").alias("n"), F.min(at).alias("lo"), F.max(at).alias("hi")).first()
    if span.n <= limit:
        return WHOLE
    cell = max(1, (span.hi - span.lo) // GRID_CELLS + 1)
    per_cell = df.groupBy(*by, F.floor(at / F.lit(cell)).alias("_cell")).count()
    densest = (
        per_cell.groupBy(*by)
        .agg(F.sum("count").alias("rows"), F.max("count").alias("cell_rows"))
        .agg(F.max("rows").alias("rows"), F.max("cell_rows").alias("cell_rows"))
        .first()
    )
    if densest.rows <= limit:
        return WHOLE
    if densest.cell_rows <= limit:
        return Layout(slice_us=int(cell), block_rows=limit)
    width = int(max(1, cell * limit // densest.cell_rows))
    slices = df.groupBy(*by, F.floor(at / F.lit(width)).alias("_cell")).count()
    most = slices.agg(F.max("count")).first()[0]
    # Rows of a cell may be anywhere in it, all at one instant at worst.
    return Layout(width, limit, 2 * -(-span.n // limit) if most > limit else None)


def _order(names: Sequence[str], reverse: bool = False) -> list[Column]:
    if reverse:
        return [F.col(n).desc_nulls_last() for n in names]
    return [F.col(n).asc_nulls_first() for n in names]


def window(by: Sequence[str], order: Sequence[str], reverse: bool = False) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*_order(order, reverse))


def scan(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    *,
    sums: Mapping[str, Column] | None = None,
    prev: Mapping[str, Column] | None = None,
    next: Mapping[str, Column] | None = None,
    layout: Layout | None = None,
    slices: Column | None = None,
) -> DataFrame:
    """Add running values over each series, strictly before (or after) every row.

    ``sums``  total of the expression over all earlier rows (0 at the start);
    ``prev``  last non-null value of the expression among earlier rows;
    ``next``  first non-null value of the expression among later rows.
    Slices are cut by the first column of ``order``: spans of time, or of numbers.
    ``slices`` replaces them by any expression that never falls along the order.
    """
    sums, prev, next = dict(sums or {}), dict(prev or {}), dict(next or {})
    if layout is None:
        layout = plan_layout(df, by, order[0]) if slices is None else Layout(block_rows=1)
    keys = list(by)
    if not layout.whole:
        keys = [*by, SLICE]
        df = _sliced(df, by, order, layout) if slices is None else df.withColumn(SLICE, slices)

    names = [f"_in{i}" for i in range(len(sums) + len(prev) + len(next))]
    exprs = [*sums.values(), *prev.values(), *next.values()]
    df = df.withColumns(dict(zip(names, exprs)))
    sum_in, prev_in, next_in = _split(names, len(sums), len(prev))

    earlier = window(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    # Later rows are earlier rows of the reversed order: an unbounded-following
    # frame would be evaluated again for every row.
    later = window(keys, order, reverse=True).rowsBetween(Window.unboundedPreceding, -1)
    local = {}
    for out, name in zip(sums, sum_in):
        local[out] = F.coalesce(F.sum(name).over(earlier), F.lit(0))
    for out, name in zip(prev, prev_in):
        local[out] = F.last(name, ignorenulls=True).over(earlier)
    for out, name in zip(next, next_in):
        local[out] = F.last(name, ignorenulls=True).over(later)
    if layout.whole:
        return df.withColumns(local).drop(*names)

    carry = _carry(df, by, order, sum_in, prev_in, next_in)
    joined = df.withColumns(local).join(carry, keys, "left")
    merged = {}
    for out, name in zip(sums, sum_in):
        merged[out] = F.col(out) + F.coalesce(F.col("c" + name), F.lit(0))
    for out, name in [*zip(prev, prev_in), *zip(next, next_in)]:
        merged[out] = F.coalesce(F.col(out), F.col("c" + name))
    return joined.withColumns(merged).drop(*names, *["c" + n for n in names], SLICE)


def _sliced(df: DataFrame, by: Sequence[str], order: Sequence[str], layout: Layout) -> DataFrame:
    """``df`` with the number of its slice, which never falls along the order of a series.

    Slices of ``parts`` are the partitions of a sort by range, which splits an instant between
    its ties, and rows that are equal in the whole order, which may come in any, anywhere. What
    is read twice must be cut alike both times, so these are written first.
    """
    if layout.parts and _is_time(df, order[0]):
        told = df.withColumn(TIE, F.monotonically_increasing_id())
        ranged = told.repartitionByRange(layout.parts, *_order([*by, *order, TIE])).drop(TIE)
        return settle(ranged.withColumn(SLICE, F.spark_partition_id().cast("bigint")))
    width = layout.slice_us if _is_time(df, order[0]) else layout.block_rows
    return df.withColumn(SLICE, F.floor(_time_us(df, order[0]) / F.lit(width or DEFAULT_SLICE_US)))


def _split(names: list[str], first: int, second: int) -> tuple[list[str], list[str], list[str]]:
    return names[:first], names[first : first + second], names[first + second :]


def _carry(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    sum_in: list[str],
    prev_in: list[str],
    next_in: list[str],
) -> DataFrame:
    """One row per slice with what all earlier (or later) slices contribute."""
    place = F.struct(*[F.col(n) for n in order])

    def known(name: str) -> Column:
        return F.when(F.col(name).isNotNull(), place)

    aggs = [F.sum(n).alias(n) for n in sum_in]
    aggs += [F.max_by(F.col(n), known(n)).alias(n) for n in prev_in]
    aggs += [F.min_by(F.col(n), known(n)).alias(n) for n in next_in]
    slices = df.groupBy(*by, SLICE).agg(*(aggs or [F.count("*").alias("_n")]))
    before = window(by, [SLICE]).rowsBetween(Window.unboundedPreceding, -1)
    after = window(by, [SLICE], reverse=True).rowsBetween(Window.unboundedPreceding, -1)
    out = [F.sum(n).over(before).alias("c" + n) for n in sum_in]
    out += [F.last(n, ignorenulls=True).over(before).alias("c" + n) for n in prev_in]
    out += [F.last(n, ignorenulls=True).over(after).alias("c" + n) for n in next_in]
    return slices.select(*by, SLICE, *out)


def number(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    name: str = "pos",
    layout: Layout | None = None,
) -> DataFrame:
    """Add the 0-based position of each row in its series."""
    return scan(df, by, order, sums={name: F.lit(1).cast("bigint")}, layout=layout)


def rolling(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    back: int,
    columns: Callable[[WindowSpec], Mapping[str, Column]],
    layout: Layout | None = None,
    pos: str = "pos",
) -> DataFrame:
    """Add columns computed over frames that reach at most ``back`` rows back.

    ``columns`` gets the ordered window and returns the named columns. The position
    of the row in its series is added as ``pos``.
    """
    layout = layout if layout is not None else plan_layout(df, by, order[0])
    if layout.whole:
        spec = window(by, order)
        index = (F.row_number().over(spec) - 1).cast("bigint")
        return df.withColumns({pos: index, **columns(spec)})
    rows = max(int(layout.block_rows or DEFAULT_TASK_ROWS), 2 * back, 1)
    numbered = df if pos in df.columns else number(df, by, order, pos, layout)
    spread = with_halo(numbered, pos, rows, back)
    spec = window([*by, SLICE], [pos])
    return spread.withColumns(columns(spec)).where(HOME).drop(SLICE, HOME)


def with_halo(df: DataFrame, pos: str, rows: int, back: int) -> DataFrame:
    """Cut series into blocks of ``rows``; copy the last ``back`` rows into the next."""
    block = F.floor(F.col(pos) / F.lit(rows)).cast("bigint")
    tail = F.pmod(F.col(pos), F.lit(rows)) >= F.lit(rows - back)
    homes = F.when(tail, F.array(block, block + 1)).otherwise(F.array(block))
    return (
        df.withColumn("_own", block)
        .withColumn(SLICE, F.explode(homes))
        .withColumn(HOME, F.col(SLICE) == F.col("_own"))
        .drop("_own")
    )

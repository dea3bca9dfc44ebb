"""Ordered pandas kernels over series of any size.

A kernel that needs the whole past of a series as a small state (moment sums, a
filter's matrices) runs once per block of rows. Each block first yields a summary;
the summaries of earlier blocks are combined into the state a block starts from. Of tables
that fit a kernel, every series is one block and needs no summaries.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.ordering import SMALL_ROW_BYTES, Layout, stored_bytes, task_rows, with_halo

# Rows of a series that a kernel gets at once: in pandas a row takes kilobytes.
KERNEL_ROWS = 50_000

Kernel = Callable[[pd.DataFrame, "pd.DataFrame | None"], pd.DataFrame]


def run_blocks(
    rows: DataFrame,
    by: Sequence[str],
    layout: Layout,
    schema: str,
    kernel: Kernel,
    summary_schema: str,
    summarise: Callable[[pd.DataFrame], pd.DataFrame],
    combine: Callable[[pd.DataFrame], pd.DataFrame],
    state_schema: str,
    halo: int = 0,
    pos: str = "pos",
    align: int = 1,
    steps: Sequence[str] = (),
) -> DataFrame:
    """Apply ``kernel(rows, state)`` to every block of every series, in row order.

    ``summarise`` reduces the rows of a block to one summary row (or a few);
    ``combine`` turns the summaries of a series, ordered by block, into the state at
    the start of each block. ``halo`` rows of the block before are prepended; states
    refer to the first of them. Rows of the halo have ``_home`` false.

    The layout says what a task of plain windows holds; kernels get ``KERNEL_ROWS`` at most, up
    to a multiple of ``align``. With ``steps``, summaries are many: ``combine`` then maps batches of
    them, sorted by series and ``steps``, so that a series' summaries are never together.
    """
    by = list(by)
    most = min(KERNEL_ROWS, task_rows(rows))
    stored = stored_bytes(rows) if layout.whole else None
    if stored is not None and stored <= most * SMALL_ROW_BYTES:

        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            return kernel(pdf.sort_values(pos).assign(_home=True), None)

        return rows.groupBy(*by).applyInPandas(whole, schema)

    size = max(min(int(layout.block_rows or most), most), 2 * halo, 1)
    size = -(-size // align) * align
    keyed = rows.withColumn("_slice", F.floor((F.col(pos) + halo) / F.lit(size)).cast("bigint"))
    summaries = keyed.groupBy(*by, "_slice").applyInPandas(
        lambda pdf: summarise(pdf.sort_values(pos)), summary_schema
    )
    if steps:
        ordered = summaries.repartition(*by).sortWithinPartitions(*by, *steps)
        states = ordered.mapInPandas(combine, state_schema)
    else:
        states = summaries.groupBy(*by).applyInPandas(
            lambda pdf: combine(pdf.sort_values("_slice")), state_schema
        )
    spread = with_halo(rows, pos, size, halo)

    def block(pdf: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty or not pdf["_home"].any():
            return kernel(pdf.iloc[:0], None)
        return kernel(pdf.sort_values(pos), state)

    keys = [*by, "_slice"]
    return spread.groupBy(*keys).cogroup(states.groupBy(*keys)).applyInPandas(block, schema)

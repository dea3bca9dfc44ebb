"""Continuous ingestion: idempotent outcomes, tailed observations, rolling features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators.features import STATE_FEATURES, gap_columns, state_measures, state_vector
from tidemark.schemas import OBSERVATION_LINE, OUTCOME, OUTCOME_COLUMNS
from tidemark.sources.ledgers import stamp_version
from tidemark.sources.observations import flat_observations
from tidemark.sources.outcomes import AppendResult, append_outcomes
from tidemark.streaming.tail import tail_lines


def stream_outcomes(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Canonical outcomes as they arrive in a folder of closed JSON files."""
    reader = spark.readStream.schema(OUTCOME)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def distinct_outcomes(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each key once; replays are recognised as long as the watermark allows."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["series", "outcome_id"])


def outcome_sink(
    path: str, results: list[AppendResult] | None = None
) -> Callable[[DataFrame, int], None]:
    """foreachBatch function that appends outcomes to a table.

    The append skips keys that are stored already, so a batch that is run again after
    a failure changes nothing; a key with other contents stops the stream.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        result = append_outcomes(batch.select(*OUTCOME_COLUMNS), path)
        if results is not None:
            results.append(result)

    return write


def ledger_sink(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch function that appends ledger events, exactly once per batch.

    A batch that is run again replaces its own folder. Numbers of batches start anew with
    each stream, so the folder is also named by the id of the query, which is kept in its
    checkpoint: a second stream, or one with a new checkpoint, replaces nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        query_id = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        target = f"{path}/query_id={query_id}/batch_id={batch_id}"
        stamp_version(batch).write.mode("overwrite").json(target)

    return write


def tail_observations(spark: SparkSession, path: str) -> DataFrame:
    """Observations from lines that are appended to the files of a folder, each line once."""
    lines = tail_lines(spark, path).select(F.from_json("value", OBSERVATION_LINE).alias("line"))
    return flat_observations(lines.where(F.col("line.observed_at").isNotNull()).select("line.*"))


def rolling_stream_features(
    observations: DataFrame,
    window: str = "8 seconds",
    slide: str = "2 seconds",
    delay: str = "10 seconds",
) -> DataFrame:
    """All state features of the last ``window`` before every multiple of ``slide``.

    (series, start, end, n and the features by name) for windows (start, end] with an
    observation, as soon as the watermark has passed them; later rows are dropped. The rows
    of a series meet in panes of ``slide`` first, whose totals, edges and sockets are then put
    together window by window, so all figures are exact: they equal ``window_state_features``
    at the cutoff ``end``.
    """
    # Windows are closed at their end; event-time windows are closed at their start.
    rows = observations.withColumn("_us", C.micros("ts"))
    rows = rows.withColumn("_at", F.timestamp_micros(F.col("_us") - 1)).withWatermark("_at", delay)
    measures = state_measures()
    panes = rows.groupBy("series", F.window("_at", slide).alias("_pane")).agg(
        *[F.sum(m).alias(n) for n, m in measures.items()],
        F.array_sort(F.collect_list("_us")).alias("_times"), F.collect_set("socket").alias("_sockets"),
    )
    edges = F.struct(F.element_at("_times", 1).alias("first"), F.element_at("_times", -1).alias("last"), _squares("_times").alias("gap2"))
    panes = panes.select("series", "_pane", *measures, edges.alias("_edges"), "_sockets")
    windows = panes.groupBy("series", F.window("_pane", window, slide).alias("_w")).agg(
        *[F.sum(n).alias(n) for n in measures],
        F.array_sort(F.collect_list("_edges")).alias("_panes"), F.array_distinct(F.flatten(F.collect_list("_sockets"))).alias("_sockets"),
    )
    none = F.lit(0).cast("decimal(38,0)")
    within = F.aggregate("_panes", none, lambda total, p: (total + p["gap2"]).cast("decimal(38,0)"))
    seams = F.flatten(F.transform("_panes", lambda p: F.array(p["first"], p["last"])))
    between = _squares(F.slice(seams, F.lit(2), F.greatest(F.size(seams) - 2, F.lit(0))), 2)
    first = F.element_at("_panes", 1)["first"]
    totals = windows.select(
        "series", F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *measures, F.size("_sockets").alias("_open"),
        first.alias("first_seen_next_us"), first.alias("before_seen_us"), F.element_at("_panes", -1)["last"].alias("last_seen_us"),
        (within + between).cast("decimal(38,0)").alias("gap2"),
    )
    vector = state_vector(F.col("_open"))
    return gap_columns(totals).select("series", "start", "end", "n", *[v.alias(n) for v, n in zip(vector, STATE_FEATURES)])


def _squares(times: Column | str, step: int = 1) -> Column:
    """The sum of squared differences of neighbours, or of every ``step``-th pair of them."""
    times = F.col(times) if isinstance(times, str) else times
    count = F.floor((F.size(times) - 1 + step - 1) / step).cast("int")
    places = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))

    def add(total: Column, i: Column) -> Column:
        gap = (F.get(times, i * step + 1) - F.get(times, i * step)).cast("decimal(19,0)")
        return (total + gap * gap).cast("decimal(38,0)")

    return F.aggregate(places, F.lit(0).cast("decimal(38,0)"), add)

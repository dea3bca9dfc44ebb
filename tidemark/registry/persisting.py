"""What is written and read again: tables, ledgers, reports, exports, streams."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from tidemark.operators import ledger as L
from tidemark.plans.lineage import new_folder
from tidemark.registry.common import FREQUENCY, OUTCOMES, elements, observed
from tidemark.registry.modelling import LEDGER
from tidemark.registry.timing import _vector_sql
from tidemark.operators.features import STATE_FEATURES
from tidemark.schemas import OUTCOME_COLUMNS, STREAM_LEDGER
from tidemark.sources import driver_tables as D
from tidemark.sources import ledgers
from tidemark.sources import outcomes as S
from tidemark.streaming import ingest, locks

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def add(function):
        QUERIES[name], ORACLES[name] = function, sql
        return function

    return add


STORED = f"WITH {OUTCOMES} SELECT series, outcome_id, value::DOUBLE AS value, ts FROM outcomes"


@query("export_outcomes", STORED)
def _(spark, sf_dir):
    folder = new_folder(spark, "export")
    S.export_outcomes(D.outcomes(spark, sf_dir), folder)
    lines = spark.read.schema("source string, round_id string, multiplier string, timestamp string").json(folder)
    return lines.select(
        F.col("source").alias("series"), F.col("round_id").alias("outcome_id"),
        F.col("multiplier").cast("double").alias("value"), F.col("timestamp").cast("timestamp").alias("ts"),
    )


@query("export_manifest", f"WITH {OUTCOMES} SELECT count(*) AS rows, true AS digested FROM outcomes")
def _(spark, sf_dir):
    manifest = S.export_outcomes(D.outcomes(spark, sf_dir), new_folder(spark, "export"))
    return manifest.agg(F.sum("rows").alias("rows"), F.every(F.length("sha256") == 64).alias("digested"))


@query("append_ledger", f"WITH {LEDGER} SELECT series, 'lock-' || event_id AS lock_id, event_id * 5 + 2 AS scored_seq, value::DOUBLE AS actual FROM pairs")
def _(spark, sf_dir):
    folder = new_folder(spark, "ledger")
    ledgers.append_ledger(D.ledger(spark, sf_dir), folder)
    return L.lock_score_pairing(ledgers.read_ledger(spark, folder)).drop("lock")


@query("write_report", f"WITH {OUTCOMES} SELECT series, count(*) AS outcomes FROM outcomes GROUP BY series")
def _(spark, sf_dir):
    folder = new_folder(spark, "report")
    ledgers.write_report(S.count_outcomes(D.outcomes(spark, sf_dir)), folder)
    return spark.read.schema("series string, outcomes bigint").json(folder)


@query("stream_outcomes", STORED)
def _(spark, sf_dir):
    """All outcomes arrive, then all of them again; the table holds each once."""
    arriving, table, progress = (new_folder(spark, n) for n in ("arriving", "outcomes", "progress"))
    rows = D.outcomes(spark, sf_dir).select(*OUTCOME_COLUMNS)
    for _ in range(2):
        rows.write.mode("append").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(arriving)
        stream = ingest.stream_outcomes(spark, arriving).writeStream.foreachBatch(ingest.outcome_sink(table))
        stream.option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(table).select("series", "outcome_id", "value", "ts")


@query(
    "stream_window_features",
    _vector_sql(
        f"""{observed(True).strip()}, ends AS (SELECT DISTINCT series, CAST(ceil(epoch_us(ts) / 7.2e9) AS BIGINT) + k AS slot FROM obs, range(4) AS r(k)),
        points AS (SELECT series, series || '@' || slot AS key, make_timestamp(slot * 7200000000) AS cutoff FROM ends)""",
        [("p.cutoff - INTERVAL 8 HOUR", "")], minimum=1,
    ),
)
def _(spark, sf_dir):
    """Observations arrive in a folder; a row far ahead lets the watermark pass them all."""
    arriving, out, progress = (new_folder(spark, n) for n in ("arriving", "windows", "progress"))
    rows = D.observations(spark, sf_dir, True).select(
        "series", "ts", "direction", "payload_format", "payload_bytes", "socket", "entropy", "zero_ratio", "high_bit_ratio", "unique_byte_bucket"
    )
    ahead = rows.agg(F.timestamp_micros(F.max(F.unix_micros("ts")) + 10 * 86_400_000_000).alias("ts"))
    rows.unionByName(ahead.withColumn("series", F.lit("")), allowMissingColumns=True).write.parquet(arriving)
    stream = ingest.rolling_stream_features(spark.readStream.schema(rows.schema).parquet(arriving), "8 hours", "2 hours", "1 minute")
    with flushing(spark):
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(stream.schema).parquet(out).where("series <> ''")
    slot = F.floor(F.unix_micros("end") / 7_200_000_000).cast("string")
    return elements(found.select("series", F.concat("series", F.lit("@"), slot).alias("key"), F.array(*STATE_FEATURES).alias("state")), "state", ["series", "key"])


@contextmanager
def flushing(spark):
    """Streams that start here go on without data until the watermark has passed all rows."""
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@query("tail_observations", f"WITH {observed()} SELECT series, kind, ts, socket, direction, payload_bytes, payload_format FROM obs")
def _(spark, sf_dir):
    """Lines arrive in two parts; the second run goes on where the first one ended."""
    folder, out, progress = (new_folder(spark, n) for n in ("lines", "tailed", "progress"))
    rows = D.observations(spark, sf_dir)
    lines = rows.select(
        F.to_json(
            F.struct(
                "series", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("observed_at"), "kind", "url", F.col("socket").alias("socket_id"), "opcode", "status",
                F.struct(F.col("payload_bytes").alias("bytes"), F.col("payload_format").alias("format")).alias("payload"),
            )
        ).alias("value"), (F.crc32("obs_id") % 2).alias("half")
    )
    for half in range(2):
        lines.where(F.col("half") == half).select("value").write.mode("append").text(folder)
        tailed = ingest.tail_observations(spark, folder).select("series", "kind", "ts", "socket", "direction", "payload_bytes", "payload_format")
        tailed.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(tailed.schema).parquet(out)


@contextmanager
def keyed_state(spark):
    """Keyed state of Python operators needs the RocksDB store."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@query(
    "stream_locks",
    f"""WITH {FREQUENCY}, parts AS (SELECT *, event_id * 4 // (SELECT max(event_id) + 1 FROM events) AS part FROM forecast),
    seen AS (SELECT series, threshold, part, count(*) AS rows, CAST(sum(actual) AS BIGINT) AS won, arg_min(outcome_id, (ts, outcome_id)) AS first_id FROM parts GROUP BY ALL),
    locks AS (SELECT *, CAST(sum(rows) OVER w AS BIGINT) AS history_count, sum(won) OVER w AS hits, lead(first_id) OVER w AS actual_id, lead(rows) OVER w - 1 AS others
      FROM seen WINDOW w AS (PARTITION BY series, threshold ORDER BY part))
    SELECT series, history_count, threshold::DOUBLE AS threshold, CASE WHEN history_count >= 50 THEN round_even(hits / history_count, 6) END AS probability, actual_id,
      CASE WHEN others > 0 THEN others END AS unpredicted FROM locks""",
)
def _(spark, sf_dir):
    """Outcomes arrive in four parts; each is scored, its others are a gap, and a lock follows."""
    arriving, out, progress = (new_folder(spark, n) for n in ("arriving", "ledger", "progress"))
    rows = D.outcomes(spark, sf_dir).select("series", "outcome_id", "value", "ts")
    upto = D.events(spark, sf_dir).agg(F.max("event_id") + 1).first()[0]
    part = F.floor(F.col("outcome_id").cast("bigint") * 4 / upto)
    with keyed_state(spark):
        for k in range(4):
            rows.where(part == k).write.mode("append").parquet(arriving)
            stream = locks.lock_and_score(locks.messages(outcomes=spark.readStream.schema(rows.schema).parquet(arriving)), D.THRESHOLDS)
            writer = stream.writeStream.foreachBatch(ingest.ledger_sink(out)).option("checkpointLocation", progress)
            writer.trigger(availableNow=True).start().awaitTermination()
    events = spark.read.schema(STREAM_LEDGER).json(out)
    locked = events.where("event = 'prediction_locked'").select("series", "lock_id", "history_count", F.explode("details").alias("threshold", "detail"))
    scored = events.where("event = 'prediction_scored'").select("series", "lock_id", "actual_id")
    gaps = events.where("event = 'prediction_gap'").select("series", "lock_id", "unpredicted")
    return locked.join(scored, ["series", "lock_id"], "left").join(gaps, ["series", "lock_id"], "left").select(
        "series", "history_count", F.col("threshold").cast("double").alias("threshold"), F.col("detail.baseline_probability").cast("double").alias("probability"),
        "actual_id", "unpredicted",
    )

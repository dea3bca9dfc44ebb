"""Outcome, observation and ledger views over the driver's tables.

Time scales there are days, so callers pass windows in hours. All views are lazy
projections of the given Parquet files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, WindowSpec
from pyspark.sql import functions as F

from tidemark.operators.forecast import frequency_forecast
from tidemark.operators.snapshots import infer_onsets
from tidemark.operators.triggers import rank_onsets
from tidemark.functions import columns as C
from tidemark.plans.ordering import rolling

THRESHOLDS = ("1.5", "20", "50", "200")
HOUR = 3600.0
GROUPS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _value(column: Column) -> Column:
    return column.cast("decimal(18,6)")


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as outcomes, one series per event type."""
    event_id = F.col("event_id")
    ts = F.col("ts")
    late = F.timestamp_micros(C.micros("ts") + (event_id % 7) * 1_000_000)
    nothing = F.lit(None).cast("timestamp")
    return events(spark, sf_dir).where(F.col("value") >= 1).select(
        F.col("event_type").alias("series"),
        event_id.cast("string").alias("outcome_id"),
        _value(F.col("value")).alias("value"),
        ts.alias("ts"),
        late.alias("collection_ts"),
        F.when(event_id % 4 == 0, F.timestamp_micros(C.micros("ts") - 60_000_000)).otherwise(nothing).alias("started_at"),
        F.when(event_id % 8 == 0, F.timestamp_micros(C.micros("ts") - 90_000_000)).otherwise(nothing).alias("pre_observed_at"),
        F.when(event_id % 8 == 0, F.lit('{"phase":"open"}')).otherwise("{}").alias("pre_data"),
        F.col("props").alias("post_data"),
        F.lit("{}").alias("raw_data"),
    )


def order_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as outcomes: many ties in time, larger runs."""
    rows = table(spark, sf_dir, "orders")
    return rows.select(
        F.col("o_orderpriority").alias("series"),
        F.col("o_orderkey").cast("string").alias("outcome_id"),
        _value(F.col("o_totalprice")).alias("value"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
    )


def _series(grouped: bool) -> Column:
    user = F.col("user_id")
    return (user % GROUPS if grouped else user).cast("string")


def user_outcomes(spark: SparkSession, sf_dir: str, grouped: bool = False) -> DataFrame:
    """Purchases as outcomes, one series per user (or per group of users)."""
    rows = events(spark, sf_dir).where((F.col("event_type") == "purchase") & (F.col("value") >= 1))
    return rows.select(
        _series(grouped).alias("series"),
        F.col("event_id").cast("string").alias("outcome_id"),
        _value(F.col("value")).alias("value"),
        "ts",
    )


def small_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases whose value is 1..5, so that fields can equal them."""
    rows = events(spark, sf_dir).where((F.col("event_type") == "purchase") & (F.col("value") >= 1))
    return rows.select(
        F.col("user_id").cast("string").alias("series"),
        F.col("event_id").cast("string").alias("outcome_id"),
        (_k() % 5 + 1).cast("decimal(18,6)").alias("value"),
        "ts",
    )


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def observations(spark: SparkSession, sf_dir: str, grouped: bool = False) -> DataFrame:
    """Clicks, views and errors as frames and messages."""
    event_id, kind = F.col("event_id"), F.col("event_type")
    rows = events(spark, sf_dir).where(kind.isin("click", "view", "error"))
    sent = kind == "click"
    binary = event_id % 2 == 0
    size = F.octet_length("props") * (F.floor(F.col("value") / 20) + 1)

    def bucket(value: Column) -> Column:
        return F.when(binary & (event_id % 22 != 0), value)

    number = F.struct(
        F.lit("data.multiplier").alias("path"), F.lit("numeric").alias("kind"),
        (_k() % 5 + 1).cast("double").alias("value"), F.lit(None).cast("string").alias("sha256_24"),
        F.lit(None).cast("int").alias("length"),
    )
    digest = F.struct(
        F.lit("data.roundid").alias("path"), F.lit("identifier_hash").alias("kind"),
        F.lit(None).cast("double").alias("value"),
        F.substring(F.sha2((event_id % 50).cast("string"), 256), 1, 24).alias("sha256_24"),
        F.lit(2).alias("length"),
    )
    words = F.array(
        F.struct(F.lit("state").alias("path"), kind.alias("value")),
        F.struct(F.lit("phase").alias("path"), F.concat(F.lit("p"), (event_id % 4).cast("string")).alias("value")),
    )
    shape = F.array(
        F.struct(F.lit("k").alias("path"), F.lit("number").alias("type")),
        F.struct(F.concat(F.lit("status."), kind).alias("path"), F.lit("string").alias("type")),
    )
    return rows.select(
        _series(grouped).alias("series"),
        event_id.cast("string").alias("obs_id"),
        "ts",
        F.when(sent, "cdp_websocket_sent").otherwise("cdp_websocket_received").alias("kind"),
        F.concat(F.lit("feed/"), (event_id % 3).cast("string")).alias("url"),
        F.concat(F.lit("s"), (event_id % 3).cast("string")).alias("socket"),
        F.when(sent, "sent").otherwise("received").alias("direction"),
        F.when(binary, 2).otherwise(1).alias("opcode"),
        F.when(event_id % 5 == 0, 200).alias("status"),
        size.cast("bigint").alias("payload_bytes"),
        F.when(binary, "binary").otherwise("json").alias("payload_format"),
        F.sha2("props", 256).alias("payload_sha256"),
        bucket(F.lit(4.0) + (event_id % 4).cast("double") / 4).alias("entropy"),
        bucket(F.lit(0.25)).alias("printable_ratio"),
        bucket((event_id % 3).cast("double") * 0.25).alias("zero_ratio"),
        bucket(F.lit(0.5)).alias("high_bit_ratio"),
        bucket(F.lit(128)).cast("int").alias("unique_byte_bucket"),
        F.when(~binary, shape).alias("shape"),
        F.when(~binary, F.array(number, digest)).alias("fields"),
        F.when(~binary, words).alias("categories"),
    )


def readings(spark: SparkSession, sf_dir: str, grouped: bool = False) -> DataFrame:
    """Signups as live readings."""
    rows = events(spark, sf_dir).where(F.col("event_type") == "signup")
    return rows.select(
        _series(grouped).alias("series"), "ts", F.col("event_id").cast("string").alias("snap_id"),
        _value(F.col("value")).alias("value"),
    )


def onsets(spark: SparkSession, sf_dir: str, grouped: bool = False) -> DataFrame:
    """First signup with a value up to 300 in each purchase interval."""
    completed = user_outcomes(spark, sf_dir, grouped)
    return infer_onsets(completed, readings(spark, sf_dir, grouped), max_value="300")


def later_onsets(found: DataFrame) -> DataFrame:
    return rank_onsets(found, 0.55).where(~F.col("discovery"))


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups as markers with two event names, on the series of user groups."""
    rows = events(spark, sf_dir).where(F.col("event_type") == "signup")
    name = F.when(F.col("event_id") % 2 == 0, "start").otherwise("finish")
    return rows.select(
        _series(True).alias("series"), "ts", F.col("event_id").cast("string").alias("marker_id"),
        name.alias("event"),
    )


def strips(spark: SparkSession, sf_dir: str, shown: int = 8) -> DataFrame:
    """At each outcome, a strip of the last values (newest left) and one live reading."""
    text = F.col("value").cast("decimal(18,2)").cast("string")

    def item(value: Column, x: Column | int, y: int, w: int, h: int) -> Column:
        lit = lambda v: (F.lit(v) if isinstance(v, int) else v).cast("int")
        return F.struct(
            value.alias("multiplier"), lit(x).alias("x_bucket"), lit(y).alias("y_bucket"),
            lit(w).alias("width_bucket"), lit(h).alias("height_bucket"),
        )

    def columns(w: WindowSpec) -> dict[str, Column]:
        chips = [text, *[F.lag(text, i).over(w) for i in range(1, shown)]]
        return {"chips": F.array_compact(F.array(*chips))}

    rows = rolling(outcomes(spark, sf_dir), ["series"], ["ts", "outcome_id"], shown, columns)
    placed = F.transform("chips", lambda v, i: item(v, i * 50, 50, 40, 20))
    live = item(F.lit("1.03"), 0, 700, 120, 50)
    return rows.select(
        "series", "ts", F.col("outcome_id").alias("snap_id"), F.lit("page").alias("url"),
        F.lit(1).alias("canvas_count"), F.concat(placed, F.array(live)).alias("candidates"),
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forecast ledger: every ready forecast locked, then invalidated, scored or left open."""
    rows = frequency_forecast(outcomes(spark, sf_dir), THRESHOLDS).where(F.col("status") == "READY")
    event_id = F.col("outcome_id").cast("bigint")
    text = F.col("threshold").cast("double").cast("string")
    shown = F.col("probability").cast("decimal(7,6)").cast("string")
    raw = C.ratio(F.col("hits") + 1, F.col("sample_count") + 2).cast("decimal(7,6)").cast("string")
    detail = F.struct(
        F.when(event_id % 3 == 0, "gated_logistic_challenger").otherwise("historical_baseline").alias("source"),
        F.lit("chronological_gate").alias("reason"),
        shown.alias("baseline_probability"),
        F.when(event_id % 5 != 0, raw).alias("raw_candidate_probability"),
    )
    chosen = F.when((event_id % 3 == 0) & (event_id % 5 != 0), raw).otherwise(shown)
    locks = rows.groupBy("series", "outcome_id", "value").agg(
        F.map_from_entries(F.collect_list(F.struct(text, chosen))).alias("threshold_probabilities"),
        F.map_from_entries(F.collect_list(F.struct(text, detail))).alias("threshold_model_details"),
        F.max("sample_count").alias("history_count"),
    )
    lock_id = F.concat(F.lit("lock-"), F.col("outcome_id"))
    kinds = F.explode(
        F.array_compact(
            F.array(
                F.lit("prediction_locked"),
                F.when(event_id % 17 == 0, "prediction_invalidated"),
                F.when(event_id % 97 != 0, "prediction_scored"),
                F.when(event_id % 23 == 0, "prediction_gap"),
                F.when(event_id % 100 == 0, "prediction_armed"),
            )
        )
    )
    line = locks.withColumn("event", kinds)
    step = (
        F.when(F.col("event") == "prediction_locked", 0)
        .when(F.col("event") == "prediction_invalidated", 1)
        .when(F.col("event") == "prediction_scored", 2)
        .when(F.col("event") == "prediction_gap", 3)
        .otherwise(4)
    )
    is_lock = F.col("event") == "prediction_locked"
    has_lock = F.col("event").isin("prediction_locked", "prediction_invalidated", "prediction_scored")
    scored = F.col("event") == "prediction_scored"
    return line.select(
        "series",
        (event_id * 5 + step).alias("seq"),
        "event",
        F.lit(1).alias("ledger_version"),
        F.when(has_lock, lock_id).alias("lock_id"),
        F.concat(F.lit("session-"), (event_id % 3).cast("string")).alias("collector_session_id"),
        F.when(is_lock | (F.col("event") == "prediction_armed"), F.col("history_count")).alias("history_count"),
        F.when(scored, F.col("value").cast("string")).alias("actual_multiplier"),
        F.when(F.col("event") == "prediction_gap", event_id % 3 + 1).alias("unpredicted_rounds"),
        F.when(is_lock, F.lit("100.00")).alias("predicted_multiplier"),
        F.when(is_lock, F.struct(F.lit("50").alias("lower"), F.lit("150").alias("upper"))).alias("prediction_interval"),
        F.when(is_lock, F.col("threshold_probabilities")).alias("threshold_probabilities"),
        F.when(is_lock, F.col("threshold_model_details")).alias("threshold_model_details"),
        F.lit(None).cast("string").alias("locked_at"),
        F.lit(None).cast("string").alias("armed_at"),
        F.lit(None).cast("string").alias("history_last_round_id"),
        F.lit(None).cast("string").alias("history_last_timestamp"),
    )


def documents_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as nested JSON messages, for the sanitisers."""
    rows = events(spark, sf_dir)
    value = F.col("value").cast("decimal(18,2)").cast("string")
    text = F.concat(
        F.lit('{"type":"'), F.col("event_type"),
        F.lit('","data":{"multiplier":"'), value,
        F.lit('x","round-id":'), F.col("event_id").cast("string"),
        F.lit(',"items":['), F.col("props"), F.lit(",{}"), F.lit(']},"sessionToken":"t","user":'),
        F.col("user_id").cast("string"), F.lit("}"),
    )
    return rows.select(
        F.col("event_type").alias("series"), F.col("event_id").alias("doc_id"), text.alias("text")
    )


def documents_of_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each event, of one of six shapes: mixed lists, depth 21, root lists, broken."""
    event_id = F.col("event_id")
    deep = '{"d":' * 20 + '{"multiplier":"2.5x"}' + "}" * 20
    shapes = [
        '{"k":1}', '{"a":[{"b":1},{"c":"x"},2,[true]]}', deep, '[{"z":null},{"session-id":1,"state":"OPEN"}]',
        '{"k":', '{"user":{"Access-Token":"x"},"note":"password"}',
    ]
    text = F.element_at(F.array(*[F.lit(x) for x in shapes]), (event_id % 6 + 1).cast("int"))
    return events(spark, sf_dir).select(F.col("event_type").alias("series"), event_id.alias("doc_id"), text.alias("text"))

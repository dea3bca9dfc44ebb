"""Append-only forecast ledgers: reading with a version check, appending, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.schemas import FORECAST_LEDGER, LEDGER_VERSION, SNAPSHOT_LEDGER, STREAM_LEDGER
from tidemark.sources.times import utc_text


def _streamed() -> dict[str, Column]:
    """What the columns of both ledgers are in the rows that streams write."""
    at = utc_text(F.timestamp_micros("us"))

    def of(word: str, value: Column) -> Column:
        return F.when(F.col("event").endswith(word), value)

    def detail(_: Column, p: Column) -> Column:
        nothing = F.lit(None).cast("string")
        return F.struct(
            F.lit("historical_baseline").alias("source"), nothing.alias("reason"),
            p.alias("baseline_probability"), nothing.alias("raw_candidate_probability"),
        )

    kept = ("source", "reason", "baseline_probability", "raw_candidate_probability")
    told = F.transform_values("details", lambda _, d: F.struct(*[d[n].alias(n) for n in kept]))
    reference, actual = F.col("reference_id"), F.col("actual_id")
    known = F.col("event").endswith("locked") | F.col("event").endswith("armed")
    return {
        "locked_at": of("locked", at),
        "scored_at": of("scored", at),
        "armed_at": of("armed", at),
        "invalidated_at": of("invalidated", at),
        "observed_at": F.when(F.col("us").isNotNull(), at),
        "history_last_round_id": F.when(known, reference),
        "previous_round_id": of("snapshot_locked", reference),
        "actual_round_id": of("scored", actual),
        "actual_timestamp": of("scored", at),
        "actual_multiplier": F.col("actual_value"),
        "after_lock_id": of("gap", F.col("lock_id")),
        "unpredicted_rounds": of("gap", F.col("unpredicted")),
        "first_unpredicted_round_id": of("gap", reference),
        "last_unpredicted_round_id": of("gap", actual),
        "threshold_probabilities": of("prediction_locked", F.col("probabilities")),
        "threshold_model_details": of("prediction_locked", F.coalesce(told, F.transform_values("probabilities", detail))),
        "predicted_multiplier": of("prediction_locked", F.col("predicted")),
        "prediction_interval": of("prediction_locked", F.col("interval")),
        "snapshot_id": F.col("lock_id"),
        "trigger_age_after_previous_seconds": F.col("trigger_age_seconds"),
        "historical_rounds": of("snapshot_locked", F.col("history_count")),
        "forecast": of(
            "snapshot_locked",
            F.struct(
                "historical_probabilities", "probabilities", "candidate_probabilities",
                F.lit(False).alias("prior_reconstructed_for_audit"),
            ),
        ),
    }


def read_ledger(spark: SparkSession, paths: str | list[str], schema: str = FORECAST_LEDGER) -> DataFrame:
    """Ledger rows; a line of another version, or no JSON object, fails the read.

    Lines that streams have written are read as well: what their columns say goes to the
    columns of ``schema`` that are null.
    """
    wanted, streamed = T._parse_datatype_string(schema), T._parse_datatype_string(STREAM_LEDGER)
    # A struct may be an object or a text that holds it, so it is read as text first.
    read = {f.name: f.dataType for f in [*streamed.fields, *wanted.fields]}
    read |= {"features": T.StringType()}
    lines = spark.read.schema(T.StructType([T.StructField(n, t) for n, t in read.items()])).json(paths, mode="FAILFAST")
    found = _streamed()
    columns = []
    for field in wanted.fields:
        value = F.col(field.name)
        if field.name == "features":
            value = F.from_json(value, field.dataType, {"mode": "FAILFAST"})
        elif field.name in found:
            value = F.coalesce(value, found[field.name].cast(field.dataType))
        columns.append(value.alias(field.name))
    supported = F.coalesce(F.col("ledger_version") == LEDGER_VERSION, F.lit(False))
    guard = F.assert_true(supported, "Ledger version is unsupported.")
    return lines.where(guard.isNull()).select(*columns)


def read_snapshot_ledger(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return read_ledger(spark, paths, SNAPSHOT_LEDGER)


def stamp_version(events: DataFrame) -> DataFrame:
    """Ledger rows with the current version and columns in name order."""
    stamped = events.withColumn("ledger_version", F.lit(LEDGER_VERSION))
    return stamped.select(*sorted(stamped.columns))


def append_ledger(events: DataFrame, path: str) -> None:
    """Append events as JSON lines with sorted keys; earlier lines are never rewritten.

    Rows keep their ``(series, seq)`` order key, so file layout does not matter.
    """
    stamp_version(events).write.mode("append").json(path)


def write_report(report: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write a report table as JSON; an existing report is refused by default."""
    mode = "overwrite" if overwrite else "errorifexists"
    report.write.mode(mode).option("ignoreNullFields", "false").json(path)

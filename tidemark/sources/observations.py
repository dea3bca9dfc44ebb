"""Reading observations, snapshots and markers from JSON lines (batch or stream)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schemas import MARKER_LINE, OBSERVATION_LINE, SNAPSHOT_LINE
from tidemark.sources.times import instant

# Kinds of lines.
FRAME_KINDS = ["cdp_websocket_received", "cdp_websocket_sent"]
LIVE_KINDS = [
    "websocket_received", "websocket_sent", "cdp_websocket_received",
    "cdp_websocket_sent", "cdp_eventsource_received",
]
SERVER_KINDS = [
    "cdp_websocket_received", "websocket_received", "cdp_eventsource_received", "response",
]
DISCLOSURE_KINDS = ["cdp_websocket_received", "websocket_received", "response"]
SNAPSHOT_KIND = "dom_multiplier_snapshot"
MARKER_KIND = "visual_marker"


def read_lines(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """JSON lines with a fixed schema; a malformed line gives a row of nulls."""
    return spark.read.schema(schema).json(paths, mode="PERMISSIVE")


def _series() -> Column:
    return F.coalesce(F.col("series"), F.lit("default"))


def flat_observations(lines: DataFrame) -> DataFrame:
    """Project nested observation lines to flat observations.

    Direction comes from the kind; the socket falls back to the URL, then to
    ``unknown``. ``obs_id`` is derived from the contents so that ties in time have
    an order that does not depend on how files were split.
    """
    direction = F.when(F.col("kind").endswith("received"), "received").when(
        F.col("kind").endswith("sent"), "sent"
    )
    fingerprint = "payload.binary_fingerprint."
    return lines.select(
        _series().alias("series"),
        F.sha2(
            F.to_json(F.struct("observed_at", "kind", "socket_id", "url", "payload")), 256
        ).alias("obs_id"),
        instant(F.col("observed_at")).alias("ts"),
        "observed_at",
        "kind",
        "url",
        F.coalesce("socket_id", "url", F.lit("unknown")).alias("socket"),
        direction.alias("direction"),
        "opcode",
        "status",
        F.col("payload.bytes").alias("payload_bytes"),
        F.col("payload.format").alias("payload_format"),
        F.col("payload.sha256").alias("payload_sha256"),
        F.col(fingerprint + "entropy_bucket").alias("entropy"),
        F.col(fingerprint + "printable_ratio_bucket").alias("printable_ratio"),
        F.col(fingerprint + "zero_ratio_bucket").alias("zero_ratio"),
        F.col(fingerprint + "high_bit_ratio_bucket").alias("high_bit_ratio"),
        F.col(fingerprint + "unique_byte_bucket").alias("unique_byte_bucket"),
        F.col("payload.shape").alias("shape"),
        F.col("payload.game_fields").alias("fields"),
        F.col("payload.categorical_fields").alias("categories"),
    )


def frames(observations: DataFrame) -> DataFrame:
    """Usable frames: a frame kind, a time, a size and a format; replays removed."""
    usable = observations.where(
        F.col("kind").isin(FRAME_KINDS)
        & F.col("ts").isNotNull()
        & (F.col("payload_bytes") >= 0)
        & F.col("payload_format").isNotNull()
    )
    return usable.dropDuplicates(
        ["series", "ts", "kind", "socket", "payload_bytes", "payload_sha256"]
    )


def read_observations(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return frames(flat_observations(read_lines(spark, paths, OBSERVATION_LINE)))


def field_observations(
    observations: DataFrame, strict: bool = False, first_fields: int | None = None
) -> DataFrame:
    """One row per allow-listed field of an observation.

    The loose form takes every observation kind; replays are equal in time, kind,
    URL, payload and field. The strict form takes server messages; replays are equal
    in time, field, value and URL. ``first_fields`` takes only so many of each message.
    """
    timed = observations.where(F.col("ts").isNotNull() & F.col("fields").isNotNull())
    if strict:
        timed = timed.where(F.col("kind").isin(SERVER_KINDS))
    missing = F.lit("" if strict else "unknown")
    rows = timed.select(
        "series",
        "ts",
        "obs_id",
        F.coalesce("kind", F.lit("unknown")).alias("obs_kind"),
        F.coalesce("url", missing).alias("url"),
        F.coalesce("payload_sha256", F.lit("")).alias("payload_sha256"),
        F.posexplode("fields").alias("field_no", "field"),
    ).where(F.col("field.path").isNotNull() & F.col("field.kind").isNotNull())
    numeric = F.when(F.col("field.kind") == "numeric", F.col("field.value"))
    digest = F.when(F.col("field.kind") == "identifier_hash", F.col("field.sha256_24"))
    rows = rows.select(
        "*",
        F.col("field.path").alias("path"),
        F.col("field.kind").alias("field_kind"),
        numeric.alias("number"),
        digest.alias("identifier"),
    ).where(F.col("number").isNotNull() | F.col("identifier").isNotNull())
    if first_fields is not None:
        rows = rows.where(F.col("field_no") < first_fields)
    same = ["series", "ts", "path", "field_kind", "number", "identifier", "url"]
    if not strict:
        same += ["obs_kind", "payload_sha256"]
    return rows.drop("field").dropDuplicates(same)


def protocol_events(observations: DataFrame) -> DataFrame:
    """Server JSON messages that carry fields or categories, once each."""
    fields = F.filter(F.coalesce("fields", F.array()), lambda x: x.isNotNull())
    categories = F.filter(F.coalesce("categories", F.array()), lambda x: x.isNotNull())
    return (
        observations.where(
            F.col("kind").isin(DISCLOSURE_KINDS)
            & F.col("ts").isNotNull()
            & (F.col("payload_format") == "json")
        )
        .withColumns(
            {
                "url": F.coalesce("url", F.lit("")),
                "payload_sha256": F.coalesce("payload_sha256", F.lit("")),
                "fields": fields,
                "categories": categories,
            }
        )
        .dropDuplicates(["series", "ts", "kind", "url", "payload_sha256"])
        .where((F.size("fields") > 0) | (F.size("categories") > 0))
    )


def recent_observations(observations: DataFrame, limit: int = 20) -> DataFrame:
    """The last ``limit`` observations, newest first."""
    return observations.orderBy(F.desc("ts"), F.desc("obs_id")).limit(limit)


def read_snapshots(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    lines = read_lines(spark, paths, SNAPSHOT_LINE)
    return lines.where(F.col("kind") == SNAPSHOT_KIND).select(
        _series().alias("series"),
        instant(F.col("observed_at")).alias("ts"),
        "observed_at",
        F.sha2(F.to_json(F.struct(*lines.columns)), 256).alias("snap_id"),
        "url",
        "canvas_count",
        "candidates",
    ).where(F.col("ts").isNotNull())


def read_markers(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    lines = read_lines(spark, paths, MARKER_LINE)
    return lines.where(
        (F.col("kind") == MARKER_KIND) & F.col("event").isNotNull()
    ).select(
        _series().alias("series"),
        instant(F.col("observed_at")).alias("ts"),
        F.sha2(F.to_json(F.struct(*lines.columns)), 256).alias("marker_id"),
        "event",
        "multiplier",
    ).where(F.col("ts").isNotNull())

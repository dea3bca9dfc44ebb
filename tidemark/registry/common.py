"""Shared pieces of the query registry: published types, oracle sub-queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def publish(df: DataFrame) -> DataFrame:
    """Types that compare across engines: zone-free timestamps, doubles for decimals."""
    out = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.TimestampType):
            column = column.cast("timestamp_ntz")
        elif isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        out.append(column.alias(field.name))
    return df.select(*out)


def six(name: str) -> Column:
    return F.bround(F.col(name).cast("double"), 6).alias(name)


def elements(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """One row per element of a vector, rounded to 6 places."""
    flat = df.select(*keys, F.posexplode(name).alias("feature", "x"))
    return flat.select(*keys, "feature", (F.bround("x", 6) + 0.0).alias("x"))


THRESHOLD_ROWS = "th(threshold) AS (VALUES (1.5), (20.0), (50.0), (200.0))"

OUTCOMES = """
outcomes AS (
  SELECT event_type AS series, event_id, CAST(event_id AS VARCHAR) AS outcome_id,
         CAST(value AS DECIMAL(18,6)) AS value, ts,
         ts + INTERVAL 1 SECOND * (event_id % 7) AS collection_ts,
         CASE WHEN event_id % 4 = 0 THEN ts - INTERVAL 60 SECOND END AS started_at,
         CASE WHEN event_id % 8 = 0 THEN ts - INTERVAL 90 SECOND END AS pre_observed_at,
         CASE WHEN event_id % 8 = 0 THEN '{"phase":"open"}' ELSE '{}' END AS pre_data,
         props AS post_data, '{}' AS raw_data
  FROM events WHERE value >= 1)"""


def users(grouped: bool = False) -> str:
    series = "user_id % 5" if grouped else "user_id"
    return f"""
user_outcomes AS (
  SELECT CAST({series} AS VARCHAR) AS series, event_id, CAST(event_id AS VARCHAR) AS outcome_id,
         CAST(value AS DECIMAL(18,6)) AS value, ts,
         CAST(json_extract(props, '$.k') AS INTEGER) % 5 + 1 AS small_value
  FROM events WHERE event_type = 'purchase' AND value >= 1),
pairs AS (
  SELECT * FROM (
    SELECT series, outcome_id AS target_id, ts AS target_ts, value AS target_value,
           small_value AS target_small,
           lag(ts) OVER w AS prev_ts, lag(value) OVER w AS prev_value,
           lag(small_value) OVER w AS prev_small,
           row_number() OVER w - 1 AS target_index
    FROM user_outcomes WINDOW w AS (PARTITION BY series ORDER BY ts, outcome_id))
  WHERE prev_ts < target_ts)"""


def observed(grouped: bool = False) -> str:
    series = "user_id % 5" if grouped else "user_id"
    return f"""
obs AS (
  SELECT *, CASE WHEN payload_bytes < 64 THEN '<64' WHEN payload_bytes < 128 THEN '64-127'
                 WHEN payload_bytes < 256 THEN '128-255' WHEN payload_bytes < 512 THEN '256-511'
                 WHEN payload_bytes < 1024 THEN '512-1023' WHEN payload_bytes < 2048 THEN '1024-2047'
                 ELSE '2048+' END AS band
  FROM (
    SELECT CAST({series} AS VARCHAR) AS series, event_id, CAST(event_id AS VARCHAR) AS obs_id, ts,
           event_type,
           CASE WHEN event_type = 'click' THEN 'cdp_websocket_sent' ELSE 'cdp_websocket_received' END AS kind,
           'feed/' || (event_id % 3) AS url, 's' || (event_id % 3) AS socket,
           CASE WHEN event_type = 'click' THEN 'sent' ELSE 'received' END AS direction,
           CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END AS opcode,
           CASE WHEN event_id % 5 = 0 THEN 200 END AS status,
           CAST(octet_length(encode(props)) * (floor(value / 20) + 1) AS BIGINT) AS payload_bytes,
           CASE WHEN event_id % 2 = 0 THEN 'binary' ELSE 'json' END AS payload_format,
           CASE WHEN event_id % 2 = 0 AND event_id % 22 <> 0 THEN 4.0 + (event_id % 4) / 4.0 END AS entropy,
           CASE WHEN event_id % 2 = 0 AND event_id % 22 <> 0 THEN (event_id % 3) * 0.25 END AS zero_ratio,
           CASE WHEN event_id % 2 = 0 AND event_id % 22 <> 0 THEN 0.5 END AS high_bit_ratio,
           CASE WHEN event_id % 2 = 0 AND event_id % 22 <> 0 THEN 128 END AS unique_byte_bucket,
           CAST(json_extract(props, '$.k') AS INTEGER) % 5 + 1 AS number,
           substr(sha256(CAST(event_id % 50 AS VARCHAR)), 1, 24) AS identifier
    FROM events WHERE event_type IN ('click', 'view', 'error'))),
signed AS (
  SELECT *, direction || ':' || payload_format || ':' || band || CASE WHEN payload_format = 'binary' THEN
      '|e=' || coalesce(format('{{:g}}', entropy), 'na') || '|z=' || coalesce(format('{{:g}}', zero_ratio), 'na')
      || '|h=' || coalesce(format('{{:g}}', high_bit_ratio), 'na') || '|u=' || coalesce(CAST(unique_byte_bucket AS VARCHAR), 'na')
    ELSE '' END AS signature
  FROM obs)"""


def onsets(grouped: bool = False) -> str:
    series = "user_id % 5" if grouped else "user_id"
    return f"""
readings AS (
  SELECT CAST({series} AS VARCHAR) AS series, ts, CAST(value AS DECIMAL(18,6)) AS value
  FROM events WHERE event_type = 'signup' AND value <= 300),
onsets AS (
  SELECT p.series, p.prev_ts, p.target_ts, any_value(p.target_value) AS target_value,
         any_value(p.prev_value) AS prev_value, any_value(p.target_small) AS target_small,
         any_value(p.prev_small) AS prev_small, any_value(p.target_index) AS target_index,
         any_value(p.target_id) AS target_id,
         min(r.ts) AS onset_ts, min_by(r.value, r.ts) AS onset_value
  FROM pairs p JOIN readings r ON r.series = p.series
    AND r.ts >= p.prev_ts + INTERVAL 750 MILLISECOND AND r.ts <= p.target_ts - INTERVAL 1 SECOND
  GROUP BY p.series, p.prev_ts, p.target_ts)"""


FREQUENCY = f"""
{OUTCOMES},
{THRESHOLD_ROWS},
prefix AS (
  SELECT o.series, o.outcome_id, o.event_id, o.ts, o.value, th.threshold,
         count(*) OVER w AS n,
         coalesce(sum(CASE WHEN o.value >= th.threshold THEN 1 ELSE 0 END) OVER w, 0) AS hits,
         CASE WHEN o.value >= th.threshold THEN 1 ELSE 0 END AS actual
  FROM outcomes o, th
  WINDOW w AS (PARTITION BY o.series, th.threshold ORDER BY o.ts, o.outcome_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
forecast AS (
  SELECT *, CASE WHEN n >= 50 THEN round_even(hits / n, 6) END AS probability FROM prefix)"""

US = "epoch_us"

"""Observations: reading, profiling, markers, snapshots and onsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import profile, snapshots
from tidemark.registry.common import OUTCOMES, observed, onsets, users
from tidemark.sources import driver_tables as D
from tidemark.sources import observations as S
from tidemark.sources import outcomes as O

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


OBS, OBS_G = observed(), observed(True)


@query(
    "read_observations",
    f"WITH {OBS} SELECT series, obs_id, socket, direction, payload_bytes, payload_format, entropy::DOUBLE AS entropy FROM obs",
)
def _(spark, sf_dir):
    rows = D.observations(spark, sf_dir)
    again = S.frames(rows.unionByName(rows))
    return again.select("series", "obs_id", "socket", "direction", "payload_bytes", "payload_format", "entropy")


@query(
    "read_field_observations",
    f"""WITH {OBS} SELECT series, obs_id, 'data.multiplier' AS path, number::DOUBLE AS number, NULL::VARCHAR AS identifier
    FROM obs WHERE payload_format = 'json'
    UNION ALL SELECT series, obs_id, 'data.roundid', NULL, identifier FROM obs WHERE payload_format = 'json'""",
)
def _(spark, sf_dir):
    rows = D.observations(spark, sf_dir)
    return S.field_observations(rows.unionByName(rows)).select("series", "obs_id", "path", "number", "identifier")


@query(
    "read_field_observations_strict",
    f"""WITH {OBS}, server AS (SELECT * FROM obs WHERE payload_format = 'json' AND kind = 'cdp_websocket_received')
    SELECT series, obs_id, 'data.multiplier' AS path, number::DOUBLE AS number, NULL::VARCHAR AS identifier FROM server
    UNION ALL SELECT series, obs_id, 'data.roundid', NULL, identifier FROM server""",
)
def _(spark, sf_dir):
    rows = S.field_observations(D.observations(spark, sf_dir), strict=True)
    return rows.select("series", "obs_id", "path", "number", "identifier")


@query(
    "read_protocol_events",
    f"""WITH {OBS} SELECT series, obs_id, 2 AS fields, 2 AS categories FROM obs
    WHERE payload_format = 'json' AND kind = 'cdp_websocket_received'""",
)
def _(spark, sf_dir):
    rows = S.protocol_events(D.observations(spark, sf_dir))
    return rows.select("series", "obs_id", F.size("fields").alias("fields"), F.size("categories").alias("categories"))


@query(
    "observation_signature",
    f"WITH {OBS} SELECT signature, count(*) AS n FROM signed GROUP BY 1",
)
def _(spark, sf_dir):
    rows = D.observations(spark, sf_dir).select(C.observation_signature().alias("signature"))
    return rows.groupBy("signature").agg(F.count("*").alias("n"))


@query("size_bucket", f"WITH {OBS} SELECT band, count(*) AS n FROM obs GROUP BY band")
def _(spark, sf_dir):
    rows = D.observations(spark, sf_dir).select(C.size_band("payload_bytes").alias("band"))
    return rows.groupBy("band").agg(F.count("*").alias("n"))


@query("recent_observations", f"WITH {OBS} SELECT series, obs_id, ts FROM obs ORDER BY ts DESC, obs_id DESC LIMIT 20")
def _(spark, sf_dir):
    return S.recent_observations(D.observations(spark, sf_dir)).select("series", "obs_id", "ts")


def _pairs(name: str, key: str) -> Column:
    return F.array_join(
        F.transform(
            name, lambda e: F.concat(e[key].cast("string"), F.lit(":"), e["n"].cast("string"))
        ),
        ",",
    ).alias(name)


@query(
    "profile_kinds",
    f"""WITH {OBS}, paths AS (
      SELECT kind, url, path, count(*) AS n FROM (
        SELECT kind, url, unnest(['k', 'status.' || event_type]) AS path FROM obs WHERE payload_format = 'json')
      GROUP BY ALL),
    listed AS (SELECT kind, url, string_agg(path || ':' || n, ',' ORDER BY n DESC, path) AS json_paths,
        string_agg(path || ':' || n, ',' ORDER BY n DESC, path) FILTER (path LIKE 'status%') AS candidate_paths FROM paths GROUP BY ALL)
    SELECT kind, url, count(*) AS events, any_value(json_paths) AS json_paths, any_value(candidate_paths) AS candidate_paths,
      '200.0:' || count(status) AS status_counts
    FROM obs JOIN listed USING (kind, url) GROUP BY ALL""",
)
def _(spark, sf_dir):
    rows = profile.profile_kinds(D.observations(spark, sf_dir))
    return rows.select(
        "kind", "url", "events", _pairs("json_paths", "path"), _pairs("candidate_paths", "path"),
        _pairs("status_counts", "bucket"),
    )


@query(
    "profile_transports",
    f"""WITH {OBS}, paths AS (
      SELECT url, count(DISTINCT event_type) AS found FROM obs WHERE payload_format = 'json' GROUP BY url),
    hist AS (SELECT url, string_agg(entropy::DOUBLE || ':' || n, ',' ORDER BY entropy) AS entropy_buckets FROM
      (SELECT url, entropy, count(*) AS n FROM obs WHERE entropy IS NOT NULL GROUP BY ALL) GROUP BY url)
    SELECT url, count(*) AS events, count(*) FILTER (direction = 'received') AS received_events,
      count(*) FILTER (direction = 'sent') AS sent_events, count(*) FILTER (payload_format = 'json') AS json_events,
      CAST(0 AS BIGINT) AS text_events, count(*) FILTER (payload_format = 'binary') AS binary_events,
      min(payload_bytes) AS min_bytes, max(payload_bytes) AS max_bytes, count(DISTINCT payload_bytes) AS distinct_sizes,
      any_value(entropy_buckets) AS entropy_buckets,
      least(count(*) FILTER (direction = 'received'), 100) + any_value(found) * 25
        + least(count(*) FILTER (payload_format = 'json'), 20) * 2 + least(count(DISTINCT payload_bytes), 20) AS score
    FROM obs JOIN paths USING (url) JOIN hist USING (url) GROUP BY url""",
)
def _(spark, sf_dir):
    rows = profile.profile_transports(D.observations(spark, sf_dir))
    return rows.select(
        "url", "events", "received_events", "sent_events", "json_events", "text_events",
        "binary_events", "min_bytes", "max_bytes", "distinct_sizes",
        _pairs("entropy_buckets", "bucket"), F.col("score").cast("bigint").alias("score"),
    )


@query(
    "frame_classes",
    f"""WITH {OBS}, b AS (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY url, direction, band ORDER BY ts, obs_id)) / 1000.0 AS gap
      FROM obs WHERE payload_format = 'binary'),
    modes AS (SELECT url, direction, band, arg_min(entropy, (-n, entropy)) AS entropy_mode FROM
      (SELECT url, direction, band, entropy, count(*) AS n FROM b WHERE entropy IS NOT NULL GROUP BY ALL) GROUP BY ALL)
    SELECT url, direction, band AS size_band, count(*) AS events, round_even(min(gap), 1) AS min_gap_ms,
      round_even(max(gap), 1) AS max_gap_ms, round_even(quantile_cont(gap, 0.5), 1) AS median_gap_ms,
      CASE WHEN avg(gap) > 0 THEN round_even(greatest(0.0, 1.0 - least(1.0, stddev_pop(gap) / avg(gap))), 3) ELSE 0.0 END AS periodicity_score,
      any_value(entropy_mode)::DOUBLE AS entropy_mode
    FROM b LEFT JOIN modes USING (url, direction, band) GROUP BY url, direction, band""",
)
def _(spark, sf_dir):
    rows = profile.frame_classes(D.observations(spark, sf_dir))
    return rows.select(
        "url", "direction", "size_band", "events", "min_gap_ms", "max_gap_ms", "median_gap_ms",
        "periodicity_score", "entropy_mode",
    )


MARKERS = """
markers AS (SELECT CAST(user_id % 5 AS VARCHAR) AS series, ts, CAST(event_id AS VARCHAR) AS marker_id,
    CASE WHEN event_id % 2 = 0 THEN 'start' ELSE 'finish' END AS event FROM events WHERE event_type = 'signup'),
frames AS (SELECT *, direction || ':' || band AS frame_class FROM obs WHERE payload_format = 'binary'),
near AS (SELECT m.series, m.event, m.marker_id, f.url, f.frame_class, f.signature_strict,
      (epoch_us(f.ts) - epoch_us(m.ts)) AS off, f.ts AS seen
    FROM markers m JOIN (SELECT *, frame_class || '|e=' || format('{:g}', entropy) || '|z=' || format('{:g}', zero_ratio)
        || '|h=' || format('{:g}', high_bit_ratio) || '|u=' || unique_byte_bucket AS signature_strict FROM frames) f
      ON m.series = f.series AND abs(epoch_us(f.ts) - epoch_us(m.ts)) <= 3600000000)"""


@query(
    "marker_correlation",
    f"""WITH {OBS_G}, {MARKERS}, counts AS (SELECT series, event, url, frame_class, count(*) AS nearby_frames FROM near GROUP BY ALL),
    totals AS (SELECT series, event, count(*) AS markers FROM markers GROUP BY ALL)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series, event ORDER BY nearby_frames DESC, url, frame_class)::INTEGER AS rank FROM counts)
    JOIN totals USING (series, event) WHERE rank <= 20""",
)
def _(spark, sf_dir):
    return profile.marker_correlation(D.observations(spark, sf_dir, True), D.markers(spark, sf_dir), D.HOUR)


def _enrichment_sql(column: str, where: str, keep_zero: bool, places: int) -> str:
    return f"""WITH {OBS_G}, {MARKERS},
    per AS (SELECT series, event, marker_id, url, {column} AS c, count(*) AS n, arg_min(off, (abs(off), off)) AS nearest
        FROM near WHERE {column} IS NOT NULL GROUP BY ALL),
    hits AS (SELECT series, event, url, c, count(*) AS hits, CAST(sum(n) AS BIGINT) AS nearby_frames,
        round_even(quantile_cont(nearest / 1000.0, 0.5), 1) AS median_nearest_offset_ms FROM per GROUP BY ALL),
    classed AS (SELECT series, url, ts, {where} AS c FROM frames),
    totals AS (SELECT series, url, c, count(*) AS total FROM classed WHERE c IS NOT NULL GROUP BY ALL),
    spans AS (SELECT series, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 AS duration FROM classed WHERE c IS NOT NULL GROUP BY series),
    ev AS (SELECT series, event, count(*) AS markers FROM markers GROUP BY ALL)
    SELECT event, series, url, c AS class, markers, coalesce(hits, 0) AS hits, round_even(coalesce(hits, 0) / markers, 3) AS hit_rate,
      coalesce(nearby_frames, 0) AS nearby_frames,
      round_even(total / duration * (2.0 * 3600.0) * markers, {places}) AS expected_frames,
      round_even(coalesce(nearby_frames, 0) / (total / duration * (2.0 * 3600.0) * markers), 2) AS enrichment,
      median_nearest_offset_ms
    FROM ev JOIN totals USING (series) JOIN spans USING (series) {'LEFT' if keep_zero else ''} JOIN hits USING (series, event, url, c)
    WHERE total >= {1 if keep_zero else 2}"""


STRICT = """direction || ':' || band || '|e=' || format('{:g}', entropy) || '|z=' || format('{:g}', zero_ratio)
        || '|h=' || format('{:g}', high_bit_ratio) || '|u=' || unique_byte_bucket"""


@query("marker_class_enrichment", _enrichment_sql("frame_class", "frame_class", True, 2))
def _(spark, sf_dir):
    rows = profile.marker_class_enrichment(D.observations(spark, sf_dir, True), D.markers(spark, sf_dir), D.HOUR)
    return rows.withColumnRenamed("frame_class", "class")


@query("marker_signature_enrichment", _enrichment_sql("signature_strict", STRICT, False, 3))
def _(spark, sf_dir):
    rows = profile.marker_signature_enrichment(D.observations(spark, sf_dir, True), D.markers(spark, sf_dir), D.HOUR)
    return rows.withColumnRenamed("signature", "class")


# --- snapshots -----------------------------------------------------------------------------


def _raw_items(spark, sf_dir):
    value = F.col("value").cast("decimal(18,2)").cast("string")
    event_id = F.col("event_id")

    def item(text: Column, x: Column) -> Column:
        return F.struct(
            text.alias("text"), x.cast("double").alias("x"), F.lit(47.0).alias("y"),
            F.lit(44.0).alias("w"), F.lit(18.0).alias("h"),
        )

    return D.events(spark, sf_dir).select(
        "event_id",
        F.array(
            item(F.concat(F.lit(" "), value, F.lit("x")), event_id % 100),
            item(F.concat(value, F.lit(" X")), event_id % 100),
            item(value, event_id % 100),
            item(F.lit("0.50x"), event_id % 100),
            item(F.lit("7x"), event_id % 1000),
        ).alias("items"),
    )


@query(
    "normalise_candidates",
    """WITH c AS (SELECT event_id, CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS shown, CAST(round_even((event_id % 100) / 10.0, 0) * 10 AS INTEGER) AS x,
      CAST(round_even((event_id % 1000) / 10.0, 0) * 10 AS INTEGER) AS x2, value FROM events)
    SELECT event_id, shown AS multiplier, x AS x_bucket FROM c WHERE CAST(shown AS DOUBLE) >= 1
    UNION ALL SELECT event_id, '7' AS multiplier, x2 AS x_bucket FROM c""",
)
def _(spark, sf_dir):
    rows = snapshots.normalise_candidates(_raw_items(spark, sf_dir))
    return rows.select("event_id", F.explode("candidates").alias("c")).select(
        "event_id", "c.multiplier", "c.x_bucket"
    )


@query(
    "suppress_unchanged",
    """WITH k AS (SELECT event_type AS series, CAST(event_id AS VARCHAR) AS snap_id, ts,
      CAST(json_extract(props, '$.k') AS INTEGER) % 3 AS shown FROM events)
    SELECT series, snap_id FROM (SELECT *, lag(shown) OVER (PARTITION BY series ORDER BY ts, snap_id) AS before FROM k)
    WHERE before IS DISTINCT FROM shown""",
)
def _(spark, sf_dir):
    shown = F.get_json_object("props", "$.k").cast("int") % 3
    rows = D.events(spark, sf_dir).select(
        F.col("event_type").alias("series"), F.lit("u").alias("url"), "ts",
        F.col("event_id").cast("string").alias("snap_id"), shown.alias("canvas_count"),
        F.array(shown).alias("candidates"),
    )
    return snapshots.suppress_unchanged(rows).select("series", "snap_id")


STRIPS = f"""{OUTCOMES}, shown AS (
  SELECT series, outcome_id, ts, CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS v FROM outcomes),
strips AS (
  SELECT series, outcome_id, ts, v,
    list(v) OVER (PARTITION BY series ORDER BY ts, outcome_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS oldest_first
  FROM shown),
ranked AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts, outcome_id) AS n FROM strips)"""


@query(
    "strip_row",
    f"""WITH {STRIPS} SELECT series, outcome_id AS snap_id, 50 AS y, array_to_string(list_reverse(oldest_first), ',') AS strip
    FROM ranked WHERE n >= 5""",
)
def _(spark, sf_dir):
    rows = snapshots.strip_row(D.strips(spark, sf_dir))
    return rows.select("series", "snap_id", "y", F.array_join("strip", ",").alias("strip"))


@query(
    "strip_overlap",
    f"""WITH {STRIPS} SELECT series, outcome_id AS snap_id, least(n - 1, 7)::INTEGER AS left_overlap FROM ranked WHERE n >= 6""",
)
def _(spark, sf_dir):
    rows = snapshots.strip_overlap(snapshots.strip_row(D.strips(spark, sf_dir)))
    return rows.where("previous is not null").select("series", "snap_id", "left_overlap")


INSERTED = f"""WITH {STRIPS} SELECT series, outcome_id AS snap_id, ts, v AS value, 'left' AS edge,
    least(n - 1, 7)::INTEGER AS overlap, least(n, 8)::INTEGER AS history_size FROM ranked WHERE n >= 6"""


@query("strip_insertions", INSERTED)
def _(spark, sf_dir):
    rows = snapshots.strip_insertions(D.strips(spark, sf_dir))
    return rows.select("series", "snap_id", "ts", "value", "edge", "overlap", "history_size")


@query(
    "ingest_strip_outcomes",
    f"""WITH {STRIPS} SELECT series, 'strip-' || substr(sha256(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z|' || v || '|left|50'), 1, 24) AS outcome_id,
      v::DOUBLE AS value, ts FROM ranked WHERE n >= 6""",
)
def _(spark, sf_dir):
    rows = O.strip_outcome_records(snapshots.strip_insertions(D.strips(spark, sf_dir)))
    return rows.select("series", "outcome_id", "value", "ts")


@query(
    "live_reading",
    f"""WITH {STRIPS} SELECT series, outcome_id AS snap_id, 1.03::DOUBLE AS value, 1 AS occurrences, 120 AS max_width, 50 AS max_height FROM ranked""",
)
def _(spark, sf_dir):
    rows = snapshots.live_reading(D.strips(spark, sf_dir))
    return rows.select("series", "snap_id", "value", "occurrences", "max_width", "max_height")


@query(
    "completed_boundaries",
    f"""WITH {STRIPS} SELECT series, ts, v::DOUBLE AS value FROM ranked WHERE n >= 6 AND v::DOUBLE BETWEEN 1 AND 1000""",
)
def _(spark, sf_dir):
    seen = snapshots.strip_insertions(D.strips(spark, sf_dir))
    return snapshots.completed_boundaries(seen.unionByName(seen)).select("series", "ts", "value")


@query(
    "infer_onsets",
    f"""WITH {users()}, {onsets()} SELECT series, prev_ts, target_ts, onset_ts, onset_value::DOUBLE AS onset_value,
      (epoch_us(onset_ts) - epoch_us(prev_ts)) / 1e6 AS seconds_after_previous,
      (epoch_us(target_ts) - epoch_us(onset_ts)) / 1e6 AS seconds_before_target FROM onsets""",
)
def _(spark, sf_dir):
    rows = D.onsets(spark, sf_dir)
    return rows.select(
        "series", "prev_ts", "target_ts", "onset_ts", "onset_value", "seconds_after_previous",
        "seconds_before_target",
    )

"""Joins in time, point-in-time features, triggers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import features, temporal, triggers
from tidemark.plans.lineage import settle
from tidemark.registry.common import FREQUENCY, OUTCOMES, elements, observed, onsets, six, users
from tidemark.sources import driver_tables as D

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


OBS, USERS, ONSETS = observed(), users(), onsets()
OBS_G, USERS_G, ONSETS_G = observed(True), users(True), onsets(True)
HOURS = (2 * D.HOUR, 8 * D.HOUR)
LONG_HOURS = (3 * D.HOUR, 24 * D.HOUR)
HOUR_US = 3_600_000_000


# --- joins ---------------------------------------------------------------------------------


@query(
    "assign_interval",
    f"""WITH {OBS}, {USERS} SELECT o.series, o.obs_id, o.ts, p.prev_ts, p.target_ts, p.target_id
    FROM obs o JOIN pairs p ON o.series = p.series AND o.ts > p.prev_ts AND o.ts <= p.target_ts""",
)
def _(spark, sf_dir):
    rows = temporal.assign_interval(D.user_outcomes(spark, sf_dir), D.observations(spark, sf_dir).select("series", "ts", "obs_id"))
    return rows.select("series", "obs_id", "ts", "prev_ts", "target_ts", "target_id")


@query(
    "trailing_window_join",
    f"""WITH {OBS}, {USERS} SELECT u.series, u.outcome_id, u.ts, count(o.obs_id) AS observations,
      CAST(coalesce(sum(o.payload_bytes), 0) AS BIGINT) AS bytes
    FROM user_outcomes u LEFT JOIN obs o ON o.series = u.series AND o.ts > u.ts - INTERVAL 6 HOUR AND o.ts <= u.ts
    GROUP BY ALL""",
)
def _(spark, sf_dir):
    return temporal.trailing_window_join(
        D.user_outcomes(spark, sf_dir), D.observations(spark, sf_dir), 6 * D.HOUR,
        {"bytes": F.col("payload_bytes")},
    )


@query(
    "onset_lookup",
    f"WITH {USERS}, {ONSETS} SELECT series, target_id, target_index, prev_ts, target_ts, onset_ts FROM onsets",
)
def _(spark, sf_dir):
    pairs = temporal.outcome_pairs(D.user_outcomes(spark, sf_dir))
    rows = temporal.onset_lookup(pairs, D.onsets(spark, sf_dir))
    return rows.select("series", "target_id", "target_index", "prev_ts", "target_ts", "onset_ts")


@query(
    "first_match_in_interval",
    f"""WITH {OBS}, {USERS} SELECT p.series, p.target_id, min(o.ts) AS ts, arg_min(o.obs_id, o.ts) AS obs_id
    FROM obs o JOIN pairs p ON o.series = p.series AND o.ts > p.prev_ts AND o.ts <= p.target_ts
    WHERE o.direction = 'sent' GROUP BY ALL""",
)
def _(spark, sf_dir):
    obs = D.observations(spark, sf_dir).select("series", "ts", "obs_id", "direction")
    rows = temporal.first_match_in_interval(
        D.user_outcomes(spark, sf_dir), obs, F.col("direction") == "sent"
    )
    return rows.select("series", "target_id", "ts", "obs_id")


@query(
    "history_as_of_all",
    f"""WITH {FREQUENCY} SELECT series, outcome_id, threshold::DOUBLE AS threshold, n + 1 AS n,
    CAST(hits + actual AS BIGINT) AS hits FROM forecast""",
)
def _(spark, sf_dir):
    rows = D.outcomes(spark, sf_dir)
    out = temporal.history_as_of(rows.select("series", "outcome_id"), rows, D.THRESHOLDS).select("series", "outcome_id", "n", F.explode("counts").alias("c"))
    return out.select("series", "outcome_id", F.col("c.threshold").cast("double").alias("threshold"), "n", "c.hits")


# --- features --------------------------------------------------------------------------------

LOGS = f"""{OUTCOMES}, logs AS (SELECT *, ln(least(value::DOUBLE, 1000.0)) AS x,
    row_number() OVER (PARTITION BY series ORDER BY ts, outcome_id) - 1 AS pos FROM outcomes)"""


def _frame(n: int) -> str:
    return f"OVER (PARTITION BY series ORDER BY ts, outcome_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def _lags(n: int) -> str:
    return ", ".join(
        f"round_even(lag(x, {i}) OVER (PARTITION BY series ORDER BY ts, outcome_id), 6) AS log_value_lag_{i}" for i in range(1, n + 1)
    )


def _rate(t: str, n: int) -> str:
    return f"round_even(avg(CASE WHEN value >= {t} THEN 1.0 ELSE 0.0 END) {_frame(n)}, 6)"


@query(
    "lag_log_features",
    f"""WITH {LOGS} SELECT * FROM (SELECT series, outcome_id, pos, {_lags(5)},
      round_even(avg(x) {_frame(20)}, 6) AS rolling_mean_log_value,
      {', '.join(f'{_rate(t, 20)} AS "rate_{i}"' for i, t in enumerate(D.THRESHOLDS))} FROM logs) WHERE pos >= 20""",
)
def _(spark, sf_dir):
    rows = features.lag_log_features(D.outcomes(spark, sf_dir), thresholds=D.THRESHOLDS)
    return rows.select(
        "series", "outcome_id", "pos", *[six(f"log_value_lag_{i}") for i in range(1, 6)],
        six("rolling_mean_log_value"),
        *[F.bround(F.col("rolling_rate_ge_" + t.replace(".", "_")), 6).alias(f"rate_{i}") for i, t in enumerate(D.THRESHOLDS)],
    )


@query(
    "regime_features",
    f"""WITH {LOGS} SELECT * FROM (SELECT series, outcome_id, pos, {_lags(5)},
      round_even(avg(x) {_frame(8)}, 6) AS short_mean, round_even(avg(x) {_frame(20)}, 6) AS long_mean,
      round_even(avg(x) {_frame(8)} - avg(x) {_frame(20)}, 6) AS mean_shift,
      round_even(stddev_pop(x) {_frame(8)}, 6) AS short_std, round_even(stddev_pop(x) {_frame(20)}, 6) AS long_std,
      {_rate('5', 8)} AS short_rate, {_rate('5', 20)} AS long_rate FROM logs) WHERE pos >= 20""",
)
def _(spark, sf_dir):
    rows = features.regime_features(D.outcomes(spark, sf_dir))
    return rows.select(
        "series", "outcome_id", "pos", *[six(f"log_value_lag_{i}") for i in range(1, 6)],
        *[six(n) for n in ("short_mean", "long_mean", "mean_shift", "short_std", "long_std")],
        F.bround("short_rate_ge_5", 6).alias("short_rate"), F.bround("long_rate_ge_5", 6).alias("long_rate"),
    )


@query(
    "recent_median",
    f"""WITH {LOGS} SELECT series, outcome_id, pos, quantile_cont(value::DOUBLE, 0.5) {_frame(8)} AS recent_median FROM logs""",
)
def _(spark, sf_dir):
    rows = features.recent_median(D.outcomes(spark, sf_dir))
    return rows.select("series", "outcome_id", "pos", "recent_median")


_WEIGHTED = " + ".join(
    f"lag(x, {i}) OVER w * {(2 / 9) * (7 / 9) ** (i - 1) if i < 20 else (7 / 9) ** 19}::DOUBLE" for i in range(1, 21)
)


@query(
    "ewma",
    f"""WITH {LOGS} SELECT * FROM (SELECT series, outcome_id, pos, round_even({_WEIGHTED}, 6) AS ewma_log FROM logs
    WINDOW w AS (PARTITION BY series ORDER BY ts, outcome_id)) WHERE pos >= 20""",
)
def _(spark, sf_dir):
    return features.ewma(D.outcomes(spark, sf_dir)).select("series", "outcome_id", "pos", six("ewma_log"))


@query(
    "prefix_counts",
    f"""WITH {FREQUENCY} SELECT series, outcome_id, any_value(n) AS n,
      {', '.join(f"CAST(max(hits) FILTER (threshold = {t}) AS BIGINT) AS hits_{i}" for i, t in enumerate(D.THRESHOLDS))}
    FROM forecast GROUP BY ALL""",
)
def _(spark, sf_dir):
    rows = features.prefix_counts(D.outcomes(spark, sf_dir), D.THRESHOLDS)
    return rows.select("series", "outcome_id", "n", *[f"hits_{i}" for i in range(len(D.THRESHOLDS))])


STATE_AGG = """
  count(o.ts) AS n, ln(1 + count(o.ts)) AS f0,
  ln(1 + count(*) FILTER (o.direction = 'received')) AS f1, ln(1 + count(*) FILTER (o.direction = 'sent')) AS f2,
  ln(1 + coalesce(sum(payload_bytes), 0)) AS f3,
  ln(1 + coalesce(sum(payload_bytes) FILTER (o.direction = 'received'), 0)) AS f4,
  ln(1 + coalesce(sum(payload_bytes) FILTER (o.direction = 'sent'), 0)) AS f5,
  count(*) FILTER (o.direction = 'received' AND payload_format = 'binary') / greatest(1, count(*) FILTER (o.direction = 'received')) AS f6,
  count(*) FILTER (o.direction = 'sent' AND payload_format = 'binary') / greatest(1, count(*) FILTER (o.direction = 'sent')) AS f7,
  count(*) FILTER (payload_bytes >= 1024) / count(o.ts) AS f8, count(*) FILTER (payload_bytes < 128) / count(o.ts) AS f9,
  coalesce(avg(entropy) FILTER (payload_format = 'binary'), 0)::DOUBLE AS f10,
  coalesce(avg(zero_ratio) FILTER (payload_format = 'binary'), 0)::DOUBLE AS f11,
  coalesce(avg(high_bit_ratio) FILTER (payload_format = 'binary'), 0)::DOUBLE AS f12,
  coalesce(avg(unique_byte_bucket / 256.0) FILTER (payload_format = 'binary'), 0)::DOUBLE AS f13,
  ln(1 + coalesce(avg(gap), 0)) AS f14,
  ln(1 + CASE WHEN count(gap) > 1 THEN stddev_pop(gap) ELSE 0 END) AS f15,
  ln(1 + count(DISTINCT socket)) AS f16"""


def _vector_sql(points: str, spans: list[tuple[str, str]], lead: str = "", minimum: int = 3, counted: int = 0) -> str:
    """Long-form state vectors per point by plain theta joins."""
    parts = []
    for i, (low, _) in enumerate(spans):
        parts.append(f"""
v{i} AS (SELECT key, {STATE_AGG} FROM (
    SELECT p.key, o.*, (epoch_us(o.ts) - lag(epoch_us(o.ts)) OVER (PARTITION BY p.key ORDER BY o.ts, o.obs_id)) / 1000.0 AS gap
    FROM points p JOIN obs o ON o.series = p.series AND o.ts > {low} AND o.ts <= p.cutoff) o GROUP BY key)""")
    leads = [x for x in lead.split(";") if x]
    rows = [f"SELECT key, {j} AS feature, {x} AS x FROM points" for j, x in enumerate(leads)]
    offset = len(leads)
    for i in range(len(spans)):
        for j in range(17):
            rows.append(
                f"SELECT p.key, {offset + 17 * i + j} AS feature, coalesce(v.f{j}, 0) AS x FROM points p LEFT JOIN v{i} v USING (key)"
            )
    joined = " UNION ALL ".join(rows)
    return f"""WITH {points}, {','.join(parts)}, long AS ({joined})
    SELECT p.series, p.key AS key, l.feature, round_even(l.x::DOUBLE, 6) + 0.0 AS x
    FROM long l JOIN points p USING (key) JOIN v{counted} c ON c.key = p.key AND c.n >= {minimum}"""


_SPANS_8 = [("p.cutoff - INTERVAL 2 HOUR", ""), ("p.cutoff - INTERVAL 8 HOUR", "")]


@query(
    "window_state_features",
    _vector_sql(f"{OBS}, {USERS}, points AS (SELECT series, outcome_id AS key, ts AS cutoff FROM user_outcomes)", _SPANS_8, counted=1, minimum=1),
)
def _(spark, sf_dir):
    points = D.user_outcomes(spark, sf_dir).withColumn("cutoff", F.col("ts"))
    rows = features.window_state_features(
        points, D.observations(spark, sf_dir), HOURS, ["outcome_id", "cutoff"]
    )
    rows = rows.where("events_1 >= 1").withColumnRenamed("outcome_id", "key")
    return elements(rows, "state", ["series", "key"])


_WARM = "target_index >= 20"


@query(
    "state_samples_at_outcome",
    _vector_sql(
        f"{OBS_G}, {USERS_G}, points AS (SELECT series, target_id AS key, prev_ts AS cutoff FROM pairs WHERE {_WARM})",
        _SPANS_8, counted=1,
    ),
)
def _(spark, sf_dir):
    rows = features.state_samples_at_outcome(
        D.user_outcomes(spark, sf_dir, True), D.observations(spark, sf_dir, True), HOURS
    )
    return elements(rows.withColumnRenamed("outcome_id", "key"), "state", ["series", "key"])


_SPANS_SINCE = [("p.prev_ts", ""), ("p.cutoff - INTERVAL 3 HOUR", ""), ("p.cutoff - INTERVAL 24 HOUR", "")]


@query(
    "state_samples_prestart",
    _vector_sql(
        f"""{OBS_G}, {USERS_G}, {ONSETS_G}, points AS (SELECT series, target_id AS key, prev_ts, onset_ts - INTERVAL 500 MILLISECOND AS cutoff,
        ln(1 + (epoch_us(onset_ts) - 500000 - epoch_us(prev_ts)) / 1e6) AS age FROM onsets
        WHERE {_WARM} AND onset_ts - INTERVAL 500 MILLISECOND > prev_ts AND onset_ts < target_ts)""",
        _SPANS_SINCE, "age",
    ),
)
def _(spark, sf_dir):
    rows = features.state_samples_prestart(
        D.user_outcomes(spark, sf_dir, True), D.observations(spark, sf_dir, True),
        D.onsets(spark, sf_dir, True), windows_seconds=LONG_HOURS,
    )
    return elements(rows.withColumnRenamed("outcome_id", "key"), "state", ["series", "key"])


@query(
    "state_samples_checkpoint",
    _vector_sql(
        f"""{OBS_G}, {USERS_G}, {ONSETS_G}, points AS (SELECT series, target_id || '@' || d::INTEGER AS key, prev_ts,
          prev_ts + INTERVAL 1 SECOND * d AS cutoff, ln(1 + d) AS age
        FROM onsets, (VALUES (3600), (7200)) v(d) WHERE {_WARM} AND prev_ts + INTERVAL 1 SECOND * d < onset_ts AND onset_ts < target_ts)""",
        _SPANS_SINCE, "age",
    ),
)
def _(spark, sf_dir):
    rows = features.state_samples_checkpoint(
        D.user_outcomes(spark, sf_dir, True), D.observations(spark, sf_dir, True),
        D.onsets(spark, sf_dir, True), [D.HOUR, 2 * D.HOUR], windows_seconds=LONG_HOURS,
    )
    key = F.concat_ws("@", "outcome_id", F.col("delay_seconds").cast("int").cast("string"))
    return elements(rows.withColumn("key", key), "state", ["series", "key"])


# --- triggers --------------------------------------------------------------------------------


def _frozen_sql(lookback: int, minimum: int, fraction: float, hits: int, rate: float, enrich: float, top: int, source: str) -> str:
    """Discovery by theta joins; times in microseconds."""
    return f"""
ranked AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY onset_ts, target_ts) - 1 AS r, count(*) OVER (PARTITION BY series) AS n FROM {source}),
marked AS (SELECT *, r < greatest(1, least(n - 1, floor(n * {fraction}::DOUBLE))) AS discovery FROM ranked),
early AS (SELECT *, epoch_us(prev_ts) AS p, epoch_us(onset_ts) AS s, greatest(epoch_us(prev_ts), epoch_us(onset_ts) - {lookback}) AS nl,
    epoch_us(onset_ts) - {minimum} AS nr FROM marked WHERE discovery),
totals AS (SELECT series, count(*) AS d, CAST(sum(CASE WHEN nr > nl THEN nl - p ELSE 0 END) AS DOUBLE) / 1e6 AS bg FROM early GROUP BY series),
seen AS (SELECT e.series, o.signature, e.target_ts, epoch_us(o.ts) AS tick, e.s, e.nl, e.nr FROM early e JOIN signed o
    ON o.series = e.series AND o.ts > e.prev_ts AND o.ts < e.onset_ts WHERE e.nr > e.nl),
sig AS (SELECT series, signature, count(*) FILTER (tick >= nl AND tick <= nr) AS near,
    count(*) FILTER (tick < nl) AS background,
    count(DISTINCT target_ts) FILTER (tick >= nl AND tick <= nr) AS hits,
    min(s - tick) FILTER (tick >= nl AND tick <= nr) / 1e6 AS min_lead,
    round_even(quantile_cont(s - tick, 0.5) FILTER (tick >= nl AND tick <= nr), 0) / 1e6 AS med_lead
    FROM seen GROUP BY ALL),
rated AS (SELECT *, hits / d AS hr, (near / ({(lookback - minimum) / 1e6} * d) + 1e-6) /
    (CASE WHEN bg > 0 THEN background / bg ELSE 0 END + 1e-6) AS en FROM sig JOIN totals USING (series)),
frozen AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY score DESC, hit_rate DESC, enrichment DESC, minimum_lead_seconds DESC, signature) - 1 AS rank FROM (
  SELECT series, signature, d AS discovery_onsets, hits, round_even(hr, 6) AS hit_rate, near AS occurrences_near_onset,
    background AS background_occurrences, round_even(en, 6) AS enrichment, med_lead AS median_lead_seconds,
    round_even(min_lead, 6) AS minimum_lead_seconds, round_even(hr * ln(1 + en) * ln(1 + hits), 6) AS score
  FROM rated WHERE hits >= {hits} AND hr >= {rate} AND en >= {enrich}) QUALIFY rank < {top})"""


_TRIGGER = {
    "lookback_seconds": 6 * D.HOUR, "minimum_lead_seconds": 60.0, "minimum_hits": 3,
    "minimum_hit_rate": 0.02, "minimum_enrichment": 1.05,
}
_FROZEN = _frozen_sql(6 * HOUR_US, 60_000_000, 0.55, 3, 0.02, 1.05, 12, "onsets")
_BASE_G = f"{OBS_G}, {USERS_G}, {ONSETS_G}"


def _signed(spark, sf_dir):
    return D.observations(spark, sf_dir, True).withColumn("signature", C.observation_signature())


def _frozen(spark, sf_dir, found=None):
    found = D.onsets(spark, sf_dir, True) if found is None else found
    return triggers.discover_triggers(found, _signed(spark, sf_dir), **_TRIGGER)



@query("discover_triggers", f"WITH {_BASE_G}, {_FROZEN} SELECT * FROM frozen")
def _(spark, sf_dir):
    return _frozen(spark, sf_dir)


_APPLIED = f"""{_FROZEN},
late AS (SELECT * FROM marked WHERE NOT discovery),
applied AS (SELECT l.series, l.prev_ts, l.target_ts, l.onset_ts, l.target_index, l.target_id, count(*) AS c, min(o.ts) AS trigger_ts, arg_min(o.obs_id, o.ts) AS obs_id,
    arg_min(o.signature, o.ts) AS signature, arg_min(f.score, o.ts) AS score, arg_min(f.rank, o.ts) AS rank
  FROM late l JOIN signed o ON o.series = l.series AND o.ts > l.prev_ts AND o.ts < l.onset_ts AND o.ts <= l.onset_ts - INTERVAL 60 SECOND
  JOIN frozen f ON f.series = o.series AND f.signature = o.signature GROUP BY ALL),
fired AS (SELECT *, round_even((epoch_us(onset_ts) - epoch_us(trigger_ts)) / 1e6, 6) AS lead_seconds,
    round_even((epoch_us(trigger_ts) - epoch_us(prev_ts)) / 1e6, 6) AS age_seconds FROM applied)"""


def _fired(spark, sf_dir):
    found = settle(D.onsets(spark, sf_dir, True))
    late = D.later_onsets(found)
    frozen = _frozen(spark, sf_dir, found)
    return late, settle(triggers.apply_triggers(late, _signed(spark, sf_dir), frozen, 60.0))


@query(
    "apply_triggers",
    f"WITH {_BASE_G}, {_APPLIED} SELECT series, prev_ts, target_ts, onset_ts, trigger_ts, obs_id, signature, score, rank, lead_seconds, age_seconds FROM fired",
)
def _(spark, sf_dir):
    rows = _fired(spark, sf_dir)[1]
    return rows.select(
        "series", "prev_ts", "target_ts", "onset_ts", "trigger_ts", "obs_id", "signature", "score",
        "rank", "lead_seconds", "age_seconds",
    )


@query(
    "trigger_coverage",
    f"""WITH {_BASE_G}, {_APPLIED} SELECT l.series, count(*) AS evaluated, count(f.trigger_ts) AS triggers,
      min(lead_seconds) AS minimum_lead_seconds, round_even(quantile_cont(epoch_us(f.onset_ts) - epoch_us(f.trigger_ts), 0.5), 0) / 1e6 AS median_lead_seconds,
      round_even(quantile_cont(epoch_us(f.trigger_ts) - epoch_us(f.prev_ts), 0.5), 0) / 1e6 AS median_age_seconds, round_even(count(f.trigger_ts) / count(*), 6) AS coverage
    FROM late l LEFT JOIN fired f USING (series, target_ts) GROUP BY l.series""",
)
def _(spark, sf_dir):
    late, rows = _fired(spark, sf_dir)
    return triggers.trigger_coverage(rows, late)


@query(
    "recent_trigger_refresh",
    f"""WITH {_BASE_G}, latest AS (SELECT * FROM onsets QUALIFY row_number() OVER (PARTITION BY series ORDER BY onset_ts DESC, target_ts DESC) <= 48),
    {_frozen_sql(6 * HOUR_US, 60_000_000, 0.80, 3, 0.02, 1.05, 16, "latest")} SELECT * FROM frozen""",
)
def _(spark, sf_dir):
    settings = {k: v for k, v in _TRIGGER.items()}
    rows = triggers.recent_trigger_refresh(D.onsets(spark, sf_dir, True), _signed(spark, sf_dir), **settings)
    return rows


_TRIGGER_POINTS = f"""{_BASE_G}, {_APPLIED}, points AS (
  SELECT f.series, f.target_id AS key, f.prev_ts, f.trigger_ts AS cutoff, age_seconds, score, rank, o.direction, o.payload_format, o.payload_bytes,
    o.entropy, o.zero_ratio, o.high_bit_ratio, o.unique_byte_bucket
  FROM fired f JOIN obs o ON o.obs_id = f.obs_id WHERE {_WARM})"""


@query(
    "state_samples_triggered",
    _vector_sql(
        _TRIGGER_POINTS, _SPANS_SINCE,
        "ln(1 + age_seconds);ln(1 + score);1.0 / (1 + rank);CASE WHEN direction = 'received' THEN 1 ELSE 0 END;"
        "CASE WHEN payload_format = 'binary' THEN 1 ELSE 0 END;ln(1 + payload_bytes);coalesce(entropy, 0);coalesce(zero_ratio, 0);"
        "coalesce(high_bit_ratio, 0);coalesce(unique_byte_bucket, 0) / 256.0", minimum=2,
    ),
)
def _(spark, sf_dir):
    rows = features.state_samples_triggered(
        D.user_outcomes(spark, sf_dir, True), D.observations(spark, sf_dir, True),
        _fired(spark, sf_dir)[1], LONG_HOURS,
    )
    return elements(rows.withColumnRenamed("outcome_id", "key"), "state", ["series", "key"])


_SEQUENCE = f"""{_BASE_G}, {_APPLIED},
inside AS (SELECT f.series, f.target_ts, f.prev_ts, o.ts, o.obs_id, o.signature, o.direction, o.payload_format, o.payload_bytes,
    row_number() OVER (PARTITION BY f.series, f.target_ts ORDER BY o.ts DESC, o.obs_id DESC) AS back
  FROM fired f JOIN signed o ON o.series = f.series AND o.ts > f.prev_ts AND o.ts <= f.trigger_ts),
seqtot AS (SELECT series, target_ts, count(*) AS event_count, count(*) FILTER (direction = 'received') AS received_count,
    count(*) FILTER (direction = 'sent') AS sent_count, count(*) FILTER (payload_format = 'binary') AS binary_count,
    CAST(sum(payload_bytes) AS BIGINT) AS total_payload_bytes FROM inside GROUP BY ALL),
steps AS (SELECT series, target_ts, ts, obs_id, signature, lag(signature) OVER w AS before,
    round((epoch_us(ts) - coalesce(lag(epoch_us(ts)) OVER w, epoch_us(prev_ts))) / 1000.0, 3) AS gap_ms
  FROM inside WHERE back <= 32 WINDOW w AS (PARTITION BY series, target_ts ORDER BY ts, obs_id))"""


def _sequences(spark, sf_dir):
    return features.signature_sequence(_fired(spark, sf_dir)[1], D.observations(spark, sf_dir, True))


@query(
    "signature_sequence",
    f"""WITH {_SEQUENCE} SELECT t.*, s.recent, s.transitions FROM seqtot t JOIN (
      SELECT series, target_ts, string_agg(signature || '@' || format('{{:.3f}}', gap_ms), ',' ORDER BY ts, obs_id) AS recent,
        count(before) AS transitions FROM steps GROUP BY ALL) s USING (series, target_ts)""",
)
def _(spark, sf_dir):
    rows = _sequences(spark, sf_dir)
    step = F.transform(
        "features.recent_sequence",
        lambda e: F.concat(e["signature"], F.lit("@"), F.format_string("%.3f", e["gap_ms"])),
    )
    total = F.aggregate(F.map_values("features.transition_counts"), F.lit(0).cast("bigint"), lambda a, n: a + n)
    return rows.select(
        "series", "target_ts", F.col("features.event_count_since_previous").alias("event_count"),
        "features.received_count", "features.sent_count", "features.binary_count",
        "features.total_payload_bytes", F.array_join(step, ",").alias("recent"), total.alias("transitions"),
    )


def _bin(token: str) -> str:
    return f"CAST('0x' || substr(sha256({token}), 1, 8) AS BIGINT) % 24"


def _sign(token: str) -> str:
    return f"CASE WHEN CAST('0x' || substr(sha256({token}), 9, 2) AS INTEGER) % 2 = 1 THEN 1.0 ELSE -1.0 END"


@query(
    "hashed_features",
    f"""WITH {_SEQUENCE}, k AS (SELECT series, target_ts FROM seqtot),
    sc AS (SELECT series, target_ts, signature AS t, count(*) AS n FROM steps GROUP BY ALL),
    tc AS (SELECT series, target_ts, before || ' -> ' || signature AS t, count(*) AS n FROM steps WHERE before IS NOT NULL GROUP BY ALL),
    sq AS (SELECT series, target_ts, 'seq:' || signature AS t,
        row_number() OVER w / count(*) OVER (PARTITION BY series, target_ts) AS n FROM steps WINDOW w AS (PARTITION BY series, target_ts ORDER BY ts, obs_id)),
    tr AS (SELECT series, target_ts, 'trigger:' || signature AS t, 1.0 AS n FROM fired),
    w AS (SELECT series, target_ts, 10 + {_bin('t')} AS feature, {_sign('t')} * ln(1 + n) AS x FROM sc
      UNION ALL SELECT series, target_ts, 34 + {_bin('t')}, {_sign('t')} * ln(1 + n) FROM tc
      UNION ALL SELECT series, target_ts, 58 + {_bin('t')}, {_sign('t')} * n FROM sq
      UNION ALL SELECT series, target_ts, 82 + {_bin('t')}, {_sign('t')} * n FROM tr),
    g AS (SELECT series, target_ts, avg(gap_ms) AS m, CASE WHEN count(*) > 1 THEN stddev_pop(gap_ms) ELSE 0 END AS s, arg_max(gap_ms, (ts, obs_id)) AS l FROM steps GROUP BY ALL),
    base AS (SELECT t.*, f.age_seconds, f.score, g.m, g.s, g.l FROM seqtot t JOIN fired f USING (series, target_ts) JOIN g USING (series, target_ts)),
    scalars AS (SELECT series, target_ts, unnest([0,1,2,3,4,5,6,7,8,9]) AS feature, unnest([ln(1 + age_seconds), ln(1 + score), ln(1 + event_count), ln(1 + received_count),
        ln(1 + sent_count), ln(1 + binary_count), ln(1 + total_payload_bytes), ln(1 + m), ln(1 + s), ln(1 + l)]) AS x FROM base),
    empty AS (SELECT series, target_ts, unnest(range(10, 106)) AS feature, 0.0 AS x FROM k)
    SELECT series, target_ts, CAST(feature AS INTEGER) AS feature, round_even(sum(x)::DOUBLE, 6) + 0.0 AS x FROM (
      SELECT * FROM w UNION ALL SELECT * FROM scalars UNION ALL SELECT * FROM empty) GROUP BY ALL""",
)
def _(spark, sf_dir):
    fired = _fired(spark, sf_dir)[1]
    seen = features.signature_sequence(fired, D.observations(spark, sf_dir, True))
    locks = seen.join(
        fired.select(
            "series", "target_ts", F.col("signature").alias("trigger_signature"),
            F.col("score").alias("trigger_score"),
            F.col("age_seconds").alias("trigger_age_after_previous_seconds"),
        ),
        ["series", "target_ts"],
    )
    return elements(features.hashed_features(locks), "vector", ["series", "target_ts"])

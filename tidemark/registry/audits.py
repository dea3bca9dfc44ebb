"""Leak audits over fields, identifiers and categories."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import leaks, triggers
from tidemark.registry.common import observed, onsets, users
from tidemark.sources import driver_tables as D
from tidemark.sources import observations as S

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


BASE = f"""{observed()}, {users()}, {onsets()},
fields AS (SELECT * FROM obs WHERE payload_format = 'json'),
events_ AS (SELECT * FROM fields WHERE kind = 'cdp_websocket_received')"""
JOINED = """o.series = p.series AND o.ts > p.prev_ts AND o.ts <= p.target_ts"""


def _inputs(spark, sf_dir):
    return D.small_outcomes(spark, sf_dir), D.onsets(spark, sf_dir)


def _fields(spark, sf_dir):
    return S.field_observations(D.observations(spark, sf_dir))



EXACT = f"""{BASE},
hits AS (SELECT p.series, p.target_ts, p.target_id, p.target_small, n.onset_ts,
    min(o.ts) FILTER (o.number = p.target_small) AS first_ts
  FROM pairs p JOIN fields o ON {JOINED} LEFT JOIN onsets n ON n.series = p.series AND n.target_ts = p.target_ts GROUP BY ALL),
lead AS (SELECT *, (epoch_us(target_ts) - epoch_us(first_ts)) / 1e6 AS lead, coalesce(first_ts < onset_ts, false) AS early FROM hits)"""


@query(
    "exact_match_leak_audit",
    f"""WITH {EXACT}, counts AS (SELECT series, count(*) AS observations FROM fields GROUP BY series),
    r AS (SELECT series, count(*) AS target_intervals_seen, count(first_ts) AS exact_match_targets, count(*) FILTER (lead >= 0.25) AS exact_matches_ge_025s,
      count(*) FILTER (lead >= 1) AS exact_matches_ge_1s, count(*) FILTER (lead >= 2) AS exact_matches_ge_2s, count(*) FILTER (lead >= 5) AS exact_matches_ge_5s,
      count(*) FILTER (early) AS exact_matches_before_onset, round_even(max(lead), 6) AS maximum_lead_seconds, round_even(quantile_cont(CAST(round(lead * 1e6) AS BIGINT), 0.5), 0) / 1e6 AS median_lead_seconds
      FROM lead GROUP BY series)
    SELECT c.series, 'data.multiplier' AS path, observations, coalesce(target_intervals_seen, 0) AS target_intervals_seen, coalesce(exact_match_targets, 0) AS exact_match_targets,
      coalesce(exact_matches_ge_025s, 0) AS exact_matches_ge_025s, coalesce(exact_matches_ge_1s, 0) AS exact_matches_ge_1s, coalesce(exact_matches_ge_2s, 0) AS exact_matches_ge_2s,
      coalesce(exact_matches_ge_5s, 0) AS exact_matches_ge_5s, coalesce(exact_matches_before_onset, 0) AS exact_matches_before_onset, maximum_lead_seconds, median_lead_seconds,
      true AS outcome_like_path, CASE WHEN exact_matches_before_onset > 0 THEN 'POTENTIAL_PRESTART_DISCLOSURE' WHEN exact_matches_ge_5s > 0 THEN 'POTENTIAL_EARLY_DISCLOSURE'
        WHEN exact_matches_ge_1s > 0 THEN 'REVIEW_TIMING' ELSE 'NO_DIRECT_LEAK' END AS verdict
    FROM counts c LEFT JOIN r USING (series)""",
)
def _(spark, sf_dir):
    rows = leaks.exact_match_leak_audit(*_inputs(spark, sf_dir), _fields(spark, sf_dir))
    return rows


@query(
    "exact_match_examples",
    f"""WITH {EXACT} SELECT series, target_ts, first_ts AS observed_ts, round_even(lead, 6) AS lead_seconds, early AS before_onset FROM lead
    WHERE first_ts IS NOT NULL ORDER BY early DESC, lead DESC LIMIT 30""",
)
def _(spark, sf_dir):
    hits = leaks.exact_match_hits(*_inputs(spark, sf_dir), _fields(spark, sf_dir))
    rows = leaks.exact_match_examples(hits)
    return rows.select(
        "series", "target_ts", F.col("earliest.ts").alias("observed_ts"),
        F.bround("lead_seconds", 6).alias("lead_seconds"), "before_onset",
    )


@query(
    "identifier_exposure",
    f"""WITH {BASE}, seen AS (SELECT p.series, p.target_ts, bool_or(coalesce(o.ts < n.onset_ts, false)) AS early
      FROM pairs p JOIN fields o ON {JOINED} LEFT JOIN onsets n ON n.series = p.series AND n.target_ts = p.target_ts GROUP BY ALL),
    c AS (SELECT series, count(*) AS observations, count(DISTINCT identifier) AS unique_hashes FROM fields GROUP BY series),
    i AS (SELECT series, count(*) AS target_intervals_seen, count(*) FILTER (early) AS intervals_with_preonset FROM seen GROUP BY series)
    SELECT series, 'data.roundid' AS path, observations, unique_hashes, coalesce(target_intervals_seen, 0) AS target_intervals_seen,
      coalesce(intervals_with_preonset, 0) AS intervals_with_preonset FROM c LEFT JOIN i USING (series)""",
)
def _(spark, sf_dir):
    return leaks.identifier_exposure(*_inputs(spark, sf_dir), _fields(spark, sf_dir))


def _before(rows: str, margin: str) -> str:
    return f"""{BASE}, seen AS (SELECT p.series, p.target_ts, p.onset_ts, p.target_small, p.prev_small, o.* EXCLUDE (series), epoch_us(o.ts) AS tick,
      (epoch_us(p.onset_ts) - epoch_us(o.ts)) / 1e6 AS lead
    FROM onsets p JOIN {rows} o ON o.series = p.series AND o.ts > p.prev_ts AND o.ts <= p.onset_ts - INTERVAL {margin})"""


@query(
    "any_last_match_audit",
    f"""WITH {_before('events_', '500 MILLISECOND')}, per AS (SELECT series, target_ts, bool_or(abs(number - target_small) <= 1) AS any_match,
      arg_max(abs(number - target_small) <= 1, (ts, obs_id)) AS last_match, min(lead) AS lead FROM seen GROUP BY ALL),
    d AS (SELECT series, count(DISTINCT number) AS distinct_values FROM seen GROUP BY series)
    SELECT series, 'data.multiplier' AS path, count(*) AS rounds_observed, count(*) FILTER (any_match) AS any_exact_matches, count(*) FILTER (last_match) AS last_exact_matches,
      round_even(count(*) FILTER (any_match) / count(*), 6) AS any_match_rate, round_even(count(*) FILTER (last_match) / count(*), 6) AS last_match_rate,
      round_even(min(lead), 6) AS minimum_last_lead_seconds, any_value(distinct_values) AS distinct_values, round_even(quantile_cont(CAST(round(lead * 1e6) AS BIGINT), 0.5), 0) / 1e6 AS median_last_lead_seconds,
      CASE WHEN count(*) >= 5 AND count(*) FILTER (last_match) / count(*) >= 0.8 THEN 'DIRECT_LEAK_CANDIDATE' ELSE 'REVIEW' END AS severity
    FROM per JOIN d USING (series) GROUP BY series""",
)
def _(spark, sf_dir):
    fields = S.field_observations(D.observations(spark, sf_dir), strict=True)
    rows = leaks.any_last_match_audit(*_inputs(spark, sf_dir), fields, tolerance=1.0)
    return rows


@query(
    "identifier_rounds",
    f"""WITH {_before('events_', '500 MILLISECOND')} SELECT series, 'data.roundid' AS path, count(DISTINCT target_ts) AS rounds_observed,
      count(DISTINCT identifier) AS unique_hashes FROM seen GROUP BY series""",
)
def _(spark, sf_dir):
    fields = S.field_observations(D.observations(spark, sf_dir), strict=True)
    return leaks.identifier_rounds(*_inputs(spark, sf_dir), fields)


def _events(spark, sf_dir):
    return S.protocol_events(D.observations(spark, sf_dir))


@query(
    "disclosure_audit",
    f"""WITH {_before('events_', '2 SECOND')}, a AS (SELECT series, count(*) AS observations, count(DISTINCT target_ts) AS rounds,
      count(*) FILTER (abs(number - target_small) <= 1) AS target_matches, count(*) FILTER (abs(number - prev_small) <= 1) AS previous_matches,
      round_even(min(lead), 6) AS minimum_lead_seconds, round_even(quantile_cont(CAST(round(lead * 1e6) AS BIGINT), 0.5), 0) / 1e6 AS median_lead_seconds FROM seen GROUP BY series)
    SELECT *, 'data.multiplier' AS path, round_even(target_matches / observations, 6) AS target_match_rate, round_even(previous_matches / observations, 6) AS previous_match_rate,
      CASE WHEN target_matches >= 3 AND target_matches / observations >= 0.8 AND target_matches / observations >= previous_matches / observations + 0.2
        THEN 'CANDIDATE_PRE_ROUND_DISCLOSURE' ELSE 'NO_DIRECT_DISCLOSURE' END AS verdict FROM a""",
)
def _(spark, sf_dir):
    rows = leaks.disclosure_audit(*_inputs(spark, sf_dir), _events(spark, sf_dir), tolerance=1.0)
    return rows


@query(
    "identifier_leads",
    f"""WITH {_before('events_', '2 SECOND')} SELECT series, 'data.roundid' AS path, count(*) AS observations, count(DISTINCT target_ts) AS rounds,
      count(DISTINCT identifier) AS unique_hashes, round_even(quantile_cont(CAST(round(lead * 1e6) AS BIGINT), 0.5), 0) / 1e6 AS median_lead_seconds FROM seen GROUP BY series""",
)
def _(spark, sf_dir):
    rows = leaks.identifier_leads(*_inputs(spark, sf_dir), _events(spark, sf_dir))
    return rows


# Categories are audited on groups of users, whose series are long enough to split.
BASE_G = f"{observed(True)}, {users(True)}, {onsets(True)}, events_ AS (SELECT * FROM obs WHERE payload_format = 'json' AND kind = 'cdp_websocket_received')"
ELIGIBLE = f"""{BASE_G},
eligible AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY onset_ts, target_ts) - 1 AS r, count(*) OVER (PARTITION BY series) AS n FROM onsets
  WHERE epoch_us(onset_ts) - 2000000 > epoch_us(prev_ts)),
seen AS (SELECT e.series, e.target_ts, o.obs_id, o.event_type, o.event_id FROM eligible e JOIN events_ o ON o.series = e.series AND o.ts > e.prev_ts
  AND o.ts <= e.onset_ts - INTERVAL 2 SECOND),
tokens AS (SELECT DISTINCT series, target_ts, unnest(['state=' || event_type, 'phase=p' || (event_id % 4)]) AS token FROM seen)"""


@query(
    "category_holdout",
    f"""WITH {ELIGIBLE}, th(threshold) AS (VALUES (20.0), (50.0)),
    lab AS (SELECT series, target_ts, threshold, r < CASE WHEN n > 1 THEN greatest(1, least(n - 1, floor(n * 0.6::DOUBLE))) ELSE 0 END AS early,
      CASE WHEN target_value >= threshold THEN 1.0 ELSE 0.0 END AS hit FROM eligible, th),
    ov AS (SELECT series, threshold, avg(hit) FILTER (early) AS e, avg(hit) FILTER (NOT early) AS l FROM lab GROUP BY ALL),
    st AS (SELECT series, threshold, token, count(*) FILTER (early) AS ds, avg(hit) FILTER (early) AS dr, count(*) FILTER (NOT early) AS hs, avg(hit) FILTER (NOT early) AS hr
      FROM lab JOIN tokens USING (series, target_ts) GROUP BY ALL HAVING count(*) FILTER (early) >= 5)
    SELECT series, threshold::DOUBLE AS threshold, token, ds AS discovery_support, round_even(dr, 6) AS discovery_positive_rate, round_even(dr - e, 6) + 0.0 AS discovery_lift,
      hs AS holdout_support, round_even(hr, 6) AS holdout_positive_rate, round_even(hr - l, 6) + 0.0 AS holdout_lift,
      coalesce(dr - e = 0 OR hr - l = 0 OR (dr - e > 0) = (hr - l > 0), false) AS direction_consistent
    FROM st JOIN ov USING (series, threshold) WHERE e IS NOT NULL AND l IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY series, threshold ORDER BY abs(dr - e) * sqrt(ds) DESC, token DESC) <= 20""",
)
def _(spark, sf_dir):
    events = S.protocol_events(D.observations(spark, sf_dir, True))
    rows = leaks.category_holdout(
        D.user_outcomes(spark, sf_dir, True), D.onsets(spark, sf_dir, True), events, thresholds=("20", "50")
    )
    lifts = ["discovery_lift", "holdout_lift"]
    return rows.withColumns({n: F.col(n) + 0.0 for n in lifts})


@query(
    "interval_coverage",
    f"""WITH {ELIGIBLE}, c AS (SELECT series, count(*) AS eligible_intervals FROM eligible GROUP BY series),
    s AS (SELECT series, count(DISTINCT target_ts) AS metadata_intervals, count(*) AS json_events, count(*) AS categorical_events FROM seen GROUP BY series),
    u AS (SELECT series, count(DISTINCT token) AS unique_tokens FROM tokens GROUP BY series)
    SELECT series, eligible_intervals, coalesce(metadata_intervals, 0) AS metadata_intervals, coalesce(json_events, 0) AS json_events,
      coalesce(categorical_events, 0) AS categorical_events, coalesce(unique_tokens, 0) AS unique_tokens
    FROM c LEFT JOIN s USING (series) LEFT JOIN u USING (series)""",
)
def _(spark, sf_dir):
    events = S.protocol_events(D.observations(spark, sf_dir, True))
    return leaks.interval_coverage(D.user_outcomes(spark, sf_dir, True), D.onsets(spark, sf_dir, True), events)


@query(
    "onset_gap_summary",
    f"""WITH {users()}, {onsets()} SELECT series, count(*) AS onsets,
      round_even(quantile_cont(epoch_us(onset_ts) - epoch_us(prev_ts), 0.5), 0) / 1e6 AS median_outcome_to_onset,
      round_even(quantile_cont(epoch_us(target_ts) - epoch_us(onset_ts), 0.5), 0) / 1e6 AS median_onset_to_outcome FROM onsets GROUP BY series""",
)
def _(spark, sf_dir):
    rows = triggers.onset_gap_summary(D.onsets(spark, sf_dir))
    return rows

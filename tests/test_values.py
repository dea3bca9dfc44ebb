"""Hand-computed values, planted signals, ties, nulls, empty input and causality."""

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.operators import describe, evaluate, features, forecast, leaks, ledger, profile, snapshots, temporal, triggers
from tidemark.sources import ledgers, observations, outcomes as store

pytestmark = pytest.mark.usefixtures("whole")
START = datetime(2025, 1, 1, 12, tzinfo=timezone.utc)


def at(seconds):
    return START + timedelta(seconds=seconds)


def series_of(spark, values, step=1.0, name="s"):
    rows = [(name, f"o{i:04d}", str(v), at(i * step)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "series string, outcome_id string, v string, ts timestamp")
    return df.select("series", "outcome_id", F.col("v").cast("decimal(18,6)").alias("value"), "ts")


def frame(spark, rows):
    """(seconds, bytes[, format]) as received frames of one series."""
    made = [
        ("s", f"x{i:04d}", at(r[0]), "cdp_websocket_received", "u", "k", "received", r[1], r[2] if len(r) > 2 else "binary",
         "h", 5.0, 0.1, 0.4, 128)
        for i, r in enumerate(rows)
    ]
    return spark.createDataFrame(
        made,
        "series string, obs_id string, ts timestamp, kind string, url string, socket string, direction string, "
        "payload_bytes bigint, payload_format string, payload_sha256 string, entropy double, zero_ratio double, "
        "high_bit_ratio double, unique_byte_bucket int",
    )


# --- frequency -----------------------------------------------------------------------------


def next_probabilities(spark, values, **config):
    rows = forecast.frequency_forecast(forecast.with_next(series_of(spark, values)), **config)
    rows = rows.where("value is null").orderBy("threshold").collect()
    return [(r.sample_count, r.status, None if r.probability is None else float(r.probability)) for r in rows]


def test_frequency_values(spark):
    got = next_probabilities(spark, [1.2, 2, 6, 3], thresholds=("1.5", "2", "5"), min_history=4)
    assert [p for _, _, p in got] == [0.75, 0.75, 0.25]
    rolled = next_probabilities(spark, [10, 1, 1, 2], thresholds=("2",), mode="rolling", window=3, min_history=3)
    assert rolled == [(3, "READY", 0.333333)]
    short = next_probabilities(spark, [2, 3], thresholds=("2",), min_history=3)
    assert short == [(2, "INSUFFICIENT_DATA", None)]


def test_walk_forward_values(spark):
    row = evaluate.walk_forward_frequency(series_of(spark, [1, 3, 3, 1]), ("2",), min_history=2).first()
    assert (row.predictions, row.positives) == (2, 1)
    assert (float(row.brier_score), float(row.calibration_error)) == (0.347222, 0.083334)
    row = evaluate.walk_forward_frequency(series_of(spark, [1, 1, 10]), ("5",), min_history=2).first()
    assert (row.skipped, float(row.brier_score)) == (2, 1.0)


def test_thresholds_must_increase(spark):
    with pytest.raises(ValueError):
        forecast.frequency_forecast(series_of(spark, [1]), ("2", "2"))


# --- description ---------------------------------------------------------------------------


def test_numeric_summary_and_buckets(spark):
    df = series_of(spark, [1.1, 2, 5, 10, 20])
    row = describe.numeric_summary(df, "value").first()
    assert (float(row["mean"]), row["median"]) == (7.62, 5.0)
    assert [float(r.pct) for r in describe.bucket_histogram(df).orderBy("lower").collect()] == [20, 20, 20, 40]
    thirds = describe.bucket_histogram(series_of(spark, [1, 1, 2])).orderBy("lower").collect()
    assert [float(r.pct) for r in thirds] == [66.67, 33.33, 0, 0]
    for values, mean in (([1.000000, 1.000001], 1.0), ([1.000001, 1.000002], 1.000002), ([1, 1, 2], 1.333333)):
        assert float(describe.numeric_summary(series_of(spark, values), "value").first()["mean"]) == mean


def test_report_of_nothing(spark):
    empty = series_of(spark, [1]).where("false").select(
        "*", F.col("ts").alias("collection_ts"), F.col("ts").alias("started_at"),
        F.col("ts").alias("pre_observed_at"), *[F.lit("{}").alias(n) for n in describe.PAYLOADS],
    )
    row = describe.outcome_report(empty).first()
    assert row.status == "NO_DATA" and row.selected == 0 and row.value_median is None and row.bucket_0 == 0


# --- storage ---------------------------------------------------------------------------------


def test_documents_are_read_strictly(spark, tmp_path):
    good = {
        "round_id": "1", "timestamp": "2025-01-01T12:00:00+02:00", "multiplier": "1.250", "source": " T ",
        "collection_timestamp": "2025-01-01T12:00:01Z",
    }
    cases = {
        "good": json.dumps({"format_version": 1, "rounds": [good]}),
        "extra": json.dumps({"format_version": 1, "rounds": [], "x": 1}),
        "version": json.dumps({"format_version": 2, "rounds": []}),
        "number": json.dumps({"format_version": 1, "rounds": [{**good, "multiplier": 1.25}]}),
        "unknown": json.dumps({"format_version": 1, "rounds": [{**good, "z": 1}]}),
        "missing": json.dumps({"format_version": 1, "rounds": [{"round_id": "1"}]}),
        "broken": "{",
        "twice": '{"format_version":1,"format_version":1,"rounds":[]}',
    }
    for name, text in cases.items():
        (tmp_path / f"{name}.json").write_text(text)
    rows = store.read_outcome_documents(spark, str(tmp_path))
    found = {r.file.rsplit("/", 1)[1][:-5]: r.document_error for r in rows.collect()}
    assert found == {
        "good": None, "extra": "INVALID_DOCUMENT_FIELDS", "version": "UNSUPPORTED_FORMAT_VERSION",
        "number": "MULTIPLIER_MUST_BE_STRING", "unknown": "UNKNOWN_ROUND_FIELD",
        "missing": "MISSING_ROUND_FIELD", "broken": "INVALID_JSON", "twice": "DUPLICATE_JSON_KEY",
    }
    kept, _ = store.validate_outcomes(rows.where("document_error is null"))
    row = store.text_form(kept).first()
    assert (row.series, row.value, row.ts) == ("T", "1.25", "2025-01-01T10:00:00.000000Z")


def raw(spark, **changes):
    row = {
        "series": "s", "outcome_id": "1", "value": "2.5", "ts": "2025-01-01T00:00:10Z",
        "collection_ts": "2025-01-01T00:00:11Z", "started_at": None, "pre_observed_at": None,
        "pre_data": "{}", "post_data": "{}", "raw_data": "{}", **changes,
    }
    schema = ", ".join(f"{k} string" for k in row)
    return spark.createDataFrame([tuple(row.values())], schema)


@pytest.mark.parametrize(
    "changes, code",
    [
        ({"value": "NaN"}, "VALUE_INVALID"),
        ({"value": "0.99"}, "VALUE_BELOW_ONE"),
        ({"value": "1." + "1" * 19}, "DECIMAL_PRECISION"),
        ({"value": "1" * 30}, "DECIMAL_PRECISION"),
        ({"ts": "2025-01-01T00:00:10"}, "TS_INVALID"),
        ({"outcome_id": "a\u0007"}, "OUTCOME_ID_CONTROL_CHARACTER"),
        ({"raw_data": '{"a":[{"API_key":1}]}'}, "RAW_DATA_AUTH_KEY"),
        ({"raw_data": '{"\\u0070assword":1}'}, "RAW_DATA_AUTH_KEY"),
        ({"raw_data": '{"a":{"b":1,"b":2}}'}, "RAW_DATA_DUPLICATE_KEY"),
        ({"started_at": "2025-01-01T00:00:20Z"}, "START_AFTER_RESULT"),
        ({"started_at": "2025-01-01T00:00:05Z", "pre_observed_at": "2025-01-01T00:00:05Z"}, "PRE_NOT_BEFORE_START"),
    ],
)
def test_each_rule_has_its_code(spark, changes, code):
    assert store.check_outcomes(raw(spark, **changes)).first().errors == [code]


def test_a_value_that_only_looks_like_a_key_is_fine(spark):
    text = '{"a":"x\\",\\"password\\":","b":"token"}'
    assert store.check_outcomes(raw(spark, raw_data=text)).first().errors == []
    with pytest.raises(store.InvalidOutcomes):
        store.validate_outcomes(raw(spark, value="0"), strict=True)


def test_export_writes_a_manifest(spark, tmp_path):
    good, _ = store.validate_outcomes(raw(spark))
    manifest = store.export_outcomes(good, str(tmp_path / "out")).collect()
    assert sum(r.rows for r in manifest) == 1 and len(manifest[0].sha256) == 64
    with pytest.raises(Exception, match="already exists"):
        store.export_outcomes(good, str(tmp_path / "out"))


def test_ledger_version_is_checked(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"series":"s","seq":1,"event":"prediction_armed","ledger_version":2}')
    with pytest.raises(Exception, match="version"):
        ledgers.read_ledger(spark, str(tmp_path)).collect()


def test_observation_lines(spark, tmp_path):
    line = {
        "observed_at": "2025-01-01T00:00:00Z", "kind": "cdp_websocket_sent", "url": "u",
        "payload": {"bytes": 64, "sha256": "h", "format": "binary", "binary_fingerprint": {"entropy_bucket": 5.0}},
    }
    bad = [{**line, "observed_at": "2025-01-01T00:00:00"}, {**line, "kind": "other"}]
    lines = [json.dumps(x) for x in (line, line, *bad)] + ["not json"]
    (tmp_path / "o.jsonl").write_text("\n".join(lines))
    rows = observations.read_observations(spark, str(tmp_path)).collect()
    assert [(r.direction, r.socket, r.entropy) for r in rows] == [("sent", "u", 5.0)]


# --- time ------------------------------------------------------------------------------------


def test_an_observation_at_an_outcome_belongs_to_the_interval_it_ends(spark):
    obs = frame(spark, [(0, 64), (1, 64), (1.5, 64), (3, 64)]).select("series", "ts", "obs_id")
    rows = temporal.assign_interval(series_of(spark, [1, 2, 3]), obs).orderBy("obs_id").collect()
    assert [(r.obs_id, r.target_id) for r in rows] == [("x0001", "o0001"), ("x0002", "o0002")]


def test_gaps_of_frame_classes(spark):
    obs = frame(spark, [(0, 80), (0.1, 82), (0.2, 84), (1, 600), (3, 620)])
    rows = {r.size_band: (r.events, r.median_gap_ms) for r in profile.frame_classes(obs).collect()}
    assert rows == {"64-127": (3, 100.0), "512-1023": (2, 2000.0)}


def test_marker_enrichment_finds_the_rare_class(spark):
    background = [(i / 10, 80) for i in range(100)]
    obs = frame(spark, [*background, (2.1, 600), (6.1, 600)])
    marks = spark.createDataFrame(
        [("s", at(2), "m1", "start"), ("s", at(6), "m2", "start")],
        "series string, ts timestamp, marker_id string, event string",
    )
    rows = {r.frame_class: r for r in profile.marker_class_enrichment(obs, marks, 0.25).collect()}
    rare = rows["received:512-1023"]
    assert (rare.hits, rare.hit_rate, rare.median_nearest_offset_ms) == (2, 1.0, 100.0) and rare.enrichment > 5
    counts = profile.marker_correlation(frame(spark, [(0.5, 80), (10, 80)]), marks.limit(1).withColumn("ts", F.lit(START)), 1.0)
    assert [r.nearby_frames for r in counts.collect()] == [1]


def test_state_sample_ends_at_its_cutoff(spark):
    outcomes = series_of(spark, [2] * 20 + [3], 1.0)
    outcomes = outcomes.withColumn("ts", F.when(F.col("outcome_id") == "o0020", F.lit(at(29))).otherwise(F.col("ts")))
    obs = frame(spark, [(18, 64), (18.5, 64), (19, 64), (24, 64)])
    rows = features.state_samples_at_outcome(outcomes, obs, (2.0, 8.0)).collect()
    assert len(rows) == 1 and rows[0].window_events == 3 and rows[0].target_index == 20
    assert rows[0].state[0] == pytest.approx(1.3862943611198906)  # ln(1 + 3) in (17, 19]


# --- snapshots -------------------------------------------------------------------------------


def snapshot(seconds, values, live=None):
    chips = [(str(v), 50 * i, 50, 40, 20) for i, v in enumerate(values)]
    return ("s", at(seconds), f"n{seconds:05}", "u", 1, chips + ([(live, 0, 700, 120, 50)] if live else []))


def snapshots_of(spark, rows):
    item = "struct<multiplier:string,x_bucket:int,y_bucket:int,width_bucket:int,height_bucket:int>"
    return spark.createDataFrame(
        rows, f"series string, ts timestamp, snap_id string, url string, canvas_count int, candidates array<{item}>"
    )


def test_strips_give_outcomes_and_onsets(spark):
    old = ["1.10", "4.20", "1.50", "9.00", "2.20", "1.01", "3.30"]
    one, two = ["2.00", *old[:-1]], ["3.00", "2.00", *old[:-2]]
    shots = snapshots_of(spark, [snapshot(0, old), snapshot(10, one), snapshot(15, one, "1.03"), snapshot(30, two)])
    found = snapshots.strip_insertions(shots)
    assert [(r.value, r.edge) for r in found.orderBy("ts").collect()] == [("2.00", "left"), ("3.00", "left")]
    onsets = snapshots.infer_onsets(snapshots.completed_boundaries(found), snapshots.live_reading(shots)).collect()
    assert [(r.seconds_after_previous, r.seconds_before_target) for r in onsets] == [(5.0, 15.0)]
    assert snapshots.strip_insertions(snapshots_of(spark, [snapshot(0, old), snapshot(1, old)])).count() == 0


# --- triggers and leaks ------------------------------------------------------------------------


def onset_world(spark, n=10):
    outcomes = series_of(spark, [1 + i % 5 for i in range(n + 1)], 20.0)
    onsets = spark.createDataFrame(
        [("s", at(20 * i), at(20 * i + 20), at(20 * i + 10)) for i in range(n)],
        "series string, prev_ts timestamp, target_ts timestamp, onset_ts timestamp",
    )
    return outcomes, onsets


def test_the_frame_before_onsets_is_found_and_applied(spark):
    outcomes, onsets = onset_world(spark)
    rows = [(20 * i + s, size) for i in range(10) for s, size in ((2, 64), (4, 64), (9.2, 256))]
    from tidemark.functions.columns import observation_signature

    obs = frame(spark, rows).withColumn("signature", observation_signature())
    best = triggers.discover_triggers(onsets, obs).orderBy("rank").first()
    assert "256-511" in best.signature and best.median_lead_seconds == 0.8 and best.discovery_onsets == 5
    late = triggers.rank_onsets(onsets, 0.55).where("not discovery")
    fired = triggers.apply_triggers(late, obs, triggers.discover_triggers(onsets, obs)).collect()
    assert len(fired) == 5 and {(r.lead_seconds, r.age_seconds) for r in fired} == {(0.8, 9.2)}


def fields_of(spark, rows):
    return spark.createDataFrame(
        [("s", f"f{i}", at(t), "response", "u", "", i, p, v, None) for i, (t, p, v) in enumerate(rows)],
        "series string, obs_id string, ts timestamp, obs_kind string, url string, payload_sha256 string, "
        "field_no int, path string, number double, identifier string",
    )


def test_a_field_that_names_the_outcome_early_is_flagged(spark):
    outcomes, onsets = onset_world(spark, 1)
    outcomes = outcomes.withColumn("value", F.lit("2.5").cast("decimal(18,6)"))
    row = leaks.exact_match_leak_audit(outcomes, onsets, fields_of(spark, [(5, "data.nextMultiplier", 2.5)])).first()
    assert (row.exact_matches_ge_5s, row.exact_matches_before_onset, row.outcome_like_path) == (1, 1, True)
    assert row.verdict == "POTENTIAL_PRESTART_DISCLOSURE"


def test_last_match_audit_and_echo(spark):
    outcomes, onsets = onset_world(spark, 5)
    early = fields_of(spark, [(20 * i + 3, "next", 1.0 + (i + 1) % 5) for i in range(5)])
    row = leaks.any_last_match_audit(outcomes, onsets, early).first()
    assert (row.rounds_observed, float(row.last_match_rate), row.severity) == (5, 1.0, "DIRECT_LEAK_CANDIDATE")
    assert float(row.minimum_last_lead_seconds) >= 5

    def event_rows(shift):
        made = [
            ("s", f"e{i}", at(20 * i + 3), [("m", "numeric", 1.0 + (i + shift) % 5, None, None)], [])
            for i in range(5)
        ]
        field = "struct<path:string,kind:string,value:double,sha256_24:string,length:int>"
        return spark.createDataFrame(
            made, f"series string, obs_id string, ts timestamp, fields array<{field}>, "
            "categories array<struct<path:string,value:string>>",
        )

    told = leaks.disclosure_audit(outcomes, onsets, event_rows(1)).first()
    echo = leaks.disclosure_audit(outcomes, onsets, event_rows(0)).first()
    assert told.verdict == "CANDIDATE_PRE_ROUND_DISCLOSURE" and echo.verdict == "NO_DIRECT_DISCLOSURE"


# --- ledger ------------------------------------------------------------------------------------


def test_live_audit_values(spark):
    def lock(i, chosen, base, raw):
        return {
            "event": "prediction_locked", "lock_id": f"l{i}", "threshold_probabilities": {"2": chosen},
            "threshold_model_details": {"2": {"source": "gated_logistic_challenger", "baseline_probability": base, "raw_candidate_probability": raw}},
        }

    def score(i, value):
        return {"event": "prediction_scored", "lock_id": f"l{i}", "actual_multiplier": value}

    events = [
        lock(1, "0.80", "0.60", "0.90"), score(1, "3.0"), lock(2, "0.20", "0.40", "0.10"), score(2, "1.1"),
        lock(3, "0.5", "0.5", "0.5"), {"event": "prediction_invalidated", "lock_id": "l3"}, score(3, "9"),
        {"event": "prediction_gap", "unpredicted_rounds": 2}, lock(4, "0.5", "0.5", "0.5"),
    ]
    lines = [json.dumps({"series": "s", "seq": i, "ledger_version": 1, **e}) for i, e in enumerate(events)]
    from tidemark.schemas import FORECAST_LEDGER

    rows = spark.read.schema(FORECAST_LEDGER).json(spark.sparkContext.parallelize(lines))
    row = ledger.live_forecast_audit(rows).first()
    assert [float(x) for x in (row.mean_chosen_brier, row.mean_baseline_brier, row.mean_raw_candidate_brier)] == [0.04, 0.16, 0.01]
    assert (row.chosen_skill_vs_baseline_pct, row.raw_candidate_skill_vs_baseline_pct, float(row.calibration_gap)) == (75, 93.75, 0)
    totals = ledger.performance_summary(rows).first()
    assert (totals.scored_locks, totals.invalidated_locks, totals.unpredicted_outcomes) == (2, 1, 2)
    assert ledger.open_locks(rows).first().lock_id == "l4"


# --- causality and order -------------------------------------------------------------------------

VALUES = [1 + ((i * 37) % 91) / 10 for i in range(60)]


@pytest.mark.parametrize(
    "operator",
    [
        lambda df: features.lag_log_features(df).drop("value"),
        lambda df: features.regime_features(df).drop("value"),
        lambda df: features.recent_median(df).drop("value"),
        lambda df: features.ewma(df).drop("value"),
        lambda df: features.prefix_counts(df).drop("value"),
        lambda df: forecast.frequency_forecast(df, min_history=5).drop("value", "actual"),
    ],
)
def test_the_future_does_not_change_the_past(spark, operator):
    changed = VALUES[:40] + [99.0] * 20
    cut = F.col("ts") <= F.lit(at(40))

    def past(values):
        return sorted(map(str, operator(series_of(spark, values)).where(cut).collect()))

    assert past(VALUES) == past(changed)


def test_input_order_does_not_matter(spark):
    df = series_of(spark, VALUES).withColumn("ts", F.date_trunc("minute", "ts"))  # many ties
    one = sorted(map(str, features.regime_features(df).collect()))
    two = sorted(map(str, features.regime_features(df.orderBy(F.rand(3)).repartition(5)).collect()))
    assert one == two


def test_plans_have_no_nested_loops(spark):
    outcomes = series_of(spark, VALUES)
    obs = frame(spark, [(i, 64) for i in range(50)])
    plans = [
        temporal.assign_interval(outcomes, obs.select("series", "ts", "obs_id")),
        temporal.trailing_window_join(outcomes, obs, 5.0),
        features.window_state_features(outcomes.withColumn("cutoff", F.col("ts")), obs, (2.0, 8.0), ["outcome_id", "cutoff"]),
        features.signature_sequence(
            outcomes.select("series", F.col("ts").alias("prev_ts"), F.col("ts").alias("target_ts"), F.col("ts").alias("trigger_ts")), obs
        ),
    ]
    for df in plans:
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in text and "CartesianProduct" not in text


@pytest.mark.parametrize("small", [True, False])
def test_medians_of_decimals_keep_every_digit(spark, small):
    from decimal import Decimal

    from tidemark.plans.quantiles import medians

    rows = [("a", "12345678901234567.25"), ("b", "1.000001"), ("b", "1.000002"), ("c", "3"), ("c", "12345678901234567.250001"), ("c", "12345678901234567.250002"), ("d", None)]
    df = spark.createDataFrame(rows, "g string, t string").select("g", F.col("t").cast("decimal(24,6)").alias("v"), F.col("t").cast("decimal(38,18)").alias("w"))
    got = {r.g: (r.m, r.k) for r in medians(df, ["g"], {"m": F.col("v"), "k": F.col("w")}, small).collect()}
    assert got["a"] == (Decimal("12345678901234567.25"),) * 2
    assert got["b"] == (Decimal("1.0000015"),) * 2
    assert got["c"] == (Decimal("12345678901234567.250001"),) * 2
    assert got.get("d") in (None, (None, None))


def test_fingerprints_are_trees(spark, whole):
    import hashlib

    from tidemark.sources.outcomes import dataset_fingerprint

    def digest(parts):
        return hashlib.sha256(",".join(parts).encode()).hexdigest()

    values = [f"{i}.5" for i in range(1, 48)]
    got = {n: dataset_fingerprint(series_of(spark, values), 5, n).first() for n in (3, 4096)}
    chunks = [digest(values[a : a + 5]) for a in range(0, 47, 5)]
    assert (got[4096].outcomes, got[4096].fingerprint) == (47, digest(chunks))
    assert got[3].fingerprint == digest([digest(chunks[a : a + 3]) for a in range(0, 10, 3)])


def test_marker_enrichment_beyond_a_task_forms_no_shuffled_pairs(spark, monkeypatch):
    """Many places in few bins, in parts, give what one task gives; pairs of marker and class stay behind the exchange."""
    from tidemark.plans import ordering

    obs = frame(spark, [(i / 7 % 60, 40 + i % 3 * 300) for i in range(600)]).withColumn("ts", F.timestamp_micros(F.unix_micros("ts") + F.crc32("obs_id") % 977))
    marks = spark.range(300).selectExpr(
        "'s' AS series", f"timestamp_micros({int(at(0).timestamp() * 1e6)} + id * id % 60000 * 1000) AS ts",
        "CAST(id % 290 AS STRING) AS marker_id", "IF(id % 2 = 0, 'start', 'finish') AS event",
    )
    ask = lambda: sorted(map(str, profile.marker_class_enrichment(obs, marks, 0.7).collect()))
    few = ask()
    monkeypatch.setattr(profile, "fits_one_task", lambda df: False)
    monkeypatch.setattr(profile, "PART_PAIRS", 50)
    spark.conf.set(ordering.TASK_ROWS_CONF, "100")
    try:
        many = ask()
    finally:
        spark.conf.unset(ordering.TASK_ROWS_CONF)
    assert many == few and len(few) == 6
    near = profile.nearest_offsets(profile._labelled(obs).select("series", "us", "url", "frame_class"), marks, 0.7, ["url", "frame_class"], True)
    plan = near._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Generate explode(_classes")]
    assert "Exchange" not in above

"""Streams: replay equality, gaps, arming, heartbeats, triggers, idempotent sinks."""

import json
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ledger
from tidemark.sources import ledgers
from tidemark.sources.outcomes import OUTCOME_COLUMNS, OutcomeConflict
from tidemark.streaming import ingest, locks

BASE = 1_700_000_000_000_000


def run(spark, tmp_path, batches, build):
    """Feed lists of messages as one micro-batch each; return the ledger in order."""
    folder, out = tmp_path / "in", tmp_path / "ledger"
    folder.mkdir()
    columns = [p.split()[0] for p in locks.MESSAGE.split(", ")]
    for i, batch in enumerate(batches):
        lines = [json.dumps({c: m.get(c) for c in columns}) for m in batch]
        path = folder / f"{i:03d}.json"
        path.write_text("\n".join(lines))
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = (
        spark.readStream.schema(locks.MESSAGE).option("maxFilesPerTrigger", 1).json(str(folder))
    )
    query = (
        build(stream).writeStream.foreachBatch(ingest.ledger_sink(str(out)))
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination(240)
    rows = spark.read.json(str(out)).orderBy("series", "seq").collect()
    return [r.asDict(recursive=True) for r in rows]


def outcome(i, value, series="a"):
    return {"series": series, "kind": "outcome", "us": BASE + i * 10_000_000, "id": f"o{i}", "value": str(value)}


def beat(i, session, ready=True):
    return {"series": "a", "kind": "heartbeat", "us": BASE + i * 10_000_000 + 1, "session": session, "ready": ready}


VALUES = [1.2, 2.0, 6.0, 3.0, 1.1]


def test_each_outcome_scores_the_lock_before_it(spark, tmp_path):
    batches = [[outcome(i, v)] for i, v in enumerate(VALUES)]
    rows = run(spark, tmp_path, batches, lambda s: locks.lock_and_score(s, min_history=2))
    assert [r["event"] for r in rows] == ["prediction_locked"] + ["prediction_scored", "prediction_locked"] * 4
    assert rows[-1]["probabilities"] == {"1.5": "0.600000", "2": "0.600000", "5": "0.200000"}
    scored = [r for r in rows if r["event"] == "prediction_scored"]
    # 3 of 4 earlier values are at least 1.5; the last one is not.
    assert scored[-1]["briers"]["1.5"] == "0.562500"
    assert scored[0].get("briers", {}).get("1.5") is None  # one outcome is too little history


def test_several_outcomes_in_one_batch_leave_a_gap(spark, tmp_path):
    batches = [[outcome(0, 2)], [outcome(1, 3), outcome(2, 4), outcome(3, 5)]]
    rows = run(spark, tmp_path, batches, lambda s: locks.lock_and_score(s, min_history=1))
    assert [r["event"] for r in rows] == [
        "prediction_locked", "prediction_scored", "prediction_gap", "prediction_locked",
    ]
    assert rows[1]["actual_id"] == "o1" and rows[2]["unpredicted"] == 2
    assert rows[3]["history_count"] == 4


def test_sessions_arm_and_invalidate(spark, tmp_path):
    batches = [
        [outcome(0, 2)], [beat(1, "s1")], [outcome(2, 3)], [beat(3, "s2")], [outcome(4, 3)],
        [beat(5, "s2", False)],
    ]
    rows = run(
        spark, tmp_path, batches,
        lambda s: locks.lock_and_score(s, min_history=1, sessions=True, stale_seconds=3600),
    )
    assert [(r["event"], r.get("reason")) for r in rows] == [
        ("prediction_armed", "await_fresh_outcome"),
        ("prediction_locked", None),
        ("prediction_invalidated", "collector_session_changed"),
        ("prediction_armed", "await_fresh_outcome"),
        ("prediction_locked", None),
        ("prediction_invalidated", "collector_heartbeat_missing_or_stale"),
    ]


def test_triggers_lock_score_and_miss(spark, tmp_path):
    def seen(i, at, token="t"):
        return {
            "series": "a", "kind": "observation", "us": BASE + i * 10_000_000 + at, "id": f"x{i}-{at}",
            "signature": token, "direction": "received", "payload_format": "binary", "payload_bytes": 64,
        }

    frozen = {"series": "a", "kind": "signatures", "us": BASE, "scores": json.dumps({"t": 0.5})}
    batches = [
        [frozen, outcome(0, 2)],
        [seen(0, 500_000), seen(0, 900_000, "u"), seen(0, 2_000_000), seen(0, 3_000_000)],
        [outcome(1, 3)],
        [outcome(2, 1.2)],
        [outcome(3, 2), outcome(4, 2)],
    ]
    rows = run(spark, tmp_path, batches, lambda s: locks.trigger_locks(s))
    kinds = [r["event"] for r in rows]
    ready = ["prospective_boundary_ready", "pre_round_prior_forecast"]
    assert kinds == [
        *ready, "pre_round_snapshot_locked", "pre_round_snapshot_scored", *ready,
        "pre_round_snapshot_missed", *ready, "pre_round_snapshot_missed", *ready,
        "pre_round_snapshot_missed", *ready,
    ]
    lock = rows[2]
    features = json.loads(lock["features"])
    # The early match is too young; the lock comes at two seconds with what was seen so far.
    assert lock["trigger_age_seconds"] == 2.0 and features["event_count_since_previous"] == 3
    assert features["transition_counts"] == {"t -> u": 1, "u -> t": 1}
    assert rows[3]["briers"] == {"1.5": "0.000000", "2": "0.000000", "5": "0.000000"}


def test_outcome_sink_is_idempotent_and_refuses_conflicts(spark, tmp_path, whole):
    rows = spark.createDataFrame(
        [("s", f"{i}", str(1 + i), f"2025-01-01 00:00:0{i}") for i in range(4)],
        "series string, outcome_id string, value string, ts string",
    ).select(
        "series", "outcome_id", F.col("value").cast("decimal(38,18)").alias("value"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("ts").cast("timestamp").alias("collection_ts"),
        F.lit(None).cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("pre_observed_at"),
        *[F.lit("{}").alias(n) for n in ("pre_data", "post_data", "raw_data")],
    ).select(*OUTCOME_COLUMNS)
    table, results = str(tmp_path / "t"), []
    sink = ingest.outcome_sink(table, results)
    sink(rows, 0)
    sink(rows.unionByName(rows), 1)
    assert [(r.inserted, r.duplicates) for r in results] == [(4, 0), (0, 8)]
    other = rows.withColumn("value", (F.col("value") + 1).cast("decimal(38,18)"))
    with pytest.raises(OutcomeConflict):
        sink(other, 2)
    assert spark.read.parquet(table).count() == 4


def test_stream_of_outcomes_drops_replays(spark, tmp_path, whole):
    folder = tmp_path / "in"
    folder.mkdir()
    line = {
        "series": "s", "outcome_id": "1", "value": 2.5, "ts": "2025-01-01T00:00:00Z",
        "collection_ts": "2025-01-01T00:00:01Z", "pre_data": "{}", "post_data": "{}", "raw_data": "{}",
    }
    for i in range(3):
        (folder / f"{i}.json").write_text(json.dumps(line))
    stream = ingest.distinct_outcomes(ingest.stream_outcomes(spark, str(folder), 1))
    query = (
        stream.writeStream.foreachBatch(ingest.outcome_sink(str(tmp_path / "t")))
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination(240)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1


def test_the_gate_lets_a_proven_candidate_through():
    """Without Spark: after sixteen scored locks the better candidate replaces the prior."""
    from types import SimpleNamespace

    machine = locks.TriggerLocks(("2", "5"), 5.0, False, False, 0.0)
    machine.cell = SimpleNamespace(exists=lambda: False)
    state = machine.load()
    state["frozen"] = {"t": 1.0}

    def step(i, value):
        events = machine.advance(state, [
            SimpleNamespace(kind="outcome", us=i * 1_000_000, id=f"o{i}", value=str(value)),
            SimpleNamespace(
                kind="observation", us=i * 1_000_000 + 500_000, id=f"x{i}", signature="t",
                direction="sent", payload_format="text", payload_bytes=1,
            ),
        ], None)
        return [e for e in events if e["event"] == "pre_round_snapshot_locked"][0]

    for i in range(300):
        step(i, 1)  # a long history of misses keeps the prior low
    state["cohorts"] = {"": machine.empty()}
    state["lock"] = None
    first = step(300, 1)
    assert first["probabilities"] == first["historical_probabilities"]
    for i in range(301, 330):
        last = step(i, 3)  # then every trigger is followed by a hit at 2
    assert last["probabilities"]["2"] == last["candidate_probabilities"]["2"] > last["historical_probabilities"]["2"]
    assert last["probabilities"]["5"] == last["historical_probabilities"]["5"]


def test_replayed_and_late_outcomes_are_counted_not_scored(spark, tmp_path):
    batches = [
        [outcome(0, 1.2), outcome(1, 2.0)],
        [outcome(1, 2.0)],  # the reference of the open lock, again
        [outcome(0, 1.2), outcome(1, 2.0)],
        [outcome(2, 6.0), outcome(2, 6.0), outcome(1, 2.0)],
    ]
    rows = run(spark, tmp_path, batches, lambda s: locks.lock_and_score(s, min_history=2))
    assert [r["event"] for r in rows] == [
        "prediction_locked", "outcomes_ignored", "outcomes_ignored", "outcomes_ignored",
        "prediction_scored", "prediction_locked",
    ]
    assert [r["unpredicted"] for r in rows if r["event"] == "outcomes_ignored"] == [1, 2, 2]
    assert rows[4]["actual_id"] == "o2" and rows[5]["history_count"] == 3


def test_outcomes_that_arrive_with_a_score_only_arm(spark, tmp_path):
    def seen(i, at):
        return {
            "series": "a", "kind": "observation", "us": BASE + i * 10_000_000 + at, "id": f"x{i}",
            "signature": "t", "direction": "received", "payload_format": "binary", "payload_bytes": 64,
        }

    frozen = {"series": "a", "kind": "signatures", "us": BASE, "scores": json.dumps({"t": 0.5})}
    batches = [
        [frozen, outcome(0, 2)],
        [seen(0, 3_000_000)],
        [outcome(1, 3), outcome(2, 1.2), outcome(3, 4)],
        [outcome(4, 2)],
    ]
    rows = run(spark, tmp_path, batches, lambda s: locks.trigger_locks(s))
    ready = ["prospective_boundary_ready", "pre_round_prior_forecast"]
    assert [r["event"] for r in rows] == [
        *ready, "pre_round_snapshot_locked", "pre_round_snapshot_scored", "prospective_capture_armed", *ready,
    ]
    assert rows[4]["history_count"] == 4 and rows[4]["reference_id"] == "o3"


def test_a_second_stream_replaces_no_ledger_rows(spark, tmp_path):
    rows = run(spark, tmp_path, [[outcome(0, 1.2)], [outcome(1, 2)]], lambda s: locks.lock_and_score(s, min_history=1))
    stream = spark.readStream.schema(locks.MESSAGE).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    again = (
        locks.lock_and_score(stream, min_history=1).writeStream.foreachBatch(ingest.ledger_sink(str(tmp_path / "ledger")))
        .option("checkpointLocation", str(tmp_path / "other")).trigger(availableNow=True).start()
    )
    again.awaitTermination(240)
    assert spark.read.json(str(tmp_path / "ledger")).count() == 2 * len(rows)


def test_batch_audits_read_streamed_forecasts(spark, tmp_path):
    batches = [[outcome(i, v)] for i, v in enumerate(VALUES)]
    run(spark, tmp_path, batches, lambda s: locks.lock_and_score(s, min_history=1))
    found = ledgers.read_ledger(spark, str(tmp_path / "ledger"))
    pairs = ledger.lock_score_pairing(found).orderBy("scored_seq").collect()
    assert [float(p.actual) for p in pairs] == VALUES[1:]
    # Before 2.0, 6.0, 3.0 and 1.1 the shares of values from 2 on are 0, 1/2, 2/3 and 3/4.
    audit = {float(r.threshold): r for r in ledger.live_forecast_audit(found).collect()}
    losses = [1.0, 0.25, 0.333333**2, 0.5625]
    scored = ledger.score_forecasts(ledger.lock_score_pairing(found)).where("threshold = 2").orderBy("scored_seq")
    assert [float(r.chosen_brier) for r in scored.collect()] == pytest.approx(losses, abs=1e-5)
    assert set(audit) == {1.5, 2.0, 5.0}
    assert [r.lock_id for r in ledger.open_locks(found).collect()] not in ([], [None])


def test_batch_samples_read_streamed_snapshots(spark, tmp_path):
    def seen(i, at, signature):
        return {
            "series": "a", "kind": "observation", "us": BASE + i * 10_000_000 + at, "id": f"x{i}{at}",
            "signature": signature, "direction": "received", "payload_format": "binary", "payload_bytes": 64,
        }

    frozen = {"series": "a", "kind": "signatures", "us": BASE, "scores": json.dumps({"t": 0.5})}
    batches = [[frozen, outcome(0, 2)], [seen(0, 2_000_000, "u"), seen(0, 3_000_000, "t")], [outcome(1, 3)]]
    run(spark, tmp_path, batches, lambda s: locks.trigger_locks(s))
    found = ledgers.read_snapshot_ledger(spark, str(tmp_path / "ledger"))
    lock = found.where("event = 'pre_round_snapshot_locked'").first()
    assert lock.features.event_count_since_previous == 2 and lock.features.transition_counts == {"u -> t": 1}
    assert lock.previous_round_id == "o0" and lock.trigger_age_after_previous_seconds == 3.0
    samples = ledger.snapshot_samples(found, ("1.5", "2", "5")).collect()
    assert [(r.actual, r.trigger_signature, r.priors) for r in samples] == [(3.0, "t", [1.0, 1.0, 0.0])]


@pytest.mark.parametrize("window", [None, 60])
def test_streamed_locks_equal_batch_forecasts(spark, tmp_path, whole, window):
    """Every lock of a replay carries what the batch operators say of the history before it."""
    from tidemark.operators import forecast, logistic, ridge

    rng = random.Random(4)
    values, level = [], 0.0
    for i in range(190):  # a series whose past tells something
        level = 0.9 * level + rng.gauss(0, 0.5)
        values.append(f"{1 + math.exp(level + rng.gauss(0, 0.3)):.2f}")
    cuts = [1, 10, 22, 24, 27, 40, 139, 140, 165, 190]
    batches = [[outcome(i, values[i]) for i in range(a, b)] for a, b in zip([0, *cuts], cuts)]
    rows = run(spark, tmp_path, batches, lambda s: locks.lock_and_score(s, min_history=20, window=window))
    found = {r["history_count"]: r for r in rows if r["event"] == "prediction_locked"}
    assert sorted(found) == cuts
    table = spark.createDataFrame([("a", f"o{i}", BASE + i * 10_000_000, v) for i, v in enumerate(values)], "series string, outcome_id string, us bigint, v string")
    table = table.select("series", "outcome_id", F.timestamp_micros("us").alias("ts"), F.col("v").cast("decimal(18,6)").alias("value"), "us")
    sources = set()
    for n in cuts:
        past, lock = table.where(F.col("us") < BASE + n * 10_000_000).drop("us"), found[n]
        want = {f"{r.threshold:g}": r for r in logistic.gated_logistic_forecast(past, min_history=20, window=window).collect()}
        for t, r in want.items():
            told, p = lock["details"][t], lock["probabilities"].get(t)
            assert (told["source"], told["reason"]) == (r.source, r.reason)
            assert (p is None) == (r.probability is None) and float(p or 0) == pytest.approx(r.probability or 0, abs=1e-6)
            assert float(told.get("raw_candidate_probability") or 0) == pytest.approx(r.raw_candidate_probability or 0, abs=1e-6)
            sources.add(r.source)
        point = ridge.point_forecast(forecast.with_next(past)).where("outcome_id is null").first()
        told = json.loads(lock["point"])
        if n >= 20:
            assert (told["status"], told["validation_rows"]) == (point.status, point.validation_rows)
            assert float(lock.get("predicted") or 0) == pytest.approx(point.predicted or 0, abs=0.011)
            if point.predicted:
                assert [float(lock["interval"][k]) for k in ("lower", "upper")] == pytest.approx([point.lower, point.upper], abs=0.011)
                assert told["components"] == pytest.approx(point.components, abs=1e-5) and told["regime"] == point.regime
        else:
            assert point is None and told["status"] == "INSUFFICIENT_DATA"
    assert sources == {"historical_baseline", "gated_logistic_challenger"}
    last = [r for r in rows if r["event"] == "prediction_scored"][-1]
    miss = abs(float(found[165]["predicted"]) - float(values[165]))
    assert float(last["point_score"]["absolute_error"]) == pytest.approx(miss, abs=1e-9)
    ledger_rows = ledgers.read_ledger(spark, str(tmp_path / "ledger"))
    scored = ledger.score_forecasts(ledger.lock_score_pairing(ledger_rows)).where("scored_seq = %d and threshold = 2" % last["seq"]).first()
    assert float(scored.absolute_error) == pytest.approx(miss, abs=1e-9) and scored.within_interval == last["point_score"]["within_interval"]
    assert scored.source == found[165]["details"]["2"]["source"]


def test_a_refresh_is_applied_once(spark, tmp_path):
    """Eight misses ask for new signatures; a rerun of the batch that answered changes nothing."""
    folder, control, out = tmp_path / "in", tmp_path / "control", str(tmp_path / "ledger")
    folder.mkdir()
    control.mkdir()
    columns = [p.split()[0] for p in locks.MESSAGE.split(", ")]
    asked, batches = [], []

    def discover():
        asked.append(1)
        return spark.createDataFrame([("a", json.dumps({"new": 0.9}))], "series string, scores string")

    sink = locks.refresh_sink(out, str(control), discover)

    def write(batch, batch_id):
        if batch_id in batches:
            return
        sink(batch, batch_id)
        if not batch.where("event = 'trigger_refresh_wanted'").isEmpty():
            sink(batch, batch_id)  # as after a failure behind the write
            batches.append(batch_id)

    def feed(name, *polls):
        for i, rows in enumerate(polls):
            path = folder / f"{name}-{i}.json"
            path.write_text("\n".join(json.dumps({c: m.get(c) for c in columns}) for m in rows))
            os.utime(path, (1_700_000_000 + 100 * int(name) + i,) * 2)
        main = spark.readStream.schema(locks.MESSAGE).option("maxFilesPerTrigger", 1).json(str(folder))
        stream = main.unionByName(locks.messages(signatures=locks.stream_signatures(spark, str(control))))
        query = (
            locks.trigger_locks(stream, min_age_seconds=0.0).writeStream.foreachBatch(write)
            .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        )
        query.awaitTermination(240)
        return [r.asDict(recursive=True) for r in spark.read.json(out).orderBy("seq").collect()]

    frozen = {"series": "a", "kind": "signatures", "us": BASE, "scores": json.dumps({"old": 0.5})}
    rows = feed("0", [frozen, outcome(0, 2)], *[[outcome(i, 2)] for i in range(1, 9)])
    assert [r["event"] for r in rows].count("trigger_refresh_wanted") == 1 and len(asked) == 2
    seen = {
        "series": "a", "kind": "observation", "us": BASE + 8 * 10_000_000 + 1_000_000, "id": "x", "signature": "new",
        "direction": "sent", "payload_format": "text", "payload_bytes": 1,
    }
    rows = feed("1", [seen])
    found = [r for r in rows if r["event"] in ("trigger_regime_refreshed", "pre_round_snapshot_locked")]
    assert [r["event"] for r in found] == ["trigger_regime_refreshed", "pre_round_snapshot_locked"]
    assert found[1]["trigger_signature"] == "new" and found[1]["trigger_score"] == 0.9
    # The control rows are written once more, under new file names.
    spark.read.json(str(control), locks.CONTROL, recursiveFileLookup=True).write.mode("append").json(str(control / "again"))
    rows = feed("2", [outcome(9, 2)])
    assert [r["event"] for r in rows].count("trigger_regime_refreshed") == 1
    assert rows[-1]["event"] == "pre_round_prior_forecast" and "pre_round_snapshot_scored" in [r["event"] for r in rows]


@pytest.mark.parametrize("cuts", [[1, 2, 3, 4, 5, 6, 7], [3, 7], [7]])
def test_sessions_become_stale_in_the_time_of_rows(spark, tmp_path, cuts):
    """The same ledger, whatever the batches; the last session ends when others' rows pass it."""
    rows = [beat(0, "s1"), outcome(1, 2), beat(1, "s1"), outcome(4, 3), outcome(5, 3), beat(6, "s2"), outcome(7, 2)]
    rows = [r | {"series": "a"} for r in rows]
    later = [[outcome(i, 2, "b")] for i in (20, 21, 22)]
    batches = [rows[a:b] for a, b in zip([0, *cuts], cuts)] + later
    found = run(
        spark, tmp_path, batches,
        lambda s: locks.lock_and_score(s, min_history=1, sessions=True, stale_seconds=15.0, watermark="1 second"),
    )
    mine = [(r["event"], (r["us"] - BASE) / 1e7, r.get("reason"), r["history_count"] if "history_count" in r else None) for r in found if r["series"] == "a"]
    assert mine == [
        ("prediction_armed", pytest.approx(0.0, abs=1e-3), "await_fresh_outcome", 0),
        ("prediction_locked", 1.0, None, 1),
        ("prediction_invalidated", pytest.approx(2.5, abs=1e-3), "collector_heartbeat_missing_or_stale", None),
        ("prediction_armed", pytest.approx(6.0, abs=1e-3), "await_fresh_outcome", 3),
        ("prediction_locked", 7.0, None, 4),
        ("prediction_invalidated", pytest.approx(7.5, abs=1e-3), "collector_heartbeat_missing_or_stale", None),
    ]

"""Lines of growing files, and state features of live windows."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.features import STATE_FEATURES, window_state_features
from tidemark.streaming import ingest, tail


class Bytes:
    """A file in memory, as the reader sees it."""

    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at : at + n]


@pytest.mark.parametrize("seed", range(30))
def test_parts_have_each_line_once(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(tail, "PIECE_BYTES", rng.randrange(1, 9))
    data = b"\n".join(bytes([97 + rng.randrange(3)]) * rng.randrange(6) for _ in range(rng.randrange(1, 12)))
    whole = tail.whole_bytes(Bytes(data), len(data))
    assert whole == data.rfind(b"\n") + 1
    reader = tail.TailReader("", rng.randrange(1, 10))
    cuts = sorted({0, whole, *[i + 1 for i in range(whole) if data[i : i + 1] == b"\n" and rng.random() < 0.3]})
    got = []
    for a, b in zip(cuts, cuts[1:]):
        for part in reader.partitions({"f": a}, {"f": b}):
            got += tail.lines(Bytes(data), part.first, part.start, part.end)
    at, want = 0, []
    for line in data[:whole].split(b"\n")[:-1]:
        want.append((at, line))
        at += len(line) + 1
    assert got == want


def test_a_shorter_file_is_read_anew():
    parts = tail.TailReader("", 100).partitions({"f": 50, "g": 10, "h": 7}, {"f": 20, "g": 10, "new": 150})
    assert [(p.file, p.first, p.start, p.end) for p in parts] == [("f", 0, 0, 20), ("new", 0, 0, 100), ("new", 0, 100, 150)]


def test_growing_lines_arrive_once(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()

    def line(i):
        frame = {"bytes": i, "format": "json"}
        return json.dumps({"series": "s", "observed_at": f"2025-01-01T00:00:{i:02d}.000000Z", "kind": "cdp_websocket_sent", "payload": frame})

    def run():
        rows = ingest.tail_observations(spark, str(folder)).select("payload_bytes", "direction", F.unix_micros("ts").alias("us"))
        query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(240)
        return sorted(r.payload_bytes for r in spark.read.parquet(out).collect())

    one, two = folder / "one.jsonl", folder / "two.jsonl"
    one.write_text(line(1) + "\n" + line(2) + "\n" + line(3)[:20])
    (folder / "_hidden").write_text(line(9) + "\n")
    assert run() == [1, 2]
    with one.open("a") as f:
        f.write(line(3)[20:] + "\n{broken\n" + line(4))
    two.write_bytes(b"\xff\xfe\n" + line(5).encode() + b"\r\n")
    assert run() == [1, 2, 3, 5]
    assert run() == [1, 2, 3, 5]
    two.write_text(line(6) + "\n")  # cut: another file of that name
    os.truncate(one, one.stat().st_size)
    with one.open("a") as f:
        f.write("\n")
    assert run() == [1, 2, 3, 4, 5, 6]


def test_live_windows_equal_batch_features(spark, tmp_path, whole):
    rng, base = random.Random(1), 1_700_000_000_000_000
    rows = []
    for i in range(160):
        at = base + rng.randrange(0, 40) * 500_000 + (rng.randrange(0, 3) if rng.random() < 0.5 else 0)
        binary = rng.random() < 0.6
        rows.append((
            rng.choice("ab"), f"o{i}", at, rng.choice(["sent", "received"]), "binary" if binary else "json", rng.choice([10, 200, 3000]), rng.choice(["x", "y", "z"]),
            *([rng.randrange(8) / 2, 0.25, None, 64] if binary else [None] * 4),
        ))
    names = "series string, obs_id string, us bigint, direction string, payload_format string, payload_bytes bigint, socket string, entropy double, zero_ratio double, high_bit_ratio double, unique_byte_bucket int"
    obs = spark.createDataFrame(rows, names).withColumn("ts", F.timestamp_micros("us")).drop("us")
    folder = tmp_path / "in"
    parts = [rows[:100], rows[100:], [("", "", base + i * 10**9, *[None] * 8) for i in (1,)], [("", "", base + 2 * 10**9, *[None] * 8)], [("", "", base + 3 * 10**9, *[None] * 8)]]
    for n, part in enumerate(parts):
        one = spark.createDataFrame(part, names).withColumn("ts", F.timestamp_micros("us")).drop("us")
        one.coalesce(1).write.mode("append").parquet(str(folder))
        for name in os.listdir(folder):
            path = folder / name
            if path.stat().st_mtime > 1_700_001_000:
                os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))
    stream = spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    out = str(tmp_path / "out")
    query = (
        ingest.rolling_stream_features(stream, "8 seconds", "2 seconds", "30 seconds").writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination(400)
    got = {(r.series, r.us): [r[n] for n in STATE_FEATURES] for r in spark.read.parquet(out).withColumn("us", F.unix_micros("end")).where("series <> ''").collect()}
    ends = sorted({(s, -(-us // 2_000_000) * 2_000_000 + k * 2_000_000) for s, _, us, *_ in rows for k in range(4)})
    points = spark.createDataFrame(ends, "series string, us bigint").withColumn("cutoff", F.timestamp_micros("us"))
    batch = {(r.series, r.us): r.state for r in window_state_features(points, obs, [8.0], ["us", "cutoff"]).collect()}
    assert set(got) == set(ends) == set(batch)
    for key, state in batch.items():
        assert got[key] == pytest.approx(state, abs=1e-9), key


def test_streamed_signals_equal_batch(spark, tmp_path, whole):
    """Probabilities and champions of a replay in uneven batches are those of the batch operators."""
    from tidemark.operators import online
    from tidemark.streaming import signals

    rng = random.Random(3)
    thresholds, rows = ("2", "5"), []
    for i in range(150):
        hits = [int(rng.random() < 0.5), int(rng.random() < 0.2)]
        for mode, width in (("history", 2), ("state", 3)):
            rows.append(("a", mode, i, [rng.gauss(0, 1) + (hits[0] if mode == "state" else 0) for _ in range(width)], hits))
    schema = "series string, mode string, pos bigint, x array<double>, hits array<int>"
    folder = tmp_path / "in"
    for n, (a, b) in enumerate([(0, 1), (1, 70), (60, 71), (71, 128), (128, 150)]):  # one part comes twice
        spark.createDataFrame([r for r in rows if a <= r[2] < b], schema).coalesce(1).write.mode("append").parquet(str(folder))
        for name in os.listdir(folder):
            path = folder / name
            if path.stat().st_mtime > 1_700_001_000:
                os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    out = str(tmp_path / "out")
    query = (
        signals.online_signals(stream, thresholds).writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination(240)
    got = {(r.pos, float(r.threshold)): r for r in spark.read.parquet(out).collect()}
    assert len(got) == 300 == spark.read.parquet(out).count()
    batch = online.online_rls(spark.createDataFrame(rows, schema))
    name = F.concat_ws(":ff=", F.col("mode"), F.format_number("factor", 2))
    losses = online.candidate_losses(batch, thresholds, 16, name)
    for r in losses.collect():
        assert got[r.at, float(r.threshold)].candidates[r.name] == pytest.approx(r.probability, abs=1e-12)
    for r in online.champion_selection(losses).collect():
        mine = got[r["at"], float(r.threshold)]
        assert (mine.champion, mine.mode, mine.factor, mine.actual) == (r.champion.name, r.champion["mode"], r.champion.factor, r.actual)

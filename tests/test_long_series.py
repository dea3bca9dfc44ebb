"""Locks of long series: rows stay columns, values are learned together, samples are made piece by piece."""

import json
import math
import random
from decimal import Decimal
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from tidemark.operators import logistic
from tidemark.streaming import history, locks

RNG = np.random.default_rng(7)
COLUMNS = [part.split()[0] for part in locks.MESSAGE.split(", ")]


class Cell:
    """A value state and a list state."""

    def __init__(self, body=None):
        self.body, self.items = body, []

    def exists(self):
        return self.body is not None

    def get(self):
        return self.body if self.body is not None else iter(self.items)

    def update(self, body):
        self.body = body

    def appendValue(self, item):
        self.items.append(item)


def machine(**options):
    plain = dict(min_history=50, stale_seconds=5.0, sessions=False, event_time=False, window=None, challenger=logistic.ChallengerConfig(), point=True)
    made = locks.ForecastLocks(("1.5", "2", "5"), **plain | options)
    cells = {}
    made.init(SimpleNamespace(getValueState=lambda *a: Cell(), getListState=lambda name, _: cells.setdefault(name, Cell())))
    return made


def message(i, value, us=None):
    return dict.fromkeys(COLUMNS) | {"series": "a", "kind": "outcome", "us": i if us is None else us, "id": f"o{i:07d}", "value": value}


def told(made, messages, packed=True):
    """The events of one batch, whose rows come in pieces of 1,000."""
    if not packed:
        frames = [pd.DataFrame(messages[at : at + 1000]) for at in range(0, len(messages), 1000)]
        return next(made.handleInputRows(("a",), iter(frames), None)).to_dict("records")
    batches = [pa.RecordBatch.from_pylist(messages[at : at + 1000], locks.TABLE) for at in range(0, len(messages), 1000)]
    frames = [b.to_pandas() for b in locks.pack(iter(batches))]
    return next(made.handleInputRows(("a",), iter(frames), None)).to_dict("records")


def test_a_batch_is_learned_without_a_call_for_each_row(monkeypatch):
    calls = []
    name = "regime_rows" if hasattr(history, "regime_rows") else "regime_row"
    plain = getattr(history, name)
    monkeypatch.setattr(history, name, lambda recent: calls.append(1) or plain(recent))
    values = [f"{v:.2f}" for v in 1 + RNG.exponential(2, 20_000)]
    made = machine(challenger=None)
    rows = [message(i, v) for i, v in enumerate(values)]
    random.Random(3).shuffle(rows)
    lock = told(made, rows, packed=False)[0]
    assert lock["event"] == "prediction_locked" and lock["history_count"] == 20_000 and lock["reference_id"] == "o0019999"
    hits = {t: sum(Decimal(v) >= Decimal(t) for v in values) for t in ("1.5", "2", "5")}
    assert lock["probabilities"] == {t: str((Decimal(h) / 20_000).quantize(Decimal("0.000001"))) for t, h in hits.items()}
    assert len(calls) <= 100  # 20,000 before, one for each


def test_values_equal_to_a_limit_as_doubles_are_compared_as_decimals():
    texts = ["2", "2.0000", "1.99999999999999999999", "2.00000000000000000001", "1.9", "3"]
    made = machine(challenger=None, point=False, min_history=1)
    lock = told(made, [message(i, v) for i, v in enumerate(texts)])[0]
    assert lock["probabilities"]["2"] == "0.666667"


def test_points_are_the_same_bits_in_whatever_cuts():
    values = 1 + RNG.exponential(20, 1500).round(2)
    one = history.Points(None)
    for v in values:
        one.learn([v])
    for cuts in ([1500], [3, 19, 20, 21, 22, 27, 28, 29, 300, 1500]):
        many = history.Points(None)
        for lo, hi in zip([0, *cuts], cuts):
            many.learn(values[lo:hi])
        assert json.dumps(many.state) == json.dumps(one.state)
    # The moments are those of all rows but the last VALIDATION, written out.
    x = np.array([history.regime_row(values[i - 20 : i])[0] for i in range(20, 1500)])
    z = np.column_stack([np.ones(len(x)), x, history.log_values(values[20:])])[: -history.VALIDATION]
    assert np.array(one.state["moments"]).reshape(18, 18) == pytest.approx(z.T @ z, rel=1e-9)
    assert one.state["tail"][-1][0] == x[-1].tolist()


def test_samples_made_in_pieces_are_the_written_out_ones():
    values, thresholds = 1 + RNG.exponential(5, 3 * logistic.LEAVES * logistic.PART + 100), [1.5, 2.0, 5.0]
    rows = history.Samples(values, thresholds)
    size, n, logs = logistic.LEAVES * logistic.PART, len(values) - 20, np.log(values)
    assert len(rows.rank) == n
    for at in range(0, n, size):
        part = rows.leaves(at)
        filled = part.rank.ravel() >= 0
        some = RNG.choice(np.arange(at, min(at + size, n)), 20)
        for r in [*some, at, min(at + size, n) - 1]:
            past, k = values[: r + 20], r - at
            want = [*logs[r + 15 : r + 20][::-1], logs[r : r + 20].mean(), *[(past[-20:] >= t).mean() for t in history.LIMITS]]
            assert part.rank.ravel()[filled][k] == r and part.x.reshape(-1, 9)[k] == pytest.approx(want, abs=1e-12)
            assert part.hits.reshape(-1, 3)[k].tolist() == [float(values[r + 20] >= t) for t in thresholds]
            assert part.prior.reshape(-1, 3)[k] == pytest.approx([(past >= t).mean() for t in thresholds], abs=1e-15)
        assert rows.leaves(at, False).prior is None
    assert rows.features(n, n + 1)[0][0] == logs[-1]


def test_sums_of_fits_taken_together_are_those_of_each():
    n = 1000
    x, y = RNG.normal(size=(n, 4)), (RNG.random((n, 2)) < 0.3).astype(float)
    rows = logistic.Rows(np.arange(n), x, y, np.zeros((n, 2)))

    def fit(lo, hi, target):
        w = RNG.normal(size=5)
        return logistic.Fit(lo, hi, target, 1.0, x[lo:hi].mean(axis=0), x[lo:hi].std(axis=0), w, trial=w)

    fits = [fit(0, n, 0), fit(0, 700, 1), fit(0, n, 1), fit(130, 131, 0)]
    fits[3].mean, fits[3].scale = fits[0].mean, fits[0].scale
    got, seen = logistic.answer(rows, logistic.Newton(fits)), []
    for f in fits:
        f.take = lambda loss, gradient, hessian: seen.append((loss, gradient, hessian))
    logistic.Newton(fits).read(got)
    for f, (loss, gradient, hessian) in zip(fits, seen):
        z = np.column_stack([np.ones(n), (x - f.mean) / f.scale])[f.lo : f.hi]
        hit, p = y[f.lo : f.hi, f.target], 1 / (1 + np.exp(-z @ f.w))
        assert loss == pytest.approx(-np.log(np.where(hit > 0, p, 1 - p)).sum(), rel=1e-12)
        assert gradient == pytest.approx(z.T @ (p - hit), rel=1e-9, abs=1e-10)
        assert hessian == pytest.approx(z.T @ ((p * (1 - p))[:, None] * z), rel=1e-9, abs=1e-10)


def test_large_margins_have_finite_sums():
    x = np.array([[3000.0], [-3000.0]])
    rows = logistic.Rows(np.arange(2), x, np.array([[1.0], [1.0]]), np.zeros((2, 1)))
    f = logistic.Fit(0, 2, 0, 1.0, np.zeros(1), np.ones(1), np.ones(2), trial=np.array([0.0, 1.0]))
    assert np.isfinite(logistic.answer(rows, logistic.Newton([f]))).all()


@pytest.mark.parametrize("seed", range(4))
def test_replays_and_late_outcomes_are_found_as_one_by_one(seed):
    rng = random.Random(seed)
    made = machine(challenger=None, point=False, min_history=1)
    last, n = None, 0
    for _ in range(8):
        rows = [message(rng.randrange(40), "2", rng.randrange(6)) for _ in range(rng.randrange(1, 15))]
        kept, ignored = [], []
        before = last
        for at in sorted((r["us"], r["id"]) for r in rows):
            if last is not None and at <= last:
                ignored.append(at)
            else:
                kept.append(at)
                last = at
        events = told(made, rows)
        n += len(kept)
        found = [e for e in events if e["event"] == "outcomes_ignored"]
        assert [(e["unpredicted"], e["actual_id"]) for e in found] == ([(len(ignored), ignored[-1][1])] if ignored else [])
        if ignored:
            assert found[0]["us"] == (before or ignored[-1])[0]
        state = made.load()
        assert state["n"] == n and tuple(state["last"][::-1]) == last


def test_packed_rows_come_back_by_series():
    rows = [message(i, None if i % 7 == 0 else f"{i}") | {"series": [None, "a", "b", ""][i % 4], "kind": ["outcome", "observation"][i % 2]} for i in range(500)]
    rows[3] |= {"ready": True, "payload_bytes": 5}
    batches = [pa.RecordBatch.from_pylist(rows[at : at + 90], locks.TABLE) for at in range(0, 500, 90)]
    got = pa.concat_tables([pa.Table.from_batches([b]) for b in locks.pack(iter([*batches, batches[0].slice(0, 0)]))]).to_pandas()
    assert len(got) == 4 * len(batches)
    for series in (None, "a", "b", ""):
        own = got[got["series"].isna() if series is None else got["series"] == series]
        back = locks.unpacked(iter([own.iloc[:2], own.iloc[2:]])).to_pylist()
        assert [dict.fromkeys(COLUMNS) | r | {"series": series} for r in back] == [r for r in rows if r["series"] == series]


def test_values_of_an_older_state_come_first():
    made = machine()
    values = [1 + abs(math.sin(i)) * 3 for i in range(200)]
    for v in values[:150]:
        made.values.appendValue((v,))
    for part in (values[150:151], values[151:]):
        made.blocks.appendValue((np.array(part).tobytes(),))
    assert made.history({"n": 200}).tolist() == values
    assert made.history({"n": 139}).tolist() == [0.0] * 139

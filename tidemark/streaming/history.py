"""What a live lock forecasts from: a series' values as they come, one after another.

The ridge regressions of the point forecast need sums of products of the rows before, and the
last few rows themselves; both are a bounded state. The logistic challenger is fitted anew at
each lock, as its batch form is, on all values so far: eight bytes of state for each.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from tidemark.operators import ridge
from tidemark.operators.features import RATE_THRESHOLDS
from tidemark.operators.logistic import DECISION, LEAVES, PART, ChallengerConfig, Rows, gated_program, in_task

# Windows and penalties of the point forecast.
LAGS, SHORT, LONG, VALIDATION = 5, 8, 20, 8
ALPHAS = (0.1, 1.0, 10.0)
LIMITS = [float(t) for t in RATE_THRESHOLDS]
CAP = 1000.0
WIDTH = LAGS + 5 + 2 * len(LIMITS)

#: Values that are learned from together; bounds the products in memory.
STEP = 256


def log_values(values: Sequence[float]) -> np.ndarray:
    return np.log(np.minimum(np.asarray(values, float), CAP))


def regime_rows(recent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Regime features, medians and averages of the logs of rows of ``LONG`` values."""
    logs = log_values(recent)
    near, far = logs[:, -SHORT:], logs
    means = near.mean(axis=1), far.mean(axis=1)
    x = [logs[:, -k] for k in range(1, LAGS + 1)]
    x += [*means, means[0] - means[1], near.std(axis=1), far.std(axis=1)]
    x += [(w >= t).mean(axis=1) for t in LIMITS for w in (recent[:, -SHORT:], recent)]
    alpha, level = 2.0 / (SHORT + 1.0), logs[:, 0]
    for k in range(1, logs.shape[1]):
        level = logs[:, k] * alpha + level * (1.0 - alpha)
    return np.stack(x, axis=1), np.median(near, axis=1), level


def regime_row(recent: Sequence[float]) -> tuple[list[float], float, float]:
    """Regime features, median and average of the logs of the last ``LONG`` values."""
    x, median, level = regime_rows(np.asarray(recent[-LONG:], float)[None])
    return x[0].tolist(), float(median[0]), float(level[0])


class Points:
    """The point forecast of a series.

    ``state`` has n (values so far), recent (the last ``LONG``), tail (the last ``VALIDATION``
    rows: features, target, median, average) and moments (of the rows before the tail).
    """

    def __init__(self, state: dict | None):
        self.state = state or {"n": 0, "recent": [], "tail": [], "moments": [0.0] * (WIDTH + 2) ** 2}

    def learn(self, values: Sequence[float]) -> None:
        """Values in their order; moments are added row by row, so cuts change no bit of them."""
        s = self.state
        values = np.asarray(values, float)
        known = np.concatenate([np.asarray(s["recent"], float), values])
        s["n"] += len(values)
        s["recent"] = known[-LONG:].tolist()
        if len(known) <= LONG:
            return
        rows = np.lib.stride_tricks.sliding_window_view(known, LONG)[:-1]
        targets = log_values(known[LONG:])
        tail = [np.array([r[k] for r in s["tail"]], float) for k in range(4)] if s["tail"] else [np.zeros((0, WIDTH)), *[np.zeros(0)] * 3]
        moments = np.array(s["moments"]).reshape(1, WIDTH + 2, WIDTH + 2)
        for at in range(0, len(rows), STEP):
            x, median, level = regime_rows(np.ascontiguousarray(rows[at : at + STEP]))
            tail = [np.concatenate(pair) for pair in zip(tail, (x, targets[at : at + STEP], median, level))]
            out = max(len(tail[0]) - VALIDATION, 0)
            if out:
                moments = np.concatenate([moments, ridge.products(tail[0][:out], tail[1][:out])]).sum(axis=0, keepdims=True)
                tail = [column[out:] for column in tail]
        s["tail"] = [list(row) for row in zip(*[column.tolist() for column in tail])]
        s["moments"] = moments.ravel().tolist()

    @staticmethod
    def _products(rows: list) -> np.ndarray:
        if not rows:
            return np.zeros((WIDTH + 2, WIDTH + 2))
        return ridge.products(np.array([r[0] for r in rows]), np.array([r[1] for r in rows])).sum(axis=0)

    def forecast(self) -> dict:
        """The columns of ``point_forecast`` for the outcome to come."""
        s = self.state
        names = ["status", "predicted", "lower", "upper", "confidence", "regime", "regime_shift", "validation_rows", "validation_mae_log", "recent_median_mae_log", "components"]
        valid = min(VALIDATION, max(s["n"] - LONG - 3, 0))
        if s["n"] < LONG or valid < 3:
            status = "INSUFFICIENT_DATA" if s["n"] < LONG else "INSUFFICIENT_TRAINING_ROWS"
            return dict(zip(names, (status, None, None, None, "LOW", "UNKNOWN", None, valid, None, None, None)))
        before = np.array(s["moments"]).reshape(WIDTH + 2, WIDTH + 2)
        judged = s["tail"][-valid:]
        train = before + self._products(s["tail"][:-valid])
        full = before + self._products(s["tail"])
        # Unused slots repeat the last row.
        slots = [judged[min(i, valid - 1)] for i in range(VALIDATION)]
        x_val, y_val, median_val, ewma_val = (np.array([[r[k] for r in slots]]) for k in range(4))
        x, median, ewma = regime_row(s["recent"])
        at = ridge.Competition(x_val, y_val, median_val, ewma_val, np.array([valid]), np.array([x]), np.array([median]), np.array([ewma]))
        return dict(zip(names, ridge.compete(train[None], full[None], at, ALPHAS, LAGS)[0]))


class Samples(Rows):
    """The challenger's samples of a series of values; their features are made where sums are taken.

    The sample of rank r is the value behind the first ``LONG`` + r, and its features are those of
    the last ``LONG`` of these.
    """

    def __init__(self, values: np.ndarray, thresholds: Sequence[float]):
        self.values, self.thresholds = values, np.asarray(thresholds, float)
        self.rank = np.arange(max(len(values) - LONG, 0))
        self.won = [np.zeros(len(self.thresholds))]  # before each LEAVES parts
        for at in range(0, len(values), LEAVES * PART):
            self.won.append(self.won[-1] + self._hits(values[at : at + LEAVES * PART]).sum(axis=0))

    def _hits(self, values: np.ndarray) -> np.ndarray:
        return (values[:, None] >= self.thresholds).astype(float)

    def features(self, lo: int, hi: int) -> np.ndarray:
        """Of the samples from ``lo`` to before ``hi``, in memory by column; the coming one has the last rank."""
        values, n = self.values[lo : hi + LONG - 1], hi - lo
        logs = log_values(values)
        total = logs[:n].copy()
        for k in range(1, LONG):
            total += logs[k : k + n]
        x = [logs[LONG - k : LONG - k + n] for k in range(1, LAGS + 1)]
        x.append(total / LONG)
        for t in LIMITS:
            won = np.concatenate([[0], np.cumsum(values >= t)])
            x.append((won[LONG:] - won[:-LONG]) / LONG)
        return np.stack(x).T

    def leaves(self, at: int, priors: bool = True) -> Rows:
        rank = self.rank[at : at + LEAVES * PART]
        hits = self._hits(self.values[at : at + LONG + len(rank)])
        prior = None
        if priors:
            won = self.won[at // (LEAVES * PART)] + np.cumsum(hits, axis=0)[LONG - 1 : -1]
            prior = won / (rank + LONG)[:, None]
        return Rows(rank, self.features(at, at + len(rank)), hits[LONG:], prior).leaves(0, priors)


def challenged(series: str, values: Sequence[float], priors: Sequence[float | None], thresholds: Sequence[float], config: ChallengerConfig) -> list[dict]:
    """The rows of ``gated_logistic_forecast`` for the outcome to come after ``values``."""
    values = np.asarray(values, float)
    rows = Samples(values, thresholds)
    n = len(rows.rank)
    head = {"series": series, "history_count": len(values), "base": list(priors), "samples": n, "shift": None, "ahead": None}
    if not config.too_early(len(values), n):
        head |= {"shift": rows.features(0, 1)[0], "ahead": rows.features(n, n + 1)[0]}
    found = in_task(gated_program(head, list(thresholds), config), rows)
    names = [c.split()[0] for c in DECISION.split(", ")]
    return [dict(zip(names, row)) for row in found]

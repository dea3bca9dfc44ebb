"""Online models and the choice between them on a stream of samples, one row after another.

State of a series: for each mode the filter behind the last whole part of ``PART_ROWS``
positions, the rows of the open part, and the last losses of every candidate. Predictions of a
row go from the start of its part, as in batch, so a replay in any batches gives the rows
of ``online_rls`` and ``champion_selection``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle as pickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.online import FACTORS, PART_ROWS, Filter

SIGNAL = (
    "series string, pos bigint, threshold string, actual int, champion string, mode string, factor double, "
    "probability double, candidates map<string,double>"
)


class OnlineSignals(StatefulProcessor):
    """Probabilities of every candidate for each row, from the rows before it, and the champion.

    Rows of a position come together, one for each mode, with features ``x`` and ``hits``, one
    for each threshold. Rows at or before the last position are replays and give nothing.
    """

    def __init__(self, thresholds: Sequence[str], factors: Sequence[float], regularization: float, window: int):
        self.thresholds, self.factors, self.window = list(thresholds), [float(f) for f in factors], window
        self.regularization = regularization

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cell = handle.getValueState("state", "body binary")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        state = pickle.loads(self.cell.get()[0]) if self.cell.exists() else {"last": -1, "modes": {}, "losses": {}}
        batch = batch[batch["pos"] > state["last"]].drop_duplicates(["pos", "mode"])
        found: dict[int, dict] = {}
        for mode, own in batch.sort_values("pos").groupby("mode", sort=True):
            x = np.stack(own["x"].to_numpy()).astype(float)
            x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
            y = np.stack(own["hits"].to_numpy()).astype(float)
            pos = own["pos"].to_numpy()
            for i, p in enumerate(self.learn(state["modes"], mode, pos, x, y)):
                found.setdefault(int(pos[i]), {"actual": y[i].astype(int)})[mode] = p
        made = [row for at in sorted(found) for row in self.choose(state["losses"], at, found[at])]
        if found:
            state["last"] = max(found)
        self.cell.update((pickle.dumps(state),))
        names = [c.split()[0] for c in SIGNAL.split(", ")]
        yield pd.DataFrame([(key[0], *row) for row in made], columns=names, dtype=object)

    def learn(self, modes: dict, mode: str, pos: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Probabilities (row, factor, threshold) of new rows, which the state then knows."""
        model = Filter(self.factors, self.regularization)
        now = modes.get(mode) or {"state": model.start(x.shape[1], y.shape[1]), "part": None, "x": x[:0], "y": y[:0]}
        out = []
        for part in np.unique(pos // PART_ROWS):
            mine = pos // PART_ROWS == part
            if now["part"] is not None and part != now["part"]:
                now["state"] = model.advance(now["state"], len(now["x"]), *model.sums(now["x"], now["y"]))
                now["x"], now["y"] = x[:0], y[:0]
            now["part"], before = part, len(now["x"])
            now["x"], now["y"] = np.concatenate([now["x"], x[mine]]), np.concatenate([now["y"], y[mine]])
            out.append(model.predictions(now["state"], now["x"], now["y"])[before:])
        modes[mode] = now
        return np.concatenate(out)

    def choose(self, losses: dict, at: int, found: dict) -> list[tuple]:
        """One row a threshold: the candidate of the lowest mean of its last losses, ties by name."""
        actual = found.pop("actual")
        made = []
        for k, threshold in enumerate(self.thresholds):
            candidates = {}
            for mode, p in found.items():
                for f, factor in enumerate(self.factors):
                    candidates[f"{mode}:ff={factor:.2f}"] = (mode, factor, float(p[f, k]))
            recent = {n: losses.get((threshold, n), []) for n in candidates}
            best = min(candidates, key=lambda n: (np.mean(recent[n]) if recent[n] else np.inf, n))
            mode, factor, probability = candidates[best]
            made.append((at, threshold, int(actual[k]), best, mode, factor, probability, {n: c[2] for n, c in candidates.items()}))
            for n, (_, _, p) in candidates.items():
                losses[threshold, n] = [*recent[n], (p - actual[k]) ** 2][-self.window :]
        return made


def online_signals(
    samples: DataFrame, thresholds: Sequence[str], factors: Sequence[float] = FACTORS, regularization: float = 10.0, window: int = 16
) -> DataFrame:
    """A row for each sample and threshold of a stream of (series, mode, pos, x, hits).

    The champion, its probability, and the probability of every candidate. State is bounded by
    the width of the features and ``window``. Needs the RocksDB state store.
    """
    return samples.select("series", "mode", "pos", "x", F.col("hits").cast("array<int>").alias("hits")).groupBy("series").transformWithStateInPandas(
        statefulProcessor=OnlineSignals(thresholds, factors, regularization, window), outputStructType=SIGNAL, outputMode="append", timeMode="None"
    )

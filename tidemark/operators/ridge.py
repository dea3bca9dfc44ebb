"""Walk-forward ridge regression from prefix moments, and the point forecast on it.

The normal equations of every target are sums over the rows before it, so running
sums of products replace a refit per target. Solving them is a batched numpy call.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators.blocks import run_blocks
from tidemark.operators.features import (
    ORDER,
    SERIES,
    array_median,
    ewma_of,
    lags_array,
    regime_columns,
    regime_names,
)
from tidemark.plans.ordering import Layout, plan_layout, rolling

CHUNK = 256  # targets solved together; bounds the memory of the moment stack


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Outer products of (1, x, y) per row; rows without a target contribute nothing."""
    z = np.concatenate([np.ones((len(x), 1)), x, y[:, None]], axis=1)
    z[~np.isfinite(z).all(axis=1)] = 0.0
    return z[:, :, None] * z[:, None, :]


def solve(moments: np.ndarray, alphas: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """Intercepts (m, k) and coefficients on raw features (m, k, d) from moment stacks.

    Features are standardised with the population deviation, the intercept is not
    penalised. A column whose deviation is at most 1e-12, or below the rounding noise
    of its moments, is constant: it gets scale 1 and no weight.
    """
    n = np.maximum(moments[:, 0, 0], 1.0)
    mean = moments[:, 0, 1:-1] / n[:, None]
    target = moments[:, 0, -1] / n
    second = moments[:, 1:-1, 1:-1] / n[:, None, None]
    cov = second - mean[:, :, None] * mean[:, None, :]
    var = np.diagonal(cov, axis1=1, axis2=2)
    raw = np.diagonal(second, axis1=1, axis2=2)
    constant = (var <= 1e-24) | (var <= 1e-13 * raw)
    scale = np.where(constant, 1.0, np.sqrt(np.maximum(var, 1e-300)))
    live = ~constant
    both = live[:, :, None] & live[:, None, :]
    gram = np.where(both, cov / (scale[:, :, None] * scale[:, None, :]), 0.0) * n[:, None, None]
    rhs = moments[:, 1:-1, -1] - n[:, None] * mean * target[:, None]
    rhs = np.where(live, rhs / scale, 0.0)
    eye = np.eye(gram.shape[1])
    coefficients = np.stack(
        [np.linalg.solve(gram + a * eye, rhs[:, :, None])[:, :, 0] / scale for a in alphas], axis=1
    )
    intercepts = target[:, None] - (coefficients * mean[:, None, :]).sum(axis=2)
    return intercepts, coefficients


class PrefixMoments:
    """Moment stacks at row positions of one block, computed chunk by chunk."""

    def __init__(self, x: np.ndarray, y: np.ndarray, start: np.ndarray | None):
        self.x, self.y = x, y
        size = x.shape[1] + 2
        self.start = np.zeros((size, size)) if start is None else start
        edges = range(0, len(x) + 1, CHUNK)
        self.edges = [self.start]
        for edge in edges:
            rows = products(x[edge : edge + CHUNK], y[edge : edge + CHUNK])
            self.edges.append(self.edges[-1] + rows.sum(axis=0))

    def before(self, positions: np.ndarray) -> np.ndarray:
        """Moments of all rows before each (block-relative) position, ascending."""
        out = np.empty((len(positions), *self.start.shape))
        chunks = positions // CHUNK
        for chunk in np.unique(chunks):
            low = chunk * CHUNK
            rows = products(self.x[low : low + CHUNK], self.y[low : low + CHUNK])
            running = np.concatenate([np.zeros((1, *self.start.shape)), rows.cumsum(axis=0)])
            mine = chunks == chunk
            out[mine] = self.edges[chunk] + running[positions[mine] - low]
        return out


def moment_steps(columns: Sequence[str], by: Sequence[str]):
    """The summary and combination steps of moment sums, for ``run_blocks``."""
    by = list(by)

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        out = {c: [pdf[c].iloc[0]] for c in [*by, "_slice"]}
        for c in columns:
            x, y = stacked(pdf, c), pdf["y"].to_numpy(float)
            total = 0
            for low in range(0, len(x), CHUNK):
                total = total + products(x[low : low + CHUNK], y[low : low + CHUNK]).sum(axis=0)
            out[f"m_{c}"] = [total.ravel()]
        return pd.DataFrame(out)

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[[*by, "_slice"]].copy()
        for c in columns:
            sums = np.cumsum(np.stack(pdf[f"m_{c}"].to_list()), axis=0)
            before = np.concatenate([np.zeros((1, sums.shape[1])), sums[:-1]])
            out[f"m_{c}"] = list(before)
        return out

    return summarise, combine


def state_schema(columns: Sequence[str], by_schema: str) -> str:
    return f"{by_schema}, _slice bigint, " + ", ".join(f"m_{c} array<double>" for c in columns)


def stacked(pdf: pd.DataFrame, column: str) -> np.ndarray:
    if pdf.empty:
        return np.zeros((0, 1))
    return np.stack(pdf[column].to_numpy()).astype(float)


def start_of(state: pd.DataFrame | None, column: str, width: int) -> np.ndarray | None:
    if state is None or state.empty:
        return None
    return np.asarray(state[f"m_{column}"].iloc[0], dtype=float).reshape(width + 2, width + 2)


# --- batched ridge ---------------------------------------------------------------------


def batched_ridge(
    samples: DataFrame, alpha: float = 1.0, min_rows: int = 1, layout: Layout | None = None
) -> DataFrame:
    """Prediction for every row of a series by a ridge fitted on the rows before it.

    ``samples`` has (series, pos, x ARRAY<DOUBLE>, y). Rows with fewer than
    ``min_rows`` earlier rows get null.
    """
    layout = layout if layout is not None else plan_layout(samples, SERIES, "pos")
    rows = samples.select("series", "pos", "x", "y")

    def kernel(pdf: pd.DataFrame, state: pd.DataFrame | None) -> pd.DataFrame:
        x, y = stacked(pdf, "x"), pdf["y"].to_numpy(float)
        moments = PrefixMoments(x, y, start_of(state, "x", x.shape[1]))
        predicted = np.full(len(x), np.nan)
        for low in range(0, len(x), CHUNK):
            at = np.arange(low, min(low + CHUNK, len(x)))
            stack = moments.before(at)
            intercept, beta = solve(stack, [alpha])
            value = intercept[:, 0] + (beta[:, 0] * x[at]).sum(axis=1)
            predicted[at] = np.where(stack[:, 0, 0] >= min_rows, value, np.nan)
        out = pdf[["series", "pos", "y"]].assign(predicted=predicted)
        return out.assign(predicted=out["predicted"].astype(object).where(np.isfinite(predicted), None))

    summarise, combine = moment_steps(["x"], SERIES)
    schema = state_schema(["x"], "series string")
    return run_blocks(
        rows, SERIES, layout, "series string, pos bigint, y double, predicted double",
        kernel, schema, summarise, combine, schema,
    )


# --- point forecast ----------------------------------------------------------------------

POINT_SCHEMA = (
    "series string, outcome_id string, pos bigint, ts timestamp, actual double, status string, "
    "predicted double, lower double, upper double, confidence string, regime string, "
    "regime_shift double, validation_rows int, validation_mae_log double, "
    "recent_median_mae_log double, recent_median double, components map<string,double>"
)


def _masked_quantile(values: np.ndarray, counts: np.ndarray, q: float) -> np.ndarray:
    """Interpolated quantile of the first ``counts`` entries of each row."""
    slots = np.arange(values.shape[1])[None, :]
    ordered = np.sort(np.where(slots < counts[:, None], values, np.inf), axis=1)
    place = (counts - 1) * q
    low, high = np.floor(place).astype(int), np.ceil(place).astype(int)
    rows, part = np.arange(len(values)), place - low
    return ordered[rows, low] * (1.0 - part) + ordered[rows, high] * part


@dataclass
class Competition:
    """What the candidates of some targets are judged on, and what they forecast from.

    Validation rows come first, (target, slot, ...), of which ``valid`` are used for each
    target; then the features, median and average of the targets themselves.
    """

    x_val: np.ndarray
    y_val: np.ndarray
    median_val: np.ndarray
    ewma_val: np.ndarray
    valid: np.ndarray
    x: np.ndarray
    median: np.ndarray
    ewma: np.ndarray


def compete(train: np.ndarray, full: np.ndarray, at: Competition, alphas: Sequence[float], lags: int) -> list[tuple]:
    """Status, figures and components of the forecast of each target.

    ``train`` are the moments of the rows before a target's validation rows, ``full`` those of
    all rows before the target.
    """
    labels = [*[f"ridge_{a:g}" for a in alphas], "recent_median", "ewma"]
    order = np.argsort(np.argsort(labels))  # ties go to the smaller name
    v = at.valid
    used = np.arange(at.x_val.shape[1])[None, :] < v[:, None]
    b0, b = solve(train, alphas)
    f0, f = solve(full, alphas)
    ridge = b0[:, :, None] + np.einsum("mkd,mvd->mkv", b, at.x_val)
    guess = np.concatenate([ridge, at.median_val[:, None, :], at.ewma_val[:, None, :]], axis=1)
    miss = np.abs(guess - at.y_val[:, None, :])
    mae = np.where(used[:, None, :], miss, 0.0).sum(axis=2) / v[:, None]
    ahead = np.concatenate([f0 + np.einsum("mkd,md->mk", f, at.x), at.median[:, None], at.ewma[:, None]], axis=1)
    rows = np.arange(len(v))
    # Lowest error first, equal errors by name.
    ranked = np.lexsort((np.broadcast_to(order, mae.shape), mae), axis=1)[:, :3]
    inverse = 1.0 / np.maximum(np.take_along_axis(mae, ranked, 1), 1e-6)
    weight = inverse / inverse.sum(axis=1, keepdims=True)
    blend = (weight * np.take_along_axis(ahead, ranked, 1)).sum(axis=1)
    best, base = mae[rows, ranked[:, 0]], mae[:, len(alphas)]
    radius = _masked_quantile(miss[rows, ranked[:, 0]], v, 0.80)
    spread = np.stack([np.zeros(len(v)), -radius, radius], axis=1)
    shown = np.clip(np.exp(blend[:, None] + spread), 1.0, 1000.0)
    near, far, std = at.x[:, lags], at.x[:, lags + 1], at.x[:, lags + 4]
    shift = (near - far) / np.maximum(std, 1e-6)
    gain = (base - best) / np.maximum(base, 1e-6)
    result = []
    for j in rows:
        regime = "STABLE"
        if abs(shift[j]) > 0.35:
            regime = ("HIGHER" if shift[j] > 0 else "LOWER") + "_RECENT_VALUES"
        result.append(
            (
                "READY", *[round(float(p), 2) for p in shown[j]],
                "MEDIUM" if v[j] >= 8 and gain[j] >= 0.15 else "LOW",
                regime, round(float(shift[j]), 6), int(v[j]), round(float(best[j]), 6),
                round(float(base[j]), 6),
                {labels[c]: round(float(w), 6) for c, w in zip(ranked[j], weight[j])},
            )
        )
    return result


def point_forecast(
    outcomes: DataFrame,
    min_history: int = 20,
    lags: int = 5,
    short: int = 8,
    long: int = 20,
    validation_rows: int = 8,
    alphas: Sequence[float] = (0.1, 1.0, 10.0),
    layout: Layout | None = None,
) -> DataFrame:
    """Point forecast of every outcome from the outcomes before it.

    Ridge at several penalties, the recent median and an exponential average compete
    on the last ``validation_rows`` training rows; the best three are blended by the
    inverse of their error. Add ``with_next`` rows to forecast what is still to come.
    """
    if min_history < long or short < lags or long < short or validation_rows < 3:
        raise ValueError("windows must satisfy lags <= short <= long <= min_history.")
    log, value = C.log_value("value"), F.col("value").cast("double")
    names = regime_names(lags)

    def columns(w: WindowSpec) -> Mapping[str, Column]:
        return {
            **regime_columns(w, lags, short, long),
            "median_log": array_median(lags_array(log, w, short)),
            "recent_median": array_median(lags_array(value, w, short)),
            "ewma_log": ewma_of(lags_array(log, w, long), 2.0 / (short + 1.0)),
        }

    rows = outcomes.select("series", "outcome_id", "ts", "value")
    layout = layout if layout is not None else plan_layout(rows, SERIES, "ts")
    rows = rolling(rows, SERIES, ORDER, long, columns, layout)
    rows = rows.where(F.col("pos") >= long).select(
        "series", "outcome_id", "ts", "pos", value.alias("actual"), log.alias("y"),
        F.array(*names).alias("x"), "median_log", "ewma_log", "recent_median",
    )
    v_max = validation_rows

    def kernel(pdf: pd.DataFrame, state: pd.DataFrame | None) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame(columns=[c.split()[0] for c in POINT_SCHEMA.split(", ")])
        x, y = stacked(pdf, "x"), pdf["y"].to_numpy(float)
        pos, home = pdf["pos"].to_numpy(), pdf["_home"].to_numpy(bool)
        median_log, ewma_log = pdf["median_log"].to_numpy(float), pdf["ewma_log"].to_numpy(float)
        moments = PrefixMoments(x, y, start_of(state, "x", x.shape[1]))
        trained = pos - long  # rows before the target that have features
        valid = np.minimum(v_max, np.maximum(trained - 3, 0))
        result = []
        for i in np.flatnonzero(home & ((valid < 3) | (pos < min_history))):
            status = "INSUFFICIENT_DATA" if pos[i] < min_history else "INSUFFICIENT_TRAINING_ROWS"
            result.append((i, status, *[None] * 3, "LOW", "UNKNOWN", None, int(valid[i]), None, None, None))
        targets = np.flatnonzero(home & (valid >= 3) & (pos >= min_history))
        for low in range(0, len(targets), CHUNK):
            at = targets[low : low + CHUNK]
            v = valid[at]
            train = moments.before(at - v)
            full = moments.before(at)
            # Validation rows of each target; unused slots repeat the last row.
            slots = np.arange(v_max)[None, :]
            val = at[:, None] - v[:, None] + np.minimum(slots, v[:, None] - 1)
            inputs = Competition(
                x[val], y[val], median_log[val], ewma_log[val], v, x[at], median_log[at], ewma_log[at]
            )
            result += [(i, *row) for i, row in zip(at, compete(train, full, inputs, alphas, lags))]
        fields = [
            "i", "status", "predicted", "lower", "upper", "confidence", "regime", "regime_shift",
            "validation_rows", "validation_mae_log", "recent_median_mae_log", "components",
        ]
        made = pd.DataFrame(result, columns=fields)
        base = pdf.iloc[made["i"].to_numpy(int)][
            ["series", "outcome_id", "pos", "ts", "actual", "recent_median"]
        ].reset_index(drop=True)
        out = pd.concat([base, made.drop(columns="i")], axis=1)
        return out[[c.split()[0] for c in POINT_SCHEMA.split(", ")]]

    summarise, combine = moment_steps(["x"], SERIES)
    schema = state_schema(["x"], "series string")
    return run_blocks(
        rows, SERIES, layout, POINT_SCHEMA, kernel, schema, summarise, combine, schema, halo=v_max
    )

"""Online probability models and the choice between them by past losses.

A model with forgetting is sequential within one series. Its state after any number
of rows is a decayed sum of products, though, so a long series is cut into blocks
whose decayed sums, made part by part, are added up to the state at each block start.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators.blocks import run_blocks
from tidemark.plans.ordering import Layout, plan_layout, rolling

FACTORS = (0.90, 0.95, 0.98, 1.00)
LOW, HIGH = 0.001, 0.999
SLICE_AT = 2  # the place of the block's number in a summary
# Rows whose products are summed together, by position, however the series is cut.
PART_ROWS = 64
# Share of the regularisation that forgetting leaves: else directions that no row moves any
# more keep nothing but rounding errors.
FLOOR = 1e-8


def _inputs(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    x = np.stack(pdf["x"].to_numpy()).astype(float)
    y = np.stack(pdf["hits"].to_numpy()).astype(float)
    return np.concatenate([np.ones((len(x), 1)), x], axis=1), y


class Filter:
    """Least squares with forgetting, in information form, for several factors at once.

    A state is (rows so far, decayed products of their features, and of features and hits).
    """

    def __init__(self, factors: Sequence[float], regularization: float):
        self.forget, self.regularization = np.asarray(factors, float), regularization

    def start(self, width: int, labels: int) -> tuple:
        n = len(self.forget)
        return 0, np.zeros((n, width, width)), np.zeros((n, labels, width))

    def sums(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Decayed products of a part's rows: (factor, width, width) and (factor, label, width)."""
        decay = self.forget[:, None] ** np.arange(len(x) - 1, -1, -1.0)
        decayed = decay[:, :, None] * x
        return np.swapaxes(decayed, 1, 2) @ x, y.T @ decayed

    def advance(self, state: tuple, rows: int, gram: np.ndarray, cross: np.ndarray) -> tuple:
        """The state after a part: rows so far, and decayed products of all of them."""
        fade = (self.forget**rows)[:, None, None]
        return state[0] + rows, state[1] * fade + gram, state[2] * fade + cross

    def predictions(self, state: tuple, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Probabilities of each row of a part, (row, factor, label), from all rows before it."""
        forget = self.forget
        n, gram, cross = state
        width = x.shape[1]
        grams = np.empty((len(x), *gram.shape))
        crosses = np.empty((len(x), *cross.shape))
        for i in range(len(x)):
            grams[i], crosses[i] = gram, cross
            gram = gram * forget[:, None, None] + np.outer(x[i], x[i])
            cross = cross * forget[:, None, None] + np.outer(y[i], x[i])
        held = self.regularization * np.maximum(forget ** (n + np.arange(len(x), dtype=float))[:, None], FLOOR)
        grams[..., np.arange(width), np.arange(width)] += held[..., None]
        crosses[..., 0] += 0.5 * held[..., None]
        weights = np.linalg.solve(grams, np.swapaxes(crosses, 2, 3))
        return np.clip(np.einsum("iw,ifwl->ifl", x, weights), LOW, HIGH)


def online_rls(
    samples: DataFrame,
    factors: Sequence[float] = FACTORS,
    regularization: float = 10.0,
    layout: Layout | None = None,
) -> DataFrame:
    """Recursive least squares probabilities of each row from the rows before it.

    ``samples`` has (series, mode, pos, x ARRAY<DOUBLE>, hits ARRAY<INT>), one hit per
    threshold. The gain does not depend on the hits, so all thresholds share it.
    Output: (series, mode, factor, pos, probabilities, hits) in threshold order.

    The filter is run in its information form: weights solve the decayed normal equations
    of all earlier rows, with the decayed ``regularization``, but no less than ``FLOOR`` of
    it, so the equations are well-posed at any length. Products are summed in parts of
    ``PART_ROWS`` positions, which every cut respects: a series gives the same numbers
    whole and in blocks of any size. The update of the covariance form, which divides by
    the forgetting factor plus a square, has nothing to guard against here.
    """
    by = ["series", "mode"]
    rows = samples.select(*by, "pos", "x", "hits")
    layout = layout if layout is not None else plan_layout(rows, by, "pos")
    factors = [float(f) for f in factors]
    model = Filter(factors, regularization)

    def parts(pdf: pd.DataFrame):
        """Consecutive rows with the same ``pos // PART_ROWS``."""
        for _, part in pdf.groupby(pdf["pos"] // PART_ROWS, sort=True):
            yield part

    def kernel(pdf: pd.DataFrame, state: pd.DataFrame | None) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame(
                columns=["series", "mode", "factor", "pos", "probabilities", "hits"]
            )
        x, y = _inputs(pdf)
        width, labels = x.shape[1], y.shape[1]
        now = model.start(width, labels)
        if state is not None and not state.empty:
            own = state.set_index("factor").loc[factors]
            now = (
                int(own["rows"].iloc[0]),
                np.stack(own["gram"].to_numpy()).reshape(-1, width, width),
                np.stack(own["cross"].to_numpy()).reshape(-1, labels, width),
            )
        made = []
        for part in parts(pdf):
            px, py = _inputs(part)
            made.append(model.predictions(now, px, py))
            now = model.advance(now, len(px), *model.sums(px, py))
        out = np.concatenate(made)
        count = len(x)
        return pd.DataFrame(
            {
                "series": np.repeat(pdf["series"].to_numpy(), len(factors)),
                "mode": np.repeat(pdf["mode"].to_numpy(), len(factors)),
                "factor": np.tile(factors, count),
                "pos": np.repeat(pdf["pos"].to_numpy(), len(factors)),
                "probabilities": list(out.reshape(count * len(factors), labels)),
                "hits": list(np.repeat(y.astype(int), len(factors), axis=0)),
            }
        )

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        made = []
        for part in parts(pdf):
            x, y = _inputs(part)
            gram, cross = model.sums(x, y)
            first = part.iloc[0]
            for k, f in enumerate(factors):
                made.append(
                    (
                        first["series"], first["mode"], first["_slice"], f, int(first["pos"]) // PART_ROWS,
                        len(x), gram[k].ravel(), cross[k].ravel(),
                    )
                )
        return pd.DataFrame(
            made, columns=["series", "mode", "_slice", "factor", "part", "rows", "gram", "cross"]
        )

    def combine(batches):
        """States at the starts of blocks, one part after another: rows come by series, mode, factor and part."""
        key, reached, n, gram, cross = None, None, 0, None, None
        for pdf in batches:
            made = []
            for row in pdf.itertuples(index=False):
                own_gram, own_cross = np.asarray(row.gram, float), np.asarray(row.cross, float)
                if (row.series, row.mode, row.factor) != key:
                    key, reached, n = (row.series, row.mode, row.factor), None, 0
                    gram, cross = np.zeros_like(own_gram), np.zeros_like(own_cross)
                if row[SLICE_AT] != reached:
                    reached = row[SLICE_AT]
                    made.append((row.series, row.mode, reached, row.factor, n, gram, cross))
                fade = (model.forget**row.rows)[factors.index(row.factor)]
                n, gram, cross = n + row.rows, gram * fade + own_gram, cross * fade + own_cross
            yield pd.DataFrame(
                made, columns=["series", "mode", "_slice", "factor", "rows", "gram", "cross"]
            )

    return run_blocks(
        rows, by, layout,
        "series string, mode string, factor double, pos bigint, probabilities array<double>, "
        "hits array<int>",
        kernel,
        "series string, mode string, _slice bigint, factor double, part bigint, rows bigint, "
        "gram array<double>, cross array<double>",
        summarise, combine,
        "series string, mode string, _slice bigint, factor double, rows bigint, "
        "gram array<double>, cross array<double>",
        align=PART_ROWS,  # cut between the parts that sums are made of
        steps=["factor", "part"],
    )


def clipped(values: Column, bound: float = 12.0) -> Column:
    return F.transform(values, lambda x: C.clip(x, -bound, bound))


def candidate_losses(
    predictions: DataFrame,
    thresholds: Sequence[str],
    window: int,
    name: Column,
    layout: Layout | None = None,
) -> DataFrame:
    """One row per candidate, threshold and target ``at``, from ``online_rls`` output.

    ``recent_loss`` is the mean of at most the last ``window`` squared losses before
    the row, ``past`` counts them.
    """
    limits = C.number_list(thresholds, "decimal(18,6)")
    each = F.transform(
        "probabilities",
        lambda p, i: F.struct(
            F.get(limits, i).alias("threshold"),
            p.alias("probability"),
            F.get("hits", i).alias("actual"),
        ),
    )
    rows = predictions.withColumn("name", name).select(
        "series", "mode", "factor", "name", F.col("pos").alias("at"), F.explode(each).alias("e")
    ).select("series", "mode", "factor", "name", "at", "e.*")
    rows = rows.withColumn("loss", F.pow(F.col("probability") - F.col("actual"), 2))
    by = ["series", "threshold", "name"]
    return rolling(
        rows, by, ["at"], window,
        lambda w: {
            "recent_loss": F.avg("loss").over(w.rowsBetween(-window, -1)),
            "past": F.count("loss").over(w.rowsBetween(-window, -1)),
        },
        layout,
    ).drop("pos")


def champion_selection(losses: DataFrame, modes: Sequence[str] = ()) -> DataFrame:
    """Per target: the candidate with the lowest recent loss, ties by name.

    With ``modes`` also the best candidate of each mode (``best_<mode>``).
    """
    score = F.struct(F.coalesce("recent_loss", F.lit(float("inf"))), F.col("name"))
    chosen = F.struct("name", "mode", "factor", "probability")

    def best(condition: Column | None) -> Column:
        return F.min_by(chosen, score if condition is None else F.when(condition, score))

    return losses.groupBy("series", "threshold", "at").agg(
        F.max("actual").alias("actual"),
        best(None).alias("champion"),
        *[best(F.col("mode") == m).alias(f"best_{m}") for m in modes],
    )

"""Logistic regression per series and threshold, chosen and judged chronologically.

There is one solver. Newton's method needs only sums over rows: the loss, its gradient and
its Hessian. A series' *program* asks for such sums, for all of its fits at once, and
goes on with the answers until it can say its result. A series that fits a task is
answered there. Larger series advance together: each round every task answers for the
blocks it holds, the answers are added up, and every program takes its next step. There
is one round for a step of all fits of all series, however many they are.

Sums are taken over parts of 64 rows and added up as a binary tree over the numbers of the
parts. Blocks are aligned with the tree, so a series has the same result, bit for bit,
however it is cut.

All fits minimise C times the log-loss plus half the squared weights of the standardised
features, the intercept free.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import cloudpickle as pickle  # classes of this package travel by value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators.features import RATE_THRESHOLDS, lag_log_features, lag_names, prefix_counts
from tidemark.operators.forecast import check_thresholds, frequency_forecast, with_next
from tidemark.plans.lineage import new_folder, settle
from tidemark.plans.ordering import declared_layout, task_rows

#: Rows whose sums are one leaf of the tree.
PART = 64

#: Leaves that are in memory with their features at once; a power of two.
LEAVES = 64

#: Leaves whose sums for fits are taken at once, few enough for a processor's cache.
NEAR = 16

#: Rows of a block that is kept packed for all rounds; a power of two.
BLOCK = 8192

#: Nodes of a series that one task adds up; a power of two.
FOLD = 256


# --- sums over rows ------------------------------------------------------------------------


@dataclass
class Rows:
    """Consecutive samples of a series; the first rank is a multiple of ``PART``."""

    rank: np.ndarray
    x: np.ndarray
    hits: np.ndarray
    prior: np.ndarray

    @classmethod
    def of(cls, pdf: pd.DataFrame) -> Rows:
        pdf = pdf.sort_values("rank")

        def matrix(name: str) -> np.ndarray:
            return np.stack(pdf[name].to_numpy()).astype(float) if len(pdf) else np.zeros((0, 0))

        return cls(pdf["rank"].to_numpy(), matrix("x"), matrix("hits"), matrix("prior"))

    def leaves(self, at: int, priors: bool = True) -> Rows:
        """``LEAVES`` parts from the row ``at``, filled up with rows of rank -1."""
        rows = slice(at, at + LEAVES * PART)
        n = len(self.rank[rows])
        shape = (-(-n // PART), PART)

        def filled(a: np.ndarray, value: float = 0.0) -> np.ndarray:
            if n == shape[0] * PART:
                return a[rows].reshape(*shape, *a.shape[1:])
            out = np.full((shape[0] * PART, *a.shape[1:]), value, a.dtype)
            out[:n] = a[rows]
            return out.reshape(*shape, *a.shape[1:])

        return Rows(filled(self.rank, -1), filled(self.x), filled(self.hits), filled(self.prior) if priors else None)

    def within(self, lo: int, hi: int) -> np.ndarray:
        return ((self.rank >= lo) & (self.rank < hi)).astype(float)


def by_column(a: np.ndarray) -> np.ndarray:
    """(leaf, row, column) as (leaf, column, row), in this order also in memory, on which sums depend."""
    return np.ascontiguousarray(a.transpose(0, 2, 1))


def tree_sum(nodes: np.ndarray) -> np.ndarray:
    """Sum over the first axis by neighbours, so that aligned cuts change no bit of it."""
    while len(nodes) > 1:
        if len(nodes) % 2:
            nodes = np.concatenate([nodes, np.zeros_like(nodes[:1])])
        nodes = nodes[0::2] + nodes[1::2]
    return nodes[0]


@dataclass
class Fit:
    """One fit: the ranks it learns from, its target, its scale, and where Newton's method is."""

    lo: int
    hi: int
    target: int
    c: float
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    trial: np.ndarray = None
    loss: float | None = None
    step: np.ndarray | None = None
    size: float = 1.0
    steps: int = 0
    done: bool = False

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.w[0] + ((x - self.mean) / self.scale) @ self.w[1:])

    def take(self, loss: float, gradient: np.ndarray, hessian: np.ndarray) -> None:
        """Go on with the sums at the trial weights: accept them, or halve the step."""
        ridge = np.ones(len(self.w))
        ridge[0] = 0.0
        now = self.c * loss + 0.5 * float((ridge * self.trial * self.trial).sum())
        if self.loss is not None and now > self.loss + 1e-13 * max(1.0, abs(self.loss)):
            self.size /= 2
            self.done = self.size < 1e-8
            self.trial = self.w - self.size * self.step
            return
        gradient = self.c * gradient + ridge * self.trial
        little = self.loss is not None and self.loss - now < 1e-13 * max(1.0, abs(now))
        self.w, self.loss, self.size, self.steps = self.trial, now, 1.0, self.steps + 1
        self.done = little or np.abs(gradient).max() < 1e-10 or self.steps > 100
        self.step = np.linalg.solve(self.c * hessian + np.diag(ridge + 1e-12), gradient)
        self.trial = self.w - self.step


def _sigmoid(margin: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(margin, -700, 700)))


@dataclass
class Moments:
    """For each range of ranks: rows, shifted sums and squares of x, hits, and the loss of the prior."""

    ranges: list[tuple[int, int]]
    shift: np.ndarray
    places: int | None = None

    def sums(self, part: Rows) -> np.ndarray:
        x, hits = by_column(part.x) - self.shift[:, None], by_column(part.hits)
        prior = by_column(part.prior if self.places is None else np.round(part.prior, self.places))
        each = np.concatenate([np.ones_like(x[:, :1]), x, x * x, hits, (prior - hits) ** 2], axis=1)
        within = np.stack([part.within(lo, hi) for lo, hi in self.ranges], axis=1)
        return np.matmul(within, each.transpose(0, 2, 1)).reshape(len(x), -1)

    def read(self, sums: np.ndarray, width: int, targets: int) -> list[dict]:
        out = []
        for one in np.split(sums, len(self.ranges)):
            n, x, xx, hits, off = np.split(one, np.cumsum([1, width, width, targets]))
            n = int(n[0])
            mean = x / max(n, 1)
            spread = np.sqrt(np.maximum(xx / max(n, 1) - mean * mean, 0.0))
            out.append({"n": n, "mean": self.shift + mean, "scale": np.where(spread > 0, spread, 1.0), "hits": hits, "prior_loss": off / max(n, 1)})
        return out


def of_same_ranks(fits: list[Fit]) -> dict[tuple[int, int], list[int]]:
    """The places of fits that learn from the same ranks, and so have one scale."""
    found: dict[tuple[int, int], list[int]] = {}
    for i, f in enumerate(fits):
        found.setdefault((f.lo, f.hi), []).append(i)
    return found


def scaled(part: Rows, fit: Fit) -> np.ndarray:
    """Ones and the standardised features as columns."""
    leaves, rows, width = part.x.shape
    z = np.ones((leaves, width + 1, rows))
    np.subtract(part.x.transpose(0, 2, 1), fit.mean[:, None], out=z[:, 1:])
    z[:, 1:] /= fit.scale[:, None]
    return z


@dataclass
class Newton:
    """For each fit: the log-loss, its gradient and its Hessian at the trial weights."""

    fits: list[Fit]

    def sums(self, part: Rows) -> np.ndarray:
        d = len(self.fits[0].trial)
        out = np.zeros((len(part.rank), len(self.fits), 1 + d + d * (d + 1) // 2))
        for (lo, hi), mine in of_same_ranks(self.fits).items():
            fits, m, z = [self.fits[i] for i in mine], part.within(lo, hi)[:, None], scaled(part, self.fits[mine[0]])
            trials, targets = np.stack([f.trial for f in fits]), [f.target for f in fits]
            hits = by_column(part.hits)
            for at in range(0, len(z), NEAR):
                near = slice(at, at + NEAR)
                if m[near].any():
                    out[near, mine] = self._together(z[near], hits[near][:, targets], trials, m[near])
        return out.reshape(len(out), -1)

    @staticmethod
    def _together(z: np.ndarray, y: np.ndarray, trials: np.ndarray, m: np.ndarray) -> np.ndarray:
        d = z.shape[1]
        margin = np.maximum(np.matmul(trials, z), -700.0)
        small = np.exp(-margin)
        p = 1.0 / (1.0 + small)
        loss, miss, weight = np.log1p(small) + (margin - y * margin), p - y, p - p * p
        if not m.all():
            loss, miss, weight = m * loss, m * miss, m * weight
        # Hessians are symmetric: each product of two columns is taken once.
        pairs, k = np.empty((len(z), d * (d + 1) // 2, z.shape[2])), 0
        for i in range(d):
            np.multiply(z[:, i : i + 1], z[:, i:], out=pairs[:, k : k + d - i])
            k += d - i
        return np.concatenate([loss.sum(axis=2)[..., None], np.matmul(miss, z.transpose(0, 2, 1)), np.matmul(weight, pairs.transpose(0, 2, 1))], axis=2)

    def read(self, sums: np.ndarray) -> None:
        for f, one in zip(self.fits, np.split(sums, len(self.fits))):
            d = len(f.trial)
            hessian = np.zeros((d, d))
            hessian[np.triu_indices(d)] = hessian.T[np.triu_indices(d)] = one[d + 1 :]
            f.take(float(one[0]), one[1 : d + 1], hessian)


@dataclass
class Losses:
    """For each fit: the sum of squared errors of its probabilities on other ranks."""

    fits: list[Fit]
    lo: int
    hi: int

    def sums(self, part: Rows) -> np.ndarray:
        m = part.within(self.lo, self.hi)
        out = np.zeros((len(m), len(self.fits)))
        if m.any():
            for i, f in enumerate(self.fits):
                out[:, i] = (m * (f.probability(part.x) - part.hits[..., f.target]) ** 2).sum(axis=1)
        return out


def answer(rows: Rows, ask: Moments | Newton | Losses) -> np.ndarray:
    """The sums over all rows."""
    chunks = range(0, len(rows.rank), LEAVES * PART)
    return tree_sum(np.stack([tree_sum(ask.sums(rows.leaves(at, isinstance(ask, Moments)))) for at in chunks]))


#: Asks for sums and ends with rows of the result.
Program = Generator["Moments | Newton | Losses", np.ndarray, list]


def newton(fits: list[Fit]) -> Generator[Newton, np.ndarray, None]:
    """Run all fits to their ends, together."""
    while active := [f for f in fits if not f.done]:
        ask = Newton(active)
        ask.read((yield ask))


def losses(fits: list[Fit], lo: int, hi: int) -> Generator[Losses, np.ndarray, np.ndarray]:
    """Mean squared errors on ranks from ``lo`` to before ``hi``."""
    if not fits:
        return np.zeros(0)
    return (yield Losses(fits, lo, hi)) / (hi - lo)


def start(stats: dict, lo: int, hi: int, target: int, c: float) -> Fit:
    """A fit whose weights are zero but for the intercept of the rate of hits."""
    rate = min(max(stats["hits"][target] / stats["n"], 1e-9), 1 - 1e-9)
    w = np.zeros(len(stats["mean"]) + 1)
    w[0] = np.log(rate / (1 - rate))
    return Fit(lo, hi, target, c, stats["mean"], stats["scale"], w, trial=w)


def both_classes(stats: dict, target: int) -> bool:
    return 0 < stats["hits"][target] < stats["n"]


def in_task(program: Program, rows: Rows) -> list:
    """The result of a program whose rows are all here."""
    try:
        ask = next(program)
        while True:
            ask = program.send(answer(rows, ask))
    except StopIteration as end:
        return end.value


def fit_logistic(x: np.ndarray, y: np.ndarray, c: float) -> Fit:
    """One fit of rows that are all here."""
    rows = Rows(np.arange(len(x)), np.asarray(x, float), np.asarray(y, float)[:, None], np.zeros((len(x), 1)))

    def program() -> Program:
        ask = Moments([(0, len(x))], rows.x[0])
        stats = ask.read((yield ask), rows.x.shape[1], 1)[0]
        fit = start(stats, 0, len(x), 0, c)
        yield from newton([fit])
        return fit

    return in_task(program(), rows)


# --- programs of many series -----------------------------------------------------------------


def _frame(rows: list, names: list[str]) -> pd.DataFrame:
    """Plain objects: strings in Arrow's own form may come in chunks, which a result refuses."""
    return pd.DataFrame(rows, columns=names, dtype=object)


def _fresh(df: DataFrame) -> DataFrame:
    """The same columns under new identities, for a table that meets what was derived from it."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


@dataclass
class Work:
    """The series whose programs are to run.

    ``rows`` has all rows of a series, from which ``read`` makes, in a task, what the program is
    made from and the samples. The same as tables, for series that no task holds: ``heads``,
    one row for each series, with the number of its ``samples``, and ``samples`` with
    (series, rank, x, hits, prior).
    """

    rows: DataFrame
    read: Callable[[pd.DataFrame], tuple[dict, pd.DataFrame]]
    heads: DataFrame
    samples: DataFrame


def run_programs(work: Work, program: Callable[[dict], Program], schema: str) -> DataFrame:
    """The result rows of every series' program.

    Series of more samples than the rows of a task go in rounds, if there are any; the others
    are one task's work.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        head, samples = work_read(pdf)
        return _frame(in_task(program(head), Rows.of(samples)), names)

    work_read = work.read
    declared = declared_layout(work.rows)
    limit = task_rows(work.rows)
    if declared is None or not declared.whole:
        heads = settle(work.heads)
        most = heads.agg(F.max("samples")).first()[0] or 0
        if most > limit:
            large = heads.where(F.col("samples") > limit)
            others = _fresh(heads.where(F.col("samples") <= limit).select("series"))
            small = work.rows.join(others, "series", "left_semi").groupBy("series").applyInPandas(kernel, schema)
            return small.unionByName(_in_rounds(large, _fresh(work.samples), program, schema, limit, most))
    return work.rows.groupBy("series").applyInPandas(kernel, schema)


STATE = "series string, log binary, ask binary, result binary"


def _in_rounds(large: DataFrame, rows: DataFrame, program, schema: str, limit: int, most: int) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    size = PART
    while 2 * size <= min(limit, BLOCK):
        size *= 2
    cut = rows.join(large.select("series"), "series", "left_semi").withColumn("block", F.floor(F.col("rank") / size).cast("bigint"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return _frame([(pdf["series"].iloc[0], pdf["block"].iloc[0], pickle.dumps(Rows.of(pdf)))], ["series", "block", "rows"])

    # Rows are shuffled once; rounds send the questions to the blocks, and the blocks stay.
    packed = settle(cut.groupBy("series", "block").applyInPandas(pack, "series string, block bigint, rows binary"))

    def advance(head: dict, log: list[np.ndarray]) -> tuple:
        """Run the program again from its start with the answers so far: its next question, or its end."""
        running = program(head)
        try:
            ask = next(running)
            for sums in log:
                ask = running.send(sums)
            return (head["series"], pickle.dumps(log), pickle.dumps(ask), None)
        except StopIteration as end:
            return (head["series"], None, None, pickle.dumps(end.value))

    def step(head: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        made = []
        for h, s in zip(head.to_dict("records"), state.to_dict("records") or [{}]):
            if s.get("result") is not None:
                made.append((h["series"], None, None, s["result"]))
            else:
                log = pickle.loads(s["log"]) + [pickle.loads(s["node"])] if s.get("log") is not None else []
                made.append(advance(h, log))
        return _frame(made, ["series", "log", "ask", "result"])

    def measure(batches):
        for pdf in batches:
            made = []
            for one in pdf.itertuples(index=False):
                made.append((one.series, one.block, pickle.dumps(answer(pickle.loads(one.rows), pickle.loads(one.ask)))))
            yield _frame(made, ["series", "block", "node"])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        nodes = np.stack([pickle.loads(n) for n in pdf["node"]])
        return _frame([(pdf["series"].iloc[0], pdf["block"].iloc[0] // FOLD, pickle.dumps(tree_sum(nodes)))], ["series", "block", "node"])

    def kept(df: DataFrame) -> DataFrame:
        """Written as files: a checkpoint keeps the estimated size, a product that has twice the digits each round."""
        folder = new_folder(large.sparkSession, "rounds")
        df.write.parquet(folder)
        return large.sparkSession.read.schema(STATE).parquet(folder)

    nothing = large.sparkSession.createDataFrame([], STATE + ", node binary")
    state = kept(large.groupBy("series").cogroup(nothing.groupBy("series")).applyInPandas(step, STATE))
    while not state.where("ask is not null").isEmpty():
        # One question for each series of more rows than a task.
        asks = F.broadcast(_fresh(state.where("ask is not null").select("series", "ask")))
        nodes = _fresh(packed).join(asks, "series").mapInPandas(measure, "series string, block bigint, node binary")
        n_blocks = -(-most // size)
        while True:
            nodes = nodes.groupBy("series", F.floor(F.col("block") / FOLD).alias("_up")).applyInPandas(fold, "series string, block bigint, node binary")
            if n_blocks <= FOLD:
                break
            n_blocks = -(-n_blocks // FOLD)
        told = _fresh(state).join(_fresh(nodes.select("series", "node")), "series", "left")
        state = kept(large.groupBy("series").cogroup(told.groupBy("series")).applyInPandas(step, STATE))

    def unpack(batches):
        for pdf in batches:
            yield _frame([r for result in pdf["result"] for r in pickle.loads(result)], names)

    return state.select("result").mapInPandas(unpack, schema)


# --- samples ---------------------------------------------------------------------------


def labelled_samples(outcomes: DataFrame, thresholds: Sequence[str]) -> DataFrame:
    """Warm targets with the history vector, hits and prior frequencies per threshold."""
    counted = prefix_counts(outcomes.select("series", "outcome_id", "ts", "value"), thresholds)
    rows = lag_log_features(counted)
    limits = [F.lit(t).cast("decimal(18,6)") for t in thresholds]
    return rows.select(
        "series", "outcome_id", "pos",
        F.array(*lag_names(5, RATE_THRESHOLDS)).alias("x"),
        F.array(*[C.hit("value", t) for t in limits]).alias("hits"),
        F.array(*[F.col(f"hits_{i}").cast("double") / F.col("n") for i in range(len(limits))]).alias("prior"),
    )


def chronological_split(
    samples: DataFrame, validation_fraction: float = 0.2, test_fraction: float = 0.2
) -> DataFrame:
    """Label samples train / validation / test per series by position.

    The test part is max(1, int(n * f)) last rows, validation the part before it. The
    rank is the position less the first position, as samples are consecutive.
    """
    if not (0 < validation_fraction and 0 < test_fraction and validation_fraction + test_fraction < 1):
        raise ValueError("fractions must be positive and sum to less than 1.")
    sizes = samples.groupBy("series").agg(
        F.count("*").alias("samples"), F.min("pos").alias("_first")
    )
    n = F.col("samples")
    test_start = n - F.greatest(F.lit(1), F.floor(n * F.lit(test_fraction)))
    validation_start = test_start - F.greatest(F.lit(1), F.floor(n * F.lit(validation_fraction)))
    rank = F.col("pos") - F.col("_first")
    part = F.when(rank >= test_start, "test").when(rank >= validation_start, "validation")
    rows = samples.join(sizes, "series").where((n >= 5) & (validation_start >= 1))
    return rows.withColumns({"rank": rank, "part": part.otherwise("train")}).drop("_first")


EXPERIMENT = (
    "series string, threshold double, status string, selected_c double, train_rows bigint, "
    "validation_rows bigint, test_rows bigint, validation_brier double, test_brier double, "
    "baseline_test_brier double, test_positive_rate double, intercept double, weights array<double>"
)


def logistic_experiment(
    outcomes: DataFrame,
    thresholds: Sequence[str] = ("1.5", "2", "5"),
    c_values: Sequence[float] = (0.1, 1.0, 10.0),
    validation_fraction: float = 0.2,
    test_fraction: float = 0.2,
) -> DataFrame:
    """Choose C on validation rows, refit, and score the untouched test rows.

    The baseline is the expanding frequency, rounded to 6 places as published. The intercept
    and the weights of the refit belong to the features as they are.
    """
    thresholds = check_thresholds(thresholds)
    numbers, grid = [float(t) for t in thresholds], [float(c) for c in c_values]
    split = chronological_split(labelled_samples(outcomes, thresholds), validation_fraction, test_fraction)
    heads = split.groupBy("series").agg(
        F.count("*").alias("samples"), F.count_if(F.col("part") == "train").alias("train"),
        F.count_if(F.col("part") != "test").alias("known"), F.min_by("x", "rank").alias("shift"),
    )

    def program(head: dict) -> Program:
        n, train, known, shift = int(head["samples"]), int(head["train"]), int(head["known"]), np.array(head["shift"], float)
        ask = Moments([(0, train), (0, known), (known, n)], shift, places=6)
        learned, before, test = ask.read((yield ask), len(shift), len(numbers))
        able = [k for k in range(len(numbers)) if both_classes(learned, k)]
        fits = [start(learned, 0, train, k, c) for k in able for c in grid]
        yield from newton(fits)
        score = dict(zip([(f.target, f.c) for f in fits], (yield from losses(fits, train, known))))
        best = {k: min(grid, key=lambda c: (score[k, c], c)) for k in able}
        final = [start(before, 0, known, k, best[k]) for k in able]
        yield from newton(final)
        tested = dict(zip(able, (yield from losses(final, known, n))))
        weights = {f.target: f.w[1:] / f.scale for f in final}
        rows = []
        for k, threshold in enumerate(numbers):
            row = [head["series"], threshold, "INSUFFICIENT_CLASS_VARIATION", None, train, known - train, n - known]
            row += [None, None, None, float(test["hits"][k] / test["n"]), None, None]
            if k in best:
                row[2:4] = "COMPLETE", best[k]
                row[7:10] = float(score[k, best[k]]), float(tested[k]), float(test["prior_loss"][k])
                fit = final[able.index(k)]
                row[11:] = float(fit.w[0] - weights[k] @ fit.mean), weights[k].tolist()
            rows.append(row)
        return rows

    def read(pdf: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
        part = pdf["part"]
        first = pdf["x"].iloc[pdf["rank"].to_numpy().argmin()]
        return {"series": pdf["series"].iloc[0], "samples": len(pdf), "train": (part == "train").sum(), "known": (part != "test").sum(), "shift": first}, pdf

    samples = split.select("series", "rank", "x", "hits", "prior")
    return run_programs(Work(split.drop("outcome_id", "pos"), read, heads, samples), program, EXPERIMENT)


# Names, reasons and defaults of the challenger, as ledgers carry them.
DECISION = (
    "series string, threshold double, source string, reason string, probability double, "
    "baseline_probability double, raw_candidate_probability double, selected_c double, "
    "tune_samples bigint, gate_samples bigint, candidate_brier double, baseline_brier double, "
    "candidate_skill_pct double, candidate_weight double, history_count bigint"
)


@dataclass(frozen=True)
class ChallengerConfig:
    min_history: int = 140
    min_train_rows: int = 60
    tune_rows: int = 40
    gate_rows: int = 60
    min_gate_rows: int = 40
    min_skill_pct: float = 3.0
    max_candidate_weight: float = 0.65
    max_probability_shift: float = 0.10
    c_values: tuple[float, ...] = (0.03, 0.1, 0.3, 1.0)

    def sizes(self, n: int) -> tuple[int, int, int]:
        """Rows to train, tune and gate, of ``n`` samples."""
        gate = min(self.gate_rows, n - self.min_train_rows - self.tune_rows)
        gate = max(self.min_gate_rows, gate)
        tune = min(self.tune_rows, n - self.min_train_rows - gate)
        return n - tune - gate, tune, gate

    def too_early(self, history: int, samples: int) -> str | None:
        if history < self.min_history:
            return "insufficient_challenger_history"
        if samples < self.min_train_rows + self.tune_rows + self.min_gate_rows:
            return "insufficient_challenger_rows"
        return None

    def blend(self, gate: int, skill: float, raw: float, base: float) -> tuple[float, float]:
        """Weight of an accepted candidate and the blended probability."""
        evidence = gate / max(self.gate_rows, 1) * 0.45 + min(max(skill, 0.0), 25.0) / 25.0 * 0.20
        weight = min(self.max_candidate_weight, max(0.20, evidence))
        shift = (raw - base) * weight
        shift = max(-self.max_probability_shift, min(self.max_probability_shift, shift))
        return weight, min(1.0, max(0.0, base + shift))


@dataclass
class Decision:
    """What is known of the forecast of one threshold."""

    threshold: float
    base: float | None
    reason: str = "baseline_not_ready"
    used: dict = field(default_factory=dict)

    def row(self, series: str, history: int) -> dict:
        row = dict.fromkeys(c.split()[0] for c in DECISION.split(", "))
        return row | {
            "series": series, "threshold": self.threshold, "source": "historical_baseline", "reason": self.reason,
            "probability": self.base, "baseline_probability": self.base, "tune_samples": 0, "gate_samples": 0, "history_count": history,
        } | self.used


def gated_program(head: dict, numbers: Sequence[float], config: ChallengerConfig) -> Program:
    """Decide on the forecasts of one series.

    ``head`` has series, history_count, base (a probability for each threshold), samples,
    shift (any features, to centre sums) and ahead (the features of the coming outcome).
    """
    count, n = int(head["history_count"]), int(head["samples"])
    decisions = [Decision(t, None if b is None or b != b else float(b)) for t, b in zip(numbers, head["base"])]
    early = config.too_early(count, n)
    ready = [k for k, d in enumerate(decisions) if d.base is not None and not early]
    if early:
        for d in decisions:
            d.reason = early
    if ready:
        train, tune, gate = config.sizes(n)
        shift, ahead = np.array(head["shift"], float), np.array(head["ahead"], float)
        ask = Moments([(0, train), (0, train + tune), (0, n), (train + tune, n)], shift)
        learned, tuned, everything, judged = ask.read((yield ask), len(shift), len(numbers))
        for k in ready:
            decisions[k].reason = "insufficient_train_class_variation"
            decisions[k].used = {"tune_samples": tune, "gate_samples": gate}
        ready = [k for k in ready if both_classes(learned, k)]
        fits = [start(learned, 0, train, k, c) for k in ready for c in config.c_values]
        yield from newton(fits)
        score = dict(zip([(f.target, f.c) for f in fits], (yield from losses(fits, train, train + tune))))
        chosen = {k: min(config.c_values, key=lambda c: (score[k, c], c)) for k in ready}
        fits = [start(tuned, 0, train + tune, k, chosen[k]) for k in ready]
        yield from newton(fits)
        accepted = {}
        for k, candidate in zip(ready, (yield from losses(fits, train + tune, n))):
            baseline, candidate = float(judged["prior_loss"][k]), float(candidate)
            skill = (baseline - candidate) / baseline * 100 if baseline > 0 else 0.0
            decisions[k].used |= {
                "selected_c": chosen[k], "candidate_brier": round(candidate, 6), "baseline_brier": round(baseline, 6), "candidate_skill_pct": round(skill, 6),
            }
            decisions[k].reason = "chronological_gate_rejected"
            if gate >= config.min_gate_rows and candidate < baseline and skill >= config.min_skill_pct:
                accepted[k] = skill
        fits = [start(everything, 0, n, k, chosen[k]) for k in accepted]
        yield from newton(fits)
        for fit, (k, skill) in zip(fits, accepted.items()):
            raw = float(fit.probability(ahead))
            weight, blended = config.blend(gate, skill, raw, decisions[k].base)
            decisions[k].reason = "chronological_gate_passed"
            decisions[k].used |= {
                "source": "gated_logistic_challenger", "probability": round(blended, 6),
                "raw_candidate_probability": round(raw, 6), "candidate_weight": round(weight, 6),
            }
    rows, previous = [d.row(head["series"], count) for d in decisions], None
    for row in rows:  # probabilities do not rise with the threshold
        p = row["probability"]
        if p is not None:
            row["probability"] = previous = p if previous is None else min(previous, p)
    return [list(row.values()) for row in rows]


def gated_logistic_forecast(
    outcomes: DataFrame,
    thresholds: Sequence[str] = ("1.5", "2", "5"),
    min_history: int = 50,
    config: ChallengerConfig | None = None,
    window: int | None = None,
) -> DataFrame:
    """Forecast the next outcome of each series: frequency, or a blend that has earned it.

    A logistic challenger is tuned and then gated on later rows it never saw. It moves
    the frequency only if it beat it on the gate; probabilities are finally clamped so
    that they do not rise with the threshold. With ``window`` the frequency is rolling.
    """
    thresholds = check_thresholds(thresholds)
    config = config or ChallengerConfig()
    numbers = [float(t) for t in thresholds]
    extended = with_next(outcomes.select("series", "outcome_id", "ts", "value"))
    upcoming = F.col("value").isNull()
    mode = "expanding" if window is None else "rolling"
    base = frequency_forecast(extended, thresholds, mode, window, min_history).where(upcoming)
    base = base.groupBy("series").agg(
        F.max("available").alias("history_count"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("threshold", "probability"))),
            lambda e: e["probability"].cast("double"),
        ).alias("base"),
    )
    samples = labelled_samples(extended, thresholds)
    past = F.col("outcome_id").isNotNull()
    sizes = samples.groupBy("series").agg(
        F.count("outcome_id").alias("samples"), F.min("pos").alias("first"), F.min_by("x", "pos").alias("shift"),
        F.max(F.when(~past, F.col("x"))).alias("ahead"),
    )
    heads = base.join(sizes, "series", "left").withColumn("samples", F.coalesce("samples", F.lit(0)))
    cut = samples.where(past).join(sizes.select("series", "first"), "series")
    cut = cut.select("series", (F.col("pos") - F.col("first")).alias("rank"), "x", "hits", "prior")

    def read(pdf: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
        head = {n: pdf[n].iloc[0] for n in ("series", "history_count", "base")}
        pdf = pdf[pdf["x"].notna()].sort_values("pos")
        known, ahead = pdf[pdf["outcome_id"].notna()], pdf[pdf["outcome_id"].isna()]
        head |= {"samples": len(known), "shift": pdf["x"].iloc[0] if len(pdf) else None, "ahead": ahead["x"].iloc[0] if len(ahead) else None}
        return head, known.assign(rank=known["pos"] - (known["pos"].iloc[0] if len(known) else 0))

    work = Work(samples.join(base, "series", "right"), read, heads.drop("first"), cut)
    return run_programs(work, lambda head: gated_program(head, numbers, config), DECISION)

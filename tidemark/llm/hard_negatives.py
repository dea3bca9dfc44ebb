"""Hard-negative mining by exact inner products behind segment summaries.

Each vector is stored with the mean and the deviation of its segments, at levels of 1, 2, 4,
... segments. Over a segment of length l, the inner product of two vectors lies within
``l * (mean * mean')`` plus or minus ``l * (deviation * deviation')``; the sums over all
segments bound the score, more tightly at each level. A pair is refined level by level only as
long as its bounds still allow a result, and scored exactly only after the last level.

Anchors take part in blocks of a bounded number of bytes. Every block is one scan of all
vectors for the positives and one for the negatives; a task keeps the best rows of each anchor
among those it reads, whatever the label, so neither a hot label nor a hot vector is one
task's work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.shared import pieces, written

#: Largest magnitude of an integer component.
MOST = 1 << 26

#: Rows that meet a block of anchors at once.
ROWS = 512

#: Bytes of the anchors of one block, with their summaries.
BLOCK_BYTES = 4 << 20

#: Segments of the finest level, at most.
SEGMENTS = 16

#: Share of pairs above which a level is computed for whole matrices instead of pair by pair.
DENSE = 0.1

POSITIVES = "anchor long, positive long, n_positive long, positive_score long"
NEGATIVES = "anchor long, positive_place int, negative long, negative_score long"


def levels(size: int) -> list[np.ndarray]:
    """The starts of the segments of each level, for vectors of ``size`` components."""
    out, n = [], 1
    while n <= min(SEGMENTS, max(1, size)):
        out.append(np.arange(n) * size // n)
        n *= 2
    return out


def summaries(x: np.ndarray) -> np.ndarray:
    """Means and deviations of all segments of all levels, each times the root of its length.

    With that factor the sum of products of two rows of means is the middle of their bounds,
    and that of deviations the half width. Columns: the means of a level, then its deviations.
    """
    n, size = x.shape
    if not size:
        return np.zeros((n, 2))
    x = x.astype(np.float64)
    out = []
    for starts in levels(size):
        length = np.diff(np.append(starts, size))
        mean = np.add.reduceat(x, starts, axis=1) / length
        off = np.add.reduceat((x - np.repeat(mean, length, axis=1)) ** 2, starts, axis=1)
        out += [mean * np.sqrt(length), np.sqrt(off)]
    return np.concatenate(out, axis=1)


def stored_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> tuple[DataFrame, int]:
    """row, id, label, q (integers) and summary (doubles) of the rows that take part, and the size.

    Shorter vectors are filled with zeros, which leave inner products unchanged. Written to the
    shared folder once; rows keep their number from then on.
    """
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform(vector, lambda x: F.floor(F.when(F.abs(x) * scale <= MOST, x * scale).otherwise(F.raise_error(F.lit("a component is too large to score exactly")).cast("double"))))
    some = df.where(finite & F.col(f"`{label_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull()).select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), whole.alias("q")
    )
    size = some.agg(F.max(F.size("q"))).first()[0] or 0

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 4096):
            lists = batch.column(3)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            x = np.zeros((batch.num_rows, size), np.int32)
            x[np.arange(size) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], _packed(x), _packed(summaries(x))], ["row", "id", "label", "q", "summary"])

    return written(some.mapInArrow(pack, "row long, id long, label long, q binary, summary binary"), "vectors"), size


def _packed(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in x], pa.binary())


def _unpacked(column: pa.Array, dtype: type) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, dtype).reshape(len(column), -1) if data else np.zeros((len(column), 0), dtype)


class Vectors:
    """Some rows: numbers, ids, labels, integer components and summaries."""

    def __init__(self, columns: list[pa.Array]):
        self.row, self.id, self.label = (c.to_numpy(zero_copy_only=False) for c in columns[:3])
        self.q = _unpacked(columns[3], np.int32)
        self.summary = _unpacked(columns[4], np.float64)

    def __len__(self) -> int:
        return len(self.row)


def _most(a: np.ndarray, b: np.ndarray) -> int:
    """No score of these rows has a greater magnitude; an error if that does not fit 64 bits."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most >= 1 << 63:
        raise OverflowError("scores do not fit 64 bits")
    return most


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products; by doubles where those are exact, by integers otherwise."""
    if _most(a, b) < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def candidates(anchors: Vectors, rows: Vectors, alive: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (anchor, row) of ``alive`` with a score of ``low`` to ``high`` of the anchor, and the scores.

    While many pairs are possible, a level's bounds are products of matrices; later levels look
    at the pairs that are left. Bounds are widened by what rounding may cost, so no pair is lost.
    """
    size = anchors.q.shape[1]
    slack = 1e-9 * (1 + _most(anchors.q, rows.q))
    least, most = low - slack, high + slack
    steps, at = [], 0
    for starts in levels(size) if size else ():
        steps.append((slice(at, at + len(starts)), slice(at + len(starts), at + 2 * len(starts))))
        at += 2 * len(starts)
    while steps and np.count_nonzero(alive) > DENSE * alive.size:
        mean, deviation = steps.pop(0)
        middle = anchors.summary[:, mean] @ rows.summary[:, mean].T
        width = anchors.summary[:, deviation] @ rows.summary[:, deviation].T
        alive = alive & (middle + width >= least[:, None]) & (middle - width <= most[:, None])
    a, r = np.nonzero(alive)
    for mean, deviation in steps:
        middle = np.einsum("ij,ij->i", anchors.summary[a, mean], rows.summary[r, mean])
        width = np.einsum("ij,ij->i", anchors.summary[a, deviation], rows.summary[r, deviation])
        possible = (middle + width >= least[a]) & (middle - width <= most[a])
        a, r = a[possible], r[possible]
    if len(a) > DENSE * alive.size:
        score = _exact(anchors.q, rows.q)[a, r]
    else:
        score = np.einsum("ij,ij->i", anchors.q[a].astype(np.int64), rows.q[r].astype(np.int64))
    fits = (score >= low[a]) & (score <= high[a])
    return a[fits], r[fits], score[fits]


class Best:
    """The first ``most`` rows of each group by falling score, then rising id."""

    def __init__(self, groups: int, most: int):
        self.most = most
        self.group, self.score, self.id, self.row = (np.zeros(0, np.int64) for _ in range(4))
        #: A row with a lower score than this cannot be among the first of its group.
        self.least = np.full(groups, -np.inf)

    def add(self, group: np.ndarray, score: np.ndarray, id: np.ndarray, row: np.ndarray) -> None:
        fits = score >= self.least[group]
        if not fits.any():
            return
        g, s, i, r = (np.concatenate([old, new[fits]]) for old, new in ((self.group, group), (self.score, score), (self.id, id), (self.row, row)))
        order = np.lexsort((r, i, -s, g))
        g, s, i, r = g[order], s[order], i[order], r[order]
        first = np.r_[True, g[1:] != g[:-1]]
        place = np.arange(len(g)) - np.maximum.accumulate(np.where(first, np.arange(len(g)), 0))
        kept = place < self.most
        self.group, self.score, self.id, self.row = g[kept], s[kept], i[kept], r[kept]
        full = place[kept] == self.most - 1
        self.least[self.group[full]] = self.score[full]


def _find_positives(anchors: Vectors, most: int) -> Callable:
    """For mapInArrow: a task's first rows of each anchor's label, other than the anchor."""

    def run(batches):
        best = Best(len(anchors), most)
        for batch in pieces(batches, ROWS):
            rows = Vectors(batch.columns)
            alive = (anchors.label[:, None] == rows.label) & (anchors.row[:, None] != rows.row)
            a, r, score = candidates(anchors, rows, alive, best.least, np.full(len(anchors), np.inf))
            best.add(a, score, rows.id[r], rows.row[r])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (anchors.row[best.group], best.id, best.row, best.score)], ["anchor", "positive", "n_positive", "positive_score"])

    return run


def _find_negatives(anchors: Vectors, window: np.ndarray, most: int, low: np.ndarray, high: np.ndarray) -> Callable:
    """For mapInArrow: a task's first rows of other labels in each anchor's windows of scores.

    ``window`` has the number of the anchor of each window, in order, ``low`` and ``high`` its
    inclusive ends. An anchor without a window has no part.
    """
    n_windows = np.bincount(window, minlength=len(anchors))
    first = np.cumsum(n_windows) - n_windows

    def per_anchor(values: np.ndarray, reduce: np.ufunc, empty: float) -> np.ndarray:
        out = np.full(len(anchors), empty)
        reduce.at(out, window, values)
        return out

    def run(batches):
        best = Best(len(window), most)
        top = per_anchor(high, np.maximum, -np.inf)
        for batch in pieces(batches, ROWS):
            rows = Vectors(batch.columns)
            least = per_anchor(np.maximum(low, best.least), np.minimum, np.inf)
            alive = (anchors.label[:, None] != rows.label) & (least <= top)[:, None]
            a, r, score = candidates(anchors, rows, alive, least, top)
            for k in range(int(n_windows.max(initial=0))):
                has = k < n_windows[a]
                w, found, s = first[a[has]] + k, r[has], score[has]
                inside = (s >= low[w]) & (s <= high[w])
                best.add(w[inside], s[inside], rows.id[found[inside]], rows.row[found[inside]])
        place = best.group - first[window[best.group]] if len(best.group) else best.group
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchors.row[window[best.group]], pa.int64()), pa.array(place, pa.int32()), pa.array(best.id, pa.int64()), pa.array(best.score, pa.int64())],
            ["anchor", "positive_place", "negative", "negative_score"],
        )

    return run


def _first(found: DataFrame, keys: list[str], score: str, ids: list[str], most: int, place: str) -> DataFrame:
    """The first rows of each key over all tasks, numbered from 0.

    A key has at most ``most`` rows from each task.
    """
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), *ids)
    return found.withColumn(place, F.row_number().over(order) - 1).where(F.col(place) < most)


def mine(
    df: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``every``; an anchor's positives are its first
    other rows of the same label by falling score and rising id, and the negatives of a positive
    the first rows of other labels whose score is ``low`` to ``high`` hundredths of the positive's.
    A rank counts from 1 within a positive. Rows with a null id or label, a null vector, or a null
    or non-finite component take no part; of vectors of unequal size the shared components count.
    Rows are told apart by place, so a repeated row is a row of its own, as a positive of its copy
    too. An empty table and anchors without positives give no rows; other columns are ignored.
    """
    spark = df.sparkSession
    vectors, size = stored_vectors(df, id_col, vector_col, label_col, scale)
    named = written(vectors.where(F.col("id") % every == 0), "anchors")
    bytes_each = 24 + 4 * size + 16 * max(1, sum(len(s) for s in levels(size)))
    blocks = -(-named.count() * bytes_each // block_bytes)
    out = None
    for block in range(blocks):
        some = named.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).orderBy("row").toArrow()
        if not some.num_rows:
            continue
        anchors = Vectors([some.column(i).combine_chunks() for i in range(5)])
        near = vectors.mapInArrow(_find_positives(anchors, positives), POSITIVES)
        near = written(_first(near, ["anchor"], "positive_score", ["positive", "n_positive"], positives, "positive_place"), "positives")
        chosen = near.select("anchor", "positive_place", "positive_score").orderBy("anchor", "positive_place").toArrow()
        window = np.searchsorted(anchors.row, chosen.column(0).to_numpy())
        score = chosen.column(2).to_numpy()
        least, most = -(-low * score // 100), high * score // 100
        far = vectors.mapInArrow(_find_negatives(anchors, window, negatives, least, most), NEGATIVES)
        far = _first(far, ["anchor", "positive_place"], "negative_score", ["negative"], negatives, "rank")
        ids = named.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
        found = far.join(near, ["anchor", "positive_place"]).join(ids, "anchor").select(
            "anchor_id", F.col("positive").alias("positive_id"), (F.col("rank") + 1).cast("int").alias("rank"),
            F.col("negative").alias("negative_id"), "positive_score", "negative_score",
        )
        found = written(found, "negatives")
        out = found if out is None else out.unionByName(found)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.createDataFrame([], schema) if out is None else out

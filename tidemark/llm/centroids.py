"""Centroid clustering of integer vectors, assigned by Orchard's search.

Every centroid keeps the other centroids sorted by distance from it. A vector starts at some
centroid and walks that centroid's list; whenever an unvisited centroid is closer, the walk
goes on at the start of that one's list. It ends where the list's distance lies strictly
beyond twice the current distance: by the triangle inequality, nothing after it can be closer
or as close. All arithmetic is on integers, so sums, ties and floors are exact and results do
not depend on how rows are dealt to tasks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.shared import pieces, written

#: Largest magnitude of a component after scaling: four times the squared distance of 64 of them fits 64 bits.
MOST = 1 << 26

#: Vectors that walk together.
WALKERS = 4096


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int, size: int) -> DataFrame:
    """id, q: ``floor(scale * x)`` of the vectors that have ``size`` finite components.

    Rows with a null vector, another size, or a null or non-finite component go; a scaled
    component of magnitude over 2**26 raises an error, since its distances would not fit.
    """
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = df.where((F.size(vector) == size) & finite)
    scaled = F.transform(vector, lambda x: F.floor(F.when(F.abs(x) * scale <= MOST, x * scale).otherwise(F.raise_error(F.lit("a component is too large to cluster exactly")).cast("double"))))
    return kept.select(F.col(f"`{id_col}`").alias("id"), scaled.alias("q"))


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The ``k`` vectors of the least SHA-256 of seed and id; fewer, if there are fewer.

    Vectors of one id have the same hash and come in the order of their components.
    """
    digest = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    rows = vectors.where(F.col("id").isNotNull()).orderBy(digest, "q").limit(k).collect()
    return np.array([r.q for r in rows], np.int64) if rows else np.zeros((0, 0), np.int64)


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of paired rows."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


class Orchard:
    """Nearest centroids by sorted neighbour lists."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        apart = np.stack([squared_distances(np.broadcast_to(c, centroids.shape), centroids) for c in centroids])
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, axis=1)

    def nearest(self, x: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of each row's nearest centroid; ties take the smaller number.

        Rows walk together, each on its own list: a step visits the next entry of the list of
        the row's current centroid, skips it if visited, and moves to that centroid's list if
        it is closer, or as close with a smaller number.
        """
        n, k = len(x), len(self.centroids)
        best = np.zeros(n, np.int64) if start is None else start.copy()
        dist = squared_distances(x, self.centroids[best])
        visited = np.zeros((n, k), bool)
        visited[np.arange(n), best] = True
        at = np.zeros(n, np.int64)
        walking = np.arange(n)
        while len(walking):
            walking = walking[at[walking] < k]
            # (2 d)^2 in squared distances; strictly beyond, so that ties are still seen.
            walking = walking[self.apart[best[walking], at[walking]] <= 4 * dist[walking]]
            other = self.order[best[walking], at[walking]]
            at[walking] += 1
            fresh = ~visited[walking, other]
            rows, other = walking[fresh], other[fresh]
            visited[rows, other] = True
            d = squared_distances(x[rows], self.centroids[other])
            closer = (d < dist[rows]) | ((d == dist[rows]) & (other < best[rows]))
            moved = rows[closer]
            best[moved], dist[moved], at[moved] = other[closer], d[closer], 0
        return best, dist


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """The rows of a list column, all of one size."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def _sums(vectors: DataFrame, centroids: np.ndarray) -> dict[int, dict[int, int]]:
    """Exact component sums of each centroid's vectors, and their number at place -1.

    Each task adds up what it reads and sends one row for each sum, so that a hot centroid
    costs no more than another.
    """
    k, size = centroids.shape
    tree = Orchard(centroids)

    def add(batches):
        count, total = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for batch in pieces(batches, WALKERS):
            x = _matrix(batch.column(0), size)
            best, _ = tree.nearest(x)
            count += np.bincount(best, minlength=k)
            np.add.at(total, best, x)
        some = np.flatnonzero(count)
        sums = np.concatenate([count[some, None], total[some]], axis=1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(some, size + 1), pa.int32()), pa.array(np.tile(np.arange(-1, size), len(some)), pa.int32()), pa.array(sums.ravel(), pa.int64())],
            ["c", "place", "s"],
        )

    parts = vectors.select("q").mapInArrow(add, "c int, place int, s long")
    out: dict[int, dict[int, int]] = {}
    for r in parts.groupBy("c", "place").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
        out.setdefault(r.c, {})[r.place] = int(r.s)
    return out


def fit(vectors: DataFrame, k: int, rounds: int, seed: str) -> np.ndarray:
    """Centroids after ``rounds`` rounds of assignment and exact floored means; empty ones stay."""
    centroids = first_centroids(vectors, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        for c, sums in _sums(vectors, centroids).items():
            centroids[c] = [sums[i] // sums[-1] for i in range(centroids.shape[1])]
    return centroids


def cluster(
    df: DataFrame, k: int = 8, rounds: int = 10, seed: str = "3:", scale: int = 1024, size: int = 64, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each kept vector.

    Rows whose vector is null, of another size, or has a null or non-finite component take no
    part; other columns are ignored, whatever their names. Repeated rows are vectors of their
    own. A null id cannot become a first centroid, but its vector is assigned. Without kept
    vectors the result is empty. The integer vectors are written to the shared folder once
    and read in every round; the driver holds only the centroids.
    """
    vectors = written(integer_vectors(df, id_col, vector_col, scale, size), "vectors")
    centroids = fit(vectors, k, rounds, seed)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    tree = Orchard(centroids) if len(centroids) else None

    def assign(batches):
        for batch in pieces(batches, WALKERS):
            best, dist = tree.nearest(_matrix(batch.column(1), size)) if tree else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            rows = len(best)
            yield pa.RecordBatch.from_pydict(
                {
                    id_col: batch.column(0).slice(0, rows), "cluster": pa.array(best, pa.int32()), "distance": pa.array(dist, pa.int64()),
                    "centroid_sha256": pa.array([digests[c] for c in best], pa.string()),
                }
            )

    id_type = vectors.schema["id"].dataType.simpleString()
    found = written(vectors.mapInArrow(assign, f"`{id_col}` {id_type}, cluster int, distance long, centroid_sha256 string"), "clusters")
    per = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    return found.select(
        id_col, "cluster", "distance", _of_cluster(per).alias("cluster_inertia"), F.lit(sum(per.values())).cast("long").alias("inertia"), "centroid_sha256"
    )


def _of_cluster(values: dict[int, int]) -> Column:
    """One value for each centroid, of which there are few, as a literal."""
    pairs = [x for c, v in values.items() for x in (F.lit(c), F.lit(v).cast("long"))]
    return F.create_map(*pairs)[F.col("cluster")] if pairs else F.lit(None).cast("long")

"""Centroid clustering of whole-number vectors by equal-average equal-variance search.

Centroids are sorted by the sum of their components. The search for a vector starts where its
own sum would stand and goes outward on both sides. With d components, sums s and deviations
v = sqrt(d * sum(x * x) - s * s), the squared distance D of two vectors obeys
``d * D >= (s1 - s2) ** 2 + (v1 - v2) ** 2``. The first term ends the scan once it exceeds the
best distance so far, since it only grows outward; both terms reject a centroid without reading
its components. The rest is compared in whole numbers, and bounds that rounding could touch are
loosened, so the result is that of comparing everything.

A round is one pass over the vectors: each task assigns its batches and sends one row of counts
and sums a cluster and component, which Spark adds up. Only centroids pass through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import mapped

DIMS = 64
SCALE = 256
CENTROIDS = 40
ROUNDS = 5
REACH = 1 << 24  # whole components lie below it; with up to 512 of them, distances and bounds fit 64 bits
ROWS = 4096  # vectors that are searched together


@dataclass(frozen=True)
class Codebook:
    """Centroids by sum; ``number`` holds their place before sorting."""

    vectors: np.ndarray
    number: np.ndarray
    sums: np.ndarray
    deviations: np.ndarray


def codebook(centroids: np.ndarray) -> Codebook:
    sums = centroids.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    own = centroids[order]
    return Codebook(own, order, sums[order], _deviation(own, sums[order]))


def _deviation(x: np.ndarray, sums: np.ndarray) -> np.ndarray:
    return np.sqrt((x.shape[1] * (x * x).sum(axis=1) - sums * sums).astype(np.float64))


def nearest(x: np.ndarray, book: Codebook) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of the nearest centroid of every row, ties to the smaller
    number, and how many distances were computed."""
    n, d, k = len(x), x.shape[1], len(book.sums)
    sums = x.sum(axis=1)
    spread = _deviation(x, sums)
    best = np.full(n, np.iinfo(np.int64).max // (d + 1), dtype=np.int64)
    number = np.full(n, k, dtype=np.int64)
    hi = np.searchsorted(book.sums, sums)
    lo = hi - 1
    rows, far, computed = np.arange(n), np.iinfo(np.int64).max, 0
    while len(rows):
        s, low, high = sums[rows], lo[rows], hi[rows]
        below = np.where(low >= 0, s - book.sums[low], far)
        above = np.where(high < k, book.sums[np.minimum(high, k - 1)] - s, far)
        down = below <= above
        gap = np.where(down, below, above)
        at = np.where(down, low, high)
        on = gap < far
        on[on] = gap[on] * gap[on] <= d * best[rows[on]]  # the sums alone: the rest lies farther out
        rows, gap, at, down = rows[on], gap[on], at[on], down[on]
        apart = np.maximum(np.abs(spread[rows] - book.deviations[at]) - 1e-5, 0.0)
        bound = (gap.astype(np.float64) ** 2 + apart * apart) * (1 - 1e-12)
        open_ = bound <= (d * best[rows]).astype(np.float64)
        r, c = rows[open_], at[open_]
        away = x[r] - book.vectors[c]
        distance, own = (away * away).sum(axis=1), book.number[c]
        computed += len(r)
        better = (distance < best[r]) | ((distance == best[r]) & (own < number[r]))
        best[r[better]], number[r[better]] = distance[better], own[better]
        lo[rows[down]] -= 1
        hi[rows[~down]] += 1
    return number, best, computed


def _whole(df: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> tuple[DataFrame, DataFrame]:
    """Kept vectors within REACH, and those kept beyond it."""
    x = F.col(vector_col)
    real = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    kept = df.where(x.isNotNull() & (F.size(x) == dims)).where(real).select(
        F.col(id_col).cast("long").alias("vec_id"), x.cast("array<double>").alias("vector")
    )
    inside = F.forall("vector", lambda v: F.abs(v) * scale < REACH)
    return kept.where(inside), kept.where(~inside)


def _matrix(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(flat.reshape(-1, dims) * float(scale)).astype(np.int64)


def start(vectors: DataFrame, centroids: int, prefix: str, dims: int, scale: int) -> np.ndarray:
    """The vectors with the smallest hash of ``prefix`` and their id, in order of the hash."""
    key = F.sha2(F.concat(F.lit(prefix), F.col("vec_id").cast("string")), 256)
    first = vectors.orderBy(key.asc_nulls_last(), "vector").limit(centroids).select("vector").toArrow()
    return _matrix(first.column("vector").combine_chunks(), dims, scale) if len(first) else np.empty((0, dims), np.int64)


def _sums(vectors: DataFrame, centroids: np.ndarray, dims: int, scale: int) -> tuple[np.ndarray, list[int]]:
    """Floored means of the clusters of ``centroids``, and the distances summed in each."""
    book, k = codebook(centroids), len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # columns: components, then the distance in two parts of 32 bits, then the count
        total = np.zeros((k, dims + 3), dtype=np.int64)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                x = _matrix(batch.column(0).slice(at, ROWS), dims, scale)
                cluster, distance, _ = nearest(x, book)
                for c in np.unique(cluster).tolist():
                    own = cluster == c
                    parts = (distance[own] >> 32).sum(), (distance[own] & 0xFFFFFFFF).sum(), own.sum()
                    total[c] += np.concatenate([x[own].sum(axis=0), parts])
        which, what = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(what), pa.array(total[which, what])], names=["cluster", "what", "n"])

    parts = mapped(vectors.select("vector"), run, "cluster long, what long, n long")
    added = parts.groupBy("cluster", "what").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
    grid = [[0] * (dims + 3) for _ in range(k)]
    for row in added.collect():  # at most centroids * (components + 3) rows
        grid[row["cluster"]][row["what"]] = int(row["n"])
    counts = [g[dims + 2] for g in grid]
    inertia = [(g[dims] << 32) + g[dims + 1] for g in grid]
    means = np.array([[v // n for v in g[:dims]] if n else c for g, n, c in zip(grid, counts, centroids.tolist())], dtype=np.int64)
    return means, inertia


def fit(
    vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, prefix: str = "2:", dims: int = DIMS, scale: int = SCALE
) -> np.ndarray:
    """Centroids after ``rounds`` rounds over all ``vectors`` (vec_id, vector of doubles)."""
    now = start(vectors, centroids, prefix, dims, scale)
    for _ in range(rounds if len(now) else 0):
        now = _sums(vectors, now, dims, scale)[0]
    return now


def cluster(
    df: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding",
    prefix: str = "2:", dims: int = DIMS, scale: int = SCALE,
) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)``, one row a kept vector.

    Kept are vectors of exactly ``dims`` components, none null or non-finite; a component x
    becomes ``floor(scale * x)``. Centroids start as the kept vectors with the smallest hash of
    ``prefix`` and id, equal hashes by vector and a missing id last; with fewer vectors there
    are fewer. Rounds take every vector to the nearest centroid (ties: smaller number) and
    replace a centroid by the floored mean of its vectors; an empty one stays. Vectors with a
    component of REACH or more, whose distances need not fit 64 bits, take part in nothing and
    have nulls beside their id; so has an inertia that does not fit. Repeated rows count and
    give a row each. An empty table gives no rows, other columns are ignored.
    """
    vectors, beyond = _whole(df, id_col, vector_col, dims, scale)
    final = fit(vectors, centroids, rounds, prefix, dims, scale)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    nothing = beyond.select("vec_id", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in schema.split(", ")[1:]])
    if not len(final):
        return nothing
    inertia = _sums(vectors, final, dims, scale)[1]
    fits = [v if v < 1 << 63 else None for v in (*inertia, sum(inertia))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in final.tolist()]
    book = codebook(final)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                number, distance, _ = nearest(_matrix(part.column(1), dims, scale), book)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(number.astype(np.int32)), pa.array(distance),
                        pa.array([fits[c] for c in number.tolist()], pa.int64()), pa.array([fits[-1]] * len(part), pa.int64()),
                        pa.array([digests[c] for c in number.tolist()], pa.string()),
                    ],
                    names=[c.split()[0] for c in schema.split(", ")],
                )

    return mapped(vectors, run, schema).unionByName(nothing)

"""K-means on whole numbers with an N-simplex filter.

A few pivots are fixed once. The distances from a vector to n pivots put it at one point of an
n-dimensional space, up to a mirror: the apex over the simplex of the pivots. Between two apexes,
the straight distance is at most the true one, and the distance to the mirrored apex is at least
it. So each vector's apex is computed once and stored with it; in a round a centroid whose lower
bound exceeds another's upper bound is left out, and only those that remain are compared
exactly, in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from fieldbeat.llm.shared import discard, in_batches, stage

#: Pivots, and the vectors they are chosen from.
PIVOTS, SAMPLE_ROWS = 12, 1024
#: Vectors that a task compares at once.
TOGETHER = 8192
#: Squared distances from here on do not fit a long.
LIMIT = 1 << 62


@dataclass
class Simplex:
    """Pivots, and where they lie in the space that they span: pivot i at row i, with zeros
    from component i on."""

    pivots: np.ndarray
    base: np.ndarray

    @classmethod
    def of(cls, points: np.ndarray) -> Simplex:
        """Of these points, far from each other and in general position, at most PIVOTS."""
        chosen: list[int] = []
        base = apexes = np.zeros((0, 0))
        # The height over the simplex so far; the first is the one farthest from the mean.
        height = np.linalg.norm(points - points.mean(axis=0), axis=1)
        # A flat simplex would enlarge rounding errors.
        least = 0.02 * (1 + height.max())
        while len(chosen) < min(PIVOTS, len(points)) and (not chosen or height.max() > least):
            chosen.append(int(height.argmax()))
            if len(chosen) == 1:
                base = np.zeros((1, 0))
            else:
                base = np.vstack([np.pad(base, ((0, 0), (0, 1))), apexes[chosen[-1]]])
            apexes = cls(points[chosen], base).apexes(points)
            height = apexes[:, -1]
        return cls(points[chosen], base)

    def apexes(self, vectors: np.ndarray) -> np.ndarray:
        """Coordinates that have the vector's distances to all pivots; the last, the height
        above the simplex, is not negative."""
        d = np.stack([((vectors - p) ** 2).sum(axis=1) for p in self.pivots], axis=1)
        n = len(self.pivots)
        out = np.zeros((len(vectors), n))
        for i in range(1, n):
            own = self.base[i, :i]
            # From the distances to pivot i and to the first one, which lies at zero.
            known = out[:, : i - 1] @ own[:-1]
            out[:, i - 1] = ((d[:, 0] - d[:, i] + own @ own) / 2 - known) / own[-1]
        out[:, -1] = np.sqrt(np.maximum(d[:, 0] - (out[:, :-1] ** 2).sum(axis=1), 0))
        return out


def bounds(apexes: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest squared distance between what lies behind each two apexes."""
    flat = (((apexes[:, None, :-1] - others[None, :, :-1]) ** 2).sum(axis=2))
    a, b = apexes[:, None, -1], others[None, :, -1]
    return flat + (a - b) ** 2, flat + (a + b) ** 2


def quantized(vector: str, scale: int, size: int | None = None) -> Column:
    """Each component as floor(scale * x); null for a vector that is null, holds null, NaN or an
    infinite value, or has another number of components than ``size``."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    fits = F.col(vector).isNotNull() & (F.size(vector) == size if size else F.lit(True))
    return F.when(fits & ~bad, whole)


def _matrix(column: pa.BinaryArray, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _nearest(v: np.ndarray, apexes: np.ndarray, centroids: np.ndarray,
             tops: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each vector the nearest centroid (the first on a tie), the squared distance to it, and
    how many distances were computed."""
    low, high = bounds(apexes, tops)
    # Rounding errors are far below a millionth of the terms of the bounds.
    slack = 1e-6 * (1 + high.max(axis=1, initial=0))
    left = low <= (high.min(axis=1) + slack)[:, None]
    best = np.full(len(v), LIMIT)
    cluster = np.zeros(len(v), np.int64)
    for c in range(len(centroids)):
        at = np.flatnonzero(left[:, c])
        away = v[at] - centroids[c]
        d = (away * away).sum(axis=1)
        nearer = d < best[at]
        best[at[nearer]], cluster[at[nearer]] = d[nearer], c
    return cluster, best, int(left.sum())


def _store(batches: Iterator[pa.RecordBatch], simplex: Simplex, width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("v")
        v = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)
        apexes = simplex.apexes(v.astype(float))
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), pa.array([x.tobytes() for x in v], pa.binary()),
             pa.array([x.tobytes() for x in apexes], pa.binary())], ["key", "v", "apex"])


def _parts(batches: Iterator[pa.RecordBatch], width: int, pivots: int, centroids: np.ndarray,
           tops: np.ndarray) -> Iterator[tuple]:
    for whole in batches:
        for start in range(0, whole.num_rows, TOGETHER):
            batch = whole.slice(start, TOGETHER)
            v = _matrix(batch.column("v"), np.int64, width)
            yield batch, v, *_nearest(v, _matrix(batch.column("apex"), np.float64, pivots), centroids, tops)


def _sums(parts: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """For each cluster of a part: number of vectors, sum of each component, and how many
    distances of the part were computed (with its first cluster)."""
    for _, v, cluster, _, compared in parts:
        for i, c in enumerate(np.unique(cluster)):
            own = v[cluster == c]
            yield pa.RecordBatch.from_arrays(
                [pa.array([c], pa.int32()), pa.array([len(own)], pa.int64()),
                 pa.array([own.sum(axis=0).tolist()], pa.list_(pa.int64())),
                 pa.array([0 if i else compared], pa.int64())], ["cluster", "n", "sums", "compared"])


def _assigned(parts: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    for batch, _, cluster, best, _ in parts:
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), pa.array(cluster, pa.int32()), pa.array(best)], ["key", "cluster", "distance"])


@dataclass
class Clusters:
    """``rows`` (key, cluster, distance), a row for each vector; the final centroids; and for
    each round the share of distances that the bounds left to compute."""

    rows: DataFrame
    centroids: list[list[int]]
    compared: list[float]


def cluster(vectors: DataFrame, k: int, rounds: int, order: Column, key: str = "vec_id",
            vector: str = "vector") -> Clusters:
    """Lloyd's algorithm in whole numbers.

    Centroids 0, 1, … start as the first ``k`` vectors by ``order`` (an expression over the key;
    ties go to the smaller vector). Each round assigns every vector to the nearest centroid, by
    squared distance, ties to the smaller number, and replaces every centroid that has vectors by
    their mean, rounded down in each component. Then vectors are assigned once more.

    ``vector`` is an array of whole numbers, one size in all rows, else it fails. Rows whose vector
    is null take no part; rows with a null key do, as do all rows of a repeated key. With fewer
    vectors than ``k`` there are fewer centroids; without any there are no rows. Squared
    distances of 2**62 or more fail, as they would not fit a long.

    A round reads the stored vectors and returns a row for each centroid, whatever the number of
    vectors; nothing is shuffled but partial sums.
    """
    rows = vectors.where(F.col(vector).isNotNull()).select(
        F.col(key).cast("long").alias("key"), F.col(vector).alias("v"))
    spark = rows.sparkSession
    greatest = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    n, least, width, longest = rows.agg(
        F.count("*"), F.min(F.size("v")), F.max(F.size("v")), F.max(greatest)).first()
    if not n:
        return Clusters(spark.createDataFrame([], "key long, cluster int, distance long"), [], [])
    if least != width or not width:
        raise ValueError("vectors have different numbers of components, or none")
    if 4 * longest * longest * width >= LIMIT or longest * n >= LIMIT:
        raise ValueError("squared distances or sums of these vectors do not fit a long")
    first = rows.orderBy(order, "v").limit(k).collect()
    sample = rows.orderBy(F.xxhash64("v"), "v").limit(SAMPLE_ROWS).select("v").collect()
    simplex = Simplex.of(np.unique(np.array([r["v"] for r in sample], float), axis=0))
    shared = spark.sparkContext.broadcast(simplex)
    stored = stage(in_batches(rows, lambda b: _store(b, shared.value, width),
                              "key long, v binary, apex binary"))
    centroids = np.array([r["v"] for r in first], np.int64)
    compared = []

    def over(run, schema: str) -> DataFrame:
        tops, now = simplex.apexes(centroids.astype(float)), centroids.copy()
        pivots = len(simplex.pivots)
        return in_batches(stored, lambda b: run(_parts(b, width, pivots, now, tops)), schema)

    for _ in range(rounds):
        found = over(_sums, "cluster int, n long, sums array<long>, compared long")
        total = found.groupBy("cluster").agg(
            F.sum("n").alias("n"), F.sum("compared").alias("compared"),
            F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums")).collect()
        centroids = _moved(centroids, total)
        compared.append(sum(r["compared"] for r in total) / (n * len(centroids)))
    done = stage(over(_assigned, "key long, cluster int, distance long"))
    discard(stored)
    return Clusters(done, centroids.tolist(), compared)


def _moved(centroids: np.ndarray, total: list[Row]) -> np.ndarray:
    """Means rounded down; a centroid without vectors stays."""
    out = centroids.copy()
    for r in total:
        out[r["cluster"]] = [s // r["n"] for s in r["sums"]]
    return out

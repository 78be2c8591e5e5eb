"""Exact top-k search by inner product with a pivot-distance index.

With one more component that brings all vectors to the same length, the highest inner product is
the smallest distance. Vectors are keyed by their nearest pivot and the distance to it, and
stored in rings around the pivots. A query visits the rings in the order of their least possible
distance, which the triangle inequality gives, first a few, then more, and leaves out all
that cannot be nearer than its k-th best so far.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbeat.functions.joins import split_join
from fieldbeat.llm.shared import in_batches, stage

#: Vectors that pivots are chosen from, and bounds on the numbers of pivots and rings of each.
#: Pivots, rings and their distances are broadcast: at most PIVOTS * RINGS of them.
SAMPLE_ROWS, PIVOTS, RINGS = 2048, 64, 16
#: Vectors of a chunk and queries of a pack, which a task compares at once.
CHUNK, PACK = 1024, 1024
#: Rings that a query has visited at most after each round; the last round has no limit.
ROUNDS = (4, 32, None)
#: Products are exact in floating point below this squared length, and in integers below the next.
EXACT_FLOAT, EXACT_INT = 1 << 52, 1 << 62


def quantized(vector: str, scale: int = 256) -> Column:
    """Each component as floor(scale * x); null for a vector that is null or holds null, NaN or
    an infinite value."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return F.when(F.col(vector).isNotNull() & ~bad, whole)


@dataclass
class Rings:
    """The pivots, the longest squared length, and each ring's least and greatest distance."""

    pivots: np.ndarray
    extra: np.ndarray  # the pivots' additional component
    longest: int
    edges: np.ndarray  # (pivot, ring) -> inner edges
    ids: np.ndarray | None = None
    low: np.ndarray | None = None
    high: np.ndarray | None = None

    def distances(self, vectors: np.ndarray, extra: np.ndarray) -> np.ndarray:
        """From each vector, with its additional component, to each pivot."""
        own = (vectors * vectors).sum(axis=1) + extra * extra
        pivot = (self.pivots * self.pivots).sum(axis=1) + self.extra * self.extra
        cross = vectors @ self.pivots.T + np.outer(extra, self.extra)
        return np.sqrt(np.maximum(own[:, None] + pivot[None, :] - 2 * cross, 0))

    def place(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest pivot (the first on a tie) and the distance to it."""
        squared = (vectors * vectors).sum(axis=1)
        d = self.distances(vectors, np.sqrt(np.maximum(self.longest - squared, 0)))
        pivot = d.argmin(axis=1)
        return pivot, d[np.arange(len(d)), pivot]

    def least(self, queries: np.ndarray) -> np.ndarray:
        """Least possible distance from each query to what lies in each ring."""
        to_pivot = self.distances(queries, np.zeros(len(queries)))[:, self.ids // RINGS]
        bound = np.maximum(np.maximum(to_pivot - self.high, self.low - to_pivot), 0)
        return bound - 1e-6 * (1 + to_pivot)


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Lists of whole numbers as rows; shorter ones are padded by zeros."""
    out = np.zeros((len(column), width), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(column)), sizes), at] = flat
    return out


def _pivots(sample: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the sample, each the farthest from those before it."""
    extra = np.sqrt(np.maximum(longest - (sample * sample).sum(axis=1), 0.0))
    points = np.concatenate([sample, extra[:, None]], axis=1)
    chosen, nearest = [0], ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < min(PIVOTS, len(points)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen], extra[chosen]


def search(vectors: DataFrame, wanted: Column, k: int, key: str = "vec_id",
           vector: str = "vector") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``wanted`` holds, the k other rows of
    the highest inner product; ties go to the smaller key.

    ``vector`` is an array of whole numbers. Rows whose key or vector is null take no part. Of
    several rows with one key the least vector counts. A vector shorter than another counts as
    padded by zeros. Squared lengths of 2**62 or more fail, as products would not fit a long.
    """
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    rows = rows.groupBy(F.col(key).cast("long").alias("key")).agg(F.min(vector).alias("v"))
    rows = stage(rows.withColumn("wanted", F.coalesce(wanted, F.lit(False))))
    squared = F.aggregate("v", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x)
    n, width, longest = rows.agg(F.count("*"), F.max(F.size("v")), F.max(squared)).first()
    none = "query_id long, rank int, vec_id long, score long"
    if not n:
        return vectors.sparkSession.createDataFrame([], none)
    if longest >= EXACT_INT:
        raise ValueError("inner products of these vectors do not fit a long")
    longest = int(longest) + 1
    kind = np.float64 if longest < EXACT_FLOAT else np.int64
    index, chunks = _index(rows, n, width, longest)
    shared = rows.sparkSession.sparkContext.broadcast(index)
    queries = stage(rows.where("wanted").select(F.col("key").alias("query_id"), "v"))
    best, done = None, 0
    for limit in ROUNDS:
        state = queries
        if best is None:
            state = state.withColumn("kth", F.lit(None).cast("long"))
        else:
            kth = best.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
            state = state.join(kth, "query_id", "left")
        first, last = done, limit if limit is not None else len(index.ids)
        packs = in_batches(state, lambda b, f=first, t=last: _packs(b, shared.value, f, t, width),
                           "ring int, queries binary, vectors binary, kth binary")
        pairs = split_join(packs, chunks, "ring")
        found = in_batches(pairs, lambda b: _scored(b, width, k, kind),
                           "query_id long, vec_id long, score long")
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
        best = stage(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        done = last
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _index(rows: DataFrame, n: int, width: int, longest: int) -> tuple[Rings, DataFrame]:
    sample = rows.orderBy(F.xxhash64("key"), "key").limit(SAMPLE_ROWS).select("v").collect()
    points = np.zeros((len(sample), width))
    for i, r in enumerate(sample):
        points[i, : len(r["v"])] = r["v"]
    # About CHUNK vectors a ring, until there are as many rings as may be broadcast.
    count = max(1, min(PIVOTS, int((n / CHUNK) ** 0.5)))
    rings = max(1, min(RINGS, -(-n // (CHUNK * count))))
    pivots, extra = _pivots(points, longest)
    index = Rings(pivots[:count], extra[:count], longest, np.zeros((count, 0)))
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pivot, distance = shared.value.place(_matrix(batch.column("v"), width).astype(float))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("v"), pa.array(pivot, pa.int32()), pa.array(distance)],
                ["key", "v", "pivot", "distance"])

    placed = stage(in_batches(
        rows.select("key", "v"), place, "key long, v array<long>, pivot int, distance double"))
    shares = [i / rings for i in range(1, rings)]
    cuts = {r["pivot"]: r["cuts"] for r in placed.groupBy("pivot").agg(
        F.percentile_approx("distance", shares or [0.5]).alias("cuts")).collect()}  # a row a pivot
    ring = F.lit(0)
    for pivot, edges in cuts.items():
        passed = sum((F.col("distance") > e).cast("int") for e in (edges if shares else []))
        ring = F.when(F.col("pivot") == pivot, passed).otherwise(ring)
    ringed = placed.withColumn("ring", (F.col("pivot") * RINGS + ring).cast("int"))
    known = ringed.groupBy("ring").agg(
        F.min("distance").alias("low"), F.max("distance").alias("high")).orderBy("ring").collect()
    index.ids = np.array([r["ring"] for r in known])
    index.low = np.array([r["low"] for r in known])
    index.high = np.array([r["high"] for r in known])
    dealt = ringed.repartitionByRange("ring", "distance", "key").sortWithinPartitions("ring", "distance")
    chunks = in_batches(dealt.select("ring", "key", "v"), lambda b: _chunks(b, width),
                        "ring int, keys binary, members binary")
    return index, stage(chunks)


def _chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows come by ring; a chunk never holds two rings."""
    for batch in batches:
        ring = batch.column("ring").to_numpy(zero_copy_only=False)
        key = batch.column("key").to_numpy(zero_copy_only=False)
        v = _matrix(batch.column("v"), width)
        change = np.flatnonzero(np.diff(ring)) + 1
        cuts = np.unique(np.concatenate([
            [0], change, *(np.arange(a, b, CHUNK) for a, b in zip([0, *change], [*change, len(ring)], strict=True))]))
        if len(ring):
            parts = list(zip(cuts, [*cuts[1:], len(ring)], strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array([ring[a] for a, _ in parts], pa.int32()),
                 pa.array([key[a:b].tobytes() for a, b in parts], pa.binary()),
                 pa.array([v[a:b].tobytes() for a, b in parts], pa.binary())],
                ["ring", "keys", "members"])


def _packs(batches: Iterator[pa.RecordBatch], index: Rings, first: int, last: int,
           width: int) -> Iterator[pa.RecordBatch]:
    """For each ring the queries that visit it in this round: by the order of least distances,
    and only where that distance is not beyond the query's k-th best."""
    for whole in batches:
        for start in range(0, whole.num_rows, PACK):
            batch = whole.slice(start, PACK)
            ids = batch.column("query_id").to_numpy(zero_copy_only=False)
            v = _matrix(batch.column("v"), width)
            known = np.array(batch.column("kth").is_valid())
            kth = batch.column("kth").fill_null(0).to_numpy(zero_copy_only=False)
            q = v.astype(float)
            reach = np.sqrt(np.maximum((q * q).sum(axis=1) + index.longest - 2.0 * kth, 0))
            reach = np.where(known, reach + 1e-6 * (1 + reach), np.inf)
            kth = np.where(known, kth, np.iinfo(np.int64).min)
            least = index.least(q)
            place = least.argsort(axis=1, kind="stable").argsort(axis=1, kind="stable")
            visit = (place >= first) & (place < last) & (least <= reach[:, None])
            for r in np.flatnonzero(visit.any(axis=0)):
                at = np.flatnonzero(visit[:, r])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([index.ids[r]], pa.int32()), *(
                        pa.array([x[at].tobytes()], pa.binary()) for x in (ids, v, kth))],
                    ["ring", "queries", "vectors", "kth"])


def _scored(batches: Iterator[pa.RecordBatch], width: int, k: int, kind: type) -> Iterator[pa.RecordBatch]:
    """The k best of a chunk for each query, as far as they reach its k-th best so far."""

    def whole(data: bytes) -> np.ndarray:
        return np.frombuffer(data, np.int64)

    for batch in batches:
        names = ("queries", "vectors", "kth", "keys", "members")
        for query, v, kth, key, members in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            query, kth, key = whole(query), whole(kth), whole(key)
            product = whole(v).reshape(-1, width).astype(kind) @ whole(members).reshape(-1, width).astype(kind).T
            product = product.astype(np.int64)
            own = query[:, None] == key[None, :]
            order = np.argsort(key, kind="stable")
            key, product, own = key[order], product[:, order], own[:, order]
            product[own] = -EXACT_INT  # below all others
            top = np.argsort(-product, axis=1, kind="stable")[:, :k]
            rows = np.repeat(np.arange(len(query)), top.shape[1])
            top = top.ravel()
            score = product[rows, top]
            good = ~own[rows, top] & (score >= kth[rows])
            yield pa.RecordBatch.from_arrays(
                [pa.array(query[rows[good]]), pa.array(key[top[good]]), pa.array(score[good])],
                ["query_id", "vec_id", "score"])

"""Hard negatives by anchor clusters with shared lists.

Anchors are clustered by direction. For an anchor at most the angle b from its cluster's centre,
and a candidate at the angle t from it, the inner product is at most the product of their lengths
times cos(max(0, t - b)). So one list of all candidates for each cluster, sorted by length times
that cosine, serves all its members: each walks it from the top, and stops where nothing further
down can reach what it still needs. The lists are sorted once, in segments that grow eightfold; a
segment is built when a member of the cluster first comes to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbeat.functions.joins import split_join
from fieldbeat.llm.shared import discard, in_batches, stage

#: Anchors that centres are chosen from, and at most so many centres, about one for MEMBERS anchors.
#: Centres and the edges of segments are broadcast: their number has these bounds.
SAMPLE_ROWS, CLUSTERS, MEMBERS = 2048, 16, 64
#: Candidates of the first segment; the next ones grow by the factor.
FIRST, GROWTH = 4096, 8
#: Candidates of a chunk and anchors of a pack, which a task compares at once.
CHUNK, PACK = 1024, 256
#: Products are exact in floating point below this squared length; beyond the next one a hundred
#: of them would not fit a long.
EXACT_FLOAT, LIMIT = 1 << 52, 1 << 55
LEAST, MOST = -(1 << 62), 1 << 62
_FOUND = "row long, slot int, other long, other_row long, score long"


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Lists of whole numbers as rows; shorter ones are padded by zeros."""
    out = np.zeros((len(column), width), np.int64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(column)), sizes), at] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _directions(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors (zero stays zero) and lengths."""
    length = np.sqrt((v * v).sum(axis=1))
    return v / np.where(length > 0, length, 1)[:, None], length


def _centres(sample: np.ndarray, count: int) -> np.ndarray:
    """Directions that the sampled anchors gather around."""
    unit, _ = _directions(sample)
    centres = unit[:1]
    while len(centres) < min(count, len(unit)):
        centres = np.vstack([centres, unit[(unit @ centres.T).max(axis=1).argmin()]])
    for _ in range(10):
        own = (unit @ centres.T).argmax(axis=1)
        means = np.stack([unit[own == c].sum(axis=0) for c in range(len(centres))])
        centres = np.where((means * means).sum(axis=1, keepdims=True) > 0, _directions(means)[0], centres)
    return centres


def _angles(v: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unit, length = _directions(v)
    return np.arccos(np.clip(unit @ centres.T, -1, 1)), length


@dataclass
class Lists:
    """The candidates' lists, one a cluster, and the segments built so far."""

    rows: DataFrame  # row, key, label, v, bounds
    edges: np.ndarray  # (segment, cluster) -> least bound of the segment
    width: int
    built: dict[tuple[int, int], DataFrame] = field(default_factory=dict)
    staged: list[DataFrame] = field(default_factory=list)

    def segment(self, s: int, clusters: list[int]) -> DataFrame:
        """Chunks of these clusters' segment, sorted by bound."""
        new = [c for c in clusters if (s, c) not in self.built]
        if new:
            top = self.edges[s - 1] if s else np.full(self.edges.shape[1], np.inf)
            cut = {c: (self.edges[s, c], top[c]) for c in new}
            entries = in_batches(
                self.rows, lambda b: _entries(b, cut),
                "cluster int, bound double, row long, key long, label long, v array<long>")
            dealt = entries.repartitionByRange("cluster", F.desc("bound"), "row").sortWithinPartitions(
                "cluster", F.desc("bound"), "row")
            width = self.width
            chunks = stage(in_batches(dealt, lambda b: _chunks(b, width),
                                      "cluster int, bound double, data binary, members binary"))
            self.staged.append(chunks)
            self.built |= {(s, c): chunks for c in new}
        parts = {id(self.built[s, c]): self.built[s, c] for c in clusters}
        out = None
        for part in parts.values():
            out = part if out is None else out.unionByName(part)
        return out.where(F.col("cluster").isin(clusters))


def _bounded(batches: Iterator[pa.RecordBatch], centres: np.ndarray, reach: np.ndarray,
             width: int) -> Iterator[pa.RecordBatch]:
    """Adds the bound for each cluster, per unit of the anchor's length."""
    for batch in batches:
        angle, length = _angles(_matrix(batch.column("v"), width).astype(float), centres)
        bound = length[:, None] * (np.cos(np.maximum(angle - reach, 0)) + 1e-6)
        offsets = np.arange(0, bound.size + 1, len(centres), dtype=np.int32)
        yield batch.append_column("bounds", pa.ListArray.from_arrays(
            pa.array(offsets), pa.array(bound.ravel())))


def _entries(batches: Iterator[pa.RecordBatch], cut: dict[int, tuple[float, float]]) -> Iterator[pa.RecordBatch]:
    names = ["row", "key", "label", "v"]
    for batch in batches:
        bounds = batch.column("bounds").flatten().to_numpy().reshape(batch.num_rows, -1)
        for c, (low, high) in cut.items():
            own = bounds[:, c]
            at = np.flatnonzero((own >= low) & (own < high))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), c), pa.int32()), pa.array(own[at]),
                 *(batch.column(n).take(pa.array(at)) for n in names)], ["cluster", "bound", *names])


def _chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows come by cluster and bound; a chunk never holds two clusters. Its bound is the first's."""
    for batch in batches:
        cluster = batch.column("cluster").to_numpy(zero_copy_only=False)
        bound = batch.column("bound").to_numpy(zero_copy_only=False)
        data = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in ("row", "key", "label")])
        v = _matrix(batch.column("v"), width)
        edges = [0, *(np.flatnonzero(np.diff(cluster)) + 1), len(cluster)]
        for a, b in zip(edges, edges[1:], strict=False):
            for start in range(a, b, CHUNK):
                end = min(start + CHUNK, b)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([cluster[start]], pa.int32()), pa.array([bound[start]]),
                     pa.array([data[:, start:end].tobytes()], pa.binary()),
                     pa.array([v[start:end].tobytes()], pa.binary())],
                    ["cluster", "bound", "data", "members"])


def _packs(batches: Iterator[pa.RecordBatch], width: int, slots: int) -> Iterator[pa.RecordBatch]:
    """Members of one cluster that go on walking, at most PACK together."""
    for batch in batches:
        cluster = batch.column("cluster").to_numpy(zero_copy_only=False)
        order = np.argsort(cluster, kind="stable")
        batch, cluster = batch.take(pa.array(order)), cluster[order]
        data = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in ("row", "label")])
        length = batch.column("length").to_numpy(zero_copy_only=False)
        v = _matrix(batch.column("v"), width)
        caps, needs = (batch.column(n).flatten().to_numpy().reshape(-1, slots) for n in ("caps", "needs"))
        edges = [0, *(np.flatnonzero(np.diff(cluster)) + 1), len(cluster)]
        for a, b in zip(edges, edges[1:], strict=False):
            for start in range(a, b, PACK):
                part = slice(start, min(start + PACK, b))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([cluster[start]], pa.int32()),
                     *(pa.array([x.tobytes()], pa.binary()) for x in (
                         np.ascontiguousarray(data[:, part]), length[part], v[part], caps[part], needs[part]))],
                    ["cluster", "anchors", "lengths", "vectors", "caps", "needs"])


def _scored(batches: Iterator[pa.RecordBatch], width: int, slots: int, k: int, same: bool,
            kind: type) -> Iterator[pa.RecordBatch]:
    """The k best of a chunk for each member and slot: rows of its label or of others, whose score
    is at most the slot's cap and reaches what the slot needs."""

    def whole(data: bytes, kind: type = np.int64) -> np.ndarray:
        return np.frombuffer(data, kind)

    names = ("bound", "anchors", "lengths", "vectors", "caps", "needs", "data", "members")
    for batch in batches:
        for bound, anchors, lengths, vectors, caps, needs, data, members in zip(
                *(batch.column(n).to_pylist() for n in names), strict=True):
            caps, needs = whole(caps).reshape(-1, slots), whole(needs).reshape(-1, slots)
            lengths = whole(lengths, np.float64)
            walks = np.flatnonzero(lengths * bound >= needs.min(axis=1))
            row, label = whole(anchors).reshape(2, -1)[:, walks]
            caps, needs = caps[walks], needs[walks]
            other_row, key, other_label = whole(data).reshape(3, -1)
            product = (whole(vectors).reshape(-1, width)[walks].astype(kind)
                       @ whole(members).reshape(-1, width).astype(kind).T).astype(np.int64)
            hit = (label[:, None] == other_label[None, :]) == same
            hit &= (row[:, None] != other_row[None, :]) & (product >= needs.min(axis=1)[:, None])
            hit &= product <= caps.max(axis=1)[:, None]
            member, other = np.nonzero(hit)
            score = product[member, other]
            for slot in range(slots):
                good = np.flatnonzero((score <= caps[member, slot]) & (score >= needs[member, slot]))
                m, o, x = member[good], other[good], score[good]
                order = np.lexsort((other_row[o], key[o], -x, m))
                m, o, x = m[order], o[order], x[order]
                first = np.searchsorted(m, m)
                top = np.flatnonzero(np.arange(len(m)) - first < k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row[m[top]]), pa.array(np.full(len(top), slot), pa.int32()),
                     pa.array(key[o[top]]), pa.array(other_row[o[top]]), pa.array(x[top])],
                    ["row", "slot", "other", "other_row", "score"])


def _walk(members: DataFrame, lists: Lists, slots: int, k: int, same: bool, kind: type) -> DataFrame:
    """(row, slot, rank, other, score): for each member and slot the k best rows of the whole list.

    ``members`` has row, label, v, length, cluster, caps and needs: a slot takes rows with a score
    from its need to its cap. With k found, the k-th score is what it needs.
    """
    order = Window.partitionBy("row", "slot").orderBy(F.desc("score"), "other", "other_row")
    best, width = None, lists.width
    for s in range(len(lists.edges)):
        state = members
        if best is not None:
            kth = best.where(F.col("rank") == k).groupBy("row").agg(
                F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("kth"))
            state = split_join(members, kth, "row", "left").withColumn("needs", F.transform(
                "needs", lambda x, slot: F.greatest(x, F.try_element_at("kth", slot)))).drop("kth")
            reach = F.lit(None).cast("double")
            for c, edge in enumerate(lists.edges[s - 1].tolist()):
                reach = F.when(F.col("cluster") == c, F.col("length") * F.lit(edge)).otherwise(reach)
            state = state.where(reach >= F.array_min("needs"))
        state = stage(state)
        clusters = sorted(r["cluster"] for r in state.select("cluster").distinct().collect())  # few
        if clusters:
            packs = in_batches(
                state, lambda b: _packs(b, width, slots), "cluster int, anchors binary, lengths binary, "
                "vectors binary, caps binary, needs binary")
            pairs = split_join(packs, lists.segment(s, clusters), "cluster")
            found = in_batches(pairs, lambda b: _scored(b, width, slots, k, same, kind),
                               _FOUND)
            if best is not None:
                found = found.unionByName(best.drop("rank"))
            old, best = best, stage(
                found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
            if old is not None:
                discard(old)
        discard(state)
        if not clusters:
            break
    if best is None:
        return members.sparkSession.createDataFrame([], f"{_FOUND}, rank int")
    return best


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5,
         share: tuple[int, int] = (80, 100), key: str = "vec_id", vector: str = "vector",
         label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Scores are inner products; higher ones come first, ties by smaller key. For each row where
    ``anchors`` (an expression over key) holds, its positives are the first ``positives`` other
    rows of its label. For each positive, its negatives are the first ``negatives`` rows of another
    label with a score from ``share`` of the positive's (a fraction) up to the positive's.

    ``vector`` is an array of whole numbers, ``label`` a whole number. Rows whose key, label or
    vector is null take no part. A row is told from others by itself, not by its key: rows
    that repeat a key are all candidates, and anchors each. A vector shorter than another counts
    as padded by zeros. Squared lengths of 2**55 or more fail. A positive below zero has no
    negatives, and a positive without negatives has no row.
    """
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(label).cast("long").alias("label"),
                          F.col(vector).alias("v")).dropna()
    rows = stage(rows.withColumn("wanted", F.coalesce(anchors, F.lit(False))).withColumn(
        "row", F.monotonically_increasing_id()))
    spark = rows.sparkSession
    squared = F.aggregate("v", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x)
    n, asked, width, longest = rows.agg(
        F.count("*"), F.count_if("wanted"), F.max(F.size("v")), F.max(squared)).first()
    if not asked or not width:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, "
                                     "positive_score long, negative_score long")
    if longest >= LIMIT:
        raise ValueError("inner products of these vectors do not fit a long")
    kind = np.float64 if longest < EXACT_FLOAT else np.int64
    members, centres, reach = _members(rows, asked, width)
    lists = _lists(rows, n, width, spark.sparkContext.broadcast(centres), reach)
    everything = members.withColumn("caps", F.array(F.lit(MOST))).withColumn("needs", F.array(F.lit(LEAST)))
    near = _walk(everything, lists, 1, positives, True, kind)
    # A slot for each positive; those that are missing take nothing.
    low, high = share
    caps = near.groupBy("row").agg(F.map_from_entries(F.collect_list(
        F.struct("rank", "score"))).alias("cap"))
    slot = F.sequence(F.lit(1), F.lit(positives))
    ranged = split_join(members, caps, "row").withColumn("caps", F.transform(
        slot, lambda r: F.coalesce(F.try_element_at("cap", r), F.lit(LEAST)))).withColumn(
        "needs", F.transform("caps", lambda c: F.when(c < 0, F.lit(MOST)).otherwise(
            F.call_function("div", c * low + (high - 1), F.lit(high).cast("long"))))).drop("cap")
    far = _walk(ranged, lists, positives, negatives, False, kind)
    discard(*lists.staged, lists.rows, rows)
    near = near.select("row", (F.col("rank") - 1).alias("slot"), F.col("other").alias("positive_id"),
                       F.col("score").alias("positive_score"))
    found = far.withColumnsRenamed({"other": "negative_id", "score": "negative_score"}).join(
        near, ["row", "slot"])
    named = split_join(found, members.select("row", F.col("key").alias("anchor_id")), "row")
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
                        "positive_score", "negative_score")


def _members(rows: DataFrame, asked: int, width: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The anchors with length and cluster, the clusters' centres, and the greatest angle between a
    centre and its members."""
    wanted = rows.where("wanted").drop("wanted")
    sample = wanted.orderBy(F.xxhash64("row"), "row").limit(SAMPLE_ROWS).select("v").collect()
    points = np.zeros((len(sample), width))
    for i, r in enumerate(sample):
        points[i, : len(r["v"])] = r["v"]
    centres = _centres(points, max(1, min(CLUSTERS, asked // MEMBERS)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angle, length = _angles(_matrix(batch.column("v"), width).astype(float), centres)
            own = angle.argmin(axis=1)
            out = batch.append_column("length", pa.array(length))
            out = out.append_column("cluster", pa.array(own, pa.int32()))
            yield out.append_column("angle", pa.array(angle[np.arange(len(own)), own]))

    members = stage(in_batches(wanted, place, "key long, label long, v array<long>, row long, "
                               "length double, cluster int, angle double"))
    reach = np.zeros(len(centres))
    for r in members.groupBy("cluster").agg(F.max("angle").alias("angle")).collect():  # a row a cluster
        reach[r["cluster"]] = r["angle"]
    return members.drop("angle"), centres, reach


def _lists(rows: DataFrame, n: int, width: int, centres: Broadcast, reach: np.ndarray) -> Lists:
    bounded = stage(in_batches(
        rows.drop("wanted"), lambda b: _bounded(b, centres.value, reach, width),
        "key long, label long, v array<long>, row long, bounds array<double>"))
    ends, size = [], FIRST
    while size < n:
        ends.append(1 - size / n)
        size *= GROWTH
    count = len(reach)
    edges = np.full((len(ends) + 1, count), -np.inf)
    if ends:
        found = bounded.agg(*[F.percentile_approx(F.col("bounds")[c], ends).alias(f"c{c}")
                              for c in range(count)]).first()
        edges[:-1] = np.array([found[c] for c in range(count)]).T
    return Lists(bounded, edges, width)

"""The clusters against plain Lloyd, and the bounds against true distances."""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldbeat.llm import centroids
from tests.compare import compare, connect


def plain(vectors, k, rounds):
    """vectors: (order, vector); all distances in Python's whole numbers."""
    points = [v for _, v in sorted(vectors, key=lambda x: (x[0] is None, x[0] or 0, x[1]))]
    middle = points[:k]

    @cache
    def nearest(v, middle):
        d = [sum((a - b) ** 2 for a, b in zip(v, m, strict=True)) for m in middle]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        own = [nearest(tuple(v), tuple(map(tuple, middle)))[0] for v in points]
        for c in range(len(middle)):
            members = [v for v, o in zip(points, own, strict=True) if o == c]
            if members:
                middle[c] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    last = tuple(map(tuple, middle))
    return middle, {(tuple(v), nearest(tuple(v), last)) for v in points}


def found(spark, vectors, k, rounds):
    df = spark.createDataFrame(vectors, "vec_id long, vector array<long>")
    out = centroids.cluster(df, k, rounds, F.col("key").asc_nulls_last())
    rows = out.rows.join(df, F.col("key") == F.col("vec_id")).collect()
    assert len(rows) == len(vectors)
    return out, {(tuple(r["vector"]), (r["cluster"], r["distance"])) for r in rows}


@pytest.mark.parametrize("kind", ["spread", "clusters", "ties", "hot", "one component"])
def test_against_all_distances(spark, kind):
    r = np.random.default_rng(5)
    n = 1200
    if kind == "spread":
        data = r.integers(-99, 99, (n, 16))
    elif kind == "clusters":
        data = r.integers(-900, 900, (9, 20))[r.integers(0, 9, n)] + r.integers(-30, 31, (n, 20))
    elif kind == "ties":
        data = r.integers(0, 2, (n, 4))
    elif kind == "hot":
        data = np.where(r.random((n, 1)) < 0.4, np.full((n, 8), 7), r.integers(-9, 9, (n, 8)))
    else:
        data = r.integers(-50, 50, (n, 1))
    vectors = [(i, data[i].tolist()) for i in range(n)]
    out, got = found(spark, vectors, 8, 6)
    middle, want = plain(vectors, 8, 6)
    assert out.centroids == middle and got == want
    assert all(0 < share <= 1 for share in out.compared)
    if kind == "clusters":  # the bounds leave out most of the distances
        assert out.compared[-1] < 0.3


def test_bounds():
    r = np.random.default_rng(1)
    for n, width in ((300, 64), (300, 3), (5, 64), (2, 2), (1, 3)):
        points = np.unique(r.integers(-500, 500, (n, width)).astype(float), axis=0)
        apexes = centroids.Simplex.of(points).apexes(points)
        low, high = centroids.bounds(apexes, apexes)
        true = ((points[:, None] - points[None]) ** 2).sum(axis=2)
        assert (low <= true + 1e-6 * (1 + high)).all() and (true <= high + 1e-6 * (1 + high)).all()


def test_rounding_below_zero_and_empty_centroids(spark):
    # The second centroid is a copy of the first, so it never has a vector.
    vectors = [(0, [-1, 0]), (1, [-1, 0]), (2, [-2, 1]), (3, [-2, -2]), (4, [50, 50])]
    out, got = found(spark, vectors, 2, 1)
    assert out.centroids == [[8, 9], [-1, 0]]  # (44 // 5, 49 // 5)
    assert (got, out.centroids) == plain(vectors, 2, 1)[::-1]


def test_odd_rows(make_df, spark):
    schema = "vec_id long, vector array<long>, key int, cluster string"
    order = F.col("key").asc_nulls_last()

    def cluster(rows, k=3):
        return centroids.cluster(make_df(schema, rows), k, 2, order)

    for none in ([], [{"vec_id": 1}]):
        out = cluster(none)
        assert out.rows.collect() == [] and out.centroids == []
    rows = [{"vec_id": 1, "vector": [5, 5]}, {"vec_id": None, "vector": [0, 0]}, {"vec_id": 2},
            {"vec_id": 1, "vector": [4, 5]}]
    out = cluster(rows, 9)
    assert out.centroids == [[4, 5], [5, 5], [0, 0]]  # by key, then vector; null last
    assert sorted(tuple(r) for r in out.rows.fillna(-1).collect()) == [(-1, 2, 0), (1, 0, 0), (1, 1, 0)]
    with pytest.raises(ValueError, match="numbers of components"):
        cluster([{"vec_id": 1, "vector": [1]}, {"vec_id": 2, "vector": [1, 2]}])
    with pytest.raises(ValueError, match="do not fit"):
        cluster([{"vec_id": 1, "vector": [1 << 32]}])


def test_quantized(make_df):
    df = make_df("v array<float>", [{"v": [0.5, -0.001]}, {"v": None}, {"v": [None, 1.0]}, {"v": [1.0]},
                                    {"v": [float("nan"), 1.0]}, {"v": [float("-inf"), 1.0]}])
    got = [r["q"] for r in df.select(centroids.quantized("v", 1024, 2).alias("q")).collect()]
    assert got == [[512, -2], None, None, None, None, None]


def test_query_against_its_sql(spark):
    con = connect("/root/testdata/sf0.01")
    assert compare(spark, con, "op12_centroids", "/root/testdata/sf0.01") is None
    first = min((hashlib.sha256(f"3:{i}".encode()).hexdigest(), i) for i in range(500))[1]
    assert con.execute(f"SELECT count(*) FROM embeddings WHERE vec_id = {first}").fetchone() == (1,)

"""Mining against all products."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldbeat.llm import negatives
from tests.compare import compare, connect

SCHEMA = "vec_id long, vector array<long>, label int, key string, row int, score int"


def plain(rows, step, positives=5, keep=5, share=(80, 100)):
    """rows: (key, vector, label)."""
    width = max((len(v) for _, v, _ in rows), default=0)
    points = [np.array(v + [0] * (width - len(v)), object) for _, v, _ in rows]
    out = []
    for a, (key, _, label) in enumerate(rows):
        if key % step:
            continue
        scores = [int((points[a] * p).sum()) for p in points]
        others = sorted((i for i in range(len(rows)) if i != a), key=lambda i: (-scores[i], rows[i][0], i))
        for p in [i for i in others if rows[i][2] == label][:positives]:
            good = [i for i in others if rows[i][2] != label
                    and share[0] * scores[p] <= share[1] * scores[i] <= share[1] * scores[p]]
            out += [(key, rows[p][0], r + 1, rows[i][0], scores[p], scores[i])
                    for r, i in enumerate(good[:keep])]
    return sorted(out)


def mined(df, step, *args):
    return sorted(tuple(r) for r in negatives.mine(df, F.col("key") % step == 0, *args).collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, vector array<long>, label int")


@pytest.mark.parametrize("kind", ["spread", "clusters", "ties", "hot"])
def test_against_all_products(spark, monkeypatch, kind):
    monkeypatch.setattr(negatives, "FIRST", 64)
    monkeypatch.setattr(negatives, "GROWTH", 4)
    monkeypatch.setattr(negatives, "MEMBERS", 12)
    r = np.random.default_rng(7)
    n = 2000
    label = r.integers(0, 4, n)
    if kind == "spread":
        data = r.integers(-99, 99, (n, 8))
    elif kind == "clusters":
        data = r.integers(-300, 300, (12, 8))[r.integers(0, 12, n)] + r.integers(-9, 10, (n, 8))
    elif kind == "ties":
        data = r.integers(0, 3, (n, 4))
    else:  # a third of the rows is one vector, and one label has most rows
        data = np.where(r.random((n, 1)) < 0.34, np.full((n, 8), 7), r.integers(-9, 9, (n, 8)))
        label = np.where(r.random(n) < 0.7, 1, label)
    rows = [(i, data[i].tolist(), int(label[i])) for i in range(n)]
    want = plain(rows, 25)
    assert want
    assert mined(frame(spark, rows), 25) == want


def test_walks_end_early(spark, monkeypatch):
    """On clustered vectors most lists are not walked to their end."""
    monkeypatch.setattr(negatives, "FIRST", 128)
    monkeypatch.setattr(negatives, "MEMBERS", 3)
    built = []
    segment = negatives.Lists.segment

    def noted(self, s, clusters):
        built.append((s, len(clusters), len(self.edges)))
        return segment(self, s, clusters)

    monkeypatch.setattr(negatives.Lists, "segment", noted)
    r = np.random.default_rng(2)
    n = 3000
    centres = r.integers(-300, 300, (10, 12))
    own = r.integers(0, 10, n)
    data = centres[own] + r.integers(-3, 4, (n, 12))
    rows = [(i, data[i].tolist(), i % 2) for i in range(n)]
    assert mined(frame(spark, rows), 100) == plain(rows, 100)
    first = [c for s, c, _ in built if s == 0]
    assert built[0][2] == 3
    assert sum(c for s, c, _ in built if s == 2) < sum(first) / 2


def test_other_shares_and_counts(spark):
    r = np.random.default_rng(4)
    rows = [(i, r.integers(-20, 20, 3).tolist(), i % 3) for i in range(300)]
    for args in ((2, 3, (1, 3)), (7, 1, (100, 100)), (1, 9, (0, 1))):
        assert mined(frame(spark, rows), 20, *args) == plain(rows, 20, *args)


def test_large_numbers(spark):
    rows = [(i, [10**7 - i, i * 791, -(10**8)], i % 2) for i in range(60)]
    assert mined(frame(spark, rows), 10) == plain(rows, 10)
    with pytest.raises(ValueError, match="do not fit"):
        mined(frame(spark, [(0, [10**9], 1)]), 10)


def test_odd_rows(make_df):
    assert mined(make_df(SCHEMA, []), 10) == []
    assert mined(make_df(SCHEMA, [{"vec_id": 0, "vector": [1], "label": 1}]), 10) == []
    assert mined(make_df(SCHEMA, [{"vec_id": 0, "vector": [], "label": 1}]), 10) == []
    rows = [(0, [1, 2], 1), (0, [1, 2], 1), (0, [2, 2], 2), (3, [5], 2), (4, [], 1), (5, [1, 2, 3], 1), (6, [-9], 2),
            (10, [0, 0], 2), (20, [-1, -1], 1)]
    nulls = [{"vec_id": 30, "vector": [1, 1]}, {"vec_id": 1, "label": 1}, {"vector": [1, 2], "label": 2}]
    df = make_df(SCHEMA, [{"vec_id": i, "vector": v, "label": c} for i, v, c in rows] + nulls)
    assert mined(df, 10) == plain(rows, 10)


def test_query_against_its_sql(spark):
    con = connect("/root/testdata/sf0.01")
    assert compare(spark, con, "op13_negatives", "/root/testdata/sf0.01") is None

"""Tables in buckets: what a batch reads, shuffles and writes."""

from __future__ import annotations

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fieldbeat.functions.merge import insert_ignore, upsert
from fieldbeat.sources.buckets import BucketTable

SCHEMA = "k string, day int, n int"


@pytest.fixture
def table(spark, make_df, tmp_path):
    made = BucketTable(spark, str(tmp_path / "t"), SCHEMA, ["k", "day"], 8)
    made.create(make_df(SCHEMA, [{"k": f"k{i}", "day": i % 3, "n": i} for i in range(60)] + [{"day": 1, "n": 99}]))
    return made


def content(df):
    return sorted(map(str, df.collect()))


def files(table) -> dict[int, set[str]]:
    found: dict[int, set[str]] = {}
    for path in Path(table.root, "rows").glob("slot=*/bucket=*/part-*"):
        found.setdefault(int(path.parent.name.split("=")[1]), set()).add(str(path))
    return found


BATCH = [{"k": "k1", "day": 1, "n": 500}, {"k": "k1", "day": 2, "n": 502}, {"k": "k1", "day": 2, "n": 501},
         {"k": "k4", "day": 1, "n": 503}, {"k": None, "day": 1, "n": 504}, {"k": "new", "day": None, "n": 505}]


def test_insert_and_upsert_as_on_plain_tables(table, make_df):
    batch, keys = make_df(SCHEMA, BATCH), ["k", "day"]
    want = content(insert_ignore(table.rows(), batch, keys, F.col("n")))
    assert table.insert_ignore(batch, F.col("n"), "a")
    assert not table.insert_ignore(batch, F.col("n"), "a")
    assert content(table.rows()) == want
    want = content(upsert(table.rows(), batch, keys, ["n"], F.col("n")))
    assert table.upsert(batch, ["n"], F.col("n"), "b")
    assert content(table.rows()) == want


def test_only_touched_buckets_are_written(table, make_df):
    batch = make_df(SCHEMA, [{"k": "k1", "day": 1, "n": 7}])
    own = batch.select(table.bucket()).first()[0]
    before = files(table)
    for n, slots in ((1, 2), (2, 2), (3, 2)):  # two places at most, however many batches
        table.upsert(batch.withColumn("n", F.lit(n)), ["n"])
        after = files(table)
        assert {b: f for b, f in after.items() if b != own} == {b: f for b, f in before.items() if b != own}
        assert len({Path(f).parent for f in after[own]}) == slots
    assert [r["n"] for r in table.rows().where("k = 'k1'").collect()] == [3]
    assert len(table.rows().collect()) == 61


def test_no_rows_left_in_a_bucket_and_rows_again(table, make_df):
    everything = table.rows().select("k", "day")
    for _ in range(2):
        table.change(everything, lambda rows: rows.where("n < 0"))
        assert table.rows().isEmpty()
    table.insert_ignore(make_df(SCHEMA, BATCH), F.col("n"))
    assert len(table.rows().collect()) == 5


def test_empty_batch(table, make_df):
    want = content(table.rows())
    assert table.insert_ignore(make_df(SCHEMA, []), F.col("n"), "none")
    assert not table.insert_ignore(make_df(SCHEMA, BATCH), F.col("n"), "none")
    assert content(table.rows()) == want


def test_a_batch_that_dies_changes_nothing(table, make_df, monkeypatch):
    want, batch = content(table.rows()), make_df(SCHEMA, BATCH)

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr("fieldbeat.sources.buckets.commit", dies)
        with pytest.raises(RuntimeError, match="lost"):
            table.upsert(batch, ["n"], F.col("n"), "a")
    assert content(table.rows()) == want
    want = content(upsert(table.rows(), batch, ["k", "day"], ["n"], F.col("n")))
    assert table.upsert(batch, ["n"], F.col("n"), "a")
    assert content(table.rows()) == want


def test_rows_of_other_buckets_are_refused(table, make_df):
    with pytest.raises(ValueError, match="does not touch"):
        table.change(make_df("k string, day int", [{"k": "k1", "day": 1}]), lambda rows: rows.unionByName(
            make_df(SCHEMA, [{"k": f"x{i}", "day": 1, "n": i} for i in range(50)])))
    assert len(table.rows().collect()) == 61


def test_another_session_finds_the_table(table, spark):
    spark.sql(f"DROP TABLE {table.name}")  # the files stay
    again = BucketTable(spark, table.root, SCHEMA, ["k", "day"], 8)
    assert len(again.rows().collect()) == 61


def shuffled_scans(df, mark: str) -> list[bool]:
    """For each scan whose line has the mark: whether an exchange lies above it."""
    above, found = [], []
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(re.match(r"[ :+\-]*", line).group())
        above = [(d, text) for d, text in above if d < depth] + [(depth, line)]
        if "FileScan" in line and mark in line:
            found.append(any("Exchange hash" in text for _, text in above))
    return found


def test_the_table_is_not_shuffled(table, spark, make_df):
    batch = spark.range(1000).select(
        F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"), (F.col("id") % 3).cast("int").alias("day"),
        F.lit(2).alias("n"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for batches of any size
    try:
        keys, old = ["k", "day"], table.rows([1, 3])
        for result in (upsert(old, batch, keys, ["n"]), insert_ignore(old, batch, keys, F.col("n")),
                       old.join(batch.select("k", "day"), keys, "left_semi")):
            scans = shuffled_scans(result, "Bucketed: true")
            assert scans and not any(scans)
            assert "PartitionFilters" in result._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_only_folders_of_touched_buckets_are_read(table):
    read = table.rows([1, 3])
    assert {r[0] for r in read.select(table.bucket()).distinct().collect()} <= {1, 3}
    assert "bucket#" in re.search(
        r"PartitionFilters: \[.*?\]", read._jdf.queryExecution().executedPlan().toString()).group()

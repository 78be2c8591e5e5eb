"""Ids, text patterns, rounding, positions, top rows and merges."""

from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldbeat.functions.columns import (
    clamp, clean_name, contains_text, id_number, like_pattern, make_id, mean_score, pack, percent,
)
from fieldbeat.functions.joins import left_join_many
from fieldbeat.functions.merge import assign_ids, insert_ignore, last_number, upsert
from fieldbeat.functions.ranking import top_per_key, with_position


def test_ids_are_padded_below_ten_only(spark, rows_of):
    df = spark.createDataFrame([(1,), (9,), (10,), (123,)], "n bigint")
    ids = df.select(make_id("m", F.col("n")).alias("id"))
    assert [r[0] for r in ids.collect()] == ["m01", "m09", "m10", "m123"]
    assert rows_of(ids.select(id_number(F.col("id"), "m").alias("n")), "n") == [
        (1,), (9,), (10,), (123,)]


@pytest.mark.parametrize("text", [
    "mx", "m", "", "x12", "m 7", "m-7", "m7 ", "ms7", "7", "m1e3", "m12345678901234567890"])
def test_malformed_id_fails(spark, text):
    df = spark.createDataFrame([(text,)], "id string")
    with pytest.raises(Exception, match="malformed id"):
        df.select(id_number(F.col("id"), "m")).collect()


def test_long_ids_and_none(spark):
    df = spark.createDataFrame([("m0009223372036854775807",), (None,)], "id string")
    assert [r[0] for r in df.select(id_number(F.col("id"), "m")).collect()] == [2**63 - 1, None]


def test_packed_keys(spark, rows_of):
    df = spark.createDataFrame([(0, 5), (1, 2**45 - 1), (2**18 - 1, 0)], "h bigint, l bigint")
    keys = [k for (k,) in rows_of(df.select(pack(F.col("h"), F.col("l")).alias("k")), "k")]
    assert keys == sorted(keys) and keys[0] == 5 and keys[-1] < 2**63
    for pair in ((0, 2**45), (0, -1), (2**18, 0), (-1, 0)):
        wide = spark.createDataFrame([pair], "h bigint, l bigint")
        with pytest.raises(Exception, match="number not in"):
            wide.select(pack(F.col("h"), F.col("l"))).collect()


def test_clamp():
    assert [clamp(n, 100) for n in (-5, 0, 1, 50, 100, 1000)] == [1, 1, 1, 50, 100, 100]


def test_clean_name():
    assert clean_name(" '\"Kim's Store\" '") == "Kim's Store"


@pytest.mark.parametrize("text, value, found", [
    ("asia", "South ASIA east", True),
    ("a%c", "xabcx", True),          # wildcards stay wildcards
    ("a_c", "abc", True),
    ("a_c", "ac", False),
    ("a\\%c", "a%c", True),          # quoted wildcard
    ("a\\%c", "abc", False),
    ("a\\bc", "abc", True),          # quoted plain letter
    ("a\\\\c", "a\\c", True),
    ("", "anything", True),
    ("É", "caférÉ", True),
])
def test_contains_text(spark, text, value, found):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(contains_text(F.col("v"), text)).first()[0] is found


def test_backslash_at_the_end_quotes_the_closing_wildcard():
    assert like_pattern("a\\") == "%a\\%"


@pytest.mark.parametrize("part, whole, rate", [
    (1, 2, "50.0"), (1, 16, "6.3"), (2, 3, "66.7"), (0, 5, "0.0"), (5, 5, "100.0"), (1, 0, None),
    (1, 2000, "0.1"), (1, 2001, "0.0"),
])
def test_percent(spark, part, whole, rate):
    df = spark.createDataFrame([(part, whole)], "p bigint, w bigint")
    value = df.select(percent(F.col("p"), F.col("w"))).first()[0]
    assert (None if value is None else str(value)) == rate


def test_mean_of_a_large_group_does_not_round_twice(spark):
    # Exact mean 0.0049995: rounded to six decimals first it would become 0.01.
    df = spark.range(20000).select(
        F.when(F.col("id") < 9999, F.lit("0.01")).otherwise("0").cast("decimal(5,2)").alias("s"))
    mean = df.agg(mean_score(F.sum("s"), F.count("s")).alias("m")).first()[0]
    assert str(mean) == "0.00"


KEYS = st.lists(st.integers(0, 2**62 - 1), unique=True, min_size=1, max_size=40)
NEAR = st.builds(lambda base, offs: sorted({base + o for o in offs}),
                 st.sampled_from([0, 2**20 - 5, 2**40 - 5, 2**60]),
                 st.lists(st.integers(0, 2**21), min_size=1, max_size=40))


@settings(max_examples=8, deadline=None)
@given(st.one_of(KEYS, NEAR), st.integers(1, 3))
def test_positions_equal_a_sort(spark, keys, groups):
    rows = [(k % groups, k) for k in keys]
    df = spark.createDataFrame(rows, "g int, k bigint")
    got = {(r.g, r.k): r.position for r in with_position(df, F.col("k"), ["g"]).collect()}
    want = {}
    for g in {g for g, _ in rows}:
        for i, k in enumerate(sorted(k for h, k in rows if h == g), 1):
            want[(g, k)] = i
    assert got == want


def test_positions_in_one_large_group(spark):
    df = spark.range(200_000).select(((F.col("id") * 7919) % 200_003 * 64).alias("k"))
    numbered = with_position(df, F.col("k"))
    window_free = numbered.agg(
        F.min("position"), F.max("position"), F.count_distinct("position")).first()
    assert tuple(window_free) == (1, 200_000, 200_000)
    by_key = numbered.orderBy("k").select("position").limit(1000).collect()
    assert [r[0] for r in by_key] == list(range(1, 1001))


def test_positions_in_groups_of_all_sizes(spark, rows_of):
    df = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 100).alias("g"),
        (F.col("id") * 7 % 2003).alias("k"))
    got = with_position(df, F.col("k"), ["g"])
    want = df.withColumn("position", F.row_number().over(Window.partitionBy("g").orderBy("k")))
    assert sorted(rows_of(got, "g", "k", "position")) == sorted(rows_of(want, "g", "k", "position"))


def test_null_position_key_fails(spark):
    df = spark.createDataFrame([(1,), (None,)], "k bigint")
    with pytest.raises(Exception, match="null position key"):
        with_position(df, F.col("k")).collect()


def test_unused_positions_are_not_computed(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 3)
    plan = with_position(df, F.col("id"), ["g"]).select("id")._jdf.queryExecution()
    assert "Window" not in plan.optimizedPlan().toString()
    assert "Join" not in plan.optimizedPlan().toString()


def test_top_per_key(spark):
    df = spark.createDataFrame([(1, 5), (1, 9), (1, 7), (2, 1)], "g int, v int")
    assert sorted(map(tuple, top_per_key(df, ["g"], [F.desc("v")], 2).collect())) == [
        (1, 7), (1, 9), (2, 1)]


def test_left_join_many_keeps_unmatched_rows(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, l string")
    right = spark.createDataFrame([(1, "x"), (1, "y"), (4, "z")], "k int, r string")
    got = left_join_many(left, right, "k").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, left.join(right, "k", "left").collect()))


def test_assign_ids_continue_behind_the_stored_ones(spark, rows_of):
    stored = spark.createDataFrame([("r07",), ("r08",)], "id string")
    new = spark.createDataFrame([(30,), (10,), (20,)], "seq bigint")
    got = assign_ids(new, "r", F.col("seq"), last_number(stored, "r"))
    assert sorted(rows_of(got, "seq", "id")) == [(10, "r09"), (20, "r10"), (30, "r11")]
    empty = assign_ids(new, "r", F.col("seq"), last_number(stored.limit(0), "r"))
    assert sorted(rows_of(empty, "id")) == [("r01",), ("r02",), ("r03",)]


MERGE = "k int, d int, a string, b string"


def test_insert_ignore(spark, rows_of):
    target = spark.createDataFrame([(1, 1, "old", "old")], MERGE)
    batch = spark.createDataFrame(
        [(1, 1, "new", "new", 1), (2, 1, "later", "x", 3), (2, 1, "first", None, 2)],
        MERGE + ", seq int")
    once = insert_ignore(target, batch, ["k", "d"], "seq")
    want = [(1, 1, "old", "old"), (2, 1, "first", None)]
    assert sorted(rows_of(once, "k", "d", "a", "b")) == want
    twice = insert_ignore(once, batch, ["k", "d"], "seq")
    assert sorted(rows_of(twice, "k", "d", "a", "b")) == want


def test_upsert_updates_some_columns_and_takes_nulls(spark, rows_of):
    target = spark.createDataFrame([(1, 1, "old", "old"), (3, 1, "kept", "kept")], MERGE)
    batch = spark.createDataFrame([(1, 1, None, "new"), (2, 1, "in", "in")], MERGE)
    once = upsert(target, batch, ["k", "d"], ["a"])
    want = [(1, 1, None, "old"), (2, 1, "in", "in"), (3, 1, "kept", "kept")]
    assert sorted(rows_of(once, "k", "d", "a", "b")) == want
    assert sorted(rows_of(upsert(once, batch, ["k", "d"], ["a"]), "k", "d", "a", "b")) == want


def test_upsert_in_order_inserts_the_first_and_updates_with_the_last(spark, rows_of):
    target = spark.createDataFrame([(1, 1, "old", "old")], MERGE)
    batch = spark.createDataFrame(
        [(1, 1, "a1", "b1", 1), (1, 1, None, "b2", 2), (2, 1, "a1", "b1", 3), (2, 1, "a2", "b2", 4)],
        MERGE + ", seq int")
    got = upsert(target, batch, ["k", "d"], ["a"], order="seq")
    assert sorted(rows_of(got, "k", "d", "a", "b")) == [(1, 1, None, "old"), (2, 1, "a2", "b1")]


def test_no_python_functions_in_the_library():
    from pathlib import Path

    for path in Path(__file__).parent.parent.joinpath("fieldbeat").rglob("*.py"):
        if path.parent.name == "llm":
            continue
        text = path.read_text()
        assert not re.search(r"(pandas_udf|applyInPandas|mapInPandas|\.rdd\b|collect\(\)|"
                             r"toPandas|localCheckpoint|crossJoin)", text), path
        assert "broadcast(" not in text, path  # that is Spark's choice by size

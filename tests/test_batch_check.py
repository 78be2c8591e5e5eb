"""The check of a damaged batch over raw tables of its own."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fieldbeat.operators import quality
from fieldbeat.plans.queries import BATCH_DATE, QUERIES
from fieldbeat.schema import RULES, SCHEMAS
from fieldbeat.sources.testdata import AS_OF, TestData

RAW = {
    "region": ("r_regionkey int, r_name string", [(0, "AFRICA"), (1, "ASIA")]),
    "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "KENYA", 0), (1, "JAPAN", 1)]),
    "supplier": ("s_suppkey bigint, s_name string, s_nationkey int",
                 [(i, f"Supplier {i}", i % 2) for i in range(40)]),
    "customer": ("c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
                 [(i, f"Customer#{i:09d}", i % 2, 1.5 * i, "FURNITURE") for i in range(60)]),
    # Some orders come twice, and the customers of the last ones do not exist.
    "orders": ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
               "o_orderpriority string",
               [(i, i % 66, "FOP"[i % 3], 100.0 * i, "1-URGENT") for i in [*range(400), *range(0, 400, 9)]]),
    # Some events have no instant, so that their rows belong to every batch.
    "events": ("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
               [(i, None if i % 19 == 5 else datetime(2024, 1, 30, 8) - timedelta(hours=i), i % 70, "view", 3.5, "{}")
                for i in [*range(120), *range(0, 120, 11)]]),
    "conversations": ("conv_id bigint, turn bigint, role string, text string", [(1, 0, "user", "Hello")]),
}


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory) -> TestData:
    folder = tmp_path_factory.mktemp("raw")
    for name, (schema, rows) in RAW.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return TestData(spark, str(folder))


def test_a_stored_batch_breaks_what_it_would_unstored(raw, rows_of):
    damaged = raw.damaged()
    is_new = {name: F.coalesce(F.col(c).cast("date") == AS_OF, F.lit(True)) for name, c in BATCH_DATE.items()}
    parts = {name: getattr(damaged, name) for name in BATCH_DATE}
    expected = quality.check_batch(
        damaged.replace(**{name: rows.where(~is_new[name]) for name, rows in parts.items()}),
        {name: rows.where(is_new[name]) for name, rows in parts.items()})
    want = sorted(map(str, rows_of(expected)))
    assert sorted(map(str, rows_of(QUERIES["d01_batch"](raw)))) == want
    assert {eval(row)["table_name"] for row in want} == set(BATCH_DATE)


def test_damage_is_done_once_and_not_in_each_read(raw):
    plan = QUERIES["d01_batch"](raw)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert not [line for line in scans if any(f"/{name}.parquet" in line for name in RAW)]
    assert sum("_new" in line for line in scans) >= 2 * len(BATCH_DATE)


@pytest.mark.parametrize("name", RULES)
def test_ruled_columns_are_all_that_rules_read(make_df, name):
    columns = quality.ruled_columns(name)
    assert set(columns) <= set(make_df(SCHEMAS[name], []).columns)
    quality._broken_rows(name, make_df(SCHEMAS[name], []).select(*columns))

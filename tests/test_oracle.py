"""Every registered query against its SQL, on plain and on skewed data."""

from __future__ import annotations

import shutil

import pytest

import __spark_entry__ as contract
from fieldbeat.plans.queries import QUERIES
from tests.compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain_data():
    return connect(SF_DIR)


@pytest.fixture(scope="module")
def skewed_data(tmp_path_factory):
    """A third of orders, events and messages belongs to one customer, user and session."""
    folder = tmp_path_factory.mktemp("skewed")
    for name in ("region", "nation", "customer", "supplier"):
        shutil.copy(f"{SF_DIR}/{name}.parquet", folder / f"{name}.parquet")
    changed = {
        "orders": "CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE o_custkey END AS o_custkey",
        "events": "CASE WHEN event_id % 3 = 0 THEN 5 ELSE user_id END AS user_id",
        "conversations": "CASE WHEN (conv_id * 31 + turn) % 3 = 0 THEN 4 ELSE conv_id END AS conv_id,"
        " CASE WHEN (conv_id * 31 + turn) % 3 = 0 THEN 1000 + row_number() OVER"
        " (ORDER BY conv_id, turn) ELSE turn END AS turn",
    }
    con = connect(SF_DIR)
    for name, columns in changed.items():
        con.execute(
            f"COPY (SELECT * REPLACE ({columns}) FROM {name})"
            f" TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder), connect(str(folder))


def test_every_query_has_sql():
    assert set(QUERIES) <= set(contract.queries())
    assert set(QUERIES) <= set(contract.oracle_sql())


def test_entry(spark):
    assert len(contract.entry(spark).collect()) == 20


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, plain_data, name):
    assert compare(spark, plain_data, name, SF_DIR) is None


@pytest.mark.parametrize("name", [
    "q01_score_merchants", "q02_reprofiled_scores", "q03_prioritized_all", "q05_history_all",
    "q15_area", "q18_visits_admin", "q19_dsp", "q23_chat_all", "q25_context", "m01_recs",
    "m01_visits", "m08_recs", "m09_sessions", "m09_messages",
])
def test_query_on_skewed_data(spark, skewed_data, name):
    folder, con = skewed_data
    assert compare(spark, con, name, folder) is None

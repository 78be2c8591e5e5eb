from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

from fieldbeat.schema import SCHEMAS
from fieldbeat.sources.tables import Tables


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    if session.conf.get("spark.checkpoint.dir", None) is None:
        session.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_df(spark):
    """A DataFrame from dicts; columns left out are null."""

    def make(schema: str, rows: list[dict]):
        empty = spark.createDataFrame([], schema)
        values = [tuple(r.get(c) for c in empty.columns) for r in rows]
        unknown = {k for r in rows for k in r} - set(empty.columns)
        assert not unknown, unknown
        return spark.createDataFrame(values, empty.schema)

    return make


@pytest.fixture(scope="session")
def make_tables(make_df):
    """Tables from lists of dicts; tables left out are empty."""

    def make(**rows: list[dict]) -> Tables:
        return Tables(lambda name: make_df(SCHEMAS[name], rows.get(name, [])))

    return make


@pytest.fixture(scope="session")
def rows_of():
    """Rows as dicts, or tuples of the named columns."""

    def rows(df, *columns: str):
        if columns:
            return [tuple(r[c] for c in columns) for r in df.select(*columns).collect()]
        return [r.asDict(recursive=True) for r in df.collect()]

    return rows

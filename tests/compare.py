"""Runs registered queries and their SQL at one scale and compares every value.

    python -m tests.compare [sf_dir] [query …]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

import __spark_entry__ as contract

TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
    "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _key(row):
    return tuple((v is None, str(v)) for v in row)


def _value(value):
    if isinstance(value, float):
        return 0.0 if value == 0 else round(value, 9)
    return value


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in values), key=_key)


def compare(spark, con, name: str, sf_dir: str) -> str | None:
    """None if equal, else what differs."""
    df = contract.queries()[name](spark, sf_dir)
    cursor = con.execute(contract.oracle_sql()[name])
    expected_types = {d[0]: str(d[1]) for d in cursor.description}
    types = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString())
             for f in df.schema}
    if types != expected_types:
        different = set(types.items()) ^ set(expected_types.items())
        return f"schema: {sorted(different)}"
    want = rows(list(expected_types), cursor.fetchall())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if got == want:
        return None
    extra = sorted(set(got) - set(want), key=_key)[:2]
    missing = sorted(set(want) - set(got), key=_key)[:2]
    return (f"rows {len(got)} against {len(want)}; columns {sorted(types)};\n"
            f"  spark {extra}\n  sql   {missing}")


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(contract.oracle_sql())
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, name, sf_dir)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.2f}s",
              problem or "", flush=True)
    print(f"{len(names) - failed} of {len(names)} equal")


if __name__ == "__main__":
    main()

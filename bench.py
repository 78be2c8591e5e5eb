"""Times every registered query and prints one JSON line.

The model tables are stored first, as they would be in use, and the queries run on the
stored tables (``stage_tables`` is the time to derive and write them). With BENCH_RAW=1
each query derives what it needs from the raw test tables instead.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession

from fieldbeat.plans.queries import QUERIES, plain
from fieldbeat.sources.tables import Tables, write_tables
from fieldbeat.sources.testdata import TestData


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("fieldbeat-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(df: DataFrame) -> None:
    """Computes every row and column without collecting any."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session()
    raw = TestData(spark, sf_dir)
    data, times = raw, {}
    if not os.environ.get("BENCH_RAW"):
        folder = spark.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir()
        root = tempfile.mkdtemp(prefix="fieldbeat-", dir=folder) if "://" not in folder else (
            f"{folder}/fieldbeat-bench-{int(time.time())}")
        start = time.perf_counter()
        write_tables(raw.tables, root)
        times["stage_tables"] = round(time.perf_counter() - start, 3)
        data = TestData(spark, sf_dir, Tables.from_parquet(spark, root))
    run(plain(QUERIES["q03_prioritized_admin"](data)))  # warm-up
    for name, query in QUERIES.items():
        start = time.perf_counter()
        run(plain(query(data)))
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total time of all registered queries" + (", from raw tables" if data is raw else ""),
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

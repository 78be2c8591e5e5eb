"""KPI roll-ups of a day that are kept, and follow change sets by signed differences.

Two tables are kept: a row per active merchant with the day's score and recommendation counts, in
buckets of its id, and a row per (region, area, DSP) with sums over its merchants. A change set
becomes new rows of the merchants it touches; their old rows are taken off the sums and their new
ones added, so nothing else is read. All sums are exact, and a distinct count is the number of
rows of a finer step that have merchants left, so it goes down again as well as up.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbeat.functions.columns import day
from fieldbeat.functions.joins import narrow
from fieldbeat.operators import dashboards, manager
from fieldbeat.schema import SCORE_TYPE
from fieldbeat.sources.buckets import BucketTable
from fieldbeat.sources.tables import Tables

GROUP = ["region", "area", "assigned_dsp_id"]
COUNTED = {"done": "Done", "new": "New", "in_progress": "In Progress"}
MERCHANT_ROWS = (
    f"id string, region string, area string, assigned_dsp_id string, priority_score {SCORE_TYPE},"
    " actions bigint, done bigint, new bigint, in_progress bigint")
SUMS = {"merchants": "bigint", "score_sum": "decimal(38,2)", "score_n": "bigint", "actions": "bigint",
        "done": "bigint", "new": "bigint", "in_progress": "bigint", "high": "bigint", "open": "bigint"}
SUM_ROWS = ", ".join([f"{c} string" for c in GROUP] + [f"{c} {kind}" for c, kind in SUMS.items()])


def sums(merchants: DataFrame) -> DataFrame:
    """The sums per (region, area, DSP) of rows per merchant."""
    weighed = merchants.withColumn("weight", F.greatest("actions", F.lit(1)))
    high, waiting = dashboards.is_high(), (F.col("new") + F.col("in_progress")) > 0
    return weighed.groupBy(*GROUP).agg(
        *manager.kpi_sums(), F.count_if(high).alias("high"), F.count_if(waiting).alias("open")
    ).select(*GROUP, *[F.col(c).cast(kind).alias(c) for c, kind in SUMS.items()])


def add(*signed: tuple[DataFrame, int]) -> DataFrame:
    """Rows of sums added up by their signs; groups all of whose sums are zero are left out."""
    first, *rest = [rows.select(*GROUP, *[(F.col(c) * sign).alias(c) for c in SUMS]) for rows, sign in signed]
    for rows in rest:
        first = first.unionByName(rows)
    added = first.groupBy(*GROUP).agg(*[F.sum(c).cast(kind).alias(c) for c, kind in SUMS.items()])
    some = F.lit(False)
    for c in SUMS:
        some = some | (F.col(c) != 0)
    return added.where(some)


def status_changes(tables: Tables, results: DataFrame, as_of: date) -> DataFrame:
    """(id, done, new, in_progress): by how much the day's counts of merchants change.

    ``results`` are those of a change set of statuses (seq, rec_id, status), and ``tables`` the
    tables before it.
    """
    last = results.groupBy("rec_id").agg(F.max_by("status", "seq").alias("after"))
    old = tables.recommendations.where(F.col("recommendation_date") == day(as_of)).select(
        F.col("id").alias("rec_id"), F.col("merchant_id").alias("id"), F.col("status").alias("before"))
    moved = narrow(old, last, "rec_id").join(last, "rec_id")

    def change(status: str) -> Column:
        return F.count_if(F.col("after") == status) - F.count_if(F.col("before") == status)

    return moved.groupBy("id").agg(*[change(s).alias(c) for c, s in COUNTED.items()])


def assignments(results: DataFrame) -> DataFrame:
    """(id, assigned_dsp_id) after a change set of assignments (seq, merchant_id, assigned_dsp_id)."""
    return results.groupBy(F.col("merchant_id").alias("id")).agg(
        F.max_by("assigned_dsp_id", "seq").alias("assigned_dsp_id"))


class KeptRollups:
    """The roll-ups of one day below ``root``.

    Apply a batch here first, under its name, and then to the store: each of the two tables, and
    the store, takes a name once, so a batch that died anywhere on the way is applied again as it
    was. Sums are stored before the merchants' rows that they were made from.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int):
        self.spark, self.root = spark, root
        self.merchants = BucketTable(spark, f"{root}/merchants", MERCHANT_ROWS, ["id"], buckets)
        self.sums = BucketTable(spark, f"{root}/sums", SUM_ROWS, GROUP, max(1, buckets // 16))

    def create(self, tables: Tables, as_of: date) -> None:
        self.merchants.create(manager.per_merchant(tables, as_of).select(*self.merchants.columns))
        self.sums.create(sums(self.merchants.rows()))

    def take_statuses(self, changes: DataFrame, batch: str) -> bool:
        """Takes the rows of ``status_changes``."""

        def changed(rows: DataFrame, changes: DataFrame) -> DataFrame:
            given = changes.select("id", *[F.col(c).alias(f"_{c}") for c in COUNTED])
            moved = {c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in COUNTED}
            return rows.join(given, "id", "left").withColumns(moved)

        return self._take(changes, changed, batch)

    def take_assignments(self, changes: DataFrame, batch: str) -> bool:
        """Takes the rows of ``assignments``."""

        def changed(rows: DataFrame, changes: DataFrame) -> DataFrame:
            given = changes.select("id", F.col("assigned_dsp_id").alias("_dsp"))
            return rows.join(given, "id", "left").withColumn(
                "assigned_dsp_id", F.coalesce("_dsp", "assigned_dsp_id"))

        return self._take(changes, changed, batch)

    def _take(self, changes: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame], batch: str) -> bool:
        if self.merchants.has(batch):
            return False
        scratch = f"{self.root}/scratch-{uuid4().hex}"

        def keep(df: DataFrame, name: str) -> DataFrame:
            df.write.parquet(f"{scratch}/{name}")
            return self.spark.read.schema(df.schema).parquet(f"{scratch}/{name}")

        try:
            changes = keep(changes, "changes")
            if not self.sums.has(batch):
                old = narrow(self.merchants.rows(self.merchants.touched(changes)), changes, "id")
                difference = keep(add((sums(change(old, changes)), 1), (sums(old), -1)), "difference")
                self.sums.change(difference, lambda rows: add((rows, 1), (difference, 1)), batch)
            return self.merchants.change(changes, lambda rows: change(rows, changes), batch)
        finally:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(scratch)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def area_summary(self) -> DataFrame:
        return manager.area_kpis(self.sums.rows())

    def dsp_performance(self, users: DataFrame) -> DataFrame:
        per_dsp = self.sums.rows().groupBy("assigned_dsp_id").agg(*[F.sum(c).alias(c) for c in SUMS])
        return manager.dsp_kpis(users, per_dsp)

    def dashboards_for_all(self, users: DataFrame, role: str) -> DataFrame:
        owners = self.sums.rows().groupBy(F.col("assigned_dsp_id").alias("owner_id")).agg(
            *[F.sum(c).alias(name) for c, name in zip(("merchants", "high", "open"), dashboards.COUNTS, strict=True)])
        return dashboards.per_viewer(users, owners, role)

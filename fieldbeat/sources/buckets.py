"""Large tables kept in buckets of their key, of which a batch rewrites those it touches.

A row's bucket is the hash of its key by which Spark also shuffles, modulo the number of buckets.
So a join on the whole key reads a bucket in one task and shuffles the other side only. Each
bucket is a folder with two slots, as the dates of other stored tables are: what replaces a bucket
is written to the slot not in use, and counts once the table of commits names it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from fieldbeat.functions.merge import insert_ignore, upsert
from fieldbeat.sources.tables import COMMITS, GONE, State, commit


class BucketTable:
    """One table below ``root``, in ``buckets`` buckets of ``keys``, with one writer at a time.

    Keys are unique, so no bucket is hot; a null in a key is a value like any other. The number of
    buckets is fixed when the table is written: choose it so that a bucket fits a task.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, keys: Sequence[str], buckets: int):
        self.spark, self.root, self.keys, self.buckets = spark, root, list(keys), buckets
        self.columns = spark.createDataFrame([], schema).columns
        self.name = f"buckets_{hashlib.sha256(root.encode()).hexdigest()[:16]}"
        keyed = ", ".join(f"`{k}`" for k in keys)
        # A batch overwrites only the folders that occur in it.
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({schema}, slot int, bucket int) USING parquet"
            " OPTIONS (partitionOverwriteMode 'dynamic') PARTITIONED BY (slot, bucket)"
            f" CLUSTERED BY ({keyed}) SORTED BY ({keyed}) INTO {buckets} BUCKETS LOCATION '{root}/rows'")
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/rows")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):  # written elsewhere
            spark.catalog.recoverPartitions(self.name)

    def create(self, rows: DataFrame) -> None:
        """Writes the table anew, one file a bucket."""
        self._write(rows.repartition(self.buckets, *self.keys), F.lit(0))
        commit(self.spark, self.root, 0, "0", None, [("rows", None, 0, None)], "overwrite")

    def rows(self, touched: Sequence[int] | None = None) -> DataFrame:
        """The committed rows, or those of some buckets. Both are filters on folders alone."""
        return self._read(State.read(self.spark, self.root), touched)

    def bucket(self) -> Column:
        return F.pmod(F.hash(*self.keys), F.lit(self.buckets))

    def has(self, batch: str) -> bool:
        commits = self.spark.read.schema(COMMITS).parquet(f"{self.root}/commits")
        return not commits.where(F.col("batch") == batch).isEmpty()

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets of these keys: as many numbers as there are buckets at most."""
        return sorted(r["n"] for r in keys.select(self.bucket().alias("n")).distinct().collect())

    def change(self, keys: DataFrame, build: Callable[[DataFrame], DataFrame],
               batch: str | None = None) -> bool:
        """Replaces the buckets of ``keys`` by what ``build`` makes of their rows; False if a batch
        of this name is stored already. ``build`` adds rows only with keys of these buckets."""
        if batch is not None and self.has(batch):
            return False
        state = State.read(self.spark, self.root)
        touched = self.touched(keys)
        ones = [b for b in touched if str(b) in state.dates("rows", 1)]
        done = []
        if touched:
            slot = F.when(self.bucket().isin(ones), 0).otherwise(1)
            present = self._write(build(self._read(state, touched)), slot)
            if beyond := present - set(touched):
                raise ValueError(f"rows of buckets that the batch does not touch: {sorted(beyond)}")
            done = [("rows", str(b), GONE if b not in present else 0 if b in ones else 1, None) for b in touched]
        commit(self.spark, self.root, state.seq + 1, uuid4().hex, batch, done or [("", None, None, None)])
        return True

    def insert_ignore(self, rows: DataFrame, order: Column, batch: str | None = None) -> bool:
        """Adds the first row of each key that the table does not have."""
        return self.change(rows, lambda old: insert_ignore(old, rows, self.keys, order), batch)

    def upsert(self, rows: DataFrame, update: Sequence[str], order: Column | None = None,
               batch: str | None = None) -> bool:
        """Adds rows with new keys, and sets the ``update`` columns of the others."""
        return self.change(rows, lambda old: upsert(old, rows, self.keys, update, order), batch)

    def _read(self, state: State, touched: Sequence[int] | None = None) -> DataFrame:
        current = F.lit(0)
        for slot in (1, GONE):
            if buckets := [int(b) for b in state.dates("rows", slot)]:
                current = F.when(F.col("bucket").isin(buckets), slot).otherwise(current)
        rows = self.spark.table(self.name).where(F.col("slot") == current)
        if touched is not None:
            rows = rows.where(F.col("bucket").isin(list(touched)))
        return rows.select(self.columns)

    def _write(self, rows: DataFrame, slot: Column) -> set[int]:
        """Writes the rows to their buckets in this slot; the buckets that occur."""
        seen = Observation()
        placed = rows.select(*self.columns, slot.alias("slot"), self.bucket().alias("bucket"))
        placed.observe(seen, F.collect_set("bucket").alias("buckets")).write.insertInto(
            self.name, overwrite=True)
        try:
            return set(seen.get["buckets"])
        except Py4JJavaError:  # a plan that is known to be empty has no metrics
            return set()

"""Stored tables, and change sets applied to them."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from fieldbeat.functions.columns import id_number
from fieldbeat.operators.changes import ChangeSet, Keep
from fieldbeat.schema import ID_PREFIX, LATEST, PARTITION_COLUMN
from fieldbeat.sources.tables import (
    COMMITS, GONE, State, Tables, add_rows, at_once, begin, commit, date_text, replace_dates, replace_table,
)

# (table, date, slot, highest id number), as the table of commits has them.
Written = tuple[str, str | None, int | None, int | None]

# Parts of a change set that add rows to other tables.
ADDED_PARTS = {"audit_logs": "audit", "visit_history": "visits", "chat_messages": "messages"}


@dataclass
class NewRows:
    """What a batch writes: tables as a whole, dates of tables (the rows, and the dates they
    replace, some of which may have no row left), and rows to add."""

    whole: dict[str, DataFrame] = field(default_factory=dict)
    dates: dict[str, tuple[DataFrame, DataFrame]] = field(default_factory=dict)
    added: dict[str, DataFrame] = field(default_factory=dict)


class Store:
    """Parquet tables below ``root``, one directory per table, with one writer at a time.

    A batch is computed from the tables as they are, written beside them, and counts as a whole
    once it commits. A batch that died has changed nothing and is computed anew.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def tables(self) -> Tables:
        return Tables.from_parquet(self.spark, self.root)

    def scratch(self, name: str) -> str:
        """A shared folder for intermediate results: in the cluster's checkpoint folder."""
        return f"{self.spark.conf.get('spark.checkpoint.dir', None) or f'{self.root}/_scratch'}/{name}"

    def write(self, name: str, rows: DataFrame) -> None:
        """Replaces a table, or, if it has dates, the dates that occur in ``rows``."""
        column = PARTITION_COLUMN.get(name)
        if column is None:
            self.change(lambda tables, keep: NewRows(whole={name: rows}))
        else:
            self.change(lambda tables, keep: NewRows(dates={name: (rows, rows.select(column))}))

    def apply(self, build: Callable[[Tables, Keep], ChangeSet], batch: str | None = None) -> bool:
        """Stores the outcome of a change set; False if a batch of this name is stored already.

        ``build`` gets the tables as they are and a function that keeps an intermediate result,
        by which the batch is checked once for all its parts.
        """

        def rows(tables: Tables, keep: Keep) -> NewRows:
            changes, new = build(tables, keep), NewRows()
            if changes.touched is None:
                new.whole[changes.name] = changes.table
            else:
                column = PARTITION_COLUMN[changes.name]
                dates = keep(changes.touched.select(column).distinct())
                table = changes.table
                kept = table.join(
                    dates.withColumnRenamed(column, "_date"),
                    table[column].eqNullSafe(F.col("_date")), "left_semi")
                new.dates[changes.name] = (kept, dates)
            for name, part in ADDED_PARTS.items():
                if (added := getattr(changes, part)) is not None:
                    new.added[name] = added
            return new

        return self.change(rows, batch)

    def change(self, build: Callable[[Tables, Keep], NewRows], batch: str | None = None) -> bool:
        """Computes, stores and commits new rows. A batch is never stored twice."""
        if batch is not None and not self.commits().where(F.col("batch") == batch).isEmpty():
            return False
        state, attempt = State.read(self.spark, self.root), uuid.uuid4().hex
        scratch, seq = self.scratch(attempt), state.seq + 1

        def keep(df: DataFrame) -> DataFrame:
            path = f"{scratch}/{uuid.uuid4().hex}"
            df.write.parquet(path)
            return self.spark.read.schema(df.schema).parquet(path)

        try:
            new = build(self.tables(), keep)
            if new.added:
                begin(self.spark, self.root, seq, attempt)
            steps = [partial(self._add, name, rows, state, attempt) for name, rows in new.added.items()]
            steps += [partial(self._replace, name, rows, state) for name, rows in new.whole.items()]
            steps += [partial(self._replace_dates, name, *rows, state) for name, rows in new.dates.items()]
            done = [row for rows in at_once(steps) for row in rows]
            # Newest rows are not known where a history has changed without them.
            done += [(latest, None, GONE, None) for latest, table in LATEST.items()
                     if table in new.whole.keys() | new.dates.keys() and latest not in new.whole]
            commit(self.spark, self.root, seq, attempt, batch, done or [("", None, None, None)])
        finally:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(scratch)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return True

    def commits(self) -> DataFrame:
        return self.spark.read.schema(COMMITS).parquet(f"{self.root}/commits")

    def _add(self, name: str, rows: DataFrame, state: State, attempt: str) -> list[Written]:
        last, _ = self._written(name, rows, state, partial(
            add_rows, root=self.root, name=name, attempt=attempt))
        return [(name, None, None, last)]

    def _replace(self, name: str, rows: DataFrame, state: State) -> list[Written]:
        slot = 1 if state.slot(name) == 0 else 0
        last, _ = self._written(name, rows, state, partial(
            replace_table, root=self.root, name=name, slot=slot))
        return [(name, None, slot, last)]

    def _replace_dates(self, name: str, rows: DataFrame, dates: DataFrame, state: State) -> list[Written]:
        ones = state.dates(name, 1)
        moved = rows.withColumn("slot", F.when(date_text(name).isin(ones), 0).otherwise(1))
        last, present = self._written(name, moved, state, partial(replace_dates, root=self.root, name=name))
        touched = {r["date"] for r in dates.select(date_text(name).alias("date")).distinct().collect()}
        slots = {d: GONE if d not in present else 0 if d in ones else 1 for d in touched | present}
        return [(name, None, None, last), *((name, d, slot, None) for d, slot in sorted(slots.items()))]

    def _written(self, name: str, rows: DataFrame, state: State,
                 write: Callable[[DataFrame], None]) -> tuple[int | None, set[str]]:
        """Writes the rows; the highest id number so far, which is read from the whole table only
        the first time, and the dates that occur among the rows."""
        metrics = [F.count(F.lit(1)).alias("n")]
        if name in ID_PREFIX:
            number = F.max(id_number(F.col("id"), ID_PREFIX[name]))
            metrics.append(number.alias("last"))
            before = state.last.get(name)
            if before is None:
                before = getattr(self.tables(), name).agg(number).first()[0]
        if name in PARTITION_COLUMN:
            metrics.append(F.collect_set(date_text(name)).alias("dates"))
        seen = Observation()
        write(rows.observe(seen, *metrics))
        try:
            found = seen.get
        except Py4JJavaError:  # a plan that is known to be empty has no metrics
            found = {}
        last = max(before or 0, found.get("last") or 0) if name in ID_PREFIX else None
        return last, set(found.get("dates") or ())

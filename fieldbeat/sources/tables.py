"""The nine tables of the model, where they can be read from, and how they are stored.

A stored table, or each date of one, has two slots. What replaces it is written to the slot not
in use, by Spark's overwrite of the partitions that occur, and counts once a row of the table of
commits names the slot. Rows that are only added carry the name of the attempt that added
them; those of an attempt that began and did not commit are left out when read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbeat.functions.merge import last_number
from fieldbeat.functions.ranking import top_per_key
from fieldbeat.schema import (
    ADDED_TABLES, ATTEMPT_COLUMN, BAD_ROWS, ID_PREFIX, LATEST, LOG_DATE, PARTITION_COLUMN, SCHEMAS,
)

Days = Callable[[int], tuple[DataFrame, bool]]
NO_DATE = "__HIVE_DEFAULT_PARTITION__"  # the directory of rows whose date is null
COMMITS = ("seq bigint, attempt string, began string, batch string, table_name string, date string, "
           "slot int, last bigint")
GONE = -1  # the slot of what has no rows


def table_schema(name: str) -> str:
    return BAD_ROWS if name == "bad_rows" else SCHEMAS[LATEST.get(name, name)]


class Tables:
    """Lazily read tables, by attribute: ``tables.merchants``, ``tables.daily_scores`` …

    ``read`` maps a table name to its DataFrame and is called once per table. ``latest_signals``
    and ``latest_scores`` hold each merchant's newest row; they are read if ``read`` has them
    (they are named in ``stored``), else found in the whole history. ``last`` has the highest id
    numbers that are known; others are looked for in the table. ``days`` reads the newest days of
    logs that are stored by date.
    """

    def __init__(self, read: Callable[[str], DataFrame], last: Mapping[str, int] | None = None,
                 stored: Iterable[str] = (), days: Mapping[str, Days] | None = None):
        self._read, self._last, self._stored = read, dict(last or {}), frozenset(stored)
        self._days = dict(days or {})
        self._frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS and name not in LATEST and name != "bad_rows":
            raise AttributeError(name)
        if name not in self._frames:
            self._frames[name] = newest(
                getattr(self, LATEST[name]), LATEST[name]) if (
                name in LATEST and name not in self._stored) else self._read(name)
        return self._frames[name]

    def last_number(self, name: str) -> Column:
        """The highest id number of a table, 0 if it is empty."""
        if name in self._last:
            return F.lit(self._last[name])
        return last_number(getattr(self, name), ID_PREFIX[name])

    def newest_days(self, name: str, n: int) -> tuple[DataFrame, bool]:
        """Rows of a log's ``n`` newest dates and those without a date, and whether there are older
        ones. All rows where the log is not stored by date."""
        return self._days[name](n) if name in self._days else (getattr(self, name), False)

    def replace(self, **frames: DataFrame) -> Tables:
        """A copy with some tables exchanged, e.g. for the results of a change set."""
        changed = set(frames) | {n for n, table in LATEST.items() if table in frames}
        return Tables(
            lambda name: frames[name] if name in frames else getattr(self, name),
            {n: last for n, last in self._last.items() if n not in frames},
            (self._stored - changed) | (LATEST.keys() & frames.keys()),
            {n: days for n, days in self._days.items() if n not in frames})

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str) -> Tables:
        """The tables below ``root``, as ``write_tables`` and ``Store`` leave them."""
        state = State.read(spark, root)
        return cls(lambda name: read_table(spark, root, name, state), state.last,
                   {name for name in LATEST if state.slot(name) >= 0},
                   {name: partial(newest_days, spark, root, name, state) for name in LOG_DATE})

    @classmethod
    def from_jdbc(
        cls,
        spark: SparkSession,
        url: str,
        properties: Mapping[str, str],
        predicates: Mapping[str, list[str]],
    ) -> Tables:
        """Tables of a relational database.

        ``predicates`` gives each table's disjoint WHERE clauses; Spark reads one
        partition per clause, so that no table comes through a single connection.
        """

        def read(name: str) -> DataFrame:
            source = "chat_sessions" if name == "chat_messages" else name
            return conform(name, spark.read.jdbc(
                url, source, predicates=predicates[source], properties=dict(properties)))

        return cls(read)


def newest(table: DataFrame, name: str) -> DataFrame:
    """The row of the latest date of each merchant."""
    return top_per_key(table, ["merchant_id"], [F.desc(PARTITION_COLUMN[name])])


def conform(name: str, rows: DataFrame) -> DataFrame:
    """Rows as a database has them, in the columns and types of the model.

    Instants with a zone become UTC without one, JSON texts become structs, and a session's JSON
    array of messages (``chat_messages`` from ``chat_sessions``) becomes a row a message. A column
    that is missing is null; further ones are left out.
    """
    schema = rows.sparkSession.createDataFrame([], SCHEMAS[name]).schema
    if name == "chat_messages" and "messages" in rows.columns:
        items = F.from_json(F.col("messages").cast("string"), "array<struct<role:string,content:string>>")
        rows = rows.select(F.col("id").alias("session_id"), F.posexplode(items)).select(
            "session_id", F.col("pos").cast("bigint").alias("position"), "col.role", "col.content")
    given = dict(rows.dtypes)

    def column(wanted) -> Column:
        kind = wanted.dataType.simpleString()
        if wanted.name not in given:
            return F.lit(None).cast(kind)
        value = F.col(wanted.name)
        if given[wanted.name] == "timestamp" and kind == "timestamp_ntz":
            return F.convert_timezone(F.current_timezone(), F.lit("UTC"), value.cast("timestamp_ntz"))
        if given[wanted.name] == "string" and kind.startswith("struct"):
            return F.from_json(value, kind)
        return value.cast(kind)

    return rows.select(*[column(f).alias(f.name) for f in schema])


@dataclass
class State:
    """What the table of commits says: which of its two slots holds a table, or a date of a table
    (0 where it says nothing, ``GONE`` if none), the highest id numbers, and the attempts that
    began to add rows but did not commit. As large as the number of dates ever replaced."""

    seq: int
    slots: dict[tuple[str, str | None], int]
    last: dict[str, int]
    dead: list[str]
    names: set[str]

    @classmethod
    def read(cls, spark: SparkSession, root: str) -> State:
        commits = spark.read.schema(COMMITS).parquet(f"{root}/commits")
        rows = commits.groupBy("table_name", "date").agg(
            F.max("seq").alias("seq"), F.max_by("slot", "seq").alias("slot"), F.max("last").alias("last"),
            F.collect_set("began").alias("began"), F.collect_set("attempt").alias("done")).collect()
        named = [r for r in rows if r["table_name"] is not None]
        done = {a for r in named for a in r["done"]}
        return cls(
            max((r["seq"] for r in rows), default=0),
            {(r["table_name"], r["date"]): r["slot"] for r in named if r["slot"] is not None},
            {r["table_name"]: r["last"] for r in named if r["date"] is None and r["last"] is not None},
            sorted({a for r in rows for a in r["began"]} - done),
            {r["table_name"] for r in named})

    def slot(self, name: str, date: str | None = None) -> int:
        return self.slots.get((name, date), GONE if name in LATEST else 0)

    def dates(self, name: str, slot: int) -> list[str]:
        return sorted(d for (n, d), s in self.slots.items() if n == name and d is not None and s == slot)


def date_text(name: str) -> Column:
    """The date of a row as its folder names it."""
    return F.coalesce(F.col(PARTITION_COLUMN[name]).cast("string"), F.lit(NO_DATE))


def newest_days(spark: SparkSession, root: str, name: str, state: State, n: int) -> tuple[DataFrame, bool]:
    """See ``Tables.newest_days``. The dates are the names of folders."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    start = f"{LOG_DATE[name][0]}="
    names = (folder.getPath().getName() for folder in found)
    dates = sorted((d.removeprefix(start) for d in names if d.startswith(start) and NO_DATE not in d), reverse=True)
    since = dates[n - 1] if len(dates) > n else None
    return read_table(spark, root, name, state, since), since is not None


def read_table(spark: SparkSession, root: str, name: str, state: State, since: str | None = None) -> DataFrame:
    """The committed rows of a stored table. Which slots hold them is a filter on folders alone, as is
    ``since``, a log's first date to read; rows without a date are read, too."""
    path, schema = f"{root}/{name}", table_schema(name)
    empty = spark.createDataFrame([], schema)
    columns = empty.columns
    if name == "bad_rows" and name not in state.names:
        return empty
    if name in ADDED_TABLES:
        log = f", {LOG_DATE[name][0]} date" if name in LOG_DATE else ""
        rows = spark.read.schema(f"{schema}, {ATTEMPT_COLUMN} string{log}").parquet(path)
        if state.dead:
            rows = rows.where(~F.col(ATTEMPT_COLUMN).isin(state.dead))
        if since is not None:
            date = F.col(LOG_DATE[name][0])
            rows = rows.where(date.isNull() | (date >= F.lit(since).cast("date")))
    elif name in PARTITION_COLUMN:
        rows = spark.read.schema(f"{schema}, slot int").parquet(path)
        text, current = date_text(name), F.lit(0)
        for slot in (1, GONE):
            if dates := state.dates(name, slot):
                current = F.when(text.isin(dates), F.lit(slot)).otherwise(current)
        rows = rows.where(F.col("slot") == current)
    else:
        rows = spark.read.schema(schema).parquet(f"{path}/slot={state.slot(name)}")
    return rows.select(columns)


def write_tables(tables: Tables, root: str, names: tuple[str, ...] = (*SCHEMAS, *LATEST)) -> None:
    """Writes tables as Parquet, those with a date in one directory per date."""
    spark = getattr(tables, names[0]).sparkSession

    def write(name: str) -> None:
        rows = getattr(tables, name)
        if name in ADDED_TABLES:
            add_rows(rows, root, name, "0", "overwrite")
        elif name in PARTITION_COLUMN:
            replace_dates(rows.withColumn("slot", F.lit(0)), root, name)
        else:
            replace_table(rows, root, name, 0)

    at_once([partial(write, name) for name in names])
    commit(spark, root, 0, "0", None, [(name, None, 0, None) for name in names], "overwrite")


def at_once(steps: list[Callable]) -> list:
    """Results of independent Spark jobs, started together; a few, one for each table."""
    with ThreadPoolExecutor(max(1, len(steps))) as pool:
        return [job.result() for job in [pool.submit(step) for step in steps]]


def _by_date(df: DataFrame, date: str | None) -> DataFrame:
    """Rows of a date together; a date too large for one task is split by AQE (REBALANCE), so
    there are neither many small files nor one hot task result."""
    return df.hint("rebalance", date) if date else df


def replace_table(df: DataFrame, root: str, name: str, slot: int) -> None:
    df.write.mode("overwrite").parquet(f"{root}/{name}/slot={slot}")


def replace_dates(df: DataFrame, root: str, name: str) -> None:
    """Replaces the folders of the slots and dates that occur."""
    date = PARTITION_COLUMN[name]
    _by_date(df, date).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "slot", date).parquet(f"{root}/{name}")


def add_rows(df: DataFrame, root: str, name: str, attempt: str, mode: str = "append") -> None:
    """Adds rows to a table that only grows, by date if it has one."""
    date, df = PARTITION_COLUMN.get(name), df.withColumn(ATTEMPT_COLUMN, F.lit(attempt))
    if name in LOG_DATE:
        date, at = LOG_DATE[name]
        df = df.withColumn(date, F.to_date(at))
    _by_date(df, date).write.mode(mode).partitionBy(*[date] if date else []).parquet(f"{root}/{name}")


def commit(spark: SparkSession, root: str, seq: int, attempt: str, batch: str | None,
           tables: list[tuple[str, str | None, int | None, int | None]], mode: str = "append") -> None:
    """One small file that says what an attempt has written: all of it or nothing."""
    _append(spark, root, [(seq, attempt, None, batch, *table) for table in tables], mode)


def begin(spark: SparkSession, root: str, seq: int, attempt: str) -> None:
    """Says that an attempt may add rows, which count once it commits."""
    _append(spark, root, [(seq, None, attempt, None, None, None, None, None)], "append")


def _append(spark: SparkSession, root: str, rows: list[tuple], mode: str) -> None:
    schema = spark.createDataFrame([], COMMITS).schema
    columns = [pa.array(values, pa.string() if f.dataType.simpleString() == "string" else pa.int64())
               for f, values in zip(schema, zip(*rows, strict=True), strict=True)]
    spark.createDataFrame(pa.table(columns, schema.names)).select(
        *[F.col(f.name).cast(f.dataType) for f in schema]).coalesce(1).write.mode(mode).parquet(f"{root}/commits")

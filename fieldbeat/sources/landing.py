"""Rows in bulk from files that others drop into a folder.

Files hold one row a line, as JSON objects or as CSV with a header. A line that cannot be read
as the table's declared schema, or breaks a rule on single rows, is kept apart with its text and a
reason; the others are taken unless the table has their key. Spark's file stream remembers which
files it has seen, and the store which of its batches it has stored, so every file counts once,
whenever the job dies.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader, StreamingQuery

from fieldbeat.functions.columns import id_number
from fieldbeat.functions.merge import new_rows
from fieldbeat.operators.changes import Keep, as_is
from fieldbeat.schema import ADDED_TABLES, ID_PREFIX, PARTITION_COLUMN, RULES, SCHEMAS
from fieldbeat.sources.store import NewRows, Store
from fieldbeat.sources.tables import Tables

UNREADABLE = "_unreadable"


@dataclass
class Landed:
    """The rows of landed files: ``good`` in the table's schema, ``bad`` as ``bad_rows`` has them."""

    good: DataFrame
    bad: DataFrame


def _broken(name: str) -> Column:
    """The first rule on single rows that a row breaks, or null."""
    rules = RULES[name]
    checks = [(F.col(UNREADABLE).isNotNull(), "unreadable")]
    checks += [(F.col(c).isNull(), f"{c} not null") for c in rules.not_null]
    if name in ID_PREFIX:
        checks.append((~F.col("id").rlike(f"^{ID_PREFIX[name]}[0-9]{{1,18}}$"), "id form"))
    checks += [(~F.col(c).isin(*values), f"{c} allowed") for c, values in rules.allowed.items()]
    checks += [(F.char_length(c) > length, f"{c} length") for c, length in rules.max_length.items()]
    return F.coalesce(*[F.when(failed, F.lit(reason)) for failed, reason in checks])


def _lines(reader: DataFrameReader | DataStreamReader, folder: str) -> DataFrame:
    return reader.format("text").load(folder).select(
        F.col("value").alias("line"), F.col("_metadata.file_name").alias("file"))


def parse(lines: DataFrame, name: str, form: str = "json", keep: Keep = as_is) -> Landed:
    """Splits lines (line, file) of files for the table ``name``; empty ones are left out.

    A CSV line equal to the table's column names is a header. A value of a wrong type makes its
    line unreadable, as does a broken object; columns that are missing are null, further ones
    of an object are ignored.
    """
    empty = lines.sparkSession.createDataFrame([], SCHEMAS[name])
    schema = f"{SCHEMAS[name]}, {UNREADABLE} string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": UNREADABLE}
    lines = lines.where(F.trim("line") != "")
    if form == "json":
        row = F.from_json("line", schema, options)
    elif form == "csv":
        lines = lines.where(F.col("line") != ",".join(empty.columns))
        row = F.from_csv("line", schema, options)
    else:
        raise ValueError(f"unknown form of files: {form}")
    read = lines.select("file", "line", row.alias("row")).select("file", "line", "row.*")
    checked = keep(read.withColumn("_reason", _broken(name)))
    return Landed(
        checked.where(F.col("_reason").isNull()).select(empty.columns),
        checked.where(F.col("_reason").isNotNull()).select(
            F.lit(name).alias("table_name"), "file", F.col("line").alias("row"),
            F.col("_reason").alias("reason")))


def read_files(spark: SparkSession, folder: str, name: str, form: str = "json") -> Landed:
    """All files of a folder, whether or not they have been taken."""
    return parse(_lines(spark.read, folder), name, form)


def take(tables: Tables, lines: DataFrame, name: str, keys: list[str], form: str = "json",
         keep: Keep = as_is) -> NewRows:
    """What the lines change: rows of new keys, the first of each key by id number, and bad rows.

    Of a table with dates only those that occur among the lines are read and replaced, if the
    date is one of the keys.
    """
    landed, target = parse(lines, name, form, keep), getattr(tables, name)
    order = id_number(F.col("id"), ID_PREFIX[name]) if name in ID_PREFIX else F.struct(*keys)
    out, date = NewRows(added={"bad_rows": landed.bad}), PARTITION_COLUMN.get(name)
    if name in ADDED_TABLES:
        out.added[name] = new_rows(target, landed.good, keys, order)
    elif date in keys:
        dates = keep(landed.good.select(date).distinct())
        there = target.join(F.broadcast(dates), date, "left_semi")  # at most a row a day
        out.dates[name] = there.unionByName(new_rows(there, landed.good, keys, order)), dates
    elif date is None:
        out.whole[name] = target.unionByName(new_rows(target, landed.good, keys, order))
    else:
        raise ValueError(f"{date} must be one of the keys")
    return out


def take_files(store: Store, folder: str, name: str, keys: list[str], checkpoint: str,
               form: str = "json", source: str | None = None) -> StreamingQuery:
    """Starts a query that takes all files not yet taken, then stops.

    ``source`` names the folder in the store's list of batches; a checkpoint belongs to one source.
    """

    def apply(lines: DataFrame, number: int) -> None:
        store.change(lambda tables, keep: take(tables, lines, name, keys, form, keep),
                     f"{source or folder}-{number}")

    return (
        _lines(store.spark.readStream, folder).writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

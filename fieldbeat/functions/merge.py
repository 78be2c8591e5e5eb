"""Set forms of INSERT … ON CONFLICT and of sequence-generated ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbeat.functions.columns import id_number, make_id
from fieldbeat.functions.ranking import with_position


def last_number(table: DataFrame, prefix: str) -> Column:
    """Scalar subquery: highest id number of a table, 0 if it is empty."""
    return table.agg(F.coalesce(F.max(id_number(F.col("id"), prefix)), F.lit(0))).scalar()


def assign_ids(
    df: DataFrame, prefix: str, key: Column, after: Column | int = 0, name: str = "id"
) -> DataFrame:
    """Numbers the rows by ascending unique ``key``, starting behind ``after``."""
    start = after if isinstance(after, Column) else F.lit(after)
    return (
        with_position(df, key, name="_number")
        .withColumn(name, make_id(prefix, start + F.col("_number")))
        .drop("_number")
    )


def _one_per_key(
    batch: DataFrame, keys: Sequence[str], order: Column, last: Sequence[str]
) -> DataFrame:
    """First row of each key; the ``last`` columns come from the key's last row."""
    rest = [c for c in batch.columns if c not in keys]
    aggregates = [F.min_by(F.struct(*rest), order).alias("_first")]
    if last:
        aggregates.append(F.max_by(F.struct(*last), order).alias("_last"))
    picked = [F.col(f"_last.{c}" if c in last else f"_first.{c}").alias(c) for c in rest]
    return batch.groupBy(*keys).agg(*aggregates).select(*keys, *picked).select(*batch.columns)


def new_rows(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The first batch row of each key the target does not have; a null in a key meets nothing.

    ``order`` must sort as the rows came: ids by their number (``id_number``), not as text.
    """
    fresh = _one_per_key(batch, keys, order, ()).join(
        target.select(*keys), list(keys), "left_anti"
    )
    return fresh.select(*target.columns)


def insert_ignore(
    target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Column
) -> DataFrame:
    """ON CONFLICT DO NOTHING: the target, and the ``new_rows`` of the batch."""
    return target.unionByName(new_rows(target, batch, keys, order))


def upsert(
    target: DataFrame,
    batch: DataFrame,
    keys: Sequence[str],
    update: Sequence[str],
    order: Column | None = None,
) -> DataFrame:
    """ON CONFLICT DO UPDATE of the ``update`` columns; a null in the batch overwrites.

    Without ``order`` the batch must be unique on the keys. With it, rows of one key
    apply one after the other: the first inserts, the last one's update columns stay.
    """
    if order is not None:
        batch = _one_per_key(batch, keys, order, update)
    old, new = target.alias("old"), batch.withColumn("_given", F.lit(True)).alias("new")
    condition = [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys]
    has_old = F.col(f"old.{keys[0]}").isNotNull()

    def value(column: str) -> Column:
        kept, given = F.col(f"old.{column}"), F.col(f"new.{column}")
        if column in keys:
            return F.coalesce(kept, given).alias(column)
        if column in update:
            return F.when(F.col("new._given"), given).otherwise(kept).alias(column)
        return F.when(has_old, kept).otherwise(given).alias(column)

    return old.join(new, condition, "full_outer").select(*[value(c) for c in target.columns])

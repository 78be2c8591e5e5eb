"""Ordering operators that hold when one group has a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_BITS = 20


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    """The first ``k`` rows of each key.

    Spark applies the limit before the shuffle as well, so every task sends at most
    ``k`` rows of a key, however many it holds.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_row", F.row_number().over(window))
        .where(F.col("_row") <= k)
        .drop("_row")
    )


def first_rows(df: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """The first ``limit`` (a few hundred at most) rows, found once however often the result
    is used: as a scalar subquery they are one array, which Spark computes a single time."""
    page = df.orderBy(*order).limit(limit).agg(F.collect_list(F.struct(*df.columns)))
    return df.sparkSession.range(0, 1, 1, 1).select(F.inline(page.scalar()))


def with_position(
    df: DataFrame, key: Column, group: Sequence[str] = (), name: str = "position"
) -> DataFrame:
    """Adds the 1-based position of each row in its group, by ascending ``key``.

    ``key`` is a non-negative long below 2**63, unique within the group; group columns
    are not null. A plain ``row_number`` sends a whole group to one task. Here the key
    space is cut into blocks of 2**20 keys, and the blocks into spans of 2**20 blocks:
    rows are numbered within their block, and a block starts after the rows of the
    spans and blocks before it. So the rows of no group meet in one task: one window
    sees at most 2**20 rows of a block or 2**20 block counts of a span, and the last
    one only the spans that occur in the group.
    """
    group = list(group)
    # Not nullable: a null key fails, and no null filter makes the branches below differ,
    # so that they share one shuffle of the counts.
    missing = F.raise_error(F.lit("null position key")).cast("bigint")
    keyed = df.withColumn("_key", F.coalesce(key, missing, F.lit(-1)))
    keyed = keyed.withColumn("_block", F.shiftright("_key", BLOCK_BITS))
    keyed = keyed.withColumn("_span", F.shiftright("_block", BLOCK_BITS))
    blocks = keyed.groupBy(*group, "_span", "_block").agg(F.count("*").alias("_n"))
    spans = blocks.groupBy(*group, "_span").agg(F.sum("_n").alias("_span_n"))

    def before(count: str, window) -> Column:
        rows = window.rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(count).over(rows), F.lit(0))

    in_group = Window.partitionBy(*group).orderBy("_span")
    in_span = Window.partitionBy(*group, "_span").orderBy("_block")
    in_block = Window.partitionBy(*group, "_span", "_block").orderBy("_key")
    # One row per block, which the last grouping shows to the optimizer: where the position
    # is not used, it then drops the left join and with it all of this.
    starts = (
        blocks.withColumn("_in_span", before("_n", in_span))
        .join(
            spans.withColumn("_before_span", before("_span_n", in_group)).drop("_span_n"),
            [*group, "_span"],
        )
        .groupBy(*group, "_span", "_block")
        .agg(F.max(F.col("_before_span") + F.col("_in_span")).alias("_start"))
    )
    return (
        keyed.join(starts, [*group, "_span", "_block"], "left")
        .withColumn(name, F.col("_start") + F.row_number().over(in_block))
        .select(*df.columns, name)
    )

"""Joins that hold when one key has a third of all rows.

Spark splits a skewed key at run time only where both sides of a join come straight from
their shuffles, and where the side to split is not the optional one of an outer join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join in which Spark can split a hot key, whatever comes before it.

    The key's hash as a second join key makes this join shuffle both sides for itself,
    instead of reusing the partitioning of an earlier join or grouping by the key.
    """
    hashed = F.xxhash64(key)
    joined = left.withColumn("_hash", hashed).join(
        right.withColumn("_hash", hashed), [key, "_hash"], how)
    return joined.drop("_hash")


def left_join_many(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join to a side on which one key may have very many rows.

    In a left join only the left side can be split. So matches come from an inner join,
    and the rest from an anti join with the distinct keys.
    """
    matched = split_join(left, right, key)
    unmatched = left.join(right.select(key).distinct(), key, "left_anti")
    return matched.unionByName(unmatched, allowMissingColumns=True)


def narrow(table: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """A smaller table that still has all rows whose key occurs in ``wanted``.

    Compares hashes: few long numbers are cheap to broadcast, so for a small ``wanted`` the
    table is read once and not shuffled. The join that follows compares the keys themselves.
    """
    hashed = F.xxhash64(*keys)
    hashes = wanted.select(hashed.alias("_hash")).distinct()
    return table.withColumn("_hash", hashed).join(hashes, "_hash", "left_semi").drop("_hash")

"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldbeat.functions.joins import split_join
from fieldbeat.llm.shared import stage


def stars(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge and is not itself the lowest of its component.

    Alternates two steps until nothing changes: every larger neighbour of a node, then every
    smaller one, is linked to the lowest neighbour instead. Each round is staged, so a lost
    executor costs one round. Null ends and loops are ignored; an empty table has no stars.
    """
    a, b = edges.columns
    tidy = edges.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("node"), F.least(a, b).alias("root"))
    current, seen = stage(tidy.distinct()), None
    while True:
        state = current.agg(
            F.count("*").alias("n"), F.bit_xor(F.xxhash64("node", "root")).alias("h")).first()
        if state == seen or not state["n"]:
            return current
        seen = state
        current = stage(_smaller(_larger(current)).distinct())


def _larger(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
    lowest = both.groupBy("node").agg(F.min("root").alias("low"))
    lowest = lowest.withColumn("low", F.least("node", "low"))
    return (
        split_join(both, lowest, "node").where("root > node")
        .select(F.col("root").alias("node"), F.col("low").alias("root"))
    )


def _smaller(edges: DataFrame) -> DataFrame:
    lowest = edges.groupBy("node").agg(F.min("root").alias("low"))
    moved = split_join(edges, lowest, "node").where("root != low").select(
        F.col("root").alias("node"), F.col("low").alias("root"))
    return moved.unionByName(lowest.withColumnRenamed("low", "root"))

"""One JSON document per merchant: profile, scores, signals and visits."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, StructField

from fieldbeat.functions.columns import id_number, pack
from fieldbeat.functions.joins import split_join
from fieldbeat.functions.ranking import with_position
from fieldbeat.operators.merchants import (
    merchant_details, merchants_in_scope, scoped_visits, with_visitors,
)
from fieldbeat.operators.scope import Caller
from fieldbeat.sources.tables import Tables

VISITS_PER_PART = 1000
LAST_DAY = 100_000  # days since 1970-01-01; later than any visit


def _json_values(fields: Iterable[StructField], prefix: str = "") -> list[Column]:
    """Columns as they go into JSON: decimals as plain numbers without padding zeros."""
    return [
        F.col(prefix + f.name).cast("double" if isinstance(f.dataType, DecimalType) else f.dataType)
        .alias(f.name)
        for f in fields
    ]


def brief_context(
    tables: Tables,
    caller: Caller,
    as_of: date,
    merchant_ids: DataFrame | None = None,
    visits_per_part: int = VISITS_PER_PART,
) -> DataFrame:
    """(merchant_id, part, context): documents of the merchants in scope.

    A merchant's visits stand newest first, those without a date before them. Part 0 holds the first ``visits_per_part``,
    which is the whole document of all but the most visited merchants; further visits
    follow in parts 1, 2 …, each with the same profile. So no row, and no task, has to
    hold an unbounded history.
    """
    details = merchant_details(tables, caller, as_of, merchant_ids)
    profile_columns = [field for field in details.schema if field.name != "signals"]
    profiles = details.select(
        "merchant_id",
        F.struct(
            F.struct(*_json_values(profile_columns)).alias("merchant_profile"),
            F.struct(*_json_values(details.schema["signals"].dataType, "signals."))
            .alias("signals"),
        ).alias("merchant_profile_and_scores"),
    )
    newest_first = F.coalesce(F.lit(LAST_DAY) - F.unix_date("visit_date"), F.lit(0))
    key = pack(newest_first, id_number(F.col("id"), "vh"))
    visits = scoped_visits(tables, caller, merchant_ids)
    # Numbered as they are stored; the names of visitors come after that.
    numbered = with_position(visits, key, ["merchant_id"])
    placed = with_visitors(tables, numbered).select(
        "merchant_id",
        F.floor((F.col("position") - 1) / visits_per_part).cast("int").alias("part"),
        F.struct("position", "visit_date", "visit_notes", "outcome", "duration_mins",
                 "visited_by").alias("visit"),
    )
    # A null visit per merchant gives each a part 0, and so allows an inner join, in which
    # Spark can split the parts of a much-visited merchant.
    first_parts = merchants_in_scope(tables, caller, merchant_ids).select(
        "merchant_id", F.lit(0).alias("part"),
        F.lit(None).cast(placed.schema["visit"].dataType).alias("visit"))
    parts = placed.unionByName(first_parts).groupBy("merchant_id", "part").agg(
        F.array_sort(F.collect_list("visit")).alias("visits"))
    history = F.transform("visits", lambda v: v.dropFields("position"))
    document = F.struct("merchant_profile_and_scores", history.alias("recent_visit_history"))
    return split_join(profiles, parts, "merchant_id").select(
        "merchant_id", "part",
        F.to_json(document, {"ignoreNullFields": "false"}).alias("context"),
    )

"""Reads over merchants: priority lists, details, histories, name lookups and search."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbeat.functions.columns import (
    clamp, clean_name, contains_text, day, id_number, null_if_zero,
)
from fieldbeat.functions.joins import split_join
from fieldbeat.functions.ranking import first_rows, top_per_key
from fieldbeat.operators.scope import Caller, active, entitlements, in_scope
from fieldbeat.operators.scoring import SIGNAL_VALUES
from fieldbeat.sources.tables import Tables


def _narrow(df: DataFrame, ids: DataFrame | None, column: str = "merchant_id") -> DataFrame:
    """Rows of the wanted ids only, before anything is sorted or shuffled.

    The join has a shuffle of its own, if any: Spark can split a hot id there, and a window
    that follows cuts each task's rows before it shuffles again.
    """
    return df if ids is None else split_join(df, ids.select(column), column, "left_semi")


def latest_scores(tables: Tables, wanted: DataFrame | None = None) -> DataFrame:
    """Each merchant's most recent score and rank."""
    return _narrow(tables.latest_scores, wanted).select("merchant_id", "priority_score", "rank")


def best_recommendations(recommendations: DataFrame) -> DataFrame:
    """Each merchant's newest and most confident recommendation; nulls rank first."""
    order = [
        F.desc_nulls_first("recommendation_date"), F.desc_nulls_first("confidence_score"),
        id_number(F.col("id"), "r"),
    ]
    return top_per_key(recommendations, ["merchant_id"], order).select(
        "merchant_id", F.col("id").alias("recommendation_id"),
        F.col("recommended_action").alias("recommendation"),
        F.col("status").alias("recommendation_status"),
    )


def _wanted_ids(
    tables: Tables, caller: Caller, merchant_ids: DataFrame | None = None
) -> DataFrame | None:
    """What to narrow other tables by; None if the caller sees, and asks for, everything."""
    if caller.role == "Admin":
        return merchant_ids
    return merchants_in_scope(tables, caller, merchant_ids).select("merchant_id")


def _ranked(merchants: DataFrame, scores: DataFrame) -> DataFrame:
    """Active merchants with their latest score; without any score a merchant drops out."""
    return active(merchants).select(
        F.col("id").alias("merchant_id"), F.col("merchant_name").alias("name"),
        "tier", "region", "area",
    ).join(scores, "merchant_id")


def _priority_order() -> list[Column]:
    return [F.asc_nulls_last("rank"), id_number(F.col("merchant_id"), "m")]


def _with_recommendation(listed: DataFrame, recommendations: DataFrame, *leading: str) -> DataFrame:
    best = best_recommendations(recommendations)
    return split_join(listed, best, "merchant_id", "left").select(
        *leading, "merchant_id", "name", "tier", "region", "area",
        null_if_zero(F.col("priority_score")).alias("score"), "rank",
        "recommendation", "recommendation_status",
    )


def prioritized_merchants(tables: Tables, caller: Caller, limit: int = 20) -> DataFrame:
    """The caller's first ``limit`` merchants by rank, each with its best recommendation."""
    mine = in_scope(tables.merchants, tables.users, caller)
    scores = latest_scores(tables, _wanted_ids(tables, caller))
    listed = first_rows(_ranked(mine, scores), _priority_order(), clamp(limit, 100))
    wanted = _narrow(tables.recommendations, listed)
    return _with_recommendation(listed, wanted).orderBy(*_priority_order())


def prioritized_for_all(tables: Tables, limit: int = 20) -> DataFrame:
    """``prioritized_merchants`` of every user, with ``viewer_id``, in one job."""
    limit = clamp(limit, 100)
    ranked = _ranked(tables.merchants, latest_scores(tables))
    entitled = entitlements(tables.users, active(tables.merchants))
    scoped = top_per_key(
        entitled.join(ranked, "merchant_id"), ["viewer_id"], _priority_order(), limit)
    # All Admins share one list of at most 100 rows.
    page = ranked.orderBy(*_priority_order()).limit(limit).agg(
        F.collect_list(F.struct(*ranked.columns)))
    admins = tables.users.where(F.col("role") == "Admin").select(
        F.col("id").alias("viewer_id"), F.inline(page.scalar()))
    listed = scoped.unionByName(admins)
    return _with_recommendation(listed, tables.recommendations, "viewer_id")


def merchants_in_scope(
    tables: Tables, caller: Caller, merchant_ids: DataFrame | None = None
) -> DataFrame:
    """The caller's merchants, those of ``merchant_ids`` if given, with key ``merchant_id``."""
    mine = in_scope(tables.merchants, tables.users, caller)
    return _narrow(mine.withColumnRenamed("id", "merchant_id"), merchant_ids)


def merchant_details(
    tables: Tables, caller: Caller, as_of: date, merchant_ids: DataFrame | None = None
) -> DataFrame:
    """Profile, latest score, best recommendation and signals of ``as_of`` per merchant.

    ``merchant_ids`` (merchant_id) narrows the result; out of scope means no row. Zero
    coordinates, scores, trends and balances read as null.
    """
    wanted = _wanted_ids(tables, caller, merchant_ids)
    names = tables.users.select(
        F.col("id").alias("assigned_dsp_id"), F.col("full_name").alias("assigned_dsp"))
    signals = tables.merchant_signals.where(F.col("signal_date") == day(as_of)).select(
        "merchant_id", *SIGNAL_VALUES)
    shown = {
        name: null_if_zero(F.col(name)) if name in ("transaction_trend", "wallet_balance")
        else F.col(name)
        for name in SIGNAL_VALUES
    }
    return (
        split_join(merchants_in_scope(tables, caller, merchant_ids), names,
                   "assigned_dsp_id", "left")
        .join(latest_scores(tables, wanted), "merchant_id", "left")
        .join(best_recommendations(_narrow(tables.recommendations, wanted)),
              "merchant_id", "left")
        .join(_narrow(signals, wanted), "merchant_id", "left")
        .select(
            "merchant_id", "merchant_name", "region", "area", "tier", "category",
            "contact_number", "address",
            null_if_zero(F.col("latitude")).alias("latitude"),
            null_if_zero(F.col("longitude")).alias("longitude"),
            "onboarding_date", "is_active", "assigned_dsp",
            null_if_zero(F.col("priority_score")).alias("priority_score"),
            "recommendation", "recommendation_status", "recommendation_id",
            F.struct(*[value.alias(name) for name, value in shown.items()]).alias("signals"),
        )
    )


def merchant_history(
    tables: Tables, caller: Caller, merchant_ids: DataFrame | None = None
) -> DataFrame:
    """All visits of the merchants in scope, newest first within a merchant."""
    visits = with_visitors(tables, scoped_visits(tables, caller, merchant_ids))
    return _shown_visits(visits).orderBy(
        id_number(F.col("merchant_id"), "m"), F.desc("visit_date"),
        id_number(F.col("visit_id"), "vh"),
    )


def scoped_visits(
    tables: Tables, caller: Caller, merchant_ids: DataFrame | None = None
) -> DataFrame:
    """The stored visits to merchants in scope."""
    return _narrow(tables.visit_history, merchants_in_scope(tables, caller, merchant_ids))


def with_visitors(tables: Tables, visits: DataFrame) -> DataFrame:
    """Visits with the visitor's name."""
    visitors = tables.users.select(
        F.col("id").alias("dsp_id"), F.col("full_name").alias("visited_by"))
    return split_join(visits, visitors, "dsp_id")


def _shown_visits(visits: DataFrame) -> DataFrame:
    return visits.select(
        "merchant_id", F.col("id").alias("visit_id"), "visit_date", "visit_notes", "outcome",
        "duration_mins", "visited_by",
    )


def _named(tables: Tables, name: str, caller: Caller) -> DataFrame:
    mine = in_scope(tables.merchants, tables.users, caller)
    return mine.where(contains_text(F.col("merchant_name"), clean_name(name)))


def _first_named(tables: Tables, name: str, caller: Caller) -> DataFrame:
    """Of several matches the one with the lowest number."""
    return _named(tables, name, caller).orderBy(id_number(F.col("id"), "m")).limit(1)


def find_merchant(tables: Tables, name: str, caller: Caller) -> DataFrame:
    return _first_named(tables, name, caller).select(
        "id", "merchant_name", "region", "area", "tier", "category", "contact_number", "address")


def merchant_score(tables: Tables, name: str, caller: Caller, as_of: date) -> DataFrame:
    """Score, rank, breakdown, trend and complaints of ``as_of``; nulls if there are none."""
    found = _first_named(tables, name, caller).select(
        F.col("id").alias("merchant_id"), "merchant_name")
    scores = tables.daily_scores.where(F.col("score_date") == day(as_of)).select(
        "merchant_id", "priority_score", "rank", "score_breakdown")
    signals = tables.merchant_signals.where(F.col("signal_date") == day(as_of)).select(
        "merchant_id", "transaction_trend", "complaint_count")
    return (
        found.join(_narrow(scores, found), "merchant_id", "left")
        .join(_narrow(signals, found), "merchant_id", "left")
        .drop("merchant_id")
    )


def merchant_recommendations(tables: Tables, name: str, caller: Caller, as_of: date) -> DataFrame:
    """Recommendations of ``as_of`` for all matching merchants, unknown confidence first."""
    found = _named(tables, name, caller).select(F.col("id").alias("merchant_id"))
    today = tables.recommendations.where(F.col("recommendation_date") == day(as_of))
    return today.join(found, "merchant_id", "left_semi").orderBy(
        F.desc_nulls_first("confidence_score"), id_number(F.col("id"), "r")
    ).select(
        F.col("recommended_action").alias("action"),
        F.col("action_explanation").alias("explanation"), "status",
        null_if_zero(F.col("confidence_score")).alias("confidence_score"),
    )


def merchant_visits(tables: Tables, name: str, caller: Caller) -> DataFrame:
    """The five latest visits over all matching merchants."""
    found = _named(tables, name, caller).select(F.col("id").alias("merchant_id"))
    visits = with_visitors(tables, _narrow(tables.visit_history, found))
    return _shown_visits(visits).orderBy(
        F.desc("visit_date"), id_number(F.col("visit_id"), "vh")
    ).limit(5).select("visit_date", "visit_notes", "outcome", "visited_by")


def search_merchants(tables: Tables, query: str, caller: Caller, as_of: date) -> DataFrame:
    """The 20 highest scores of ``as_of`` among merchants whose name, region, area or
    category contains ``query`` as given; merchants without a score come last."""
    matches = F.lit(False)
    for column in ("merchant_name", "region", "area", "category"):
        matches = matches | contains_text(F.col(column), query)
    scores = tables.daily_scores.where(F.col("score_date") == day(as_of)).select(
        "merchant_id", "priority_score", "rank")
    return (
        in_scope(tables.merchants, tables.users, caller)
        .where(matches)
        .withColumnRenamed("id", "merchant_id")
        .join(scores, "merchant_id", "left")
        .orderBy(F.desc_nulls_last("priority_score"), id_number(F.col("merchant_id"), "m"))
        .limit(20)
        .select("merchant_name", "region", "area", "tier", "category", "priority_score", "rank")
    )

"""Dashboard counts: merchants, high priorities and recommended visits of a day."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbeat.functions.columns import HIGH_PRIORITY, day
from fieldbeat.operators.scope import Caller, active, team, viewer_owners
from fieldbeat.schema import OPEN_STATUSES
from fieldbeat.sources.tables import Tables

COUNTS = ("total_merchants", "high_priority", "recommended_visits")


def is_high() -> Column:
    return F.col("priority_score") >= HIGH_PRIORITY


def _flagged(tables: Tables, merchants: DataFrame, as_of: date, some: bool = False) -> DataFrame:
    """Active merchants with one flag per count.

    Scores and recommendations shrink to distinct merchant ids first, so the joins do not
    multiply rows and the distinct counts become plain ones. With ``some`` they are narrowed
    to the given merchants even before that.
    """
    high = tables.daily_scores.where((F.col("score_date") == day(as_of)) & is_high())
    visit = tables.recommendations.where(
        (F.col("recommendation_date") == day(as_of)) & F.col("status").isin(*OPEN_STATUSES))

    def flag(df: DataFrame, name: str) -> DataFrame:
        ids = df.select(F.col("merchant_id").alias("id"))
        if some:
            ids = ids.join(merchants.select("id"), "id", "left_semi")
        return ids.distinct().withColumn(name, F.lit(1))

    return (
        active(merchants).select("id", "assigned_dsp_id")
        .join(flag(high, "is_high"), "id", "left")
        .join(flag(visit, "is_visit"), "id", "left")
    )


def _counts() -> list[Column]:
    columns = (F.count("*"), F.count("is_high"), F.count("is_visit"))
    return [column.alias(name) for column, name in zip(columns, COUNTS)]


def dsp_dashboard(tables: Tables, caller: Caller, as_of: date) -> DataFrame:
    caller.require("DSP")
    own = tables.merchants.where(F.col("assigned_dsp_id") == caller.user_id)
    return _flagged(tables, own, as_of, some=True).agg(*_counts())


def manager_dashboard(tables: Tables, caller: Caller, as_of: date) -> DataFrame:
    """Counts over the merchants of the caller's reports and the caller."""
    caller.require("Manager", "Admin")
    members = team(tables.users, caller.user_id).withColumnRenamed("id", "assigned_dsp_id")
    teams = tables.merchants.join(members, "assigned_dsp_id", "left_semi")
    return _flagged(tables, teams, as_of, some=True).agg(*_counts())


def admin_dashboard(tables: Tables, caller: Caller, as_of: date) -> DataFrame:
    caller.require("Admin")
    return _flagged(tables, tables.merchants, as_of).agg(*_counts())


def dashboards_for_all(tables: Tables, role: str, as_of: date) -> DataFrame:
    """The dashboard of every user of a role, DSP or Manager, in one job.

    Merchants are counted per DSP first; a manager's numbers are sums over the team.
    """
    owners = _flagged(tables, tables.merchants, as_of).groupBy(
        F.col("assigned_dsp_id").alias("owner_id")).agg(*_counts())
    return per_viewer(tables.users, owners, role)


def per_viewer(users: DataFrame, owners: DataFrame, role: str) -> DataFrame:
    """Sums of each viewer of a role over the owners (owner_id, counts) of the viewer's merchants."""
    viewers = users.where(F.col("role") == role).select(F.col("id").alias("viewer_id"))
    return (
        viewers.join(viewer_owners(users), "viewer_id")
        .join(owners, "owner_id", "left")
        .groupBy("viewer_id")
        .agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in COUNTS])
    )

"""KPI roll-ups per area and per DSP."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbeat.functions.columns import (
    HIGH_PRIORITY, day, id_number, mean_score, null_if_zero, percent,
)
from fieldbeat.operators.scope import Caller, active, region_of, team
from fieldbeat.sources.tables import Tables

WEEKLY_VISIT_TARGET = 10
UNKNOWN_AREA = "Unknown"


def per_merchant(tables: Tables, as_of: date) -> DataFrame:
    """One row per active merchant with the day's score and recommendation counts.

    In the KPI views a merchant counts once per recommendation of the day, so its score
    weighs as often. ``weight`` keeps that without multiplying rows.
    """
    status = F.col("status")
    actions = (
        tables.recommendations.where(F.col("recommendation_date") == day(as_of))
        .groupBy(F.col("merchant_id").alias("id"))
        .agg(
            F.count("id").alias("actions"),
            F.count_if(status == "Done").alias("done"),
            F.count_if(status == "New").alias("new"),
            F.count_if(status == "In Progress").alias("in_progress"),
        )
    )
    scores = tables.daily_scores.where(F.col("score_date") == day(as_of)).select(
        F.col("merchant_id").alias("id"), "priority_score")
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("actions", "done", "new", "in_progress")}
    return (
        active(tables.merchants).select("id", "region", "area", "assigned_dsp_id")
        .join(scores, "id", "left")
        .join(actions, "id", "left")
        .withColumns(counts)
        .withColumn("weight", F.greatest("actions", F.lit(1)))
    )


def kpi_sums() -> list[Column]:
    scored = F.when(F.col("priority_score").isNotNull(), F.col("weight"))
    sums = [F.sum(c).alias(c) for c in ("actions", "done", "new", "in_progress")]
    return [
        F.count("*").alias("merchants"),
        F.sum(F.col("priority_score") * F.col("weight")).alias("score_sum"),
        F.sum(scored).alias("score_n"),
        *sums,
    ]


def area_summary(tables: Tables, as_of: date) -> DataFrame:
    """KPIs per (region, area) of active merchants.

    Grouped per DSP first, so the distinct DSPs of an area are its rows of that step.
    """
    return area_kpis(per_merchant(tables, as_of).groupBy("region", "area", "assigned_dsp_id").agg(
        *kpi_sums()))


def area_kpis(per_dsp: DataFrame) -> DataFrame:
    """KPIs per (region, area) from sums per (region, area, DSP)."""
    parts = ("merchants", "score_sum", "score_n", "actions", "done", "new", "in_progress")
    return per_dsp.groupBy("region", "area").agg(
        F.count("assigned_dsp_id").alias("total_dsps"), *[F.sum(c).alias(c) for c in parts]
    ).select(
        "region", "area",
        F.col("merchants").alias("total_merchants"),
        "total_dsps",
        mean_score(F.col("score_sum"), F.col("score_n")).alias("avg_priority_score"),
        F.col("done").alias("actions_completed"),
        F.col("new").alias("actions_pending"),
        F.col("in_progress").alias("actions_in_progress"),
        percent(F.col("done"), F.col("actions")).alias("completion_rate"),
    )


def dsp_performance(tables: Tables, as_of: date) -> DataFrame:
    """KPIs per active DSP with at least one active merchant."""
    return dsp_kpis(
        tables.users, per_merchant(tables, as_of).groupBy("assigned_dsp_id").agg(*kpi_sums()))


def dsp_kpis(users: DataFrame, portfolios: DataFrame) -> DataFrame:
    """KPIs per active DSP from sums per DSP."""
    reps = users.where((F.col("role") == "DSP") & F.col("is_active")).select(
        F.col("id").alias("assigned_dsp_id"), F.col("full_name").alias("dsp_name"),
        "region", "area")
    return reps.join(portfolios, "assigned_dsp_id").select(
        F.col("assigned_dsp_id").alias("dsp_id"), "dsp_name", "region", "area",
        F.col("merchants").alias("merchant_count"),
        mean_score(F.col("score_sum"), F.col("score_n")).alias("avg_portfolio_score"),
        F.col("done").alias("actions_completed"),
        (F.col("new") + F.col("in_progress")).alias("actions_open"),
        percent(F.col("done"), F.col("actions")).alias("completion_rate"),
    )


def register_views(tables: Tables, as_of: date) -> None:
    """The two KPI views for use from SQL."""
    area_summary(tables, as_of).createOrReplaceTempView("v_area_summary")
    dsp_performance(tables, as_of).createOrReplaceTempView("v_dsp_performance")


def _visible_areas(tables: Tables, caller: Caller, as_of: date) -> DataFrame:
    caller.require("Manager", "Admin")
    areas = area_summary(tables, as_of)
    if caller.role == "Admin":
        return areas
    return areas.where(F.col("region") == region_of(tables.users, caller))


def area_summary_for(tables: Tables, caller: Caller, as_of: date) -> DataFrame:
    """The areas of a Manager's region, or all; a zero average reads as null, no rate as 0."""
    return _visible_areas(tables, caller, as_of).withColumns({
        "avg_priority_score": null_if_zero(F.col("avg_priority_score")),
        "completion_rate": F.coalesce("completion_rate", F.lit(0).cast("decimal(10,1)")),
    }).orderBy(F.asc_nulls_last("region"), F.asc_nulls_last("area"))


def area_totals(tables: Tables, caller: Caller, as_of: date) -> DataFrame:
    """One row over the visible areas.

    Its completion rate leaves deferred actions out of the base, unlike the areas' own
    rates. High priorities are those of the newest score date, inactive merchants included.
    The rate rounds half up.
    """
    scores = tables.daily_scores
    newest = tables.latest_scores.agg(F.max("score_date")).scalar()
    high = scores.where(
        (F.col("score_date") == newest) & (F.col("priority_score") >= HIGH_PRIORITY))
    if caller.role != "Admin":
        local = tables.merchants.where(F.col("region") == region_of(tables.users, caller))
        high = high.join(
            local.select(F.col("id").alias("merchant_id")), "merchant_id", "left_semi")

    def total(column: str) -> Column:
        return F.coalesce(F.sum(column), F.lit(0)).alias(column)

    done = F.col("actions_completed")
    actions = done + F.col("actions_pending") + F.col("actions_in_progress")
    return _visible_areas(tables, caller, as_of).agg(
        *[total(c) for c in ("total_merchants", "actions_completed", "actions_pending",
                             "actions_in_progress")]
    ).select(
        F.coalesce(percent(done, actions), F.lit(0).cast("decimal(10,1)"))
        .alias("completion_rate"),
        "total_merchants",
        high.agg(F.count("*")).scalar().alias("high_priority"),
    )


def visits_by_area(tables: Tables, caller: Caller, as_of: date) -> DataFrame:
    """Visits of the last seven days (and later) per area, with the weekly target.

    Visits are counted per merchant before the join, so a much-visited merchant is one row.
    """
    caller.require("Manager", "Admin")
    merchants = tables.merchants
    if caller.role == "Manager":
        merchants = merchants.where(F.col("region") == region_of(tables.users, caller))
    counted = (
        tables.visit_history.where(F.col("visit_date") >= F.date_sub(day(as_of), 7))
        .groupBy(F.col("merchant_id").alias("id")).agg(F.count("*").alias("n"))
    )
    return (
        counted.join(merchants.select("id", "area"), "id")
        .groupBy("area").agg(F.sum("n").alias("visits"))
        .orderBy(F.asc_nulls_last("area"))
        .select(
            F.coalesce(F.nullif("area", F.lit("")), F.lit(UNKNOWN_AREA)).alias("area"),
            "visits", F.lit(WEEKLY_VISIT_TARGET).alias("target"),
        )
    )


def team_performance(tables: Tables, caller: Caller, as_of: date) -> DataFrame:
    """DSP KPIs, best completion rate first: a Manager's direct reports, or all DSPs.

    The one-decimal average rounds half up; the rate is text such as ``62.5%``.
    """
    caller.require("Manager", "Admin")
    reps = dsp_performance(tables, as_of)
    if caller.role == "Manager":
        reports = team(tables.users, caller.user_id, with_self=False)
        reps = reps.join(reports.withColumnRenamed("id", "dsp_id"), "dsp_id", "left_semi")
    rate = F.col("completion_rate")
    return reps.orderBy(F.desc_nulls_last("completion_rate"), id_number(F.col("dsp_id"), "u")).select(
        F.col("dsp_name").alias("name"), "region", "area",
        F.col("merchant_count").alias("merchants"),
        F.round(null_if_zero(F.col("avg_portfolio_score")), 1).alias("avg_score"),
        F.col("actions_completed").alias("completed"),
        F.col("actions_open").alias("open"),
        F.when(rate != 0, F.concat(rate.cast("string"), F.lit("%"))).otherwise("0%")
        .alias("completion_rate"),
    )

"""Daily priority score and rank, and the roll-forward of signals to a new day."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbeat.functions.columns import day, id_number, pack
from fieldbeat.functions.ranking import with_position
from fieldbeat.schema import BREAKDOWN_TYPE, SCORE_TYPE

# The 20 % tier part of the score, in points.
TIER_POINTS = {"Gold": 20, "Silver": 14, "Bronze": 8, "New": 4}
OTHER_TIER_POINTS = 4

# A merchant without any signal starts from these.
FIRST_SIGNAL = {
    "transaction_volume": 10,
    "transaction_trend": 0,
    "days_since_visit": 0,
    "complaint_count": 0,
    "campaign_status": "None",
    "wallet_balance": 100,
    "active_products": 1,
}

SIGNAL_VALUES = tuple(FIRST_SIGNAL)


def tier_points(tier: Column) -> Column:
    points = F.when(tier.isNull(), OTHER_TIER_POINTS)
    for name, value in TIER_POINTS.items():
        points = points.when(tier == name, value)
    return points.otherwise(OTHER_TIER_POINTS)


def score_parts() -> dict[str, Column]:
    """Points by component, in exact decimals.

    The weights 40/30/20/10 over trend (100 at most), days/30, tier and complaints/5
    reduce to integers but for ``0.4 * |trend|``, whose third decimal is even: no tie
    occurs in rounding, so half-up decimals equal rounded floats.
    """
    trend = F.least(F.abs(F.coalesce("transaction_trend", F.lit(0))), F.lit(100))
    days = F.least(F.coalesce("days_since_visit", F.lit(0)), F.lit(30))
    complaints = F.least(F.coalesce("complaint_count", F.lit(0)), F.lit(5))
    return {
        "transaction": trend.cast("decimal(5,2)") * F.lit("0.4").cast("decimal(2,1)"),
        "recency": days.cast("decimal(10,0)"),
        "tier": tier_points(F.col("tier")).cast("decimal(3,0)"),
        "complaints": (complaints * 2).cast("decimal(10,0)"),
    }


def rank_key(score: Column, merchant_id: Column) -> Column:
    """Ascending key: higher scores first, equal ones by merchant number."""
    return pack(F.lit(99999) - (score * 100).cast("bigint"), id_number(merchant_id, "m"))


def score_merchants(signals: DataFrame, merchants: DataFrame, on: date | None = None) -> DataFrame:
    """Score and rank of each merchant with a signal, per day; of one day if ``on`` is given.

    Ranks run 1..n within a day. One day may hold all rows, so they are counted block by
    block (``with_position``) and not in one window per day.
    """
    if on is not None:
        signals = signals.where(F.col("signal_date") == day(on))
    parts = score_parts()
    total = sum(parts.values(), F.lit(0))
    scored = signals.join(
        merchants.select(F.col("id").alias("merchant_id"), "tier"), "merchant_id"
    ).select(
        "merchant_id",
        F.col("signal_date").alias("score_date"),
        F.round(total, 2).cast(SCORE_TYPE).alias("priority_score"),
        F.struct(*[F.round(part, 1).alias(name) for name, part in parts.items()])
        .cast(BREAKDOWN_TYPE).alias("score_breakdown"),
    )
    key = rank_key(F.col("priority_score"), F.col("merchant_id"))
    return with_position(scored, key, ["score_date"], "rank").select(
        "merchant_id", "score_date", "priority_score",
        F.col("rank").cast("int").alias("rank"), "score_breakdown",
    )


def roll_forward_signals(
    latest_signals: DataFrame, merchants: DataFrame, deltas: DataFrame, as_of: date
) -> DataFrame:
    """The ``as_of`` signal of each merchant, from its latest signal and its change.

    ``latest_signals`` has one row a merchant at most, as ``Tables.latest_signals``.
    ``deltas`` (merchant_id, volume_pct, trend_delta, complaint_step, wallet_delta) has at
    most one row per merchant; a missing row or value means no change. The latest signal
    may be the one of ``as_of`` itself, so a second run on one day rolls forward again.
    Merchants without any signal start from ``FIRST_SIGNAL``. Volumes are products of
    decimals, cut to whole numbers: 100 plus 15 % is 115, where floats would give 114.
    """
    latest = latest_signals.select(
        "merchant_id", F.struct(*SIGNAL_VALUES).alias("last"))
    rolled = (
        merchants.select(F.col("id").alias("merchant_id"))
        .join(latest, "merchant_id", "left")
        .join(deltas, "merchant_id", "left")
    )
    first = F.struct(*[F.lit(v).alias(name) for name, v in FIRST_SIGNAL.items()]).cast(
        latest.schema["last"].dataType)
    last = F.coalesce("last", first)

    def change(name: str) -> Column:
        return F.coalesce(name, F.lit(0))

    factor = (1 + change("volume_pct")).cast("decimal(8,4)")
    volume = last["transaction_volume"].cast("decimal(10,0)") * factor
    complaints = last["complaint_count"]
    step = change("complaint_step")
    wallet = F.round(last["wallet_balance"] + change("wallet_delta"), 2)
    return rolled.select(
        "merchant_id",
        day(as_of).alias("signal_date"),
        F.when(volume.isNotNull(), F.greatest(volume.cast("int"), F.lit(0)))
        .alias("transaction_volume"),
        F.round(last["transaction_trend"] + change("trend_delta"), 2).cast("decimal(5,2)")
        .alias("transaction_trend"),
        (F.coalesce(last["days_since_visit"], F.lit(0)) + 1).alias("days_since_visit"),
        F.when(step > 0, F.coalesce(complaints, F.lit(0)) + 1)
        .when((step < 0) & (complaints > 0), complaints - 1)
        .otherwise(complaints).alias("complaint_count"),
        last["campaign_status"].alias("campaign_status"),
        F.when(wallet.isNotNull(), F.greatest(wallet, F.lit(0))).cast("decimal(12,2)")
        .alias("wallet_balance"),
        last["active_products"].alias("active_products"),
    )

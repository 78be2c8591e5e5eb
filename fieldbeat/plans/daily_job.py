"""The daily job: roll signals forward, score and rank, store both days' partitions."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldbeat.functions.columns import day, id_number, instant
from fieldbeat.functions.merge import assign_ids, upsert
from fieldbeat.operators.changes import Keep
from fieldbeat.operators.scope import active
from fieldbeat.operators.scoring import roll_forward_signals, score_merchants
from fieldbeat.schema import ID_PREFIX
from fieldbeat.sources.store import NewRows, Store
from fieldbeat.sources.tables import Tables

# A second signal on one day keeps the stored campaign status and products.
UPDATED_SIGNAL_COLUMNS = (
    "transaction_volume", "transaction_trend", "days_since_visit", "complaint_count",
    "wallet_balance",
)
UPDATED_SCORE_COLUMNS = ("priority_score", "rank", "score_breakdown")


def next_signals(tables: Tables, deltas: DataFrame, as_of: date, now: datetime | None = None) -> DataFrame:
    """The signals of ``as_of`` after the roll-forward, ready to replace that date."""
    signals = tables.merchant_signals
    rolled = roll_forward_signals(tables.latest_signals, active(tables.merchants), deltas, as_of)
    stored = signals.where(F.col("signal_date") == day(as_of))
    merged = upsert(
        stored,
        rolled.withColumns({
            "id": F.lit(None).cast("string"),
            "created_at": F.lit(None).cast("timestamp_ntz") if now is None else instant(now),
        }).select(*signals.columns),
        ["merchant_id", "signal_date"], UPDATED_SIGNAL_COLUMNS)
    return merged


def _with_ids(df: DataFrame, tables: Tables, name: str) -> DataFrame:
    """Rows without an id get one behind the stored ones, in order of their merchants."""
    merchant = id_number(F.col("merchant_id"), "m")
    new = df.where(F.col("id").isNull()).drop("id")
    numbered = assign_ids(new, ID_PREFIX[name], merchant, tables.last_number(name))
    return df.where(F.col("id").isNotNull()).unionByName(numbered)


def _newest(before: DataFrame, rows: DataFrame, as_of: date, column: str) -> DataFrame:
    """The newest rows after those of ``as_of``, unless a merchant has a later one."""
    later = before.where(F.col(column) > day(as_of)).select("merchant_id")
    moved = rows.join(later, "merchant_id", "left_anti")
    return moved.unionByName(before.join(moved.select("merchant_id"), "merchant_id", "left_anti"))


def run_daily(
    store: Store, deltas: DataFrame, as_of: date, now: datetime, batch: str | None = None
) -> bool:
    """Rewrites the ``as_of`` partitions of signals and scores, and the tables of newest rows.

    All of it is computed before the first one is replaced, so the job never overwrites what it
    still reads, and a lost executor costs no more than its tasks. A second run on one day
    rolls the signals forward once more, but not with the ``batch`` name of the first.
    """

    def build(tables: Tables, keep: Keep) -> NewRows:
        merged = keep(next_signals(tables, deltas, as_of, now))
        signals = keep(_with_ids(merged, tables, "merchant_signals"))
        stored = tables.daily_scores
        scored = score_merchants(merged, active(tables.merchants), as_of).withColumns({
            "id": F.lit(None).cast("string"), "created_at": instant(now),
        }).select(*stored.columns)
        merged_scores = keep(upsert(
            stored.where(F.col("score_date") == day(as_of)), scored,
            ["merchant_id", "score_date"], UPDATED_SCORE_COLUMNS))
        scores = keep(_with_ids(merged_scores, tables, "daily_scores"))
        return NewRows(
            whole={
                "latest_signals": _newest(tables.latest_signals, signals, as_of, "signal_date"),
                "latest_scores": _newest(tables.latest_scores, scores, as_of, "score_date"),
            },
            dates={
                "merchant_signals": (signals, signals.select("signal_date")),
                "daily_scores": (scores, scores.select("score_date")),
            })

    return store.change(build, batch)

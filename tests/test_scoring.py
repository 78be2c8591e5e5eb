"""Score, rank and roll-forward."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest

from fieldbeat.operators.scoring import roll_forward_signals, score_merchants
from fieldbeat.plans.daily_job import UPDATED_SIGNAL_COLUMNS, next_signals
from fieldbeat.schema import SCHEMAS

DAY = date(2024, 1, 30)
BEFORE = date(2024, 1, 29)
DELTAS = ("merchant_id string, volume_pct decimal(6,4), trend_delta decimal(5,2), "
          "complaint_step int, wallet_delta decimal(12,2)")


def merchant(number, tier="Gold", **values):
    return {"id": f"m{number:02d}", "merchant_name": f"M{number}", "tier": tier,
            "region": "R", "assigned_dsp_id": "u01", "is_active": True, **values}


def signal(number, day=DAY, trend=None, days=None, complaints=None, **values):
    return {"id": f"ms{number}", "merchant_id": f"m{number:02d}", "signal_date": day,
            "transaction_trend": None if trend is None else Decimal(trend),
            "days_since_visit": days, "complaint_count": complaints, **values}


# (tier, trend, days, complaints) -> score and parts
CASES = [
    ("Gold", "0", 0, 0, "20.00", ("0.0", "0.0", "20.0", "0.0")),
    ("Silver", "-12.34", 15, 1, "35.94", ("4.9", "15.0", "14.0", "2.0")),
    ("Bronze", "100", 30, 5, "88.00", ("40.0", "30.0", "8.0", "10.0")),
    ("New", "250.55", 45, 9, "84.00", ("40.0", "30.0", "4.0", "10.0")),   # all capped
    ("Other", None, None, None, "4.00", ("0.0", "0.0", "4.0", "0.0")),
    (None, "0.01", 1, 0, "5.00", ("0.0", "1.0", "4.0", "0.0")),
    ("Gold", "-99.99", 29, 4, "97.00", ("40.0", "29.0", "20.0", "8.0")),
]


def test_scores(make_tables):
    tables = make_tables(
        merchants=[merchant(i, tier) for i, (tier, *_) in enumerate(CASES, 1)],
        merchant_signals=[signal(i, trend=t, days=d, complaints=c)
                          for i, (_, t, d, c, *_) in enumerate(CASES, 1)])
    rows = score_merchants(tables.merchant_signals, tables.merchants).collect()
    got = {r.merchant_id: (str(r.priority_score), tuple(map(str, r.score_breakdown))) for r in rows}
    assert got == {f"m{i:02d}": (score, parts) for i, (*_, score, parts) in enumerate(CASES, 1)}


@pytest.mark.parametrize("tier, points", [("Gold", 20), ("Silver", 14), ("Bronze", 8), ("New", 4)])
def test_decimal_score_equals_the_float_formula(spark, make_df, tier, points):
    trends = [Decimal(n) / 100 for n in range(0, 11000, 37)]
    inputs = [(t, d, c) for t in trends for d in (0, 7, 29, 31) for c in (0, 2, 6)]
    signals = make_df(SCHEMAS["merchant_signals"], [
        signal(n, trend=t, days=d, complaints=c) for n, (t, d, c) in enumerate(inputs, 1)])
    ids = signals.selectExpr("merchant_id AS id", f"'{tier}' AS tier")
    got = {r.merchant_id: float(r.priority_score) for r in score_merchants(signals, ids).collect()}
    for n, (t, d, c) in enumerate(inputs, 1):
        want = round(0.40 * min(abs(float(t)), 100) + 0.30 * min(d / 30 * 100, 100)
                     + 0.20 * points * 5 + 0.10 * min(c / 5 * 100, 100), 2)
        assert got[f"m{n:02d}"] == want, (t, d, c)


def test_ranks_run_from_one_and_ties_go_by_number(make_tables, rows_of):
    tables = make_tables(
        merchants=[merchant(i, "New") for i in (2, 3, 10, 100)],
        merchant_signals=[signal(100, trend="5"), signal(10, trend="5"), signal(3, trend="9"),
                          signal(2, trend="5"), signal(2, BEFORE, trend="1")])
    ranks = rows_of(score_merchants(tables.merchant_signals, tables.merchants),
                    "score_date", "rank", "merchant_id")
    assert sorted(ranks) == [(BEFORE, 1, "m02"), (DAY, 1, "m03"), (DAY, 2, "m02"),
                             (DAY, 3, "m10"), (DAY, 4, "m100")]


def test_merchants_without_a_signal_on_the_day_get_no_score(make_tables, rows_of):
    tables = make_tables(merchants=[merchant(1), merchant(2)],
                         merchant_signals=[signal(1), signal(2, BEFORE)])
    scores = score_merchants(tables.merchant_signals, tables.merchants, DAY)
    assert rows_of(scores, "merchant_id") == [("m01",)]


def roll(make_tables, make_df, signals, deltas, merchants=None):
    tables = make_tables(merchants=merchants or [merchant(1)], merchant_signals=signals)
    return roll_forward_signals(
        tables.latest_signals, tables.merchants, make_df(DELTAS, deltas), DAY).collect()


FULL = dict(transaction_volume=100, campaign_status="Active", wallet_balance=Decimal("300.00"),
            active_products=4)


def test_roll_forward(make_tables, make_df):
    [row] = roll(make_tables, make_df,
                 [signal(1, BEFORE, "1.50", 3, 2, **FULL), signal(1, date(2024, 1, 20), "9", 9, 9)],
                 [{"merchant_id": "m01", "volume_pct": Decimal("0.1500"),
                   "trend_delta": Decimal("-2.25"), "complaint_step": 1,
                   "wallet_delta": Decimal("-500")}])
    assert row.asDict() == {
        "merchant_id": "m01", "signal_date": DAY, "transaction_volume": 115,
        "transaction_trend": Decimal("-0.75"), "days_since_visit": 4, "complaint_count": 3,
        "campaign_status": "Active", "wallet_balance": Decimal("0.00"), "active_products": 4,
    }


@pytest.mark.parametrize("volume, pct, want", [
    (10, "-0.1500", 8), (3, "0.1499", 3), (0, "0.5", 0), (5, "-2.0", 0), (7, None, 7),
])
def test_volume_is_cut_and_not_negative(make_tables, make_df, volume, pct, want):
    [row] = roll(make_tables, make_df,
                 [signal(1, BEFORE, "1", 1, 0, **(FULL | {"transaction_volume": volume}))],
                 [{"merchant_id": "m01", "volume_pct": pct and Decimal(pct)}])
    assert row.transaction_volume == want


@pytest.mark.parametrize("count, step, want", [
    (0, -1, 0), (2, -1, 1), (2, 0, 2), (2, 1, 3), (None, 1, 1), (None, 0, None), (None, -1, None),
])
def test_complaints(make_tables, make_df, count, step, want):
    [row] = roll(make_tables, make_df, [signal(1, BEFORE, "1", 1, count, **FULL)],
                 [{"merchant_id": "m01", "complaint_step": step}])
    assert row.complaint_count == want


def test_first_signal_and_missing_change(make_tables, make_df):
    rows = roll(make_tables, make_df, [signal(2, BEFORE, "1.00", None, 1, **FULL)], [],
                [merchant(1), merchant(2)])
    first, second = sorted(rows)
    assert (first.transaction_volume, first.days_since_visit, first.campaign_status) == (10, 1, "None")
    assert (second.transaction_volume, second.days_since_visit, second.complaint_count) == (100, 1, 1)


def test_a_second_run_on_one_day_rolls_on(make_tables, make_df):
    tables = make_tables(merchants=[merchant(1)],
                         merchant_signals=[signal(1, BEFORE, "1.00", 3, 0, **FULL)])
    deltas = make_df(DELTAS, [])
    once = next_signals(tables, deltas, DAY)
    both = tables.merchant_signals.unionByName(once)
    [row] = next_signals(tables.replace(merchant_signals=both), deltas, DAY).collect()
    assert row.days_since_visit == 5


def test_a_stored_signal_of_the_day_keeps_campaign_and_products(make_tables, make_df):
    assert not {"campaign_status", "active_products"} & set(UPDATED_SIGNAL_COLUMNS)
    tables = make_tables(merchants=[merchant(1)],
                         merchant_signals=[signal(1, DAY, "1.00", 3, 0, **FULL)])
    [row] = next_signals(tables, make_df(DELTAS, []), DAY).collect()
    assert (row.id, row.campaign_status, row.active_products) == ("ms1", "Active", 4)

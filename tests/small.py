"""A small hand-written model: one Admin, two Managers, three DSPs, six merchants."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

AS_OF = date(2024, 1, 30)
YESTERDAY = date(2024, 1, 29)
NOW = datetime(2024, 1, 30, 12)
EARLIER = datetime(2024, 1, 1)


def user(number, role, manager=None, region="North", **values):
    return {"id": f"u{number:02d}", "email": f"u{number}@example.com", "password_hash": "x",
            "full_name": f"User {number}", "role": role, "region": region, "manager_id": manager,
            "is_active": True, "created_at": EARLIER, "updated_at": EARLIER, **values}


def merchant(number, dsp, name=None, **values):
    return {"id": f"m{number:02d}", "merchant_name": name or f"Shop {number}", "region": "North",
            "area": "A", "tier": "Gold", "category": "Food", "assigned_dsp_id": dsp,
            "is_active": True, "updated_at": EARLIER, **values}


def score(number, value, rank, day=AS_OF):
    return {"id": f"ds{number}{day.day}", "merchant_id": f"m{number:02d}", "score_date": day,
            "priority_score": Decimal(value), "rank": rank}


def rec(number, merchant_number, status="New", confidence="0.50", day=AS_OF, **values):
    return {"id": f"r{number:02d}", "merchant_id": f"m{merchant_number:02d}",
            "recommended_action": f"Act {number}", "status": status, "recommendation_date": day,
            "confidence_score": None if confidence is None else Decimal(confidence), **values}


def visit(number, merchant_number, day, dsp="u04"):
    return {"id": f"vh{number:02d}", "merchant_id": f"m{merchant_number:02d}", "dsp_id": dsp,
            "visit_date": day, "visit_notes": f"Note {number}", "outcome": "Completed",
            "duration_mins": 20}


USERS = [
    user(1, "Admin"), user(2, "Manager"), user(3, "Manager", region="South"),
    user(4, "DSP", "u02"), user(5, "DSP", "u02"), user(6, "DSP", "u03", region="South"),
    user(7, "DSP", "u03", region="South", is_active=False), user(8, "DSP", "u03", region="South"),
]

MERCHANTS = [
    merchant(1, "u04", "Alpha Store"),
    merchant(2, "u04", "Beta_Store", latitude=Decimal("0"), longitude=Decimal("121.5")),
    merchant(3, "u05", "Gamma 100% Store", area=None),
    merchant(4, "u02", "Delta Shop", area=""),
    merchant(5, "u06", "Epsilon Store", region="South", area="B", category="Alpha goods"),
    merchant(6, "u06", "Zeta Store", region="South", area="B", is_active=False),
]

SCORES = [
    score(1, "80.00", 1), score(2, "0.00", 5), score(3, "70.00", 2), score(5, "69.99", 3),
    score(6, "90.00", 1, YESTERDAY), score(4, "75.00", None, YESTERDAY), score(1, "10.00", 9, YESTERDAY),
]

RECS = [
    rec(1, 1, "Done", "0.90"), rec(2, 1, "New", None), rec(3, 1, "Deferred", "0.10"),
    rec(4, 2, "In Progress", "0.00"), rec(5, 2, "Done", "0.99", YESTERDAY),
    rec(6, 3, "New", "0.40"), rec(7, 3, "New", "0.40"), rec(8, 5, "Done", "0.20", None),
]

VISITS = [
    visit(1, 1, date(2024, 1, 23)), visit(2, 1, date(2024, 1, 22)), visit(3, 3, AS_OF, "u05"),
    visit(4, 4, date(2024, 1, 31), "u02"), visit(5, 5, AS_OF, "u06"), visit(6, 1, AS_OF),
    visit(7, 1, date(2024, 1, 1)), visit(8, 2, AS_OF), visit(9, 1, AS_OF),
]

MODEL = dict(users=USERS, merchants=MERCHANTS, daily_scores=SCORES, recommendations=RECS,
             visit_history=VISITS)

"""Scoped reads over merchants, users, audit rows and chats on the small model."""

from __future__ import annotations

import json
from datetime import datetime
from decimal import Decimal

import pytest

from pyspark.sql import functions as F

from fieldbeat.operators import admin, chat, context, merchants, scope
from fieldbeat.operators.scope import Caller
from tests.small import AS_OF, MERCHANTS, MODEL, USERS, YESTERDAY, merchant, user

ADMIN, MANAGER, DSP = Caller("u01", "Admin"), Caller("u02", "Manager"), Caller("u04", "DSP")


@pytest.fixture(scope="module")
def tables(make_tables):
    signals = [{"id": "ms01", "merchant_id": "m01", "signal_date": AS_OF, "transaction_volume": 5,
                "transaction_trend": Decimal("0.00"), "wallet_balance": Decimal("0.00"),
                "days_since_visit": 0, "complaint_count": 2},
               {"id": "ms02", "merchant_id": "m02", "signal_date": YESTERDAY}]
    return make_tables(**MODEL, merchant_signals=signals)


# Scope


@pytest.mark.parametrize("role", ["", None, "admin", "Owner"])
def test_unknown_roles_are_refused(role):
    with pytest.raises(PermissionError):
        Caller("u01", role)


def test_roles_are_trimmed():
    assert Caller("u01", " Admin ").role == "Admin"


@pytest.mark.parametrize("caller, want", [
    (ADMIN, {"m01", "m02", "m03", "m04", "m05", "m06"}),
    (MANAGER, {"m01", "m02", "m03", "m04"}),     # the reports' and the own one
    (Caller("u03", "Manager"), {"m05", "m06"}),
    (DSP, {"m01", "m02"}),
    (Caller("u08", "DSP"), set()),
])
def test_scope(tables, rows_of, caller, want):
    mine = scope.in_scope(tables.merchants, tables.users, caller)
    assert {i for (i,) in rows_of(mine, "id")} == want


def test_entitlements_equal_the_scopes(tables, rows_of):
    got = set(rows_of(scope.entitlements(tables.users, tables.merchants), "viewer_id", "merchant_id"))
    want = set()
    for u in USERS:
        if u["role"] != "Admin":
            mine = scope.in_scope(tables.merchants, tables.users, Caller(u["id"], u["role"]))
            want |= {(u["id"], m) for (m,) in rows_of(mine, "id")}
    assert got == want


# Merchants


def test_priority_list(tables, rows_of):
    rows = rows_of(merchants.prioritized_merchants(tables, ADMIN),
                   "merchant_id", "score", "rank", "recommendation", "recommendation_status")
    assert rows == [
        ("m01", Decimal("80.00"), 1, "Act 2", "New"),       # unknown confidence first
        ("m03", Decimal("70.00"), 2, "Act 6", "New"),       # tie: lower number
        ("m05", Decimal("69.99"), 3, "Act 8", "Done"),      # unknown date counts as newest
        ("m02", None, 5, "Act 4", "In Progress"),           # zero score reads as null
        ("m04", Decimal("75.00"), None, None, None),        # latest score is of yesterday
    ]


def test_priority_list_limit(tables):
    assert merchants.prioritized_merchants(tables, ADMIN, 0).count() == 1
    assert merchants.prioritized_merchants(tables, ADMIN, 1000).count() == 5


@pytest.mark.parametrize("limit", [2, 20])
def test_priority_lists_for_all_equal_the_single_ones(tables, rows_of, limit):
    columns = ("merchant_id", "name", "tier", "region", "area", "score", "rank",
               "recommendation", "recommendation_status")
    together = rows_of(merchants.prioritized_for_all(tables, limit), "viewer_id", *columns)
    single = [
        (u["id"], *row) for u in USERS for row in
        rows_of(merchants.prioritized_merchants(tables, Caller(u["id"], u["role"]), limit), *columns)
    ]
    assert sorted(together, key=str) == sorted(single, key=str)


def test_details(tables, spark, rows_of):
    wanted = spark.createDataFrame([("m01",), ("m02",), ("m05",)], "merchant_id string")
    rows = {r["merchant_id"]: r for r in
            rows_of(merchants.merchant_details(tables, MANAGER, AS_OF, wanted))}
    assert set(rows) == {"m01", "m02"}                       # m05 is out of scope
    first, second = rows["m01"], rows["m02"]
    assert first["assigned_dsp"] == "User 4" and first["recommendation_id"] == "r02"
    assert first["signals"]["transaction_trend"] is None     # zero reads as null …
    assert first["signals"]["wallet_balance"] is None
    assert first["signals"]["days_since_visit"] == 0         # … but counts keep it
    assert second["latitude"] is None and second["longitude"] == Decimal("121.5")
    assert second["priority_score"] is None
    assert set(second["signals"].values()) == {None}         # only yesterday's signal


def test_history(tables, rows_of):
    rows = rows_of(merchants.merchant_history(tables, DSP), "merchant_id", "visit_id", "visited_by")
    assert [v for m, v, _ in rows if m == "m01"] == ["vh06", "vh09", "vh01", "vh02", "vh07"]
    assert {m for m, _, _ in rows} == {"m01", "m02"}
    assert {n for _, _, n in rows} == {"User 4"}


@pytest.mark.parametrize("name, caller, want", [
    (" 'alpha' ", ADMIN, ["m01"]),
    ("STORE", ADMIN, ["m01"]),                # first by number
    ("store", Caller("u06", "DSP"), ["m05"]),
    ("alpha", Caller("u06", "DSP"), []),      # out of scope
    ("beta\\_", ADMIN, ["m02"]),
    ("a_s", ADMIN, ["m01"]),                  # wildcard meets the space of "Alpha Store"
    ("100%store", ADMIN, ["m03"]),
    ("100\\%", ADMIN, ["m03"]),
])
def test_find_merchant(tables, rows_of, name, caller, want):
    assert [i for (i,) in rows_of(merchants.find_merchant(tables, name, caller), "id")] == want


def test_merchant_score_keeps_zero_and_takes_today_only(tables, rows_of):
    [row] = rows_of(merchants.merchant_score(tables, "Beta", ADMIN, AS_OF))
    assert (row["priority_score"], row["rank"], row["complaint_count"]) == (Decimal("0.00"), 5, None)
    [row] = rows_of(merchants.merchant_score(tables, "Delta", ADMIN, AS_OF))
    assert row["priority_score"] is None


def test_recommendations_of_today(tables, rows_of):
    rows = rows_of(merchants.merchant_recommendations(tables, "store", DSP, AS_OF),
                   "action", "confidence_score")
    assert rows == [("Act 2", None), ("Act 1", Decimal("0.90")), ("Act 3", Decimal("0.10")),
                    ("Act 4", None)]


def test_latest_five_visits_over_all_matches(tables, rows_of):
    rows = rows_of(merchants.merchant_visits(tables, "s", MANAGER), "visit_date", "visit_notes")
    assert [n for _, n in rows] == ["Note 4", "Note 3", "Note 6", "Note 8", "Note 9"]


def test_search(tables, rows_of):
    rows = rows_of(merchants.search_merchants(tables, "alpha", ADMIN, AS_OF),
                   "merchant_name", "priority_score")
    assert rows == [("Alpha Store", Decimal("80.00")), ("Epsilon Store", Decimal("69.99"))]
    every = rows_of(merchants.search_merchants(tables, "o", ADMIN, AS_OF), "merchant_name")
    assert every[-2:] == [("Delta Shop",), ("Zeta Store",)]   # none today: last, by number
    assert rows_of(merchants.search_merchants(tables, "'alpha'", ADMIN, AS_OF)) == []


# Context documents


def test_context_document(tables, rows_of):
    rows = rows_of(context.brief_context(tables, MANAGER, AS_OF))
    docs = {(r["merchant_id"], r["part"]): json.loads(r["context"]) for r in rows}
    assert set(docs) == {("m01", 0), ("m02", 0), ("m03", 0), ("m04", 0)}
    first = docs["m01", 0]
    assert first["merchant_profile_and_scores"]["merchant_profile"]["priority_score"] == 80.0
    assert first["merchant_profile_and_scores"]["signals"]["campaign_status"] is None
    assert [v["visit_notes"] for v in first["recent_visit_history"]] == [
        "Note 6", "Note 9", "Note 1", "Note 2", "Note 7"]
    assert first["recent_visit_history"][0] == {
        "visit_date": "2024-01-30", "visit_notes": "Note 6", "outcome": "Completed",
        "duration_mins": 20, "visited_by": "User 4"}


def test_long_histories_continue_in_further_parts(tables, rows_of):
    whole = rows_of(context.brief_context(tables, ADMIN, AS_OF))
    parts = rows_of(context.brief_context(tables, ADMIN, AS_OF, visits_per_part=2))
    assert [r["part"] for r in parts if r["merchant_id"] == "m06"] == [0]   # no visits at all

    def visits(rows):
        found = {}
        for r in sorted(rows, key=lambda r: (r["merchant_id"], r["part"])):
            history = json.loads(r["context"])["recent_visit_history"]
            found.setdefault(r["merchant_id"], []).extend(history)
        return found

    assert visits(parts) == visits(whole)
    assert sum(r["merchant_id"] == "m01" for r in parts) == 3


# Administration


@pytest.fixture(scope="module")
def logs(make_tables):
    def log(number, action, at, who):
        return {"id": f"al{number:02d}", "user_id": who, "action": action, "resource": "x",
                "created_at": at}

    return make_tables(users=USERS, audit_logs=[
        log(1, "LOGIN", datetime(2024, 1, 1), "u04"), log(2, "VIEW_MERCHANT", datetime(2024, 1, 2), None),
        log(10, "VIEW_DASHBOARD", datetime(2024, 1, 2), "u99"), log(3, "LOGIN", None, "u01")])


def test_audit_trail(logs, rows_of):
    rows = rows_of(admin.audit_trail(logs, ADMIN), "action", "user")
    assert rows == [("LOGIN", "User 1"), ("VIEW_MERCHANT", None), ("VIEW_DASHBOARD", None),
                    ("LOGIN", "User 4")]
    assert rows_of(admin.audit_trail(logs, ADMIN, "view", 1), "action") == [("VIEW_MERCHANT",)]


def test_audit_page_counts_from_zero(logs, rows_of):
    rows = rows_of(admin.audit_page(logs, ADMIN, "login"), "id", "user_name")
    assert sorted(rows) == [("log-0", "User 1"), ("log-1", "User 4")]


@pytest.mark.parametrize("read", [
    admin.audit_trail, admin.audit_page, admin.list_users, admin.list_merchants])
def test_admin_reads_are_for_admins(tables, read):
    with pytest.raises(PermissionError):
        read(tables, MANAGER)


def test_list_users(tables, rows_of):
    rows = rows_of(admin.list_users(tables, ADMIN), "user_id", "manager_name")
    assert rows == [("u01", None), ("u04", "User 2"), ("u05", "User 2"), ("u06", "User 3"),
                    ("u07", "User 3"), ("u08", "User 3"), ("u02", None), ("u03", None)]
    some = admin.list_users(tables, ADMIN, role="DSP", region="South", is_active=False)
    assert rows_of(some, "user_id") == [("u07",)]
    assert admin.list_users(tables, ADMIN, limit=2).count() == 2


def test_list_merchants_takes_inactive_ones_by_name(tables, rows_of):
    rows = rows_of(admin.list_merchants(tables, ADMIN), "merchant_id", "assigned_dsp_name")
    assert rows == [("m01", "User 4"), ("m02", "User 4"), ("m04", "User 2"), ("m05", "User 6"),
                    ("m03", "User 5"), ("m06", "User 6")]


def test_profiles(tables, spark, rows_of):
    ids = spark.createDataFrame([("u07",), ("u04",), ("u99",)], "user_id string")
    assert sorted(rows_of(admin.user_profiles(tables, ids), "user_id")) == [("u04",), ("u07",)]
    emails = spark.createDataFrame([("u7@example.com",), ("u4@example.com",)], "email string")
    active = admin.user_profiles(tables, emails=emails, active_only=True)
    assert rows_of(active, "user_id") == [("u04",)]


# Chat


@pytest.fixture(scope="module")
def chats(make_tables):
    def session(number, who, hour):
        return {"id": f"cs{number:02d}", "user_id": who, "title": f"T{number}",
                "updated_at": datetime(2024, 1, 30, hour)}

    return make_tables(
        users=USERS,
        chat_sessions=[session(1, "u04", 8), session(2, "u04", 9), session(3, "u05", 9),
                       session(4, "u04", 9)],
        chat_messages=[{"session_id": "cs01", "position": p, "role": "user", "content": f"c{p}"}
                       for p in (1, 0, 2)])


@pytest.mark.parametrize("n", [3, 3000])
def test_visits_without_a_date_come_first(spark, tables, rows_of, n):
    """In a merchant's history of any length."""
    more = spark.range(n).select(
        F.concat(F.lit("vh"), (100 + F.col("id")).cast("string")).alias("id"), F.lit("m01").alias("merchant_id"),
        F.lit("u04").alias("dsp_id"), F.when(F.col("id") > 0, F.lit(AS_OF)).alias("visit_date"))
    history = tables.visit_history.unionByName(more, allowMissingColumns=True)
    rows = rows_of(context.brief_context(tables.replace(visit_history=history), ADMIN, AS_OF, visits_per_part=10**6))
    doc = next(json.loads(r["context"]) for r in rows if r["merchant_id"] == "m01")
    assert len(doc["recent_visit_history"]) == n + 5
    assert [v["visit_date"] is None for v in doc["recent_visit_history"]] == [True] + [False] * (n + 4)


def test_chat_history(chats, rows_of):
    rows = rows_of(chat.chat_history(chats, DSP), "session_id", "position", "content")
    assert rows == [("cs02", None, None), ("cs04", None, None), ("cs01", 0, "c0"),
                    ("cs01", 1, "c1"), ("cs01", 2, "c2")]
    assert rows_of(chat.chat_history(chats, DSP, 1), "session_id") == [("cs02",)]


def test_chat_history_for_all(chats, rows_of):
    every = rows_of(chat.chat_history_for_all(chats, 2), "user_id", "session_id", "position")
    assert sorted(every) == [("u04", "cs02", None), ("u04", "cs04", None), ("u05", "cs03", None)]


def test_scope_of_a_manager_reporting_to_another(make_tables, rows_of):
    people = [user(1, "Manager"), user(2, "Manager", "u01"), user(3, "DSP", "u02"),
              user(4, "Manager", "u04")]
    tables = make_tables(users=people, merchants=[merchant(i, f"u{i:02d}") for i in (1, 2, 3, 4)])
    got = rows_of(scope.entitlements(tables.users, tables.merchants), "viewer_id", "merchant_id")
    assert sorted(got) == [("u01", "m01"), ("u01", "m02"), ("u02", "m02"), ("u02", "m03"),
                           ("u03", "m03"), ("u04", "m04")]


def test_model_is_sound(make_tables):
    from fieldbeat.operators.quality import check_constraints

    # The small model has one unknown recommendation date and no other oddity.
    assert check_constraints(make_tables(**MODEL, merchant_signals=[])).count() == 0
    assert len(MERCHANTS) == 6

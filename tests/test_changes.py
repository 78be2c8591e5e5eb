"""Change sets on the small model."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime
from decimal import Decimal

import pytest

from fieldbeat.operators import changes, chat
from tests.small import AS_OF, EARLIER, MODEL, NOW, USERS, merchant, rec, user

STATUS = "seq bigint, rec_id string, status string, user_id string, role string"
CALLER = "seq bigint, caller_id string, caller_role string, "
CREATE = CALLER + ("email string, password string, full_name string, role string, region string, "
                   "area string, manager_id string")
UPDATE = CALLER + ("user_id string, full_name string, email string, region string, area string, "
                   "manager_id string, is_active boolean")
BRIEF = "seq bigint, merchant_id string, text string, user_id string, role string"
TURN = "seq bigint, user_id string, session_id string, message string, answer string"


@pytest.fixture(scope="module")
def tables(make_tables):
    return make_tables(**MODEL, audit_logs=[{"id": "al41", "action": "LOGIN", "user_id": "u05"}])


def by_admin(seq, **values):
    return {"seq": seq, "caller_id": "u01", "caller_role": "Admin", **values}


def codes(rows_of, change_set):
    return dict(rows_of(change_set.rejects, "seq", "code"))


# Recommendations


def status(seq, rec_id, value, user_id="u04", role="DSP"):
    return {"seq": seq, "rec_id": rec_id, "status": value, "user_id": user_id, "role": role}


STATUS_CHANGES = [
    status(1, "r01", "IN_PROGRESS"), status(2, "r01", "Pending"), status(3, "r02", "DONE"),
    status(4, "r02", "Done"), status(5, "r03", "done"), status(6, "r03", "DONE", "u01", "Admin"),
    status(7, "r03", "DONE", "u05"), status(8, "r99", "DONE"), status(9, "r05", "DEFERRED"),
    status(10, "r03", "done", "u01", "Admin"), status(11, "r03", None),
]


def test_status_updates(tables, make_df, rows_of):
    result = changes.apply_status_updates(tables, make_df(STATUS, STATUS_CHANGES), AS_OF, NOW)
    # Bad status before wrong role before unknown or foreign recommendation.
    assert codes(rows_of, result) == {5: 400, 6: 403, 7: 404, 8: 404, 10: 400, 11: 400}
    rows = {r["id"]: r for r in rows_of(result.table)}
    assert len(rows) == 8
    assert (rows["r01"]["status"], rows["r01"]["status_updated_by"]) == ("New", "u04")  # the last one
    assert rows["r02"]["status"] == "Done" and rows["r02"]["status_updated_at"] == NOW
    assert rows["r03"]["status"] == "Deferred" and rows["r03"]["status_updated_at"] is None
    assert rows["r05"]["status"] == "Deferred"
    # Every completed change logs a visit, every accepted one an audit row.
    visits = rows_of(result.visits)
    assert [(v["id"], v["merchant_id"], v["dsp_id"], v["visit_notes"], v["duration_mins"])
            for v in sorted(visits, key=lambda v: v["id"])] == [
        ("vh10", "m01", "u04", "Completed recommendation: Act 2", 15),
        ("vh11", "m01", "u04", "Completed recommendation: Act 2", 15)]
    assert {(v["visit_date"], v["outcome"]) for v in visits} == {(AS_OF, "Recommendation fulfilled")}
    audit = rows_of(result.audit, "id", "user_id", "action", "resource", "details")
    assert sorted(audit) == [
        (f"al{n}", "u04", "UPDATE_ACTION_STATUS", "recommendation", None) for n in range(42, 47)]


def test_visit_notes_take_the_first_200_characters(make_tables, make_df, rows_of):
    tables = make_tables(users=USERS, merchants=[merchant(1, "u04")],
                         recommendations=[rec(1, 1, recommended_action="x" * 250)])
    result = changes.apply_status_updates(tables, make_df(STATUS, [status(1, "r01", "Done")]), AS_OF, NOW)
    assert rows_of(result.visits, "id", "visit_notes") == [
        ("vh01", "Completed recommendation: " + "x" * 200)]


def test_tool_actions_take_stored_names_only(tables, make_df, rows_of):
    result = changes.apply_actions(tables, make_df(STATUS, STATUS_CHANGES), NOW)
    assert set(codes(rows_of, result)) == {1, 2, 3, 5, 6, 7, 8, 9, 10, 11}
    assert dict(rows_of(result.table, "id", "status"))["r02"] == "Done"
    assert result.audit is None and result.visits is None


def test_briefs(tables, make_df, rows_of):
    def brief(seq, merchant_id, text, user_id="u04", role="DSP"):
        return {"seq": seq, "merchant_id": merchant_id, "text": text, "user_id": user_id, "role": role}

    result = changes.replace_briefs(tables, make_df(BRIEF, [
        brief(1, "m01", "first"), brief(2, "m01", "second"), brief(3, "m02", ""),
        brief(4, "m03", "other rep"), brief(5, "m03", "boss", "u02", "Manager"),
        brief(6, "m05", "wrong boss", "u02", "Manager"), brief(7, "m04", "own", "u02", "Manager"),
        brief(8, "m05", "any", "u01", "Admin"), brief(9, "m99", "none", "u01", "Admin"),
        brief(10, "m01", "x", "u04", "Owner"), brief(11, "m02", None),
    ]), AS_OF, NOW)
    assert codes(rows_of, result) == {3: 500, 4: 404, 6: 404, 9: 404, 10: 403, 11: 500}
    rows = {r["id"]: r for r in rows_of(result.table)}
    # m01, m03, m04 and m05 hold their brief only; m02 keeps its recommendations.
    assert {i: (r["merchant_id"], r["recommended_action"]) for i, r in rows.items()} == {
        "r04": ("m02", "Act 4"), "r05": ("m02", "Act 5"), "r10": ("m01", "second"),
        "r11": ("m03", "boss"), "r12": ("m04", "own"), "r13": ("m05", "any")}
    new = rows["r11"]
    assert (new["action_explanation"], new["confidence_score"], new["status"]) == (
        "Live generated AI brief.", Decimal("0.95"), "New")
    assert (new["recommendation_date"], new["status_updated_by"], new["status_updated_at"]) == (
        AS_OF, "u02", NOW)


# Users


def test_create_users(tables, make_df, rows_of):
    def create(seq, email, role="DSP", **values):
        return by_admin(seq, email=email, password="pw", full_name=f"New {seq}", role=role, **values)

    result = changes.create_users(tables, make_df(CREATE, [
        create(5, "a@x", manager_id="u02"), create(6, "a@x"), create(1, "a@x", "Boss"),
        create(2, "u4@example.com"), create(3, "a@x", manager_id="u55"),
        create(7, "a@x", manager_id="u55"), create(8, "b@x", "Admin"),
        create(9, "c@x") | {"caller_role": "Manager"}, create(10, "c@x"),
    ]), NOW)
    # A failed attempt at an address does not take it.
    assert codes(rows_of, result) == {1: 400, 2: 409, 3: 500, 6: 409, 7: 409, 9: 403}
    rows = {r["id"]: r for r in rows_of(result.table)}
    assert {i: rows[i]["full_name"] for i in ("u09", "u10", "u11")} == {
        "u09": "New 5", "u10": "New 8", "u11": "New 10"}
    assert rows["u09"]["password_hash"] == hashlib.sha256(b"pw").hexdigest()
    assert rows["u09"]["is_active"] and rows["u09"]["manager_id"] == "u02"
    assert sorted(rows_of(result.audit, "id", "user_id", "action")) == [
        (f"al{n}", "u01", "CREATE_USER") for n in (42, 43, 44)]


def test_update_users(tables, make_df, rows_of):
    result = changes.update_users(tables, make_df(UPDATE, [
        by_admin(1, user_id="u04", full_name="One", area="X"),
        by_admin(2, user_id="u04", full_name="Two"),
        by_admin(3, user_id="u05"),
        by_admin(4, user_id="u99", full_name="None"),
        by_admin(5, user_id="u05", email="u4@example.com"),
        by_admin(6, user_id="u05", manager_id="u77"),
        by_admin(7, user_id="u05", email="new@x", is_active=False),
        by_admin(8, user_id="u06", email="new@x"),
        by_admin(9, user_id="u05", email="new@x", region="East"),
        by_admin(10, user_id="u04", email="u4@example.com"),     # one's own address
        by_admin(11, user_id="u06", full_name="No") | {"caller_role": "DSP"},
    ]), NOW)
    assert codes(rows_of, result) == {3: 400, 4: 404, 5: 500, 6: 500, 8: 500, 11: 403}
    assert dict(rows_of(result.rejects, "seq", "reason"))[8] == "e-mail taken"
    rows = {r["id"]: r for r in rows_of(result.table)}
    assert (rows["u04"]["full_name"], rows["u04"]["area"], rows["u04"]["updated_at"]) == ("Two", "X", NOW)
    assert (rows["u05"]["email"], rows["u05"]["is_active"], rows["u05"]["region"]) == ("new@x", False, "East")
    assert (rows["u06"]["full_name"], rows["u06"]["updated_at"]) == ("User 6", EARLIER)
    assert result.audit is None
    assert sorted(rows_of(result.results, "seq", "user_id", "full_name", "is_active")) == [
        (1, "u04", "Two", True), (2, "u04", "Two", True), (7, "u05", "User 5", False),
        (9, "u05", "User 5", False), (10, "u04", "Two", True)]


def test_delete_users(tables, make_df, rows_of):
    delete = CALLER + "user_id string"
    result = changes.delete_users(tables, make_df(delete, [
        by_admin(1, user_id="u04"),   # has merchants
        by_admin(2, user_id="u03"),   # has reports
        by_admin(3, user_id="u05"),   # has merchants and audit rows
        by_admin(4, user_id="u08"), by_admin(5, user_id="u08"), by_admin(6, user_id="u99"),
        by_admin(7, user_id="u07") | {"caller_role": "Manager"},
    ]), NOW)
    assert codes(rows_of, result) == {1: 500, 2: 500, 3: 500, 5: 404, 6: 404, 7: 403}
    assert {i for (i,) in rows_of(result.table, "id")} == {f"u0{n}" for n in range(1, 8)}
    assert rows_of(result.results, "user_id", "full_name") == [("u08", "User 8")]
    assert rows_of(result.audit, "action") == [("DEACTIVATE_USER",)]


def test_assign_roles(tables, make_df, rows_of):
    roles = CALLER + "user_id string, role string"
    result = changes.assign_roles(tables, make_df(roles, [
        by_admin(3, user_id="u04", role="Admin"), by_admin(1, user_id="u04", role="Manager"),
        by_admin(2, user_id="u04", role="Chief"), by_admin(4, user_id="u99", role="DSP"),
        by_admin(5, user_id="u05", role="DSP"),
    ]), NOW)
    assert codes(rows_of, result) == {2: 400, 4: 404}
    assert sorted(rows_of(result.results, "seq", "user_id", "old_role", "new_role")) == [
        (1, "u04", "DSP", "Manager"), (3, "u04", "Manager", "Admin"), (5, "u05", "DSP", "DSP")]
    assert dict(rows_of(result.table, "id", "role"))["u04"] == "Admin"
    assert {a for (a,) in rows_of(result.audit, "action")} == {"ROLE_CHANGE"}


# Merchants


def test_assign_merchants(tables, make_df, rows_of):
    assign = CALLER + "merchant_id string, assigned_dsp_id string"
    result = changes.assign_merchants(tables, make_df(assign, [
        by_admin(1, merchant_id="m01", assigned_dsp_id="u05"),
        by_admin(2, merchant_id="m01", assigned_dsp_id="u06"),
        by_admin(3, merchant_id="m02", assigned_dsp_id="u02"),
        by_admin(4, merchant_id="m02", assigned_dsp_id="u99"),
        by_admin(5, merchant_id="m99", assigned_dsp_id="u05"),
        by_admin(6, merchant_id="m99", assigned_dsp_id="u02"),
    ]), NOW)
    assert dict(rows_of(result.rejects, "seq", "reason")) == {
        3: "user is not a DSP", 4: "DSP not found", 5: "merchant not found", 6: "user is not a DSP"}
    rows = {r["id"]: r for r in rows_of(result.table)}
    assert (rows["m01"]["assigned_dsp_id"], rows["m01"]["updated_at"]) == ("u06", NOW)
    assert rows["m02"]["assigned_dsp_id"] == "u04"
    [first, _] = sorted(rows_of(result.audit), key=lambda a: a["id"])
    assert (first["action"], first["resource_id"]) == ("ASSIGN_MERCHANT", "m01")
    assert json.loads(first["details"]) == {"assigned_dsp_id": "u05", "dsp_name": "User 5"}


# Chat


def test_append_chats(make_tables, make_df, rows_of):
    old = datetime(2024, 1, 2)
    tables = make_tables(
        users=USERS,
        chat_sessions=[{"id": "cs01", "user_id": "u04", "title": "T", "updated_at": old},
                       {"id": "cs02", "user_id": "u05", "title": "U", "updated_at": old}],
        chat_messages=[{"session_id": "cs01", "position": 0, "role": "user", "content": "hi"}])

    def turn(seq, user_id, session_id, message):
        return {"seq": seq, "user_id": user_id, "session_id": session_id, "message": message,
                "answer": f"re {message}"}

    result = chat.append_chats(tables, make_df(TURN, [
        turn(4, "u04", "cs01", "second"), turn(2, "u04", "cs01", "first"),
        turn(1, "u04", "cs02", "not mine"), turn(3, "u05", None, "y" * 120),
        turn(5, "u05", "cs99", "unknown"),
    ]), NOW)
    assert sorted(rows_of(result.results, "seq", "session_id", "is_new")) == [
        (1, "cs03", True), (2, "cs01", False), (3, "cs04", True), (4, "cs01", False),
        (5, "cs05", True)]
    sessions = {r["id"]: r for r in rows_of(result.table)}
    assert sessions["cs01"]["updated_at"] == NOW and sessions["cs01"]["title"] == "T"
    assert sessions["cs02"]["updated_at"] == old
    assert sessions["cs04"]["title"] == "y" * 100 and sessions["cs04"]["user_id"] == "u05"
    messages = sorted(rows_of(result.messages, "session_id", "position", "role", "content"))
    assert [m for m in messages if m[0] == "cs01"] == [
        ("cs01", 1, "user", "first"), ("cs01", 2, "assistant", "re first"),
        ("cs01", 3, "user", "second"), ("cs01", 4, "assistant", "re second")]
    assert [m for m in messages if m[0] == "cs03"] == [
        ("cs03", 0, "user", "not mine"), ("cs03", 1, "assistant", "re not mine")]


def test_new_users_are_numbered_behind_the_highest_id(make_tables, make_df, rows_of):
    tables = make_tables(users=[user(9, "Admin"), user(120, "DSP"), user(13, "DSP")])
    result = changes.create_users(tables, make_df(CREATE, [
        by_admin(1, email="n@x", password="p", full_name="N", role="DSP")]), NOW)
    assert rows_of(result.results, "user_id") == [("u121",)]

"""Dashboards and KPI roll-ups on the small model."""

from __future__ import annotations

from decimal import Decimal

import pytest

from fieldbeat.operators import dashboards, manager, quality
from fieldbeat.operators.scope import Caller
from fieldbeat.schema import SCHEMAS
from tests.small import AS_OF, MERCHANTS, MODEL, SCORES, USERS, merchant, rec, score

ADMIN, MANAGER = Caller("u01", "Admin"), Caller("u02", "Manager")
SOUTH, DSP = Caller("u03", "Manager"), Caller("u04", "DSP")


@pytest.fixture(scope="module")
def tables(make_tables):
    return make_tables(**MODEL)


COUNTS = dashboards.COUNTS


def test_dashboards(tables, rows_of):
    assert rows_of(dashboards.dsp_dashboard(tables, DSP, AS_OF), *COUNTS) == [(2, 1, 2)]
    assert rows_of(dashboards.manager_dashboard(tables, MANAGER, AS_OF), *COUNTS) == [(4, 2, 3)]
    assert rows_of(dashboards.admin_dashboard(tables, ADMIN, AS_OF), *COUNTS) == [(5, 2, 3)]
    # An Admin may open the manager page; it has no reports.
    assert rows_of(dashboards.manager_dashboard(tables, ADMIN, AS_OF), *COUNTS) == [(0, 0, 0)]


def test_dashboards_for_all_equal_the_single_ones(tables, rows_of):
    for role, single in (("DSP", dashboards.dsp_dashboard), ("Manager", dashboards.manager_dashboard)):
        got = rows_of(dashboards.dashboards_for_all(tables, role, AS_OF), "viewer_id", *COUNTS)
        want = [(u["id"], *rows_of(single(tables, Caller(u["id"], role), AS_OF), *COUNTS)[0])
                for u in USERS if u["role"] == role]
        assert sorted(got) == sorted(want)


@pytest.mark.parametrize("read, caller", [
    (dashboards.dsp_dashboard, ADMIN), (dashboards.dsp_dashboard, MANAGER),
    (dashboards.manager_dashboard, DSP), (dashboards.admin_dashboard, MANAGER),
    (manager.area_summary_for, DSP), (manager.area_totals, DSP), (manager.visits_by_area, DSP),
    (manager.team_performance, DSP),
])
def test_roles(tables, read, caller):
    with pytest.raises(PermissionError):
        read(tables, caller, AS_OF)


def test_area_summary(tables, rows_of):
    rows = {(r["region"], r["area"]): r for r in rows_of(manager.area_summary(tables, AS_OF))}
    assert set(rows) == {("North", "A"), ("North", None), ("North", ""), ("South", "B")}
    a = rows["North", "A"]
    # m01 has three recommendations today, so its 80 weighs three times against one 0.
    assert a["avg_priority_score"] == Decimal("60.00")
    assert (a["total_merchants"], a["total_dsps"]) == (2, 1)
    assert (a["actions_completed"], a["actions_pending"], a["actions_in_progress"]) == (1, 1, 1)
    assert a["completion_rate"] == Decimal("25.0")           # of four, the deferred included
    empty = rows["North", ""]
    assert empty["avg_priority_score"] is None and empty["completion_rate"] is None
    assert rows["South", "B"]["total_merchants"] == 1        # the inactive one left out


def test_area_summary_for(tables, rows_of):
    rows = rows_of(manager.area_summary_for(tables, ADMIN, AS_OF), "region", "area", "completion_rate")
    assert rows == [("North", "", Decimal("0.0")), ("North", "A", Decimal("25.0")),
                    ("North", None, Decimal("0.0")), ("South", "B", Decimal("0.0"))]
    assert rows_of(manager.area_summary_for(tables, SOUTH, AS_OF), "area") == [("B",)]


def test_zero_average_reads_as_null(make_tables, rows_of):
    tables = make_tables(users=USERS, merchants=[merchant(1, "u04")], daily_scores=[score(1, "0", 1)])
    assert rows_of(manager.area_summary(tables, AS_OF), "avg_priority_score") == [(Decimal("0.00"),)]
    assert rows_of(manager.area_summary_for(tables, ADMIN, AS_OF), "avg_priority_score") == [(None,)]


def test_area_totals(tables, rows_of):
    # One done of one done, three new, one in progress; the deferred one is left out.
    columns = ("completion_rate", "total_merchants", "high_priority")
    assert rows_of(manager.area_totals(tables, ADMIN, AS_OF), *columns) == [(Decimal("20.0"), 5, 2)]
    assert rows_of(manager.area_totals(tables, SOUTH, AS_OF), *columns) == [(Decimal("0.0"), 1, 0)]


def test_high_priority_takes_the_newest_score_date_and_inactive_merchants(make_tables, rows_of):
    older = [s for s in SCORES if s["score_date"] != AS_OF]
    tables = make_tables(users=USERS, merchants=MERCHANTS, daily_scores=older)
    assert rows_of(manager.area_totals(tables, ADMIN, AS_OF), "high_priority") == [(2,)]
    assert rows_of(manager.area_totals(tables, SOUTH, AS_OF), "high_priority") == [(1,)]


def test_areas_sum_up_to_the_totals(tables, rows_of):
    areas = rows_of(manager.area_summary(tables, AS_OF), "total_merchants")
    [(total,)] = rows_of(manager.area_totals(tables, ADMIN, AS_OF), "total_merchants")
    assert sum(n for (n,) in areas) == total


def test_visits_by_area(tables, rows_of):
    # The day seven days back counts, so does a later one; null and empty areas stay apart.
    rows = rows_of(manager.visits_by_area(tables, ADMIN, AS_OF), "area", "visits", "target")
    assert rows == [("Unknown", 1, 10), ("A", 4, 10), ("B", 1, 10), ("Unknown", 1, 10)]
    assert rows_of(manager.visits_by_area(tables, SOUTH, AS_OF), "area", "visits") == [("B", 1)]


def test_dsp_performance(tables, rows_of):
    rows = {r["dsp_id"]: r for r in rows_of(manager.dsp_performance(tables, AS_OF))}
    assert set(rows) == {"u04", "u05", "u06"}    # no Manager, no DSP without merchants
    assert (rows["u04"]["actions_completed"], rows["u04"]["actions_open"]) == (1, 2)
    assert rows["u06"]["completion_rate"] is None


def test_inactive_reps_are_left_out(make_tables, rows_of):
    tables = make_tables(users=USERS, merchants=[merchant(1, "u07")])
    assert rows_of(manager.dsp_performance(tables, AS_OF)) == []


def test_team_performance(make_tables, rows_of):
    recs = [rec(i, 1, "Done" if i < 6 else "New") for i in range(1, 9)] + [rec(9, 2, "New")]
    tables = make_tables(
        users=USERS, recommendations=recs, daily_scores=[score(1, "6.25", 1), score(2, "0", 2)],
        merchants=[merchant(1, "u04"), merchant(2, "u05"), merchant(3, "u08"), merchant(4, "u02")])
    rows = rows_of(manager.team_performance(tables, ADMIN, AS_OF), "name", "avg_score", "completion_rate")
    assert rows == [("User 4", Decimal("6.3"), "62.5%"), ("User 5", None, "0%"), ("User 8", None, "0%")]
    assert rows_of(manager.team_performance(tables, SOUTH, AS_OF), "name") == [("User 8",)]
    assert rows_of(manager.team_performance(tables, MANAGER, AS_OF), "name") == [
        ("User 4",), ("User 5",)]                # reports only, not the manager


def test_views(tables, spark):
    manager.register_views(tables, AS_OF)
    assert spark.sql("SELECT sum(total_merchants) FROM v_area_summary").first()[0] == 5
    assert spark.sql("SELECT count(*) FROM v_dsp_performance").first()[0] == 3


def test_profile_reports(tables, rows_of):
    reports = {name: rows_of(report(tables, AS_OF)) for name, report in quality.PROFILE.items()}
    assert reports["users_by_role"] == [{"role": "Admin", "n": 1}, {"role": "DSP", "n": 5},
                                        {"role": "Manager", "n": 2}]
    assert [r["rank"] for r in reports["top_merchants"]] == [1, 2, 3, 5]
    assert reports["signals_today"] == [{"n": 0}]


def test_violations(make_tables, rows_of):
    users = [USERS[0], USERS[0] | {"id": "u09", "role": "Owner", "manager_id": "u77"}]
    tables = make_tables(
        users=users, merchants=[merchant(1, "u01"), merchant(1, "u01"), merchant(2, "u50"),
                                merchant(3, None)],
        daily_scores=[score(1, "1", 1), score(1, "1", 1) | {"id": "ds99"}])
    rows = rows_of(quality.check_constraints(tables), "table_name", "rule", "value", "n")
    assert sorted(rows, key=str) == sorted([
        ("users", "role allowed", "Owner", 1), ("users", "email unique", "u1@example.com", 2),
        ("users", "manager_id in users", "u77", 1), ("merchants", "id unique", "m01", 2),
        ("merchants", "assigned_dsp_id in users", "u50", 1),
        ("merchants", "assigned_dsp_id not null", None, 1),
        ("daily_scores", "merchant_id,score_date unique", "m01,2024-01-30", 2),
    ], key=str)


def test_a_batch_is_checked_by_its_own_rows(make_tables, make_df, rows_of):
    stored = [*MODEL["recommendations"], rec(20, 99), rec(21, 1, "Odd")]  # broken before the batch
    tables = make_tables(**{**MODEL, "recommendations": stored})
    new_users = [{"id": "u50", "email": "a", "password_hash": "x", "full_name": "x", "role": "DSP",
                  "manager_id": "u51"}, {"id": "u51", "email": "a", "password_hash": "x", "full_name": "x",
                                         "role": "DSP", "manager_id": "u52"}]
    new_recs = [rec(1, 2), rec(30, 98), rec(31, 98), rec(32, 3, "Odd"), rec(34, 3) | {"id": None},
                rec(33, 1, status_updated_by="u50")]
    added = {"users": make_df(SCHEMAS["users"], new_users),
             "recommendations": make_df(SCHEMAS["recommendations"], new_recs)}
    got = rows_of(quality.check_batch(tables, added), "table_name", "rule", "value", "n")
    assert sorted(map(str, got)) == sorted(map(str, [
        ("users", "email unique", "a", 2), ("users", "manager_id in users", "u52", 1),
        ("recommendations", "id unique", "r01", 2), ("recommendations", "id not null", None, 1),
        ("recommendations", "merchant_id in merchants", "m98", 2),
        ("recommendations", "status allowed", "Odd", 1)]))
    nothing = {name: rows.limit(0) for name, rows in added.items()}
    assert rows_of(quality.check_batch(tables, nothing)) == []

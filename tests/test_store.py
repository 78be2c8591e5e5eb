"""Stored tables: partition overwrites, change sets, the daily job and the change feed."""

from __future__ import annotations

import itertools
import json
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fieldbeat.operators import changes, chat
from fieldbeat.plans.daily_job import run_daily
from fieldbeat.schema import LATEST, SCHEMAS
from fieldbeat.sources import store as store_module
from fieldbeat.sources.store import Store
from fieldbeat.sources.tables import Tables, conform, newest, write_tables
from fieldbeat.streaming.feed import apply_feed
from tests.small import AS_OF, MODEL, NOW, YESTERDAY
from tests.test_changes import BRIEF, STATUS, TURN, status
from tests.test_scoring import DELTAS

SIGNALS = [
    {"id": f"ms0{n}", "merchant_id": f"m0{n}", "signal_date": YESTERDAY, "transaction_volume": 100,
     "transaction_trend": Decimal(n), "days_since_visit": n, "complaint_count": 0,
     "campaign_status": "Active", "wallet_balance": Decimal("10"), "active_products": 2,
     "created_at": NOW}
    for n in range(1, 6)
]


@pytest.fixture
def store(spark, make_tables, tmp_path):
    tables = make_tables(**MODEL, merchant_signals=SIGNALS, audit_logs=[], chat_sessions=[
        {"id": "cs01", "user_id": "u04", "title": "T", "updated_at": NOW}], chat_messages=[
        {"session_id": "cs01", "position": 0, "role": "user", "content": "hi"}])
    root = str(tmp_path / "tables")
    write_tables(tables, root)
    return Store(spark, root)


def updates(batch):
    return lambda tables, keep: changes.apply_status_updates(tables, batch, AS_OF, NOW, keep)


class Lost(Exception):
    """The driver dies."""


@pytest.fixture
def dying(monkeypatch):
    """Lets a step of a batch die at its n-th call, before or after it does its work."""

    def at(step, call=1, after=False):
        real, numbers = getattr(store_module, step), itertools.count(1)

        def wrapped(*args, **named):
            number = next(numbers)  # steps on several tables run at once
            if number == call and not after:
                raise Lost
            result = real(*args, **named)
            if number == call:
                raise Lost
            return result

        monkeypatch.setattr(store_module, step, wrapped)
        return lambda: monkeypatch.setattr(store_module, step, real)

    return at


def test_round_trip(store, make_tables, rows_of):
    want = make_tables(**MODEL)
    for name in ("users", "daily_scores", "recommendations", "visit_history"):
        got = getattr(store.tables(), name)
        assert got.schema.simpleString() is not None
        key = lambda r: r["id"]
        assert sorted(rows_of(got), key=key) == sorted(rows_of(getattr(want, name)), key=key)


def test_reads_of_one_day_touch_one_partition(store):
    today = store.tables().daily_scores.where(F.col("score_date") == F.lit(AS_OF))
    plan = today._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "score_date" in filters and "slot" in filters


def test_write_replaces_only_the_dates_given(store, rows_of):
    scores = store.tables().daily_scores
    today = scores.where(F.col("score_date") == F.lit(AS_OF)).withColumn("rank", F.lit(77))
    before = scores.where(F.col("score_date") == F.lit(YESTERDAY)).count()
    store.write("daily_scores", today)     # derived from the table it replaces
    after = store.tables().daily_scores
    assert {r for (r,) in rows_of(after.where(F.col("score_date") == F.lit(AS_OF)), "rank")} == {77}
    assert after.where(F.col("score_date") == F.lit(YESTERDAY)).count() == before


def test_daily_job(store, make_df, rows_of):
    deltas = make_df(DELTAS, [{"merchant_id": "m01", "trend_delta": Decimal("5")}])
    run_daily(store, deltas, AS_OF, NOW)
    tables = store.tables()
    signals = {r["merchant_id"]: r for r in rows_of(
        tables.merchant_signals.where(F.col("signal_date") == F.lit(AS_OF)))}
    assert set(signals) == {"m01", "m02", "m03", "m04", "m05"}       # the active ones
    assert signals["m01"]["transaction_trend"] == Decimal("6.00")
    assert {s["id"] for s in signals.values()} == {"ms06", "ms07", "ms08", "ms09", "ms10"}
    assert tables.merchant_signals.where(F.col("signal_date") == F.lit(YESTERDAY)).count() == 5
    scores = rows_of(tables.daily_scores.where(F.col("score_date") == F.lit(AS_OF)),
                     "rank", "merchant_id", "priority_score")
    assert sorted(r for r, _, _ in scores) == [1, 2, 3, 4, 5]
    ordered = [s for _, _, s in sorted(scores)]
    assert ordered == sorted(ordered, reverse=True)
    # Stored scores of the day keep their ids; a second run rolls on and adds no rows.
    assert "ds130" in dict(rows_of(tables.daily_scores, "id", "rank"))
    n_scores = tables.daily_scores.count()
    run_daily(store, deltas, AS_OF, NOW)
    again = store.tables().merchant_signals.where(F.col("signal_date") == F.lit(AS_OF))
    assert dict(rows_of(again, "merchant_id", "days_since_visit"))["m01"] == 3
    assert sorted(i for (i,) in rows_of(again, "id")) == sorted(s["id"] for s in signals.values())
    assert store.tables().daily_scores.count() == n_scores


def test_next_day_adds_a_partition(store, make_df):
    empty = make_df(DELTAS, [])
    run_daily(store, empty, AS_OF, NOW)
    run_daily(store, empty, AS_OF + timedelta(days=1), NOW)
    dates = store.tables().merchant_signals.groupBy("signal_date").count().collect()
    assert sorted(r.signal_date for r in dates) == [YESTERDAY, AS_OF, date(2024, 1, 31)]


def test_applied_status_changes(store, make_df, rows_of):
    batch = make_df(STATUS, [status(1, "r01", "NEW"), status(2, "r02", "DONE"), status(3, "r99", "NEW")])
    done = [store.apply(updates(batch), "batch") for _ in range(2)]
    assert done == [True, False]      # the same batch again changes nothing more
    tables = store.tables()
    rows = dict(rows_of(tables.recommendations, "id", "status"))
    assert len(rows) == 8 and (rows["r01"], rows["r02"], rows["r05"]) == ("New", "Done", "Done")
    assert tables.audit_logs.count() == 2
    assert tables.visit_history.count() == len(MODEL["visit_history"]) + 1


def test_applied_briefs_empty_a_partition(store, make_df, rows_of):
    batch = make_df(BRIEF, [{"seq": n, "merchant_id": m, "text": "t", "user_id": "u01", "role": "Admin"}
                            for n, m in enumerate(("m01", "m02", "m03", "m05"))])
    store.apply(lambda tables, keep: changes.replace_briefs(tables, batch, AS_OF, NOW, keep))
    dates = rows_of(store.tables().recommendations, "recommendation_date")
    assert dates == [(AS_OF,)] * 4


def test_applied_chats(store, make_df, rows_of):
    batch = make_df(TURN, [{"seq": 1, "user_id": "u04", "session_id": "cs01", "message": "a", "answer": "b"},
                           {"seq": 2, "user_id": "u04", "message": "c", "answer": "d"}])
    store.apply(lambda tables, keep: chat.append_chats(tables, batch, NOW, keep))
    assert store.tables().chat_sessions.count() == 2
    assert sorted(rows_of(store.tables().chat_messages, "session_id", "position")) == [
        ("cs01", 0), ("cs01", 1), ("cs01", 2), ("cs02", 0), ("cs02", 1)]


def test_change_feed(store, spark, tmp_path, rows_of):
    folder = tmp_path / "requests"
    folder.mkdir()

    def send(name, *rows):
        (folder / f"{name}.json").write_text("\n".join(json.dumps(r) for r in rows))
        stream = spark.readStream.schema(STATUS).option("maxFilesPerTrigger", 1).json(str(folder))
        apply_feed(
            store, stream,
            lambda tables, batch, keep: changes.apply_status_updates(tables, batch, AS_OF, NOW, keep),
            str(tmp_path / "state"), f"feed-{tmp_path.name}",
        ).awaitTermination()

    send("one", status(1, "r01", "IN_PROGRESS"), status(2, "r04", "DONE"))
    send("two", status(3, "r01", "DONE"))
    assert dict(rows_of(store.tables().recommendations, "id", "status"))["r01"] == "Done"
    assert store.tables().audit_logs.count() == 3
    assert store.tables().visit_history.count() == len(MODEL["visit_history"]) + 2


def test_jdbc_reads_use_the_given_partitions(spark, make_df, rows_of):
    seen = {}

    class Reader:
        def jdbc(self, url, name, predicates, properties):
            seen[name] = (url, predicates, properties)
            return make_df("id string, full_name string", [{"id": "u01", "full_name": "U"}])

    class Session:
        read = Reader()

    tables = Tables.from_jdbc(
        Session(), "jdbc:postgresql://host/db", {"user": "u"}, {"users": ["id < 'u5'", "id >= 'u5'"]})
    assert rows_of(tables.users, "id", "full_name", "email") == [("u01", "U", None)]
    assert seen == {"users": ("jdbc:postgresql://host/db", ["id < 'u5'", "id >= 'u5'"], {"user": "u"})}


def test_conform(make_df, rows_of):
    sessions = make_df("id string, messages string, other int", [
        {"id": "cs01", "messages": '[{"role": "user", "content": "a"}, {"role": "assistant"}]'},
        {"id": "cs02", "messages": "[]"}, {"id": "cs03"}])
    assert rows_of(conform("chat_messages", sessions), "session_id", "position", "role", "content") == [
        ("cs01", 0, "user", "a"), ("cs01", 1, "assistant", None)]
    logs = make_df("id string, action string, ip_address string, created_at string", [
        {"id": "al01", "ip_address": "10.0.0.1", "created_at": "2024-01-30 12:00:00+02:00"}])
    logs = logs.withColumn("created_at", F.col("created_at").cast("timestamp"))
    assert rows_of(conform("audit_logs", logs), "ip_address", "created_at", "user_id") == [
        ("10.0.0.1", datetime(2024, 1, 30, 10), None)]
    scores = make_df("id string, score_breakdown string", [
        {"id": "ds01", "score_breakdown": '{"transaction": 1.5, "recency": 2, "tier": 3, "complaints": 4}'}])
    assert conform("daily_scores", scores).first()["score_breakdown"]["transaction"] == Decimal("1.5")
    for name, ddl in SCHEMAS.items():
        empty = make_df(ddl, [])
        assert conform(name, empty).dtypes == empty.dtypes


def test_schemas_parse(spark):
    for ddl in SCHEMAS.values():
        assert spark.createDataFrame([], ddl).columns
    assert datetime(2024, 1, 30, 12) == NOW


def test_latest_rows_follow_the_daily_job(store, make_df, rows_of):
    """They equal those of the whole history, also for a merchant whose last day is old."""
    for days in (0, 1):
        run_daily(store, make_df(DELTAS, []), AS_OF + timedelta(days=days), NOW)
        if not days:
            store.apply(lambda tables, keep: changes.assign_merchants(tables, make_df(
                "seq bigint, caller_id string, caller_role string, merchant_id string, assigned_dsp_id string",
                []), NOW, keep))
    tables = store.tables()
    for latest, name in LATEST.items():
        want = newest(getattr(tables, name), name)
        got = getattr(tables, latest)
        assert "row_number" not in got._jdf.queryExecution().executedPlan().toString()
        key = lambda r: r["merchant_id"]
        assert sorted(rows_of(got), key=key) == sorted(rows_of(want), key=key)
    assert dict(rows_of(tables.latest_scores, "merchant_id", "score_date"))["m06"] == YESTERDAY
    store.write("daily_scores", tables.daily_scores.withColumn("rank", F.lit(5)))    # without them
    assert set(rows_of(store.tables().latest_scores, "rank")) == {(5,)}


def test_numbers_run_on_without_the_history(store, make_df, rows_of):
    for n in (1, 2, 3):
        store.apply(updates(make_df(STATUS, [status(1, "r02", "DONE"), status(2, "r01", "DONE")])))
    assert sorted(rows_of(store.tables().audit_logs, "id")) == [(f"al0{n}",) for n in range(1, 7)]
    plan = store.tables().last_number("audit_logs")
    assert "Subquery" not in str(plan)


STEPS = [("begin", 1, False), ("begin", 1, True), ("add_rows", 1, True), ("add_rows", 2, False), ("add_rows", 2, True),
         ("replace_dates", 1, False), ("replace_dates", 1, True), ("commit", 1, False)]


@pytest.mark.parametrize(("step", "call", "after"), [*STEPS, ("commit", 1, True)])
def test_interrupted_changes_are_stored_once(store, make_df, rows_of, dying, step, call, after):
    """A dies at some point, which changes nothing unless it has committed; B runs, A is called
    again: both are stored, each once."""
    one = make_df(STATUS, [status(1, "r01", "NEW"), status(2, "r02", "DONE")])
    two = make_df(STATUS, [status(1, "r03", "DONE")])
    before = dict(rows_of(store.tables().recommendations, "id", "status"))
    revive = dying(step, call, after)
    with pytest.raises(Lost):
        store.apply(updates(one), "A")
    revive()
    if (step, after) != ("commit", True):
        assert dict(rows_of(store.tables().recommendations, "id", "status")) == before
        assert store.tables().audit_logs.isEmpty()
        assert store.tables().visit_history.count() == len(MODEL["visit_history"])
    assert store.apply(updates(two), "B")
    store.apply(updates(one), "A")
    tables = store.tables()
    rows = dict(rows_of(tables.recommendations, "id", "status"))
    assert len(rows) == 8 and (rows["r01"], rows["r02"], rows["r03"]) == ("New", "Done", "Done")
    assert sorted(rows_of(tables.audit_logs, "id")) == [("al01",), ("al02",), ("al03",)]
    assert tables.visit_history.count() == len(MODEL["visit_history"]) + 2
    assert tables.visit_history.select("id").distinct().count() == tables.visit_history.count()


def test_a_recommendation_without_a_date_is_updated(store, make_df, rows_of):
    store.apply(updates(make_df(STATUS, [dict(status(1, "r08", "DEFERRED"), user_id="u06")])))
    assert dict(rows_of(store.tables().recommendations, "id", "status"))["r08"] == "Deferred"
    store.apply(lambda tables, keep: changes.replace_briefs(tables, make_df(BRIEF, [
        {"seq": 1, "merchant_id": "m05", "text": "t", "user_id": "u01", "role": "Admin"}]), AS_OF, NOW, keep))
    left = store.tables().recommendations
    assert left.where("recommendation_date IS NULL").count() == 0 and left.count() == 8


def test_replaced_rows_take_two_places_at_most(store, make_df, rows_of, tmp_path):
    """A date's folder is overwritten by the change after the next one."""
    for n in range(4):
        assert store.apply(updates(make_df(STATUS, [status(1, "r01", ("NEW", "DONE")[n % 2])])), f"b{n}")
        assert dict(rows_of(store.tables().recommendations, "id", "status"))["r01"] == ("New", "Done")[n % 2]
    folders = [p for p in (tmp_path / "tables/recommendations").glob("slot=*/*") if p.is_dir()]
    assert len(folders) <= 2 * len({p.name for p in folders})
    logs = [p.name for p in (tmp_path / "tables/audit_logs").iterdir() if p.is_dir()]
    assert logs == [f"created_on={AS_OF}"]


def test_a_table_may_become_empty(store, spark):
    users = store.tables().users
    every = spark.createDataFrame(users.collect(), users.schema)
    for rows in (every.limit(0), every, every.limit(0)):
        store.write("users", rows)
        assert store.tables().users.count() == rows.count()


def test_scratch_is_empty_after_a_batch(store, make_df, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Store, "scratch", lambda self, name: f"{tmp_path}/scratch/{name}")
    store.apply(updates(make_df(STATUS, [status(1, "r01", "NEW")])), "A")
    run_daily(store, make_df(DELTAS, []), AS_OF, NOW, "day")
    assert list((tmp_path / "scratch").iterdir()) == []


@pytest.mark.parametrize(("step", "call", "after"), [
    ("replace_table", 2, True), ("replace_dates", 1, True), ("commit", 1, False), ("commit", 1, True)])
def test_an_interrupted_daily_job_rolls_on_once(store, make_df, rows_of, dying, step, call, after):
    revive = dying(step, call, after)
    with pytest.raises(Lost):
        run_daily(store, make_df(DELTAS, []), AS_OF, NOW, "day")
    revive()
    assert run_daily(store, make_df(DELTAS, []), AS_OF, NOW, "day") == (step != "commit" or not after)
    assert not run_daily(store, make_df(DELTAS, []), AS_OF, NOW, "day")
    today = store.tables().merchant_signals.where(F.col("signal_date") == F.lit(AS_OF))
    assert dict(rows_of(today, "merchant_id", "days_since_visit"))["m01"] == 2
    scores = store.tables().daily_scores.where(F.col("score_date") == F.lit(AS_OF))
    assert sorted(rows_of(scores, "rank")) == [(1,), (2,), (3,), (4,), (5,)]

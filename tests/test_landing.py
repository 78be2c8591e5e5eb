"""Landed files: declared schema, bad rows apart, each file once."""

from __future__ import annotations

import json
from datetime import timedelta

import pytest

from fieldbeat.sources import landing, store as store_module
from fieldbeat.sources.store import Store
from fieldbeat.sources.tables import write_tables
from tests.small import AS_OF, MODEL
from tests.test_store import SIGNALS, Lost, dying  # noqa: F401

KEYS = ["merchant_id", "signal_date"]
NEXT = AS_OF + timedelta(days=1)


def signal(number, merchant, day=NEXT, **more):
    return json.dumps({"id": f"ms{number}", "merchant_id": merchant, "signal_date": str(day)} | more)


@pytest.fixture
def landed(spark, make_tables, tmp_path):
    """Lets files be dropped and taken, and gives the store."""
    write_tables(make_tables(**MODEL, merchant_signals=SIGNALS), str(tmp_path / "store"),
                 ("merchant_signals", "users", "audit_logs"))
    store = Store(spark, str(tmp_path / "store"))

    def take(files, name="merchant_signals", keys=KEYS, form="json"):
        folder = tmp_path / name
        folder.mkdir(exist_ok=True)
        for file, lines in files.items():
            (folder / file).write_text("\n".join(lines))
        landing.take_files(store, str(folder), name, keys, str(tmp_path / f"seen-{name}"), form).awaitTermination()
        return store.tables()

    return take


def test_json_lines(spark, tmp_path, rows_of):
    (tmp_path / "a.json").write_text("\n".join([
        signal(1, "m01", transaction_volume=5, wallet_balance=1.5, other=[1]), "", '{"id": "ms2", "mer', "[1, 2]",
        signal(3, "m01", transaction_volume="many"), signal(4, None), signal(5, "m01", campaign_status="Odd"),
        json.dumps({"id": "x6", "merchant_id": "m01", "signal_date": str(NEXT)}), signal("7" + "0" * 20, "m01"),
        signal(8, "m02", day="2024-13-45")]))
    out = landing.read_files(spark, str(tmp_path), "merchant_signals")
    assert rows_of(out.good, "id", "transaction_volume", "signal_date") == [("ms1", 5, NEXT)]
    bad = rows_of(out.bad, "row", "reason")
    assert sorted(r for _, r in bad) == sorted([
        "unreadable", "unreadable", "unreadable", "unreadable", "merchant_id not null", "campaign_status allowed",
        "id form", "id form"])
    assert ('{"id": "ms2", "mer', "unreadable") in bad
    assert set(rows_of(out.bad, "table_name", "file")) == {("merchant_signals", "a.json")}


def test_csv_lines(spark, tmp_path, rows_of):
    (tmp_path / "a.csv").write_text("\n".join([
        "session_id,position,role,content", "cs01,0,user,\"hi, there\"", "cs01,one,user,x", "cs01,2,user,a,b",
        ",3,user,x", "session_id,position,role,content", "cs02,4,,"]))
    out = landing.read_files(spark, str(tmp_path), "chat_messages", "csv")
    assert sorted(rows_of(out.good, "session_id", "position", "role", "content")) == [
        ("cs01", 0, "user", "hi, there"), ("cs02", 4, None, None)]
    assert sorted(rows_of(out.bad, "reason")) == [("session_id not null",), ("unreadable",), ("unreadable",)]
    with pytest.raises(ValueError, match="unknown form"):
        landing.read_files(spark, str(tmp_path), "users", "xml")


def test_each_file_is_taken_once(landed, rows_of):
    first = {"one.json": [signal(11, "m01", transaction_volume=1), signal(12, "m01", transaction_volume=2), "{"]}
    tables = landed(first)
    today = tables.merchant_signals.where(f"signal_date = '{NEXT}'")
    assert rows_of(today, "id", "transaction_volume") == [("ms11", 1)]
    assert rows_of(tables.bad_rows, "file", "reason") == [("one.json", "unreadable")]
    tables = landed({})                                            # nothing new
    assert tables.merchant_signals.count() == len(SIGNALS) + 1 and tables.bad_rows.count() == 1
    tables = landed({"two.json": [signal(9, "m01"), signal(13, "m02"), signal(14, "m03", day=AS_OF)]})
    assert sorted(rows_of(tables.merchant_signals.where(f"signal_date >= '{AS_OF}'"), "id")) == [
        ("ms11",), ("ms13",), ("ms14",)]
    assert tables.bad_rows.count() == 1


@pytest.mark.parametrize(("step", "after"), [
    ("add_rows", True), ("replace_dates", True), ("commit", False), ("commit", True)])
def test_a_job_that_dies_takes_its_files_later(landed, rows_of, dying, step, after):  # noqa: F811
    revive = dying(step, 1, after)
    files = {"one.json": [signal(11, "m01"), "{"]}
    with pytest.raises(Exception, match="Lost"):
        landed(files)
    revive()
    tables = landed({})
    assert tables.merchant_signals.count() == len(SIGNALS) + 1
    assert rows_of(tables.bad_rows, "row") == [("{",)]
    assert Lost and store_module


def test_tables_without_dates_and_tables_that_grow(landed, rows_of):
    user = {"id": "u90", "email": "n@x", "password_hash": "h", "full_name": "N", "role": "DSP"}
    tables = landed({"u": [json.dumps(user), json.dumps(user | {"id": "u04"}), json.dumps(user | {"role": "Boss"})]},
                    "users", ["id"])
    assert tables.users.count() == len(MODEL["users"]) + 1
    logs = [{"id": "al01", "action": "LOGIN", "created_at": "2024-01-30T08:00:00"}, {"id": "al02"}]
    tables = landed({"l": [json.dumps(r) for r in logs]}, "audit_logs", ["id"])
    assert rows_of(tables.audit_logs, "id", "action") == [("al01", "LOGIN")]
    assert sorted(rows_of(tables.bad_rows, "table_name", "reason")) == [
        ("audit_logs", "action not null"), ("users", "role allowed")]


def test_keys_must_have_the_date(landed):
    with pytest.raises(Exception, match="must be one of the keys"):
        landed({"x": [signal(1, "m01")]}, keys=["id"])


def test_no_rows_yet(landed, spark, tmp_path):
    assert Store(spark, str(tmp_path / "store")).tables().bad_rows.collect() == []
    tables = landed({"empty.json": [""]})
    assert tables.merchant_signals.count() == len(SIGNALS) and tables.bad_rows.isEmpty()

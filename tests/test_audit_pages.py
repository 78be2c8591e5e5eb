"""Pages of a stored audit log read its newest dates only."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

import pytest

from fieldbeat.operators import admin
from fieldbeat.operators.scope import Caller
from fieldbeat.sources.tables import Tables, write_tables
from tests.small import MODEL

ADMIN = Caller("u01", "Admin")
DAYS = 20


@pytest.fixture(scope="module")
def both(spark, make_tables, tmp_path_factory):
    """The same log, not stored and stored: twelve rows a day, with ties across ids, and one row without an instant."""
    start = datetime(2024, 1, 1)
    logs = [{"id": f"al{n:02d}", "user_id": "u01", "action": "RARE" if n % 60 == 7 else "VIEW", "resource": str(n),
             "details": f'{{"k": {n}}}', "created_at": start + timedelta(days=n // 12, hours=n % 12 // 5)}
            for n in range(12 * DAYS)]
    logs.append({"id": "al999", "user_id": "u02", "action": "VIEW", "resource": "none"})
    plain = make_tables(users=MODEL["users"], audit_logs=logs)
    root = str(tmp_path_factory.mktemp("logs") / "t")
    write_tables(plain, root, ("users", "audit_logs"))
    return plain, Tables.from_parquet(spark, root)


@pytest.mark.parametrize("action, limit, dates", [
    (None, 10, 1), (None, 13, 1), (None, 14, 8), (None, 100, DAYS), ("VIEW", 5, 1), ("rare", 1, 8), ("rare", 3, DAYS),
    ("rare", 50, DAYS), ("nothing", 5, DAYS)])
def test_pages(both, action, limit, dates):
    plain, stored = both
    page = admin.audit_trail(stored, ADMIN, action, limit)
    want = [tuple(r) for r in admin.audit_trail(plain, ADMIN, action, limit).collect()]
    assert [tuple(r) for r in page.collect()] == want
    assert dates_read(page) == dates


def dates_read(page) -> int:
    """How many dates the filters on folders leave."""
    scan = next(line for line in page._jdf.queryExecution().executedPlan().toString().splitlines()
                if "FileScan" in line and "created_on" in line)
    since = re.search(r"created_on#\d+ >= 2024-01-(\d\d)", scan)
    return DAYS - int(since.group(1)) + 1 if since else DAYS


def test_by_detail(both):
    plain, stored = both
    for value in ("239", "3", "none"):
        want = [tuple(r) for r in admin.audit_by_detail(plain, ADMIN, "$.k", value).collect()]
        assert [tuple(r) for r in admin.audit_by_detail(stored, ADMIN, "$.k", value).collect()] == want

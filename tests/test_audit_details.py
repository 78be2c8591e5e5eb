"""Fields of audit details, whatever the details hold."""

from __future__ import annotations

import pytest

from fieldbeat.operators import admin
from fieldbeat.operators.scope import Caller
from tests.small import NOW

ADMIN = Caller("u01", "Admin")
DETAILS = ['{"k": 7, "dsp": {"name": "Ann \\"A\\""}}', '{"k": "x"}', "not json", "[1]", None, '{"k": null}', "{}", '{"k": 7']


def test_fields(make_tables, rows_of):
    tables = make_tables(audit_logs=[
        {"id": f"al0{i}", "action": "A", "details": d, "created_at": NOW} for i, d in enumerate(DETAILS)], users=[])
    got = admin.audit_details(tables, ADMIN, {"$.k": "bigint", "$.dsp.name": "string"})
    assert sorted(rows_of(got, "id", "is_json", "k", "name")) == [
        ("al00", True, 7, 'Ann "A"'), ("al01", True, None, None), ("al02", False, None, None),
        ("al03", True, None, None), ("al04", False, None, None), ("al05", True, None, None),
        ("al06", True, None, None), ("al07", False, None, None)]
    assert admin.audit_details(tables, ADMIN, {"$.k": "bigint"}, action="b").isEmpty()
    named = admin.audit_by_detail(tables, ADMIN, "$.dsp.name", 'Ann "A"')
    assert rows_of(named, "id", "user") == [("al00", None)]
    with pytest.raises(PermissionError):
        admin.audit_details(tables, Caller("u02", "Manager"), {"$.k": "bigint"})

"""Administration reads: users, merchants, profiles and the audit trail."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbeat.functions.columns import clamp, contains_text, id_number
from fieldbeat.operators.scope import Caller
from fieldbeat.sources.tables import Tables


def _newest() -> list[Column]:
    return [F.desc_nulls_first("created_at"), id_number(F.col("id"), "al")]


def _page(tables: Tables, wanted: Column | None, limit: int) -> DataFrame:
    """The newest ``limit`` audit rows that are wanted.

    Of a log stored by date only the newest dates are read, eight times as many in each try, until
    they have the page: any row of an older date comes behind it.
    """
    days, more = 1, True
    while more:
        logs, more = tables.newest_days("audit_logs", days)
        logs = logs if wanted is None else logs.where(wanted)
        more = more and logs.limit(limit).count() < limit
        days *= 8
    return logs.orderBy(*_newest()).limit(limit)


def _newest_logs(tables: Tables, caller: Caller, action: str | None, limit: int) -> DataFrame:
    caller.require("Admin")
    wanted = contains_text(F.col("action"), action) if action else None
    names = tables.users.select(F.col("id").alias("user_id"), F.col("full_name").alias("user"))
    return _page(tables, wanted, clamp(limit, 200)).join(names, "user_id", "left")


def audit_trail(
    tables: Tables, caller: Caller, action: str | None = None, limit: int = 50
) -> DataFrame:
    """Newest audit rows with the user's name; ``action`` is a contained text."""
    return _newest_logs(tables, caller, action, limit).orderBy(*_newest()).select(
        "action", "resource", "resource_id", "details", "created_at", "user")


def audit_page(
    tables: Tables, caller: Caller, action: str | None = None, limit: int = 50
) -> DataFrame:
    """The same rows in the page layout, numbered ``log-0``, ``log-1`` … from the newest.

    The page has columns for ids, details and addresses, but leaves them empty.
    """
    none = F.lit(None).cast("string")
    position = F.row_number().over(Window.orderBy(*_newest())) - 1  # of at most 200 rows
    return _newest_logs(tables, caller, action, limit).select(
        F.concat(F.lit("log-"), position.cast("string")).alias("id"),
        "action", "resource", none.alias("resource_id"), none.alias("details"),
        none.alias("ip_address"), F.col("user").alias("user_name"), "created_at",
    )


def audit_details(
    tables: Tables, caller: Caller, fields: Mapping[str, str], action: str | None = None
) -> DataFrame:
    """Audit rows with fields of their details: ``fields`` gives each one's path and type.

    Details are free text, most of it JSON objects of whatever form the action has. They are
    parsed once, as a variant; a field is null where the details are not JSON, do not have it, or
    hold a value that is not of its type.
    """
    caller.require("Admin")
    logs = tables.audit_logs
    if action:
        logs = logs.where(contains_text(F.col("action"), action))
    parsed = logs.withColumn("_details", F.try_parse_json("details"))
    return parsed.select(
        "id", "user_id", "action", "resource", "resource_id", "created_at",
        F.col("_details").isNotNull().alias("is_json"),
        *[F.try_variant_get("_details", path, kind).alias(path.rpartition(".")[2])
          for path, kind in fields.items()])


def audit_by_detail(
    tables: Tables, caller: Caller, path: str, value: str, limit: int = 50
) -> DataFrame:
    """Newest audit rows whose details have this text at this path."""
    caller.require("Admin")
    found = F.try_variant_get(F.try_parse_json("details"), path, "string") == value
    names = tables.users.select(F.col("id").alias("user_id"), F.col("full_name").alias("user"))
    page = _page(tables, found, clamp(limit, 200)).join(names, "user_id", "left")
    return page.orderBy(*_newest()).select(
        "id", "action", "resource", "resource_id", "details", "created_at", "user")


def list_users(
    tables: Tables,
    caller: Caller,
    role: str | None = None,
    region: str | None = None,
    is_active: bool | None = None,
    limit: int = 100,
) -> DataFrame:
    """Users with their manager's name, by role and name; only given filters apply."""
    caller.require("Admin")
    wanted = {"role": role or None, "region": region or None, "is_active": is_active}
    conditions = [F.col(name) == value for name, value in wanted.items() if value is not None]
    order = [F.asc_nulls_last("role"), F.asc_nulls_last("full_name"), id_number(F.col("user_id"), "u")]
    page = (
        tables.users.where(reduce(and_, conditions, F.lit(True)))
        .withColumnRenamed("id", "user_id")
        .orderBy(*order).limit(clamp(limit, 500))
    )
    managers = tables.users.select(
        F.col("id").alias("manager_id"), F.col("full_name").alias("manager_name"))
    return page.join(managers, "manager_id", "left").orderBy(*order).select(
        "user_id", "email", "full_name", "role", "region", "area", "is_active",
        "manager_name", "created_at",
    )


def list_merchants(tables: Tables, caller: Caller) -> DataFrame:
    """All merchants, active or not, with the assigned DSP's name, by merchant name."""
    caller.require("Admin")
    names = tables.users.select(
        F.col("id").alias("assigned_dsp_id"), F.col("full_name").alias("assigned_dsp_name"))
    return tables.merchants.join(names, "assigned_dsp_id", "left").orderBy(
        "merchant_name", id_number(F.col("id"), "m")
    ).select(
        F.col("id").alias("merchant_id"), "merchant_name", "region", "area", "tier",
        "category", "assigned_dsp_id", "assigned_dsp_name",
    )


def user_profiles(
    tables: Tables,
    user_ids: DataFrame | None = None,
    emails: DataFrame | None = None,
    active_only: bool = False,
) -> DataFrame:
    """Profiles, narrowed by ids (user_id) or e-mail addresses (email) if given."""
    users = tables.users.withColumnRenamed("id", "user_id")
    if active_only:
        users = users.where(F.col("is_active"))
    if user_ids is not None:
        users = users.join(user_ids.select("user_id"), "user_id", "left_semi")
    if emails is not None:
        users = users.join(emails.select("email"), "email", "left_semi")
    return users.select(
        "user_id", F.col("full_name").alias("name"), "email", "role", "region", "area")

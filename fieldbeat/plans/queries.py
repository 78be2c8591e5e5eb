"""The registered queries: each operator over the whole test tables of one scale.

Results are flattened to plain types (bigint, double, string, date, timestamp, boolean)
so that they compare with SQL results value by value.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegerType, StructType

from fieldbeat.functions.columns import as_json, clean_name, id_number
from fieldbeat.functions.merge import insert_ignore, upsert
from fieldbeat.operators import (
    admin, changes, chat, context, dashboards, manager, merchants, quality, scope, scoring, text_index,
)
from fieldbeat.operators.scope import Caller, active
from fieldbeat.plans import kept_rollups
from fieldbeat.plans.daily_job import UPDATED_SIGNAL_COLUMNS, next_signals
from fieldbeat.plans.kept_rollups import KeptRollups
from fieldbeat.schema import PARTITION_COLUMN, RULES, SCHEMAS
from fieldbeat.sources import landing
from fieldbeat.sources.buckets import BucketTable
from fieldbeat.sources.store import Store
from fieldbeat.sources.tables import Tables, conform, write_tables
from fieldbeat.sources.testdata import AS_OF, NOW, TestData

ADMIN = Caller("u01", "Admin")
MANAGER = Caller("u02", "Manager")
DSP = Caller("u08", "DSP")
NAME = "'\"#00000001 '"

Query = Callable[[TestData], DataFrame]


def plain(df: DataFrame) -> DataFrame:
    """Integers as bigint, decimals as double, structs as their fields."""
    columns: list[Column] = []

    def add(column: Column, name: str, data_type) -> None:
        if isinstance(data_type, StructType):
            for field in data_type:
                add(column[field.name], field.name, field.dataType)
        elif isinstance(data_type, DecimalType):
            columns.append(column.cast("double").alias(name))
        elif isinstance(data_type, IntegerType):
            columns.append(column.cast("bigint").alias(name))
        else:
            columns.append(column.alias(name))

    for field in df.schema:
        add(F.col(field.name), field.name, field.dataType)
    return df.select(*columns)


def _reprofiled_scores(d: TestData) -> DataFrame:
    """Signals rolled forward and upserted, then the day scored and ranked again."""
    signals = next_signals(d.tables, d.signal_deltas(), AS_OF)
    return scoring.score_merchants(signals, active(d.tables.merchants), AS_OF)


def _context_fields(
    d: TestData, caller: Caller = ADMIN, merchant_ids: DataFrame | None = None,
    visits_per_part: int = context.VISITS_PER_PART,
) -> DataFrame:
    """The JSON documents, parsed again; visits as one text per document, in order."""
    documents = context.brief_context(d.tables, caller, AS_OF, merchant_ids, visits_per_part)
    parsed = documents.select(
        "merchant_id", "part",
        F.from_json(
            "context",
            "merchant_profile_and_scores struct<merchant_profile: struct<merchant_name: string, "
            "area: string, latitude: double, onboarding_date: date, assigned_dsp: string, "
            "priority_score: double, recommendation_id: string>, signals: "
            "struct<transaction_trend: double, wallet_balance: double, days_since_visit: bigint>>, "
            "recent_visit_history array<struct<visit_date: string, visit_notes: string, "
            "outcome: string, duration_mins: string, visited_by: string>>",
        ).alias("doc"),
    )
    scores = F.col("doc.merchant_profile_and_scores")
    line = F.transform("doc.recent_visit_history", lambda v: F.concat_ws(
        "|", v.visit_date, v.visit_notes, v.outcome, v.duration_mins, v.visited_by))
    return parsed.select(
        "merchant_id", "part", scores["merchant_profile"].alias("profile"),
        scores["signals"].alias("signals"),
        F.size("doc.recent_visit_history").alias("n_visits"),
        F.array_join(line, "\n").alias("visits"),
    )


def _profile(report: str) -> Query:
    return lambda d: quality.PROFILE[report](d.tables, AS_OF)


def _m01(d: TestData) -> changes.ChangeSet:
    return changes.apply_status_updates(d.tables, d.status_changes(), AS_OF, NOW)


def _m02(d: TestData) -> changes.ChangeSet:
    return changes.apply_actions(d.tables, d.status_changes(), NOW)


def _m03(d: TestData) -> changes.ChangeSet:
    return changes.create_users(d.tables, d.user_creates(), NOW)


def _m04(d: TestData) -> changes.ChangeSet:
    return changes.update_users(d.tables, d.user_updates(), NOW)


def _m05(d: TestData) -> changes.ChangeSet:
    tables = d.tables.replace(users=d.users_and_trainees())
    return changes.delete_users(tables, d.user_deletes(), NOW)


def _m06(d: TestData) -> changes.ChangeSet:
    return changes.assign_roles(d.tables, d.role_changes(), NOW)


def _m07(d: TestData) -> changes.ChangeSet:
    return changes.assign_merchants(d.tables, d.assignments(), NOW)


def _m08(d: TestData) -> changes.ChangeSet:
    return changes.replace_briefs(d.tables, d.briefs(), AS_OF, NOW)


def _m09(d: TestData) -> changes.ChangeSet:
    return chat.append_chats(d.tables, d.chat_turns(), NOW)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's folder for intermediate tables. One machine alone may use its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        folder = tempfile.mkdtemp()
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _stored(d: TestData) -> DataFrame:
    """The tables that status changes touch, after two batches that a third call repeats."""
    root = f"{shared_folder(d.spark)}/stored-{uuid.uuid4().hex}"
    write_tables(d.tables, root, ("users", "merchants", "recommendations", "visit_history", "audit_logs"))
    store = Store(d.spark, root)
    for batch in ("one", "two", "one"):
        store.apply(lambda tables, keep: changes.apply_status_updates(
            tables, d.status_changes(), AS_OF, NOW, keep), batch)
    tables = store.tables()

    def rows(name: str, state: str, user: str, at: str) -> DataFrame:
        return getattr(tables, name).select(
            F.lit(name).alias("table_name"), "id", F.col(state).alias("state"),
            F.col(user).alias("user_id"), F.col(at).cast("date").alias("at"))

    return (
        rows("recommendations", "status", "status_updated_by", "status_updated_at")
        .unionByName(rows("audit_logs", "action", "user_id", "created_at"))
        .unionByName(rows("visit_history", "outcome", "dsp_id", "visit_date")))


def _landed(d: TestData) -> Store:
    """A store of signals after two deliveries of files, each taken once, and a third call."""
    root = f"{shared_folder(d.spark)}/landed-{uuid.uuid4().hex}"
    write_tables(d.tables, f"{root}/store", ("merchant_signals",))
    store = Store(d.spark, f"{root}/store")
    lines = d.landed_lines()
    for delivery in (0, 1, 2):
        part = lines.where(F.col("_signal") % 2 == delivery).select("line")
        part.write.mode("append").text(f"{root}/files")
        landing.take_files(store, f"{root}/files", "merchant_signals", SIGNAL_KEYS, f"{root}/seen",
                           source="files").awaitTermination()
    return store


def _bad_rows(d: TestData) -> DataFrame:
    return _landed(d).tables().bad_rows.select(
        "table_name", F.regexp_extract("row", '"id":"([^"]*)"', 1).alias("id"), "reason")


def _details(d: TestData) -> DataFrame:
    """Of the stored audit rows and of new ones, whose details have other fields."""
    logs = d.tables.audit_logs.unionByName(_m07(d).audit)
    return admin.audit_details(d.tables.replace(audit_logs=logs), ADMIN, {
        "$.k": "bigint", "$.dsp_name": "string", "$.assigned_dsp_id": "string"}).drop("user_id", "created_at")


def _by_detail(d: TestData) -> DataFrame:
    logs = d.tables.audit_logs.unionByName(_m07(d).audit)
    return admin.audit_by_detail(d.tables.replace(audit_logs=logs), ADMIN, "$.assigned_dsp_id", "u08", 100)


def _logged(d: TestData) -> Tables:
    """Audit rows and users, stored."""
    root = f"{shared_folder(d.spark)}/logged-{uuid.uuid4().hex}"
    write_tables(d.tables, root, ("users", "audit_logs"))
    return Tables.from_parquet(d.spark, root)


def _indexed(d: TestData, text: str, fields: tuple[str, ...] = text_index.FIELDS) -> Tables:
    """The tables, with the merchants that an index over all of them leaves for this text."""
    path = f"{shared_folder(d.spark)}/index-{uuid.uuid4().hex}"
    text_index.write_index(d.tables.merchants, path)
    return text_index.candidates(d.tables, text_index.read_index(d.spark, path), text, fields)


def _bucketed(d: TestData, name: str, keys: list[str]) -> BucketTable:
    table = BucketTable(d.spark, f"{shared_folder(d.spark)}/buckets-{uuid.uuid4().hex}", SCHEMAS[name], keys, 16)
    table.create(getattr(d.tables, name))
    return table


def _insert_bucketed(d: TestData) -> DataFrame:
    table = _bucketed(d, "merchant_signals", SIGNAL_KEYS)
    for batch in ("one", "two", "one"):
        table.insert_ignore(d.next_day_signals(), _by_id_number(), batch)
    return table.rows()


def _upsert_bucketed(d: TestData) -> DataFrame:
    table = _bucketed(d, "merchant_signals", SIGNAL_KEYS)
    for batch in ("one", "two", "one"):
        table.upsert(d.next_day_signals(), UPDATED_SIGNAL_COLUMNS, _by_id_number(), batch)
    return table.rows()


def _assigned_bucketed(d: TestData) -> DataFrame:
    """Merchants in buckets of their id, after assignments that read and write only theirs."""
    table, batch = _bucketed(d, "merchants", ["id"]), d.assignments()
    table.change(batch.select(F.col("merchant_id").alias("id")), lambda merchants: changes.assign_merchants(
        d.tables.replace(merchants=merchants), batch, NOW).table)
    return table.rows()


def _kept(d: TestData) -> KeptRollups:
    """Kept roll-ups after status changes and assignments, each offered twice."""
    kept = KeptRollups(d.spark, f"{shared_folder(d.spark)}/kept-{uuid.uuid4().hex}", 16)
    kept.create(d.tables, AS_OF)
    for _ in range(2):
        kept.take_statuses(kept_rollups.status_changes(d.tables, _m01(d).results, AS_OF), "statuses")
        kept.take_assignments(kept_rollups.assignments(_m07(d).results), "assignments")
    return kept


def _batch_violations(d: TestData) -> DataFrame:
    """The damaged rows of the last day as a batch, added to those of the days before.

    Both are stored first, as rows that come in and rows that are there, and so are the ids they
    refer to. A filter on the damaged
    date would be moved below the expressions that damage it, and repeat all of them for each raw
    row, in each of the reads.
    """
    damaged, root = d.damaged(), f"{shared_folder(d.spark)}/damaged-{uuid.uuid4().hex}"

    def store(name: str, columns: Sequence[str | Column], *by: str) -> DataFrame:
        rows = getattr(damaged, name).select(*columns)
        rows.write.partitionBy(*by).parquet(f"{root}/{name}")
        return d.spark.read.schema(rows.schema).parquet(f"{root}/{name}")

    def flagged(name: str, date_column: str) -> list[str | Column]:
        is_new = F.coalesce(F.col(date_column).cast("date") == AS_OF, F.lit(True))
        return [*quality.ruled_columns(name), is_new.cast("int").alias("_new")]

    # One after the other: the plans of all of them together are large.
    rows = {name: store(name, flagged(name, c), "_new") for name, c in BATCH_DATE.items()}
    parents = {parent for name in rows for parent in RULES[name].references.values()} - rows.keys()
    ids = {parent: store(parent, ["id"]) for parent in sorted(parents)}

    def part(new: int) -> dict[str, DataFrame]:
        return {name: table.where(F.col("_new") == new).drop("_new") for name, table in rows.items()}

    return quality.check_batch(damaged.replace(**part(0), **ids), part(1))


def _view(name: str) -> Query:
    def query(d: TestData) -> DataFrame:
        manager.register_views(d.tables, AS_OF)
        return d.spark.sql(f"SELECT * FROM {name}")

    return query


def _json_rows(d: TestData) -> DataFrame:
    """Every user's priority list as JSON objects, read back."""
    listed = plain(merchants.prioritized_for_all(d.tables))
    return as_json(listed).select(F.from_json("json", listed.schema).alias("row")).select("row.*")


def _by_id_number() -> Column:
    return id_number(F.col("id"), "ms")


def _insert(d: TestData, target: DataFrame) -> DataFrame:
    return insert_ignore(target, d.next_day_signals(), SIGNAL_KEYS, _by_id_number())


def _upsert(d: TestData, target: DataFrame) -> DataFrame:
    return upsert(target, d.next_day_signals(), SIGNAL_KEYS, UPDATED_SIGNAL_COLUMNS, _by_id_number())


BATCH_DATE = PARTITION_COLUMN | {"audit_logs": "created_at"}
SIGNAL_KEYS = ["merchant_id", "signal_date"]

QUERIES: dict[str, Query] = {
    "q01_score_merchants": lambda d: scoring.score_merchants(
        d.tables.merchant_signals, active(d.tables.merchants)),
    "q02_roll_forward": lambda d: scoring.roll_forward_signals(
        d.tables.latest_signals, active(d.tables.merchants), d.signal_deltas(), AS_OF),
    "q02_reprofiled_scores": _reprofiled_scores,
    "q03_prioritized_admin": lambda d: merchants.prioritized_merchants(d.tables, ADMIN),
    "q03_prioritized_manager": lambda d: merchants.prioritized_merchants(d.tables, MANAGER, 50),
    "q03_prioritized_dsp": lambda d: merchants.prioritized_merchants(d.tables, DSP),
    "q03_prioritized_all": lambda d: merchants.prioritized_for_all(d.tables),
    "q04_details_all": lambda d: merchants.merchant_details(d.tables, ADMIN, AS_OF),
    "q04_details_manager": lambda d: merchants.merchant_details(d.tables, MANAGER, AS_OF),
    "q05_history_all": lambda d: merchants.merchant_history(d.tables, ADMIN),
    "q05_history_manager": lambda d: merchants.merchant_history(d.tables, MANAGER),
    "q06_find": lambda d: merchants.find_merchant(d.tables, NAME, ADMIN),
    "q06_find_indexed": lambda d: merchants.find_merchant(
        _indexed(d, clean_name(NAME), ("merchant_name",)), NAME, ADMIN),
    "q07_score": lambda d: merchants.merchant_score(d.tables, NAME, ADMIN, AS_OF),
    "q08_recs": lambda d: merchants.merchant_recommendations(d.tables, NAME, ADMIN, AS_OF),
    "q09_visits": lambda d: merchants.merchant_visits(d.tables, NAME, ADMIN),
    "q10_search": lambda d: merchants.search_merchants(d.tables, "asia", ADMIN, AS_OF),
    "q10_search_manager": lambda d: merchants.search_merchants(d.tables, "Build", MANAGER, AS_OF),
    "q10_search_indexed": lambda d: merchants.search_merchants(_indexed(d, "asia"), "asia", ADMIN, AS_OF),
    "q10_search_manager_indexed": lambda d: merchants.search_merchants(
        _indexed(d, "Build"), "Build", MANAGER, AS_OF),
    "q11_audit": lambda d: admin.audit_trail(d.tables, ADMIN),
    "q11_audit_filtered": lambda d: admin.audit_trail(d.tables, ADMIN, "view", 200),
    "q11_audit_page": lambda d: admin.audit_page(d.tables, ADMIN, "_data"),
    "q11_details": _details,
    "q11_by_detail": _by_detail,
    "q11_stored": lambda d: admin.audit_trail(_logged(d), ADMIN),
    "q11_stored_filtered": lambda d: admin.audit_trail(_logged(d), ADMIN, "view", 200),
    "q12_dsp": lambda d: dashboards.dsp_dashboard(d.tables, DSP, AS_OF),
    "q12_dsp_all": lambda d: dashboards.dashboards_for_all(d.tables, "DSP", AS_OF),
    "q13_manager": lambda d: dashboards.manager_dashboard(d.tables, MANAGER, AS_OF),
    "q13_manager_all": lambda d: dashboards.dashboards_for_all(d.tables, "Manager", AS_OF),
    "q14_admin": lambda d: dashboards.admin_dashboard(d.tables, ADMIN, AS_OF),
    "q15_area": lambda d: manager.area_summary(d.tables, AS_OF),
    "q16_area_admin": lambda d: manager.area_summary_for(d.tables, ADMIN, AS_OF),
    "q16_area_manager": lambda d: manager.area_summary_for(d.tables, MANAGER, AS_OF),
    "q17_totals_admin": lambda d: manager.area_totals(d.tables, ADMIN, AS_OF),
    "q17_totals_manager": lambda d: manager.area_totals(d.tables, MANAGER, AS_OF),
    "q18_visits_admin": lambda d: manager.visits_by_area(d.tables, ADMIN, AS_OF),
    "q18_visits_manager": lambda d: manager.visits_by_area(d.tables, MANAGER, AS_OF),
    "q19_dsp": lambda d: manager.dsp_performance(d.tables, AS_OF),
    "q20_team_admin": lambda d: manager.team_performance(d.tables, ADMIN, AS_OF),
    "q20_team_manager": lambda d: manager.team_performance(d.tables, MANAGER, AS_OF),
    "q21_users": lambda d: admin.list_users(d.tables, ADMIN),
    "q21_users_filtered": lambda d: admin.list_users(d.tables, ADMIN, "DSP", "ASIA", True, 500),
    "q22_merchants": lambda d: admin.list_merchants(d.tables, ADMIN),
    "q23_chat": lambda d: chat.chat_history(d.tables, MANAGER, 3),
    "q23_chat_all": lambda d: chat.chat_history_for_all(d.tables),
    "q24_profiles": lambda d: admin.user_profiles(d.tables),
    "q24_profiles_active": lambda d: admin.user_profiles(
        d.tables, d.user_deletes(), d.tables.users, active_only=True),
    "q25_context": lambda d: _context_fields(d, visits_per_part=25),
    "q25_context_whole": _context_fields,
    "q25_context_wanted": lambda d: _context_fields(
        d, MANAGER, d.tables.merchants.select(F.col("id").alias("merchant_id"))),
    "q26_users_by_role": _profile("users_by_role"),
    "q26_merchants_by_tier": _profile("merchants_by_tier"),
    "q26_merchants_by_region": _profile("merchants_by_region"),
    "q26_signals_today": _profile("signals_today"),
    "q26_top_merchants": _profile("top_merchants"),
    "q26_recommendation_status": _profile("recommendation_status"),
    "q26_areas": _profile("areas"),
    "m01_recs": lambda d: _m01(d).table,
    "m01_visits": lambda d: _m01(d).visits,
    "m01_audit": lambda d: _m01(d).audit,
    "m01_results": lambda d: _m01(d).results,
    "m01_rejects": lambda d: _m01(d).rejects,
    "m01_stored": _stored,
    "m02_recs": lambda d: _m02(d).table,
    "m02_rejects": lambda d: _m02(d).rejects,
    "m03_users": lambda d: _m03(d).table,
    "m03_audit": lambda d: _m03(d).audit,
    "m03_results": lambda d: _m03(d).results,
    "m03_rejects": lambda d: _m03(d).rejects,
    "m04_users": lambda d: _m04(d).table,
    "m04_results": lambda d: _m04(d).results,
    "m04_rejects": lambda d: _m04(d).rejects,
    "m05_users": lambda d: _m05(d).table,
    "m05_audit": lambda d: _m05(d).audit,
    "m05_results": lambda d: _m05(d).results,
    "m05_rejects": lambda d: _m05(d).rejects,
    "m06_users": lambda d: _m06(d).table,
    "m06_results": lambda d: _m06(d).results,
    "m06_audit": lambda d: _m06(d).audit,
    "m06_rejects": lambda d: _m06(d).rejects,
    "m07_merchants": lambda d: _m07(d).table,
    "m07_audit": lambda d: _m07(d).audit,
    "m07_results": lambda d: _m07(d).results,
    "m07_rejects": lambda d: _m07(d).rejects,
    "m07_bucketed": _assigned_bucketed,
    "m08_recs": lambda d: _m08(d).table,
    "m08_results": lambda d: _m08(d).results,
    "m08_rejects": lambda d: _m08(d).rejects,
    "m09_sessions": lambda d: _m09(d).table,
    "m09_messages": lambda d: d.tables.chat_messages.unionByName(_m09(d).messages),
    "m09_placed": lambda d: _m09(d).results,
    "s01_conform_scores": lambda d: conform("daily_scores", d.database_scores()),
    "s01_conform_messages": lambda d: conform("chat_messages", d.database_sessions()),
    "s01_conform_audit": lambda d: conform("audit_logs", d.database_logs()),
    "s02_landed": lambda d: _landed(d).tables().merchant_signals,
    "s02_bad_rows": _bad_rows,
    "s03_insert_ignore": lambda d: _insert(d, d.tables.merchant_signals),
    "s03_twice": lambda d: _insert(d, _insert(d, d.tables.merchant_signals)),
    "s03_bucketed": _insert_bucketed,
    "s04_upsert": lambda d: _upsert(d, d.tables.merchant_signals),
    "s04_twice": lambda d: _upsert(d, _upsert(d, d.tables.merchant_signals)),
    "s04_bucketed": _upsert_bucketed,
    "s05_area_view": _view("v_area_summary"),
    "s05_dsp_view": _view("v_dsp_performance"),
    "s05_kept": lambda d: _kept(d).area_summary(),
    "s05_kept_dsps": lambda d: _kept(d).dsp_performance(d.tables.users),
    "s05_kept_dashboards": lambda d: _kept(d).dashboards_for_all(d.tables.users, "Manager"),
    "s06_ids": lambda d: d.event_ids(),
    "s07_json": _json_rows,
    "d01_violations": lambda d: quality.check_constraints(d.damaged()),
    "d01_batch": _batch_violations,
    "f01_entitlements": lambda d: scope.entitlements(d.tables.users, d.tables.merchants),
}

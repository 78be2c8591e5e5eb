"""Change sets: the bulk form of single-row edits.

Each function takes a batch of changes with a unique, non-negative ``seq`` giving their
order, and returns the new version of the changed table, the audit rows, and the refused
changes with a code (400 bad value, 403 not allowed, 404 not found or out of scope, 409
taken, 500 breaks an integrity rule or has no content). Nothing is written here.

Checks look at the tables as they were before the batch, and at earlier changes of the
batch where these would take an e-mail address or remove a user. Of several accepted
changes to one row the last one stays, but each is audited.

With ``keep`` (``Store.apply`` gives one) the checked batch is written once and the parts read
it; without, each part checks the batch again when it runs.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbeat.functions.columns import day, instant
from fieldbeat.functions.joins import narrow, split_join
from fieldbeat.functions.merge import assign_ids
from fieldbeat.functions.ranking import top_per_key, with_position
from fieldbeat.schema import ROLES, STATUSES
from fieldbeat.sources.tables import Tables

# Accepted spellings of a status.
STATUS_NAMES = {
    "NEW": "New",
    "IN_PROGRESS": "In Progress",
    "DONE": "Done",
    "DEFERRED": "Deferred",
    "New": "New",
    "In Progress": "In Progress",
    "Done": "Done",
    "Deferred": "Deferred",
    "Pending": "New",
}

# The visit logged for a completed recommendation.
DONE_VISIT_NOTES = "Completed recommendation: "
DONE_VISIT_OUTCOME = "Recommendation fulfilled"
DONE_VISIT_MINUTES = 15
DONE_VISIT_TEXT_LENGTH = 200

# A saved brief.
BRIEF_EXPLANATION = "Live generated AI brief."
BRIEF_CONFIDENCE = "0.95"

USER_FIELDS = ("full_name", "email", "region", "area", "manager_id", "is_active")

# Every column that refers to a user.
USER_REFERENCES = (
    ("users", "manager_id"),
    ("merchants", "assigned_dsp_id"),
    ("recommendations", "status_updated_by"),
    ("visit_history", "dsp_id"),
    ("audit_logs", "user_id"),
    ("chat_sessions", "user_id"),
)


class ChangeSet:
    """What a batch does to the table ``name``. Parts are built when first asked for, and
    are None where a batch of this kind has no such part.

    - ``table``: the table after the changes, in full
    - ``touched``: the values of its partition column, if no other partitions change
    - ``rejects``: seq, code and reason of the refused changes
    - ``results``: one row per accepted change, as reported back to its sender
    - ``audit``, ``visits``, ``messages``: rows to add to the audit log, the visit history
      and the chat messages
    """

    PARTS = ("table", "touched", "rejects", "results", "audit", "visits", "messages")

    def __init__(self, name: str, **parts: Callable[[], DataFrame]):
        self.name, self._parts = name, parts

    def __getattr__(self, part: str) -> DataFrame | None:
        if part not in self.PARTS:
            raise AttributeError(part)
        build = self._parts.get(part)
        frame = None if build is None else build()
        setattr(self, part, frame)
        return frame


Keep = Callable[[DataFrame], DataFrame]


def as_is(df: DataFrame) -> DataFrame:
    return df


class _Checked:
    """Changes with the first failed check of each; checks apply in the order given."""

    def __init__(self, changes: DataFrame, *checks: tuple[Column, int, str], keep: Keep = as_is):
        failure = F.lit(None).cast("struct<code: int, reason: string>")
        for failed, code, reason in reversed(checks):
            found = F.struct(F.lit(code).alias("code"), F.lit(reason).alias("reason"))
            failure = F.when(F.coalesce(failed, F.lit(True)), found).otherwise(failure)
        rows = keep(changes.withColumn("_failure", failure))
        self.accepted = rows.where(F.col("_failure").isNull()).drop("_failure")
        self._refused = rows.where(F.col("_failure").isNotNull())

    def rejects(self) -> DataFrame:
        return self._refused.select("seq", "_failure.code", "_failure.reason")


def _lookup(rows: DataFrame, table: DataFrame, key: str, changes: DataFrame) -> DataFrame:
    """``rows`` of a batch with the columns of a table, which is unique on ``key``."""
    return split_join(rows, narrow(table, changes, key), key, "left")


def _not_admin() -> tuple[Column, int, str]:
    return F.col("caller_role") != "Admin", 403, "only an Admin may do this"


def _bad_role() -> tuple[Column, int, str]:
    return ~F.col("role").isin(*ROLES), 400, "unknown role"


def append_audit(
    tables: Tables,
    accepted: DataFrame,
    now: datetime,
    user: str,
    action: str,
    resource: str,
    resource_id: Column | None = None,
    details: Column | None = None,
) -> DataFrame:
    """One new audit row per accepted change, numbered on from the stored ones."""
    none = F.lit(None).cast("string")
    rows = accepted.select(
        "seq", F.col(user).alias("user_id"), F.lit(action).alias("action"),
        F.lit(resource).alias("resource"),
        (none if resource_id is None else resource_id).alias("resource_id"),
        (none if details is None else details).alias("details"), none.alias("ip_address"),
        instant(now).alias("created_at"),
    )
    numbered = assign_ids(rows, "al", F.col("seq"), tables.last_number("audit_logs"))
    return numbered.select(*tables.audit_logs.columns)


def _updated(table: DataFrame, last: DataFrame, values: dict[str, Column]) -> DataFrame:
    """The table with ``values`` set on rows whose id is a ``new_id`` of ``last`` (unique)."""
    joined = table.join(
        last.withColumn("_hit", F.lit(True)), table["id"] == last["new_id"], "left")
    return joined.select(*[
        F.when(F.col("_hit"), values[c]).otherwise(table[c]).alias(c) if c in values else table[c]
        for c in table.columns
    ])


# Recommendations


class _StatusChanges:
    """Status changes checked, and the recommendations after them."""

    def __init__(
        self, tables: Tables, changes: DataFrame, names: dict[str, str], keep: Keep
    ):
        self.tables = tables
        stored = F.create_map(*[F.lit(v) for pair in names.items() for v in pair])
        recs = tables.recommendations.select(
            F.col("id").alias("rec_id"), "merchant_id", "recommended_action",
            "recommendation_date")
        owners = tables.merchants.select(F.col("id").alias("merchant_id"), "assigned_dsp_id")
        self.targets = narrow(recs, changes, "rec_id").join(owners, "merchant_id")
        self.named = changes.withColumn("new_status", F.element_at(stored, F.col("status")))
        self.checked = _Checked(
            split_join(self.named, self.targets, "rec_id", "left"),
            (F.col("new_status").isNull(), 400, "unknown status"),
            (F.col("role") != "DSP", 403, "only a DSP may update a status"),
            (F.col("assigned_dsp_id") != F.col("user_id"), 404, "recommendation not found"),
            keep=keep,
        )

    def last(self) -> DataFrame:
        """The change that stays, per recommendation.

        The last change of each user is taken before the join: a recommendation with very
        many changes is one row per user there, of which the owner's is kept.
        """
        by_user = self.named.where(
            F.col("new_status").isNotNull() & (F.col("role") == "DSP")
        ).groupBy("rec_id", "user_id").agg(F.max_by("new_status", "seq").alias("new_status"))
        return split_join(by_user, self.targets, "rec_id").where(
            F.col("assigned_dsp_id") == F.col("user_id"))

    def table(self, now: datetime) -> DataFrame:
        last = self.last().select(
            F.col("rec_id").alias("new_id"), F.col("user_id").alias("new_user"), "new_status")
        return _updated(self.tables.recommendations, last, {
            "status": F.col("new_status"),
            "status_updated_at": instant(now),
            "status_updated_by": F.col("new_user"),
        })

    def touched(self) -> DataFrame:
        return self.last().select("recommendation_date")

    def results(self, now: datetime) -> DataFrame:
        return self.checked.accepted.select(
            "seq", "rec_id", F.col("new_status").alias("status"), instant(now).alias("updated_at"))

    def visits(self, as_of: date, now: datetime) -> DataFrame:
        """A visit for each completed recommendation."""
        text = F.substring(F.coalesce("recommended_action", F.lit("")), 1, DONE_VISIT_TEXT_LENGTH)
        done = self.checked.accepted.where(F.col("new_status") == "Done").select(
            "seq", "merchant_id", F.col("user_id").alias("dsp_id"),
            day(as_of).alias("visit_date"),
            F.concat(F.lit(DONE_VISIT_NOTES), text).alias("visit_notes"),
            F.lit(DONE_VISIT_OUTCOME).alias("outcome"),
            F.lit(DONE_VISIT_MINUTES).alias("duration_mins"),
            instant(now).alias("created_at"),
        )
        stored = self.tables.visit_history
        numbered = assign_ids(done, "vh", F.col("seq"), self.tables.last_number("visit_history"))
        return numbered.select(*stored.columns)


def apply_status_updates(
    tables: Tables, changes: DataFrame, as_of: date, now: datetime, keep: Keep = as_is
) -> ChangeSet:
    """Status changes (seq, rec_id, status, user_id, role) by the assigned DSPs.

    Synonyms of a status are accepted. A completed recommendation also logs a visit.
    """
    status = _StatusChanges(tables, changes, STATUS_NAMES, keep)
    return ChangeSet(
        "recommendations",
        table=lambda: status.table(now),
        touched=status.touched,
        rejects=status.checked.rejects,
        results=lambda: status.results(now),
        audit=lambda: append_audit(
            tables, status.checked.accepted, now, "user_id", "UPDATE_ACTION_STATUS",
            "recommendation"),
        visits=lambda: status.visits(as_of, now),
    )


def apply_actions(
    tables: Tables, changes: DataFrame, now: datetime, keep: Keep = as_is
) -> ChangeSet:
    """Status changes by tools: stored status names only, no visit and no audit row."""
    status = _StatusChanges(tables, changes, {name: name for name in STATUSES}, keep)
    return ChangeSet(
        "recommendations",
        table=lambda: status.table(now),
        touched=status.touched,
        rejects=status.checked.rejects,
        results=lambda: status.results(now),
    )


def replace_briefs(
    tables: Tables, briefs: DataFrame, as_of: date, now: datetime, keep: Keep = as_is
) -> ChangeSet:
    """Saves briefs (seq, merchant_id, text, user_id, role): a merchant's new brief takes
    the place of all its recommendations. The caller must see the merchant."""
    owners = tables.merchants.select("assigned_dsp_id", F.col("id").alias("merchant_id"),
                                     F.lit(True).alias("_known"))
    heads = tables.users.select(
        F.col("id").alias("assigned_dsp_id"), F.col("manager_id").alias("head_id"))
    wanted = narrow(owners, briefs, "merchant_id")
    seen = split_join(wanted, heads, "assigned_dsp_id", "left")
    looked_up = split_join(briefs, seen, "merchant_id", "left")
    role, own = F.col("role"), F.col("assigned_dsp_id") == F.col("user_id")
    managed = (role == "Manager") & F.coalesce(F.col("head_id") == F.col("user_id"), F.lit(False))
    visible = (role == "Admin") | own | managed
    checked = _Checked(
        looked_up,
        (~role.isin(*ROLES), 403, "unknown role"),
        (F.col("_known").isNull() | ~visible, 404, "merchant not found"),
        (F.coalesce("text", F.lit("")) == "", 500, "no brief"),
        keep=keep,
    )
    numbered = assign_ids(
        checked.accepted.select("seq", "merchant_id", "text", "user_id"),
        "r", F.col("seq"), tables.last_number("recommendations"))

    def table() -> DataFrame:
        saved = top_per_key(numbered, ["merchant_id"], [F.desc("seq")]).select(
            "id", "merchant_id", F.col("text").alias("recommended_action"),
            F.lit(BRIEF_EXPLANATION).alias("action_explanation"),
            F.lit(BRIEF_CONFIDENCE).cast("decimal(3,2)").alias("confidence_score"),
            F.lit("New").alias("status"),
            instant(now).alias("status_updated_at"),
            F.col("user_id").alias("status_updated_by"),
            day(as_of).alias("recommendation_date"),
            instant(now).alias("created_at"),
        )
        briefed = saved.select("merchant_id")
        kept = split_join(tables.recommendations, briefed, "merchant_id", "left_anti")
        return kept.unionByName(saved)

    def touched() -> DataFrame:
        """The dates of what the briefs replace, and the day they are saved on."""
        gone = split_join(
            tables.recommendations, checked.accepted.select("merchant_id"), "merchant_id", "left_semi")
        saved = checked.accepted.select(day(as_of).alias("recommendation_date"))
        return gone.select("recommendation_date").unionByName(saved)

    return ChangeSet(
        "recommendations",
        table=table,
        touched=touched,
        rejects=checked.rejects,
        results=lambda: numbered.select(
            "seq", F.col("id").alias("rec_id"), "merchant_id", "text"),
    )


# Users


def create_users(
    tables: Tables, changes: DataFrame, now: datetime, keep: Keep = as_is
) -> ChangeSet:
    """New users (seq, caller_id, caller_role, email, password, full_name, role, region,
    area, manager_id). Of several with one address the first acceptable one gets it."""
    stored = tables.users.select("email", F.lit(True).alias("_taken"))
    looked_up = _lookup(
        _lookup(changes, stored, "email", changes), _managers(tables), "manager_id", changes)
    no_manager = F.col("manager_id").isNotNull() & F.col("_manager").isNull()
    before = [_not_admin(), _bad_role(), (F.col("_taken").isNotNull(), 409, "e-mail taken")]
    manager = (no_manager, 500, "unknown manager")
    first = _Checked(looked_up, *before, manager).accepted.groupBy("email").agg(
        F.min("seq").alias("_first"))
    late = (F.coalesce(F.col("_first") < F.col("seq"), F.lit(False)), 409, "e-mail taken")
    checked = _Checked(
        split_join(looked_up, first, "email", "left"), *before, late, manager, keep=keep)
    created = assign_ids(
        checked.accepted, "u", F.col("seq"), tables.last_number("users"))

    def table() -> DataFrame:
        return tables.users.unionByName(created.select(
            "id", "email", F.sha2("password", 256).alias("password_hash"), "full_name", "role",
            "region", "area", "manager_id", F.lit(True).alias("is_active"),
            instant(now).alias("created_at"), instant(now).alias("updated_at"),
        ))

    return ChangeSet(
        "users",
        table=table,
        rejects=checked.rejects,
        results=lambda: created.select(
            "seq", F.col("id").alias("user_id"), "email", "full_name", "role"),
        audit=lambda: append_audit(
            tables, checked.accepted, now, "caller_id", "CREATE_USER", "user"),
    )


def _managers(tables: Tables) -> DataFrame:
    return tables.users.select(F.col("id").alias("manager_id"), F.lit(True).alias("_manager"))


def _known_users(tables: Tables) -> DataFrame:
    return tables.users.select(
        F.col("id").alias("user_id"), F.col("full_name").alias("old_name"),
        F.col("role").alias("stored_role"))


def update_users(
    tables: Tables, changes: DataFrame, now: datetime, keep: Keep = as_is
) -> ChangeSet:
    """Edits (seq, caller_id, caller_role, user_id and the six ``USER_FIELDS``): only
    non-null fields change. An address counts as taken if another user has it, or an
    earlier accepted change of the batch gives it to another user. No audit rows."""
    holders = tables.users.select("email", F.col("id").alias("_holder"))
    looked_up = _lookup(changes, _known_users(tables), "user_id", changes)
    looked_up = _lookup(looked_up, holders, "email", changes)
    looked_up = _lookup(looked_up, _managers(tables), "manager_id", changes)
    given = F.coalesce(*[F.col(c).cast("string") for c in USER_FIELDS])
    other_holder = F.coalesce(F.col("_holder") != F.col("user_id"), F.lit(False))
    no_manager = F.col("manager_id").isNotNull() & F.col("_manager").isNull()
    checks = [
        _not_admin(),
        (given.isNull(), 400, "no fields"),
        (F.col("stored_role").isNull(), 404, "user not found"),
        (other_holder, 500, "e-mail taken"),
        (no_manager, 500, "unknown manager"),
    ]
    claims = _Checked(looked_up, *checks).accepted.where(F.col("email").isNotNull()).groupBy(
        "email").agg(F.min_by("user_id", "seq").alias("_claimed_by"))
    late = F.coalesce(F.col("_claimed_by") != F.col("user_id"), F.lit(False))
    checked = _Checked(
        split_join(looked_up, claims, "email", "left"), *checks, (late, 500, "e-mail taken"),
        keep=keep)

    def table() -> DataFrame:
        last = checked.accepted.groupBy(F.col("user_id").alias("new_id")).agg(*[
            F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"new_{c}")
            for c in USER_FIELDS
        ])
        values = {c: F.coalesce(F.col(f"new_{c}"), tables.users[c]) for c in USER_FIELDS}
        return _updated(tables.users, last, values | {"updated_at": instant(now)})

    def results() -> DataFrame:
        """The user of each change as the whole batch leaves it."""
        after = table().select(
            F.col("id").alias("user_id"), "full_name", "email", "role", "is_active")
        return split_join(checked.accepted.select("seq", "user_id"), after, "user_id")

    return ChangeSet(
        "users",
        table=table,
        rejects=checked.rejects,
        results=results,
    )


def delete_users(
    tables: Tables, changes: DataFrame, now: datetime, keep: Keep = as_is
) -> ChangeSet:
    """Removes users (seq, caller_id, caller_role, user_id) for good, unless some row refers
    to them. Each referring column shrinks to its distinct users before the join."""
    referring = [
        getattr(tables, name).select(F.col(column).alias("user_id")).distinct()
        for name, column in USER_REFERENCES
    ]
    referred = referring[0]
    for ids in referring[1:]:
        referred = referred.unionByName(ids)
    referred = referred.distinct().withColumn("_referred", F.lit(True))
    users = _known_users(tables).join(referred, "user_id", "left")
    # Who is first to remove a user is settled per user, before the changes meet the users.
    first = changes.where(~_not_admin()[0]).groupBy("user_id").agg(F.min("seq").alias("_first"))
    checked = _Checked(
        _lookup(changes, users.join(first, "user_id", "left"), "user_id", changes),
        _not_admin(),
        (F.col("stored_role").isNull(), 404, "user not found"),
        (F.col("_referred").isNotNull(), 500, "user is referred to"),
        (F.col("_first") != F.col("seq"), 404, "user not found"),
        keep=keep,
    )
    accepted = checked.accepted
    return ChangeSet(
        "users",
        table=lambda: tables.users.join(
            accepted.select(F.col("user_id").alias("id")), "id", "left_anti"),
        rejects=checked.rejects,
        results=lambda: accepted.select("seq", "user_id", F.col("old_name").alias("full_name")),
        audit=lambda: append_audit(
            tables, accepted, now, "caller_id", "DEACTIVATE_USER", "user"),
    )


def assign_roles(
    tables: Tables, changes: DataFrame, now: datetime, keep: Keep = as_is
) -> ChangeSet:
    """Role changes (seq, caller_id, caller_role, user_id, role), reporting old and new role.

    The old role of a user's second and later change is that of the change before it.
    """
    checked = _Checked(
        _lookup(changes, _known_users(tables), "user_id", changes),
        _not_admin(), _bad_role(), (F.col("stored_role").isNull(), 404, "user not found"),
        keep=keep)
    accepted = checked.accepted

    def table() -> DataFrame:
        valid = changes.where(~_not_admin()[0] & ~_bad_role()[0])
        last = valid.groupBy(F.col("user_id").alias("new_id")).agg(
            F.max_by("role", "seq").alias("new_role"))
        return _updated(
            tables.users, last, {"role": F.col("new_role"), "updated_at": instant(now)})

    def results() -> DataFrame:
        placed = with_position(accepted, F.col("seq"), ["user_id"], "_nth")
        before = placed.select("user_id", (F.col("_nth") + 1).alias("_nth"),
                               F.col("role").alias("_role_before"))
        return placed.join(before, ["user_id", "_nth"], "left").select(
            "seq", "user_id", F.col("old_name").alias("full_name"),
            F.coalesce("_role_before", "stored_role").alias("old_role"),
            F.col("role").alias("new_role"),
        )

    return ChangeSet(
        "users",
        table=table,
        rejects=checked.rejects,
        results=results,
        audit=lambda: append_audit(tables, accepted, now, "caller_id", "ROLE_CHANGE", "user"),
    )


# Merchants


def assign_merchants(
    tables: Tables, changes: DataFrame, now: datetime, keep: Keep = as_is
) -> ChangeSet:
    """Gives merchants to DSPs (seq, caller_id, caller_role, merchant_id, assigned_dsp_id)."""
    targets = tables.users.select(
        F.col("id").alias("assigned_dsp_id"), F.col("full_name").alias("dsp_name"),
        F.col("role").alias("target_role"))
    known = tables.merchants.select(F.col("id").alias("merchant_id"), "merchant_name")
    aimed = _lookup(changes, targets, "assigned_dsp_id", changes)
    checked = _Checked(
        _lookup(aimed, known, "merchant_id", changes),
        _not_admin(),
        (F.col("target_role").isNull(), 404, "DSP not found"),
        (F.col("target_role") != "DSP", 400, "user is not a DSP"),
        (F.col("merchant_name").isNull(), 404, "merchant not found"),
        keep=keep,
    )
    accepted = checked.accepted

    def table() -> DataFrame:
        valid = aimed.where(~_not_admin()[0] & (F.col("target_role") == "DSP"))
        last = valid.groupBy(F.col("merchant_id").alias("new_id")).agg(
            F.max_by("assigned_dsp_id", "seq").alias("new_dsp"))
        return _updated(
            tables.merchants, last,
            {"assigned_dsp_id": F.col("new_dsp"), "updated_at": instant(now)})

    return ChangeSet(
        "merchants",
        table=table,
        rejects=checked.rejects,
        results=lambda: accepted.select("seq", "merchant_id", "merchant_name", "assigned_dsp_id"),
        audit=lambda: append_audit(
            tables, accepted, now, "caller_id", "ASSIGN_MERCHANT", "merchant",
            F.col("merchant_id"), F.to_json(F.struct("assigned_dsp_id", "dsp_name"))),
    )

"""Chat sessions: history reads and bulk appends."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldbeat.functions.columns import clamp, id_number, instant
from fieldbeat.functions.joins import left_join_many, narrow, split_join
from fieldbeat.functions.merge import assign_ids
from fieldbeat.functions.ranking import first_rows, top_per_key, with_position
from fieldbeat.operators.changes import ChangeSet, Keep, as_is
from fieldbeat.operators.scope import Caller
from fieldbeat.sources.tables import Tables

TITLE_LENGTH = 100


def _newest() -> list:
    return [F.desc_nulls_first("updated_at"), id_number(F.col("session_id"), "cs")]


def _sessions(tables: Tables) -> DataFrame:
    return tables.chat_sessions.select(
        F.col("id").alias("session_id"), "user_id", "title", "created_at", "updated_at")


def chat_history(tables: Tables, caller: Caller, limit: int = 20) -> DataFrame:
    """The caller's most recently used sessions, one row per message, in order.

    A session without messages is one row with nulls.
    """
    own = _sessions(tables).where(F.col("user_id") == caller.user_id)
    page = first_rows(own, _newest(), clamp(limit, 100))
    return left_join_many(page, tables.chat_messages, "session_id").drop("user_id").orderBy(
        *_newest(), "position")


def chat_history_for_all(tables: Tables, limit: int = 20) -> DataFrame:
    """``chat_history`` of every user, with ``user_id``, in one job."""
    pages = top_per_key(_sessions(tables), ["user_id"], _newest(), clamp(limit, 100))
    return left_join_many(pages, tables.chat_messages, "session_id")


def append_chats(
    tables: Tables, turns: DataFrame, now: datetime, keep: Keep = as_is
) -> ChangeSet:
    """Appends question and answer of each turn (seq, user_id, session_id, message, answer).

    A turn goes to the session it names if that exists and belongs to the user; any other
    turn opens a session of its own, titled by the start of the message. ``seq`` is unique
    and gives the order; positions follow the session's last message. Results are seq,
    session_id and is_new.
    """
    owned = tables.chat_sessions.select(F.col("id").alias("session_id"), "user_id")
    owned_turns = turns.join(owned, ["session_id", "user_id"], "left_semi")
    known = keep(owned_turns.select(*turns.columns))
    fresh = turns.join(known.select("seq"), "seq", "left_anti").drop("session_id")
    opened = keep(assign_ids(
        fresh, "cs", F.col("seq"), tables.last_number("chat_sessions"), "session_id"))

    def sessions() -> DataFrame:
        touched = known.select(F.col("session_id").alias("id")).distinct()
        updated = F.when(F.col("_touched"), instant(now)).otherwise(F.col("updated_at"))
        kept = tables.chat_sessions.join(
            touched.withColumn("_touched", F.lit(True)), "id", "left"
        ).withColumn("updated_at", updated).select(*tables.chat_sessions.columns)
        return kept.unionByName(opened.select(
            F.col("session_id").alias("id"), "user_id",
            F.substring("message", 1, TITLE_LENGTH).alias("title"),
            instant(now).alias("created_at"), instant(now).alias("updated_at"),
        ))

    def messages() -> DataFrame:
        columns = ["session_id", "seq", "message", "answer"]
        ends = narrow(tables.chat_messages, known, "session_id").groupBy("session_id").agg(
            F.max("position").alias("_last"))
        numbered = with_position(known.select(*columns), F.col("seq"), ["session_id"], "_turn")
        first = opened.select(*columns, F.lit(1).cast("bigint").alias("_turn"),
                              F.lit(None).cast("bigint").alias("_last"))
        placed = split_join(numbered, ends, "session_id", "left").unionByName(first)
        start = F.coalesce(F.col("_last") + 1, F.lit(0)) + 2 * (F.col("_turn") - 1)
        pair = F.array(
            F.struct(start.alias("position"), F.lit("user").alias("role"),
                     F.col("message").alias("content")),
            F.struct((start + 1).alias("position"), F.lit("assistant").alias("role"),
                     F.col("answer").alias("content")),
        )
        return placed.select("session_id", F.inline(pair))

    return ChangeSet(
        "chat_sessions",
        table=sessions,
        messages=messages,
        results=lambda: known.select(
            "seq", "session_id", F.lit(False).alias("is_new")
        ).unionByName(opened.select("seq", "session_id", F.lit(True).alias("is_new"))),
    )

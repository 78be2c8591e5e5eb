"""Table schemas, fixed value sets and integrity rules of the field-sales model.

All instants are UTC and kept as ``timestamp_ntz``, so no result depends on the
time zone of the session. A chat session's messages are rows of their own
(``chat_messages``) because one session may grow without bound.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values.
ROLES = ("DSP", "Manager", "Admin")
TIERS = ("Gold", "Silver", "Bronze", "New")
CAMPAIGN_STATUSES = ("Active", "Inactive", "Pending", "None")
STATUSES = ("New", "In Progress", "Done", "Deferred")
OPEN_STATUSES = ("New", "In Progress")

SCORE_TYPE = "decimal(5,2)"
BREAKDOWN_TYPE = (
    "struct<transaction: decimal(4,1), recency: decimal(4,1), "
    "tier: decimal(4,1), complaints: decimal(4,1)>"
)

# Columns with their types, and below the rules on them.
SCHEMAS = {
    "users": """
        id string, email string, password_hash string, full_name string, role string,
        region string, area string, manager_id string, is_active boolean,
        created_at timestamp_ntz, updated_at timestamp_ntz""",
    "merchants": """
        id string, merchant_name string, region string, area string, tier string,
        category string, contact_number string, address string,
        latitude decimal(10,7), longitude decimal(10,7), assigned_dsp_id string,
        is_active boolean, onboarding_date date,
        created_at timestamp_ntz, updated_at timestamp_ntz""",
    "merchant_signals": """
        id string, merchant_id string, signal_date date, transaction_volume int,
        transaction_trend decimal(5,2), days_since_visit int, complaint_count int,
        campaign_status string, wallet_balance decimal(12,2), active_products int,
        created_at timestamp_ntz""",
    "daily_scores": f"""
        id string, merchant_id string, score_date date, priority_score {SCORE_TYPE},
        rank int, score_breakdown {BREAKDOWN_TYPE}, created_at timestamp_ntz""",
    "recommendations": """
        id string, merchant_id string, recommended_action string,
        action_explanation string, confidence_score decimal(3,2), status string,
        status_updated_at timestamp_ntz, status_updated_by string,
        recommendation_date date, created_at timestamp_ntz""",
    "visit_history": """
        id string, merchant_id string, dsp_id string, visit_date date,
        visit_notes string, outcome string, duration_mins int,
        created_at timestamp_ntz""",
    "audit_logs": """
        id string, user_id string, action string, resource string,
        resource_id string, details string, ip_address string, created_at timestamp_ntz""",
    "chat_sessions": """
        id string, user_id string, title string,
        created_at timestamp_ntz, updated_at timestamp_ntz""",
    "chat_messages": """
        session_id string, position bigint, role string, content string""",
}

ID_PREFIX = {
    "users": "u",
    "merchants": "m",
    "merchant_signals": "ms",
    "daily_scores": "ds",
    "recommendations": "r",
    "visit_history": "vh",
    "audit_logs": "al",
    "chat_sessions": "cs",
}

# Directory partitioning of the stored tables: every read of "today" touches one directory.
PARTITION_COLUMN = {
    "merchant_signals": "signal_date",
    "daily_scores": "score_date",
    "recommendations": "recommendation_date",
    "visit_history": "visit_date",
}

# Tables to which batches only add rows; each row carries the name of the attempt that added it.
ATTEMPT_COLUMN = "attempt"
ADDED_TABLES = ("visit_history", "audit_logs", "chat_messages", "bad_rows")

# Logs by the date of an instant, in a column that only the stored table has.
LOG_DATE = {"audit_logs": ("created_on", "created_at")}

# Rows of landed files that could not be taken, with their text and what is wrong with them.
BAD_ROWS = "table_name string, file string, row string, reason string"

# The newest row of each merchant, kept beside a table with its date.
LATEST = {"latest_signals": "merchant_signals", "latest_scores": "daily_scores"}


@dataclass(frozen=True)
class Rules:
    """Integrity rules of one table; Spark tables do not enforce them."""

    unique: tuple[tuple[str, ...], ...]
    not_null: tuple[str, ...] = ()
    allowed: dict[str, tuple[str, ...]] = field(default_factory=dict)
    references: dict[str, str] = field(default_factory=dict)
    max_length: dict[str, int] = field(default_factory=dict)


RULES = {
    "users": Rules(
        unique=(("id",), ("email",)),
        not_null=("id", "email", "password_hash", "full_name", "role"),
        allowed={"role": ROLES},
        references={"manager_id": "users"},
        max_length={"id": 20, "email": 255, "password_hash": 255, "full_name": 255,
                    "role": 20, "region": 100, "area": 100},
    ),
    "merchants": Rules(
        unique=(("id",),),
        not_null=("id", "merchant_name", "region", "assigned_dsp_id"),
        allowed={"tier": TIERS},
        references={"assigned_dsp_id": "users"},
        max_length={"id": 20, "merchant_name": 255, "region": 100, "area": 100, "tier": 20,
                    "category": 100, "contact_number": 20},
    ),
    "merchant_signals": Rules(
        unique=(("id",), ("merchant_id", "signal_date")),
        not_null=("id", "merchant_id", "signal_date"),
        allowed={"campaign_status": CAMPAIGN_STATUSES},
        references={"merchant_id": "merchants"},
        max_length={"id": 20, "campaign_status": 20},
    ),
    "daily_scores": Rules(
        unique=(("id",), ("merchant_id", "score_date")),
        not_null=("id", "merchant_id", "score_date", "priority_score"),
        references={"merchant_id": "merchants"},
        max_length={"id": 20},
    ),
    "recommendations": Rules(
        unique=(("id",),),
        not_null=("id", "merchant_id", "recommended_action"),
        allowed={"status": STATUSES},
        references={"merchant_id": "merchants", "status_updated_by": "users"},
        max_length={"id": 20, "status": 20},
    ),
    "visit_history": Rules(
        unique=(("id",),),
        not_null=("id", "merchant_id", "dsp_id", "visit_date"),
        references={"merchant_id": "merchants", "dsp_id": "users"},
        max_length={"id": 20, "outcome": 50},
    ),
    "audit_logs": Rules(
        unique=(("id",),),
        not_null=("id", "action"),
        references={"user_id": "users"},
        max_length={"id": 20, "action": 100, "resource": 100, "resource_id": 20},
    ),
    "chat_sessions": Rules(
        unique=(("id",),),
        not_null=("id", "user_id"),
        references={"user_id": "users"},
        max_length={"id": 20, "title": 255},
    ),
    "chat_messages": Rules(
        unique=(("session_id", "position"),),
        not_null=("session_id", "position"),
        references={"session_id": "chat_sessions"},
    ),
}

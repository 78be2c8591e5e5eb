"""SQL for the registered queries over the raw test tables, for DuckDB.

``CTES`` restates the test data mapping and the shared steps; each query is prefixed by
the CTEs it needs.
"""

from __future__ import annotations

import re
from datetime import date

from fieldbeat.schema import ID_PREFIX, PARTITION_COLUMN, RULES
from fieldbeat.sources.testdata import DAMAGE_ID, DAMAGE_STEP, LANDING_STEP, damages

AS_OF = "DATE '2024-01-30'"
NOW = "TIMESTAMP '2024-01-30 12:00:00'"
EARLIER = "TIMESTAMP '2024-01-28 09:00:00'"


def gid(prefix: str, number: str) -> str:
    return (
        f"('{prefix}' || CASE WHEN {number} < 10 THEN '0' ELSE '' END"
        f" || CAST({number} AS VARCHAR))"
    )


def num(column: str, prefix: str) -> str:
    return f"CAST(substr({column}, {len(prefix) + 1}) AS BIGINT)"


def pct(part: str, whole: str) -> str:
    """part / whole in percent, one decimal, half up, in integers; null for 0."""
    return f"CASE WHEN {whole} > 0 THEN ((2000 * ({part}) + {whole}) // (2 * {whole})) / 10.0 END"


def has(column: str, text: str) -> str:
    return f"{column} ILIKE '%{text}%' ESCAPE '\\'"


def zero_null(column: str) -> str:
    return f"CASE WHEN {column} <> 0 THEN CAST({column} AS DOUBLE) END"


N_SUP = "(SELECT count(*) FROM supplier)"
N_USR = "(SELECT count(*) + 6 FROM supplier)"
N_ORD = "(SELECT count(*) FROM orders)"
N_CUS = "(SELECT count(*) FROM customer)"

REP_NUMBER = "(s_suppkey + 7)"
MERCHANT_NUMBER = "(c_custkey + 1)"
OWNER_NUMBER = f"(7 + c_custkey % {N_SUP})"
ORDER_CUSTOMER = "(CASE WHEN o_custkey % 53 = 7 THEN o_custkey - 1 ELSE o_custkey END)"
ORDER_OWNER_NUMBER = f"(7 + {ORDER_CUSTOMER} % {N_SUP})"
CONV_USER_NUMBER = f"(1 + conv_id % {N_USR})"
USER_TARGET = (
    f"CASE WHEN s_suppkey % 9 = 8 THEN {gid('u', f'(s_suppkey + 7 + {N_SUP})')}"
    f" ELSE {gid('u', REP_NUMBER)} END"
)
CALLER = (
    "s_suppkey AS seq, 'u01' AS caller_id,"
    " CASE WHEN s_suppkey % 17 = 0 THEN 'Manager' ELSE 'Admin' END AS caller_role"
)
TIER_KEY = "((c_nationkey * 3 + c_custkey // 7) % 20)"

CTES = {
    "nations": "SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey",
    "users_base": f"""
        SELECT 'u01' AS id, 'admin.africa@example.com' AS email, 'System Admin' AS full_name,
            'Admin' AS role, 'AFRICA' AS region, CAST(NULL AS VARCHAR) AS area,
            CAST(NULL AS VARCHAR) AS manager_id, TRUE AS is_active
        UNION ALL
        SELECT {gid('u', '(r_regionkey + 2)')}, 'mgr' || r_regionkey || '@example.com',
            'Manager ' || r_name, 'Manager', r_name, NULL, NULL, TRUE
        FROM region
        UNION ALL
        SELECT {gid('u', REP_NUMBER)}, 'dsp' || s_suppkey || '@example.com', s_name, 'DSP',
            r_name, n_name, {gid('u', '(r_regionkey + 2)')}, s_suppkey % 20 <> 19
        FROM supplier JOIN nations ON s_nationkey = n_nationkey""",
    "users": f"""
        SELECT id, email, sha256(email) AS password_hash, full_name, role, region, area,
            manager_id, is_active, {NOW} AS created_at, {NOW} AS updated_at
        FROM users_base""",
    "merchants": f"""
        SELECT {gid('m', MERCHANT_NUMBER)} AS id, c_name AS merchant_name, r_name AS region,
            CASE WHEN (c_custkey // 11) % 40 <> 0 THEN n_name END AS area,
            CASE WHEN {TIER_KEY} < 2 THEN 'Gold' WHEN {TIER_KEY} < 7 THEN 'Silver'
                WHEN {TIER_KEY} < 15 THEN 'Bronze' ELSE 'New' END AS tier,
            c_mktsegment AS category, '+639' || right(c_name, 9) AS contact_number,
            c_custkey || ' Main St., ' || n_name AS address,
            CAST((c_custkey % 115) / 10.0 AS DECIMAL(10,7)) AS latitude,
            CAST(120 + (c_custkey % 70) / 10.0 AS DECIMAL(10,7)) AS longitude,
            {gid('u', OWNER_NUMBER)} AS assigned_dsp_id,
            (c_custkey // 3 + c_nationkey) % 25 <> 0 AS is_active,
            DATE '2022-01-01' + CAST(c_custkey % 730 AS INTEGER) AS onboarding_date,
            {NOW} AS created_at, {NOW} AS updated_at
        FROM customer JOIN nations ON c_nationkey = n_nationkey""",
    "signals_grouped": f"""
        SELECT {ORDER_CUSTOMER} AS o_custkey, o_orderkey % 7 AS days_ago, min(o_orderkey) AS k,
            sum(CAST(o_totalprice AS DECIMAL(12,2))) AS total,
            count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS urgent
        FROM orders GROUP BY {ORDER_CUSTOMER}, o_orderkey % 7""",
    "signals": f"""
        SELECT {gid('ms', '(k + 1)')} AS id, {gid('m', '(o_custkey + 1)')} AS merchant_id,
            {AS_OF} - CAST(days_ago AS INTEGER) AS signal_date,
            (CAST(total * 100 AS HUGEINT) // 1000000)::BIGINT AS transaction_volume,
            CAST(((k * 37) % 15000 - 7500) / 100.0 AS DECIMAL(5,2)) AS transaction_trend,
            k % 46 AS days_since_visit, urgent::BIGINT AS complaint_count,
            ['Active', 'Inactive', 'Pending', 'None'][k % 4 + 1] AS campaign_status,
            CAST(c_acctbal AS DECIMAL(12,2)) AS wallet_balance, 1 + k % 8 AS active_products,
            {NOW} AS created_at
        FROM signals_grouped JOIN customer ON o_custkey = c_custkey""",
    "scored": """
        SELECT merchant_id, signal_date AS score_date,
            CAST(0.4 AS DECIMAL(2,1)) * least(abs(coalesce(transaction_trend, 0)), 100)::DECIMAL(5,2) AS p_transaction,
            least(coalesce(days_since_visit, 0), 30) AS p_recency,
            CASE tier WHEN 'Gold' THEN 20 WHEN 'Silver' THEN 14 WHEN 'Bronze' THEN 8 ELSE 4 END AS p_tier,
            2 * least(coalesce(complaint_count, 0), 5) AS p_complaints
        FROM signals JOIN merchants ON merchants.id = merchant_id
        WHERE is_active""",
    "scores": f"""
        SELECT *, row_number() OVER (PARTITION BY score_date
            ORDER BY priority_score DESC, {num('merchant_id', 'm')}) AS rank
        FROM (
            SELECT *, round(p_transaction + p_recency + p_tier + p_complaints, 2)::DECIMAL(5,2)
                AS priority_score
            FROM scored)""",
    "recs": f"""
        SELECT {gid('r', '(o_orderkey + 1)')} AS id, {gid('m', f'({ORDER_CUSTOMER} + 1)')} AS merchant_id,
            o_orderpriority AS recommended_action, CAST(NULL AS VARCHAR) AS action_explanation,
            CASE WHEN o_orderkey % 13 <> 0 THEN CAST((o_orderkey % 101) / 100.0 AS DECIMAL(3,2)) END
                AS confidence_score,
            CASE WHEN o_orderstatus = 'F' THEN 'Done' WHEN o_orderstatus = 'O' THEN 'New'
                WHEN o_orderkey % 2 = 0 THEN 'In Progress' ELSE 'Deferred' END AS status,
            CASE WHEN o_orderstatus = 'F' THEN {EARLIER} END AS status_updated_at,
            CASE WHEN o_orderstatus = 'F' THEN {gid('u', ORDER_OWNER_NUMBER)} END AS status_updated_by,
            CASE WHEN o_orderkey % 97 <> 0 THEN {AS_OF} - CAST(o_orderkey % 5 AS INTEGER) END
                AS recommendation_date, {NOW} AS created_at
        FROM orders""",
    "visits": f"""
        SELECT {gid('vh', '(event_id + 1)')} AS id, merchants.id AS merchant_id,
            assigned_dsp_id AS dsp_id, CAST(ts AS DATE) AS visit_date, event_type AS visit_notes,
            CASE event_type WHEN 'purchase' THEN 'Successful' WHEN 'click' THEN 'Completed'
                WHEN 'view' THEN 'Follow-up Needed' WHEN 'error' THEN 'Not Available'
                ELSE 'Partially Successful' END AS outcome,
            10 + CAST(floor(value) AS BIGINT) % 51 AS duration_mins, {NOW} AS created_at
        FROM events JOIN merchants ON merchants.id = {gid('m', '(user_id + 1)')}""",
    "logs": f"""
        SELECT {gid('al', '(event_id + 1)')} AS id, {gid('u', f'(1 + user_id % {N_USR})')} AS user_id,
            CASE event_type WHEN 'signup' THEN 'LOGIN' WHEN 'view' THEN 'VIEW_MERCHANT'
                WHEN 'click' THEN 'VIEW_DASHBOARD' WHEN 'purchase' THEN 'UPDATE_ACTION_STATUS'
                ELSE 'EXPORT_DATA' END AS action,
            CASE event_type WHEN 'signup' THEN 'auth' WHEN 'view' THEN 'merchant'
                WHEN 'click' THEN 'dashboard' WHEN 'purchase' THEN 'recommendation'
                ELSE 'report' END AS resource,
            CAST(NULL AS VARCHAR) AS resource_id, props AS details, ts AS created_at
        FROM events""",
    "sessions": f"""
        SELECT {gid('cs', '(conv_id + 1)')} AS id, {gid('u', CONV_USER_NUMBER)} AS user_id,
            substr(arg_min(text, turn) FILTER (role = 'user'), 1, 100) AS title,
            {NOW} AS created_at, {NOW} - to_minutes((conv_id % 100000)::INTEGER) AS updated_at
        FROM conversations GROUP BY conv_id""",
    "messages": f"""
        SELECT {gid('cs', '(conv_id + 1)')} AS session_id, turn AS position, role, text AS content
        FROM conversations""",
    # Change sets
    "deltas": f"""
        SELECT {gid('m', MERCHANT_NUMBER)} AS merchant_id,
            CASE WHEN c_custkey % 7 <> 3 THEN (c_custkey * 13) % 3001 - 1500 ELSE 0 END AS volume_bp,
            CASE WHEN c_custkey % 7 <> 3 THEN (c_custkey * 17) % 1001 - 500 ELSE 0 END AS trend_cents,
            CASE WHEN c_custkey % 7 <> 3 THEN c_custkey % 3 - 1 ELSE 0 END AS step,
            CASE WHEN c_custkey % 7 <> 3 THEN (c_custkey * 31) % 100001 - 50000 ELSE 0 END AS wallet_cents
        FROM customer""",
    "status_changes": f"""
        SELECT event_id AS seq, {gid('r', '(target + 1)')} AS rec_id,
            ['NEW', 'IN_PROGRESS', 'DONE', 'DEFERRED', 'Pending', 'Done', 'bogus'][event_id % 7 + 1]
                AS status,
            CASE WHEN event_id % 5 = 0 OR o_orderkey IS NULL THEN 'u07'
                ELSE {gid('u', ORDER_OWNER_NUMBER)} END AS user_id,
            CASE WHEN event_id % 11 = 0 THEN 'Admin' ELSE 'DSP' END AS role
        FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 4
            ELSE ((event_id // 2) * 7) % ({N_ORD} + {N_ORD} // 2) END AS target FROM events)
        LEFT JOIN orders ON o_orderkey = target""",
    "user_creates": f"""
        SELECT {CALLER},
            CASE WHEN s_suppkey % 8 = 0 THEN 'dsp' || s_suppkey ELSE 'new' || (s_suppkey // 2) END
                || '@example.com' AS email,
            'secret' || s_suppkey AS password, 'New ' || s_name AS full_name,
            ['DSP', 'Manager', 'Bogus'][s_suppkey % 3 + 1] AS role, 'ASIA' AS region,
            CAST(NULL AS VARCHAR) AS area,
            CASE s_suppkey % 5 WHEN 4 THEN 'u00' WHEN 3 THEN 'u04' END AS manager_id
        FROM supplier""",
    "user_updates": f"""
        SELECT {CALLER}, {USER_TARGET} AS user_id,
            CASE WHEN edits THEN 'Renamed ' || s_name END AS full_name,
            CASE WHEN edits AND s_suppkey % 10 = 4 THEN 'admin.africa@example.com'
                WHEN edits AND s_suppkey % 10 = 6 THEN 'moved' || (s_suppkey // 20) || '@example.com'
                END AS email,
            CASE WHEN edits AND s_suppkey % 3 = 0 THEN 'Moved' END AS area,
            CASE WHEN edits AND s_suppkey % 7 = 2 THEN 'u02'
                WHEN edits AND s_suppkey % 7 = 5 THEN 'u00' END AS manager_id,
            CASE WHEN edits AND s_suppkey % 4 = 0 THEN FALSE END AS is_active
        FROM (SELECT *, s_suppkey % 12 <> 1 AS edits FROM supplier)""",
    "user_deletes": f"""
        SELECT {CALLER}, CASE s_suppkey % 9
            WHEN 8 THEN {gid('u', f'(s_suppkey // 18 * 18 + 15 + {N_SUP})')}
            WHEN 7 THEN {gid('u', f'(s_suppkey + 7 + 2 * {N_SUP})')}
            ELSE {gid('u', REP_NUMBER)} END AS user_id
        FROM supplier""",
    "role_changes": f"""
        SELECT {CALLER},
            CASE WHEN s_suppkey % 9 = 8 THEN {gid('u', f'(s_suppkey + 7 + {N_SUP})')}
                ELSE {gid('u', '(s_suppkey // 2 + 7)')} END AS user_id,
            ['Manager', 'Admin', 'Bogus', 'DSP'][s_suppkey % 4 + 1] AS role
        FROM supplier""",
    "assignments": f"""
        SELECT c_custkey AS seq, 'u01' AS caller_id,
            CASE WHEN c_custkey % 17 = 0 THEN 'DSP' ELSE 'Admin' END AS caller_role,
            CASE WHEN c_custkey % 23 = 5 THEN {gid('m', f'(c_custkey + 1 + {N_CUS})')}
                ELSE {gid('m', MERCHANT_NUMBER)} END AS merchant_id,
            {gid('u', f'((c_custkey // 10) % ({N_SUP} + 7) + 1)')} AS assigned_dsp_id
        FROM customer""",
    "briefs": f"""
        SELECT c_custkey AS seq, {gid('m', MERCHANT_NUMBER)} AS merchant_id,
            CASE WHEN c_custkey % 18 <> 0 THEN 'Brief for ' || c_name ELSE '' END AS text,
            CASE c_custkey % 4 WHEN 0 THEN 'u01' WHEN 1 THEN 'u02' WHEN 2 THEN 'u07'
                ELSE {gid('u', OWNER_NUMBER)} END AS user_id,
            ['Admin', 'Manager', 'DSP', 'DSP'][c_custkey % 4 + 1] AS role
        FROM customer""",
    "turns": f"""
        SELECT conv_id * 1000000 + turn AS seq, {gid('u', CONV_USER_NUMBER)} AS user_id,
            CASE conv_id % 3 WHEN 0 THEN {gid('cs', '(conv_id + 1)')}
                WHEN 1 THEN {gid('cs', '(conv_id + 2)')} END AS session_id,
            c.text AS message, a.text AS answer
        FROM conversations c LEFT JOIN (SELECT conv_id AS a_conv, turn - 1 AS a_turn, text
            FROM conversations WHERE role = 'assistant') a ON a_conv = conv_id AND a_turn = turn
        WHERE role = 'user'""",
    "next_signals": """
        SELECT * REPLACE ('ms9' || CAST(CAST(substr(id, 3) AS BIGINT) AS VARCHAR) AS id, signal_date + 1 AS signal_date,
            'None' AS campaign_status, 0 AS active_products)
        FROM signals""",
    # Shared steps
    "team": """
        SELECT id AS assigned_dsp_id FROM users_base WHERE manager_id = 'u02' OR id = 'u02'""",
    "pairs": """
        SELECT u.id AS viewer_id, m.id AS merchant_id
        FROM users_base u JOIN merchants m ON m.assigned_dsp_id = u.id
        WHERE u.role IN ('DSP', 'Manager')
        UNION
        SELECT b.id, m.id
        FROM users_base b JOIN users_base u ON u.manager_id = b.id
        JOIN merchants m ON m.assigned_dsp_id = u.id
        WHERE b.role = 'Manager'""",
    "latest": """
        SELECT merchant_id, arg_max(priority_score, score_date) AS priority_score,
            arg_max(rank, score_date) AS rank
        FROM scores GROUP BY merchant_id""",
    "best": f"""
        SELECT merchant_id, id AS recommendation_id, recommended_action AS recommendation,
            status AS recommendation_status
        FROM recs
        QUALIFY row_number() OVER (PARTITION BY merchant_id ORDER BY recommendation_date DESC
            NULLS FIRST, confidence_score DESC NULLS FIRST, {num('id', 'r')}) = 1""",
    "listing": f"""
        SELECT m.id AS merchant_id, m.merchant_name AS name, m.tier, m.region, m.area,
            {zero_null('l.priority_score')} AS score, l.rank, b.recommendation,
            b.recommendation_status, m.assigned_dsp_id, {num('m.id', 'm')} AS n
        FROM merchants m JOIN latest l ON l.merchant_id = m.id
        LEFT JOIN best b ON b.merchant_id = m.id
        WHERE m.is_active""",
    "details": f"""
        SELECT m.id AS merchant_id, m.merchant_name, m.region, m.area, m.tier, m.category,
            m.contact_number, m.address, {zero_null('m.latitude')} AS latitude,
            {zero_null('m.longitude')} AS longitude, m.onboarding_date, m.is_active,
            u.full_name AS assigned_dsp, {zero_null('l.priority_score')} AS priority_score,
            b.recommendation, b.recommendation_status, b.recommendation_id,
            s.transaction_volume, {zero_null('s.transaction_trend')} AS transaction_trend,
            s.days_since_visit, s.complaint_count, s.campaign_status,
            {zero_null('s.wallet_balance')} AS wallet_balance, s.active_products, m.assigned_dsp_id
        FROM merchants m LEFT JOIN users_base u ON u.id = m.assigned_dsp_id
        LEFT JOIN latest l ON l.merchant_id = m.id LEFT JOIN best b ON b.merchant_id = m.id
        LEFT JOIN signals s ON s.merchant_id = m.id AND s.signal_date = {AS_OF}""",
    "history": """
        SELECT v.merchant_id, v.id AS visit_id, v.visit_date, v.visit_notes, v.outcome,
            v.duration_mins, u.full_name AS visited_by
        FROM visits v JOIN users_base u ON u.id = v.dsp_id""",
    "joined": f"""
        SELECT m.id, m.region, m.area, m.assigned_dsp_id, s.priority_score, r.id AS rec, r.status
        FROM merchants m
        LEFT JOIN scores s ON s.merchant_id = m.id AND s.score_date = {AS_OF}
        LEFT JOIN recs r ON r.merchant_id = m.id AND r.recommendation_date = {AS_OF}
        WHERE m.is_active""",
    "areas": f"""
        SELECT region, area, count(DISTINCT id) AS total_merchants,
            count(DISTINCT assigned_dsp_id) AS total_dsps,
            round(CAST(sum(priority_score) AS DOUBLE) / count(priority_score) + 1e-9, 2)
                AS avg_priority_score,
            count(*) FILTER (status = 'Done') AS actions_completed,
            count(*) FILTER (status = 'New') AS actions_pending,
            count(*) FILTER (status = 'In Progress') AS actions_in_progress,
            {pct("count(*) FILTER (status = 'Done')", "count(rec)")} AS completion_rate
        FROM joined GROUP BY region, area""",
    "performance": f"""
        SELECT u.id AS dsp_id, u.full_name AS dsp_name, u.region, u.area,
            count(DISTINCT j.id) AS merchant_count,
            round(CAST(sum(priority_score) AS DOUBLE) / count(priority_score) + 1e-9, 2)
                AS avg_portfolio_score,
            count(*) FILTER (status = 'Done') AS actions_completed,
            count(*) FILTER (status IN ('New', 'In Progress')) AS actions_open,
            {pct("count(*) FILTER (status = 'Done')", "count(rec)")} AS completion_rate
        FROM users_base u JOIN joined j ON j.assigned_dsp_id = u.id
        WHERE u.role = 'DSP' AND u.is_active
        GROUP BY u.id, u.full_name, u.region, u.area""",
    "my_region": "SELECT region FROM users_base WHERE id = 'u02'",
    "high_now": """
        SELECT merchant_id FROM scores
        WHERE score_date = (SELECT max(score_date) FROM scores) AND priority_score >= 70""",
    "rolled": f"""
        SELECT l.merchant_id, {AS_OF} AS signal_date,
            greatest(CAST(trunc((l.transaction_volume * (10000 + d.volume_bp)) // 10000) AS BIGINT), 0)
                AS transaction_volume,
            CAST(CAST(l.transaction_trend * 100 + d.trend_cents AS BIGINT) / 100.0 AS DECIMAL(5,2))
                AS transaction_trend,
            l.days_since_visit + 1 AS days_since_visit,
            CASE WHEN d.step > 0 THEN l.complaint_count + 1
                WHEN d.step < 0 THEN greatest(l.complaint_count - 1, 0)
                ELSE l.complaint_count END AS complaint_count,
            l.campaign_status,
            CAST(greatest(CAST(l.wallet_balance * 100 + d.wallet_cents AS BIGINT), 0) / 100.0
                AS DECIMAL(12,2)) AS wallet_balance,
            l.active_products
        FROM (SELECT * FROM signals QUALIFY row_number() OVER (
                PARTITION BY merchant_id ORDER BY signal_date DESC) = 1) l
        JOIN merchants m ON m.id = l.merchant_id AND m.is_active
        JOIN deltas d ON d.merchant_id = l.merchant_id
        UNION ALL
        SELECT m.id, {AS_OF}, greatest(10 * (10000 + d.volume_bp) // 10000, 0),
            CAST(d.trend_cents / 100.0 AS DECIMAL(5,2)), 1, greatest(d.step, 0), 'None',
            CAST(greatest(10000 + d.wallet_cents, 0) / 100.0 AS DECIMAL(12,2)), 1
        FROM merchants m JOIN deltas d ON d.merchant_id = m.id
        WHERE m.is_active AND m.id NOT IN (SELECT merchant_id FROM signals)""",
    "status_names": """
        SELECT * FROM (VALUES ('NEW', 'New'), ('IN_PROGRESS', 'In Progress'), ('DONE', 'Done'),
            ('DEFERRED', 'Deferred'), ('New', 'New'), ('In Progress', 'In Progress'),
            ('Done', 'Done'), ('Deferred', 'Deferred'), ('Pending', 'New')) t(given, stored)""",
    "status_checked": """
        SELECT c.seq, c.rec_id, c.user_id, n.given, n.stored, r.merchant_id, r.recommended_action,
            CASE WHEN n.stored IS NULL THEN 400 WHEN c.role <> 'DSP' THEN 403
                WHEN m.assigned_dsp_id IS DISTINCT FROM c.user_id THEN 404 END AS code
        FROM status_changes c LEFT JOIN status_names n ON n.given = c.status
        LEFT JOIN recs r ON r.id = c.rec_id LEFT JOIN merchants m ON m.id = r.merchant_id""",
    "tool_checked": """
        SELECT s.* REPLACE (CASE WHEN s.given IS DISTINCT FROM s.stored THEN 400 ELSE s.code END AS code)
        FROM status_checked s""",
    "creates_checked": """
        SELECT *, CASE WHEN code0 IS NOT NULL THEN code0
            WHEN winner < seq THEN 409
            WHEN no_manager THEN 500 END AS code
        FROM (
            SELECT *, min(CASE WHEN code0 IS NULL AND NOT no_manager THEN seq END)
                OVER (PARTITION BY email) AS winner
            FROM (
                SELECT c.*, c.manager_id IS NOT NULL AND c.manager_id NOT IN
                        (SELECT id FROM users_base) AS no_manager,
                    CASE WHEN caller_role <> 'Admin' THEN 403
                        WHEN role NOT IN ('DSP', 'Manager', 'Admin') THEN 400
                        WHEN email IN (SELECT email FROM users_base) THEN 409 END AS code0
                FROM user_creates c))""",
    "updates_checked": """
        SELECT *, coalesce(code0, CASE WHEN claimant <> user_id THEN 500 END) AS code,
            CASE WHEN code0 IS NULL AND claimant <> user_id THEN 'e-mail taken' ELSE reason0 END
                AS reason
        FROM (
            SELECT *, CASE WHEN email IS NOT NULL THEN arg_min(user_id, seq) FILTER (code0 IS NULL)
                OVER (PARTITION BY email) END AS claimant
            FROM (
                SELECT *, CASE WHEN caller_role <> 'Admin' THEN 403 WHEN nothing THEN 400
                        WHEN unknown THEN 404 WHEN taken OR no_manager THEN 500 END AS code0,
                    CASE WHEN caller_role <> 'Admin' THEN 'only an Admin may do this'
                        WHEN nothing THEN 'no fields' WHEN unknown THEN 'user not found'
                        WHEN taken THEN 'e-mail taken'
                        WHEN no_manager THEN 'unknown manager' END AS reason0
                FROM (
                    SELECT c.*, c.full_name IS NULL AND c.email IS NULL AND c.area IS NULL
                            AND c.manager_id IS NULL AND c.is_active IS NULL AS nothing,
                        c.user_id NOT IN (SELECT id FROM users_base) AS unknown,
                        EXISTS (SELECT 1 FROM users_base u WHERE u.email = c.email
                            AND u.id <> c.user_id) AS taken,
                        c.manager_id IS NOT NULL AND c.manager_id NOT IN
                            (SELECT id FROM users_base) AS no_manager
                    FROM user_updates c)))""",
    "users_and_trainees": f"""
        SELECT * FROM users UNION ALL
        SELECT {gid('u', f'(s_suppkey + 7 + {N_SUP})')}, 'trainee' || s_suppkey || '@example.com',
            sha256('trainee' || s_suppkey || '@example.com'), s_name, 'DSP', 'ASIA', NULL, NULL,
            TRUE, {NOW}, {NOW}
        FROM supplier""",
    "referred": """
        SELECT manager_id AS id FROM users_and_trainees WHERE manager_id IS NOT NULL
        UNION SELECT assigned_dsp_id FROM merchants UNION SELECT dsp_id FROM visits
        UNION SELECT user_id FROM logs UNION SELECT user_id FROM sessions""",
    "deletes_checked": """
        SELECT *, CASE WHEN code0 IS NULL AND winner < seq THEN 404 ELSE code0 END AS code
        FROM (
            SELECT *, min(CASE WHEN code0 IS NULL THEN seq END) OVER (PARTITION BY user_id) AS winner
            FROM (
                SELECT *, CASE WHEN caller_role <> 'Admin' THEN 403
                    WHEN user_id NOT IN (SELECT id FROM users_and_trainees) THEN 404
                    WHEN user_id IN (SELECT id FROM referred) THEN 500 END AS code0
                FROM user_deletes))""",
    "roles_checked": """
        SELECT c.*, u.role AS stored_role, u.full_name,
            CASE WHEN caller_role <> 'Admin' THEN 403
                WHEN c.role NOT IN ('DSP', 'Manager', 'Admin') THEN 400
                WHEN u.id IS NULL THEN 404 END AS code
        FROM role_changes c LEFT JOIN users_base u ON u.id = c.user_id""",
    "assign_checked": """
        SELECT c.*, u.full_name AS dsp_name,
            CASE WHEN caller_role <> 'Admin' THEN 403 WHEN u.id IS NULL THEN 404
                WHEN u.role <> 'DSP' THEN 400 WHEN m.id IS NULL THEN 404 END AS code,
            CASE WHEN caller_role <> 'Admin' THEN 'only an Admin may do this'
                WHEN u.id IS NULL THEN 'DSP not found'
                WHEN u.role <> 'DSP' THEN 'user is not a DSP'
                WHEN m.id IS NULL THEN 'merchant not found' END AS reason
        FROM assignments c LEFT JOIN users_base u ON u.id = c.assigned_dsp_id
        LEFT JOIN merchants m ON m.id = c.merchant_id""",
    "briefs_checked": """
        SELECT b.*, CASE
            WHEN m.id IS NULL OR NOT (b.role = 'Admin' OR m.assigned_dsp_id = b.user_id
                OR (b.role = 'Manager' AND m.assigned_dsp_id IN
                    (SELECT u.id FROM users_base u WHERE u.manager_id = b.user_id))) THEN 404
            WHEN b.text = '' THEN 500 END AS code
        FROM briefs b LEFT JOIN merchants m ON m.id = b.merchant_id""",
    "turns_placed": f"""
        SELECT t.*, s.id IS NULL AS is_new,
            CASE WHEN s.id IS NOT NULL THEN t.session_id
                ELSE {gid('cs', "(CAST(fresh_n AS BIGINT) + (SELECT max(conv_id) + 1 FROM conversations))")}
                END AS target,
            CASE WHEN s.id IS NULL THEN 1 ELSE row_number() OVER (
                PARTITION BY s.id, s.id IS NULL ORDER BY seq) END AS nth
        FROM (
            SELECT t.*, count(*) FILTER (s.id IS NULL) OVER (ORDER BY seq) AS fresh_n
            FROM turns t LEFT JOIN sessions s ON s.id = t.session_id AND s.user_id = t.user_id) t
        LEFT JOIN sessions s ON s.id = t.session_id AND s.user_id = t.user_id""",
    "new_messages": """
        SELECT target AS session_id,
            2 * (nth - 1) + coalesce((SELECT max(position) + 1 FROM messages m
                WHERE m.session_id = target AND NOT is_new), 0) AS start,
            message, answer
        FROM turns_placed""",
}

LISTED = "merchant_id, name, tier, region, area, score, rank, recommendation, recommendation_status"
BY_RANK = "ORDER BY rank ASC NULLS LAST, n"
BREAKDOWN = ", ".join(
    f"CAST(round(CAST(p_{part} AS DECIMAL(8,3)), 1) AS DOUBLE) AS {part}"
    for part in ("transaction", "recency", "tier", "complaints")
)
SIGNAL_COLUMNS = (
    "merchant_id, signal_date, transaction_volume,"
    " CAST(transaction_trend AS DOUBLE) AS transaction_trend, days_since_visit, complaint_count,"
    " campaign_status, CAST(wallet_balance AS DOUBLE) AS wallet_balance, active_products"
)
COUNTS = (
    "count(DISTINCT id) AS total_merchants,"
    " count(DISTINCT CASE WHEN priority_score >= 70 THEN id END) AS high_priority,"
    " count(DISTINCT CASE WHEN status IN ('New', 'In Progress') THEN id END) AS recommended_visits"
)
AUDIT_NEWEST = f"ORDER BY created_at DESC NULLS FIRST, {num('l.id', 'al')}"
MATCHED = has("merchant_name", "#00000001")
FIRST_MATCH = f"SELECT * FROM merchants WHERE {MATCHED} ORDER BY {num('id', 'm')} LIMIT 1"
REC_COLUMNS = (
    "id, merchant_id, recommended_action, action_explanation,"
    " CAST(confidence_score AS DOUBLE) AS confidence_score, status, status_updated_at,"
    " status_updated_by, recommendation_date, created_at"
)
MERCHANT_COLUMNS = (
    "id, merchant_name, region, area, tier, category, contact_number, address,"
    " CAST(latitude AS DOUBLE) AS latitude, CAST(longitude AS DOUBLE) AS longitude,"
    " assigned_dsp_id, is_active, onboarding_date, created_at, updated_at"
)


def _search(text: str, scope: str) -> str:
    anywhere = " OR ".join(has(c, text) for c in ("merchant_name", "region", "area", "category"))
    return f"""
        SELECT merchant_name, region, area, tier, category,
            CAST(priority_score AS DOUBLE) AS priority_score, rank
        FROM merchants m LEFT JOIN scores s ON s.merchant_id = m.id AND s.score_date = {AS_OF}
        WHERE {scope} AND ({anywhere})
        ORDER BY s.priority_score DESC NULLS LAST, {num('m.id', 'm')} LIMIT 20"""


def _trail(where: str, limit: int) -> str:
    return f"""
        SELECT l.id, l.action, l.resource, l.resource_id, l.details, l.created_at,
            u.full_name AS user
        FROM logs l LEFT JOIN users_base u ON u.id = l.user_id WHERE {where}
        {AUDIT_NEWEST} LIMIT {limit}"""


def _areas(where: str) -> str:
    return f"""
        SELECT region, area, total_merchants, total_dsps,
            {zero_null('avg_priority_score')} AS avg_priority_score, actions_completed,
            actions_pending, actions_in_progress,
            coalesce(CAST(completion_rate AS DOUBLE), 0.0::DOUBLE) AS completion_rate
        FROM areas WHERE {where}"""


def _totals(where: str, high: str) -> str:
    actions = "(sum(actions_completed) + sum(actions_pending) + sum(actions_in_progress))"
    return f"""
        SELECT coalesce(CAST({pct('sum(actions_completed)', actions)} AS DOUBLE), 0.0::DOUBLE)
                AS completion_rate,
            CAST(coalesce(sum(total_merchants), 0) AS BIGINT) AS total_merchants,
            (SELECT count(*) FROM high_now WHERE {high}) AS high_priority
        FROM areas WHERE {where}"""


def _week(where: str) -> str:
    return f"""
        SELECT coalesce(nullif(area, ''), 'Unknown') AS area, count(*) AS visits,
            CAST(10 AS BIGINT) AS target
        FROM visits JOIN merchants m ON m.id = merchant_id
        WHERE visit_date >= {AS_OF} - 7 AND {where} GROUP BY m.area"""


def _team(where: str) -> str:
    return f"""
        SELECT dsp_name AS name, region, area, merchant_count AS merchants,
            CASE WHEN avg_portfolio_score <> 0 THEN round(avg_portfolio_score + 1e-9, 1) END
                AS avg_score,
            actions_completed AS completed, actions_open AS open,
            CASE WHEN completion_rate <> 0 THEN
                CAST(CAST(completion_rate AS DECIMAL(5,1)) AS VARCHAR) || '%' ELSE '0%' END
                AS completion_rate
        FROM performance WHERE {where}"""


def _status_table(checked: str) -> str:
    return f"""
        SELECT r.id, r.merchant_id, r.recommended_action, r.action_explanation,
            CAST(r.confidence_score AS DOUBLE) AS confidence_score,
            coalesce(c.stored, r.status) AS status,
            CASE WHEN c.rec_id IS NOT NULL THEN {NOW} ELSE r.status_updated_at END
                AS status_updated_at,
            coalesce(c.user_id, r.status_updated_by) AS status_updated_by, r.recommendation_date, r.created_at
        FROM recs r LEFT JOIN (
            SELECT rec_id, arg_max(stored, seq) AS stored, arg_max(user_id, seq) AS user_id
            FROM {checked} WHERE code IS NULL GROUP BY rec_id) c ON c.rec_id = r.id"""


def _status_rejects(checked: str) -> str:
    return f"""
        SELECT seq, CAST(code AS BIGINT) AS code, CASE code WHEN 400 THEN 'unknown status'
            WHEN 403 THEN 'only a DSP may update a status' ELSE 'recommendation not found' END
            AS reason
        FROM {checked} WHERE code IS NOT NULL"""


def _audit(checked: str, user: str, action: str, resource: str,
           resource_id: str = "CAST(NULL AS VARCHAR)", details: str = "CAST(NULL AS VARCHAR)") -> str:
    number = "(row_number() OVER (ORDER BY seq) + (SELECT max(event_id) + 1 FROM events))"
    return f"""
        SELECT {gid('al', number)} AS id, {user} AS user_id, '{action}' AS action,
            '{resource}' AS resource, {resource_id} AS resource_id, {details} AS details,
            CAST(NULL AS VARCHAR) AS ip_address, {NOW} AS created_at
        FROM {checked} WHERE code IS NULL"""


def _rejects(checked: str, reason: str = "reason") -> str:
    return (
        f"SELECT seq, CAST(code AS BIGINT) AS code, {reason} AS reason"
        f" FROM {checked} WHERE code IS NOT NULL"
    )


def _context(size: int, where: str) -> str:
    return f"""
        SELECT d.merchant_id, coalesce(p.part, 0) AS part, d.merchant_name, d.area, d.latitude,
            d.onboarding_date, d.assigned_dsp, d.priority_score, d.recommendation_id,
            d.transaction_trend, d.wallet_balance, d.days_since_visit,
            coalesce(p.n_visits, 0) AS n_visits, coalesce(p.visits, '') AS visits
        FROM details d LEFT JOIN (
            SELECT merchant_id, (i - 1) // {size} AS part, count(*) AS n_visits,
                string_agg(concat_ws('|', visit_date, visit_notes, outcome, duration_mins,
                    visited_by), chr(10) ORDER BY i) AS visits
            FROM (SELECT *, row_number() OVER (PARTITION BY merchant_id
                ORDER BY visit_date DESC, {num('visit_id', 'vh')}) AS i FROM history)
            GROUP BY ALL) p ON p.merchant_id = d.merchant_id
        WHERE {where}"""


def _stored_rows() -> str:
    """Both batches hold the same changes; ids run on from the first to the second."""
    logs = "(SELECT max(event_id) + 1 FROM events)"
    visits = "(SELECT max(event_id) + 1 FROM events WHERE user_id IN (SELECT c_custkey FROM customer))"
    twice = "(SELECT * FROM status_checked, (VALUES (1), (2)) b(batch)) c WHERE code IS NULL"

    def number(prefix: str, after: str) -> str:
        return gid(prefix, f"(row_number() OVER (ORDER BY batch, seq) + {after})")

    return f"""
        SELECT 'recommendations' AS table_name, id, status AS state, status_updated_by AS user_id,
            CAST(status_updated_at AS DATE) AS at
        FROM ({_status_table('status_checked')})
        UNION ALL SELECT 'audit_logs', id, action, user_id, CAST(created_at AS DATE) FROM logs
        UNION ALL SELECT 'audit_logs', {number('al', logs)}, 'UPDATE_ACTION_STATUS', user_id, {AS_OF}
        FROM {twice}
        UNION ALL SELECT 'visit_history', id, outcome, dsp_id, visit_date FROM visits
        UNION ALL SELECT 'visit_history', {number('vh', visits)}, 'Recommendation fulfilled', user_id,
            {AS_OF} FROM {twice} AND stored = 'Done'"""


QUERIES_SQL = {
    "q01_score_merchants": f"""
        SELECT merchant_id, score_date, CAST(priority_score AS DOUBLE) AS priority_score, rank,
            {BREAKDOWN} FROM scores""",
    "q02_roll_forward": f"SELECT {SIGNAL_COLUMNS} FROM rolled",
    "q02_reprofiled_scores": f"""
        SELECT merchant_id, score_date, CAST(priority_score AS DOUBLE) AS priority_score,
            row_number() OVER (ORDER BY s.priority_score DESC, {num('merchant_id', 'm')}) AS rank,
            {BREAKDOWN}
        FROM (
            SELECT *, round(p_transaction + p_recency + p_tier + p_complaints, 2)::DECIMAL(5,2)
                AS priority_score
            FROM (
                SELECT merchant_id, signal_date AS score_date,
                    CAST(0.4 AS DECIMAL(2,1)) * least(abs(transaction_trend), 100)::DECIMAL(5,2)
                        AS p_transaction,
                    least(days_since_visit, 30) AS p_recency,
                    CASE tier WHEN 'Gold' THEN 20 WHEN 'Silver' THEN 14 WHEN 'Bronze' THEN 8
                        ELSE 4 END AS p_tier,
                    2 * least(complaint_count, 5) AS p_complaints
                FROM rolled JOIN merchants ON merchants.id = merchant_id)) s""",
    "q03_prioritized_admin": f"SELECT {LISTED} FROM listing {BY_RANK} LIMIT 20",
    "q03_prioritized_manager": f"""
        SELECT {LISTED} FROM listing WHERE assigned_dsp_id IN (SELECT * FROM team)
        {BY_RANK} LIMIT 50""",
    "q03_prioritized_dsp": f"""
        SELECT {LISTED} FROM listing WHERE assigned_dsp_id = 'u08' {BY_RANK} LIMIT 20""",
    "q03_prioritized_all": f"""
        SELECT viewer_id, {LISTED} FROM listing JOIN pairs USING (merchant_id)
        QUALIFY row_number() OVER (PARTITION BY viewer_id {BY_RANK}) <= 20
        UNION ALL
        SELECT 'u01', {LISTED} FROM (SELECT * FROM listing {BY_RANK} LIMIT 20)""",
    "q04_details_all": "SELECT * EXCLUDE (assigned_dsp_id) FROM details",
    "q04_details_manager": """
        SELECT * EXCLUDE (assigned_dsp_id) FROM details
        WHERE assigned_dsp_id IN (SELECT * FROM team)""",
    "q05_history_all": "SELECT * FROM history",
    "q05_history_manager": """
        SELECT * FROM history WHERE merchant_id IN (
            SELECT id FROM merchants WHERE assigned_dsp_id IN (SELECT * FROM team))""",
    "q06_find": f"""
        SELECT id, merchant_name, region, area, tier, category, contact_number, address
        FROM ({FIRST_MATCH})""",
    "q07_score": f"""
        SELECT m.merchant_name, CAST(s.priority_score AS DOUBLE) AS priority_score, s.rank,
            {BREAKDOWN}, CAST(g.transaction_trend AS DOUBLE) AS transaction_trend, g.complaint_count
        FROM ({FIRST_MATCH}) m
        LEFT JOIN scores s ON s.merchant_id = m.id AND s.score_date = {AS_OF}
        LEFT JOIN signals g ON g.merchant_id = m.id AND g.signal_date = {AS_OF}""",
    "q08_recs": f"""
        SELECT r.recommended_action AS action, r.action_explanation AS explanation, r.status,
            {zero_null('r.confidence_score')} AS confidence_score
        FROM merchants m JOIN recs r ON r.merchant_id = m.id
        WHERE {MATCHED} AND r.recommendation_date = {AS_OF}""",
    "q09_visits": f"""
        SELECT h.visit_date, h.visit_notes, h.outcome, h.visited_by
        FROM history h JOIN merchants m ON m.id = h.merchant_id WHERE {MATCHED}
        ORDER BY h.visit_date DESC, {num('h.visit_id', 'vh')} LIMIT 5""",
    "q10_search": _search("asia", "TRUE"),
    "q10_search_manager": _search("Build", "assigned_dsp_id IN (SELECT * FROM team)"),
    "q11_audit": f"SELECT * EXCLUDE (id) FROM ({_trail('TRUE', 50)})",
    "q11_audit_filtered": f"SELECT * EXCLUDE (id) FROM ({_trail(has('l.action', 'view'), 200)})",
    "q11_audit_page": f"""
        SELECT 'log-' || (row_number() OVER ({AUDIT_NEWEST}) - 1) AS id, action, resource,
            CAST(NULL AS VARCHAR) AS resource_id, CAST(NULL AS VARCHAR) AS details,
            CAST(NULL AS VARCHAR) AS ip_address, l.user AS user_name, created_at
        FROM ({_trail(has("l.action", "_data"), 50)}) l""",
    "q12_dsp": f"SELECT {COUNTS} FROM joined WHERE assigned_dsp_id = 'u08'",
    "q12_dsp_all": f"""
        SELECT u.id AS viewer_id, {COUNTS.replace(' id', ' j.id').replace('status', 'j.status')}
        FROM users_base u LEFT JOIN joined j ON j.assigned_dsp_id = u.id
        WHERE u.role = 'DSP' GROUP BY u.id""",
    "q13_manager": f"SELECT {COUNTS} FROM joined WHERE assigned_dsp_id IN (SELECT * FROM team)",
    "q13_manager_all": f"""
        SELECT b.id AS viewer_id, {COUNTS.replace(' id', ' j.id').replace('status', 'j.status')}
        FROM users_base b LEFT JOIN users_base u ON u.manager_id = b.id OR u.id = b.id
        LEFT JOIN joined j ON j.assigned_dsp_id = u.id
        WHERE b.role = 'Manager' GROUP BY b.id""",
    "q14_admin": f"SELECT {COUNTS} FROM joined",
    "q15_area": "SELECT * REPLACE (CAST(completion_rate AS DOUBLE) AS completion_rate) FROM areas",
    "q16_area_admin": _areas("TRUE"),
    "q16_area_manager": _areas("region = (SELECT region FROM my_region)"),
    "q17_totals_admin": _totals("TRUE", "TRUE"),
    "q17_totals_manager": _totals(
        "region = (SELECT region FROM my_region)",
        "merchant_id IN (SELECT id FROM merchants WHERE region = (SELECT region FROM my_region))"),
    "q18_visits_admin": _week("TRUE"),
    "q18_visits_manager": _week("region = (SELECT region FROM my_region)"),
    "q19_dsp": "SELECT * REPLACE (CAST(completion_rate AS DOUBLE) AS completion_rate) FROM performance",
    "q20_team_admin": _team("TRUE"),
    "q20_team_manager": _team("dsp_id IN (SELECT id FROM users_base WHERE manager_id = 'u02')"),
    "q21_users": f"""
        SELECT u.id AS user_id, u.email, u.full_name, u.role, u.region, u.area, u.is_active,
            b.full_name AS manager_name, u.created_at
        FROM users u LEFT JOIN users_base b ON b.id = u.manager_id
        ORDER BY u.role, u.full_name, {num('u.id', 'u')} LIMIT 100""",
    "q21_users_filtered": f"""
        SELECT u.id AS user_id, u.email, u.full_name, u.role, u.region, u.area, u.is_active,
            b.full_name AS manager_name, u.created_at
        FROM users u LEFT JOIN users_base b ON b.id = u.manager_id
        WHERE u.role = 'DSP' AND u.region = 'ASIA' AND u.is_active
        ORDER BY u.role, u.full_name, {num('u.id', 'u')} LIMIT 500""",
    "q22_merchants": """
        SELECT m.id AS merchant_id, m.merchant_name, m.region, m.area, m.tier, m.category,
            m.assigned_dsp_id, u.full_name AS assigned_dsp_name
        FROM merchants m LEFT JOIN users_base u ON u.id = m.assigned_dsp_id""",
    "q23_chat": f"""
        SELECT s.id AS session_id, s.title, s.created_at, s.updated_at, m.position, m.role, m.content
        FROM (SELECT * FROM sessions WHERE user_id = 'u02'
            ORDER BY updated_at DESC, {num('id', 'cs')} LIMIT 3) s
        LEFT JOIN messages m ON m.session_id = s.id""",
    "q23_chat_all": f"""
        SELECT s.id AS session_id, s.user_id, s.title, s.created_at, s.updated_at, m.position,
            m.role, m.content
        FROM (SELECT * FROM sessions QUALIFY row_number() OVER (PARTITION BY user_id
            ORDER BY updated_at DESC, {num('id', 'cs')}) <= 20) s
        LEFT JOIN messages m ON m.session_id = s.id""",
    "q24_profiles": """
        SELECT id AS user_id, full_name AS name, email, role, region, area FROM users_base""",
    "q24_profiles_active": """
        SELECT id AS user_id, full_name AS name, email, role, region, area FROM users_base
        WHERE is_active AND id IN (SELECT user_id FROM user_deletes)""",
    "q25_context": _context(25, "TRUE"),
    "q25_context_whole": _context(1000, "TRUE"),
    "q25_context_wanted": _context(1000, "d.assigned_dsp_id IN (SELECT * FROM team)"),
    "q26_users_by_role": "SELECT role, count(*) AS n FROM users_base GROUP BY role",
    "q26_merchants_by_tier": "SELECT tier, count(*) AS n FROM merchants GROUP BY tier",
    "q26_merchants_by_region": "SELECT region, count(*) AS n FROM merchants GROUP BY region",
    "q26_signals_today": f"SELECT count(*) AS n FROM signals WHERE signal_date = {AS_OF}",
    "q26_top_merchants": f"""
        SELECT m.merchant_name, m.tier, CAST(s.priority_score AS DOUBLE) AS priority_score, s.rank
        FROM scores s JOIN merchants m ON m.id = s.merchant_id
        WHERE s.score_date = {AS_OF} ORDER BY s.rank LIMIT 5""",
    "q26_recommendation_status": f"""
        SELECT status, count(*) AS n FROM recs WHERE recommendation_date = {AS_OF} GROUP BY status""",
    "q26_areas": """
        SELECT * REPLACE (CAST(completion_rate AS DOUBLE) AS completion_rate) FROM areas
        ORDER BY region NULLS LAST, area NULLS LAST LIMIT 5""",
    "m01_recs": _status_table("status_checked"),
    "m01_visits": f"""
        SELECT {gid('vh', "(row_number() OVER (ORDER BY seq) + (SELECT max(event_id) + 1 FROM events WHERE user_id IN (SELECT c_custkey FROM customer)))")}
                AS id, merchant_id, user_id AS dsp_id, {AS_OF} AS visit_date,
            'Completed recommendation: ' || substr(recommended_action, 1, 200) AS visit_notes,
            'Recommendation fulfilled' AS outcome, CAST(15 AS BIGINT) AS duration_mins,
            {NOW} AS created_at
        FROM status_checked WHERE code IS NULL AND stored = 'Done'""",
    "m01_audit": _audit("status_checked", "user_id", "UPDATE_ACTION_STATUS", "recommendation"),
    "m01_results": f"""
        SELECT seq, rec_id, stored AS status, {NOW} AS updated_at FROM status_checked
        WHERE code IS NULL""",
    "m01_rejects": _status_rejects("status_checked"),
    "m01_stored": _stored_rows(),
    "m02_recs": _status_table("tool_checked"),
    "m02_rejects": _status_rejects("tool_checked"),
    "m03_users": f"""
        SELECT * FROM users UNION ALL
        SELECT {gid('u', f'(row_number() OVER (ORDER BY seq) + {N_USR})')}, email, sha256(password),
            full_name, role, region, area, manager_id, TRUE, {NOW}, {NOW}
        FROM creates_checked WHERE code IS NULL""",
    "m03_audit": _audit("creates_checked", "caller_id", "CREATE_USER", "user"),
    "m03_results": f"""
        SELECT seq, {gid('u', f'(row_number() OVER (ORDER BY seq) + {N_USR})')} AS user_id, email,
            full_name, role
        FROM creates_checked WHERE code IS NULL""",
    "m03_rejects": _rejects("creates_checked", """CASE code
        WHEN 403 THEN 'only an Admin may do this' WHEN 400 THEN 'unknown role'
        WHEN 409 THEN 'e-mail taken' ELSE 'unknown manager' END"""),
    "m04_users": f"""
        SELECT u.id, coalesce(c.email, u.email) AS email, u.password_hash,
            coalesce(c.full_name, u.full_name) AS full_name, u.role, u.region,
            coalesce(c.area, u.area) AS area, coalesce(c.manager_id, u.manager_id) AS manager_id,
            coalesce(c.is_active, u.is_active) AS is_active, u.created_at, u.updated_at
        FROM users u LEFT JOIN (SELECT * FROM updates_checked WHERE code IS NULL) c
            ON c.user_id = u.id""",
    "m04_results": """
        SELECT c.seq, c.user_id, coalesce(c.full_name, u.full_name) AS full_name,
            coalesce(c.email, u.email) AS email, u.role,
            coalesce(c.is_active, u.is_active) AS is_active
        FROM updates_checked c JOIN users_base u ON u.id = c.user_id WHERE c.code IS NULL""",
    "m04_rejects": _rejects("updates_checked"),
    "m05_users": """
        SELECT * FROM users_and_trainees WHERE id NOT IN (
            SELECT user_id FROM deletes_checked WHERE code IS NULL)""",
    "m05_audit": _audit("deletes_checked", "caller_id", "DEACTIVATE_USER", "user"),
    "m05_results": """
        SELECT c.seq, c.user_id, u.full_name
        FROM deletes_checked c JOIN users_and_trainees u ON u.id = c.user_id WHERE c.code IS NULL""",
    "m05_rejects": _rejects("deletes_checked", """CASE code
        WHEN 403 THEN 'only an Admin may do this' WHEN 404 THEN 'user not found'
        ELSE 'user is referred to' END"""),
    "m06_users": """
        SELECT u.* REPLACE (coalesce(c.role, u.role) AS role)
        FROM users u LEFT JOIN (SELECT user_id, arg_max(role, seq) AS role FROM roles_checked
            WHERE code IS NULL GROUP BY user_id) c ON c.user_id = u.id""",
    "m06_results": """
        SELECT seq, user_id, full_name, coalesce(lag(role) OVER (PARTITION BY user_id ORDER BY seq),
            stored_role) AS old_role, role AS new_role
        FROM roles_checked WHERE code IS NULL""",
    "m06_audit": _audit("roles_checked", "caller_id", "ROLE_CHANGE", "user"),
    "m06_rejects": _rejects("roles_checked", """CASE code
        WHEN 403 THEN 'only an Admin may do this' WHEN 400 THEN 'unknown role'
        ELSE 'user not found' END"""),
    "m07_merchants": f"""
        SELECT {MERCHANT_COLUMNS} FROM (
            SELECT m.* REPLACE (coalesce(c.dsp, m.assigned_dsp_id) AS assigned_dsp_id)
            FROM merchants m LEFT JOIN (SELECT merchant_id, arg_max(assigned_dsp_id, seq) AS dsp
                FROM assign_checked WHERE code IS NULL GROUP BY merchant_id) c
            ON c.merchant_id = m.id)""",
    "m07_audit": _audit(
        "assign_checked", "caller_id", "ASSIGN_MERCHANT", "merchant", "merchant_id",
        "'{\"assigned_dsp_id\":\"' || assigned_dsp_id || '\",\"dsp_name\":\"' || dsp_name || '\"}'"),
    "m07_results": """
        SELECT c.seq, c.merchant_id, m.merchant_name, c.assigned_dsp_id
        FROM assign_checked c JOIN merchants m ON m.id = c.merchant_id WHERE c.code IS NULL""",
    "m07_rejects": _rejects("assign_checked"),
    "m08_recs": f"""
        SELECT {REC_COLUMNS} FROM recs
        WHERE merchant_id NOT IN (SELECT merchant_id FROM briefs_checked WHERE code IS NULL)
        UNION ALL
        SELECT {gid('r', f'(row_number() OVER (ORDER BY seq) + {N_ORD})')}, merchant_id, text,
            'Live generated AI brief.', 0.95, 'New', {NOW}, user_id, {AS_OF}, {NOW}
        FROM briefs_checked WHERE code IS NULL""",
    "m08_results": f"""
        SELECT seq, {gid('r', f'(row_number() OVER (ORDER BY seq) + {N_ORD})')} AS rec_id,
            merchant_id, text
        FROM briefs_checked WHERE code IS NULL""",
    "m08_rejects": _rejects(
        "briefs_checked", "CASE code WHEN 404 THEN 'merchant not found' ELSE 'no brief' END"),
    "m09_sessions": f"""
        SELECT s.id, s.user_id, s.title, s.created_at, CASE WHEN s.id IN (
            SELECT target FROM turns_placed WHERE NOT is_new) THEN {NOW} ELSE s.updated_at END
            AS updated_at
        FROM sessions s
        UNION ALL
        SELECT target, user_id, substr(message, 1, 100), {NOW}, {NOW}
        FROM turns_placed WHERE is_new""",
    "m09_messages": """
        SELECT * FROM messages
        UNION ALL SELECT session_id, start, 'user', message FROM new_messages
        UNION ALL SELECT session_id, start + 1, 'assistant', answer FROM new_messages""",
    "m09_placed": "SELECT seq, target AS session_id, is_new FROM turns_placed",
    "s03_insert_ignore": f"""
        SELECT id, {SIGNAL_COLUMNS}, created_at FROM signals
        UNION ALL
        SELECT id, {SIGNAL_COLUMNS}, created_at FROM next_signals
        WHERE (merchant_id, signal_date) NOT IN (SELECT merchant_id, signal_date FROM signals)""",
    "s04_upsert": f"""
        SELECT id, {SIGNAL_COLUMNS}, created_at FROM (
            SELECT coalesce(o.id, n.id) AS id,
                coalesce(o.merchant_id, n.merchant_id) AS merchant_id,
                coalesce(o.signal_date, n.signal_date) AS signal_date,
                coalesce(n.transaction_volume + 1, o.transaction_volume) AS transaction_volume,
                coalesce(n.transaction_trend, o.transaction_trend) AS transaction_trend,
                coalesce(n.days_since_visit, o.days_since_visit) AS days_since_visit,
                coalesce(n.complaint_count, o.complaint_count) AS complaint_count,
                coalesce(o.campaign_status, n.campaign_status) AS campaign_status,
                coalesce(n.wallet_balance, o.wallet_balance) AS wallet_balance,
                coalesce(o.active_products, n.active_products) AS active_products,
                coalesce(o.created_at, n.created_at) AS created_at
            FROM signals o FULL JOIN next_signals n
                ON n.merchant_id = o.merchant_id AND n.signal_date = o.signal_date)""",
    "s06_ids": f"""
        SELECT event_id, {gid('al', '(row_number() OVER (ORDER BY event_id) + 95)')} AS id
        FROM events""",
    "f01_entitlements": "SELECT viewer_id, merchant_id FROM pairs",
}


SCORE_NUMBER = f"({num('merchant_id', 'm')} * 10 + ({AS_OF} - score_date))"
QUERIES_SQL |= {
    "s01_conform_scores": f"""
        SELECT {gid('ds', SCORE_NUMBER)} AS id, merchant_id, score_date,
            CAST(priority_score AS DOUBLE) AS priority_score, rank, {BREAKDOWN}, {NOW} AS created_at
        FROM scores""",
    "s01_conform_messages": "SELECT * FROM messages",
    "s01_conform_audit": f"""
        SELECT id, user_id, action, resource, resource_id, details,
            '10.0.0.' || CAST({num('id', 'al')} % 250 AS VARCHAR) AS ip_address, created_at
        FROM logs""",
    "q06_find_indexed": QUERIES_SQL["q06_find"],
    "q10_search_indexed": QUERIES_SQL["q10_search"],
    "q10_search_manager_indexed": QUERIES_SQL["q10_search_manager"],
    "q11_stored": QUERIES_SQL["q11_audit"],
    "q11_stored_filtered": QUERIES_SQL["q11_audit_filtered"],
    "m07_bucketed": QUERIES_SQL["m07_merchants"],
    "s03_bucketed": QUERIES_SQL["s03_insert_ignore"],
    "s03_twice": QUERIES_SQL["s03_insert_ignore"],
    "s04_bucketed": QUERIES_SQL["s04_upsert"],
    "s04_twice": QUERIES_SQL["s04_upsert"],
    "s05_area_view": QUERIES_SQL["q15_area"],
    "s05_dsp_view": QUERIES_SQL["q19_dsp"],
    "s07_json": QUERIES_SQL["q03_prioritized_all"],
}


CTES |= {
    "landed": f"""
        SELECT *, {num('id', 'ms9')} % {LANDING_STEP} AS kind FROM next_signals
        UNION ALL
        SELECT * REPLACE ('ms10' || CAST({num('id', 'ms')} AS VARCHAR) AS id, signal_date + 1 AS signal_date,
            transaction_volume + 1 AS transaction_volume), {num('id', 'ms')} % 19 AS kind
        FROM signals""",
    "all_logs": f"""
        SELECT id, action, resource, resource_id, details, created_at, user_id FROM logs
        UNION ALL
        SELECT id, action, resource, resource_id, details, created_at, user_id FROM ({QUERIES_SQL['m07_audit']})""",
}
QUERIES_SQL |= {
    "s02_landed": f"""
        SELECT id, {SIGNAL_COLUMNS}, created_at FROM signals
        UNION ALL
        SELECT id, {SIGNAL_COLUMNS}, created_at FROM (
            SELECT * FROM landed
            WHERE kind NOT BETWEEN 1 AND 5
                AND (merchant_id, signal_date) NOT IN (SELECT merchant_id, signal_date FROM signals)
            QUALIFY row_number() OVER (PARTITION BY merchant_id, signal_date ORDER BY {num('id', 'ms')}) = 1)""",
    "q11_details": """
        SELECT id, action, resource, resource_id, json_valid(details) AS is_json,
            CAST(json_extract_string(details, '$.k') AS BIGINT) AS k,
            json_extract_string(details, '$.dsp_name') AS dsp_name,
            json_extract_string(details, '$.assigned_dsp_id') AS assigned_dsp_id
        FROM all_logs""",
    "q11_by_detail": f"""
        SELECT l.id, action, resource, resource_id, details, l.created_at, u.full_name AS user
        FROM all_logs l LEFT JOIN users u ON u.id = l.user_id
        WHERE json_extract_string(details, '$.assigned_dsp_id') = 'u08'
        ORDER BY l.created_at DESC, {num('l.id', 'al')} LIMIT 100""",
    "s02_bad_rows": """
        SELECT 'merchant_signals' AS table_name,
            CASE WHEN kind = 5 THEN 'xx' || id ELSE id END AS id,
            CASE kind WHEN 1 THEN 'unreadable' WHEN 2 THEN 'unreadable' WHEN 3 THEN 'merchant_id not null'
                WHEN 4 THEN 'campaign_status allowed' ELSE 'id form' END AS reason
        FROM landed WHERE kind BETWEEN 1 AND 5""",
}


def _after(sql: str) -> str:
    """The SQL over the tables after the status changes and the assignments."""
    for name in ("areas", "performance", "joined", "merchants", "recs"):
        sql = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {name}_after", sql)
    return sql


CTES |= {
    "recs_after": QUERIES_SQL["m01_recs"], "merchants_after": QUERIES_SQL["m07_merchants"],
    "joined_after": _after(CTES["joined"]), "areas_after": _after(CTES["areas"]),
    "performance_after": _after(CTES["performance"]),
}
QUERIES_SQL |= {
    "s05_kept": _after(QUERIES_SQL["q15_area"]),
    "s05_kept_dsps": _after(QUERIES_SQL["q19_dsp"]),
    "s05_kept_dashboards": _after(QUERIES_SQL["q13_manager_all"]),
}


# The model's tables by name, for the integrity rules.
MODEL_SQL = {
    "users": "users", "merchants": "merchants", "merchant_signals": "signals",
    "daily_scores": f"(SELECT {gid('ds', SCORE_NUMBER)} AS id, * FROM scores)",
    "recommendations": "recs", "visit_history": "visits",
    "audit_logs": "logs", "chat_sessions": "sessions", "chat_messages": "messages",
}


def _literal(value: object) -> str:
    if isinstance(value, date):
        return f"DATE '{value}'"
    return "NULL" if value is None else repr(value)


def _damaged(name: str) -> str:
    prefix = ID_PREFIX.get(name, "cs")
    number = num(DAMAGE_ID.get(name, "id"), prefix)
    changed = ", ".join(
        f"CASE {' '.join(f'WHEN {number} % {DAMAGE_STEP} = {r} THEN {_literal(v)}' for r, v in reversed(values))}"
        f" ELSE {column} END AS {column}"
        for column, values in damages(name).items())
    return f"(SELECT * REPLACE ({changed}) FROM {MODEL_SQL[name]})"


def _violations(name: str, new: str = "TRUE") -> list[str]:
    """The rules that rows with ``new`` break."""
    table, rules, found = f"damaged_{name}", RULES[name], []

    def by_value(rule: str, column: str, where: str) -> str:
        return (f"SELECT '{name}' AS table_name, '{rule}' AS rule, {column} AS value, count(*) AS n"
                f" FROM {table} WHERE {new} AND {where} GROUP BY {column}")

    for key in rules.unique:
        text = " || ',' || ".join(f"CAST({c} AS VARCHAR)" for c in key)
        known = " AND ".join(f"{c} IS NOT NULL" for c in key)
        found.append(f"SELECT '{name}', '{','.join(key)} unique', {text}, count(*) FROM {table}"
                     f" WHERE {known} GROUP BY {', '.join(key)} HAVING count(*) > 1 AND bool_or({new})")
    found += [f"SELECT '{name}', '{c} not null', NULL, count(*) FROM {table} WHERE {new} AND {c} IS NULL"
              " HAVING count(*) > 0" for c in rules.not_null]
    found += [by_value(f"{c} allowed", c, f"{c} NOT IN ({', '.join(map(repr, values))})")
              for c, values in rules.allowed.items()]
    found += [by_value(f"{c} length", c, f"length({c}) > {size}") for c, size in rules.max_length.items()]
    found += [by_value(f"{c} in {parent}", c, f"{c} IS NOT NULL AND {c} NOT IN"
                       f" (SELECT id FROM damaged_{parent} WHERE id IS NOT NULL)")
              for c, parent in rules.references.items()]
    return found


CTES |= {f"damaged_{name}": f"SELECT * FROM {_damaged(name)}" for name in RULES}
QUERIES_SQL["d01_violations"] = "SELECT table_name, rule, value, n FROM (" + " UNION ALL ".join(
    ["SELECT '' AS table_name, '' AS rule, '' AS value, 0 AS n WHERE FALSE"]
    + [sql for name in RULES for sql in _violations(name)]) + ")"

QUERIES_SQL["d01_batch"] = "SELECT table_name, rule, value, n FROM (" + " UNION ALL ".join(
    ["SELECT '' AS table_name, '' AS rule, '' AS value, 0 AS n WHERE FALSE"]
    + [sql for name, c in (PARTITION_COLUMN | {"audit_logs": "created_at"}).items()
       for sql in _violations(name, f"coalesce(CAST({c} AS DATE) = {AS_OF}, TRUE)")]) + ")"


def _words(sql: str) -> set[str]:
    return set(re.findall(r"\w+", sql))


def with_ctes(sql: str) -> str:
    """The query behind the CTEs it uses, directly or through others."""
    needed, seen = [], set()

    def visit(text: str) -> None:
        for name in CTES:
            if name in _words(text) and name not in seen:
                seen.add(name)
                visit(CTES[name])
                needed.append(name)

    visit(sql)
    if not needed:
        return sql.strip()
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in needed) + "\n" + sql.strip()


ORACLE_SQL = {name: with_ctes(sql) for name, sql in QUERIES_SQL.items()}

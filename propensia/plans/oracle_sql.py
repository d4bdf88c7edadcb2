"""DuckDB oracle SQL for the registered queries.

Written independently of the Spark plans: the ``leads`` recipe, the default
fill, the derived features and the deterministic score are spelled out in
SQL here; nothing is imported from the Spark side but the declared schema.
"""

from __future__ import annotations

import zlib

from .. import schema as S

# Written out again (not imported), so that a wrong list on the other side shows.
_TEXTS = {
    "acquisition_channel": "['organic', 'referral', 'youtube', 'ads']",
    "student_stage": "['student', 'graduate', 'professional', 'student']",
    "most_active_time_window": "['morning', 'evening', 'night', 'evening']",
    "ai_mentor_topic": "['none', 'gate', 'dsa', 'career']",
    "gate_exam_urgency": "['low', 'medium', 'high', 'medium']",
    "call_duration_bucket": "['none', 'short', 'long', 'short']",
}


def _drawn_sql(name: str) -> str:
    """A column that the tables cannot supply: drawn from 24 bits of md5(id) and the checksum of the column's name."""
    c = zlib.crc32(name.encode())
    u = f"((c.h * {c & 0xFFFFF | 1} + {c >> 8}) & 16777215)"
    k = f"({u} >> 4)"
    t = S.column_type(name).simpleString()
    if name in _TEXTS:
        value = f"{_TEXTS[name]}[({k} & 3) + 1]"
    elif t == "int":
        value = f"CAST({k} & 1 AS INTEGER)"
    elif name in S.RANGE_RULES:
        lo, hi = S.RANGE_RULES[name]
        value = f"{float(lo)}::DOUBLE + CAST({k} & 1023 AS DOUBLE) * {(hi - lo) / 1023.0!r}::DOUBLE"
    elif name == "engagement_intensity":
        value = f"CAST({k} & 1023 AS DOUBLE)"
    elif name == "counsellor_call_duration_mins":
        value = f"CAST({k} & 15 AS DOUBLE) * 0.5::DOUBLE"
    else:
        value = f"CAST({k} & 31 AS DOUBLE)"
    return f"CASE WHEN ({u} & 15) <> 0 THEN {value} END AS {name}"


_DERIVED_SQL = {
    "student_id": "CAST(c.c_custkey AS VARCHAR)",
    "course_interest": "c.c_mktsegment",
    "purchased_paid_course": "CAST(coalesce(op.label, 0) AS INTEGER)",
    "pricing_page_visits": "CAST(ev.n_view AS DOUBLE)",
    "ai_mentor_total_messages": "CAST(ev.n_click AS DOUBLE)",
    "cart_items_count": "CAST(ev.n_signup AS DOUBLE)",
    "total_platform_minutes": "CAST(ev.value_sum AS DOUBLE)",
    "active_days_30d": "CAST(ev.active_days AS DOUBLE)",
    "last_login_days_ago": "CAST(date_diff('day', CAST(op.last_prior AS DATE), DATE '2001-01-01') AS DOUBLE)",
    "registration_days_ago": "CAST(date_diff('day', CAST(op.first_prior AS DATE), DATE '2001-01-01') AS DOUBLE)",
    "session_depth": "CAST(coalesce(op.prior_orders, 0) AS DOUBLE)",
    "login_frequency_14d": "CAST(coalesce(op.recent_orders, 0) AS DOUBLE)",
}


def _leads_select() -> str:
    cols = []
    for name in S.MODEL_SCHEMA_COLUMNS:
        if name in _DERIVED_SQL:
            cols.append(f"{_DERIVED_SQL[name]} AS {name}")
        else:
            cols.append(_drawn_sql(name))
    return ",\n    ".join(cols)


def _filled_select() -> str:
    """Default fill: every schema column, with the fill applied where listed."""
    cols = []
    for name in S.MODEL_SCHEMA_COLUMNS:
        if name in S.DERIVED_INPUT_DEFAULTS:
            d = S.DERIVED_INPUT_DEFAULTS[name]
            if isinstance(d, str):
                cols.append(f"coalesce({name}, '{d}') AS {name}")
            elif S.column_type(name).simpleString() == "int":
                cols.append(f"coalesce({name}, {int(d)}) AS {name}")
            else:
                cols.append(f"coalesce({name}, CAST({d} AS DOUBLE)) AS {name}")
        else:
            cols.append(name)
    return ",\n    ".join(cols)


LEADS_CTE = f"""
op AS (
  SELECT o_custkey AS c_custkey,
    max(CASE WHEN o_orderdate >= TIMESTAMP '2001-01-01' AND o_orderdate < TIMESTAMP '2001-04-01' THEN 1 ELSE 0 END) AS label,
    count(*) FILTER (WHERE o_orderdate < TIMESTAMP '2001-01-01') AS prior_orders,
    count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '2000-10-01' AND o_orderdate < TIMESTAMP '2001-01-01') AS recent_orders,
    max(o_orderdate) FILTER (WHERE o_orderdate < TIMESTAMP '2001-01-01') AS last_prior,
    min(o_orderdate) FILTER (WHERE o_orderdate < TIMESTAMP '2001-01-01') AS first_prior
  FROM orders GROUP BY o_custkey
),
ev AS (
  SELECT user_id AS c_custkey,
    count(*) FILTER (WHERE event_type = 'view') AS n_view,
    count(*) FILTER (WHERE event_type = 'click') AS n_click,
    count(*) FILTER (WHERE event_type = 'signup') AS n_signup,
    sum(value) AS value_sum,
    count(DISTINCT CAST(ts AS DATE)) AS active_days
  FROM events GROUP BY user_id
),
leads AS (
  SELECT
    {_leads_select()}
  FROM (SELECT *, ('0x' || substr(md5(c_custkey::VARCHAR), 1, 6))::BIGINT AS h FROM customer) c LEFT JOIN op ON op.c_custkey = c.c_custkey LEFT JOIN ev ON ev.c_custkey = c.c_custkey
),
filled AS (
  SELECT
    {_filled_select()}
  FROM leads
),
feat AS (
  SELECT *,
    ai_mentor_total_messages / (ai_mentor_last_used_days_ago + 1) AS ai_mentor_recency_weight,
    ai_mentor_total_messages / (registration_days_ago + 1) AS ai_mentor_msgs_per_day,
    login_frequency_14d / 14.0::DOUBLE AS daily_login_rate,
    CAST(counsellor_call_picked_up = 1 AND counsellor_call_duration_mins > 2 AS INTEGER) AS effective_call_flag,
    cart_items_count * (1.0::DOUBLE + coupon_code_applied) AS cart_seriousness,
    community_posts_count + community_comments_count * 0.5::DOUBLE + community_saved_posts * 0.3::DOUBLE AS community_depth,
    free_mock_test_count * (free_mock_test_avg_score / 100.0::DOUBLE + 0.01::DOUBLE) AS mock_commitment,
    pricing_page_visits * urgency_weight AS urgent_pricing_interest,
    total_platform_minutes / (active_days_30d + 1) AS minutes_per_active_day,
    session_depth / (login_frequency_14d + 1) AS depth_per_session_proxy
  FROM filled
),
scored AS (
  SELECT *,
    least(1.0::DOUBLE, 0.55::DOUBLE * ((('0x' || substr(md5('42|' || student_id), 1, 8))::BIGINT)::DOUBLE / 4294967296::DOUBLE)
      + 0.45::DOUBLE * CAST(purchased_paid_course AS DOUBLE)) AS score
  FROM feat
),
scored2 AS (
  SELECT *, round_even(score * 50.0::DOUBLE, 0) / 50.0::DOUBLE AS score_tied FROM scored
)"""


def with_leads(body: str, extra_ctes: str = "") -> str:
    """Prefix ``body`` with the leads / features / score CTE chain."""
    extra = f",\n{extra_ctes}" if extra_ctes else ""
    return f"WITH {LEADS_CTE}{extra}\n{body}"


TOP_SIGNAL_SQL = """CASE
    WHEN ai_mentor_recency_weight > 5 THEN 'Recent heavy AI mentor usage'
    WHEN pricing_page_visits > 3 AND cart_items_count > 0 THEN 'Repeated pricing and cart activity'
    WHEN engagement_intensity > 500 THEN 'High platform engagement intensity'
    WHEN current_streak_days >= 5 THEN 'Strong recent learning streak'
    ELSE 'Active community and study behavior' END"""


def pct_sql(score: str) -> str:
    return f"round_even({score} * 100.0::DOUBLE * 10.0::DOUBLE, 0) / 10.0::DOUBLE"


def tier_sql(score: str, high: float, outreach: float) -> str:
    return (
        f"CASE WHEN {score} >= {high!r}::DOUBLE THEN 'HIGH' "
        f"WHEN {score} >= {outreach!r}::DOUBLE THEN 'MID' ELSE 'LOW' END"
    )

"""Reading the driver tables and deriving the student (``leads``) table.

There is no student file among the test tables, so one lead per customer is
derived from ``customer``, ``orders`` and ``events`` (recipe in FIXTURES.md):
features use orders before a cut-off date, the label is "ordered in the three
months after it".  Every aggregate is a keyed ``groupBy`` with map-side
partial aggregation, so a customer holding a third of all orders or events
costs one partial row per map task, not a hot reducer.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..session import short_methods

CUTOFF = "2001-01-01"
LABEL_END = "2001-04-01"
RECENT_START = "2000-10-01"

# Values of the string columns that the driver tables cannot supply (recipe in FIXTURES.md).
LEAD_TEXTS = {
    "acquisition_channel": ["organic", "referral", "youtube", "ads"],
    "student_stage": ["student", "graduate", "professional", "student"],
    "most_active_time_window": ["morning", "evening", "night", "evening"],
    "ai_mentor_topic": ["none", "gate", "dsa", "career"],
    "gate_exam_urgency": ["low", "medium", "high", "medium"],
    "call_duration_bucket": ["none", "short", "long", "short"],
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def order_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-customer order aggregates up to the end of the label window (later orders never reach the scan)."""
    d = F.col("o_orderdate")
    o = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate").where(d < F.lit(LABEL_END).cast("timestamp"))
    prior = d < F.lit(CUTOFF).cast("timestamp")
    recent = (d >= F.lit(RECENT_START).cast("timestamp")) & prior
    return o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max(F.when(~prior, 1).otherwise(0)).alias("_label"),
        F.count_if(prior).alias("_prior_orders"),
        F.count_if(recent).alias("_recent_orders"),
        F.max(F.when(prior, d)).alias("_last_prior"),
        F.min(F.when(prior, d)).alias("_first_prior"),
    )


def event_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-user event counts, total value and distinct active dates."""
    e = read_table(spark, sf_dir, "events").select("user_id", "event_type", "value", "ts")
    return e.groupBy(F.col("user_id").alias("c_custkey")).agg(
        F.count_if(F.col("event_type") == "view").alias("_views"),
        F.count_if(F.col("event_type") == "click").alias("_clicks"),
        F.count_if(F.col("event_type") == "signup").alias("_signups"),
        F.sum("value").alias("_value"),
        F.count_distinct(F.to_date("ts")).alias("_active_days"),
    )


def draw_factors(name: str) -> tuple[int, int]:
    """Multiplier (odd) and increment of a column's draw, from the checksum of its name."""
    c = zlib.crc32(name.encode("ascii"))
    return (c & 0xFFFFF) | 1, c >> 8


def _drawn(name: str):
    """A column drawn from 24 bits of the id's md5 (``_h``): NULL for one draw in 16, else a value of the column's kind."""
    times, plus = draw_factors(name)
    u = (F.col("_h") * F.lit(times) + F.lit(plus)).bitwiseAND(0xFFFFFF)
    bits = lambda n: F.shiftright(u, 4).bitwiseAND((1 << n) - 1)
    if name in LEAD_TEXTS:
        value = F.element_at(F.array(*[F.lit(x) for x in LEAD_TEXTS[name]]), (bits(2) + 1).cast("int"))
    elif name in S.BINARY_COLUMNS:
        value = bits(1)
    elif name in S.RANGE_RULES:
        lo, hi = S.RANGE_RULES[name]
        value = F.lit(float(lo)) + bits(10).cast("double") * F.lit((hi - lo) / 1023.0)
    elif name == "engagement_intensity":
        value = bits(10).cast("double")
    elif name == "counsellor_call_duration_mins":
        value = bits(4).cast("double") * F.lit(0.5)
    else:
        value = bits(5).cast("double")
    return F.when(u.bitwiseAND(15) != 0, value)


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 86-column student row per customer, in declared schema order."""
    short_methods(spark)
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.conv(
        F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 6), 16, 10).cast("long").alias("_h"))
    joined = c.join(order_profile(spark, sf_dir), "c_custkey", "left").join(
        event_profile(spark, sf_dir), "c_custkey", "left"
    )
    cutoff = F.lit(CUTOFF).cast("date")
    derived = {
        "student_id": F.col("c_custkey").cast("string"),
        "course_interest": F.col("c_mktsegment"),
        "purchased_paid_course": F.coalesce(F.col("_label"), F.lit(0)),
        "pricing_page_visits": F.col("_views"),
        "ai_mentor_total_messages": F.col("_clicks"),
        "cart_items_count": F.col("_signups"),
        "total_platform_minutes": F.col("_value"),
        "active_days_30d": F.col("_active_days"),
        "last_login_days_ago": F.datediff(cutoff, F.to_date("_last_prior")),
        "registration_days_ago": F.datediff(cutoff, F.to_date("_first_prior")),
        "session_depth": F.coalesce(F.col("_prior_orders"), F.lit(0)),
        "login_frequency_14d": F.coalesce(F.col("_recent_orders"), F.lit(0)),
    }
    cols = []
    for name in S.MODEL_SCHEMA_COLUMNS:
        expr = derived[name] if name in derived else _drawn(name)
        cols.append(expr.cast(S.column_type(name)).alias(name))
    return joined.select(*cols)


def dirty_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leads with planted faults, so that every validation rule has rows that break it.

    By customer number modulo 97: 1 the id of the next smaller customer, 2 no
    id, 3 a blank id, 4 a target of 2, 5 binary columns at 3, 6 negative
    counts, 7 ranged columns above their limit, 8 ranged columns below it.
    """
    base = leads(spark, sf_dir).withColumn("_m", F.col("student_id").cast("long") % 97)
    m = F.col("_m")
    cols = []
    for name in S.MODEL_SCHEMA_COLUMNS:
        c = F.col(name)
        if name == S.ID_COLUMN:
            e = F.when(m == 1, (c.cast("long") - 1).cast("string")).when(m == 2, None).when(m == 3, F.lit("  ")).otherwise(c)
        elif name == S.TARGET_COLUMN:
            e = F.when(m == 4, 2).when(m == 5, 3).otherwise(c)
        elif name in S.BINARY_COLUMNS:
            e = F.when(m == 5, 3).otherwise(c)
        elif name in S.NON_NEGATIVE_COLUMNS:
            e = F.when(m == 6, -1.0).otherwise(c)
        elif name in S.RANGE_RULES:
            lo, hi = S.RANGE_RULES[name]
            e = F.when(m == 7, float(hi) + 0.5).when(m == 8, float(lo) - 0.5).otherwise(c)
        else:
            e = c
        cols.append(e.cast(S.column_type(name)).alias(name))
    return base.select(*cols)


def score_expr(id_col: str = S.ID_COLUMN, label_col: str = S.TARGET_COLUMN):
    """Deterministic, informative score: 0.55*u + 0.45*label, u from md5 of the id.

    Lets every ranking / metric / threshold operator be checked exactly
    against SQL without a trained model.
    """
    u = F.conv(F.substring(F.md5(F.concat(F.lit("42|"), F.col(id_col))), 1, 8), 16, 10).cast(
        "bigint"
    ).cast("double") / F.lit(4294967296.0)
    return F.least(F.lit(1.0), F.lit(0.55) * u + F.lit(0.45) * F.col(label_col).cast("double"))


def tie_expr(score):
    """Score snapped to a 1/50 grid (heavy ties), numpy-style half-even."""
    return F.rint(score * F.lit(50.0)) / F.lit(50.0)


def scored_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads with engineered features and the deterministic ``score``/``score_tied``."""
    from ..operators.features import engineer

    df = engineer(leads(spark, sf_dir))
    s = score_expr()
    return df.withColumn("score", s).withColumn("score_tied", tie_expr(F.col("score")))

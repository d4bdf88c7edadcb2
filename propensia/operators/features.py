"""Feature projections.

All derivations are plain column expressions; Catalyst collapses them into a
single Project inside whole-stage codegen.  Divisions use ``try_divide`` so a
bad row (e.g. a negative day count) yields NULL instead of aborting a job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions.numeric import round_to, to_double


def fill_defaults(df: DataFrame) -> DataFrame:
    """default-fill the derived-feature inputs that are present."""
    types = {f.name: f.dataType for f in df.schema.fields}
    repl = {}
    for name, default in S.DERIVED_INPUT_DEFAULTS.items():
        if name not in types:
            continue
        if isinstance(default, str):
            repl[name] = F.coalesce(F.col(name).cast("string"), F.lit(default))
        elif isinstance(types[name], T.NumericType):
            # already typed: keep the type, fill NULL (and NaN) only
            value = to_double(F.col(name), types[name]) if isinstance(
                types[name], (T.DoubleType, T.FloatType)
            ) else F.col(name)
            repl[name] = F.coalesce(value, F.lit(default).cast(types[name]))
        else:
            # raw text: strict numeric parse, then fill
            repl[name] = F.coalesce(to_double(F.col(name), types[name]), F.lit(float(default)))
    return df.withColumns(repl) if repl else df


def _div(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def derived_features() -> dict[str, Column]:
    """F1-F10 as named expressions over the filled inputs."""
    c = F.col
    return {
        "ai_mentor_recency_weight": _div(c("ai_mentor_total_messages"), c("ai_mentor_last_used_days_ago") + 1),
        "ai_mentor_msgs_per_day": _div(c("ai_mentor_total_messages"), c("registration_days_ago") + 1),
        "daily_login_rate": _div(c("login_frequency_14d"), F.lit(14.0)),
        "effective_call_flag": ((c("counsellor_call_picked_up") == 1) & (c("counsellor_call_duration_mins") > 2)).cast(
            "int"
        ),
        "cart_seriousness": c("cart_items_count") * (F.lit(1.0) + c("coupon_code_applied")),
        "community_depth": c("community_posts_count")
        + c("community_comments_count") * F.lit(0.5)
        + c("community_saved_posts") * F.lit(0.3),
        "mock_commitment": c("free_mock_test_count")
        * (_div(c("free_mock_test_avg_score"), F.lit(100.0)) + F.lit(0.01)),
        "urgent_pricing_interest": c("pricing_page_visits") * c("urgency_weight"),
        "minutes_per_active_day": _div(c("total_platform_minutes"), c("active_days_30d") + 1),
        "depth_per_session_proxy": _div(c("session_depth"), c("login_frequency_14d") + 1),
    }


def engineer(df: DataFrame) -> DataFrame:
    """F0 then F1-F10 (an absent input column fails analysis, as it should)."""
    return fill_defaults(df).withColumns(derived_features())


def model_frame(df: DataFrame, dropped: list[str] | None = None) -> DataFrame:
    """drop id, target and leak columns (absent ones are ignored)."""
    dropped = list(dropped if dropped is not None else S.leak_columns(df.columns))
    return df.drop(S.ID_COLUMN, S.TARGET_COLUMN, *dropped)


def model_inputs(df: DataFrame, model_input_columns: list[str], dropped: list[str]) -> DataFrame:
    """reindex the engineered frame to the trained column order.

    Keeps the id beside the inputs (scores must never be separated from keys).
    """
    frame = model_frame(df, dropped)
    missing = S.missing_columns(frame.columns, model_input_columns)
    if missing:
        raise ValueError(
            "Missing model columns after feature engineering: " + ", ".join(missing[:10])
        )
    return df.select(S.ID_COLUMN, *model_input_columns)


# ---------------------------------------------------------------------------
# Expand short behaviour profiles into full student rows
# ---------------------------------------------------------------------------

# FIXED VALUES: inputs a short profile carries (everything else is constant or derived).
PROFILE_INPUTS = [
    "acquisition_channel",
    "course_interest",
    "student_stage",
    "registration_days_ago",
    "targets_count",
    "login_frequency_14d",
    "total_platform_minutes",
    "session_depth",
    "last_login_days_ago",
    "current_streak_days",
    "active_days_30d",
    "free_platform_lectures_watched",
    "pyq_attempted_count",
    "pyq_accuracy_pct",
    "free_mock_test_count",
    "free_mock_test_avg_score",
    "onboarding_video_watched",
    "ai_mentor_sessions",
    "ai_mentor_total_messages",
    "ai_mentor_last_used_days_ago",
    "ai_mentor_daily_limit_hit",
    "ai_mentor_limit_hit_days",
    "ai_mentor_topic",
    "rank_predictor_used",
    "rank_predictor_course_clicked",
    "gate_exam_urgency",
    "communities_joined_count",
    "community_posts_count",
    "community_comments_count",
    "community_saved_posts",
    "pricing_page_visits",
    "demo_class_attended",
    "cart_items_count",
    "wishlist_count",
    "coupon_code_applied",
    "profile_completion_pct",
    "active_month",
    "course_urgency_score",
    "days_to_next_exam",
    "post_result_window",
    "is_peak_placement_season",
    "whatsapp_outreach_received",
    "whatsapp_replied",
    "counsellor_call_received",
    "counsellor_call_picked_up",
    "counsellor_call_duration_mins",
    "call_duration_bucket",
    "urgency_weight",
]

# FIXED VALUES: course names that switch on the target one-hots, and the
# profile-completion cut-offs for the has_* flags (strictly greater than).
PROFILE_COURSE_FLAGS = {"target_gate": "GATE", "target_placement": "Placement", "target_govt_jobs": "GovtJobs"}
PROFILE_COMPLETION_FLAGS = {"has_profile_picture": 40, "has_education_filled": 60, "has_career_goals": 70}
PROFILE_WINDOW = "evening"


def profile_derivations() -> dict[str, Column]:
    """intensity columns a short profile implies."""
    c = F.col
    return {
        "daily_avg_minutes": _div(c("total_platform_minutes"), F.greatest(c("active_days_30d"), F.lit(1))),
        "engagement_intensity": _div(c("total_platform_minutes") * c("login_frequency_14d"), F.lit(14.0)),
        "intent_score": (c("pricing_page_visits") * 10 + c("cart_items_count") * 20).cast("double"),
        "effective_call_minutes": F.when(
            c("counsellor_call_picked_up").cast("boolean"), c("counsellor_call_duration_mins")
        ).otherwise(F.lit(0.0)),
    }


def expand_profiles(profiles: DataFrame) -> DataFrame:
    """short profiles (``student_id`` + PROFILE_INPUTS) -> 86-column rows."""
    c = F.col
    present = set(profiles.columns)
    exprs: dict[str, Column] = {}
    for name in PROFILE_INPUTS:
        exprs[name] = c(name) if name in present else F.lit(None)
    exprs[S.ID_COLUMN] = c(S.ID_COLUMN)
    for flag, course in PROFILE_COURSE_FLAGS.items():
        exprs[flag] = (c("course_interest") == F.lit(course)).cast("int")
    for flag, cut in PROFILE_COMPLETION_FLAGS.items():
        exprs[flag] = (c("profile_completion_pct") > cut).cast("int")
    exprs["most_active_time_window"] = F.lit(PROFILE_WINDOW)
    base = profiles.select(*[e.alias(k) for k, e in exprs.items()])
    base = base.withColumns(profile_derivations())
    cols = []
    for name in S.MODEL_SCHEMA_COLUMNS:
        expr = F.col(name) if name in base.columns else F.lit(0)
        cols.append(expr.cast(S.column_type(name)).alias(name))
    return base.select(*cols)


def signal_columns() -> dict[str, Column]:
    """The eight behavioural signals of a student card (2 dp where rounded)."""
    c = F.col
    return {
        "ai_mentor_messages": c("ai_mentor_total_messages"),
        "ai_mentor_recency_score": round_to(c("ai_mentor_recency_weight"), 2),
        "pricing_page_visits": c("pricing_page_visits"),
        "cart_items": c("cart_items_count"),
        "community_depth_score": round_to(c("community_depth"), 2),
        "mock_test_commitment": round_to(c("mock_commitment"), 2),
        "current_streak_days": c("current_streak_days"),
        "days_since_login": c("last_login_days_ago"),
    }

"""Declared schema of the student (lead) table and the business constants.

Everything in the FIXED VALUES block must equal the values of the lead-scoring
application this engine re-implements: column names, rule lists, defaults and
money constants decide results, so they are written out plainly, in their
natural order, and never derived.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the reference application exactly)
# ---------------------------------------------------------------------------

ID_COLUMN = "student_id"
TARGET_COLUMN = "purchased_paid_course"

# Required columns of a training file, in file order.
MODEL_SCHEMA_COLUMNS = [
    "student_id",
    "acquisition_channel",
    "course_interest",
    "student_stage",
    "registration_days_ago",
    "targets_count",
    "target_gate",
    "target_placement",
    "target_govt_jobs",
    "login_frequency_14d",
    "total_platform_minutes",
    "session_depth",
    "last_login_days_ago",
    "most_active_time_window",
    "current_streak_days",
    "active_days_30d",
    "beta_mode_switched",
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
    "ai_mentor_image_uploaded",
    "ai_mentor_topic",
    "rank_predictor_used",
    "rank_predictor_coupon_copied",
    "rank_predictor_course_clicked",
    "gate_exam_urgency",
    "communities_joined_count",
    "community_posts_count",
    "community_comments_count",
    "community_saved_posts",
    "community_image_posted",
    "chat_initiated_count",
    "study_group_joined",
    "study_group_created",
    "followers_count",
    "following_count",
    "pricing_page_visits",
    "demo_class_attended",
    "cart_items_count",
    "wishlist_count",
    "coupon_code_applied",
    "profile_completion_pct",
    "has_profile_picture",
    "has_education_filled",
    "has_career_goals",
    "resume_uploaded",
    "standard_certificates",
    "job_notifications_enabled",
    "job_alerts_clicked_count",
    "job_applications_count",
    "resume_review_requested",
    "resume_review_completed",
    "mock_interview_requested",
    "mock_interview_completed",
    "question_reports_count",
    "feedback_submitted",
    "platform_rating",
    "referral_program_visited",
    "successful_referrals",
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
    "purchased_paid_course",
    "daily_avg_minutes",
    "engagement_intensity",
    "intent_score",
    "is_professional",
    "pro_intent_interaction",
    "effective_call_minutes",
    "urgency_weight",
]

STRING_COLUMNS = [
    "student_id",
    "acquisition_channel",
    "course_interest",
    "student_stage",
    "most_active_time_window",
    "ai_mentor_topic",
    "gate_exam_urgency",
    "call_duration_bucket",
]

BINARY_COLUMNS = [
    "target_gate",
    "target_placement",
    "target_govt_jobs",
    "beta_mode_switched",
    "onboarding_video_watched",
    "ai_mentor_daily_limit_hit",
    "ai_mentor_image_uploaded",
    "rank_predictor_used",
    "rank_predictor_coupon_copied",
    "rank_predictor_course_clicked",
    "community_image_posted",
    "study_group_joined",
    "study_group_created",
    "demo_class_attended",
    "coupon_code_applied",
    "has_profile_picture",
    "has_education_filled",
    "has_career_goals",
    "resume_uploaded",
    "job_notifications_enabled",
    "resume_review_requested",
    "resume_review_completed",
    "mock_interview_requested",
    "mock_interview_completed",
    "feedback_submitted",
    "referral_program_visited",
    "is_peak_placement_season",
    "whatsapp_outreach_received",
    "whatsapp_replied",
    "counsellor_call_received",
    "counsellor_call_picked_up",
    "purchased_paid_course",
]

NON_NEGATIVE_COLUMNS = [
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
    "free_mock_test_count",
    "ai_mentor_sessions",
    "ai_mentor_total_messages",
    "ai_mentor_last_used_days_ago",
    "ai_mentor_limit_hit_days",
    "communities_joined_count",
    "community_posts_count",
    "community_comments_count",
    "community_saved_posts",
    "chat_initiated_count",
    "followers_count",
    "following_count",
    "pricing_page_visits",
    "cart_items_count",
    "wishlist_count",
    "standard_certificates",
    "job_alerts_clicked_count",
    "job_applications_count",
    "question_reports_count",
    "successful_referrals",
    "days_to_next_exam",
    "post_result_window",
    "counsellor_call_duration_mins",
    "daily_avg_minutes",
    "engagement_intensity",
    "effective_call_minutes",
]

# column -> (inclusive min, inclusive max)
RANGE_RULES = {
    "pyq_accuracy_pct": (0, 100),
    "free_mock_test_avg_score": (0, 100),
    "profile_completion_pct": (0, 100),
    "platform_rating": (0, 5),
    "course_urgency_score": (0, 1),
    "urgency_weight": (0, 10),
}

UNCONSTRAINED_COLUMNS = [
    "active_month",
    "intent_score",
    "is_professional",
    "pro_intent_interaction",
]

# Post-purchase fields, dropped before training (checked in this order).
LEAKY_COLUMNS = [
    "standard_certificates",
    "completion_certificate",
    "paid_course_completed",
    "paid_content_hours_watched",
]

# Defaults applied to feature inputs when present (string -> fill, number -> coerce + fill).
DERIVED_INPUT_DEFAULTS = {
    "pyq_accuracy_pct": 0,
    "free_mock_test_avg_score": 0,
    "ai_mentor_topic": "none",
    "ai_mentor_total_messages": 0,
    "ai_mentor_last_used_days_ago": 999,
    "registration_days_ago": 0,
    "login_frequency_14d": 0,
    "counsellor_call_picked_up": 0,
    "counsellor_call_duration_mins": 0,
    "cart_items_count": 0,
    "coupon_code_applied": 0,
    "community_posts_count": 0,
    "community_comments_count": 0,
    "community_saved_posts": 0,
    "free_mock_test_count": 0,
    "pricing_page_visits": 0,
    "urgency_weight": 0,
    "total_platform_minutes": 0,
    "active_days_30d": 0,
    "session_depth": 0,
}

DERIVED_FEATURE_COLUMNS = [
    "ai_mentor_recency_weight",
    "ai_mentor_msgs_per_day",
    "daily_login_rate",
    "effective_call_flag",
    "cart_seriousness",
    "community_depth",
    "mock_commitment",
    "urgent_pricing_interest",
    "minutes_per_active_day",
    "depth_per_session_proxy",
]

COURSE_PRICE_INR = 4999
CALL_COST_INR = 150
RANDOM_STATE = 42
TEST_SIZE = 0.15
CALIBRATION_SIZE = 0.18
CV_FOLDS = 3
HIGH_PRECISION_TARGET = 0.80

# Threshold anchors added to the score-derived grid (the first is the break-even rate).
THRESHOLD_ANCHORS = [
    CALL_COST_INR / COURSE_PRICE_INR,
    0.05,
    0.10,
    0.20,
    0.30,
    0.40,
    0.50,
    0.60,
    0.70,
    0.80,
    0.90,
]
THRESHOLD_CLIP = (0.001, 0.999)

# Model candidates compared by cross-validation.
MODEL_CANDIDATES = [
    {
        "name": "balanced_depth4",
        "params": {
            "max_depth": 4,
            "learning_rate": 0.03,
            "n_estimators": 400,
            "min_child_weight": 3,
            "subsample": 0.85,
            "colsample_bytree": 0.85,
            "reg_lambda": 1.0,
        },
    },
    {
        "name": "balanced_depth5",
        "params": {
            "max_depth": 5,
            "learning_rate": 0.03,
            "n_estimators": 500,
            "min_child_weight": 5,
            "subsample": 0.80,
            "colsample_bytree": 0.80,
            "reg_lambda": 1.0,
        },
    },
    {
        "name": "steady_depth6",
        "params": {
            "max_depth": 6,
            "learning_rate": 0.02,
            "n_estimators": 700,
            "min_child_weight": 5,
            "subsample": 0.80,
            "colsample_bytree": 0.80,
            "reg_lambda": 1.5,
        },
    },
]

TIERS = ["HIGH", "MID", "LOW"]

# Tier -> recommended action text.
TIER_ACTIONS = {
    "HIGH": "Immediate priority call — high buying intent confirmed.",
    "MID": "Outreach ready — warm lead, schedule a follow-up call.",
    "LOW": "Nurture via email drip. Not yet ready for direct sales.",
}

# Top-signal labels, in rule order.
SIGNAL_RECENT_MENTOR = "Recent heavy AI mentor usage"
SIGNAL_PRICING_CART = "Repeated pricing and cart activity"
SIGNAL_INTENSITY = "High platform engagement intensity"
SIGNAL_STREAK = "Strong recent learning streak"
SIGNAL_DEFAULT = "Active community and study behavior"

# pandas' default NA tokens for read_csv (lower-case "none" is NOT among them).
NA_TOKENS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]

# ---------------------------------------------------------------------------
# end of FIXED VALUES
# ---------------------------------------------------------------------------

DOUBLE_COLUMNS = NON_NEGATIVE_COLUMNS + list(RANGE_RULES) + UNCONSTRAINED_COLUMNS


def column_type(name: str) -> T.DataType:
    """Declared Spark type of a schema column."""
    if name in STRING_COLUMNS:
        return T.StringType()
    if name in BINARY_COLUMNS:
        return T.IntegerType()
    return T.DoubleType()


def lead_schema() -> T.StructType:
    """The 86-column student table as an explicit StructType (file order)."""
    return T.StructType(
        [T.StructField(c, column_type(c), True) for c in MODEL_SCHEMA_COLUMNS]
    )


def raw_feature_columns(columns) -> list[str]:
    """Columns of a file other than id and target, in file order."""
    return [c for c in columns if c not in (ID_COLUMN, TARGET_COLUMN)]


def leak_columns(columns) -> list[str]:
    """Known leaky columns present in ``columns``, in the fixed list order."""
    present = set(columns)
    return [c for c in LEAKY_COLUMNS if c in present]


def missing_columns(columns, required) -> list[str]:
    present = set(columns)
    return [c for c in required if c not in present]

"""Feature engineering: the application's two cases plus derived values."""

import pytest

from propensia import schema as S
from propensia.operators.features import engineer, expand_profiles

ROW = {
    "pyq_accuracy_pct": None,
    "free_mock_test_avg_score": None,
    "ai_mentor_topic": None,
    "ai_mentor_total_messages": 10.0,
    "ai_mentor_last_used_days_ago": 1.0,
    "registration_days_ago": 9.0,
    "login_frequency_14d": 7.0,
    "counsellor_call_picked_up": 1,
    "counsellor_call_duration_mins": 4.0,
    "cart_items_count": 2.0,
    "coupon_code_applied": 1,
    "community_posts_count": 4.0,
    "community_comments_count": 6.0,
    "community_saved_posts": 10.0,
    "free_mock_test_count": 3.0,
    "pricing_page_visits": 5.0,
    "urgency_weight": 8.0,
    "total_platform_minutes": 240.0,
    "active_days_30d": 12.0,
    "session_depth": 14.0,
}
SCHEMA = ", ".join(
    f"{k} {'string' if k == 'ai_mentor_topic' else ('int' if isinstance(v, int) else 'double')}"
    for k, v in ROW.items()
)


def test_engineer_fills_missing_values_and_adds_columns(spark):
    df = spark.createDataFrame([tuple(ROW.values())], SCHEMA)
    r = engineer(df).first()
    for c in S.DERIVED_FEATURE_COLUMNS:
        assert c in r.asDict()
    assert r["ai_mentor_topic"] == "none"
    assert r["ai_mentor_recency_weight"] == pytest.approx(5.0)
    assert r["effective_call_flag"] == 1
    assert r["cart_seriousness"] == pytest.approx(4.0)
    assert r["mock_commitment"] == pytest.approx(0.03)
    assert r["ai_mentor_msgs_per_day"] == pytest.approx(1.0)
    assert r["daily_login_rate"] == pytest.approx(0.5)
    assert r["community_depth"] == pytest.approx(10.0)
    assert r["urgent_pricing_interest"] == pytest.approx(40.0)
    assert r["minutes_per_active_day"] == pytest.approx(240 / 13)
    assert r["depth_per_session_proxy"] == pytest.approx(1.75)


def test_leak_columns_only_returns_present_known_columns():
    cols = ["student_id", "standard_certificates", "paid_course_completed", "some_other_feature"]
    assert S.leak_columns(cols) == ["standard_certificates", "paid_course_completed"]


def test_last_used_default_is_999(spark):
    df = spark.createDataFrame([(None, 10.0, None)], "ai_mentor_last_used_days_ago double, ai_mentor_total_messages double, x string")
    from propensia.operators.features import fill_defaults

    assert fill_defaults(df).first()["ai_mentor_last_used_days_ago"] == 999.0


def test_expand_profiles(spark):
    df = spark.createDataFrame(
        [("P1", "GATE", 50.0, 100.0, 0.0, 7.0, 2.0, 1.0, 1, 6.0)],
        "student_id string, course_interest string, profile_completion_pct double, total_platform_minutes double, "
        "active_days_30d double, login_frequency_14d double, pricing_page_visits double, cart_items_count double, "
        "counsellor_call_picked_up int, counsellor_call_duration_mins double",
    )
    r = expand_profiles(df).first()
    assert len(r) == len(S.MODEL_SCHEMA_COLUMNS)
    assert (r["target_gate"], r["target_placement"], r["target_govt_jobs"]) == (1, 0, 0)
    assert (r["has_profile_picture"], r["has_education_filled"], r["has_career_goals"]) == (1, 0, 0)
    assert r["daily_avg_minutes"] == 100.0
    assert r["engagement_intensity"] == pytest.approx(50.0)
    assert r["intent_score"] == 40.0
    assert r["effective_call_minutes"] == 6.0
    assert r["most_active_time_window"] == "evening"

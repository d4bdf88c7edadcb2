"""Validation rules: the application's three cases plus edge cases."""

from pyspark.sql import types as T

from propensia import schema as S
from propensia.operators.validate import format_messages, validate, validation_report
from propensia.sources.files import normalise

# FIXED VALUES: the valid student row of the application's own test.
STRING_VALUES = {
    "student_id": "S001",
    "acquisition_channel": "organic",
    "course_interest": "GATE CSE",
    "student_stage": "student",
    "most_active_time_window": "evening",
    "ai_mentor_topic": "none",
    "gate_exam_urgency": "medium",
    "call_duration_bucket": "short",
}
OVERRIDES = {
    "registration_days_ago": 30,
    "login_frequency_14d": 7,
    "total_platform_minutes": 180,
    "session_depth": 6,
    "last_login_days_ago": 1,
    "current_streak_days": 5,
    "active_days_30d": 12,
    "pyq_accuracy_pct": 60,
    "free_mock_test_avg_score": 55,
    "profile_completion_pct": 80,
    "platform_rating": 4,
    "course_urgency_score": 0.6,
    "urgency_weight": 6,
    "days_to_next_exam": 90,
}


def valid_row(**changes):
    row = {}
    for c in S.MODEL_SCHEMA_COLUMNS:
        if c in STRING_VALUES:
            row[c] = STRING_VALUES[c]
        elif c in S.BINARY_COLUMNS:
            row[c] = 0
        else:
            row[c] = float(OVERRIDES.get(c, 0))
    row.update(changes)
    return row


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in S.MODEL_SCHEMA_COLUMNS) for r in rows], S.lead_schema())


def run(spark, rows, require_target=True):
    return validate(frame(spark, rows), S.MODEL_SCHEMA_COLUMNS, require_target)


def test_valid_row_passes(spark):
    res = run(spark, [valid_row()])
    assert res.is_valid, res.errors
    assert res.errors == []


def test_duplicate_ids_rejected(spark):
    res = run(spark, [valid_row(), valid_row()])
    assert not res.is_valid
    assert any("Duplicate student_id" in e for e in res.errors)


def test_invalid_binary_and_range_values_rejected(spark):
    res = run(spark, [valid_row(coupon_code_applied=2, profile_completion_pct=120.0)])
    text = format_messages(res.errors)
    assert "coupon_code_applied" in text
    assert "profile_completion_pct" in text
    assert text.startswith("- ")


def test_bad_target_reports_two_messages(spark):
    res = run(spark, [valid_row(purchased_paid_course=3)])
    assert "Target column must contain only 0/1 values." in res.errors
    assert "Column 'purchased_paid_course' must contain only 0/1 values." in res.errors


def test_target_skipped_when_not_required(spark):
    res = run(spark, [valid_row(purchased_paid_course=3)], require_target=False)
    assert res.is_valid


def test_blank_and_null_ids(spark):
    res = run(spark, [valid_row(student_id="  "), valid_row(student_id="S2")])
    assert "Blank or missing student_id values detected." in res.errors
    res = run(spark, [valid_row(student_id=None), valid_row(student_id=None)])
    assert "Blank or missing student_id values detected." in res.errors
    assert "Duplicate student_id values detected." in res.errors


def test_missing_columns_and_missing_id(spark):
    df = frame(spark, [valid_row()]).drop("student_id", "platform_rating")
    res = validate(df, S.MODEL_SCHEMA_COLUMNS, True)
    assert res.errors == ["Missing required columns: student_id, platform_rating"]


def test_empty_dataset(spark):
    res = validate(spark.createDataFrame([], S.lead_schema()), S.MODEL_SCHEMA_COLUMNS, True)
    assert res.errors == ["Dataset is empty."]


def test_warnings(spark):
    rows = [valid_row(student_id=f"S{i}", purchased_paid_course=1) for i in range(5)]
    res = run(spark, rows)
    assert res.is_valid
    assert "course_interest has fewer than 2 unique values in this file." in res.warnings
    assert "Target positive rate looks unusual at 100.0%." in res.warnings


def test_negative_values_and_error_order(spark):
    res = run(spark, [valid_row(session_depth=-1.0, platform_rating=9.0, coupon_code_applied=5)])
    assert res.errors == [
        "Column 'coupon_code_applied' must contain only 0/1 values.",
        "Column 'session_depth' contains negative values.",
        "Column 'platform_rating' must stay between 0 and 5.",
    ]


def test_unparsable_text_is_reported_not_nulled(spark):
    cols = ["student_id", "session_depth", "coupon_code_applied", "course_interest"]
    raw = spark.createDataFrame(
        [("a", "12d", "1", "NA"), ("b", " 12 ", "NA", "x"), ("c", "abc", "0", "none")],
        T.StructType([T.StructField(c, T.StringType()) for c in cols]),
    )
    rep = {(r["rule"], r["column"]): r["bad_rows"] for r in validation_report(raw, False).collect()}
    assert rep[("V16", "session_depth")] == 2  # '12d' and 'abc'; ' 12 ' parses
    assert rep[("V16", "coupon_code_applied")] == 0  # 'NA' is missing, not bad
    typed = normalise(raw).collect()
    assert [r["session_depth"] for r in typed] == [None, 12.0, None]
    assert [r["course_interest"] for r in typed] == [None, "x", "none"]

"""Row quarantine against the report and a plain version."""

from pyspark.sql import functions as F

from propensia import schema as S
from propensia.operators import quarantine as QU
from propensia.operators import validate as VA
from propensia.sources import tables as TB

SF001 = "/root/testdata/sf0.001"


def dirty(spark):
    return TB.dirty_leads(spark, SF001).drop("wishlist_count", "has_career_goals")


def test_counts_equal_the_report(spark):
    df = dirty(spark)
    report = {(r["rule"], r["column"]): r["bad_rows"] for r in VA.validation_report(df).collect()
              if r["severity"] == "error" and r["bad_rows"] and r["rule"] not in ("V1", "V2", "V3", "V6")}
    counts = QU.quarantine_counts(QU.quarantine(df)).collect()
    assert {(r["rule"], r["column"]): r["bad_rows"] for r in counts} == report and len(report) > 70
    assert all(r["bad_keys"] <= r["bad_rows"] for r in counts)


def test_duplicates_and_missing_ids(spark):
    rows = [("a", 1.0), ("a", 2.0), ("b", -1.0), (None, 3.0), (None, 4.0), (" ", 5.0), ("c", None), ("d", 6.0)]
    df = spark.createDataFrame(rows, f"{S.ID_COLUMN} string, session_depth double")
    got = sorted((r[S.ID_COLUMN] or "", tuple(r["rules"])) for r in QU.quarantine(df, require_target=False).collect())
    v4, v5 = f"V4:{S.ID_COLUMN}", f"V5:{S.ID_COLUMN}"
    assert got == [("", (v4, v5)), ("", (v4, v5)), (" ", (v5,)), ("a", (v4,)), ("a", (v4,)), ("b", ("V9:session_depth",))]
    keys = {r["rule"]: (r["bad_rows"], r["bad_keys"]) for r in QU.quarantine_counts(QU.quarantine(df, False)).collect()}
    assert keys == {"V4": (4, 2), "V5": (3, 2), "V9": (1, 1)}
    clean, held = QU.split_clean(df, False)
    assert sorted(r[S.ID_COLUMN] for r in clean.collect()) == ["c", "d"] and held.count() == 6


def test_raw_text_and_ragged_lines(spark):
    rows = [("a", "12", "1", None), ("b", "12d", "2", None), ("c", "NA", "yes", "c,NA,yes,9")]
    df = spark.createDataFrame(rows, f"{S.ID_COLUMN} string, session_depth string, coupon_code_applied string, {VA.BAD_LINE} string")
    got = {r[S.ID_COLUMN]: list(r["rules"]) for r in QU.quarantine(df, require_target=False).collect()}
    assert got == {"b": ["V8:coupon_code_applied", "V16:session_depth"],
                   "c": [f"S1:{VA.BAD_LINE}", "V16:coupon_code_applied"]}


def test_masks_hold_more_rules_than_one_long(spark):
    df = TB.leads(spark, SF001)
    narrow = QU.rule_masks(df)
    assert len(QU.rule_names(df)) > 63 and [c for c in narrow.columns if c.startswith("_mask")] == ["_mask0", "_mask1"]
    assert QU.quarantine(df).count() == 0
    hot = df.limit(20).withColumn(S.ID_COLUMN, F.lit("same"))
    assert QU.quarantine(hot).count() == 20

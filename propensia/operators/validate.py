"""Data-quality rules (V1-V16) as one aggregation pass plus one keyed count.

All row rules (binary, non-negative, range, unparsable-number, blank id,
target) are ``count_if`` expressions of a single ``agg`` -- one scan of the
data, partial aggregation on every map task.  Duplicate ids need a keyed
``groupBy`` (hash shuffle on the id with map-side combine, so one hot id costs
one partial row per task).  The result is a small DataFrame, one row per rule
checked, which the driver turns into error / warning lists.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions.numeric import is_na_token, parse_binary, to_double
from ..sources.files import BAD_LINE

@dataclass
class ValidationResult:
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    @property
    def is_valid(self) -> bool:
        return not self.errors


def format_messages(messages: list[str]) -> str:
    """``- msg`` lines."""
    return "\n".join(f"- {m}" for m in messages)


def _numeric(df: DataFrame, name: str) -> Column:
    t = df.schema[name].dataType
    if name in S.BINARY_COLUMNS and isinstance(t, T.StringType):
        return parse_binary(F.col(name))
    return to_double(F.col(name), t)


def _numeric_columns(df: DataFrame) -> list[str]:
    return [c for c in S.MODEL_SCHEMA_COLUMNS if c in set(df.columns) and c not in S.STRING_COLUMNS]


def _parsed(df: DataFrame) -> DataFrame:
    """Each numeric-declared column parsed once (``__n_<col>``) beside the raw columns.

    Rules then compare plain doubles; a raw text column is run through the
    number grammar a single time per value, not once per rule.
    """
    return df.select("*", *[_numeric(df, c).alias(f"__n_{c}") for c in _numeric_columns(df)])


def _rule_specs(df: DataFrame, require_target: bool) -> list[tuple[str, str, str, Column, str]]:
    """(rule, column, severity, bad-row predicate, message) in reference order.

    ``df`` is the output of ``_parsed``.
    """
    present = set(df.columns)

    def _numeric(_df, name):  # noqa: F811 - the parsed column, not a re-parse
        return F.col(f"__n_{name}")

    specs: list[tuple[str, str, str, Column, str]] = []
    idc = F.col(S.ID_COLUMN).cast("string")
    specs.append(("V5", S.ID_COLUMN, "error", idc.isNull() | (F.trim(idc) == ""),
                  "Blank or missing student_id values detected."))
    if require_target and S.TARGET_COLUMN in present:
        y = _numeric(df, S.TARGET_COLUMN)
        specs.append(("V7", S.TARGET_COLUMN, "error", y.isNotNull() & ~y.isin(0.0, 1.0),
                      "Target column must contain only 0/1 values."))
    for c in S.BINARY_COLUMNS:
        if c == S.TARGET_COLUMN and not require_target:
            continue
        if c in present:
            v = _numeric(df, c)
            specs.append(("V8", c, "error", v.isNotNull() & ~v.isin(0.0, 1.0),
                          f"Column '{c}' must contain only 0/1 values."))
    for c in S.NON_NEGATIVE_COLUMNS:
        if c in present:
            specs.append(("V9", c, "error", _numeric(df, c) < 0, f"Column '{c}' contains negative values."))
    for c, (lo, hi) in S.RANGE_RULES.items():
        if c in present:
            v = _numeric(df, c)
            specs.append(("V10", c, "error", (v < lo) | (v > hi),
                          f"Column '{c}' must stay between {lo} and {hi}."))
    if BAD_LINE in present:
        specs.append(("S1", BAD_LINE, "error", F.col(BAD_LINE).isNotNull(),
                      "Lines with too many or too few fields detected."))
    # Text that is not a number in a numeric column (raw string input only)
    for c in S.MODEL_SCHEMA_COLUMNS:
        if c in present and c not in S.STRING_COLUMNS and isinstance(df.schema[c].dataType, T.StringType):
            specs.append(("V16", c, "error", ~is_na_token(F.col(c)) & _numeric(df, c).isNull(),
                          f"Column '{c}' contains values that are not numbers."))
    return specs


def validation_report(df: DataFrame, require_target: bool = True, expected_columns: list[str] | None = None) -> DataFrame:
    """One row per checked rule with its bad-row count (single scan + id count).

    V1, V2 and V6 are about the columns: their count is that of missing ones.
    Without an id column only these three can be checked.
    """
    raw = df
    expected = list(expected_columns if expected_columns is not None else S.MODEL_SCHEMA_COLUMNS)
    missing = S.missing_columns(raw.columns, expected)
    no_id = int(S.ID_COLUMN not in raw.columns)
    no_target = int(require_target and S.TARGET_COLUMN not in raw.columns)
    heads = [("V1", None, len(missing), "Missing required columns: " + ", ".join(missing[:15]) if missing else None),
             ("V2", S.ID_COLUMN, no_id, f"Missing id column: {S.ID_COLUMN}." if no_id else None),
             ("V6", S.TARGET_COLUMN, no_target, f"Missing target column: {S.TARGET_COLUMN}." if no_target else None)]
    if no_id:
        return raw.sparkSession.createDataFrame(
            [(i, r, c, "error", n, n > 0, m) for i, (r, c, n, m) in enumerate(heads, 1)],
            "seq int, rule string, column string, severity string, bad_rows long, failed boolean, message string")
    df = _parsed(raw)
    specs = _rule_specs(df, require_target)
    present = set(raw.columns)
    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.count_if(pred).alias(f"_r{i}") for i, (_, _, _, pred, _) in enumerate(specs)]
    if "course_interest" in present:
        aggs.append(F.count_distinct(F.col("course_interest")).alias("_courses"))
    if require_target and S.TARGET_COLUMN in present:
        aggs.append(F.avg(F.col(f"__n_{S.TARGET_COLUMN}")).alias("_rate"))
    one = df.agg(*aggs)

    ids = raw.groupBy(F.col(S.ID_COLUMN).cast("string").alias("_id")).agg(F.count(F.lit(1)).alias("_c"))
    dups = ids.where(F.col("_c") > 1).agg(
        F.coalesce(F.sum("_c"), F.lit(0)).cast("long").alias("_dup_rows")
    )
    row = one.crossJoin(dups)  # both are global aggregates: exactly one row each

    items = []
    seq = 0

    def add(rule, column, severity, bad, failed, message):
        nonlocal seq
        seq += 1
        items.append(
            F.struct(
                F.lit(seq).alias("seq"),
                F.lit(rule).alias("rule"),
                F.lit(column).cast("string").alias("column"),
                F.lit(severity).alias("severity"),
                bad.cast("long").alias("bad_rows"),
                failed.alias("failed"),
                message.alias("message"),
            )
        )

    for rule, column, bad, message in heads:
        add(rule, column, "error", F.lit(bad), F.lit(bad > 0), F.lit(message).cast("string"))
    n = F.col("_n")
    add("V3", None, "error", F.when(n == 0, 1).otherwise(0), n == 0, F.lit("Dataset is empty."))
    add("V4", S.ID_COLUMN, "error", F.col("_dup_rows"), F.col("_dup_rows") > 0,
        F.lit("Duplicate student_id values detected."))
    for i, (rule, column, severity, _, message) in enumerate(specs):
        bad = F.col(f"_r{i}")
        add(rule, column, severity, bad, bad > 0, F.lit(message))
    if "course_interest" in present:
        add("V11", "course_interest", "warning", F.col("_courses"), F.col("_courses") < 2,
            F.lit("course_interest has fewer than 2 unique values in this file."))
    if require_target and S.TARGET_COLUMN in present:
        rate = F.col("_rate")
        add("V12", S.TARGET_COLUMN, "warning", F.lit(0), (rate < 0.02) | (rate > 0.80),
            F.format_string("Target positive rate looks unusual at %.1f%%.", rate * 100))
    return row.select(F.explode(F.array(*items)).alias("r")).select("r.*")


def report_text(report: DataFrame) -> DataFrame:
    """V13 as a table: (severity, text) with one ``- msg`` line per failed rule, in report order (under 200 lines)."""
    lines = F.sort_array(F.collect_list(F.struct("seq", F.concat(F.lit("- "), F.col("message")).alias("line"))))
    return report.where("failed").groupBy("severity").agg(lines.alias("l")).select("severity", F.array_join("l.line", "\n").alias("text"))


def validate(df: DataFrame, expected_columns: list[str], require_target: bool) -> ValidationResult:
    """Driver summary in the application's message order.

    The report is bounded by the number of rules (< 200 rows), so collecting
    it is safe at any data size.
    """
    result = ValidationResult()
    failed = [r for r in validation_report(df, require_target, expected_columns).collect() if r["failed"]]
    result.errors += [r["message"] for r in failed if r["rule"] == "V1"]
    if any(r["rule"] == "V2" for r in failed):
        return result
    if any(r["rule"] == "V3" for r in failed):
        result.errors.append("Dataset is empty.")
        return result
    for rule in ["S1", "V4", "V5", "V6", "V7", "V8", "V9", "V10", "V16"]:
        result.errors += [r["message"] for r in sorted(failed, key=lambda r: r["seq"]) if r["rule"] == rule]
    result.warnings += [r["message"] for r in sorted(failed, key=lambda r: r["seq"]) if r["severity"] == "warning"]
    return result


def require_valid(df: DataFrame, expected_columns: list[str], require_target: bool, what: str) -> ValidationResult:
    """Raise on errors (fail fast), return warnings to the caller."""
    res = validate(df, expected_columns, require_target)
    if res.errors:
        raise ValueError(f"{what} validation failed:\n" + format_messages(res.errors))
    return res

"""Oracle SQL text per registered query (same keys as ``catalog.QUERIES``)."""

from __future__ import annotations

from .. import schema as S
from .catalog import GONE, SALES_CAPACITY, SALES_MAX_DAYS
from .oracle_sql import TOP_SIGNAL_SQL, pct_sql, with_leads, tier_sql


def _features_sql() -> str:
    derived = [
        c if c == "effective_call_flag" else f"round({c}, 6) AS {c}" for c in S.DERIVED_FEATURE_COLUMNS
    ]
    cols = [S.ID_COLUMN] + list(S.DERIVED_INPUT_DEFAULTS) + derived
    return with_leads(f"SELECT {', '.join(cols)} FROM feat")


_SALES_SQL = with_leads(
    f"""
SELECT student_id, purchase_probability, tier, top_signal, course_interest, days_since_login
FROM (
  SELECT student_id,
    {pct_sql('score')} AS purchase_probability,
    CASE WHEN rk <= {SALES_CAPACITY} THEN 'HIGH' WHEN rk <= {3 * SALES_CAPACITY} THEN 'MID' ELSE 'LOW' END AS tier,
    top_signal, course_interest, days_since_login, score
  FROM (
    SELECT student_id, score, {TOP_SIGNAL_SQL} AS top_signal, course_interest,
      last_login_days_ago AS days_since_login,
      row_number() OVER (ORDER BY score DESC, student_id ASC) AS rk
    FROM scored2 WHERE purchased_paid_course = 0
  )
)
WHERE tier IN ('HIGH', 'MID') AND days_since_login <= {float(SALES_MAX_DAYS)!r}::DOUBLE
ORDER BY score DESC, student_id"""
)


ORACLES: dict[str, str] = {
    "leads": with_leads("SELECT * FROM leads"),
    "features": _features_sql(),
    "sales_sheet": _SALES_SQL,
}


# ---------------------------------------------------------------------------
# validation, ranking, metrics, thresholds, views
# ---------------------------------------------------------------------------

from .catalog import SUMMARY_THRESHOLDS, VIEW_HIGH, VIEW_OUTREACH  # noqa: E402


def r6(expr: str) -> str:
    """Same rounding as the Spark side: scale, half-even, unscale."""
    return f"round_even(({expr}) * 1000000.0::DOUBLE, 0) / 1000000.0::DOUBLE"


def r2(expr: str) -> str:
    return f"round_even(({expr}) * 100.0::DOUBLE, 0) / 100.0::DOUBLE"


def dbl(x: float) -> str:
    return f"{float(x)!r}::DOUBLE"


def _row_rules(raw_text: bool, absent: tuple[str, ...]) -> list[tuple[str, str, str, str]]:
    """(rule, column, predicate, message) of the row rules."""
    rules = [("V5", "student_id", "student_id IS NULL OR trim(student_id) = ''",
              "Blank or missing student_id values detected.")]
    rules.append(("V7", S.TARGET_COLUMN, f"{S.TARGET_COLUMN} IS NOT NULL AND {S.TARGET_COLUMN} NOT IN (0, 1)",
                  "Target column must contain only 0/1 values."))
    for c in S.BINARY_COLUMNS:
        rules.append(("V8", c, f"{c} IS NOT NULL AND {c} NOT IN (0, 1)", f"Column '{c}' must contain only 0/1 values."))
    for c in S.NON_NEGATIVE_COLUMNS:
        rules.append(("V9", c, f"{c} < 0", f"Column '{c}' contains negative values."))
    for c, (lo, hi) in S.RANGE_RULES.items():
        rules.append(("V10", c, f"{c} < {lo} OR {c} > {hi}", f"Column '{c}' must stay between {lo} and {hi}."))
    if raw_text:
        # every numeric column read as text: values that do not parse as a number
        for c in S.MODEL_SCHEMA_COLUMNS:
            if c not in S.STRING_COLUMNS:
                rules.append(("V16", c, f"{c} IS NOT NULL AND TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE) IS NULL",
                              f"Column '{c}' contains values that are not numbers."))
    return [r for r in rules if r[1] not in absent]


def _validation_sql(raw_text: bool = False, src: str = "leads", absent: tuple[str, ...] = (), extra_ctes: str = "") -> str:
    rules = _row_rules(raw_text, absent)
    counts = ",\n    ".join(f"count(*) FILTER (WHERE {pred}) AS r{i}" for i, (_, _, pred, _) in enumerate(rules))
    gone = f"'Missing required columns: {', '.join(absent)}'" if absent else "CAST(NULL AS VARCHAR)"
    parts = [
        "SELECT 1 AS seq, 'V1' AS rule, CAST(NULL AS VARCHAR) AS \"column\", 'error' AS severity, "
        f"CAST({len(absent)} AS BIGINT) AS bad_rows, {len(absent)} > 0 AS failed, {gone} AS message",
        "SELECT 2, 'V2', 'student_id', 'error', 0, false, NULL",
        f"SELECT 3, 'V6', '{S.TARGET_COLUMN}', 'error', 0, false, NULL",
        "SELECT 4, 'V3', NULL, 'error', CAST(CASE WHEN n = 0 THEN 1 ELSE 0 END AS BIGINT), n = 0, 'Dataset is empty.' FROM agg",
        "SELECT 5, 'V4', 'student_id', 'error', dup_rows, dup_rows > 0, "
        "'Duplicate student_id values detected.' FROM dup",
    ]
    seq = 5
    for i, (rule, col, _, msg) in enumerate(rules):
        seq += 1
        m = msg.replace("'", "''")
        parts.append(f"SELECT {seq}, '{rule}', '{col}', 'error', CAST(r{i} AS BIGINT), r{i} > 0, '{m}' FROM agg")
    seq += 1
    parts.append(f"SELECT {seq}, 'V11', 'course_interest', 'warning', CAST(courses AS BIGINT), courses < 2, "
                 "'course_interest has fewer than 2 unique values in this file.' FROM agg")
    seq += 1
    parts.append(f"SELECT {seq}, 'V12', '{S.TARGET_COLUMN}', 'warning', CAST(0 AS BIGINT), "
                 "rate < 0.02::DOUBLE OR rate > 0.80::DOUBLE, "
                 "printf('Target positive rate looks unusual at %.1f%%.', rate * 100) FROM agg")
    ctes = f"""agg AS (
  SELECT count(*) AS n,
    {counts},
    count(DISTINCT course_interest) AS courses,
    avg(CAST({S.TARGET_COLUMN} AS DOUBLE)) AS rate
  FROM {src}
),
dup AS (
  SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS dup_rows
  FROM (SELECT student_id, count(*) AS c FROM {src} GROUP BY student_id) WHERE c > 1
)"""
    ctes = extra_ctes + ctes
    return with_leads("SELECT CAST(seq AS INTEGER) AS seq, * EXCLUDE (seq) FROM (\n" + "\nUNION ALL\n".join(parts) + "\n)", ctes)


_RANKED = """rk AS (
  SELECT student_id, score_tied AS s, purchased_paid_course AS y,
    row_number() OVER (ORDER BY score_tied DESC, student_id ASC) AS rank,
    count(*) OVER () AS n,
    avg(CAST(purchased_paid_course AS DOUBLE)) OVER () AS base,
    sum(CAST(purchased_paid_course AS DOUBLE)) OVER () AS pos_total
  FROM scored2
)"""

_DECILE_SQL = with_leads(f"""
SELECT CAST(g.decile AS INTEGER) AS decile,
  CAST(count(d.y) AS BIGINT) AS students,
  CAST(coalesce(sum(d.y), 0) AS BIGINT) AS actual_buyers,
  {r6('avg(CAST(d.y AS DOUBLE))')} AS conversion_rate,
  {r6('avg(d.s)')} AS avg_probability,
  {r6('avg(CAST(d.y AS DOUBLE)) / (max(t.base) + 1e-9::DOUBLE)')} AS lift
FROM (SELECT range AS decile FROM range(1, 11)) g
CROSS JOIN (SELECT avg(CAST(purchased_paid_course AS DOUBLE)) AS base FROM scored2) t
LEFT JOIN (SELECT CAST(floor((10 * rank - 1) / n) AS INTEGER) + 1 AS decile, y, s FROM rk) d ON d.decile = g.decile
GROUP BY g.decile""", _RANKED)

_LIFT_SQL = with_leads(f"""
SELECT fraction, n_top,
  {r6('sum(CAST(y AS DOUBLE)) / (max(pos_total) + 1e-9::DOUBLE)')} AS buyers_captured,
  {r6('(sum(CAST(y AS DOUBLE)) / n_top) / (max(pos_total) / max(n) + 1e-9::DOUBLE)')} AS lift,
  {r6('sum(CAST(y AS DOUBLE)) / n_top')} AS top_conversion_rate
FROM (SELECT fraction, CAST(greatest(1, ceil((SELECT count(*) FROM scored2) * fraction)) AS BIGINT) AS n_top
      FROM (VALUES (0.1::DOUBLE), (0.2::DOUBLE)) f(fraction)) c
JOIN rk ON rk.rank <= c.n_top
GROUP BY fraction, n_top""", _RANKED)

_GAINS_SQL = with_leads(f"""
SELECT student_id, CAST(rank AS BIGINT) AS rank,
  CAST(sum(y) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum_buyers,
  {r6('rank / n * 100')} AS pct_contacted,
  {r6('sum(CAST(y AS DOUBLE)) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING) / (pos_total + 1e-9::DOUBLE) * 100')} AS pct_captured
FROM rk""", _RANKED)

_GLOBAL_RANK_SQL = with_leads("""
SELECT student_id, score_tied, CAST(row_number() OVER (ORDER BY score_tied DESC, student_id) AS BIGINT) AS rank
FROM scored2""")


def _curve_ctes(score: str) -> str:
    return f"""c AS (
  SELECT {score} AS s, sum(CAST(purchased_paid_course AS BIGINT)) AS pos, sum(1 - CAST(purchased_paid_course AS BIGINT)) AS neg
  FROM scored2 GROUP BY {score}
),
cc AS (
  SELECT s, pos, neg,
    row_number() OVER (ORDER BY s DESC) AS k,
    CAST(sum(pos) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS tp,
    CAST(sum(neg) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS fp,
    CAST(sum(pos) OVER () AS DOUBLE) AS P,
    CAST(sum(neg) OVER () AS DOUBLE) AS N
  FROM c
),
pts AS (
  SELECT *, tp / (tp + fp) AS prec, tp / P AS rec, fp / N AS fpr, tp / P AS tpr FROM cc
),
lagged AS (
  SELECT *,
    coalesce(lag(prec) OVER (ORDER BY s DESC), 1.0::DOUBLE) AS prev_prec,
    coalesce(lag(rec) OVER (ORDER BY s DESC), 0.0::DOUBLE) AS prev_rec,
    coalesce(lag(fpr) OVER (ORDER BY s DESC), 0.0::DOUBLE) AS prev_fpr,
    coalesce(lag(tpr) OVER (ORDER BY s DESC), 0.0::DOUBLE) AS prev_tpr,
    lead(pos) OVER (ORDER BY s DESC) AS next_pos,
    lead(neg) OVER (ORDER BY s DESC) AS next_neg,
    max(k) OVER () AS kmax
  FROM pts
)"""


def _metrics_sql(score: str) -> str:
    return with_leads(f"""
SELECT {r6('sum((fpr - prev_fpr) * (tpr + prev_tpr) / 2)')} AS roc_auc,
  {r6('sum((rec - prev_rec) * prec)')} AS average_precision,
  {r6('sum((rec - prev_rec) * (prec + prev_prec) / 2)')} AS pr_auc,
  (SELECT {r6(f'avg(pow({score} - CAST(purchased_paid_course AS DOUBLE), 2))')} FROM scored2) AS brier_score
FROM lagged""", _curve_ctes(score))


_ROC_SQL = with_leads(f"""
SELECT CAST(0 AS BIGINT) AS point, CAST(NULL AS DOUBLE) AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr
UNION ALL
SELECT CAST(k AS BIGINT), s, {r6('fp / N')}, {r6('tp / P')}
FROM lagged WHERE k = 1 OR k = kmax OR next_pos <> pos OR next_neg <> neg""", _curve_ctes("score_tied"))

_PR_SQL = with_leads(f"""
SELECT CAST(k AS BIGINT) AS point, s AS threshold, {r6('prec')} AS precision, {r6('rec')} AS recall FROM lagged
UNION ALL
SELECT CAST(max(k) + 1 AS BIGINT), CAST(NULL AS DOUBLE), 1.0::DOUBLE, 0.0::DOUBLE FROM lagged""",
                     _curve_ctes("score_tied"))

_EDGE_SUM = " + ".join(f"CAST(score > {i} * 0.1::DOUBLE AS INTEGER)" for i in range(1, 10))
_CALIB_SQL = with_leads(f"""
SELECT bin, count(*) AS students, {r6('avg(CAST(purchased_paid_course AS DOUBLE))')} AS prob_true,
  {r6('avg(score)')} AS prob_pred
FROM (SELECT ({_EDGE_SUM}) AS bin, purchased_paid_course, score FROM scored2)
GROUP BY bin""")

_CONFUSION_SQL = with_leads(f"""
SELECT a.actual, p.predicted,
  (SELECT count(*) FROM scored2 WHERE purchased_paid_course = a.actual
     AND CAST(score_tied >= {dbl(VIEW_HIGH)} AS INTEGER) = p.predicted) AS students
FROM (VALUES (0), (1)) a(actual), (VALUES (0), (1)) p(predicted)""")


def _summary_select(tp: str, fp: str, n: str, P: str) -> str:
    return f"""{r6(f'{tp} / ({tp} + {fp} + 1e-9::DOUBLE)')} AS precision,
  {r6(f'{tp} / ({tp} + ({P} - {tp}) + 1e-9::DOUBLE)')} AS recall,
  {r6(f'({tp} + {fp}) / {n}')} AS coverage,
  CAST({S.COURSE_PRICE_INR} * {tp} - {S.CALL_COST_INR} * ({tp} + {fp}) AS BIGINT) AS profit,
  CAST({tp} AS BIGINT) AS true_positive, CAST({fp} AS BIGINT) AS false_positive,
  CAST({P} - {tp} AS BIGINT) AS false_negative"""


_THRESHOLDS_VALUES = ", ".join(f"({dbl(t)})" for t in SUMMARY_THRESHOLDS)
_SUMMARY_SQL = with_leads(f"""
SELECT threshold, {_summary_select('tp', 'fp', 'n', 'P')}
FROM (
  SELECT t.threshold,
    CAST(count(*) FILTER (WHERE s.score_tied >= t.threshold AND s.purchased_paid_course = 1) AS DOUBLE) AS tp,
    CAST(count(*) FILTER (WHERE s.score_tied >= t.threshold AND s.purchased_paid_course = 0) AS DOUBLE) AS fp,
    CAST(count(*) AS DOUBLE) AS n,
    CAST(sum(s.purchased_paid_course) AS DOUBLE) AS P
  FROM (VALUES {_THRESHOLDS_VALUES}) t(threshold) CROSS JOIN scored2 s
  GROUP BY t.threshold
)""")

_ANCHORS = ", ".join(f"({dbl(a)})" for a in S.THRESHOLD_ANCHORS)
_CAND_CTE = f"""cand AS (
  SELECT DISTINCT least(greatest(t, {dbl(S.THRESHOLD_CLIP[0])}), {dbl(S.THRESHOLD_CLIP[1])}) AS threshold
  FROM (SELECT round_even(score * 10000.0::DOUBLE, 0) / 10000.0::DOUBLE AS t FROM scored2
        UNION ALL SELECT * FROM (VALUES {_ANCHORS}) a(t))
),
sw_raw AS (
  SELECT c.threshold,
    CAST(count(*) FILTER (WHERE s.score >= c.threshold AND s.purchased_paid_course = 1) AS DOUBLE) AS tp,
    CAST(count(*) FILTER (WHERE s.score >= c.threshold AND s.purchased_paid_course = 0) AS DOUBLE) AS fp
  FROM cand c CROSS JOIN scored2 s GROUP BY c.threshold
),
tot AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(purchased_paid_course) AS DOUBLE) AS P FROM scored2),
sw AS (
  SELECT threshold, tp, fp, n, P,
    tp / (tp + fp + 1e-9::DOUBLE) AS prec_raw,
    tp / (tp + (P - tp) + 1e-9::DOUBLE) AS rec_raw
  FROM sw_raw CROSS JOIN tot
)"""

_CAND_SQL = with_leads("SELECT threshold FROM cand", _CAND_CTE.split(",\nsw_raw AS")[0])
_SWEEP_SQL = with_leads(f"SELECT threshold, {_summary_select('tp', 'fp', 'n', 'P')} FROM sw", _CAND_CTE)
_POLICY_SQL = with_leads(f"""
SELECT policy, threshold, {_summary_select('tp', 'fp', 'n', 'P')}
FROM (
  SELECT 'outreach' AS policy, * FROM o
  UNION ALL
  SELECT 'high', * FROM (SELECT CASE WHEN h.threshold < o.threshold THEN o.threshold ELSE h.threshold END AS threshold,
      CASE WHEN h.threshold < o.threshold THEN o.tp ELSE h.tp END AS tp,
      CASE WHEN h.threshold < o.threshold THEN o.fp ELSE h.fp END AS fp,
      h.n, h.P
    FROM h CROSS JOIN o)
)""", _CAND_CTE + """,
o AS (SELECT threshold, tp, fp, n, P FROM sw ORDER BY (4999 * tp - 150 * (tp + fp)) DESC, prec_raw DESC, rec_raw DESC, threshold ASC LIMIT 1),
valid AS (SELECT * FROM sw WHERE tp > 0 AND prec_raw >= 0.8::DOUBLE),
h AS (
  SELECT threshold, tp, fp, n, P FROM valid ORDER BY rec_raw DESC, prec_raw DESC, threshold ASC LIMIT 1
),
h2 AS (SELECT 1)""".replace("""h AS (
  SELECT threshold, tp, fp, n, P FROM valid ORDER BY rec_raw DESC, prec_raw DESC, threshold ASC LIMIT 1
),
h2 AS (SELECT 1)""", """h AS (
  SELECT threshold, tp, fp, n, P FROM (
    SELECT *, 0 AS grp, rec_raw AS key1 FROM valid
    UNION ALL
    SELECT *, 1 AS grp, (1.25::DOUBLE * prec_raw * rec_raw) / (0.25::DOUBLE * prec_raw + rec_raw + 1e-9::DOUBLE) AS key1
    FROM sw WHERE NOT EXISTS (SELECT 1 FROM valid)
  ) ORDER BY grp, key1 DESC, prec_raw DESC, threshold ASC LIMIT 1
)"""))

_TIER = f"CASE WHEN score >= {dbl(VIEW_HIGH)} THEN 'HIGH' WHEN score >= {dbl(VIEW_OUTREACH)} THEN 'MID' ELSE 'LOW' END"
_PCT = pct_sql("score")

_TIER_COUNTS_SQL = with_leads(f"""
SELECT tier, count(s.student_id) AS students
FROM (VALUES ('HIGH'), ('MID'), ('LOW')) t(tier) LEFT JOIN (SELECT student_id, {_TIER} AS tr FROM scored2) s ON s.tr = t.tier
GROUP BY tier""")

_ACTIONS = {k: v.replace("'", "''") for k, v in S.TIER_ACTIONS.items()}
_TIER_ACTIONS_SQL = with_leads(f"""
SELECT student_id, tier,
  CASE tier WHEN 'HIGH' THEN '{_ACTIONS['HIGH']}' WHEN 'MID' THEN '{_ACTIONS['MID']}' WHEN 'LOW' THEN '{_ACTIONS['LOW']}' END AS action
FROM (SELECT student_id, {_TIER} AS tier FROM scored2)""")

_FULL_SQL = f"""SELECT student_id, {_PCT} AS purchase_probability, {_TIER} AS predicted_tier,
  CAST(purchased_paid_course AS INTEGER) AS actual_purchased, course_interest, last_login_days_ago AS days_since_login
FROM scored2 ORDER BY score DESC, student_id"""

_SIGNALS = f"""ai_mentor_total_messages AS ai_mentor_messages,
  {r2('ai_mentor_recency_weight')} AS ai_mentor_recency_score,
  pricing_page_visits, cart_items_count AS cart_items,
  {r2('community_depth')} AS community_depth_score,
  {r2('mock_commitment')} AS mock_test_commitment,
  current_streak_days, last_login_days_ago AS days_since_login"""

_DASH = f"""dv AS (
  SELECT student_id, {_PCT} AS purchase_probability, {_TIER} AS tier, last_login_days_ago AS days_since_login FROM scored2
)"""

_BUCKET = """CASE WHEN p <= 20 THEN '0-20%' WHEN p <= 40 THEN '20-40%' WHEN p <= 60 THEN '40-60%'
  WHEN p <= 80 THEN '60-80%' ELSE '80-100%' END"""


def _hist_sql(bins: int, by_class: bool, src: str = "scored2", ctes: str = "") -> str:
    width = 1.0 / bins
    b = f"CAST(least(floor(score * {dbl(bins)}), {bins - 1}) AS INTEGER)"
    label = "CAST(purchased_paid_course AS INTEGER) AS label, " if by_class else ""
    keys = "label, " if by_class else ""
    return with_leads(f"""
SELECT {keys}bin, {r6(f'bin * {dbl(width)}')} AS bin_start, students, {r6(f'students / {dbl(width)}')} AS density
FROM (SELECT {label}{b} AS bin, count(*) AS students FROM {src} GROUP BY ALL)""", ctes)


ORACLES.update({
    "validation_report": _validation_sql(),
    "global_rank": _GLOBAL_RANK_SQL,
    "decile_table": _DECILE_SQL,
    "lift": _LIFT_SQL,
    "gains_curve": _GAINS_SQL,
    "ranking_metrics": _metrics_sql("score_tied"),
    "ranking_metrics_raw": _metrics_sql("score"),
    "roc_points": _ROC_SQL,
    "pr_points": _PR_SQL,
    "calibration_bins": _CALIB_SQL,
    "confusion": _CONFUSION_SQL,
    "threshold_summary": _SUMMARY_SQL,
    "threshold_candidates": _CAND_SQL,
    "threshold_sweep": _SWEEP_SQL,
    "learned_policy": _POLICY_SQL,
    "tier_counts": _TIER_COUNTS_SQL,
    "tier_actions": _TIER_ACTIONS_SQL,
    "full_scored": with_leads(_FULL_SQL),
    "full_preview": with_leads(_FULL_SQL + "\nLIMIT 100"),
    "full_totals": with_leads(f"""SELECT count(*) AS total_students,
  CAST(sum(purchased_paid_course) AS BIGINT) AS actual_buyers,
  count(*) FILTER (WHERE score >= {dbl(VIEW_HIGH)}) AS high_tier_count FROM scored2"""),
    "course_options": with_leads("""SELECT DISTINCT course_interest FROM scored2 WHERE purchased_paid_course = 0
ORDER BY course_interest NULLS FIRST"""),
    "student_cards": with_leads(f"""SELECT student_id, score, printf('%.1f%%', {_PCT}) AS probability_label, {_TIER} AS tier, {_SIGNALS}, {TOP_SIGNAL_SQL} AS top_signal
FROM scored2"""),
    "id_search": with_leads(f"""SELECT * FROM (
  SELECT student_id, {_PCT} AS purchase_probability, {_TIER} AS tier, course_interest,
    last_login_days_ago AS days_since_login FROM scored2)
WHERE contains(lower(student_id), '7') AND tier = 'MID'
ORDER BY days_since_login ASC NULLS FIRST, student_id"""),
    "dashboard_summary": with_leads(f"""SELECT count(*) AS total, count(*) FILTER (WHERE tier = 'HIGH') AS high_conversion,
  {r6('coalesce(sum(CAST(round_even(coalesce(purchase_probability, 0.0::DOUBLE) * 10.0::DOUBLE, 0) AS BIGINT)) / (count(*) * 10.0::DOUBLE), 0.0::DOUBLE)')} AS avg_prob FROM dv""", _DASH),
    "probability_buckets": with_leads(f"""SELECT CAST(b.pos AS INTEGER) AS pos, b.bucket, count(x.bucket) AS students
FROM (VALUES (0, '0-20%'), (1, '20-40%'), (2, '40-60%'), (3, '60-80%'), (4, '80-100%')) b(pos, bucket)
LEFT JOIN (SELECT {_BUCKET} AS bucket FROM (SELECT coalesce(purchase_probability, 0.0::DOUBLE) AS p FROM dv)) x
  ON x.bucket = b.bucket
GROUP BY b.pos, b.bucket""", _DASH),
    "recency_decay": with_leads(f"""SELECT CAST(days_since_login AS BIGINT) AS days_since_login,
  {r2('sum(CAST(round_even(coalesce(purchase_probability, 0.0::DOUBLE) * 10.0::DOUBLE, 0) AS BIGINT)) / (count(*) * 10.0::DOUBLE)')} AS avg_prob
FROM dv WHERE days_since_login IS NOT NULL GROUP BY 1 ORDER BY 1""", _DASH),
    "recency_scatter": with_leads("""SELECT student_id, days_since_login, purchase_probability,
  coalesce(purchase_probability, 0.0::DOUBLE) > 50 AS above_50 FROM dv""", _DASH),
    "score_histogram": _hist_sql(40, True),
})


# ---------------------------------------------------------------------------
# splits and preprocessing
# ---------------------------------------------------------------------------

_SPLIT_CTE = f"""sp0 AS (
  SELECT student_id, purchased_paid_course,
    row_number() OVER (PARTITION BY purchased_paid_course ORDER BY md5('{S.RANDOM_STATE}|split|' || student_id), student_id) AS pos,
    count(*) OVER (PARTITION BY purchased_paid_course) AS n
  FROM feat
),
sp1 AS (SELECT *, CAST(floor(n * {dbl(S.TEST_SIZE)} + 0.5::DOUBLE) AS BIGINT) AS qh FROM sp0),
sp2 AS (SELECT *, CAST(floor((n - qh) * {dbl(S.CALIBRATION_SIZE)} + 0.5::DOUBLE) AS BIGINT) AS qc FROM sp1),
sp AS (
  SELECT student_id, purchased_paid_course,
    CASE WHEN pos <= qh THEN 'holdout' WHEN pos <= qh + qc THEN 'calibration' ELSE 'train' END AS split,
    CASE WHEN pos > qh + qc THEN CAST((pos - qh - qc - 1) % {S.CV_FOLDS} AS INTEGER) END AS fold
  FROM sp2
),
tr AS (SELECT f.* FROM feat f JOIN sp USING (student_id) WHERE sp.split = 'train')"""


def _model_cols():
    cols = [c for c in S.MODEL_SCHEMA_COLUMNS + S.DERIVED_FEATURE_COLUMNS
            if c not in {S.ID_COLUMN, S.TARGET_COLUMN, *S.LEAKY_COLUMNS}]
    cat = [c for c in cols if c in S.STRING_COLUMNS]
    num = [c for c in cols if c not in S.STRING_COLUMNS]
    return cat, num


_CAT, _NUM = _model_cols()
_UNPIVOT_NUM = f"(UNPIVOT (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _NUM)} FROM tr) ON COLUMNS(*) INTO NAME name VALUE v)"
_UNPIVOT_CAT = f"(UNPIVOT (SELECT {', '.join(_CAT)} FROM tr) ON COLUMNS(*) INTO NAME name VALUE v)"

ORACLES.update({
    "split_assignment": with_leads("SELECT student_id, purchased_paid_course, split, fold FROM sp", _SPLIT_CTE),
    "split_counts": with_leads("""SELECT split, CAST(purchased_paid_course AS INTEGER) AS label, count(*) AS students
FROM sp GROUP BY 1, 2""", _SPLIT_CTE),
    "scale_pos_weight": with_leads(f"""SELECT {r6('sum(1 - purchased_paid_course) / sum(purchased_paid_course)')} AS scale_pos_weight
FROM sp WHERE split = 'train'""", _SPLIT_CTE),
    "holdout_lookup": with_leads("""SELECT row_number() OVER (ORDER BY md5('42|split|' || l.student_id), l.student_id) - 1 AS position,
  l.student_id, l.purchased_paid_course, l.course_interest
FROM leads l JOIN sp USING (student_id) WHERE sp.split = 'holdout'""", _SPLIT_CTE),
    "impute_stats": with_leads(f"""SELECT name AS "column", 'median' AS kind, {r6('median(v)')} AS number, CAST(NULL AS VARCHAR) AS text
FROM {_UNPIVOT_NUM} GROUP BY name
UNION ALL
SELECT name, 'mode', CAST(NULL AS DOUBLE), v FROM (
  SELECT name, v, row_number() OVER (PARTITION BY name ORDER BY count(*) DESC, v ASC) AS rn
  FROM {_UNPIVOT_CAT} GROUP BY name, v) WHERE rn = 1""", _SPLIT_CTE),
    "category_codes": with_leads(f"""SELECT name AS "column", v AS value,
  CAST(dense_rank() OVER (PARTITION BY name ORDER BY v) - 1 AS INTEGER) AS code
FROM (SELECT DISTINCT name, v FROM {_UNPIVOT_CAT})""", _SPLIT_CTE),
})


# Columns that a short profile leaves at zero; the other ones are its inputs or are derived below.
_PROFILE_ZEROS = """
    beta_mode_switched ai_mentor_image_uploaded rank_predictor_coupon_copied community_image_posted
    chat_initiated_count study_group_joined study_group_created followers_count
    following_count resume_uploaded standard_certificates job_notifications_enabled
    job_alerts_clicked_count job_applications_count resume_review_requested resume_review_completed
    mock_interview_requested mock_interview_completed question_reports_count feedback_submitted
    platform_rating referral_program_visited successful_referrals purchased_paid_course
    is_professional pro_intent_interaction
""".split()


def _profiles_sql() -> str:
    special = {
        "course_interest": "course",
        "target_gate": "course = 'GATE'",
        "target_placement": "course = 'Placement'",
        "target_govt_jobs": "course = 'GovtJobs'",
        "has_profile_picture": "profile_completion_pct > 40",
        "has_education_filled": "profile_completion_pct > 60",
        "has_career_goals": "profile_completion_pct > 70",
        "most_active_time_window": "'evening'",
        "daily_avg_minutes": "total_platform_minutes / greatest(active_days_30d, 1)",
        "engagement_intensity": "(total_platform_minutes * login_frequency_14d) / 14.0::DOUBLE",
        "intent_score": "pricing_page_visits * 10 + cart_items_count * 20",
        "effective_call_minutes": "CASE WHEN counsellor_call_picked_up = 1 THEN counsellor_call_duration_mins ELSE 0.0 END",
    }
    cols = []
    for c in S.MODEL_SCHEMA_COLUMNS:
        sql_t = {"string": "VARCHAR", "int": "INTEGER"}.get(S.column_type(c).simpleString(), "DOUBLE")
        e = special.get(c, "0" if c in _PROFILE_ZEROS else c)
        cols.append(f"CAST({e} AS {sql_t}) AS {c}")
    return with_leads("SELECT " + ",\n  ".join(cols) + """
FROM (SELECT *, ['GATE', 'Placement', 'GovtJobs', 'Other'][CAST(student_id AS BIGINT) % 4 + 1] AS course FROM leads)""")


ORACLES["sparse_profiles"] = _profiles_sql()


def policy_ctes(src: str, prefix: str) -> str:
    """Candidates, direct sweep and both picks over relation ``src`` (brute force)."""
    p = prefix
    return f"""{p}cand AS (
  SELECT DISTINCT least(greatest(t, {dbl(S.THRESHOLD_CLIP[0])}), {dbl(S.THRESHOLD_CLIP[1])}) AS threshold
  FROM (SELECT round_even(score * 10000.0::DOUBLE, 0) / 10000.0::DOUBLE AS t FROM {src}
        UNION ALL SELECT * FROM (VALUES {_ANCHORS}) a(t))
),
{p}tot AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(purchased_paid_course) AS DOUBLE) AS P FROM {src}),
{p}sw AS (
  SELECT c.threshold, tp, fp, n, P, tp / (tp + fp + 1e-9::DOUBLE) AS prec_raw, tp / (tp + (P - tp) + 1e-9::DOUBLE) AS rec_raw
  FROM (
    SELECT c.threshold,
      CAST(count(*) FILTER (WHERE s.score >= c.threshold AND s.purchased_paid_course = 1) AS DOUBLE) AS tp,
      CAST(count(*) FILTER (WHERE s.score >= c.threshold AND s.purchased_paid_course = 0) AS DOUBLE) AS fp
    FROM {p}cand c CROSS JOIN {src} s GROUP BY c.threshold
  ) c CROSS JOIN {p}tot
),
{p}o AS (SELECT threshold FROM {p}sw
  ORDER BY ({S.COURSE_PRICE_INR} * tp - {S.CALL_COST_INR} * (tp + fp)) DESC, prec_raw DESC, rec_raw DESC, threshold ASC LIMIT 1),
{p}valid AS (SELECT * FROM {p}sw WHERE tp > 0 AND prec_raw >= {dbl(S.HIGH_PRECISION_TARGET)}),
{p}h0 AS (
  SELECT threshold FROM (
    SELECT *, 0 AS grp, rec_raw AS key1 FROM {p}valid
    UNION ALL
    SELECT *, 1 AS grp, (1.25::DOUBLE * prec_raw * rec_raw) / (0.25::DOUBLE * prec_raw + rec_raw + 1e-9::DOUBLE)
    FROM {p}sw WHERE NOT EXISTS (SELECT 1 FROM {p}valid)
  ) ORDER BY grp, key1 DESC, prec_raw DESC, threshold ASC LIMIT 1
),
{p}h AS (SELECT CASE WHEN h.threshold < o.threshold THEN o.threshold ELSE h.threshold END AS threshold
  FROM {p}h0 h CROSS JOIN {p}o o)"""


_CARD_SQL = with_leads(f"""
SELECT pol.policy, pol.threshold, {_summary_select('tp', 'fp', 'n', 'P')}
FROM (SELECT 'high' AS policy, threshold FROM cal_h UNION ALL SELECT 'outreach', threshold FROM cal_o) pol
CROSS JOIN LATERAL (
  SELECT CAST(count(*) FILTER (WHERE score >= pol.threshold AND purchased_paid_course = 1) AS DOUBLE) AS tp,
         CAST(count(*) FILTER (WHERE score >= pol.threshold AND purchased_paid_course = 0) AS DOUBLE) AS fp,
         CAST(count(*) AS DOUBLE) AS n, CAST(sum(purchased_paid_course) AS DOUBLE) AS P
  FROM hold) x""", _SPLIT_CTE + """,
cal AS (SELECT s.* FROM scored2 s JOIN sp USING (student_id) WHERE sp.split = 'calibration'),
hold AS (SELECT s.* FROM scored2 s JOIN sp USING (student_id) WHERE sp.split = 'holdout'),
""" + policy_ctes("cal", "cal_"))

ORACLES["holdout_policy_card"] = _CARD_SQL


def _text(value: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if value is None else "'" + value.replace("'", "''") + "'"


def _gates_sql() -> str:
    inputs = [c for c in S.MODEL_SCHEMA_COLUMNS if c not in {S.ID_COLUMN, S.TARGET_COLUMN, *S.LEAKY_COLUMNS}]
    ranged = [(c, lo, hi) for c, (lo, hi) in S.RANGE_RULES.items() if c not in S.BINARY_COLUMNS and c not in S.NON_NEGATIVE_COLUMNS]
    refused = ["Duplicate student_id values detected.", "Blank or missing student_id values detected.",
               *(f"Column '{c}' must stay between {lo} and {hi}." for c, lo, hi in ranged)]
    rows = [("reindex", "Missing model columns after feature engineering: " + ", ".join(inputs[::6][:10])), ("reindex_good", None),
            ("fail_fast", "Upload validation failed:\n" + "\n".join(f"- {m}" for m in refused)), ("fail_fast_good", None),
            ("missing", ", ".join(inputs[::6]))]
    return with_leads("SELECT gate, message, rows_seen FROM (" + " UNION ALL ".join(
        f"SELECT '{g}' AS gate, {_text(m)} AS message" for g, m in rows) + "), (SELECT count(*) AS rows_seen FROM leads)")


def _early_return_sql() -> str:
    gone = [c for c in S.MODEL_SCHEMA_COLUMNS if c in GONE]
    rows = [("V1", None, len(gone), "Missing required columns: " + ", ".join(gone[:15])),
            ("V2", S.ID_COLUMN, 1, f"Missing id column: {S.ID_COLUMN}."),
            ("V6", S.TARGET_COLUMN, 1, f"Missing target column: {S.TARGET_COLUMN}.")]
    return with_leads("SELECT *, true AS failed, 'error' AS severity FROM (" + " UNION ALL ".join(
        f"SELECT '{r}' AS rule, {_text(c)} AS \"column\", {n}::BIGINT AS bad_rows, {_text(m)} AS message" for r, c, n, m in rows) +
        "), (SELECT count(*) AS rows_seen FROM leads)")


_REPORT = [("decile", "decile", "lift", _DECILE_SQL), ("lift", "fraction", "lift", _LIFT_SQL), ("gains", "rank", "cum_buyers", _GAINS_SQL),
           ("roc", "fpr", "tpr", _ROC_SQL), ("pr", "recall", "precision", _PR_SQL),
           ("auc_ap", "roc_auc", "average_precision", _metrics_sql("score_tied")), ("pr_brier", "pr_auc", "brier_score", _metrics_sql("score_tied")),
           ("top", "rank", "score_tied", with_leads("""SELECT score_tied, row_number() OVER (ORDER BY score_tied DESC, student_id) AS rank
FROM scored2 QUALIFY rank <= 50"""))]
ORACLES["rank_table_report"] = " UNION ALL ".join(
    f"SELECT '{name}' AS section, CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y FROM ({sql})" for name, x, y, sql in _REPORT)
ORACLES["scoring_gates"] = _gates_sql()
ORACLES["early_return_report"] = _early_return_sql()
ORACLES["empty_report"] = with_leads("""
SELECT rule, (CASE WHEN rule = 'V3' AND n = 0 THEN 1 ELSE 0 END)::BIGINT AS bad_rows, rule = 'V3' AND n = 0 AS failed, message
FROM (VALUES ('V3', 'Dataset is empty.'), ('V4', 'Duplicate student_id values detected.'),
  ('V5', 'Blank or missing student_id values detected.'), ('V7', 'Target column must contain only 0/1 values.')) v(rule, message),
  (SELECT count(*) AS n FROM leads WHERE session_depth < 0)""")
ORACLES["assembled_features"] = with_leads(f"""
SELECT CAST(row_number() OVER (ORDER BY kind, idx) - 1 AS INTEGER) AS position, kind || '__' || name AS feature, n AS students,
  CAST(t AS DOUBLE) AS thousandths
FROM (
  SELECT 'num' AS kind, name, sum(CAST(round_even(v * 1000.0::DOUBLE, 0) AS HUGEINT))
      + (any_value(n) - count(*)) * CAST(round_even(median(v) * 1000.0::DOUBLE, 0) AS HUGEINT) AS t, any_value(n) AS n
  FROM {_UNPIVOT_NUM}, (SELECT count(*) AS n FROM tr) GROUP BY name
  UNION ALL
  SELECT 'cat', name, 1000 * (sum(code * cnt) + (any_value(n) - sum(cnt)) * arg_max(code, cnt * 1000000 - code)), any_value(n)
  FROM (SELECT name, v, count(*) AS cnt, dense_rank() OVER (PARTITION BY name ORDER BY v) - 1 AS code FROM {_UNPIVOT_CAT} GROUP BY name, v),
    (SELECT count(*) AS n FROM tr) GROUP BY name) x
JOIN (VALUES {', '.join(f"('{c}', {i})" for i, c in enumerate(_CAT + _NUM))}) o(name, idx) USING (name)""", _SPLIT_CTE)
ORACLES["csv_roundtrip"] = with_leads("SELECT * FROM leads")
ORACLES["csv_validation_report"] = _validation_sql(raw_text=True)


# ---------------------------------------------------------------------------
# holdout pages, planted faults, calibration, folds
# ---------------------------------------------------------------------------

_HOLD = _SPLIT_CTE + """,
hold AS (SELECT s.* FROM scored2 s JOIN sp USING (student_id) WHERE sp.split = 'holdout')"""


_ABSENT = ("wishlist_count", "has_career_goals")


def _quarantine_sql(select: str) -> str:
    rules = _row_rules(False, _ABSENT)
    broken = ", ".join(["CASE WHEN count(*) OVER (PARTITION BY student_id) > 1 THEN 'V4:student_id' END",
                        *(f"CASE WHEN {bad} THEN '{rule}:{column}' END" for rule, column, bad, _ in rules)])
    return with_leads(select, _dirty_cte().rstrip().rstrip(",") + f""",
dirty0 AS (SELECT * EXCLUDE (m, {', '.join(_ABSENT)}) FROM dirty),
held AS (SELECT student_id, rules FROM (
  SELECT student_id, list_filter([{broken}], lambda x: x IS NOT NULL) AS rules FROM dirty0) WHERE len(rules) > 0)""")


def _predictions_sql(show: str, tiers: str) -> str:
    return with_leads(f"""
SELECT student_id, purchase_probability, predicted_tier, actual_purchased, correct FROM (
  SELECT student_id, {_PCT} AS purchase_probability, {_TIER} AS predicted_tier,
    CAST(purchased_paid_course AS INTEGER) AS actual_purchased,
    CAST(CAST(score >= {dbl(VIEW_HIGH)} AS INTEGER) = purchased_paid_course AS INTEGER) AS correct, score
  FROM hold)
WHERE predicted_tier IN ({tiers}) AND {show}""", _HOLD)


_DECILES_OF = _DECILE_SQL.split("SELECT CAST(g.decile", 1)[1]
_DIRTY = """dirty AS (
  SELECT * REPLACE (
    {replaced}
  ) FROM (SELECT *, CAST(student_id AS BIGINT) % 97 AS m FROM leads)
),
"""


def _dirty_cte() -> str:
    out = ["CASE m WHEN 1 THEN CAST(CAST(student_id AS BIGINT) - 1 AS VARCHAR) WHEN 2 THEN NULL WHEN 3 THEN '  ' ELSE student_id END AS student_id",
           "CASE m WHEN 4 THEN 2 WHEN 5 THEN 3 ELSE purchased_paid_course END AS purchased_paid_course"]
    out += [f"CASE WHEN m = 5 THEN 3 ELSE {c} END AS {c}" for c in S.BINARY_COLUMNS if c != S.TARGET_COLUMN]
    out += [f"CASE WHEN m = 6 THEN -1.0::DOUBLE ELSE {c} END AS {c}" for c in S.NON_NEGATIVE_COLUMNS]
    out += [f"CASE m WHEN 7 THEN {hi}.5::DOUBLE WHEN 8 THEN {lo}::DOUBLE - 0.5::DOUBLE ELSE {c} END AS {c}"
            for c, (lo, hi) in S.RANGE_RULES.items()]
    return _DIRTY.replace("{replaced}", ",\n    ".join(out))


def _src_policy(score: str, where: str) -> str:
    ctes = f"""src AS (SELECT student_id, purchased_paid_course, {score} AS score FROM scored2 WHERE {where}),
""" + policy_ctes("src", "x")
    return with_leads(f"""
SELECT pol.policy, pol.threshold, {_summary_select('tp', 'fp', 'n', 'P')}
FROM (SELECT 'high' AS policy, threshold FROM xh UNION ALL SELECT 'outreach', threshold FROM xo) pol
JOIN xsw USING (threshold)""", ctes)


_FOLD_CTES = _SPLIT_CTE + """,
long AS (
  SELECT 'plain' AS candidate, 0 AS position, fold, s.purchased_paid_course AS y, score AS s FROM scored2 s JOIN sp USING (student_id) WHERE split = 'train'
  UNION ALL SELECT 'snapped', 1, fold, s.purchased_paid_course, score_tied FROM scored2 s JOIN sp USING (student_id) WHERE split = 'train'
  UNION ALL SELECT 'blurred', 2, fold, s.purchased_paid_course, round_even(score * 4.0::DOUBLE, 0) / 4.0::DOUBLE
    FROM scored2 s JOIN sp USING (student_id) WHERE split = 'train'
),
lc AS (SELECT candidate, position, fold, s, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg FROM long GROUP BY ALL),
lr AS (
  SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY candidate, fold) AS P,
    sum(neg) OVER (PARTITION BY candidate, fold) AS N
  FROM lc WINDOW w AS (PARTITION BY candidate, fold ORDER BY s DESC ROWS UNBOUNDED PRECEDING)
),
lp AS (
  SELECT *, tp / (tp + fp) AS prec, coalesce(lag(tp / (tp + fp)) OVER (PARTITION BY candidate, fold ORDER BY s DESC), 1.0::DOUBLE) AS prev_prec
  FROM lr
),
fm AS (
  SELECT candidate, position, fold,
    {auc} AS roc_auc, {ap} AS average_precision, {pr} AS pr_auc, {brier} AS brier_score
  FROM lp GROUP BY candidate, position, fold
),
fs AS (
  SELECT candidate, position, avg(roc_auc) AS roc_auc, avg(average_precision) AS average_precision, avg(pr_auc) AS pr_auc,
    avg(brier_score) AS brier_score
  FROM fm GROUP BY candidate, position
)""".replace("{auc}", r6("sum(neg * (tp - pos) + neg * pos / 2) / (max(P) * max(N))")).replace(
    "{ap}", r6("sum(pos * prec) / max(P)")).replace("{pr}", r6("sum(pos * (prec + prev_prec) / 2) / max(P)")).replace(
    "{brier}", r6("sum(pos * (s - 1) * (s - 1) + neg * s * s) / (max(P) + max(N))"))

_ISO_CTES = _SPLIT_CTE + """,
pool AS (
  SELECT s.score_tied AS x, CAST(count(*) AS DOUBLE) AS w, CAST(sum(s.purchased_paid_course) AS DOUBLE) AS y
  FROM scored2 s JOIN sp USING (student_id) WHERE sp.split = 'calibration' GROUP BY 1
),
cum AS (SELECT x, row_number() OVER (ORDER BY x) AS i, sum(w) OVER (ORDER BY x) AS cw, sum(y) OVER (ORDER BY x) AS cy, w, y FROM pool),
runs AS (SELECT a.i AS i, b.i AS k, (b.cy - a.cy + a.y) / (b.cw - a.cw + a.w) AS mean FROM cum a JOIN cum b ON b.i >= a.i),
fit AS (
  SELECT j.x, max(low) AS f FROM cum j JOIN (
    SELECT j.i AS j, r.i, min(r.mean) AS low FROM cum j JOIN runs r ON r.i <= j.i AND r.k >= j.i GROUP BY j.i, r.i
  ) m ON m.j = j.i GROUP BY j.x
),
ends AS (SELECT min(x) AS lo, max(x) AS hi FROM fit),
put AS (
  SELECT s.student_id, s.score_tied, least(greatest(s.score_tied, lo), hi) AS x FROM scored2 s CROSS JOIN ends
),
pts AS (
  SELECT DISTINCT put.x, (SELECT max(x) FROM fit WHERE fit.x <= put.x) AS x1, (SELECT min(x) FROM fit WHERE fit.x >= put.x) AS x2 FROM put
)"""

ORACLES.update({
    "prediction_table": _predictions_sql("correct = 0", "'HIGH', 'MID', 'LOW'"),
    "predictions_all": _predictions_sql("true", "'HIGH', 'MID'"),
    "predictions_correct": _predictions_sql("correct = 1", "'HIGH', 'MID', 'LOW'"),
    "predictions_buyers": _predictions_sql("actual_purchased = 1", "'MID'"),
    "predictions_non_buyers": _predictions_sql("actual_purchased = 0", "'HIGH', 'LOW'"),
    "holdout_histogram": _hist_sql(30, False, "hold", _HOLD),
    "holdout_deciles": with_leads("\nSELECT CAST(g.decile" + _DECILES_OF.replace("FROM scored2", "FROM hold"),
                                  _HOLD + ",\n" + _RANKED.replace("FROM scored2", "FROM hold")),
    "holdout_metrics": with_leads(f"""
SELECT {r6('sum((fpr - prev_fpr) * (tpr + prev_tpr) / 2)')} AS roc_auc,
  {r6('sum((rec - prev_rec) * prec)')} AS average_precision,
  {r6('sum((rec - prev_rec) * (prec + prev_prec) / 2)')} AS pr_auc,
  (SELECT {r6('avg(pow(score - CAST(purchased_paid_course AS DOUBLE), 2))')} FROM hold) AS brier_score
FROM lagged""", _HOLD + ",\n" + _curve_ctes("score").replace("FROM scored2", "FROM hold")),
    "search_by_course": with_leads(f"""SELECT student_id, {_PCT} AS purchase_probability, {_TIER} AS tier, course_interest,
  last_login_days_ago AS days_since_login FROM scored2 WHERE contains(student_id, '7') ORDER BY course_interest DESC, student_id"""),
    "search_by_tier": with_leads(f"""SELECT student_id, {_PCT} AS purchase_probability, {_TIER} AS tier, course_interest,
  last_login_days_ago AS days_since_login FROM scored2 WHERE contains(student_id, '7') ORDER BY tier, student_id"""),
    "policy_without_valid_cut": _src_policy(
        "round_even(((score - 0.45::DOUBLE * CAST(purchased_paid_course AS DOUBLE)) / 0.55::DOUBLE) * 5.0::DOUBLE, 0) / 10.0::DOUBLE", "true"),
    "policy_high_below_outreach": _src_policy(
        "CASE WHEN purchased_paid_course = 1 AND CAST(student_id AS BIGINT) % 500 <> 0 THEN 0.8::DOUBLE + score / 10.0::DOUBLE "
        "WHEN purchased_paid_course = 1 OR CAST(student_id AS BIGINT) % 16 = 0 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END", "true"),
    "one_class_metrics": with_leads(f"""
SELECT CAST(NULL AS DOUBLE) AS roc_auc, 1.0::DOUBLE AS average_precision, 1.0::DOUBLE AS pr_auc,
  (SELECT {r6('avg(pow(score_tied - 1, 2))')} FROM scored2 WHERE purchased_paid_course = 1) AS brier_score,
  1 + count(*) FILTER (WHERE k = 1 OR k = kmax OR next_pos <> pos) AS roc_points, 1.0::DOUBLE AS max_tpr,
  CAST(1 AS BIGINT) AS known_fpr, CAST(NULL AS DOUBLE) AS empty_coverage
FROM (SELECT *, row_number() OVER (ORDER BY s DESC) AS k, lead(pos) OVER (ORDER BY s DESC) AS next_pos, count(*) OVER () AS kmax
      FROM (SELECT score_tied AS s, count(*) AS pos FROM scored2 WHERE purchased_paid_course = 1 GROUP BY 1))"""),
    "dirty_validation_report": _validation_sql(src="dirty", absent=("wishlist_count", "has_career_goals"), extra_ctes=_dirty_cte()),
    "encoder_codes": """
WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_custkey % 2 AS odd,
                  CASE WHEN o_custkey % 13 <> 0 THEN 'k' || o_orderkey END AS tag FROM orders),
cats AS (SELECT tag, count(*) AS n, row_number() OVER (ORDER BY tag) - 1 AS code FROM o WHERE odd = 1 AND tag IS NOT NULL GROUP BY tag),
mode AS (SELECT tag FROM cats ORDER BY n DESC, tag LIMIT 1)
SELECT o.id, CAST(coalesce(c.code, -1) AS BIGINT) AS code
FROM o LEFT JOIN cats c ON c.tag = coalesce(o.tag, (SELECT tag FROM mode))""",
    "fold_metrics": with_leads("SELECT candidate, fold, roc_auc, average_precision, pr_auc, brier_score FROM fm", _FOLD_CTES),
    "fold_summary": with_leads(f"""SELECT candidate, {r6('roc_auc')} AS roc_auc, {r6('average_precision')} AS average_precision,
  {r6('pr_auc')} AS pr_auc, {r6('brier_score')} AS brier_score FROM fs""", _FOLD_CTES),
    "candidate_choice": with_leads(f"""SELECT candidate, position, {r6('average_precision')} AS average_precision
FROM fs ORDER BY fs.average_precision DESC, roc_auc DESC, brier_score, position LIMIT 1""", _FOLD_CTES),
    "isotonic_calibration": with_leads(f"""
SELECT put.student_id, put.score_tied,
  {r6('least(1.0::DOUBLE, greatest(0.0::DOUBLE, CASE WHEN pts.x1 = pts.x2 THEN a.f ELSE a.f + (b.f - a.f) * (put.x - pts.x1) / (pts.x2 - pts.x1) END))')} AS calibrated
FROM put JOIN pts ON pts.x = put.x JOIN fit a ON a.x = pts.x1 JOIN fit b ON b.x = pts.x2""", _ISO_CTES),
    "model_invariants": with_leads("""
SELECT "check", CAST(v AS BIGINT) AS expected, CAST(v AS BIGINT) AS actual FROM (
  SELECT 'rows_scored' AS "check", count(*) AS v FROM leads
  UNION ALL SELECT 'scores_outside_unit_interval', 0
  UNION ALL SELECT 'calibration_falls', 0
  UNION ALL SELECT 'drivers_per_student_not_ten', 0
  UNION ALL SELECT 'base_plus_contributions_not_margin', 0
  UNION ALL SELECT 'validation_scores', 3 * count(*) FROM sp WHERE split = 'train'
  UNION ALL SELECT 'holdout_rows_in_saved_order', count(*) FROM sp WHERE split = 'holdout'
  UNION ALL SELECT 'calibration_rows', count(*) FROM sp WHERE split = 'calibration'
  UNION ALL SELECT 'all_trees_of_the_chosen_candidate', 1)""", _SPLIT_CTE),
    "validation_messages": "SELECT severity, string_agg('- ' || message, chr(10) ORDER BY seq) AS text FROM ("
    + _validation_sql(src="dirty", absent=_ABSENT, extra_ctes=_dirty_cte()) + ") WHERE failed GROUP BY severity",
    "quarantine_leads": _quarantine_sql("SELECT student_id, array_to_string(rules, ',') AS rules FROM held"),
    "quarantine_counts": _quarantine_sql("""
SELECT split_part(r, ':', 1) AS rule, split_part(r, ':', 2) AS "column", count(*) AS bad_rows,
  count(DISTINCT coalesce(student_id, chr(0))) AS bad_keys
FROM (SELECT student_id, unnest(rules) AS r FROM held) GROUP BY r"""),
    "clean_leads": _quarantine_sql("SELECT * FROM dirty0 WHERE coalesce(student_id, chr(0)) NOT IN (SELECT coalesce(student_id, chr(0)) FROM held)"),
    "artifact_roundtrip": with_leads(f"""
SELECT (SELECT count(*) FROM leads) AS scored_twice, 0::BIGINT AS unequal,
  (SELECT count(*) FROM sp WHERE split = 'holdout') AS holdout_rows,
  (SELECT count(*) - 1 FROM sp WHERE split = 'holdout') AS last_position,
  (SELECT count(*) FROM (SELECT DISTINCT name, v FROM {_UNPIVOT_CAT})) AS codes""", _SPLIT_CTE),
    "upload_ledger": with_leads(f"""
SELECT upload, outcome, CAST(CASE WHEN outcome = 'replayed' THEN 0 ELSE n END AS BIGINT) AS rows, messages,
  CASE WHEN outcome = 'scored' THEN h ELSE 0 END AS high, CASE WHEN outcome = 'scored' THEN m ELSE 0 END AS mid,
  CASE WHEN outcome = 'scored' THEN l ELSE 0 END AS low
FROM (VALUES ('a_good', 0, 'scored', ''), ('b_order', 1, 'scored', ''),
  ('c_flag', 2, 'rejected', 'Column ''coupon_code_applied'' must contain only 0/1 values.'),
  ('d_missing', 3, 'rejected', 'Missing required columns: session_depth'), ('e_again', 0, 'replayed', '')) v(upload, k, outcome, messages)
JOIN (SELECT k, count(*) AS n, count(*) FILTER (WHERE t = 'HIGH') AS h, count(*) FILTER (WHERE t = 'MID') AS m,
        count(*) FILTER (WHERE t = 'LOW') AS l
      FROM (SELECT CAST(student_id AS BIGINT) % 4 AS k, {tier_sql('s', 0.4, 0.2)} AS t FROM (
        SELECT student_id, least(1.0::DOUBLE, 0.55::DOUBLE * ((('0x' || substr(md5('42|' || student_id), 1, 8))::BIGINT)::DOUBLE
          / 4294967296::DOUBLE) + 0.45::DOUBLE * 0.0::DOUBLE) AS s FROM leads)) GROUP BY k) USING (k)"""),
    "csv_one_file": with_leads("""
SELECT student_id,
  CASE m WHEN 0 THEN 'a "quoted" word' WHEN 1 THEN 'one, two' WHEN 2 THEN repeat('line' || chr(10) || 'break, ', 40) || '"end"'
    WHEN 3 THEN NULL WHEN 4 THEN 'five" pipe' WHEN 6 THEN repeat(chr(10), 9) ELSE 't' || student_id END AS ai_mentor_topic,
  CASE m WHEN 5 THEN NULL WHEN 7 THEN '1' ELSE student_id END AS session_depth,
  CASE m WHEN 5 THEN NULL WHEN 7 THEN '2' ELSE '0' END AS coupon_code_applied,
  m IN (5, 7) AS bad_line
FROM (SELECT student_id, CAST(student_id AS BIGINT) % 12 AS m FROM leads)"""),
    "dirty_csv": with_leads("""
SELECT student_id,
  CASE m WHEN 0 THEN 'a "quoted" word' WHEN 1 THEN 'one, two' WHEN 2 THEN 'line' || chr(10) || 'break' WHEN 3 THEN NULL ELSE 't' || student_id END AS ai_mentor_topic,
  CASE m WHEN 1 THEN 1000.0 WHEN 2 THEN 12.0 WHEN 6 THEN -5.5 WHEN 0 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN NULL WHEN 7 THEN NULL
    ELSE CAST(student_id AS DOUBLE) END::DOUBLE AS session_depth,
  CASE m WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN NULL ELSE (m + 1) % 2 END::DOUBLE AS coupon_code_applied,
  false AS bad_line
FROM (SELECT student_id, CAST(student_id AS BIGINT) % 12 AS m FROM leads)"""),
    "dirty_csv_report": with_leads("""
SELECT rule, "column", CAST(bad_rows AS BIGINT) AS bad_rows, bad_rows > 0 AS failed FROM (
  SELECT 'V1' AS rule, CAST(NULL AS VARCHAR) AS "column", 82 AS bad_rows
  UNION ALL SELECT 'V2', 'student_id', 0
  UNION ALL SELECT 'V6', 'purchased_paid_course', 0
  UNION ALL SELECT 'V3', NULL, 0
  UNION ALL SELECT 'V4', 'student_id', 0
  UNION ALL SELECT 'V5', 'student_id', 0
  UNION ALL SELECT 'S1', '_bad_line', 0
  UNION ALL SELECT 'V8', 'coupon_code_applied', count(*) FILTER (WHERE m = 3) FROM c
  UNION ALL SELECT 'V9', 'session_depth', count(*) FILTER (WHERE m = 6) FROM c
  UNION ALL SELECT 'V16', 'session_depth', count(*) FILTER (WHERE m IN (0, 3, 4, 7)) FROM c
  UNION ALL SELECT 'V16', 'coupon_code_applied', count(*) FILTER (WHERE m = 4) FROM c)""",
                                   "c AS (SELECT CAST(student_id AS BIGINT) % 12 AS m FROM leads)"),
})

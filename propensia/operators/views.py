"""Lead views and dashboard aggregations.

Every view is a query over a scored student frame (id, score, label and the
engineered columns).  Sorting is always ``score DESC, id ASC`` so ties are
deterministic.  Global order is only computed when the view needs a rank
(capacity tiers); otherwise ``orderBy`` / ``limit`` are left to Spark's
range-partitioned sort and TakeOrdered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.numeric import round_to
from ..functions.labels import percent_label, probability_pct, tier_by_capacity, tier_by_threshold, top_signal
from .features import signal_columns
from .rank import global_rank, score_order

ID = S.ID_COLUMN
Y = S.TARGET_COLUMN

SORTABLE = {"student_id", "purchase_probability", "tier", "course_interest", "days_since_login"}


def correctness(df: DataFrame, score_col: str, high: float) -> DataFrame:
    """L4: per-row ``(score >= high) == actual`` as 0/1."""
    return df.withColumn(
        "correct", ((F.col(score_col) >= F.lit(high)).cast("int") == F.col(Y).cast("int")).cast("int")
    )


def prediction_table(
    df: DataFrame,
    score_col: str,
    high: float,
    outreach: float,
    show: str = "All",
    tiers: Sequence[str] = ("HIGH", "MID", "LOW"),
) -> DataFrame:
    """L3 + L4 + L5: holdout prediction table with the show/tier filters."""
    base = correctness(df, score_col, high)
    v = base.select(
        F.col(ID).cast("string").alias("student_id"),
        probability_pct(F.col(score_col)).alias("purchase_probability"),
        tier_by_threshold(F.col(score_col), high, outreach).alias("predicted_tier"),
        F.col(Y).cast("int").alias("actual_purchased"),
        F.col("correct"),
        F.col(score_col).alias("_score"),
    )
    v = v.where(F.col("predicted_tier").isin(list(tiers)))
    filters = {
        "All": None,
        "Correct only": F.col("correct") == 1,
        "Wrong only": F.col("correct") == 0,
        "Buyers only": F.col("actual_purchased") == 1,
        "Non-buyers only": F.col("actual_purchased") == 0,
    }
    if show not in filters:
        raise ValueError(f"unknown filter {show!r}")
    if filters[show] is not None:
        v = v.where(filters[show])
    return v.orderBy(F.col("_score").desc(), F.col("student_id")).drop("_score")


def full_scored(df: DataFrame, score_col: str, high: float, outreach: float) -> DataFrame:
    """Every student with tier, actual, course and recency, best first."""
    return df.select(
        F.col(ID).cast("string").alias("student_id"),
        probability_pct(F.col(score_col)).alias("purchase_probability"),
        tier_by_threshold(F.col(score_col), high, outreach).alias("predicted_tier"),
        F.col(Y).cast("int").alias("actual_purchased"),
        F.col("course_interest"),
        F.col("last_login_days_ago").alias("days_since_login"),
        F.col(score_col).alias("_score"),
    ).orderBy(F.col("_score").desc(), F.col("student_id")).drop("_score")


def full_totals(df: DataFrame, score_col: str, high: float) -> DataFrame:
    """Students, buyers, HIGH-tier count."""
    return df.agg(
        F.count(F.lit(1)).alias("total_students"),
        F.sum(F.col(Y).cast("long")).alias("actual_buyers"),
        F.count_if(F.col(score_col) >= F.lit(high)).alias("high_tier_count"),
    )


def sales_sheet(
    df: DataFrame,
    score_col: str,
    high: float,
    outreach: float,
    capacity: int = 100,
    tiers: Sequence[str] = ("HIGH", "MID"),
    course: str | None = None,
    max_days: float = 30,
    num_partitions: int | None = None,
) -> DataFrame:
    """Daily sales sheet for unconverted students.

    The capacity rank counts *all* unconverted students before the tier /
    course / recency filters (as the page does).  Unless the LOW tier is asked
    for, only the first 3N of the order can appear, so just those (N is the
    feature's own parameter) are ordered and numbered; otherwise the rank comes
    from the distributed skeleton.
    """
    unconverted = df.where(F.col(Y) == 0).select(
        F.col(ID).cast("string").alias("student_id"),
        F.col(score_col).alias("_score"),
        top_signal().alias("top_signal"),
        F.col("course_interest"),
        F.col("last_login_days_ago").alias("days_since_login"),
    )
    order = score_order("_score", "student_id")
    if capacity and capacity > 0 and "LOW" not in tiers:
        first = unconverted.orderBy(*order).limit(3 * capacity)
        ranked = first.withColumn("_rank", F.row_number().over(Window.orderBy(*order)))     # 3N rows
        tier = tier_by_capacity(F.col("_rank"), capacity)
    elif capacity and capacity > 0:
        ranked = global_rank(unconverted, order, rank_col="_rank", num_partitions=num_partitions)
        tier = tier_by_capacity(F.col("_rank"), capacity)
    else:
        ranked = unconverted
        tier = tier_by_threshold(F.col("_score"), high, outreach)
    sheet = ranked.select(
        "student_id",
        probability_pct(F.col("_score")).alias("purchase_probability"),
        tier.alias("tier"),
        "top_signal",
        "course_interest",
        "days_since_login",
        "_score",
    )
    sheet = sheet.where(F.col("tier").isin(list(tiers)))
    if course is not None and course != "All":
        sheet = sheet.where(F.col("course_interest") == F.lit(course))
    sheet = sheet.where(F.col("days_since_login") <= F.lit(float(max_days)))
    return sheet.orderBy(F.col("_score").desc(), F.col("student_id")).drop("_score")


def course_options(df: DataFrame) -> DataFrame:
    """Distinct course values among unconverted students, sorted."""
    return (
        df.where(F.col(Y) == 0)
        .select(F.col("course_interest"))
        .distinct()
        .orderBy(F.col("course_interest").asc_nulls_first())
    )


def student_cards(df: DataFrame, score_col: str, high: float, outreach: float) -> DataFrame:
    """The explorer card for every student (a view, not a driver lookup)."""
    return df.select(
        F.col(ID).cast("string").alias("student_id"),
        F.col(score_col).alias("score"),
        percent_label(F.col(score_col)).alias("probability_label"),
        tier_by_threshold(F.col(score_col), high, outreach).alias("tier"),
        *[e.alias(k) for k, e in signal_columns().items()],
        top_signal().alias("top_signal"),
    )


def id_search(df: DataFrame, score_col: str, high: float, outreach: float, query: str, status: str = "All",
              sort_key: str = "purchase_probability", ascending: bool = False) -> DataFrame:
    """L12 + R8: case-insensitive id substring search, tier filter, whitelisted sort."""
    if sort_key not in SORTABLE:
        raise ValueError(f"cannot sort by {sort_key!r}")
    v = df.select(
        F.col(ID).cast("string").alias("student_id"),
        probability_pct(F.col(score_col)).alias("purchase_probability"),
        tier_by_threshold(F.col(score_col), high, outreach).alias("tier"),
        F.col("course_interest"),
        F.col("last_login_days_ago").alias("days_since_login"),
    )
    v = v.where(F.lower(F.col("student_id")).contains(query.lower()))
    if status != "All":
        v = v.where(F.col("tier") == F.lit(status))
    key = F.col(sort_key).asc() if ascending else F.col(sort_key).desc()
    return v.orderBy(key, F.col("student_id"))


def tier_counts(df: DataFrame, score_col: str, high: float, outreach: float) -> DataFrame:
    """HIGH / MID / LOW counts by threshold (all three always present)."""
    s = F.col(score_col)
    agg = df.agg(
        F.count_if(s >= F.lit(high)).alias("HIGH"),
        F.count_if((s >= F.lit(outreach)) & (s < F.lit(high))).alias("MID"),
        F.count_if(s < F.lit(outreach)).alias("LOW"),
    )
    return agg.select(
        F.explode(
            F.array(*[F.struct(F.lit(t).alias("tier"), F.col(t).alias("students")) for t in S.TIERS])
        ).alias("r")
    ).select("r.*")


# ---------------------------------------------------------------------------
# Dashboard aggregations
# ---------------------------------------------------------------------------

def dashboard_summary(scored: DataFrame) -> DataFrame:
    """B1: total, HIGH count, mean percentage (NULL counts as 0; 0 when empty).

    ``scored`` is a view with ``purchase_probability`` and a tier column ``tier``.
    """
    return scored.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("tier") == "HIGH").alias("high_conversion"),
        _mean_pct().alias("avg_prob"),
    ).select("total", "high_conversion", round_to(F.coalesce("avg_prob", F.lit(0.0)), 6).alias("avg_prob"))


def _mean_pct():
    """Mean of one-decimal percentages, summed exactly as integer tenths.

    The percentages are multiples of 0.1, so the sum is exact whatever the
    summation order (no task-order float noise before the final rounding).
    """
    tenths = F.rint(F.coalesce(F.col("purchase_probability"), F.lit(0.0)) * F.lit(10.0)).cast("long")
    return F.sum(tenths) / (F.count(F.lit(1)) * F.lit(10.0))


# FIXED VALUES: dashboard probability buckets (percent, right-closed upper edges).
PROBABILITY_BUCKETS = [("0-20%", 20), ("20-40%", 40), ("40-60%", 60), ("60-80%", 80), ("80-100%", None)]


def probability_buckets(scored: DataFrame) -> DataFrame:
    """B2: five right-closed buckets over ``purchase_probability``, zeros kept."""
    p = F.coalesce(F.col("purchase_probability"), F.lit(0.0))
    bucket = None
    for name, upper in PROBABILITY_BUCKETS:
        if upper is None:
            bucket = bucket.otherwise(F.lit(name))
        else:
            bucket = F.when(p <= upper, name) if bucket is None else bucket.when(p <= upper, name)
    counts = scored.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("students"))
    spark = scored.sparkSession
    labels = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(PROBABILITY_BUCKETS)], "pos int, bucket string")
    return labels.join(F.broadcast(counts), "bucket", "left").select(
        "pos", "bucket", F.coalesce(F.col("students"), F.lit(0)).cast("long").alias("students")
    )


def recency_decay(scored: DataFrame) -> DataFrame:
    """Mean percentage by days since login (2 dp), ascending; NULL days dropped."""
    return (
        scored.where(F.col("days_since_login").isNotNull())
        .groupBy(F.col("days_since_login").cast("long").alias("days_since_login"))
        .agg(round_to(_mean_pct(), 2).alias("avg_prob"))
        .orderBy("days_since_login")
    )


def recency_scatter(scored: DataFrame) -> DataFrame:
    """Recency vs percentage points with the > 50 flag."""
    return scored.select(
        "student_id",
        "days_since_login",
        "purchase_probability",
        (F.coalesce(F.col("purchase_probability"), F.lit(0.0)) > 50).alias("above_50"),
    )


def score_histogram(df: DataFrame, score_col: str, bins: int, by_class: bool = True) -> DataFrame:
    """Equal-width bins over [0, 1] (last bin closed); counts and density (count per unit of score)."""
    width = 1.0 / bins
    b = F.least(F.floor(F.col(score_col) * F.lit(float(bins))), F.lit(bins - 1)).cast("int")
    keys = [b.alias("bin")]
    if by_class:
        keys.append(F.col(Y).cast("int").alias("label"))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("students")).select(
        *(["label"] if by_class else []),
        "bin",
        round_to(F.col("bin") * F.lit(width), 6).alias("bin_start"),
        "students",
        round_to(F.col("students") / F.lit(width), 6).alias("density"),
    )

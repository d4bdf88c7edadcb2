"""Row-level business expressions: tiers, actions, top signal, labels.

All are native ``when`` chains, evaluated inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S


def tier_by_threshold(score: Column, high: Column | float, outreach: Column | float) -> Column:
    """>= high -> HIGH, >= outreach -> MID, else LOW."""
    high = high if isinstance(high, Column) else F.lit(float(high))
    outreach = outreach if isinstance(outreach, Column) else F.lit(float(outreach))
    return F.when(score >= high, "HIGH").when(score >= outreach, "MID").otherwise("LOW")


def tier_by_capacity(rank: Column, capacity: int) -> Column:
    """Rank <= N -> HIGH, rank <= 3N -> MID, else LOW (N > 0)."""
    n = int(capacity)
    return F.when(rank <= n, "HIGH").when(rank <= 3 * n, "MID").otherwise("LOW")


def tier_action(tier: Column) -> Column:
    """Recommended action text for a tier."""
    expr = None
    for name, text in S.TIER_ACTIONS.items():
        expr = F.when(tier == name, text) if expr is None else expr.when(tier == name, text)
    return expr


def top_signal() -> Column:
    """L1: first matching behavioural rule; NULL inputs fall through."""
    c = F.col
    return (
        F.when(c("ai_mentor_recency_weight") > 5, S.SIGNAL_RECENT_MENTOR)
        .when((c("pricing_page_visits") > 3) & (c("cart_items_count") > 0), S.SIGNAL_PRICING_CART)
        .when(c("engagement_intensity") > 500, S.SIGNAL_INTENSITY)
        .when(c("current_streak_days") >= 5, S.SIGNAL_STREAK)
        .otherwise(S.SIGNAL_DEFAULT)
    )


def probability_pct(score: Column) -> Column:
    """L3: score as a percentage with one decimal, numpy half-even rounding."""
    return F.rint(score * F.lit(100.0) * F.lit(10.0)) / F.lit(10.0)


def percent_label(score: Column) -> Column:
    """L2: display text such as ``42.1%`` (numeric columns stay the truth).

    The percentage is rounded first (half-even, as the numeric column) and
    then printed, so the JVM formatter and C-style printf agree on every value.
    """
    return F.format_string("%.1f%%", probability_pct(score))

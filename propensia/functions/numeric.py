"""Column expressions for missing values and strict numeric parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S

# Spark's string -> double cast accepts what pandas.to_numeric accepts (sign,
# digits, fraction, exponent, surrounding blanks, inf / infinity / nan) plus
# Java's type suffixes ("12d", "12f") and hex floats ("0x1p3"): those are rejected.
JAVA_ONLY = "x|d$|[^n]f$"
# FIXED VALUES: spellings that make a column boolean
TRUE_TEXTS = ["True", "TRUE", "true"]
FALSE_TEXTS = ["False", "FALSE", "false"]


def is_na_token(c: Column) -> Column:
    """True for NULL or one of pandas' default NA spellings."""
    return c.isNull() | c.isin(S.NA_TOKENS)


def nan_to_null(c: Column) -> Column:
    """NaN becomes NULL, so only NULL carries "missing" afterwards."""
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def parse_number(c: Column) -> Column:
    """String -> DOUBLE with pandas ``to_numeric(errors="coerce")`` semantics.

    The trimmed text is bound once (a one-element array), so the expression
    stays small enough to be compiled for a whole row of such columns.
    """
    def number(t: Column) -> Column:
        java_only = t.rlike(JAVA_ONLY)
        # Every NA token either fails the cast or parses to NaN, so NULL / NaN /
        # NA tokens all come out as NULL without a token lookup here; the lookup
        # is only needed to tell "missing" from "not a number" (rule V16).
        v = F.when(~java_only, t.try_cast("double"))
        return F.when(~F.isnan(v), v)

    return F.transform(F.array(F.lower(F.trim(c.cast("string")))), number)[0]


def parse_binary(c: Column) -> Column:
    """A 0/1 column: numbers as they are, and the spellings of booleans that a reader infers."""
    return F.when(c.cast("string").isin(TRUE_TEXTS), 1.0).when(c.cast("string").isin(FALSE_TEXTS), 0.0).otherwise(parse_number(c))


def to_double(c: Column, dtype: T.DataType) -> Column:
    """Numeric view of a column of any declared type, NaN normalised to NULL."""
    if isinstance(dtype, T.StringType):
        return parse_number(c)
    if isinstance(dtype, T.BooleanType):
        return c.cast("double")
    return nan_to_null(c.cast("double"))


def round_to(c: Column, places: int = 6) -> Column:
    """numpy-style ``round(c, places)``: scale, round half to even, unscale.

    Unlike ``F.round`` (half-up on the shortest decimal string), this is the
    same IEEE computation in every engine, so equal inputs give equal outputs.
    """
    c = F.col(c) if isinstance(c, str) else c
    f = float(10**places)
    return F.rint(c * F.lit(f)) / F.lit(f)


def exact_sum(c: Column) -> Column:
    """Sum of whole-number doubles as decimal(38,0), as a sum of decimals would have it.

    Up to 2^53 they are summed as two halves of longs, which cannot overflow
    below 2^36 rows; only larger ones become decimals row by row.
    """
    small = F.abs(c) <= F.lit(float(1 << 53))
    n = F.when(small, c).cast("long")
    high, low = F.sum(F.shiftright(n, 26)), F.sum(n.bitwiseAND(F.lit((1 << 26) - 1)))
    halves = high.cast("decimal(38,0)") * F.lit(1 << 26).cast("decimal(9,0)") + low.cast("decimal(20,0)")
    rest = F.sum(F.when(~small, c).cast("decimal(38,0)"))
    total = F.coalesce(halves, F.lit(0)) + F.coalesce(rest, F.lit(0))
    return F.when(high.isNotNull() | rest.isNotNull(), total).cast("decimal(38,0)")

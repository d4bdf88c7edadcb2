"""Which rows broke which rule: the row side of the validation report.

One scan of the wide rows turns every rule into one bit; what goes on is the id
and a few longs per row.  Duplicate ids are a keyed count over that narrow
table and come back as a mark by a null-safe join on the id, so wide rows are
never shuffled.  The join's one side is the duplicated ids only: Spark
broadcasts it where it is small and splits hot ids where it is not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..session import ensure_checkpoint_dir
from .validate import _parsed, _rule_specs

_BITS = 62        # rules per long


def rule_names(df: DataFrame, require_target: bool = True) -> list[str]:
    """``rule:column`` of every row rule that applies to ``df``, in report order; V4 first."""
    return [f"V4:{S.ID_COLUMN}", *(f"{rule}:{column}" for rule, column, *_ in _rule_specs(_parsed(df), require_target))]


def rule_masks(df: DataFrame, require_target: bool = True) -> DataFrame:
    """(student_id, _mask0, _mask1, ...): bit i of the masks is set where a row breaks rule i (V4 left out)."""
    parsed = _parsed(df)
    bits = [F.when(bad, F.lit(1 << (i % _BITS)).cast("long")).otherwise(F.lit(0).cast("long"))
            for i, (_, _, _, bad, _) in enumerate(_rule_specs(parsed, require_target))]
    masks = []
    for k in range(0, len(bits), _BITS):
        mask = bits[k]
        for b in bits[k + 1: k + _BITS]:
            mask = mask.bitwiseOR(b)
        masks.append(mask.alias(f"_mask{k // _BITS}"))
    return parsed.select(F.col(S.ID_COLUMN).cast("string").alias(S.ID_COLUMN), *masks)


def quarantine(df: DataFrame, require_target: bool = True) -> DataFrame:
    """(student_id, rules): one row per row of ``df`` that breaks a rule, with all it breaks, in report order.

    Two rows without an id count as duplicates of each other, as in the report.
    """
    ensure_checkpoint_dir(df.sparkSession)
    names = rule_names(df, require_target)
    narrow = rule_masks(df, require_target).checkpoint()
    masks = [F.col(c) for c in narrow.columns if c.startswith("_mask")]
    twice = narrow.groupBy(F.col(S.ID_COLUMN).alias("_id")).count().where("count > 1").select("_id", F.lit(True).alias("_twice"))
    marked = narrow.join(twice, F.col(S.ID_COLUMN).eqNullSafe(F.col("_id")), "left")
    bad = F.col("_twice").isNotNull()
    for m in masks:
        bad = bad | (m != 0)
    broken = [F.when(F.col("_twice"), F.lit(names[0]))]
    for i, name in enumerate(names[1:]):
        broken.append(F.when(masks[i // _BITS].bitwiseAND(F.lit(1 << (i % _BITS)).cast("long")) != 0, F.lit(name)))
    return marked.where(bad).select(S.ID_COLUMN, F.array_compact(F.array(*broken)).alias("rules"))


def quarantine_counts(rows: DataFrame) -> DataFrame:
    """(rule, column, bad_rows, bad_keys) of quarantined rows; a missing id is one key."""
    each = rows.select(S.ID_COLUMN, F.explode("rules").alias("r"))
    counts = each.groupBy("r").agg(F.count(F.lit(1)).alias("bad_rows"),
                                   F.count_distinct(F.struct(S.ID_COLUMN)).alias("bad_keys"))
    return counts.select(F.substring_index("r", ":", 1).alias("rule"), F.substring_index("r", ":", -1).alias("column"),
                         "bad_rows", "bad_keys")


def split_clean(df: DataFrame, require_target: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows of ids without any broken rule, quarantined (student_id, rules)).

    An id is held back as a whole: of duplicated ids none is the right one.
    """
    held = quarantine(df, require_target)
    ids = held.select(F.col(S.ID_COLUMN).alias("_id")).distinct()
    clean = df.join(ids, F.col(S.ID_COLUMN).cast("string").eqNullSafe(F.col("_id")), "left_anti")
    return clean, held

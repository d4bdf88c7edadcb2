"""Deterministic stratified splits.

A row's position in its class is its rank under ``md5(seed|split|id)``.  The
first ``round(0.15 * n_class)`` rows of each class are the holdout, the next
``round(0.18 * rest)`` the calibration split, the remainder trains and is dealt
into 3 folds round-robin.  Deterministic, disjoint, exhaustive, stratified
within one row per class -- and the same recipe is plain SQL, so it is checked
exactly.

The two border keys of each class are selected by refined histograms
(``select``), without a sort; the split of a row is then an expression of its
own id and label, so no id is exchanged and no join is needed.  Only the folds
depend on exact ranks: where they are asked for, the training rows' ids (and no
others) are ranked by a distributed sort.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..session import ensure_checkpoint_dir
from .rank import rank_within_groups
from .select import at_most, group_sizes, kth_keys


def split_hash(id_col: str = S.ID_COLUMN, seed: int = S.RANDOM_STATE):
    return F.md5(F.concat(F.lit(f"{seed}|split|"), F.col(id_col).cast("string")))


def _rounded(n: int, fraction: float) -> int:
    """round-half-up(fraction * n) in double arithmetic."""
    return math.floor(n * float(fraction) + 0.5)


def _hash_text(id_col: str, seed: int):
    return F.coalesce(split_hash(id_col, seed), F.lit(""))


def split_column(
    df: DataFrame,
    label_col: str = S.TARGET_COLUMN,
    id_col: str = S.ID_COLUMN,
    test_size: float = S.TEST_SIZE,
    calibration_size: float = S.CALIBRATION_SIZE,
    seed: int = S.RANDOM_STATE,
) -> Column:
    """``holdout`` / ``calibration`` / ``train`` as an expression of a row's id and label.

    ``df`` is read a few times by narrow aggregations to find two border keys per class.
    """
    narrow = df.select(F.col(label_col).alias("_y"), F.col(id_col).cast("string").alias("_i"), _hash_text(id_col, seed).alias("_h"))
    sizes = group_sizes(narrow, "_y")
    borders = {}
    for y, n in sizes.items():
        hold = _rounded(n, test_size)
        borders[y] = (hold, hold + _rounded(n - hold, calibration_size))
    keys = kth_keys(narrow, "_y", "_h", "_i", {y: sorted(set(b)) for y, b in borders.items()})
    h, i = _hash_text(id_col, seed), F.col(id_col).cast("string")
    split = F.lit("train")
    for y, (hold, upto) in borders.items():
        mine = F.when(at_most(h, i, keys.get((y, hold))), "holdout").when(
            at_most(h, i, keys.get((y, upto))), "calibration").otherwise("train")
        split = F.when(F.col(label_col).eqNullSafe(F.lit(y)), mine).otherwise(split)
    return split


def with_split(df: DataFrame, **kwargs) -> DataFrame:
    """``df`` with its ``split`` column: a projection."""
    ensure_checkpoint_dir(df.sparkSession)
    id_col, label_col = kwargs.get("id_col", S.ID_COLUMN), kwargs.get("label_col", S.TARGET_COLUMN)
    return df.withColumn("split", split_column(df.select(id_col, label_col).checkpoint(), **kwargs))


def split_table(
    df: DataFrame,
    label_col: str = S.TARGET_COLUMN,
    id_col: str = S.ID_COLUMN,
    test_size: float = S.TEST_SIZE,
    calibration_size: float = S.CALIBRATION_SIZE,
    folds: int | None = S.CV_FOLDS,
    seed: int = S.RANDOM_STATE,
    num_partitions: int | None = None,
) -> DataFrame:
    """(id, label, split_hash, split, fold) of every row; only (id, hash) of the training rows is ranked (``folds`` None: nothing)."""
    ensure_checkpoint_dir(df.sparkSession)
    narrow = df.select(F.col(id_col), F.col(label_col)).checkpoint()
    split = split_column(narrow, label_col, id_col, test_size, calibration_size, seed)
    tagged = narrow.select(id_col, label_col, split_hash(id_col, seed).alias("split_hash"), split.alias("split"))
    if folds is None:
        return tagged.withColumn("fold", F.lit(None).cast("int"))
    ranked = rank_within_groups(tagged.where(F.col("split") == "train"), label_col, [F.col("split_hash").asc(), F.col(id_col).asc()],
                                rank_col="_pos", num_partitions=num_partitions)
    dealt = ranked.select(id_col, label_col, "split_hash", "split", ((F.col("_pos") - 1) % folds).cast("int").alias("fold"))
    return dealt.unionByName(tagged.where(F.col("split") != "train").withColumn("fold", F.lit(None).cast("int")))


def assign_splits(df: DataFrame, id_col: str = S.ID_COLUMN, **kwargs) -> DataFrame:
    """``df`` with ``split`` (train / calibration / holdout) and ``fold`` (train rows only), joined by id."""
    tags = split_table(df, id_col=id_col, **kwargs).select(id_col, "split", "fold")
    return df.join(tags, id_col)


def saved_positions(tags: DataFrame, id_col: str = S.ID_COLUMN) -> DataFrame:
    """(position, id, split) of the calibration and holdout rows; positions count from 0 within a split."""
    saved = tags.where(F.col("split") != "train").select(F.col(id_col).cast("string").alias(id_col), "split", "split_hash")
    ranked = rank_within_groups(saved, "split", [F.col("split_hash").asc(), F.col(id_col).asc()], rank_col="_pos")
    return ranked.select((F.col("_pos") - 1).alias("position"), id_col, "split")


def class_counts(assigned: DataFrame, label_col: str = S.TARGET_COLUMN) -> DataFrame:
    """Rows and rate per split and class."""
    return assigned.groupBy("split", F.col(label_col).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("students"))


def scale_pos_weight(train: DataFrame, label_col: str = S.TARGET_COLUMN) -> DataFrame:
    """Negatives / positives among the given (training) rows."""
    y = F.col(label_col).cast("long")
    return train.agg((F.sum(F.lit(1) - y) / F.sum(y)).alias("scale_pos_weight"))


def select_ids(df: DataFrame, ids: DataFrame, id_col: str = S.ID_COLUMN) -> DataFrame:
    """Rows of the saved ids with their ``position``; every saved id must exist.

    An equi-join on the id (broadcast only where the engine finds the id table
    small); the anti-join check runs as one count and raises if non-zero.
    """
    keys = ids.select(F.col(id_col).cast("string").alias("_sel_id"), "position")
    rows = df.withColumn("_sel_id", F.col(id_col).cast("string"))
    missing = keys.join(rows.select("_sel_id"), "_sel_id", "left_anti").limit(1).count()
    if missing:
        raise ValueError("Saved holdout ids are missing from the data.")
    return rows.join(keys, "_sel_id").drop("_sel_id")

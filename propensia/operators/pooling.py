"""Pool-adjacent-violators as a mergeable stack of blocks (M5).

The isotonic fit of a range of scores is a stack of blocks with rising means.
The fit of two neighbouring ranges is the two stacks put together with
violators pooled where they meet, so stacks can be merged in any grouping of
neighbours: range tasks pool their own scores, then ``FAN_IN`` neighbours at a
time are merged up a tree.

Pooling shrinks: 0/1 labels over n rows leave at most about n^(2/3) blocks
(means are fractions whose denominators add up to n), and n^(1/3) is usual, so
the task at the root sees blocks, never all distinct scores.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, importable

FAN_IN = 8
_BLOCKS = "slot long, lo double, hi double, total double, weight double"

Block = tuple[float, float, float, float]           # first score, last score, sum of labels, rows


def push(stack: list[Block], block: Block) -> None:
    """Put a block on the stack; blocks whose means do not rise become one."""
    lo, hi, total, weight = block
    while stack and stack[-1][2] * weight >= total * stack[-1][3]:
        before = stack.pop()
        lo, total, weight = before[0], total + before[2], weight + before[3]
    stack.append((lo, hi, total, weight))


def pool(blocks: Iterable[Block]) -> list[Block]:
    """The stack of blocks that come in score order."""
    stack: list[Block] = []
    for b in blocks:
        push(stack, b)
    return stack


def _columns(slot: int, stack: list[Block]) -> list[pa.Array]:
    return [pa.array([slot] * len(stack), pa.int64()), *(pa.array([b[k] for b in stack], pa.float64()) for k in range(4))]


def pooled_blocks(df: DataFrame, score_col: str, label_col: str, fan_in: int = FAN_IN) -> DataFrame:
    """(lo, hi, mean, weight): the blocks of the increasing fit, one row each; rows without a score or label do not count.

    Equal scores are one point (their mean label, weighted by their rows).
    """
    names = ["slot", "lo", "hi", "total", "weight"]

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = ((s, s, t, w) for b in batches for s, t, w in zip(*(b.column(k).to_pylist() for k in range(3))))
        stack = pool(points)
        if stack:
            yield pa.RecordBatch.from_arrays(_columns(TaskContext.get().partitionId(), stack), names=names)

    def merge(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("lo")
        stack = pool(zip(*(t.column(k).to_pylist() for k in names[1:])))
        return pa.Table.from_arrays(_columns(key[0].as_py(), stack), names=names)

    spark = df.sparkSession
    importable(spark)
    ensure_checkpoint_dir(spark)
    points = df.where(F.col(score_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(
        F.col(score_col).cast("double").alias("s")).agg(F.sum(F.col(label_col).cast("double")).alias("t"),
                                                        F.count(F.lit(1)).cast("double").alias("w"))
    level = points.repartitionByRange("s").sortWithinPartitions("s").mapInArrow(leaf, _BLOCKS).checkpoint()
    slots = (level.agg(F.max("slot")).first()[0] or 0) + 1
    while slots > 1:
        level = level.select(F.floor(F.col("slot") / fan_in).alias("parent"), *names).groupBy("parent").applyInArrow(merge, _BLOCKS)
        slots = -(-slots // fan_in)
    return level.select("lo", "hi", (F.col("total") / F.col("weight")).alias("mean"), "weight")

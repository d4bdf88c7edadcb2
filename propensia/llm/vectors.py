"""Integer vectors: what the search and the whitening operators read of an embedding table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import q

#: Components are multiplied by this and rounded down.
STEPS = 256
_SAFE = 1 << 62


def integer_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id long, x array<long>): floor(256 * c) of every vector that is whole.

    A vector takes no part if it is null or holds a null or non-finite
    component.  Components beyond 64 bits become the nearest long.
    """
    good = F.forall(q(vec_col), lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    scaled = F.transform(q(vec_col), lambda c: F.floor(c.cast("double") * float(STEPS)).cast("long"))
    return df.where(q(vec_col).isNotNull() & good).select(q(id_col).cast("long").alias("vec_id"), scaled.alias("x"))


def padded(x: Column, width: int) -> Column:
    """``x`` with zeros up to ``width`` components."""
    return F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(x)))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows x ``width`` int64 matrix of a list column without nulls."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    return flat.reshape(len(column), width)


def largest(m: np.ndarray) -> int:
    """The largest absolute value, as a Python integer."""
    return max(abs(int(m.max())), abs(int(m.min()))) if m.size else 0


def clamp(values: list[int]) -> np.ndarray:
    """Python integers as longs; beyond 64 bits the nearest long."""
    return np.array([min(max(v, -(1 << 63)), (1 << 63) - 1) for v in values], dtype=np.int64)


def row_dots(a: np.ndarray, b: np.ndarray) -> list[int] | np.ndarray:
    """Exact inner products of the rows of two long matrices (Python integers where 64 bits may not do)."""
    if largest(a) * largest(b) * max(1, a.shape[1]) < _SAFE:
        return np.einsum("ij,ij->i", a, b)
    return [sum(int(u) * int(v) for u, v in zip(x, y)) for x, y in zip(a, b)]

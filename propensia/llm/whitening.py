"""Embedding whitening: blockwise QR, Householder bidiagonal form, dqds values, twisted-factorisation vectors.

1. *Rows.*  Every whole vector becomes a long vector x = floor(256 * c); each
   distinct x counts once for the fit (``distinct`` with map-side combine, so
   copies that hold a third of all rows meet as one row per partition).
2. *Centre.*  n and the exact sums S per dimension, from one row per dimension
   and partition.
3. *Blockwise QR.*  Each task stacks its centred rows in blocks under its
   current triangle and keeps the new triangle; triangles are merged eight at
   a time in a tree.  Only one width x width triangle reaches the driver.
4. *Directions.*  The triangle is bidiagonalised by reflections; dqds gives
   its singular values, twisted factorisations the right vectors of the
   leading ones (``bidiagonal``).
5. *Project.*  One pass writes the projections of all rows; one pass over the
   distinct vectors measures their covariance against the identity.

Nothing in a task grows with the number of rows: a block of rows and a
triangle; a width of d takes about 8 * d * (d + BLOCK_ROWS) bytes.

Defined cases: vectors that are null or hold a null or non-finite component
are left out, rows with a null id stay; repeated rows stay in the result and
count once in the fit; shorter vectors count as padded with zeros; an empty
table, or only vectors without components, gives an empty result; a direction
without variance (fewer distinct vectors than components, constant columns)
has ``whitened`` null and does not count for ``identity_error`` (null if none
is left), and ``explained`` is null if there is no variance at all; equal
eigenvalues have orthogonal components in any order; a deviation beyond 64
bits becomes the largest long; a very long vector only widens the triangle;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bidiagonal import leading
from .common import written
from .vectors import _SAFE, clamp, integer_vectors, largest, matrix, padded

BLOCK_ROWS = 4096
FAN_IN = 8

RESULT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
          "identity_error double")


def column_sums(rows: DataFrame, width: int) -> tuple[int, list[int]]:
    """(number of rows, exact sum per dimension) of the column ``x``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = 0, [0] * width
        for b in batches:
            m = matrix(b.column(0), width)
            whole = m.sum(axis=0) if largest(m) * max(1, len(m)) < _SAFE else m.astype(object).sum(axis=0)
            count += len(m)
            sums = [s + int(v) for s, v in zip(sums, whole)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(-1, width), pa.int32()),
             pa.array([Decimal(count), *map(Decimal, sums)], pa.decimal128(38, 0))], names=["dim", "s"])

    got = rows.select("x").mapInArrow(run, "dim int, s decimal(38,0)").groupBy("dim").agg(F.sum("s").alias("s")).collect()
    by = {r["dim"]: int(r["s"]) for r in got}
    return by.get(-1, 0), [by.get(i, 0) for i in range(width)]


class Centre:
    """Centred doubles and exact deviations of integer rows, given n and the sums S."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n, self.sums = n, sums
        whole = [s // n for s in sums]
        self.whole = clamp(whole)
        self.part = np.array([(s - w * n) / n for s, w in zip(sums, whole)])

    def rows(self, m: np.ndarray) -> np.ndarray:
        """x - S/n; the whole part of the mean goes off in integers where they fit."""
        if largest(m) + largest(self.whole) < _SAFE:
            return (m - self.whole).astype(float) - self.part
        return m.astype(float) - (self.whole.astype(float) + self.part)

    def deviations(self, m: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n * x - S)^2, exact up to the largest long."""
        most = self.n * largest(m) + max(map(abs, self.sums), default=0)
        if most * most * max(1, m.shape[1]) < _SAFE:
            d = self.n * m - np.array(self.sums, dtype=np.int64)
            return np.einsum("ij,ij->i", d, d)
        return clamp([sum((self.n * int(x) - s) ** 2 for x, s in zip(r, self.sums)) for r in m])


def _merged(triangles: Iterator[np.ndarray], width: int) -> np.ndarray | None:
    r = None
    for t in triangles:
        stacked = t if r is None else np.vstack([r, t])
        r = np.linalg.qr(stacked, mode="r")
    if r is None:
        return None
    out = np.zeros((width, width))
    out[: r.shape[0]] = r
    return out


def triangle(rows: DataFrame, centre: Centre, width: int) -> np.ndarray:
    """The triangle R with R.T * R = the sum of products of the centred rows: blockwise QR in a tree."""

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = (centre.rows(matrix(b.column(0).slice(i, BLOCK_ROWS), width))
                  for b in batches for i in range(0, b.num_rows, BLOCK_ROWS))
        r = _merged(blocks, width)
        if r is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())],
                names=["slot", "r"])

    def merge(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("slot")
        r = _merged((np.frombuffer(x, float).reshape(width, width) for x in t.column("r").to_pylist()), width)
        return pa.table({"slot": pa.array([key[0].as_py()], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    level = written(rows.select("x").mapInArrow(leaves, "slot long, r binary"), "whitening_triangles")
    slots = (level.agg(F.max("slot")).first()[0] or 0) + 1
    while slots > 1:
        level = level.select((F.col("slot") / FAN_IN).cast("long").alias("parent"), "slot", "r").groupBy("parent") \
            .applyInArrow(merge, "slot long, r binary")
        slots = -(-slots // FAN_IN)
    return np.frombuffer(level.first()["r"], float).reshape(width, width)


def _identity_error(rows: DataFrame, centre: Centre, weights: np.ndarray) -> float | None:
    """Largest entry of the covariance of the projections minus the identity, over the directions with variance."""
    k, width = weights.shape
    used = np.flatnonzero(np.any(weights != 0, axis=1))
    if not len(used):
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for b in batches:
            z = centre.rows(matrix(b.column(0), width)) @ weights.T
            first += z.sum(axis=0)
            second += z.T @ z
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(k + k * k), pa.int32()), pa.array(np.concatenate([first, second.ravel()]))], names=["at", "v"])

    got = {r["at"]: r["v"] for r in rows.select("x").mapInArrow(run, "at int, v double")
           .groupBy("at").agg(F.sum("v").alias("v")).collect()}
    v = np.array([got[i] for i in range(k + k * k)]) / centre.n
    cov = v[k:].reshape(k, k) - np.outer(v[:k], v[:k])
    return float(np.abs(cov - np.eye(k))[np.ix_(used, used)].max())


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 4) -> DataFrame:
    """One row per whole vector and component (1 is the direction of the largest variance): see RESULT."""
    spark = df.sparkSession
    base = written(integer_vectors(df, id_col, vec_col), "whitening_vectors")
    width = base.agg(F.max(F.size("x"))).first()[0] or 0
    if width == 0:
        return spark.createDataFrame([], RESULT)
    base = base.select("vec_id", padded(F.col("x"), width).alias("x"))
    fit = written(base.select("x").distinct(), "whitening_fit")
    centre = Centre(*column_sums(fit, width))
    every, top, vectors = leading(triangle(fit, centre, width), components)
    with np.errstate(divide="ignore", invalid="ignore"):
        # z = (x - S/n) * v / sqrt(e), with e = s * s / n
        weights = np.where(top[:, None] > 0, vectors * np.sqrt(centre.n) / top[:, None], 0.0)
        trace = float(every @ every)
        explained = [float(s * s / trace) if trace > 0 else None for s in top]
    error = _identity_error(fit, centre, weights)
    flat, k = top == 0, len(top)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = matrix(b.column(1), width)
            z = centre.rows(m) @ weights.T
            ids = b.column(0).take(pa.array(np.repeat(np.arange(len(m)), k)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(m))),
                 pa.array(np.repeat(centre.deviations(m), k)),
                 pa.array(z.ravel(), mask=np.tile(flat, len(m)))],
                names=["vec_id", "component", "deviation", "whitened"])

    z = base.mapInArrow(project, "vec_id long, component int, deviation long, whitened double")
    share = F.lit(None).cast("double")
    for i, x in enumerate(explained):
        share = F.when(F.col("component") == i + 1, F.lit(x).cast("double")).otherwise(share)
    return z.select("vec_id", "component", F.lit(centre.n).cast("long").alias("n"), "deviation", "whitened",
                    share.alias("explained"), F.lit(error).cast("double").alias("identity_error"))

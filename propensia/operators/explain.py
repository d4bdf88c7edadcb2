"""Per-student feature drivers of the boosted trees (M9).

Re-aims the application's per-student SHAP panel as a batch job over every
student.  Attribution is the path (Saabas) decomposition, not Shapley
values: along a row's path in each tree, the change of the node value at
every split is credited to the split's feature.
Invariant: ``base + sum(contributions) == margin`` (the pre-calibration raw
margin; probability = 1 / (1 + exp(-margin))).

Trees are flat arrays shipped with the closure; rows are walked vectorised in
Arrow batches.  The top-k per student is picked in the JVM with ``sort_array``
on the contribution array -- no shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import importable

NODE_FIELDS = ("feature", "threshold", "left", "right", "value")


def _matrix(pdf: pd.DataFrame, n_features: int) -> np.ndarray:
    return np.vstack(pdf["_x"].to_numpy()) if len(pdf) else np.zeros((0, n_features))


def margins(trees: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Margin of each row and its path attribution (rows, features), from the arrays of ``gbt.flat_trees``."""
    total, parts = np.zeros(len(x)), np.zeros((len(x), trees["n_features"]))
    feature, threshold, left, right, value = (trees[k] for k in NODE_FIELDS)
    for start in trees["starts"].tolist():
        node = np.full(len(x), start, np.int64)
        while True:
            inner = np.flatnonzero(feature[node] >= 0)
            if not len(inner):
                break
            at = node[inner]
            child = np.where(x[inner, feature[at]] <= threshold[at], left[at], right[at])
            parts[inner, feature[at]] += value[child] - value[at]        # each row once
            node[inner] = child
        total += value[node]
    return total, parts


def base_margin(trees: dict) -> float:
    """Sum of the trees' root values: the margin before any split is followed."""
    return float(trees["value"][trees["starts"]].sum())


def path_contributions(encoded: DataFrame, model: dict, id_col: str, features_col: str = "features") -> DataFrame:
    """(id, base, margin, contributions array) for every row."""
    importable(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        trees = shared.value
        base = base_margin(trees)
        for pdf in batches:
            margin, parts = margins(trees, _matrix(pdf, trees["n_features"]))
            yield pd.DataFrame({id_col: pdf[id_col].to_numpy(), "base": np.full(len(pdf), base), "margin": margin,
                                "contributions": list(parts)})

    src = encoded.select(F.col(id_col), vector_to_array(F.col(features_col)).alias("_x"))
    schema = T.StructType([
        T.StructField(id_col, encoded.schema[id_col].dataType, True),
        T.StructField("base", T.DoubleType(), False),
        T.StructField("margin", T.DoubleType(), False),
        T.StructField("contributions", T.ArrayType(T.DoubleType(), False), False),
    ])
    return src.mapInPandas(run, schema)


def top_drivers(contribs: DataFrame, names: list[str], id_col: str, k: int = 10) -> DataFrame:
    """Top-k features per row by absolute contribution (ties: lower feature index)."""
    keyed = F.transform("contributions", lambda v, i: F.struct((-F.abs(v)).alias("a"), i.alias("i"), v.alias("v")))
    top = F.slice(F.sort_array(keyed), 1, k)
    name_arr = F.array(*[F.lit(n) for n in names])
    return contribs.select(F.col(id_col), F.posexplode(top).alias("pos", "p")).select(
        F.col(id_col),
        (F.col("pos") + 1).alias("driver_rank"),
        F.element_at(name_arr, F.col("p.i") + 1).alias("feature"),
        F.col("p.v").alias("contribution"),
        F.abs(F.col("p.v")).alias("abs_contribution"),
    )

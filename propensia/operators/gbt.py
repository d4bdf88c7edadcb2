"""Boosted trees on distributed rows (M1-M4, M8): MLlib's GBTClassifier, several fits in flight.

Every fit of the candidate x fold grid is a series of Spark jobs over all
training rows (histograms per node and feature, summed over tasks).  One fit
alone leaves a cluster idle between its small jobs, so a bounded pool of driver
threads keeps ``in_flight`` fits going, each in a fair-scheduler pool of its
own; a fit that fails is tried again without touching the others.

``tree_share`` scales a candidate's number of trees, its rate inversely, for a
trial run.  1.0 is the candidates' own setting, which every registered query uses.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Hashable, Mapping
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..session import ensure_checkpoint_dir, shared_scratch

IN_FLIGHT = 9               # the grid of three candidates and three folds
ATTEMPTS = 3
ROWS_PER_TASK = 50_000      # about a tenth of a second of histograms, against the few milliseconds that a task costs


def n_trees(params: Mapping, tree_share: float = 1.0) -> int:
    return max(1, round(int(params["n_estimators"]) * tree_share))


def n_tasks(rows: int) -> int:
    """Tasks of each boosting job over so many rows: every level of every tree is a job with a shuffle of as many tasks."""
    return max(1, -(-rows // ROWS_PER_TASK))


def classifier(params: Mapping, tree_share: float = 1.0, seed: int = S.RANDOM_STATE, weight_col: str | None = "weight") -> GBTClassifier:
    """M1: the candidate as an MLlib estimator.

    MLlib knows no L2 leaf penalty; a child needs ``min_child_weight`` rows
    instead of that much hessian, and columns are drawn per node, not per tree.
    """
    trees = n_trees(params, tree_share)
    rate = min(1.0, float(params["learning_rate"]) * int(params["n_estimators"]) / trees)
    gbt = GBTClassifier(
        featuresCol="features", labelCol="label", maxDepth=int(params["max_depth"]), maxIter=trees, stepSize=rate,
        minInstancesPerNode=max(1, int(params["min_child_weight"])), subsamplingRate=float(params["subsample"]),
        featureSubsetStrategy=str(float(params["colsample_bytree"])), maxBins=64, seed=seed)
    return gbt.setWeightCol(weight_col) if weight_col else gbt


def fit_all(spark: SparkSession, fits: Mapping[Hashable, Callable[[], object]], in_flight: int = IN_FLIGHT,
            attempts: int = ATTEMPTS) -> dict[Hashable, object]:
    """M3: the results of all fits, at most ``in_flight`` at a time; each is tried ``attempts`` times.

    If a fit fails for good, the others are let finish and its error is raised.
    """
    ensure_checkpoint_dir(spark)
    sc = spark.sparkContext

    def one(key: Hashable, fit: Callable[[], object]) -> object:
        sc.setLocalProperty("spark.scheduler.pool", f"fit-{key}")
        try:
            for left in range(attempts - 1, -1, -1):
                try:
                    return fit()
                except Exception:
                    if not left:
                        raise
        finally:
            sc.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(max_workers=max(1, in_flight)) as pool:
        running = {key: pool.submit(inheritable_thread_target(spark)(one), key, fit) for key, fit in fits.items()}
    return {key: f.result() for key, f in running.items()}


def fit_grid(spark: SparkSession, rows: Mapping[int, DataFrame], candidates: list[dict], seed: int, tree_share: float = 1.0,
             in_flight: int = IN_FLIGHT) -> dict[tuple[str, int], GBTClassificationModel]:
    """M2, M3: a model per (candidate, fold); ``rows`` has the (features, label, weight) training rows of each fold.

    Fits with the most jobs start first, so that none is left running alone.
    """
    longest = sorted(candidates, key=lambda c: -n_trees(c["params"], tree_share) * int(c["params"]["max_depth"]))
    fits = {(c["name"], f): (lambda c=c, part=part: classifier(c["params"], tree_share, seed).fit(part))
            for c in longest for f, part in rows.items()}
    return fit_all(spark, fits, in_flight)


def raw_scores(encoded: DataFrame, model: GBTClassificationModel, keep: list[str]) -> DataFrame:
    """M4: ``keep`` columns and raw_score, the probability of class 1."""
    scored = model.setFeaturesCol("features").transform(encoded)
    return scored.select(*keep, F.get(vector_to_array("probability"), F.lit(1)).alias("raw_score"))


def flat_trees(model: GBTClassificationModel, spark: SparkSession) -> dict:
    """The trees as flat arrays over all nodes (feature, threshold, left, right, value), for attribution.

    Read from the model's own saved node table; a node's value is its share of
    the margin, log-odds of the raw score.  Trees have at most 2^depth leaves.
    """
    path = shared_scratch(spark, f"trees/{uuid.uuid4().hex}")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()
    weights = model.treeWeights
    starts, out = [], {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    for i, n in enumerate(nodes):
        if n["id"] == 0:
            starts.append(i)
        base, leaf = starts[-1], n["leftChild"] < 0
        out["feature"].append(-1 if leaf else n["split"]["featureIndex"])
        out["threshold"].append(0.0 if leaf else n["split"]["leftCategoriesOrThreshold"][0])
        out["left"].append(-1 if leaf else base + n["leftChild"])
        out["right"].append(-1 if leaf else base + n["rightChild"])
        out["value"].append(2.0 * weights[n["treeID"]] * n["prediction"])
    kinds = {"threshold": np.float64, "value": np.float64}
    return {**{k: np.array(v, kinds.get(k, np.int64)) for k, v in out.items()},
            "starts": np.array(starts, np.int64), "n_features": model.numFeatures}

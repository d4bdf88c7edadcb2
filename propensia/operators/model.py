"""Model operators (M1-M8): class weights, calibration, importances, candidate choice.

The trees themselves are in ``gbt``; calibration is isotonic regression:
adjacent violators are pooled in ``pooling``, MLlib's model applies the result.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import round_to
from . import gbt
from .pooling import pooled_blocks


def class_weight(label_col: str, scale_pos_weight: float) -> F.Column:
    """Per-row weight: ``scale_pos_weight`` for positives, 1 for negatives."""
    return F.when(F.col(label_col) == 1, F.lit(float(scale_pos_weight))).otherwise(F.lit(1.0))


def fit_calibrator(cal: DataFrame, raw_col: str = "raw_score", label_col: str = "label") -> IsotonicRegressionModel:
    """M5: increasing isotonic map fitted on the calibration split only.

    Violators are pooled in a tree of tasks (``pooling``); MLlib's fit gets both
    ends of the few blocks that are left, which already rise.
    """
    ends = pooled_blocks(cal, raw_col, label_col).select(
        F.explode(F.when(F.col("lo") < F.col("hi"), F.array("lo", "hi")).otherwise(F.array("lo"))).alias(raw_col),
        F.col("mean").alias(label_col), F.col("weight").alias("_rows"))
    iso = IsotonicRegression(featuresCol=raw_col, labelCol=label_col, weightCol="_rows", predictionCol="calibrated",
                             isotonic=True)
    return iso.fit(ends)


def calibrate(df: DataFrame, calibrator: IsotonicRegressionModel, raw_col: str = "raw_score",
              out_col: str = "score") -> DataFrame:
    """M5 + M6: apply the map (clamped at both ends by the model) and clip to [0, 1]."""
    calibrator = calibrator.copy()
    calibrator.setFeaturesCol(raw_col).setPredictionCol("_calibrated")
    out = calibrator.transform(df)
    return out.withColumn(out_col, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_calibrated")))).drop(
        "_calibrated"
    )


def feature_importance(model: GBTClassificationModel, names: list[str], spark, top: int = 15) -> DataFrame:
    """M8: the ``top`` largest importances, rounded to 6 places (bounded: one row per feature)."""
    values = model.featureImportances.toArray().tolist()
    df = spark.createDataFrame([(n, float(v)) for n, v in zip(names, values)], "feature string, importance double")
    return df.orderBy(F.col("importance").desc(), F.col("feature")).limit(top).select(
        "feature", round_to(F.col("importance"), 6).alias("importance")
    )


def score_with(encoded: DataFrame, model: GBTClassificationModel, calibrator: IsotonicRegressionModel, keep: list[str]) -> DataFrame:
    """M7: encoded features -> raw probability -> calibrated, clipped score."""
    return calibrate(gbt.raw_scores(encoded, model, keep), calibrator)


def candidate_order() -> list[F.Column]:
    """M3: best first by average precision, ROC-AUC, then Brier; the first candidate wins ties."""
    return [F.col("average_precision").desc(), F.col("roc_auc").desc(), F.col("brier_score").asc(), F.col("position").asc()]


def choose_candidate(means: DataFrame) -> DataFrame:
    """M3: the best row of (candidate, position, mean metrics)."""
    return means.orderBy(*candidate_order()).limit(1)

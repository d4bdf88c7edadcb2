"""Training and batch-scoring jobs (lifecycle A and C).

``train``: validate -> features -> stratified splits -> cross-validated
candidate choice -> fit on the training split -> isotonic calibration on the
calibration split -> thresholds learned on calibrated calibration scores ->
holdout evaluation -> artifacts.  Everything is Spark jobs over the whole table:
trees grow on all training rows, several fits of the grid in flight (``gbt``).
Only bounded summaries (one row per metric, candidate or rule) reach the driver.

``holdout_bundle``: the saved holdout rows, re-selected by id in saved order
and scored: what every evaluation page starts from.

``score_batch``: validate an upload (no target) -> features -> encoder ->
trees -> calibration -> tiers / signal -> CSV.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.labels import probability_pct, tier_by_threshold, top_signal
from ..operators import features as FE
from ..operators import gbt
from ..operators import metrics as M
from ..operators import model as MD
from ..operators import rank as R
from ..operators import split as SP
from ..operators import thresholds as TH
from ..operators import validate as VA
from ..operators.prep import CODES_SCHEMA, LeadEncoder, LeadEncoderModel, split_column_kinds
from ..session import short_methods, written
from ..sources.files import load_split_ids, save_split_ids, write_csv

ID = S.ID_COLUMN
Y = S.TARGET_COLUMN
SPLIT_COLS = ["split", "fold"]
METRICS = ("roc_auc", "average_precision", "pr_auc", "brier_score")
SHEET_INPUTS = ["ai_mentor_recency_weight", "pricing_page_visits", "cart_items_count", "engagement_intensity",
                "current_streak_days", "course_interest"]


@dataclass
class TrainConfig:
    candidates: list[dict] = field(default_factory=lambda: list(S.MODEL_CANDIDATES))
    tree_share: float = 1.0          # of each candidate's trees; its rate grows inversely
    fits_in_flight: int = gbt.IN_FLIGHT
    cv_folds: int = S.CV_FOLDS       # 0: the first candidate is taken as it is
    min_precision: float = S.HIGH_PRECISION_TARGET
    seed: int = S.RANDOM_STATE
    expected_columns: list[str] = field(default_factory=lambda: list(S.MODEL_SCHEMA_COLUMNS))


@dataclass
class Artifacts:
    encoder: LeadEncoderModel
    model: GBTClassificationModel
    calibrator: IsotonicRegressionModel
    config: dict
    saved_ids: DataFrame               # (position, student_id, split) of the calibration and holdout rows
    scored: DataFrame | None = None    # id, label, split, raw_score, score (all rows)
    cv_scores: DataFrame | None = None  # candidate, fold, label, raw_score of the validation rows


def _frame_columns(df: DataFrame, dropped: list[str]) -> list[str]:
    exclude = {ID, Y, *dropped, *SPLIT_COLS}
    return [c for c in df.columns if c not in exclude]


def _spw(df: DataFrame) -> float:
    row = SP.scale_pos_weight(df).first()
    return float(row["scale_pos_weight"]) if row and row["scale_pos_weight"] is not None else 1.0


def _fit_encoder(rows: DataFrame, cols: list[str]) -> LeadEncoderModel:
    cat, num = split_column_kinds(rows.select(*cols), exclude=[])
    return LeadEncoder(cat, num).fit(rows)


def _fit_rows(enc: LeadEncoderModel, rows: DataFrame) -> DataFrame:
    """(features, label, weight) of the given training rows, all of them, in tasks that are worth a boosting job.

    Checkpointed: every one of a fit's many jobs ships the lineage of its rows, so that must be short.
    """
    out = enc.transform(rows, keep=[Y])
    out = out.select("features", F.col(Y).cast("double").alias("label"), MD.class_weight(Y, _spw(rows)).alias("weight"))
    return out.coalesce(gbt.n_tasks(rows.count())).checkpoint()


def cross_validate(train_rows: DataFrame, cols: list[str], cfg: TrainConfig) -> tuple[DataFrame, DataFrame]:
    """M3: (validation scores, metrics) of every candidate and fold.

    One encoder per fold; the fits of the grid run side by side; the metrics of
    all candidates and folds come from one pass over the scores.
    """
    spark = train_rows.sparkSession

    def prepared(f: int) -> tuple[LeadEncoderModel, DataFrame]:
        rows = train_rows.where(F.col("fold") != f)
        enc = _fit_encoder(rows, cols)
        return enc, _fit_rows(enc, rows)

    ready = gbt.fit_all(spark, {f: lambda f=f: prepared(f) for f in range(cfg.cv_folds)}, cfg.fits_in_flight)
    encoders, parts = {f: enc for f, (enc, _) in ready.items()}, {f: part for f, (_, part) in ready.items()}
    models = gbt.fit_grid(spark, parts, cfg.candidates, cfg.seed, cfg.tree_share, cfg.fits_in_flight)
    scores = None
    for f, enc in encoders.items():
        encoded = enc.transform(train_rows.where(F.col("fold") == f), keep=[Y]).persist()
        for c in cfg.candidates:
            part = gbt.raw_scores(encoded, models[c["name"], f], [Y]).select(
                F.lit(c["name"]).alias("candidate"), F.lit(f).alias("fold"), F.col(Y).cast("int").alias("label"), "raw_score")
            part = part.checkpoint(eager=True)           # a job of its own: a task of one job for all would hold every model
            scores = part if scores is None else scores.unionByName(part)
        encoded.unpersist()
    return scores, M.ranking_metrics(scores, "raw_score", "label", keys=("candidate", "fold"))


def candidate_means(fold_metrics: DataFrame, candidates: list[dict]) -> DataFrame:
    """E10 with each candidate's position in the list (the first wins ties)."""
    order = F.create_map(*[x for i, c in enumerate(candidates) for x in (F.lit(c["name"]), F.lit(i))])
    return M.fold_summary(fold_metrics).withColumn("position", order[F.col("candidate")])


def _metrics_row(df: DataFrame, score_col: str) -> dict:
    r = M.ranking_metrics(df, score_col, Y).first()
    return {k: (float(r[k]) if r[k] is not None else float("nan")) for k in METRICS}


def train(spark: SparkSession, raw: DataFrame, cfg: TrainConfig | None = None) -> Artifacts:
    cfg = cfg or TrainConfig()
    short_methods(spark)
    warnings = VA.require_valid(raw, cfg.expected_columns, True, "Training data").warnings
    df = FE.engineer(raw)
    dropped = S.leak_columns(df.columns)
    if cfg.cv_folds:
        tags = SP.split_table(df, seed=cfg.seed, folds=cfg.cv_folds)            # narrow, checkpointed
        assigned = df.join(tags.select(ID, *SPLIT_COLS), ID)
    else:                                                # the split alone is an expression of a row's own columns
        assigned = SP.with_split(df, seed=cfg.seed).withColumn("fold", F.lit(None).cast("int"))
    assigned = written(assigned, "train")                # read some ten times, few columns at a time
    saved_ids = SP.saved_positions(assigned.select(ID, "split", SP.split_hash(ID, cfg.seed).alias("split_hash")))
    cols = _frame_columns(assigned, dropped)
    train_rows = assigned.where(F.col("split") == "train")

    cv_scores, folds, mean_of, best = None, [], {c["name"]: None for c in cfg.candidates}, cfg.candidates[0]
    if cfg.cv_folds:
        cv_scores, fold_metrics = cross_validate(train_rows, cols, cfg)
        fold_metrics = fold_metrics.checkpoint()                         # read three times
        folds = [r.asDict() for r in fold_metrics.collect()]             # candidates x folds rows
        means = candidate_means(fold_metrics, cfg.candidates).checkpoint()
        mean_of = {r["candidate"]: {m: r[m] for m in METRICS} for r in means.collect()}
        best = cfg.candidates[MD.choose_candidate(means).first()["position"]]
    cv_results = [{"name": c["name"], "params": c["params"], "mean_metrics": mean_of[c["name"]],
                   "fold_metrics": [{m: r[m] for m in METRICS} for r in sorted(folds, key=lambda r: r["fold"])
                                    if r["candidate"] == c["name"]]} for c in cfg.candidates]

    enc = _fit_encoder(train_rows, cols)
    spw = _spw(train_rows)
    model = gbt.classifier(best["params"], cfg.tree_share, cfg.seed).fit(_fit_rows(enc, train_rows))
    raw_all = gbt.raw_scores(enc.transform(assigned, keep=[ID, Y, "split"]), model, [ID, Y, "split"])
    raw_all = raw_all.withColumn("label", F.col(Y).cast("double")).checkpoint(eager=True)
    calibrator = MD.fit_calibrator(raw_all.where(F.col("split") == "calibration"))
    scored = MD.calibrate(raw_all, calibrator).select(ID, Y, "split", "raw_score", "score").checkpoint(eager=True)

    cal = scored.where(F.col("split") == "calibration")
    hold = scored.where(F.col("split") == "holdout")
    policy = {r["policy"]: r.asDict() for r in TH.learn_policy(cal, "score", Y, cfg.min_precision).collect()}
    high_t, out_t = float(policy["high"]["threshold"]), float(policy["outreach"]["threshold"])
    test_summ = {r["threshold"]: r.asDict() for r in M.threshold_summary(hold, "score", Y, [high_t, out_t]).collect()}
    lifts = {round(r["fraction"], 2): r.asDict() for r in R.lift_at(hold, "score", Y, ID, (0.10, 0.20)).collect()}
    names = enc.feature_names()
    top = {r["feature"]: r["importance"] for r in MD.feature_importance(model, names, spark).collect()}
    counts = {(r["split"], r["label"]): r["students"] for r in SP.class_counts(assigned).collect()}

    def rows(split):
        return sum(v for (s, _), v in counts.items() if s == split)

    def rate(split):
        n = rows(split)
        return counts.get((split, 1), 0) / n if n else float("nan")

    test_metrics = _metrics_row(hold, "score")
    test_profit = int(test_summ[out_t]["profit"]) if out_t in test_summ else None
    config = {
        "model_version": "spark_gbt_calibrated_v3",
        "trained_at": datetime.now().strftime("%Y-%m-%d %H:%M"),
        "random_state": cfg.seed,
        "test_size": S.TEST_SIZE,
        "calibration_size": S.CALIBRATION_SIZE,
        "cv_folds": cfg.cv_folds,
        "calibration_method": "isotonic_regression",
        "high_precision_target": cfg.min_precision,
        "high_threshold": high_t,
        "outreach_threshold": out_t,
        "hot_threshold": high_t,
        "warm_threshold": out_t,
        "high_threshold_summary": policy["high"],
        "outreach_threshold_summary": policy["outreach"],
        "test_high_threshold_summary": test_summ.get(high_t),
        "test_outreach_threshold_summary": test_summ.get(out_t),
        "expected_value_threshold": TH.break_even_rate(),
        "course_price_inr": S.COURSE_PRICE_INR,
        "call_cost_inr": S.CALL_COST_INR,
        "train_rows": rows("train"),
        "calibration_rows": rows("calibration"),
        "test_rows": rows("holdout"),
        "train_positive_rate": rate("train"),
        "calibration_positive_rate": rate("calibration"),
        "test_positive_rate": rate("holdout"),
        "scale_pos_weight": spw,
        "cat_cols": enc.cat_cols,
        "num_cols": enc.num_cols,
        "raw_feature_columns": S.raw_feature_columns(raw.columns),
        "model_input_columns": cols,
        "dropped_training_columns": dropped,
        "feature_names": names,
        "top_features": top,
        "candidate_results": cv_results,
        "selected_candidate": {"name": best["name"], "params": best["params"], "mean_metrics": mean_of[best["name"]]},
        "trees_fitted": int(model.getNumTrees),
        "tree_share": cfg.tree_share,
        "raw_test_metrics": _metrics_row(hold, "raw_score"),
        "calibration_metrics": _metrics_row(cal, "score"),
        "test_metrics": test_metrics,
        "test_roc_auc": test_metrics["roc_auc"],
        "average_precision": test_metrics["average_precision"],
        "pr_auc": test_metrics["pr_auc"],
        "brier_score": test_metrics["brier_score"],
        "validation_profit_inr": int(policy["outreach"]["profit"]),
        "test_profit_inr": test_profit,
        "max_profit_inr": test_profit,
        "top10_lift": lifts[0.1]["lift"],
        "top10_capture": lifts[0.1]["buyers_captured"],
        "top20_lift": lifts[0.2]["lift"],
        "top20_capture": lifts[0.2]["buyers_captured"],
        "warnings": warnings,
    }
    return Artifacts(enc, model, calibrator, config, saved_ids, scored, cv_scores)


# ---------------------------------------------------------------------------
# artifacts
# ---------------------------------------------------------------------------

def save(art: Artifacts, path: str) -> None:
    """Encoder and config as one JSON row; trees and calibrator by their own writers; codes and ids as Parquet."""
    spark = art.saved_ids.sparkSession
    meta = spark.createDataFrame([(art.encoder.to_json(), json.dumps(art.config, default=float))], "encoder string, config string")
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    art.model.write().overwrite().save(f"{path}/trees")
    art.calibrator.write().overwrite().save(f"{path}/calibrator")
    art.encoder.codes.write.mode("overwrite").parquet(f"{path}/codes")
    save_split_ids(art.saved_ids, f"{path}/split_ids")


def load(spark: SparkSession, path: str) -> Artifacts:
    """Read back what ``save`` wrote."""
    meta = spark.read.parquet(f"{path}/meta").first()
    return Artifacts(
        encoder=LeadEncoderModel.from_json(meta["encoder"], spark.read.schema(CODES_SCHEMA).parquet(f"{path}/codes")),
        model=GBTClassificationModel.load(f"{path}/trees"),
        calibrator=IsotonicRegressionModel.load(f"{path}/calibrator"),
        config=json.loads(meta["config"]),
        saved_ids=load_split_ids(spark, f"{path}/split_ids"),
    )


def score(df: DataFrame, art: Artifacts, extra: tuple[str, ...] = ()) -> DataFrame:
    """M7 on any frame with the raw student columns: id, label if present, ``extra`` columns, raw_score, score."""
    short_methods(df.sparkSession)
    eng = FE.engineer(df)
    cfg = art.config
    FE.model_inputs(eng, cfg["model_input_columns"], cfg["dropped_training_columns"])  # F13 check
    keep = [ID] + ([Y] if Y in eng.columns else []) + list(extra)
    return MD.score_with(art.encoder.transform(eng, keep=keep), art.model, art.calibrator, keep)


def holdout_bundle(raw: DataFrame, art: Artifacts) -> DataFrame:
    """The saved holdout rows in saved order, scored: position, id, label, raw_score, score."""
    ids = art.saved_ids.where(F.col("split") == "holdout")
    return score(SP.select_ids(raw, ids), art, ("position",)).orderBy("position")


def score_batch(spark: SparkSession, raw: DataFrame, art: Artifacts, out_path: str | None = None) -> DataFrame:
    """Validate (no target), score, tier by threshold, top signal, course; optional CSV.

    The sheet's inputs travel through the scoring pass, so the upload is
    engineered and read once.
    """
    required = [ID, *art.config.get("raw_feature_columns", [])]
    missing = S.missing_columns(raw.columns, required)
    if missing:
        raise ValueError("Upload is missing required columns: " + ", ".join(missing[:15]))
    VA.require_valid(raw, required, False, "Upload")
    high, out = art.config["high_threshold"], art.config["outreach_threshold"]
    sheet = score(raw, art, tuple(SHEET_INPUTS)).select(
        F.col(ID).cast("string").alias("student_id"),
        probability_pct(F.col("score")).alias("purchase_probability"),
        tier_by_threshold(F.col("score"), high, out).alias("tier"),
        top_signal().alias("top_signal"),
        F.col("course_interest"),
        F.col("score").alias("_score"),
    ).orderBy(F.col("_score").desc(), F.col("student_id")).drop("_score")
    if out_path:
        write_csv(sheet, out_path)
    return sheet

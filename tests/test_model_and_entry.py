"""Model invariants, artifact round trip, and the driver contract."""

import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from propensia import schema as S


@pytest.fixture(scope="module")
def trained(spark):
    from propensia.plans.training import TrainConfig, train
    from propensia.sources.tables import leads

    raw = leads(spark, SF001)
    small = [{"name": c["name"], "params": {**c["params"], "n_estimators": 8, "max_depth": 3}} for c in S.MODEL_CANDIDATES[:2]]
    return raw, train(spark, raw, TrainConfig(candidates=small))


def test_scores_in_unit_interval_and_splits(trained):
    raw, art = trained
    sc = art.scored
    assert sc.count() == raw.count()
    mn, mx = sc.agg(F.min("score"), F.max("score")).first()
    assert 0.0 <= mn <= mx <= 1.0
    c = art.config
    assert c["train_rows"] + c["calibration_rows"] + c["test_rows"] == raw.count()
    assert len(c["candidate_results"]) == 2 and all(len(r["fold_metrics"]) == 3 for r in c["candidate_results"])
    assert c["trees_fitted"] == 8 and c["selected_candidate"]["params"]["n_estimators"] == 8
    assert {"raw_test_metrics", "calibration_metrics", "hot_threshold", "warm_threshold", "max_profit_inr"} <= set(c)
    assert c["high_threshold"] >= c["outreach_threshold"]
    assert len(c["top_features"]) <= 15


def test_calibration_is_monotone(trained):
    _, art = trained
    rows = art.scored.select("raw_score", "score").orderBy("raw_score").collect()
    scores = [r["score"] for r in rows]
    assert all(a <= b + 1e-12 for a, b in zip(scores, scores[1:]))


def test_save_load_same_scores(spark, trained):
    from propensia.plans.training import holdout_bundle, load, save, score

    raw, art = trained
    d = tempfile.mkdtemp(prefix="art-", dir="/tmp")
    save(art, d)
    art2 = load(spark, d)
    ids = [r["student_id"] for r in holdout_bundle(raw, art2).collect()]
    saved = art.saved_ids.where("split = 'holdout'").orderBy("position").collect()
    assert ids == [r["student_id"] for r in saved] and [r["position"] for r in saved] == list(range(len(ids)))
    a = {r["student_id"]: r["score"] for r in score(raw, art).collect()}
    b = {r["student_id"]: r["score"] for r in score(raw, art2).collect()}
    assert a == b


def test_score_batch_rejects_bad_upload(spark, trained):
    from propensia.plans.training import score_batch

    raw, art = trained
    with pytest.raises(ValueError):
        score_batch(spark, raw.drop("session_depth"), art)
    bad = raw.withColumn("coupon_code_applied", F.lit(7))
    with pytest.raises(ValueError):
        score_batch(spark, bad, art)
    out = score_batch(spark, raw.drop("purchased_paid_course"), art)
    assert out.count() == raw.count()


def test_entry_contract(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() >= 0
    assert df.columns == ["student_id", "purchase_probability", "tier", "top_signal", "course_interest",
                          "days_since_login"]
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    core = {n for n in q if n != "pipeline" and not n.startswith("op")}
    assert core - set(o) == {"model_holdout_report", "top_drivers"}


def test_upload_stream_scores_valid_and_rejects_invalid(spark, trained):
    import os
    import time

    from propensia.streaming.uploads import start

    raw, art = trained
    base = tempfile.mkdtemp(prefix="stream-", dir="/tmp")
    inbox = os.path.join(base, "inbox")
    os.makedirs(inbox)
    pdf = raw.drop("purchased_paid_course").toPandas()
    pdf.to_csv(os.path.join(inbox, "upload_1.csv"), index=False)
    time.sleep(1.1)
    bad = pdf.copy()
    bad["coupon_code_applied"] = 7
    bad.to_csv(os.path.join(inbox, "upload_2.csv"), index=False)
    time.sleep(1.1)
    pdf[list(pdf.columns)[::-1]].to_csv(os.path.join(inbox, "upload_3.csv"), index=False)       # another column order
    time.sleep(1.1)
    pdf.drop(columns=["session_depth"]).to_csv(os.path.join(inbox, "upload_4.csv"), index=False)
    q = start(spark, inbox, os.path.join(base, "out"), os.path.join(base, "ckpt"), art)
    q.awaitTermination(300)
    scored = spark.read.option("header", True).csv(os.path.join(base, "out", "scored"))
    assert scored.count() == 2 * len(pdf)
    sheets = scored.drop("batch_id").dropDuplicates()
    assert sheets.count() == len(pdf)       # the column order of an upload changes nothing
    rejected = spark.read.json(os.path.join(base, "out", "rejected")).collect()
    assert any("coupon_code_applied" in r["message"] for r in rejected)
    assert any(r["message"] == "Missing required columns: session_depth" for r in rejected)


def test_path_contributions_add_up_to_margin(spark, trained):
    import math

    from propensia.operators import gbt
    from propensia.operators.explain import path_contributions, top_drivers
    from propensia.operators.features import engineer

    raw, art = trained
    enc = art.encoder.transform(engineer(raw), keep=["student_id"])
    contrib = path_contributions(enc, gbt.flat_trees(art.model, spark), "student_id")
    rows = {r["student_id"]: r for r in contrib.collect()}
    probs = {r["student_id"]: r["raw_score"] for r in gbt.raw_scores(enc, art.model, ["student_id"]).collect()}
    for sid, r in rows.items():
        assert r["base"] + sum(r["contributions"]) == pytest.approx(r["margin"], abs=1e-9)
        assert 1 / (1 + math.exp(-r["margin"])) == pytest.approx(probs[sid], abs=1e-9)
    top = top_drivers(contrib, art.encoder.feature_names(), "student_id", k=10).collect()
    per = {}
    for t in top:
        per.setdefault(t["student_id"], []).append(t)
    for sid, ts in per.items():
        assert len(ts) == 10
        ranked = sorted(ts, key=lambda t: t["driver_rank"])
        assert all(a["abs_contribution"] >= b["abs_contribution"] for a, b in zip(ranked, ranked[1:]))
        best = max(abs(v) for v in rows[sid]["contributions"])
        assert ranked[0]["abs_contribution"] == pytest.approx(best)


def test_trees_learn_and_scale_their_number(spark):
    import random

    from pyspark.ml.linalg import Vectors

    from propensia.operators import gbt

    rng = random.Random(0)
    rows = []
    for _ in range(800):
        x = [rng.gauss(0, 1) for _ in range(5)] + [1.0]
        rows.append((Vectors.dense(x), float((x[0] > 0) != (x[1] > 0.5)), 1.0))
    df = spark.createDataFrame(rows, ["features", "label", "weight"]).repartition(3).persist()
    params = {**S.MODEL_CANDIDATES[0]["params"], "n_estimators": 400}
    est = gbt.classifier(params, 0.05)
    assert (est.getMaxIter(), round(est.getStepSize(), 9)) == (20, 0.6) and gbt.n_trees(params) == 400
    assert gbt.classifier(params).getStepSize() == pytest.approx(0.03)
    model = est.fit(df)
    scored = gbt.raw_scores(df, model, ["label"]).collect()
    assert sum((r["raw_score"] > 0.5) == (r["label"] > 0) for r in scored) > 0.9 * len(rows)
    trees = gbt.flat_trees(model, spark)
    assert len(trees["starts"]) == 20 and not (trees["feature"] == 5).any()      # a constant column is never split
    df.unpersist()


def test_fits_run_side_by_side_and_are_tried_again(spark):
    import threading
    import time

    from propensia.operators.gbt import fit_all

    lock, running, most, calls = threading.Lock(), [0], [0], []

    def fit(key, fails):
        def run():
            with lock:
                running[0] += 1
                most[0] = max(most[0], running[0])
                calls.append(key)
                bad = calls.count(key) <= fails
            time.sleep(0.2)
            n = spark.range(key).count()
            pool = spark.sparkContext.getLocalProperty("spark.scheduler.pool")
            with lock:
                running[0] -= 1
            if bad:
                raise RuntimeError(f"lost {key}")
            return n, pool
        return run

    got = fit_all(spark, {k: fit(k, 2 if k == 3 else 0) for k in range(6)}, in_flight=3, attempts=3)
    assert got == {k: (k, f"fit-{k}") for k in range(6)}
    assert 2 <= most[0] <= 3 and calls.count(3) == 3 and calls.count(4) == 1
    with pytest.raises(RuntimeError, match="lost 1"):
        fit_all(spark, {0: fit(0, 0), 1: fit(1, 9)}, in_flight=2, attempts=2)


def test_wide_rows_run_compiled(spark):
    from propensia.sources.tables import leads

    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    leads(spark, SF001)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) == 8000
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "5000")
    leads(spark, SF001)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) == 5000        # a lower one stays
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")


def test_students_are_derived_once_for_training_and_scoring(spark, monkeypatch):
    from propensia.plans import catalog, training

    monkeypatch.setattr(training, "train", lambda spark, raw, cfg: raw)
    read, leads = catalog._trained(spark, SF001, choose=False)
    assert read is leads and "Join" not in leads._jdf.queryExecution().logical().toString()
    assert leads.dtypes == catalog.TB.leads(spark, SF001).dtypes


@pytest.fixture
def fits(monkeypatch):
    """Three small candidates in place of the real ones, and the (trees, rate) of every fit."""
    from propensia.operators import gbt

    small = [{"name": f"c{n}", "params": {**S.MODEL_CANDIDATES[0]["params"], "n_estimators": n, "max_depth": 2, "learning_rate": 0.1}}
             for n in (6, 7, 8)]
    monkeypatch.setattr(S, "MODEL_CANDIDATES", small)
    made, classifier = [], gbt.classifier

    def recorded(*args, **kwargs):
        est = classifier(*args, **kwargs)
        made.append((est.getMaxIter(), round(est.getStepSize(), 9)))
        return est

    monkeypatch.setattr(gbt, "classifier", recorded)
    return made


def test_holdout_report_grows_all_trees(spark, fits):
    from propensia.plans import catalog

    row = catalog.q_model_holdout_report(spark, SF001).first()
    grid = [(6, 0.1), (7, 0.1), (8, 0.1)]
    assert sorted(fits[:-1]) == sorted(grid * S.CV_FOLDS) and fits[-1] in grid
    assert row["trees_fitted"] == fits[-1][0] == int(row["selected"][1:])


def test_invariants_hold_for_all_trees(spark, fits):
    from propensia.plans import catalog

    rows = {r["check"]: (r["expected"], r["actual"]) for r in catalog.q_model_invariants(spark, SF001).collect()}
    assert len(rows) == 9 and all(expected == actual for expected, actual in rows.values()), rows
    assert sorted(fits[:-1]) == sorted([(6, 0.1), (7, 0.1), (8, 0.1)] * S.CV_FOLDS) and fits[-1] in fits[:-1]


def test_drivers_explain_the_chosen_candidate(spark, fits):
    from propensia.plans import catalog

    rows = catalog.q_top_drivers(spark, SF001).groupBy("student_id").count().collect()
    assert len(rows) == catalog.TB.leads(spark, SF001).count() and {r["count"] for r in rows} == {10}
    assert sorted(fits[:-1]) == sorted([(6, 0.1), (7, 0.1), (8, 0.1)] * S.CV_FOLDS) and fits[-1] in fits[:-1]


def test_validation_scores_are_written_model_by_model(trained):
    _, art = trained
    assert art.cv_scores._jdf.queryExecution().analyzed().collectLeaves().size() == 2 * S.CV_FOLDS

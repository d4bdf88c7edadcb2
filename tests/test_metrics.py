"""Metrics against brute-force definitions (ties, tiny inputs, one class)."""

import random

import pytest

from propensia.operators.metrics import (
    calibration_bins,
    confusion,
    pr_points,
    ranking_metrics,
    roc_points,
    threshold_summary,
)


def data(n, seed, grid=20):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        y = int(rnd.random() < 0.35)
        s = min(1.0, round((0.4 * rnd.random() + 0.5 * y) * grid) / grid)
        rows.append((f"r{i}", s, y))
    return rows


def brute(rows):
    pos = [s for _, s, y in rows if y == 1]
    neg = [s for _, s, y in rows if y == 0]
    auc = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    thr = sorted({s for _, s, _ in rows}, reverse=True)
    P = len(pos)
    ap, pr, prev_r, prev_p = 0.0, 0.0, 0.0, 1.0
    for t in thr:
        tp = sum(1 for _, s, y in rows if s >= t and y == 1)
        fp = sum(1 for _, s, y in rows if s >= t and y == 0)
        prec, rec = tp / (tp + fp), tp / P
        ap += (rec - prev_r) * prec
        pr += (rec - prev_r) * (prec + prev_p) / 2
        prev_r, prev_p = rec, prec
    brier = sum((s - y) ** 2 for _, s, y in rows) / len(rows)
    return auc, ap, pr, brier


@pytest.mark.parametrize("n,seed", [(6, 1), (40, 2), (400, 3)])
def test_ranking_metrics(spark, n, seed):
    rows = data(n, seed)
    df = spark.createDataFrame(rows, "k string, s double, y int")
    r = ranking_metrics(df, "s", "y", num_partitions=3).first()
    auc, ap, pr, brier = brute(rows)
    assert r["roc_auc"] == pytest.approx(auc, abs=1e-6)
    assert r["average_precision"] == pytest.approx(ap, abs=1e-6)
    assert r["pr_auc"] == pytest.approx(pr, abs=1e-6)
    assert r["brier_score"] == pytest.approx(brier, abs=1e-6)


def test_one_class_gives_null_auc(spark):
    df = spark.createDataFrame([("a", 0.2, 0), ("b", 0.4, 0)], "k string, s double, y int")
    r = ranking_metrics(df, "s", "y").first()
    assert r["roc_auc"] is None and r["average_precision"] is None


def test_roc_points_drop_repeated_increments(spark):
    # increments per distinct score (desc): (pos, neg) = (1,0), (1,0), (0,1), (0,1)
    rows = [("a", 0.9, 1), ("b", 0.8, 1), ("c", 0.7, 0), ("d", 0.6, 0)]
    df = spark.createDataFrame(rows, "k string, s double, y int")
    pts = sorted((r["point"], r["fpr"], r["tpr"]) for r in roc_points(df, "s", "y").collect())
    # origin, first, (second dropped: same increment as third? no: kept where next differs), last
    assert pts[0] == (0, 0.0, 0.0)
    assert pts[-1][1:] == (1.0, 1.0)
    assert (2, 0.0, 1.0) in pts and (1, 0.0, 0.5) in pts and (3, 0.5, 1.0) not in pts


def test_pr_points_end_and_values(spark):
    rows = data(30, 5)
    df = spark.createDataFrame(rows, "k string, s double, y int")
    pts = sorted(pr_points(df, "s", "y").collect(), key=lambda r: r["point"])
    assert (pts[-1]["precision"], pts[-1]["recall"], pts[-1]["threshold"]) == (1.0, 0.0, None)
    P = sum(y for *_, y in rows)
    for r in pts[:-1]:
        tp = sum(1 for _, s, y in rows if s >= r["threshold"] and y == 1)
        fp = sum(1 for _, s, y in rows if s >= r["threshold"] and y == 0)
        assert r["precision"] == pytest.approx(tp / (tp + fp), abs=1e-6)
        assert r["recall"] == pytest.approx(tp / P, abs=1e-6)


def test_calibration_bins_right_closed_edges(spark):
    # scores exactly on the edges go to the lower bin (right-closed)
    rows = [("a", 0.1, 0), ("b", 0.30000000000000004, 1), ("c", 0.6000000000000001, 1), ("d", 0.3, 0),
            ("e", 1.0, 1), ("f", 0.0, 0)]
    df = spark.createDataFrame(rows, "k string, s double, y int")
    got = {r["bin"]: r["students"] for r in calibration_bins(df, "s", "y").collect()}
    assert got == {0: 2, 2: 2, 5: 1, 9: 1}


def test_confusion_and_summary(spark):
    rows = data(50, 9)
    df = spark.createDataFrame(rows, "k string, s double, y int")
    cells = {(r["actual"], r["predicted"]): r["students"] for r in confusion(df, "s", "y", 0.5).collect()}
    assert sum(cells.values()) == 50 and len(cells) == 4
    tp = sum(1 for _, s, y in rows if s >= 0.5 and y == 1)
    fp = sum(1 for _, s, y in rows if s >= 0.5 and y == 0)
    P = sum(y for *_, y in rows)
    assert cells[(1, 1)] == tp
    r = threshold_summary(df, "s", "y", [0.5]).first()
    assert (r["true_positive"], r["false_positive"], r["false_negative"]) == (tp, fp, P - tp)
    assert r["profit"] == 4999 * tp - 150 * (tp + fp)
    assert r["precision"] == pytest.approx(tp / (tp + fp + 1e-9), abs=1e-6)

"""Threshold sweep and policy against a direct per-candidate loop."""

import random

import numpy as np
import pytest

from propensia import schema as S
from propensia.operators.thresholds import candidates, learn_policy, sweep


def reference_candidates(scores):
    grid = np.unique(np.round(np.asarray(scores), 4))
    return np.unique(np.clip(np.concatenate([grid, np.array(S.THRESHOLD_ANCHORS)]), 0.001, 0.999))


def summarize(y, s, t):
    pred = s >= t
    tp = int((pred & (y == 1)).sum())
    fp = int((pred & (y == 0)).sum())
    fn = int(((~pred) & (y == 1)).sum())
    return {"threshold": float(t), "precision": tp / (tp + fp + 1e-9), "recall": tp / (tp + fn + 1e-9),
            "profit": 4999 * tp - 150 * (tp + fp), "true_positive": tp, "false_positive": fp}


def adversarial_scores(n, seed):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        k = rnd.randint(0, 10000)
        base = k / 10000
        out.append(rnd.choice([base, np.nextafter(base, 0), np.nextafter(base, 1), base + 0.00005,
                               150 / 4999, np.nextafter(150 / 4999, 0), rnd.random()]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_sweep_matches_direct_loop(spark, seed):
    s = np.clip(np.array(adversarial_scores(600, seed), dtype=float), 0, 1)
    rnd = random.Random(seed)
    y = np.array([int(rnd.random() < 0.3) for _ in s])
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "s double, y int")
    cand = sorted(r["threshold"] for r in candidates(df, "s").collect())
    assert cand == reference_candidates(s).tolist()
    got = {r["threshold"]: r for r in sweep(df, "s", "y").collect()}
    for t in cand:
        e = summarize(y, s, t)
        g = got[t]
        assert (g["true_positive"], g["false_positive"], g["profit"]) == (
            e["true_positive"], e["false_positive"], e["profit"])


def reference_policy(y, s):
    cands = [summarize(y, s, float(t)) for t in reference_candidates(s)]
    best = None
    for c in cands:
        if best is None or (c["profit"], c["precision"], c["recall"]) > (best["profit"], best["precision"], best["recall"]):
            best = c
    valid = [c for c in cands if c["true_positive"] > 0 and c["precision"] >= 0.8]
    if valid:
        high = max(valid, key=lambda c: (c["recall"], c["precision"]))
    else:
        high = max(cands, key=lambda c: ((1.25 * c["precision"] * c["recall"]) /
                                         (0.25 * c["precision"] + c["recall"] + 1e-9), c["precision"]))
    if high["threshold"] < best["threshold"]:
        high = best
    return best["threshold"], high["threshold"]


@pytest.mark.parametrize("seed,signal", [(3, 0.5), (4, 0.0), (5, 0.9)])
def test_policy_matches_reference_loops(spark, seed, signal):
    rnd = random.Random(seed)
    y = np.array([int(rnd.random() < 0.3) for _ in range(300)])
    s = np.array([min(1.0, round(0.5 * rnd.random() + signal * v, 3)) for v in y])
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "s double, y int")
    pol = {r["policy"]: r["threshold"] for r in learn_policy(df, "s", "y").collect()}
    out_t, high_t = reference_policy(y, s)
    assert pol["outreach"] == out_t
    assert pol["high"] == high_t

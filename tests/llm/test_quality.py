"""Quality rules and the quality classifier."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from propensia.llm import quality_classifier as qc
from propensia.llm import quality_rules as qr
from propensia.llm.queries import op10_quality_classifier

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(zip(w, w[1:], w[2:]))
    again = {i + k for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))


def test_measures_equal_brute_force(spark):
    rnd = random.Random(1)
    texts = [None, "", " \n\x0b", "one", "a b", "a b c", "a b c a b c", "#$ | <é>&", "x\nx\n x\n\n \nx", "a  b", "the " * 5000]
    texts += [" ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 30))) + rnd.choice(["", "\n", "\r\n a b c"]) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS n_words", "2 AS `a.b`")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in qr.apply_rules(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    assert qr.apply_rules(df.limit(0)).count() == 0


def test_threshold_table_is_compiled_without_python(spark, capsys):
    rules = (qr.Rule("few", "n_words", high=2), qr.Rule("symbols", "symbol_ratio", low=0.1))
    df = spark.createDataFrame([(1, "a #"), (2, "a b c"), (2, None)], "doc_id long, text string")
    out = qr.apply_rules(df, rules)
    assert {(r.doc_id, r.pass_few, r.pass_symbols, r.kept) for r in out.collect()} == {
        (1, True, True, False), (2, False, False, False), (2, True, False, False)}
    out.explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_clean_documents_pass_and_junk_fails(spark):
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    judged = qr.apply_rules(docs).join(labels, "doc_id").where("NOT base_failed").selectExpr("quality", "CAST(kept AS INT) AS k")
    means = {r.quality: r.m for r in judged.groupBy("quality").agg({"k": "avg"}).toDF("quality", "m").collect()}
    assert means[1] > 0.97 and means[0] < 0.5


@pytest.mark.parametrize("values", [[1.0], [2.0] * 9, [0.1 * k for k in range(50)], [1.0, np.nextafter(1.0, 2), 2.0, 2.0, -5.0], [-1e300, 0.0, 1e300, 1e-300]])
def test_kth_largest(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    for k in range(1, len(values) + 1):
        assert qc.kth_largest(df, "x", k) == sorted(values, reverse=True)[k - 1]
    assert qc.kth_largest(df.limit(0), "x", 3) is None


def test_counts_and_weights_equal_a_plain_version(spark):
    docs, labels = (spark.read.parquet(f"{SF001}/{t}.parquet") for t in ("documents", "labels"))
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    raw, target = np.zeros(qc.BUCKETS), np.zeros(qc.BUCKETS)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for i, t in texts.items():
        counts = np.bincount(qc.buckets(t), minlength=qc.BUCKETS)
        raw += counts
        target += counts * (i in good)
    ratios = qc.log_ratios(target, raw)
    rows = op10_quality_classifier(spark, SF001).collect()
    assert len(rows) == len(texts)
    assert all(abs(r.log_weight - ratios[qc.buckets(texts[r.doc_id])].sum()) < 1e-6 for r in rows)
    share = sum(r.quality == 1 for r in labels.collect()) / labels.count() + qc.SLACK
    k = int(np.ceil(share * len(rows)))
    cut = sorted((r.sample_key for r in rows), reverse=True)[k - 1]
    assert all(r.kept == (r.sample_key >= cut) for r in rows)


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    held = labels.where("doc_id % 2 = 1")
    scored = qc.score(docs, labels.where("doc_id % 2 = 0")).join(held, "doc_id").collect()
    good, bad = ([r.kept for r in scored if r.quality == q] for q in (1, 0))
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.5


def test_noise_has_the_gumbel_distribution(spark):
    g = np.array([r[0] for r in spark.range(4000).select(qc._gumbel(3, qc.F.col("id"))).collect()])
    assert abs(g.mean() - 0.5772) < 0.08 and abs(g.std() - 1.2825) < 0.08


def test_defined_cases(spark):
    rows = [(1, "good text here"), (1, "good text here"), (2, None), (3, ""), (None, "junk *** junk"), (4, "a " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS _weight", "'x' AS `_key`", "2 AS `a.b`", "3 AS good")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = {(r.doc_id, r.log_weight, r.kept) for r in qc.score(docs, labels).collect()}
    assert {w for i, w, _ in out if i in (2, 3)} == {0.0} and len([1 for i, *_ in out if i == 1]) == 1
    everything = qc.select_documents(docs, labels.limit(0))
    assert everything.columns == docs.columns and everything.count() == len(rows)
    assert qc.select_documents(docs.limit(0), labels).count() == 0

"""Toxicity and source mixing."""

import itertools
import re
import warnings
import zlib

import numpy as np
import pytest
import xxhash

from propensia.llm import mixing, toxicity
from propensia.llm.queries import op1_source_mixing, op3_toxicity

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def brute_kernel(s, t, n=3, decay=toxicity.DECAY):
    total = 0.0
    for a in itertools.combinations(range(len(s)), n):
        for b in itertools.combinations(range(len(t)), n):
            if all(s[i] == t[j] for i, j in zip(a, b)):
                total += decay ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
    return total


def test_kernel_equals_brute_force():
    words = ["idiot", "id.iot", "idxiot", "abc", "aabbcc", "zzz", "ab", "trash", "thrash"]
    for a in words:
        for b in words:
            got = toxicity.subsequence_kernel(toxicity._codes([a]), toxicity._codes([b, "padpadpad"])[:1])[0]
            assert got == pytest.approx(brute_kernel(a, b), abs=1e-4)


def test_screened_kernel_equals_the_full_one_where_pairs_are_shared():
    marks = toxicity.Landmarks(["idiot", "trash", "scum"])
    table = marks.matrix(["idiot", "idxiot", "thrash", "table", "scuum", ""])
    assert np.allclose(np.diag(marks.matrix(["idiot", "trash", "scum"])), 1, atol=1e-5)
    want = brute_kernel("idxiot", "idiot") / np.sqrt(brute_kernel("idxiot", "idxiot") * brute_kernel("idiot", "idiot"))
    assert table[1, 0] == pytest.approx(want, abs=1e-4)
    assert not table[3].any() and not table[5].any()


INSULTS = ["trash", "pathetic", "worthless", "idiot", "disgusting", "loser", "scum", "clown", "moron", "stupid"]


def test_no_kernel_value_is_screened_away():
    marks = toxicity.Landmarks(INSULTS + [d for w in INSULTS for d in toxicity.disguises(w)])
    missing = [w[:i] + w[i + 1:] for w in INSULTS for i in range(len(w))]
    replaced = [w[:i] + "z" + w[i + 1:] for w in INSULTS for i in range(len(w))]
    forms = missing + replaced + ["z" * 24, "ab", "", "naïveté", "worthlessworthlessworthle"]
    got = marks.matrix(forms)
    own, other = toxicity._codes(marks.strings), toxicity._codes(forms)
    norm = np.sqrt(np.maximum(toxicity.subsequence_kernel(other, other), 1e-30))
    for k, code in enumerate(own):
        want = toxicity.subsequence_kernel(other, np.repeat(code[None], len(forms), axis=0)) / norm
        assert np.allclose(got[:, k], want / np.sqrt(toxicity.subsequence_kernel(own[k:k + 1], own[k:k + 1])), atol=1e-4)
    model = toxicity.Model(marks.strings, np.ones(len(marks.strings)), -0.5)
    assert (model.string_scores(forms)[got.max(axis=1) >= toxicity.FLOOR] > -1).all()
    searched = toxicity.Landmarks(INSULTS)
    searched.number = None                              # as with too many letters for a table
    assert (searched.matrix(forms) == toxicity.Landmarks(INSULTS).matrix(forms)).all()


def test_weights_decide_on_gaps_of_two_characters():
    marks = INSULTS + [d for w in INSULTS for d in toxicity.disguises(w)]
    model = toxicity.Model(marks, np.ones(len(marks)), -0.5)
    gapped = [w[:i] + "qz" + w[i:] for w in INSULTS for i in range(1, len(w))]
    under = toxicity.Landmarks(marks).nearest(gapped) < toxicity.FLOOR
    assert under.any() and (model.string_scores(gapped) > -1).all()
    assert (toxicity.Model(marks, np.ones(len(marks)), -3.0).string_scores(["zzzz", "ab", ""]) == -1).all()


def test_strings_of_texts():
    assert toxicity.parts_of("pat.hetic!") == ["pat", "hetic", "pathetic"]
    assert toxicity.parts_of("i-d-i-o-t") == ["idiot"] and toxicity.parts_of("...") == []
    assert "idiot" in toxicity.words_of("You I D I O T now")
    long = "x" * 30 + "idiot" + "y" * 30
    assert any("idiot" in w for w in toxicity.parts_of(long)) and max(map(len, toxicity.parts_of(long))) <= toxicity.WINDOW


@pytest.fixture(scope="module")
def scored(spark):
    return {r.doc_id: r for r in op3_toxicity(spark, SF01).collect()}


def test_held_out_toxicity(spark, scored):
    labels = spark.read.parquet(f"{SF01}/labels.parquet").collect()
    assert len(scored) == spark.read.parquet(f"{SF01}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1
               for i, r in scored.items())
    held = [(scored[x.doc_id].score, x.toxic) for x in labels if scored[x.doc_id].held_out]
    pos, neg = (np.array([s for s, y in held if y == v]) for v in (1, 0))
    assert (pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean() > 0.75


def test_insults_with_gaps_and_insertions(spark):
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    clean = "the thing is on it and of that for was"
    for insult in ("idiot", "IDIOT!", "i.d.i.o.t", "i d i o t", "id-iot", "tr*ash", "w o r t h l e s s"):
        assert model.scores([f"{clean} {insult} {clean}"])[0] > model.scores([f"{clean} {clean}"])[0] + 0.2, insult


def test_any_inserted_character(spark):
    """Recall over all letters and digits, none of which the code names; the figures are in the README."""
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    clean = "the thing is on it and of that for was"
    words = ["idiot", "moron", "trash", "scum", "loser", "stupid", "worthless", "clown", "pathetic"]
    caught = lambda forms: np.mean(np.array(model.scores([f"{clean} {f} {clean}" for f in forms])) >= 0.5)
    assert caught(words) == 1.0
    by = {c: caught([w[:i] + c + w[i:] for w in words for i in range(1, len(w))]) for c in "abcdefghijklmnopqrstuvwxyz0123456789"}
    assert np.mean(list(by.values())) > 0.45 and min(by.values()) > 0.25      # not even: 0.33 to 0.84 by character
    drawn = {c for w in words for d in toxicity.disguises(w) for c in d if c not in w}
    assert len(drawn) > 20                               # many characters, not one


def test_toxicity_defined_cases(spark):
    docs = spark.createDataFrame([(1, "you idiot"), (2, "fine day today"), (3, None), (4, ""), (None, "idiot"), (2, "fine day today"),
                                  (6, "word " * 100_000), (7, "q" * 50_000)], "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS `a.b`")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(i, 1, i % 2) for i in range(50)] + [(None, None, None), (3, 1, None)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        model = toxicity.train(docs, labels)
        rows = toxicity.score(docs, model).collect()
        assert len(rows) == 8 and all(0 <= r.score <= 1 for r in rows)
        assert toxicity.score(docs.limit(0), model).count() == 0


def test_totals_match_the_targets_and_clean_documents_stay(spark, capsys):
    labels = mixing.label_domains(spark.read.parquet(f"{SF01}/labels.parquet"))
    out = op1_source_mixing(spark, SF01)
    out.explain()
    assert not {"Python", "Arrow"} & set(capsys.readouterr().out.replace("(", " ").split())
    rows = out.collect()
    assert all(r.rate >= 0 and abs(r.p_clean + r.p_toxic + r.p_junk - 1) < 1e-6 for r in rows)
    total = {d: sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in rows) for d in mixing.TARGETS}
    whole = sum(total.values())
    for d, w in mixing.TARGETS.items():
        assert total[d] / whole == pytest.approx(w, abs=0.004)
    truth = {r.doc_id: r.domain for r in labels.collect()}
    clean = [r for r in rows if truth.get(r.doc_id) == "clean"]
    assert np.mean([r.copies >= 1 for r in clean]) > 0.97
    assert np.mean([r.rate for r in rows if truth.get(r.doc_id) == "junk"]) < 0.6


def test_projected_steps_reach_feasible_targets_and_stay_nonnegative(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.3, 0.3, 0.3], 400)
    data = [(int(n), *map(float, x)) for n, x in zip(rng.integers(1, 500, 400), p)]
    df = spark.createDataFrame(data, "t long, a double, b double, c double")
    names = {"tokens": "t", "a": "a", "b": "b", "c": "c"}
    def reached(weights, n):
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", mixing.MixingResidual)
            steps, targets, miss = mixing.fit_rates(df, weights, "a", 1.0, names, steps=n)
        rates = [r[0] for r in df.select(mixing.rate_column(steps, names)).collect()]
        assert min(rates) >= 0
        got = {d: sum(r * x[0] * x[k] for r, x in zip(rates, data)) for k, d in enumerate("abc", 1)}
        assert max(abs(got[d] - t) / t for d, t in targets.items()) == pytest.approx(miss, abs=1e-9)
        return miss

    assert reached({"a": 0.5, "b": 0.4, "c": 0.1}, 40) < mixing.TOLERANCE
    # a share that soft members hardly allow: rates stay nonnegative, the residual falls below the tolerance all the same
    assert reached({"a": 0.5, "b": 0.49, "c": 0.01}, 30) < mixing.TOLERANCE < reached({"a": 0.5, "b": 0.49, "c": 0.01}, 2)


def test_small_shares_are_reached_at_production_settings(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.3, 0.3, 0.3], 400)
    data = [(int(n), *map(float, x)) for n, x in zip(rng.integers(1, 500, 400), p)]
    df = spark.createDataFrame(data, "t long, a double, b double, c double")
    names = {"tokens": "t", "a": "a", "b": "b", "c": "c"}

    def totals(frame, weights):
        steps, targets, _ = mixing.fit_rates(frame, weights, "a", 1.0, names)
        rows = frame.select("*", mixing.rate_column(steps, names).alias("r")).collect()
        assert all(r.r >= 0 for r in rows)
        return {d: sum(r.r * r.t * r[d] for r in rows) for d in targets}, targets

    for weights in ({"a": 0.5, "b": 0.49, "c": 0.01}, {"a": 0.95, "b": 0.04, "c": 0.01}, {"a": 0.5, "b": 0.5, "c": 0.0}):
        with warnings.catch_warnings():
            warnings.simplefilter("error", mixing.MixingResidual)
            got, targets = totals(df, weights)
        assert got == pytest.approx(targets, rel=0.05) and got == pytest.approx(targets, rel=2 * mixing.TOLERANCE)
    # equal posteriors allow one total only: reported, not passed over
    with pytest.warns(mixing.MixingResidual):
        got, _ = totals(df.selectExpr("t", "1 / 3D AS a", "1 / 3D AS b", "1 / 3D AS c"), {"a": 0.95, "b": 0.04, "c": 0.01})
    assert all(np.isfinite(x) for x in got.values())


def plain_posteriors(model, text, domains):
    """Posteriors of one text by numpy, from the model's few weights."""
    words = [w for w in re.split("[\\x20\\x09-\\x0D]+", text) if w]
    n = max(len(words), 1)
    shape = [f"\x00symbols{min(5 * sum(text.count(c) for c in '#*$%&|<>!') // n, 9)}",
             f"\x00distinct{min(10 * len(set(words)) // n, 9)}", f"\x00letters{min(len(''.join(words)) // n, 9)}"]
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    buckets = {}
    for i, w in enumerate([*dict.fromkeys(words), *shape]):
        buckets[i] = signed(xxhash.xxh64_intdigest(w.encode(), seed=42)) % mixing.BUCKETS
    prior, weights = model
    logit = np.array([prior[k] + sum(weights[k].get(b, 0.0) for b in buckets.values()) for k in range(len(domains))])
    e = np.exp(logit - logit.max())
    return e / e.sum(), len(words)


@pytest.mark.parametrize("path", [SF001, SF01])
def test_posteriors_and_rates_equal_a_plain_version(spark, path):
    docs = spark.read.parquet(f"{path}/documents.parquet")
    domains, names = mixing.label_domains(spark.read.parquet(f"{path}/labels.parquet")), list(mixing.TARGETS)
    model = mixing.fit_posteriors(docs, domains, names, "doc_id", "text")
    with warnings.catch_warnings():
        warnings.simplefilter("error", mixing.MixingResidual)
        rows = {r.doc_id: r for r in mixing.document_rates(docs, domains).collect()}
    assert all(r.miss <= mixing.TOLERANCE for r in rows.values())
    ids, p, n = [], [], []
    for d in docs.collect():
        post, count = plain_posteriors(model, d.text or "", names)
        assert [rows[d.doc_id][f"p_{k}"] for k in names] == pytest.approx(post.tolist(), rel=1e-4, abs=1e-9)
        assert rows[d.doc_id].n_tokens == count
        ids, p, n = [*ids, d.doc_id], [*p, post], [*n, count]
    p, n = np.array(p), np.array(n, float)
    mass = n @ p
    live = [k for k in range(len(names)) if mass[k] > 0]
    target = mass[0] * mixing.HEADROOM * np.array([mixing.TARGETS[names[k]] for k in live]) / mixing.TARGETS["clean"]
    rate, q = np.ones(len(n)), p[:, live]
    for _ in range(60):                                    # the same projected gradient in numpy
        gram = (q * (n * (rate > 0))[:, None]).T @ q
        rate = np.maximum(0, rate - q @ np.linalg.solve(gram + 1e-9 * np.diag(np.diag(gram)), (n * rate) @ q - target))
    assert [rows[i].rate for i in ids] == pytest.approx(rate.tolist(), rel=5e-3, abs=5e-3)


def test_mixing_defined_cases(spark):
    docs = spark.createDataFrame([(1, "good words here"), (1, "good words here"), (2, None), (3, ""), (None, "x"), (4, "word " * 100_000)],
                                 "doc_id long, text string").selectExpr("*", "1 AS _rate", "2 AS copies", "3 AS `a.b`", "'s' AS _copy")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, None), (3, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        domains = mixing.label_domains(some)
        with warnings.catch_warnings():
            warnings.simplefilter("error", mixing.MixingResidual)
            rates = mixing.document_rates(docs, domains).collect()
        assert len(rates) == 6 and all(r.rate >= 1 and r.p_clean == 1 for r in rates)     # too few labels to tell anything
        out = mixing.resample(docs, domains)
        assert out.columns == docs.columns and out.count() >= 1
        assert mixing.resample(docs.limit(0), domains).count() == 0
        assert mixing.document_rates(docs.limit(0), domains).count() == 0


def test_copies_have_the_rate_as_mean(spark):
    df = spark.range(4000).select(mixing.copies(mixing.F.lit(1.3), mixing.F.xxhash64("id")).alias("c"))
    got = [r.c for r in df.collect()]
    assert set(got) == {1, 2} and abs(np.mean(got) - 1.3) < 0.03

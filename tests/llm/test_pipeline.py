"""The pipeline against a plain version of each stage; registration."""

import hashlib

import public_tokenizers as P
import pytest

import __spark_entry__ as entry
import corpus_pipeline as cp
from propensia.llm import byte_bpe, exact_dedup, mixing, quality_classifier
from propensia.llm.common import table

from .test_dedup_warc import brute as brute_exact
from .test_simhash import brute_components, brute_fingerprint

SF001 = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = entry.queries()
    assert [n for n in range(1, 14) if not any(x.startswith(f"op{n}_") for x in names)] == []
    assert "pipeline" in names and [n for n, _ in cp.STAGES] == [
        "quality_classifier", "exact_dedup", "simhash_near_dedup", "source_mixing", "byte_bpe"]


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF001, "documents"), []
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, SF001).cache()
        out.append((name, docs))
    return out


def test_stages_equal_their_plain_versions(spark, stages):
    docs = table(spark, SF001, "documents")
    labels = table(spark, SF001, "labels")
    by = dict(stages)
    kept = {r.doc_id for r in quality_classifier.score(docs, labels).collect() if r.kept}
    rows = [(r.doc_id, r.text) for r in by["quality_classifier"].collect()]
    assert {i for i, _ in rows} == kept and by["quality_classifier"].columns == docs.columns

    stay = {i for (i, _), x in zip(rows, brute_exact(rows)) if x[2]}
    rows = [(r.doc_id, r.text) for r in by["exact_dedup"].collect()]
    assert {i for i, _ in rows} == stay and by["exact_dedup"].columns == docs.columns

    groups = brute_components({i: brute_fingerprint(t or "") for i, t in rows})
    rows = [(r.doc_id, r.text) for r in by["simhash_near_dedup"].collect()]
    assert sorted(i for i, _ in rows) == sorted(set(groups.values()))

    copies = {r.doc_id: r.copies for r in mixing.document_rates(
        by["simhash_near_dedup"], mixing.label_domains(labels)).collect()}
    mixed = [(r.doc_id, r.text) for r in by["source_mixing"].collect()]
    assert sorted(i for i, _ in mixed) == sorted(i for i, n in copies.items() for _ in range(n))

    c = byte_bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    want = sorted((i, len(ids), hashlib.sha256((t or "").encode()).hexdigest())
                  for i, t in mixed for ids in [c.encode(t or "")])
    assert sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in by["byte_bpe"].collect()) == want


def test_clean_documents_come_through(spark, stages):
    by = dict(stages)
    labels = table(spark, SF001, "labels").where("quality = 1 AND toxic = 0")
    docs = table(spark, SF001, "documents").join(labels, "doc_id", "left_semi")
    before = {r.doc_id for r in exact_dedup.classes(docs).collect() if r.kept}
    after = {r.doc_id for r in by["quality_classifier"].collect()}
    assert len(before & after) >= 0.95 * len(before)


def test_run_writes_every_stage(spark):
    out = cp.run(spark, SF001)
    assert set(out.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} and out.count() > 50


def odd_documents(spark, n=40):
    words = ["alpha beta gamma delta", "of the and to in that", "lorem ipsum dolor"]
    rows = [(i, f"{words[i % 3]} number {i} " * (3 + i % 5)) for i in range(n)]
    rows += [(100, None), (101, ""), (102, " \n"), (None, "a text without an id, of some words"), (103, "x"), (103, "x"),
             (104, rows[0][1]), (105, "very long text " * 40_000)]
    names = "doc_id long, text string"
    return spark.createDataFrame(rows, names).selectExpr(
        "*", "'s' AS source", "1 AS _row", "2 AS _key", "3 AS kept", "4 AS score", "5 AS rate", "6 AS `a.b`", "7 AS component_id")


def test_every_stage_on_odd_rows(spark):
    docs = odd_documents(spark)
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, SF001).cache()
        rows = out.collect()
        if k < len(cp.STAGES) - 1:
            assert out.columns == docs.columns, name
            assert {r.text for r in rows} <= {r.text for r in docs.collect()}
        elif rows:
            assert {r.decoded_sha256 for r in rows} == {hashlib.sha256((r.text or "").encode()).hexdigest() for r in docs.collect()}
        if name in ("exact_dedup", "simhash_near_dedup"):
            texts = ["".join((r.text or "").split()) for r in rows]
            assert len(texts) == len(set(texts))
        docs = odd_documents(spark) if name == "quality_classifier" else out      # later stages see odd rows, too


def test_every_stage_on_an_empty_table(spark):
    none = odd_documents(spark).where("doc_id < -1")
    for name, stage in cp.STAGES:
        assert stage(spark, none, SF001).count() == 0, name

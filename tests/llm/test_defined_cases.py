"""Defined cases that the operators' own tests leave open."""

import public_tokenizers as P
from pyspark.sql import functions as F

from propensia.llm import exact_dedup, simhash, token_counts, warc

WORDS = P.path("word_bpe_49k.json")


def clashing(df, names):
    return df.withColumns({n: F.lit(1) for n in names})


def test_token_counts_of_empty_tables_and_clashing_names(spark):
    rows = [(1, "two words"), (2, None), (3, ""), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    names = ("n_tokens", "n_bytes", "chunk", "Head", "tail", "state", "a.b")
    plain = sorted(map(str, token_counts.count_tokens(df, WORDS).collect()))
    assert sorted(map(str, token_counts.count_tokens(clashing(df, names), WORDS).collect())) == plain and len(plain) == 4
    assert token_counts.count_tokens(clashing(df.limit(0), names), WORDS).count() == 0


def test_simhash_components_of_odd_rows(spark):
    rows = [(5, None), (6, ""), (7, " \n"), (None, "a b c d e f"), (9, "a b c d e f"), (9, "a b c d e f"), (10, "word " * 60_000)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"), ("fp", "component", "Fingerprint", "file", "a.b"))
    got = {(r.doc_id, r.component_id) for r in simhash.components(df).collect()}
    assert got == {(5, 5), (6, 5), (7, 5), (None, 9), (9, 9), (10, 10)}
    assert simhash.components(df.limit(0)).count() == 0


def test_exact_dedup_of_very_long_texts(spark):
    long = "some long text " * 100_000
    rows = [(1, long), (2, long + " "), (3, long + "x"), (4, long)]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.classes(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (2, 3, False), 2: (2, 3, True), 3: (3, 1, True), 4: (2, 3, False)}


def test_warc_with_clashing_names(spark):
    rows = [(1, "u", "<p>x</p>"), (2, "v", "<p>x</p>"), (3, "w", None)]
    df = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"),
                  ("payload", "record_type", "_same", "offset", "Digest", "a.b"))
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.round_trip(df).collect()}
    assert got == {1: ("revisit", 2), 2: ("response", None), 3: ("response", None)}

"""The corpus pipeline: documents through five operators, each stage written and read again.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``, extra ones included, whatever their names.

Defined cases, the same in every stage: a null text counts as empty; empty
texts are equal to each other, so one of them at most is left; a very long text
is one document like any other, read whole; of repeated or tied rows the
operators' own rules keep one (the longest original, then the smallest id, then
the first row); a null doc_id is kept like any other row but loses ties; rows
without labels are judged by the models of the labelled ones; an empty table,
or one that a stage leaves empty, gives an empty result.

The tables between the stages stay in the shared folder until its owner clears
it: a lost driver can go on from the last whole one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from propensia.llm import byte_bpe, exact_dedup, mixing, quality_classifier, simhash
from propensia.llm.common import importable, table
from propensia.llm.queries import BYTE_RANKS
from propensia.session import shared_scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by importance resampling; the others go.  Each row is drawn by itself, repeated ones alike."""
    importable(spark)
    return quality_classifier.select_documents(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space, the row with the most characters (then the smallest doc_id) stays."""
    importable(spark)
    return exact_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component, the document with the smallest doc_id stays; empty texts are one component."""
    importable(spark)
    return simhash.dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say; clean ones stay at least once, the rest is thinned out.

    Equal rows come out equally often; a text without words changes no total.
    """
    return mixing.resample(docs, mixing.label_domains(table(spark, sf_dir, "labels")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, decoded again: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    importable(spark)
    path, pattern = public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN
    return byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(docs, path, pattern), path, pattern))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("source_mixing", mix),
    ("byte_bpe", encode),
]

#: XXH64, sampling noise and BPE are not SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    base = shared_scratch(spark, f"pipeline/{uuid.uuid4().hex}")
    for name, stage in STAGES:
        path = f"{base}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

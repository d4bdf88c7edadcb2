"""Registered queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    byte_bpe,
    exact_dedup,
    html_extract,
    mixing,
    prefix_trie,
    quality_classifier,
    quality_rules,
    simhash,
    token_counts,
    toxicity,
    va_file,
    warc,
    whitening,
)
from .common import importable, table

WORD_TOKENIZER = "word_bpe_49k.json"
BYTE_RANKS = "byte_bpe_50k.tiktoken"
MAX_TOKENS = 2048
SEARCH_EVERY, SEARCH_K = 50, 5


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    domains = mixing.label_domains(table(spark, sf_dir, "labels"))
    return mixing.document_rates(table(spark, sf_dir, "documents"), domains)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER))
    return counted.withColumn("over_limit", F.col("n_tokens") > MAX_TOKENS)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return simhash.components(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         "kept")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    path, pattern = public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"), path, pattern)
    return byte_bpe.digests(byte_bpe.decode(encoded, path, pattern))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return exact_dedup.classes(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    read = warc.round_trip(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return quality_classifier.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return va_file.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % SEARCH_EVERY == 0, k=SEARCH_K)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_source_mixing": op1_source_mixing,
    "op2_token_counts": op2_token_counts,
    "op3_toxicity": op3_toxicity,
    "op4_simhash": op4_simhash,
    "op5_html_extraction": op5_html_extraction,
    "op6_quality_rules": op6_quality_rules,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_warc": op9_warc,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_exact_topk": op11_exact_topk,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_whitening": op13_whitening,
}

OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls, text, doc_id FROM d),
pos AS (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS p FROM w WHERE len(ws) > 2),
tri AS (SELECT r, p, count(*) OVER (PARTITION BY r, ws[p], ws[p + 1], ws[p + 2]) AS n FROM pos),
rep AS (SELECT r, count(DISTINCT p + k) AS n FROM tri, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY r),
stop AS (SELECT [{stop}] AS s),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(length(list_aggregate(ws, 'string_agg', '')), 0)::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
             len(ls) AS n_lines, len(list_filter(ws, lambda x: list_contains(s, lower(x)))) AS n_stop
      FROM w LEFT JOIN rep USING (r), stop),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN 2.5 AND 12 AND n_symbols / n_words <= 0.1
       AND n_stop / n_words >= 0.02 AND (n_lines = 0 OR n_dup_lines / n_lines <= 0.4) AS kept
FROM b
""".replace("{stop}", ", ".join(f"'{w}'" for w in (
    "the of and to a in is that it for was on with as be by this are at from "
    "der die und den von zu das mit sich des auf für ist im dem nicht eine ein als "
    "de la le et les en un du une que pour est dans qui par au sur pas avec "
    "el y los se las del por con no su para al lo").split()))

OP8_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm,
                  row_number() OVER () AS r FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER g AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       r = first_value(r) OVER g AS kept,
       sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm ORDER BY chars DESC, doc_id NULLS LAST, r)
"""

OP9_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex,
             max(page_id) OVER (PARTITION BY html) AS first FROM p),
b AS (SELECT *, [('0x' || substr(hex, 5 * g + 1, 5))::BIGINT FOR g IN range(8)] AS v FROM s)
SELECT page_id, payload_bytes,
       list_aggregate(flatten([[substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> k) & 31)::INT + 1, 1)
                                FOR k IN [15, 10, 5, 0]] FOR x IN v]), 'string_agg', '') AS payload_digest,
       CASE WHEN first IS NOT NULL AND (page_id IS NULL OR page_id < first) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND (page_id IS NULL OR page_id < first) THEN first END AS refers_to
FROM b
"""

OP11_SQL = f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x
           FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.r AS q, a.vec_id AS query_id, b.r, b.vec_id,
             coalesce(list_sum(list_transform(list_zip(a.x, b.x), lambda z: z[1] * z[2])), 0)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % {SEARCH_EVERY} = 0 AND a.r <> b.r),
p AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id NULLS LAST, r)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM p WHERE rank <= {SEARCH_K}
"""

# CRC-32 is not a DuckDB function: ``bits`` runs its register over the bits of the decimal id.
OP12_SQL = """
WITH RECURSIVE
k AS (SELECT conv_id AS c, turn, sha256(length(r)::VARCHAR || ':' || r || x) AS k, length(x)::BIGINT AS n
      FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
t AS (SELECT c, k, n, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k) AS pos FROM k),
bits(c, s, i, crc) AS (
    SELECT DISTINCT c, c::VARCHAR, 0, 4294967295::BIGINT FROM t
    UNION ALL
    SELECT c, s, i + 1, CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END
    FROM (SELECT c, s, i, CASE WHEN i % 8 = 0 THEN xor(crc, ascii(substr(s, i // 8 + 1, 1))::BIGINT) ELSE crc END AS y
          FROM bits WHERE i < 8 * length(s))),
h AS (SELECT c, c - c % 100 AS base, xor(crc, 4294967295) % 6 AS h FROM bits WHERE i = 8 * length(s)),
rb AS (SELECT h.c, 0 AS own, b.pos, b.k, b.n FROM h JOIN t b ON b.c = h.base AND b.pos <= h.h
       UNION ALL SELECT t.c, 1, t.pos, t.k, t.n FROM t JOIN h ON t.c = h.c AND t.pos > h.h),
p AS (SELECT c, list(k ORDER BY own, pos) AS ks, list(n ORDER BY own, pos) AS ns FROM rb GROUP BY c),
u AS (SELECT h.c, coalesce(ks, []) AS ks, ns, unnest(range(0, coalesce(len(ks), 0) + 1)) AS d FROM h LEFT JOIN p ON p.c = h.c),
pre AS (SELECT c, d, array_to_string(ks[1:d], '/') AS s, CASE WHEN d = 0 THEN 0 ELSE ns[d] END AS n, d = len(ks) AS ends FROM u),
node AS (SELECT s, d, min(c) AS m, count(*) AS n_convs, any_value(n) AS n, list(c ORDER BY c) FILTER (WHERE ends) AS ended
         FROM pre GROUP BY s, d),
par AS (SELECT node.s, node.d, p.s AS ps FROM node JOIN pre p ON p.c = node.m AND p.d = node.d - 1),
kids AS (SELECT ps AS s, d - 1 AS d, count(*) AS n_children FROM par GROUP BY 1, 2),
sub AS (SELECT p.s, p.d, sum((x.n_convs - 1) * x.n)::BIGINT AS saved, count(*) FILTER (WHERE kids.n_children IS NULL) AS leaves
        FROM node x LEFT JOIN kids ON kids.s = x.s AND kids.d = x.d JOIN pre p ON p.c = x.m AND p.d <= x.d GROUP BY 1, 2)
SELECT node.m AS conv_id, node.d AS depth, up.m AS parent_conv_id, node.n_convs, coalesce(kids.n_children, 0) AS n_children,
       sub.leaves AS n_leaves, sub.saved AS saved_tokens, sha256(coalesce(array_to_string(node.ended, ','), '')) AS ends_sha256
FROM node JOIN sub ON sub.s = node.s AND sub.d = node.d
LEFT JOIN kids ON kids.s = node.s AND kids.d = node.d
LEFT JOIN par ON par.s = node.s AND par.d = node.d
LEFT JOIN node up ON up.s = par.ps AND up.d = node.d - 1
"""

ORACLES = {"op6_quality_rules": OP6_SQL, "op8_exact_dedup": OP8_SQL, "op9_warc": OP9_SQL,
           "op11_exact_topk": OP11_SQL, "op12_prefix_trie": OP12_SQL}

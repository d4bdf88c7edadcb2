"""Exact dedup against brute force; WARC round trips."""

import gzip
import io
import random
import zlib

import pytest

from propensia.llm import exact_dedup, warc

DELETE = str.maketrans("", "", " \t\n\x0b\x0c\r")


def brute(rows):
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault((t or "").translate(DELETE), []).append((-len(t or ""), i is None, i or 0, k))
    out = {}
    for norm, members in groups.items():
        best = min(members)
        for _, none, i, k in members:
            out[k] = (None if best[1] else best[2], len(members), k == best[3])
    return [out[k] for k in range(len(rows))]


def sample_rows(seed):
    rnd = random.Random(seed)
    texts = ["", None, " \n", "a", "a ", " a", "ab", "a b", " a", "é", "é", "x" * 3000, "x " * 3000, "\x1c", "\x1ca"]
    return [(rnd.choice([None, *range(40)]) if rnd.random() < 0.1 else 100 + k, rnd.choice(texts + [f"u{rnd.randint(0, 60)}"]))
            for k in range(300)]


@pytest.mark.parametrize("key_bits,bucket", [(64, 200_000), (64, 2), (3, 200_000), (2, 5), (0, 1)])
def test_classes_equal_brute_force(spark, key_bits, bucket):
    rows = sample_rows(key_bits + bucket)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = exact_dedup.classes(df, bucket_entries=bucket, key_bits=key_bits).collect()
    show = lambda i, t: (str(i), *t)
    want = sorted(show(i, (str(x[0]), x[1])) for (i, _), x in zip(rows, brute(rows)))
    assert sorted(show(r.doc_id, (str(r.keep_id), r.group_size)) for r in got) == want
    assert sum(r.kept for r in got) == sum(x[2] for x in brute(rows)) == len({r.text_sha256 for r in got})


def test_batches_that_split_a_group_meet_again(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(i, "same text" if i % 3 else f"own {i}") for i in range(200)]
        got = {r.doc_id: r for r in exact_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert {r.group_size for i, r in got.items() if i % 3} == {sum(bool(i % 3) for i in range(200))}
        assert {r.keep_id for i, r in got.items() if i % 3} == {1}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_directory_doubles_until_no_bucket_is_overfull(spark):
    keys = [random.Random(i).getrandbits(64) - (1 << 63) for i in range(500)] + list(range(40))
    df = spark.createDataFrame([(k, 2) for k in keys], "k long, n long")
    buckets = exact_dedup.directory(df, "k", bucket_entries=20)
    assert buckets[0][1] == 0 and buckets[-1][2] == 2**64 - 1
    assert all(a[2] + 1 == b[1] for a, b in zip(buckets, buckets[1:]))
    for depth, lo, hi in buckets:
        inside = [k for k in keys if lo <= k % 2**64 <= hi]
        assert 2 * len(inside) <= 20 or len(inside) == 1
    assert max(d for d, _, _ in buckets) > min(d for d, _, _ in buckets)


def test_dedup_keeps_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", 1, "p"), (2, "ab", 2, "q"), (3, None, 3, "r")], "doc_id long, text string, _row int, `a.key` string")
    out = exact_dedup.dedup(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect())) == [(1, "a b", 1, "p"), (3, None, 3, "r")]
    assert exact_dedup.dedup(df.limit(0)).count() == 0


PAGES = [(1, "http://a/?q=1 2\n3", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (3, "u", None), (4, "v", ""), (5, "w", "x" * 100_000),
         (6, "w", "\x1f\x8b\x08 WARC/1.1"), (None, "n", "<p>é</p>"), (7, "r", "".join(chr(random.Random(7).randint(32, 900)) for _ in range(30_000)))]


@pytest.mark.parametrize("range_bytes", [1, 7, 400, 1 << 24])
def test_round_trip_over_any_range_size(spark, range_bytes):
    pages = spark.createDataFrame(PAGES[:6] if range_bytes == 1 else PAGES, "page_id long, url string, html string").coalesce(2)
    got = warc.round_trip(pages, range_bytes=range_bytes).collect()
    rows = PAGES[:6] if range_bytes == 1 else PAGES
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = max(first.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        to = first.get(h or "")
        revisit = to is not None and (i is None or i < to)
        want.append((str(i), len((h or "").encode()), warc.sha1_base32((h or "").encode()), "revisit" if revisit else "response",
                     str(to if revisit else None)))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == sorted(want)
    assert {r.page_id: bytes(r.payload).decode() for r in got if r.payload is not None}[5] == "x" * 100_000


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in warc.round_trip(pages, min_revisit_bytes=3).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_false_magic_inside_members_is_passed_over():
    good = [warc._deflate(warc.record(i, "u", bytes([i]) * 50, None, False)) for i in range(5)]
    decoy = gzip.compress(b"not a record")
    noise = warc.MAGIC + b"\x00" * 20
    data = good[0] + good[1] + noise + decoy + good[2] + good[3] + good[4]

    class File(io.BytesIO):
        def read_at(self, n, at):
            self.seek(at)
            return self.read(n)

    starts = [0, len(good[0]) + len(good[1]) + len(noise) + len(decoy)]
    found = [o for o, _ in warc.scan_range(File(data), len(data), 0, len(data))]
    assert starts[1] in found and 0 in found and len(found) >= 4
    for step in (1, 13, 64):
        parts = [o for a in range(0, len(data), step) for o, _ in warc.scan_range(File(data), len(data), a, min(len(data), a + step))]
        assert parts == found
    assert zlib.decompress(data, 31).startswith(b"WARC/1.1")

"""SimHash: fingerprints, pigeonring and components against brute force."""

import random
import re
from itertools import combinations

import numpy as np
import xxhash

from propensia.llm import simhash
from propensia.llm.queries import op4_simhash

SF001 = "/root/testdata/sf0.001"


def brute_fingerprint(text: str) -> int:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps: dict[int, int], bits: int = 4) -> dict[int, int]:
    ids = sorted(fps)
    group = {i: i for i in ids}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in combinations(ids, 2):
        if bin(fps[a] ^ fps[b]).count("1") <= bits:
            x, y = find(a), find(b)
            group[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_fingerprint_is_the_contracts():
    for t in ["", " \n\t", "One", "one TWO three", "A b C d", "x\x1cy z\x1f w v", "É é ß ABC\x0bdef g h i", "a " * 500,
              "the quick brown fox jumps over the lazy dog " * 7, " nbsp separated words  are one"]:
        assert simhash.fingerprint(t.encode()) == brute_fingerprint(t), t


def test_pigeonring_never_loses_a_close_pair_and_prunes_far_ones():
    rnd = random.Random(1)
    for bits in range(0, 5):
        xor = np.array([sum(1 << b for b in rnd.sample(range(64), bits)) for _ in range(3000)], np.uint64)
        assert simhash.pigeonring(xor).all()
        masks = [m for _, m in simhash.triples()]
        assert all(any(int(x) & m == 0 for m in masks) for x in xor[:500])
    far = np.array([rnd.getrandbits(64) for _ in range(3000)], np.uint64)
    assert simhash.pigeonring(far).mean() < 0.01


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()
    fps = {r.doc_id: brute_fingerprint(r.text or "") for r in rows}
    want = brute_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op4_simhash(spark, SF001).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


def linked_set(n: int, seed: int) -> list[int]:
    """Fingerprints of a few dense clusters and chains."""
    rnd, out = random.Random(seed), []
    for _ in range(6):
        x = rnd.getrandbits(64)
        for _ in range(n):
            for b in rnd.sample(range(64), rnd.randint(1, 4)):
                x ^= 1 << b
            out.append(x)
    return out + [rnd.getrandbits(64) for _ in range(40)] + [0, 0, (1 << 64) - 1]


def test_links_of_small_and_overfull_files_give_the_same_components(spark):
    fps = linked_set(9, 3)
    nodes = {i: x for i, x in enumerate(fps)}
    want = brute_components(nodes)
    groups = {}
    for i, c in want.items():
        groups.setdefault(c, set()).add(fps[i])
    df = spark.createDataFrame([(simhash._signed(x),) for x in set(fps)], "fp long")
    for block in (4096, 1):
        parts = simhash.star_components(simhash.links(df, pair_block=block)).collect()
        by = {}
        for r in parts:
            by.setdefault(r.component, set()).add(r.node & (2**64 - 1))
        assert sorted(map(sorted, by.values())) == sorted(map(sorted, (g for g in groups.values() if len(g) > 1))), block


def test_files_that_run_over_batches_are_read_whole(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        fps = linked_set(12, 4)
        df = spark.createDataFrame([(simhash._signed(x),) for x in set(fps)], "fp long")
        for block in (4096, 5):
            n = simhash.star_components(simhash.links(df, pair_block=block)).select("component").distinct().count()
            want = brute_components(dict(enumerate(fps)))
            sizes = {}
            for i, c in want.items():
                sizes.setdefault(c, set()).add(fps[i])
            assert n == sum(len(s) > 1 for s in sizes.values())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_dedup_keeps_one_row_of_each_component_and_its_columns(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(9, base, 1), (3, base, 2), (3, base, 3), (5, base + " w", 4), (1, None, 5), (2, "", 6), (None, "other text here", 7),
            (8, "quite another text of its own", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int").withColumnRenamed("fp", "_fp")
    out = simhash.dedup(df)
    assert out.columns == df.columns
    kept = sorted((r.doc_id if r.doc_id is not None else -1) for r in out.collect())
    assert kept == [-1, 1, 3, 8]
    assert out.where("doc_id = 3").count() == 1
    assert simhash.dedup(df.limit(0)).count() == 0

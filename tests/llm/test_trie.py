"""The conversation prefix trie against a plain version."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from propensia.llm import prefix_trie
from propensia.llm.common import importable
from propensia.llm.queries import op12_prefix_trie

SF001 = "/root/testdata/sf0.001"
KIND = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module", autouse=True)
def _workers(spark):
    importable(spark)


def plain(rows):
    """Nodes from whole prefixes kept in a dictionary."""
    conv = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            key = hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest()
            conv[c].append(((t is not None, t or 0), key, (r, x)))
    conv = {c: [z[2] for z in sorted(v)] for c, v in conv.items()}
    path = {}
    for c, v in conv.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        path[c] = tuple(conv.get(base, [])[:h] + v[h:])
    members = defaultdict(list)
    for c in sorted(path):
        for d in range(len(path[c]) + 1):
            members[path[c][:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    saved, leaves = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
            leaves[p[:d]] += p not in children
    return sorted((m[0], len(p), members[p[:-1]][0] if p else -1, len(m), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in m if len(path[c]) == len(p)).encode()).hexdigest())
                  for p, m in members.items())


def built(df, **more):
    rows = prefix_trie.trie(df, **more).select(*prefix_trie.RESULT).fillna(-1, "parent_conv_id").collect()
    return sorted(tuple(r) for r in rows)


def odd_rows():
    rng = random.Random(1)
    rows = []
    for c in [*range(-30, 30), *range(95, 320)]:
        if rng.random() < 0.8:
            for t in range(rng.choice([1, 1, 2, 3, 5, 9, 14])):
                rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "a", None]), rng.choice(["x", "yy é", "", None])))
    rows += [(None, 1, "user", "z")] * 3 + [(200, t, "user", "long") for t in range(150)] + [(201, 0, "u", "w")] * 40
    rows += [(c, t, "user", "the same") for c in range(400, 460) for t in range(7)]        # a group of copies
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("turns", [1, 4, 7])
def test_equals_plain_version_on_odd_rows(spark, turns):
    rows = odd_rows()
    assert built(spark.createDataFrame(rows, KIND).repartition(5), block_turns=turns) == plain(rows)


def test_query_equals_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    got = sorted(tuple(r) for r in op12_prefix_trie(spark, SF001).select(*prefix_trie.RESULT).fillna(-1, "parent_conv_id").collect())
    assert got == plain(rows)


def test_small_tables(spark):
    run = lambda rows: built(spark.createDataFrame(rows, KIND))
    assert run([]) == [] and run([(None, 0, "user", "x")]) == []
    for rows in ([(7, None, None, None)], [(c, 0, "user", "x") for c in range(300, 312)],
                 [(0, 0, "user", "y" * 100_000)], [(1, 0, "u", "ab"), (2, 0, "ua", "b")]):
        assert run(rows) == plain(rows)


def test_turnless_conversations_belong_to_the_root(spark):
    late = [c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 0][:5]
    rows = [(c, 0, "user", f"text {c}") for c in late]      # the base is absent, the only turn is cut off
    got = built(spark.createDataFrame(rows, KIND))
    assert got == plain(rows) and len(got) == 1 and got[0][3] == 5 and got[0][5] == 1


def test_other_columns_are_ignored(spark):
    rows = odd_rows()[:150]
    df = spark.createDataFrame(rows, KIND).withColumns(
        {c: F.lit(1) for c in ("c", "KEY", "r", "depth", "upto", "id", "before", "ends", "n", "m", "part_", "a")})
    assert built(df) == plain(rows)


def test_running_sums_go_on_over_partition_borders(spark):
    rows = [(g, i, (g * 7 + i) % 5 - 2) for g, n in ((1, 3), (2, 500), (3, 1), (4, 90)) for i in range(n)]
    df = spark.createDataFrame(rows, T.StructType.fromDDL("g long, i long, v long")).repartition(3)
    got = prefix_trie.running(df, "g", [F.asc("i")], ["v"], "running_test").collect()
    assert len({r["g"] for r in got}) == 4 and len(got) == len(rows)
    sums = defaultdict(int)
    want = {}
    for g, i, v in rows:
        want[g, i] = (sums[g] + v, sums[g])
        sums[g] += v
    assert {(r["g"], r["i"]): (r["v"], r["v_before"]) for r in got} == want


def test_only_forked_blocks_are_grouped_by_turn(spark):
    block = [(1, "k" * 64, 5, 5), (2, "l" * 64, 4, 9)]
    kind = "before string, ends string, n long, m long, turns array<struct<depth:long,key:string,chars:long,upto:long>>"
    nodes = spark.createDataFrame([("0:0", "a:b", 3, 1, block), ("0:0", "c:d", 2, 4, block[:1] + [(2, "z" * 64, 1, 6)]),
                                   ("a:b", "e:f", 3, 1, block)], kind)
    forks = spark.createDataFrame([("0:0",)], "before string")
    got = prefix_trie.turn_nodes(nodes, forks, 2, {"n": F.sum("n"), "m": F.min("m")}).collect()
    assert sorted((r["depth"], r["n"], r["m"], r["parent"]) for r in got if r["parent"].startswith("0:0")) == [
        (1, 5, 1, "0:0"), (2, 2, 4, got_inner(got)), (2, 3, 1, got_inner(got))]
    assert len(got) == 5


def got_inner(rows):
    return next(r["id"] for r in rows if r["parent"] == "0:0")

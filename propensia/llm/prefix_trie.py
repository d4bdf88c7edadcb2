"""Conversation prefix trie: fixed-length block hashing, refined to turns only where siblings diverge.

1. *Turns.*  Role and text of a turn become one SHA-256 key and a length where
   the table is read; no text is moved.  Positions come from running counts
   over range partitions, so a conversation that holds a third of all turns is
   spread over many tasks.
2. *Shared starts.*  A conversation takes the first turns of its base
   conversation, then its own after as many (``rebuilt``).
3. *Blocks.*  BLOCK_TURNS successive turns are one block with one digest.  The
   chain value of a block is the running sum of the digests up to it (each
   bound to its place), modulo 2^128 in two halves: a parallel prefix sum
   instead of one hash round per block.  Conversations with one chain value
   share all turns up to the block's end.
4. *Block nodes.*  Conversations are grouped by (chain before, chain after).
   A block without sibling gives its turn nodes as it is, one per turn, all
   with the members of the block.  Where siblings diverge, the prefixes inside
   the block are grouped, from one row per block node, not per conversation.
5. *Subtrees without recursion.*  Let m be the smallest member of a node and A
   of a conversation the length of its turns before the first node whose
   smallest member it is.  Then the savings of a subtree are the sum of A over
   the members without m, less (members - 1) times the length before the node;
   and its leaves are the members that are the smallest of a leaf.  Both are
   sums over members: one more grouping by block, whatever the depth.
6. *Ends.*  Ids that end at a node are sorted over range partitions, packed in
   pieces and hashed piece by piece in order; a task holds one piece at a time.

Defined cases: null role or text counts as empty; rows with a null conv_id are
no conversation; a null turn comes first; turns of equal number are ordered by
their key, repeated rows are turns of their own; an empty text has length
zero; texts and conversations of any length; ``%`` of a negative id rounds
towards zero; an empty table gives no node; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import q, written

BLOCK_TURNS = 4
FAMILY = 100              # conversations c - c % FAMILY give the starts
MOST_SHARED = 6           # a start has crc32(id) % MOST_SHARED turns
PIECE_IDS = 4096
_ROOT = "0:0"

RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


# ------------------------------------------------------------------ running sums
def _within(groups: np.ndarray, values: list[np.ndarray], last: int | None, carry: list[int]) -> list[np.ndarray]:
    """Inclusive sums (modulo 2^64) inside runs of equal groups; the first run goes on from ``carry`` if it is ``last``."""
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    run = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(groups)]))
    out = []
    for v, c in zip(values, carry):
        total = np.cumsum(v, dtype=np.uint64)
        base = np.where(starts > 0, total[starts - 1], np.uint64(0))
        if last is not None and groups[0] == last:
            base[0] -= np.uint64(c)          # wraps, as all sums here do
        out.append(total - base[run])
    return out


def running(df: DataFrame, group: str, order: list[Column], sums: list[str], label: str) -> DataFrame:
    """``df`` with inclusive running sums per long ``group`` in place of the long columns ``sums``.

    ``order`` must be total inside a group.  ``<name>_before`` holds the sum
    without the row itself.  Sums are modulo 2^64 and go on over partition
    borders: only one row per partition reaches the driver.
    """
    names = df.columns
    at_group, at = names.index(group), [names.index(s) for s in sums]
    extra = [f"{s}_before" for s in sums]
    fields = df.schema.fields + [T.StructField(n, T.LongType()) for n in extra]
    tagged = T.StructType(fields + [T.StructField("part_", T.IntegerType()), T.StructField("last_", T.BooleanType())])
    as_longs = lambda v: pa.array(v.view(np.int64), pa.int64())
    longs = lambda c: c.to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, carry, held = None, [0] * len(sums), None

        def done(columns: list, final: bool) -> pa.RecordBatch:
            flags = np.zeros(len(columns[0]), bool)
            flags[-1] = final
            return pa.RecordBatch.from_arrays(
                columns + [pa.array(np.full(len(flags), part, np.int32)), pa.array(flags)], names=tagged.names)

        for b in batches:
            if not b.num_rows:
                continue
            if held is not None:
                yield done(held, False)
            groups, values = b.column(at_group).to_numpy().astype(np.int64), [longs(b.column(i)) for i in at]
            upto = _within(groups, values, last, carry)
            last, carry = int(groups[-1]), [int(u[-1]) for u in upto]
            columns = list(b.columns)
            for i, u in zip(at, upto):
                columns[i] = as_longs(u)
            held = columns + [as_longs(u - v) for u, v in zip(upto, values)]
        if held is not None:
            yield done(held, True)

    ranged = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    parts = written(ranged.mapInArrow(local, tagged), label)
    carries: dict[int, tuple[int, list[int]]] = {}
    last, sofar = None, [0] * len(sums)
    for t in sorted(parts.where("last_").select("part_", group, *sums).collect(), key=lambda t: t["part_"]):
        own = [t[s] % (1 << 64) for s in sums]
        if last is not None:
            carries[t["part_"]] = (last, sofar)
        sofar = [(a + b) % (1 << 64) for a, b in zip(sofar, own)] if t[group] == last else own
        last = t[group]
    touched = [*at, *range(len(names), len(names) + len(sums))]
    at_part = len(names) + len(sums)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(b.columns)[:at_part]
            of = b.column(at_part).to_numpy()
            groups = b.column(at_group).to_numpy()
            for p in np.unique(of):
                if int(p) in carries:
                    g, adds = carries[int(p)]
                    here = (of == p) & (groups == g)
                    if here.any():
                        for i, a in zip(touched, adds + adds):
                            v = longs(columns[i]).copy()
                            v[here] += np.uint64(a)
                            columns[i] = as_longs(v)
            yield pa.RecordBatch.from_arrays(columns, names=names + extra)

    return parts.mapInArrow(joined, T.StructType(fields))


# ------------------------------------------------------------------ conversations
def turn_keys(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(c, turn, key, chars, r): one narrow row per turn, in the shared folder."""
    said, who = F.coalesce(q(text).cast("string"), F.lit("")), F.coalesce(q(role).cast("string"), F.lit(""))
    key = F.sha2(F.concat(F.length(who).cast("string"), F.lit(":"), who, said), 256)
    narrow = df.where(q(conv).isNotNull()).select(
        q(conv).cast("long").alias("c"), q(turn).alias("turn"), key.alias("key"),
        F.length(said).cast("long").alias("chars"), F.monotonically_increasing_id().alias("r"))
    return written(narrow, "trie_turns")


def shared_turns(c: Column) -> Column:
    """How many turns a conversation takes from its base."""
    return F.crc32(c.cast("string").cast("binary")) % MOST_SHARED


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations (c), rebuilt turns (c, depth, key, chars, upto)); ``upto`` is the length of all turns so far."""
    own = running(turns.withColumn("pos", F.lit(1).cast("long")), "c", [F.asc_nulls_first("turn"), F.asc("key"), F.asc("r")],
                  ["pos"], "trie_own").select("c", "pos", "key", "chars")
    convs = own.where("pos = 1").select("c", shared_turns(F.col("c")).alias("h"),
                                        (F.col("c") - F.col("c") % FAMILY).alias("base"))
    starts = own.where((F.col("c") % FAMILY == 0) & (F.col("pos") < MOST_SHARED)).withColumnRenamed("c", "base")
    taken = convs.join(starts, "base").where(F.col("pos") <= F.col("h")).select("c", F.lit(0).alias("own"), "pos", "key", "chars")
    rest = own.where(F.col("pos") > shared_turns(F.col("c"))).select("c", F.lit(1).alias("own"), "pos", "key", "chars")
    both = taken.unionByName(rest).withColumn("depth", F.lit(1).cast("long")).withColumn("upto", F.col("chars"))
    rows = running(both, "c", [F.asc("own"), F.asc("pos")], ["depth", "upto"], "trie_rebuilt")
    return convs.select("c"), rows.select("c", "depth", "key", "chars", "upto")


def blocks(rows: DataFrame, block_turns: int) -> DataFrame:
    """(c, b, turns, before, ends): one row per block; ``before`` and ``ends`` name the nodes above and at its end."""
    cut = rows.groupBy("c", F.floor((F.col("depth") - 1) / block_turns).alias("b")).agg(
        F.sort_array(F.collect_list(F.struct("depth", "key", "chars", "upto"))).alias("turns"))
    digest = F.sha2(F.concat(F.col("b").cast("string"), F.lit(":"), F.array_join("turns.key", "")), 256)
    half = lambda i: F.conv(F.substring("digest", 1 + 16 * i, 16), 16, -10).cast("long")
    hashed = cut.withColumn("digest", digest).select("c", "b", "turns", half(0).alias("one"), half(1).alias("two"))
    chained = running(hashed, "c", [F.asc("b")], ["one", "two"], "trie_blocks")
    before = F.concat_ws(":", F.col("one_before").cast("string"), F.col("two_before").cast("string"))
    after = F.concat_ws(":", F.col("one").cast("string"), F.col("two").cast("string"))
    ends = F.when(F.size("turns") == block_turns, after).otherwise(_inside(before, F.col("turns.key"), F.size("turns")))
    return chained.select("c", "b", "turns", before.alias("before"), ends.alias("ends"))


def _inside(before: Column, keys: Column, n: Column) -> Column:
    """The node after the first ``n`` turns of an unfinished block."""
    return F.concat(before, F.lit("/"), F.substring(F.sha2(F.array_join(F.slice(keys, F.lit(1), n), ""), 256), 1, 32))


def turn_nodes(block_nodes: DataFrame, diverging: DataFrame, block_turns: int, sums: dict[str, Column]) -> DataFrame:
    """Turn nodes (id, parent, depth, chars, above, and ``sums``) of block nodes (before, ends, turns, and what ``sums`` reads).

    Only blocks below a node of ``diverging`` are grouped by their prefixes.
    """
    keys, n = F.col("turns.key"), F.size("turns")
    ids = F.transform(F.sequence(F.lit(1), n), lambda i: F.when(i == n, F.col("ends")).otherwise(
        _inside(F.col("before"), keys, i)))
    values = [c for c in block_nodes.columns if c not in ("before", "ends", "turns")]
    each = block_nodes.join(diverging.select("before", F.lit(True).alias("forked")), "before", "left") \
        .withColumn("ids", ids).select("before", "ids", "forked", *values, F.posexplode("turns").alias("i", "t"))
    each = each.select(
        F.element_at("ids", F.col("i") + 1).alias("id"),
        F.when(F.col("i") == 0, F.col("before")).otherwise(F.get("ids", F.col("i") - 1)).alias("parent"),
        F.col("t.depth").alias("depth"), F.col("t.chars").alias("chars"),
        (F.col("t.upto") - F.col("t.chars")).alias("above"), "forked", *values)
    plain = each.where(F.col("forked").isNull()).select("id", "parent", "depth", "chars", "above", *values)
    forked = each.where("forked").groupBy("id").agg(
        *[F.first(c).alias(c) for c in ("parent", "depth", "chars", "above")], *[a.alias(n) for n, a in sums.items()])
    return plain.select("id", "parent", "depth", "chars", "above", *sums).unionByName(forked)


def ends_digests(ends: DataFrame) -> DataFrame:
    """(id, ends_sha256) of (id, c): SHA-256 of the ids in ascending order, comma-joined."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids = None, []

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([ids[0]], pa.int64()),
                                               pa.array([",".join(map(str, ids))])], names=["id", "first", "piece"])

        for b in batches:
            for node, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if node != at or len(ids) == PIECE_IDS:
                    if ids:
                        yield piece()
                    at, ids = node, []
                ids.append(c)
        if ids:
            yield piece()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        line = lambda: pa.RecordBatch.from_arrays([pa.array([at]), pa.array([digest.hexdigest()])], names=["id", "ends_sha256"])
        for b in batches:
            for node, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if node != at:
                    if at is not None:
                        yield line()
                    at, digest = node, hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
        if at is not None:
            yield line()

    pieces = ends.select("id", "c").repartitionByRange("id", "c").sortWithinPartitions("id", "c") \
        .mapInArrow(pack, "id string, first long, piece string")
    return pieces.repartition("id").sortWithinPartitions("id", "first").select("id", "piece") \
        .mapInArrow(hashed, "id string, ends_sha256 string")


def trie(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
         block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row per node of the prefix trie of the rebuilt conversations: see RESULT (all long, the digest a string)."""
    convs, rows = rebuilt(turn_keys(df, conv, turn, role, text))
    convs = written(convs, "trie_convs")
    cut = blocks(rows, block_turns)
    of = cut.groupBy("before", "ends").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("m"), F.first("turns").alias("turns"))
    nodes_of = written(of, "trie_block_nodes")
    forks = written(nodes_of.groupBy("before").count().where("count > 1").select("before"), "trie_forks")

    # who owns a node, what is childless
    first = turn_nodes(nodes_of, forks, block_turns, {"n": F.sum("n"), "m": F.min("m")})
    root = convs.groupBy().agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("m")).where("n > 0")
    nothing = F.lit(0).cast("long")
    root = root.select(F.lit(_ROOT).alias("id"), F.lit(None).cast("string").alias("parent"), nothing.alias("depth"),
                       nothing.alias("chars"), nothing.alias("above"), "n", "m")
    nodes = written(first.unionByName(root), "trie_nodes")
    children = written(nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(
        F.count(F.lit(1)).alias("n_children")), "trie_children")
    owners = nodes.join(children, "id", "left").groupBy(F.col("m").alias("c")).agg(
        F.min("above").alias("a"), F.max(F.col("n_children").isNull().cast("long")).alias("leaf"))

    # sums over members
    last = cut.groupBy("c").agg(F.max(F.struct("b", "ends", F.element_at("turns", -1)["upto"].alias("upto"))).alias("e"))
    members = written(
        convs.join(last, "c", "left").join(owners, "c", "left").select(
            "c", F.coalesce("e.ends", F.lit(_ROOT)).alias("id"),
            F.coalesce("a", "e.upto", F.lit(0)).alias("a"), F.coalesce("leaf", F.lit(0)).cast("long").alias("leaf")),
        "trie_members")
    sums = {"a": F.sum("a"), "leaf": F.sum("leaf"), "owner": F.min("owner")}
    own = F.min(F.struct("c", "a")).alias("owner")
    by_block = cut.select("c", "before", "ends").join(members.select("c", "a", "leaf"), "c").groupBy("before", "ends").agg(
        F.sum("a").alias("a"), F.sum("leaf").alias("leaf"), own)
    summed = turn_nodes(by_block.join(nodes_of.select("before", "ends", "turns"), ["before", "ends"]), forks, block_turns, sums)
    top = members.groupBy().agg(F.sum("a").alias("a"), F.sum("leaf").alias("leaf"), own).select(
        F.lit(_ROOT).alias("id"), "a", "leaf", "owner")
    totals = summed.select("id", "a", "leaf", "owner").unionByName(top)

    empty = hashlib.sha256(b"").hexdigest()
    return (nodes.join(totals, "id").join(children, "id", "left").join(ends_digests(members), "id", "left")
            .join(nodes.select(F.col("id").alias("parent"), F.col("m").alias("parent_conv_id")), "parent", "left")
            .select(F.col("m").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"),
                    F.coalesce("n_children", nothing).alias("n_children"), F.col("leaf").alias("n_leaves"),
                    (F.col("a") - F.col("owner.a") - (F.col("n") - 1) * F.col("above")).alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256")))

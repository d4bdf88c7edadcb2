"""Selection of the k-th key per group without a sort: histograms of hash prefixes, refined where the k-th key lies.

Every round is one aggregation to at most 4,096 counts per open target; it
narrows a target to one prefix of three more hexadecimal digits, so a thousand
billion rows need four rounds.  No row leaves its partition: only counts, and
at the end the few keys of the last prefix, reach the driver.
"""

from __future__ import annotations

from collections.abc import Hashable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = 3
FEW_KEYS = 1_024          # keys of a last prefix that are looked at one by one

Key = tuple[str, str | None]


def _inside(group: str, g: Hashable, hash_col: str, prefix: str) -> Column:
    same = F.col(group).eqNullSafe(F.lit(g))
    return same & F.startswith(F.col(hash_col), F.lit(prefix)) if prefix else same


def group_sizes(rows: DataFrame, group: str) -> dict[Hashable, int]:
    """Rows per group (a class label: few values)."""
    return {r[group]: r["n"] for r in rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).collect()}


def kth_keys(rows: DataFrame, group: str, hash_col: str, id_col: str, ranks: dict[Hashable, list[int]],
             few: int = FEW_KEYS) -> dict[tuple[Hashable, int], Key]:
    """The (hash, id) of rank k (from 1) in its group's (hash, id) order, for every asked (group, k).

    The hash is a lower-case hexadecimal text, empty where there is none; a
    missing id comes before any other.  Ranks that a group does not have are
    left out.
    """
    todo = [(g, k, "", k) for g, ks in ranks.items() for k in ks if k > 0]      # group, rank, prefix, rank inside the prefix
    ready: list[tuple[Hashable, int, str, int]] = []
    found: dict[tuple[Hashable, int], Key] = {}
    while todo:
        open_prefixes = {(g, p) for g, _, p, _ in todo}
        wanted = F.lit(False)
        for g, p in open_prefixes:
            wanted = wanted | _inside(group, g, hash_col, p)
        size = len(todo[0][2]) + DIGITS
        counts: dict[tuple[Hashable, str], list[tuple[str, int]]] = {}
        for r in rows.where(wanted).groupBy(group, F.substring(hash_col, 1, size).alias("p")).agg(
                F.count(F.lit(1)).alias("n")).collect():
            counts.setdefault((r[group], r["p"][:size - DIGITS]), []).append((r["p"], r["n"]))
        later = []
        for g, k, prefix, at in todo:
            for p, n in sorted(counts.get((g, prefix), [])):
                if at <= n:
                    if n <= few:
                        ready.append((g, k, p, at))
                    elif len(p) < size:                 # the whole hash: equal ids, or none
                        top = rows.where(F.col(group).eqNullSafe(F.lit(g)) & (F.col(hash_col) == p)).agg(F.max(id_col)).first()
                        found[g, k] = (p, top[0])
                    else:
                        later.append((g, k, p, at))
                    break
                at -= n
        todo = later
    if ready:
        wanted = F.lit(False)
        for g, p in {(g, p) for g, _, p, _ in ready}:
            wanted = wanted | (_inside(group, g, hash_col, p) if p else F.col(group).eqNullSafe(F.lit(g)) & (F.col(hash_col) == ""))
        keys: dict[Hashable, list[Key]] = {}
        for r in rows.where(wanted).select(group, hash_col, F.col(id_col).cast("string").alias("i")).collect():
            keys.setdefault(r[group], []).append((r[hash_col], r["i"]))
        for g, k, p, at in ready:
            mine = sorted((x for x in keys[g] if (x[0].startswith(p) if p else x[0] == "")), key=lambda x: (x[0], x[1] is not None, x[1] or ""))
            found[g, k] = mine[at - 1]
    return found


def at_most(hash_col: Column, id_col: Column, key: Key | None) -> Column:
    """Whether a row's (hash, id) comes no later than ``key`` (None: before every row)."""
    if key is None:
        return F.lit(False)
    h, i = key
    ties = id_col.isNull() if i is None else id_col.isNull() | (id_col <= F.lit(i))
    return (hash_col < F.lit(h)) | ((hash_col == F.lit(h)) & ties)

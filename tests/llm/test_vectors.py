"""Exact top-k search and whitening against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from propensia.llm import bidiagonal, va_file, whitening
from propensia.llm.common import importable
from propensia.llm.queries import op11_exact_topk, op13_whitening

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"

KIND = "vec_id long, embedding array<double>"


@pytest.fixture(scope="module", autouse=True)
def _workers(spark):
    importable(spark)


def whole(rows):
    good = [(v, x) for v, x in rows if x is not None and all(c is not None and np.isfinite(c) for c in x)]
    width = max((len(x) for _, x in good), default=0)
    return [v for v, _ in good], [[int(np.floor(256 * c)) for c in x] + [0] * (width - len(x)) for _, x in good]


def plain_top_k(rows, k=5, every=50):
    ids, xs = whole(rows)
    out = []
    for i, (v, x) in enumerate(zip(ids, xs)):
        if v is not None and v % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y)), w is None, w or 0, j, w)
                            for j, (w, y) in enumerate(zip(ids, xs)) if j != i)[:k]
            out += [(v, n + 1, s[4], -s[0]) for n, s in enumerate(scored)]
    return sorted(out, key=str)


def searched(spark, rows, **more):
    df = spark.createDataFrame(rows, KIND).coalesce(3)
    return sorted((tuple(r) for r in va_file.top_k(df, F.col("vec_id") % 50 == 0, **more).collect()), key=str)


def odd_rows():
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 3, size=4) / 4]) for i in range(300)]     # many ties
    return rows + [(None, [0.5] * 4)] * 3 + [
        (50, None), (100, [float("nan")] * 4), (150, [1.0, None, 0.0, 0.0]), (350, [float("inf")] * 4),
        (50, [0.25]), (250, []), (300, [0.5] * 9)] + [(50, [0.25] * 4)] * 9


def test_search_equals_plain_version_on_odd_rows(spark):
    rows = odd_rows()
    assert searched(spark, rows) == plain_top_k(rows)


@pytest.mark.parametrize("bits", [1, 3, 8])
def test_search_is_exact_whatever_the_cells(spark, bits):
    rng = np.random.default_rng(bits)
    rows = [(i, (rng.normal(size=6) * 10.0 ** rng.integers(-2, 3)).tolist()) for i in range(150)]
    assert searched(spark, rows, bits=bits) == plain_top_k(rows)


def test_search_over_several_tiles_and_rounds(spark, monkeypatch):
    monkeypatch.setattr(va_file, "TILE_BYTES", 900)          # some 64 rows a block and 16 queries a pack
    rng = np.random.default_rng(9)
    base = rng.normal(size=5)
    rows = [(i, (base + rng.normal(size=5) * 1e-2).tolist()) for i in range(400)]            # bounds tell little
    want = plain_top_k(rows, every=10)
    df = spark.createDataFrame(rows, KIND).coalesce(3)
    assert sorted((tuple(r) for r in va_file.top_k(df, F.col("vec_id") % 10 == 0, bits=2).collect()), key=str) == want


def test_search_of_large_and_small_tables(spark):
    one = [(50, [1.0, 2.0])]
    assert searched(spark, []) == [] and searched(spark, one) == []
    assert searched(spark, one * 2) == [(50, 1, 50, 5 * 65536)] * 2
    assert searched(spark, one + [(None, [-1.0, 0.0])]) == [(50, 1, None, -65536)]
    most = 2 ** 63 - 1
    huge = [(50, [1e300, 1.0]), (51, [1e300, 1.0]), (52, [-1e300, 0.0]), (53, [1e9, 3.0])]
    got = searched(spark, huge)
    assert [(r[1], r[2]) for r in got] == [(1, 51), (2, 53), (3, 52)] and got[0][3] == most and got[2][3] == -most - 1


def test_search_ignores_other_columns(spark):
    rows = odd_rows()[:120]
    df = spark.createDataFrame(rows, KIND).withColumns(
        {c: F.lit(1) for c in ("x", "r", "c", "q", "pack", "block", "Score", "rank", "members")})
    assert sorted((tuple(r) for r in va_file.top_k(df, F.col("vec_id") % 50 == 0).collect()), key=str) == plain_top_k(rows)


def test_query_equals_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted((tuple(r) for r in op11_exact_topk(spark, SF001).collect()), key=str) == plain_top_k(rows)


def test_bounds_hold_and_codes_round_trip():
    rng = np.random.default_rng(0)
    for scale in (100, 10 ** 6, 10 ** 12):
        m = rng.integers(-scale, scale, size=(200, 7))
        edges = np.sort(rng.integers(-scale, scale, size=(7, 16)), axis=1)
        edges[:, 0] = -scale
        codes = va_file.decode(va_file.encode(m, edges, 4), 200, 7, 4)
        starts = [np.unique(e) for e in edges]
        lo = np.array([[starts[d][c] for d, c in enumerate(r)] for r in codes])
        hi = np.array([[(starts[d][c + 1] if c + 1 < len(starts[d]) else scale) for d, c in enumerate(r)] for r in codes])
        assert (lo <= m).all() and (m <= hi).all()
        queries = rng.integers(-scale, scale, size=(20, 7))
        lower, upper = va_file.bounds(queries, lo, hi)
        exact = queries.astype(object) @ m.T.astype(object)
        assert (lower <= exact).all() and (exact <= upper).all()
        assert (np.diff(va_file._bucket(np.sort(m.ravel()))) >= 0).all()


# ------------------------------------------------------------------ whitening
def plain_whitening(rows, k=4):
    ids, xs = whole(rows)
    x = np.array(xs, dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return ids, n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ vectors, values, np.trace(centred.T @ centred / n)


def check_whitening(got, rows, k=4):
    ids, n, deviation, raw, values, trace = plain_whitening(rows)
    k = min(k, raw.shape[1])
    live = values > 1e-9 * max(values[0], 1e-300)
    assert {(r["n"]) for r in got} == {n} and len(got) == k * len(ids)
    key = lambda v, d: (v is None, v or 0, int(d))
    mine = sorted(got, key=lambda r: (key(r["vec_id"], r["deviation"]), r["component"]))
    assert sorted((key(v, d) for v, d in zip(ids, deviation)) , key=str) == sorted(
        (key(r["vec_id"], r["deviation"]) for r in mine if r["component"] == 1), key=str)
    for c in range(k):
        col = [r for r in mine if r["component"] == c + 1]
        assert col[0]["explained"] == (pytest.approx(values[c] / trace, rel=1e-9, abs=1e-12) if trace else None)
        if live[c]:
            order = sorted(range(len(ids)), key=lambda i: key(ids[i], deviation[i]))
            want = np.array([raw[i, c] for i in order]) / np.sqrt(values[c])
            z = np.array([r["whitened"] for r in col])
            assert np.allclose(z, want, atol=1e-8) or np.allclose(z, -want, atol=1e-8)
        else:
            assert all(r["whitened"] is None for r in col)
    assert got[0]["identity_error"] is None if not live.any() else got[0]["identity_error"] < 1e-9


def test_whitening_query_equals_eigenvectors(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF01}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = op13_whitening(spark, SF01).collect()
    check_whitening(got, rows)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(40)]
    rows += [(7, rows[7][1]), (None, rows[8][1]), (99, None), (98, [float("inf")] * 5), (97, [1.0, None]), (96, [0.5]), (95, [])]
    df = spark.createDataFrame(rows, KIND).withColumns({c: F.lit(1) for c in ("x", "N", "component", "dim", "slot")})
    check_whitening(whitening.whiten(df.coalesce(3)).collect(), rows)


def test_whitening_without_variance(spark):
    run = lambda rows: whitening.whiten(spark.createDataFrame(rows, KIND)).collect()
    assert run([]) == [] and run([(1, None), (2, [])]) == []
    for rows in ([(1, [1.0, 2.0, 3.0])], [(1, [1.0, 2.0, 3.0])] * 3, [(1, [0.0, 2.0, 3.0]), (2, [0.0, 4.0, 3.0]), (3, [0.0, 5.0, 3.0])]):
        check_whitening(run(rows), rows)


def test_whitening_of_equal_eigenvalues(spark):
    rows = [(2 * i + s, [float(i == j) * (1 - 2 * s) for j in range(6)]) for i in range(6) for s in (0, 1)]
    got = whitening.whiten(spark.createDataFrame(rows, KIND)).collect()
    assert got[0]["identity_error"] < 1e-9 and {round(r["explained"], 9) for r in got} == {round(1 / 6, 9)}


def test_whitening_deviation_beyond_64_bits(spark):
    rows = [(1, [1e300, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 2.0])]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(spark.createDataFrame(rows, KIND)).collect()}
    assert got[1] == 2 ** 63 - 1


def test_triangle_tree_has_one_block_per_task(spark):
    rng = np.random.default_rng(2)
    m = rng.integers(-200, 200, size=(900, 6))
    rows = spark.createDataFrame([(r.tolist(),) for r in m], "x array<long>").repartition(20)
    n, sums = whitening.column_sums(rows, 6)
    assert (n, sums) == (900, m.sum(axis=0).tolist())
    r = whitening.triangle(rows, whitening.Centre(n, sums), 6)
    centred = m - m.mean(axis=0)
    assert np.allclose(r.T @ r, centred.T @ centred, rtol=1e-10)


@pytest.mark.parametrize("n", [1, 2, 3, 8, 40])
def test_bidiagonal_solver(n):
    rng = np.random.default_rng(n)
    a = rng.normal(size=(n + 3, n)) * 10.0 ** rng.uniform(-3, 3, size=n)
    d, e, v = bidiagonal.bidiagonalise(np.linalg.qr(a, mode="r"))
    b = np.diag(d) + np.diag(e, 1)
    assert np.allclose(v.T @ (a.T @ a) @ v, b.T @ b, rtol=1e-8, atol=1e-8 * np.abs(b).max() ** 2)
    want = np.linalg.svd(b, compute_uv=False)
    assert np.allclose(bidiagonal.singular_values(d, e), want, rtol=1e-10, atol=1e-14 * want[0])
    every, top, rows = bidiagonal.leading(np.linalg.qr(a, mode="r"), 4)
    k = min(4, n)
    assert np.allclose(rows @ rows.T, np.eye(k), atol=1e-10)
    assert np.allclose(rows @ (a.T @ a) @ rows.T, np.diag(top ** 2), atol=1e-9 * top[0] ** 2)


def test_small_singular_values_keep_their_accuracy():
    d, e = np.array([1.0, 1e-5, 1e-10, 1e-15]), np.array([1.0, 1e-5, 1e-10])
    got = bidiagonal.singular_values(d, e)
    assert np.prod(got) == pytest.approx(np.prod(d), rel=1e-12)           # the determinant

"""Singular values and right vectors of a small upper triangle: Householder, dqds, twisted factorisations.

The order of the matrix is the width of the vectors, never their number.
"""

from __future__ import annotations

import numpy as np

_EPS = np.finfo(float).eps
_TINY = np.finfo(float).tiny


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(d, e, v): ``r`` = u * b * v.T with b upper bidiagonal (diagonal d, superdiagonal e), by Householder reflections."""
    a = np.array(r, dtype=float)
    n = a.shape[0]
    v = np.eye(n)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        norm = np.linalg.norm(x)
        if norm == 0 or np.linalg.norm(x[1:]) == 0:
            return None
        w = x / norm
        w[0] += np.copysign(1.0, w[0])
        return w / np.linalg.norm(w)

    for j in range(n):
        w = reflector(a[j:, j].copy())
        if w is not None:
            a[j:, j:] -= 2 * np.outer(w, w @ a[j:, j:])
        if j + 2 < n:
            w = reflector(a[j, j + 1:].copy())
            if w is not None:
                a[j:, j + 1:] -= 2 * np.outer(a[j:, j + 1:] @ w, w)
                v[:, j + 1:] -= 2 * np.outer(v[:, j + 1:] @ w, w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float]:
    """One differential qd transform with a shift; the third value is the least pivot (negative: shift too large)."""
    m = len(q)
    nq, ne = [0.0] * m, [0.0] * (m - 1)
    d = q[0] - shift
    least = d
    for i in range(m - 1):
        nq[i] = d + e[i]
        if nq[i] <= 0:
            if shift > 0:
                return q, e, -1.0
            nq[i] = _TINY
        t = q[i + 1] / nq[i]
        ne[i] = e[i] * t
        d = d * t - shift
        least = min(least, d)
    nq[m - 1] = d
    return nq, ne, least


def singular_values(d: np.ndarray, e: np.ndarray) -> np.ndarray:
    """All singular values of an upper bidiagonal matrix, falling, by the dqds algorithm.

    Shifts never pass the least remaining value (a transform with a negative
    pivot is thrown away and tried with a smaller shift), so nothing cancels
    and small values keep their relative accuracy.
    """
    q, e = [float(x) * float(x) for x in d], [float(x) * float(x) for x in e]
    out: list[float] = []
    total = 0.0                                  # the shifts so far
    if q and 1.5 * q[0] < q[-1]:                 # large values first: same singular values from the other end
        q, e = q[::-1], e[::-1]
    while q:
        m = len(q)
        if m == 1 or e[-1] <= _EPS * _EPS * (total + q[-1]) or e[-1] < _TINY:
            out.append(q.pop() + total)
            if e:
                e.pop()
            continue
        # the least eigenvalue of the last 2 x 2 block lies above the least of all
        a, c = q[-2] + (e[-2] if m > 2 else 0.0), q[-1] + e[-1]
        prod = q[-2] * e[-1]
        half = (a - c) / 2
        low = max(0.0, c - prod / (abs(half) + np.sqrt(half * half + prod)) if half >= 0
                  else a - prod / (abs(half) + np.sqrt(half * half + prod)))
        away = np.sqrt(q[-3] * e[-2]) if m > 2 else 0.0
        for shift in (low * (1 - 4 * _EPS), max(0.0, low - away), low / 4, low / 64, 0.0):
            nq, ne, least = _step(q, e, shift)
            if least >= 0 or shift == 0:
                break
        nq[-1] = max(nq[-1], 0.0)
        q, e, total = nq, ne, total + shift
    return np.sqrt(np.sort(np.array(out))[::-1])


def twisted_vector(d: np.ndarray, e: np.ndarray, lam: float) -> np.ndarray:
    """Eigenvector of b.T * b at the eigenvalue ``lam``: top and bottom factorisations meet where the twist is least."""
    n = len(d)
    pivot = d * d
    low = np.append(e / d[:-1], 0.0) if n > 1 else np.zeros(1)
    s, p = np.empty(n), np.empty(n)
    up, down = np.zeros(n), np.zeros(n)
    safe = lambda x: x if abs(x) > _TINY else _TINY
    s[0] = -lam
    for i in range(n - 1):
        up[i] = pivot[i] * low[i] / safe(s[i] + pivot[i])
        s[i + 1] = up[i] * low[i] * s[i] - lam
    p[n - 1] = pivot[n - 1] - lam
    for i in range(n - 2, -1, -1):
        t = pivot[i] / safe(pivot[i] * low[i] * low[i] + p[i + 1])
        down[i] = low[i] * t
        p[i] = p[i + 1] * t - lam
    twist = np.abs(s + p + lam)
    at = int(np.argmin(np.where(np.isnan(twist), np.inf, twist)))
    z = np.zeros(n)
    z[at] = 1.0
    for i in range(at - 1, -1, -1):
        z[i] = -up[i] * z[i + 1]
    for i in range(at, n - 1):
        z[i + 1] = -down[i] * z[i]
    return z / np.linalg.norm(z)


def _separate(d: np.ndarray, e: np.ndarray, lam: float, z: np.ndarray, known: list[np.ndarray]) -> np.ndarray:
    """``z`` made orthogonal to ``known``; where nearly equal values gave the same vector, inverse iteration finds another."""
    basis = np.array(known).T
    project = lambda x: x - basis @ (basis.T @ x)
    left = project(project(z))
    if np.linalg.norm(left) > 0.7:
        return left / np.linalg.norm(left)
    n = len(d)
    t = np.diag(d * d + np.append(0.0, e * e)) + np.diag(d[:-1] * e, 1) + np.diag(d[:-1] * e, -1)
    shifted = t - (lam * (1 + 8 * _EPS) + _TINY) * np.eye(n)
    shifted += np.eye(n) * _EPS * max(lam, _TINY)
    x = project(np.cos(np.arange(1, n + 1) * 1.7))
    for _ in range(4):
        x = project(project(np.linalg.lstsq(shifted, x / np.linalg.norm(x), rcond=None)[0]))
    return x / np.linalg.norm(x)


def leading(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all singular values of ``r``, falling; the first ``k``; their right vectors as rows).

    Values below the rounding error of the largest count as zero and have a
    zero row instead of a vector.
    """
    n = r.shape[0]
    d, e, v = bidiagonalise(r)
    scale = max(np.abs(d).max(initial=0.0), np.abs(e).max(initial=0.0))
    if scale == 0:
        return np.zeros(n), np.zeros(min(k, n)), np.zeros((min(k, n), n))
    d, e = d / scale, e / scale
    d = np.where(np.abs(d) < _EPS * 1e-3, _EPS * 1e-3, d)
    edge = _EPS * np.sqrt(np.abs(d[:-1] * d[1:]))
    cuts = [0, *(np.flatnonzero(np.abs(e) <= np.maximum(edge, _TINY)) + 1).tolist(), n]
    parts = [(lo, hi) for lo, hi in zip(cuts, cuts[1:])]
    found = [(s, lo, hi) for lo, hi in parts for s in singular_values(d[lo:hi], e[lo:hi - 1])]
    found.sort(key=lambda x: -x[0])
    every = np.array([s for s, _, _ in found])
    rows, known = [], {}
    for s, lo, hi in found[:k]:
        if s <= n * _EPS * every[0]:
            rows.append(np.zeros(n))
            continue
        z = twisted_vector(d[lo:hi], e[lo:hi - 1], s * s)
        near = [y for t, y in known.get(lo, []) if abs(t - s) <= 1e-3 * s]
        if near:
            z = _separate(d[lo:hi], e[lo:hi - 1], s * s, z, near)
        known.setdefault(lo, []).append((s, z))
        whole = v[:, lo:hi] @ z
        rows.append(whole / np.linalg.norm(whole))
    top = np.array([s if np.any(y) else 0.0 for (s, _, _), y in zip(found, rows)])
    return every * scale, top * scale, np.array(rows).reshape(len(rows), n)

"""Leading eigenpairs of a symmetric matrix: Householder tridiagonalisation, Sturm counts, inverse iteration."""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(float).eps)
CLUSTER = 1e-3  # eigenvalues closer than this part of the norm share a cluster, whose vectors are made orthogonal
ROUNDS = 6  # of inverse iteration; two or three suffice unless a start vector is unlucky


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray | None]]:
    """Diagonal, subdiagonal and reflectors (unit vectors; None where nothing is to reflect) of Q'vQ."""
    a = np.array(v, float)
    size = len(a)
    off, reflectors = np.zeros(max(0, size - 1)), []
    for k in range(size - 1):
        x = a[k + 1 :, k].copy()
        scale = np.abs(x).max()
        if scale == 0 or not np.abs(x[1:]).any():
            off[k] = x[0]
            reflectors.append(None)
            continue
        x /= scale
        length = -np.copysign(np.sqrt(x @ x), x[0])
        off[k] = length * scale
        x[0] -= length
        u = x / np.sqrt(x @ x)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ u
        w = 2.0 * (p - (u @ p) * u)
        rest -= np.outer(u, w) + np.outer(w, u)
        reflectors.append(u)
    return np.diag(a).copy(), off, reflectors


def below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues lie below each value of ``at``, by the signs of the pivots of T - at."""
    least = max(np.finfo(float).tiny, EPS * EPS * float((off * off).max(initial=0.0)))
    pivot = diagonal[0] - at
    count = (pivot < 0).astype(np.int64)
    for d, e in zip(diagonal[1:], off, strict=True):
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        pivot = d - at - e * e / pivot
        count += pivot < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` greatest eigenvalues, falling, each by bisection until the bracket cannot be halved."""
    radius = np.concatenate([np.abs(off), [0.0]]) + np.concatenate([[0.0], np.abs(off)])
    margin = EPS * max(1e-300, float(np.abs(diagonal).max() + radius.max())) * 4
    lo = np.full(k, float((diagonal - radius).min()) - margin)
    hi = np.full(k, float((diagonal + radius).max()) + margin)
    wanted = len(diagonal) - np.arange(k)  # so many eigenvalues lie at or below the one sought
    while True:
        mid = lo + (hi - lo) / 2
        if not ((lo < mid) & (mid < hi)).any():
            return mid
        enough = below(diagonal, off, mid) >= wanted
        hi, lo = np.where(enough, mid, hi), np.where(enough, lo, mid)


def _solve(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray, right: np.ndarray, least: float) -> np.ndarray:
    """(T - shift) z = right for each column, by elimination with row exchanges."""
    size, k = right.shape
    u0, u1, u2 = np.zeros((size, k)), np.zeros((size, k)), np.zeros((size, k))
    y = right.copy()
    head, nxt = diagonal[0] - shifts, np.full(k, off[0] if size > 1 else 0.0)  # the row at hand: its first two entries
    for i in range(size - 1):
        under, after = off[i], off[i + 1] if i + 2 < size else 0.0
        own = diagonal[i + 1] - shifts
        swap = np.abs(under) > np.abs(head)
        u0[i], u1[i], u2[i] = np.where(swap, under, head), np.where(swap, own, nxt), np.where(swap, after, 0.0)
        u0[i] = np.where(np.abs(u0[i]) < least, least, u0[i])
        factor = np.where(swap, head, under) / u0[i]
        top, low = np.where(swap, y[i + 1], y[i]), np.where(swap, y[i], y[i + 1])
        y[i], y[i + 1] = top, low - factor * top
        head, nxt = np.where(swap, nxt, own) - factor * u1[i], np.where(swap, 0.0, after) - factor * u2[i]
    u0[-1] = np.where(np.abs(head) < least, least, head)
    z = np.zeros_like(y)
    for i in range(size - 1, -1, -1):
        z[i] = y[i]
        if i + 1 < size:
            z[i] -= u1[i] * z[i + 1]
        if i + 2 < size:
            z[i] -= u2[i] * z[i + 2]
        z[i] /= u0[i]
        big = np.abs(z[i]) > 1e100
        if big.any():  # only directions matter
            z[:, big] *= 1e-100
            y[:, big] *= 1e-100
    return z


def leading_pairs(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` greatest eigenvalues of ``v``, falling, and unit eigenvectors as columns (greatest entry positive)."""
    size = len(v)
    k = min(k, size)
    unit = float(np.abs(v).max(initial=0.0))
    if unit == 0:
        return np.zeros(k), np.eye(size, k)
    diagonal, off, reflectors = tridiagonal(v / unit)
    values = leading_values(diagonal, off, k)
    norm = max(float(np.abs(diagonal).max()), float(np.abs(off).max(initial=0.0)), np.finfo(float).tiny)
    shifts = values.copy()
    for j in range(1, k):  # equal eigenvalues get shifts that differ a little, so that their systems do
        shifts[j] = min(shifts[j], shifts[j - 1] - 10 * EPS * norm)
    z = np.random.default_rng(1).uniform(-1, 1, (size, k))
    first = list(range(k))  # of each vector's cluster
    for j in range(1, k):
        if values[j - 1] - values[j] <= CLUSTER * norm:
            first[j] = first[j - 1]
    for _ in range(ROUNDS):
        z = _solve(diagonal, off, shifts, z, EPS * norm)
        for j in range(k):
            z[:, j] /= np.abs(z[:, j]).max()
            for _ in range(2):
                z[:, j] /= np.sqrt(z[:, j] @ z[:, j])
                mates = z[:, first[j] : j]
                z[:, j] -= mates @ (mates.T @ z[:, j])
            z[:, j] /= np.sqrt(z[:, j] @ z[:, j])
    for j in range(len(reflectors) - 1, -1, -1):
        if (u := reflectors[j]) is not None:
            z[j + 1 :] -= 2.0 * np.outer(u, u @ z[j + 1 :])
    z /= np.sqrt((z * z).sum(axis=0))
    return values * unit, z * np.where(np.take_along_axis(z, np.abs(z).argmax(axis=0)[None], 0)[0] < 0, -1.0, 1.0)

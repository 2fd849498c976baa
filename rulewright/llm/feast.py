"""Leading eigenpairs of a symmetric matrix by contour integration.

An eigenvalue interval is encircled in the complex plane; solves with the shifted
matrix at quadrature nodes on the circle, summed with their weights, project random
vectors on the eigenvectors inside.  Rayleigh-Ritz on the projected vectors gives the
eigenpairs, which go into the next projection until their residuals vanish.  How many
there must be is known beforehand: the inertia of the matrix less a shift counts the
eigenvalues below it.
"""

from __future__ import annotations

import numpy as np

#: Quadrature nodes on the upper half circle (Gauss-Legendre) and the most refinements of one interval.
NODES, ROUNDS = 8, 40
#: Eigenvalues that one interval should hold.
WIDTH = 8


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of an orthogonally similar tridiagonal matrix (Householder reflections)."""
    a = np.array(a, np.float64)
    n = len(a)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if size == 0:
            continue
        x[0] += np.copysign(size, x[0])
        x /= np.linalg.norm(x)
        block = a[k + 1 :, k + 1 :]
        p = block @ x
        q = p - (x @ p) * x
        block -= 2 * (np.outer(x, q) + np.outer(q, x))
        a[k + 1 :, k] = a[k, k + 1 :] = 0
        a[k + 1, k] = a[k, k + 1] = -np.copysign(size, x[0])
    return np.diag(a).copy(), np.diag(a, 1).copy()


def below(diagonal: np.ndarray, off: np.ndarray, shift: float) -> int:
    """How many eigenvalues lie below ``shift``: negative pivots of the shifted tridiagonal matrix (law of inertia)."""
    tiny = np.finfo(float).tiny ** 0.5
    count, pivot = 0, 1.0
    for d, e in zip(diagonal.tolist(), [0.0, *(off * off).tolist()]):
        pivot = d - shift - (e / pivot if e else 0.0)
        if abs(pivot) < tiny:
            pivot = -tiny
        count += pivot < 0
    return count


def _edges(diagonal: np.ndarray, off: np.ndarray, wanted: int, low: float, high: float) -> tuple[float, float, int]:
    """The ends of the first gap in the spectrum with ``wanted`` eigenvalues or more below it, and how many those are.

    Eigenvalues closer than rounding can tell apart are one cluster.
    """
    n = lambda s: below(diagonal, off, s)
    fine = 1e-16 * high
    while True:
        a, b = low, high
        while b - a > fine and a < (mid := (a + b) / 2) < b:
            a, b = (mid, b) if n(mid) < wanted else (a, mid)
        start, count = b, n(b)
        a, c = start, high
        while c - a > fine and a < (mid := (a + c) / 2) < c:
            a, c = (mid, c) if n(mid) <= count else (a, mid)
        if a - start > 16 * len(diagonal) * np.finfo(float).eps or count >= n(high):
            return start, a, count
        wanted = count + 1


def intervals(diagonal: np.ndarray, off: np.ndarray, leading: int) -> list[tuple[float, float, int]]:
    """Disjoint intervals (low, high, eigenvalues inside) that hold the ``leading`` largest eigenvalues, cut where the spectrum has gaps.

    Of cuts that leave up to ``WIDTH`` eigenvalues in an interval, the lowest counts whose
    gap is a good part of the interval, else the one with the widest gap for its interval.
    """
    n = len(diagonal)
    reach = np.abs(diagonal) + np.append(np.abs(off), 0) + np.append(0, np.abs(off))
    bound = float(reach.max()) * (1 + 1e-12) + np.finfo(float).tiny
    out, high, rest = [], bound, n
    while n - rest < leading:
        least, most, _ = _edges(diagonal, off, rest, -bound, high)  # the largest eigenvalue left
        best = None
        for goal in range(rest - 1, max(-1, rest - 1 - WIDTH), -1):
            low, up, count = _edges(diagonal, off, goal, -bound, high) if goal else (-bound, -bound, 0)
            if count >= rest:
                continue
            if not goal:
                up = _edges(diagonal, off, 1, -bound, high)[0]
                low = 2 * up - least - 1e-3 * bound
            cut = (low + up) / 2
            part = (up - low) / (least - cut)
            if best is None or part > best[0] or part > 0.05:
                best = (part, cut, count)
            if n - count >= leading and part > 0.05:
                break
        if best is None:  # one cluster to the end
            best = (1.0, -bound, 0)
        _, low, count = best
        out.append((low, min(high, least + max((least - low) / 10, 1e-14 * bound)), rest - count))
        high, rest = low, count
    return out


def project(a: np.ndarray, low: float, high: float, y: np.ndarray) -> np.ndarray:
    """``y`` projected on the eigenvectors of eigenvalues between ``low`` and ``high``: shifted solves on a circle."""
    x, weights = np.polynomial.legendre.leggauss(NODES)
    centre, radius = (low + high) / 2, (high - low) / 2
    eye, out = np.eye(len(a)), np.zeros_like(y)
    for t, w in zip(np.exp(1j * np.pi / 2 * (1 - x)), weights):
        z = centre + radius * t
        # The lower half circle gives the conjugates.
        out += (w / 2) * (radius * t * np.linalg.solve(z * eye - a, y.astype(complex))).real
    return out


def _ritz(a: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of ``a`` restricted to the span of ``q``."""
    q, _ = np.linalg.qr(q)
    small = q.T @ a @ q
    values, rotation = np.linalg.eigh((small + small.T) / 2)
    return values, q @ rotation


def _interval_pairs(a: np.ndarray, low: float, high: float, inside: int, random: np.random.Generator) -> np.ndarray:
    """Eigenvectors of the ``inside`` eigenvalues between ``low`` and ``high`` of a matrix of norm about one; raises if some stay missing."""
    n = len(a)
    y = random.standard_normal((n, min(n, inside + max(6, inside))))
    best, kept = np.inf, None
    for _ in range(ROUNDS):
        values, vectors = _ritz(a, project(a, low, high, y))
        here = (values > low) & (values < high)
        if here.sum() == inside:
            residual = np.abs(a @ vectors[:, here] - vectors[:, here] * values[here]).max()
            done = best < 1e-13 and residual > best / 2
            if residual < best:
                best, kept = residual, vectors[:, here]
            if done:
                break
        y = vectors
    if kept is None or best > 1e-10:
        raise ArithmeticError(f"{inside} eigenvalues lie between {low} and {high}, not all were found")
    return kept


def leading_pairs(a: np.ndarray, leading: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``leading`` largest eigenvalues of a positive semidefinite matrix, falling, and their unit eigenvectors as columns.

    Eigenvalues that rounding cannot tell from zero are left out, so there can be fewer.
    Every interval yields as many pairs as inertia counts in it, or this raises.  A last
    Rayleigh-Ritz step over all of them makes vectors of different intervals orthogonal.
    """
    n = len(a)
    scale = float(np.abs(a).max()) if n else 0.0
    if scale == 0:
        return np.empty(0), np.empty((n, 0))
    b = (a + a.T) / (2 * scale)
    diagonal, off = tridiagonal(b)
    leading = min(leading, n - below(diagonal, off, 16 * n * np.finfo(float).eps))
    if leading == 0:
        return np.empty(0), np.empty((n, 0))
    random = np.random.default_rng(7)
    found = [_interval_pairs(b, low, high, inside, random) for low, high, inside in intervals(diagonal, off, leading)]
    values, vectors = _ritz(b, np.concatenate(found, axis=1))
    order = np.argsort(-values)[:leading]
    return values[order] * scale, vectors[:, order]

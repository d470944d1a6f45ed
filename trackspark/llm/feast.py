"""Eigenpairs of a symmetric matrix by contour integration, one interval of the spectrum at a time (numpy).

For an interval, the resolvent is integrated along a circle around it: a quadrature of solves with complex
shifts turns any vectors into their parts in the eigenspace of the interval. A Rayleigh-Ritz step on these
vectors gives eigenpairs, and repeating both refines them. How many there must be is known beforehand from the
inertia of the matrix shifted to the interval's ends, so that none can be missed unseen.
"""

from __future__ import annotations

import numpy as np

NODES = 8  # of the quadrature on a half circle; the other half is its conjugate
MOST_ROUNDS = 100


def count_below(a: np.ndarray, shift: float) -> int:
    """The number of eigenvalues below ``shift``: the negative ones of a block-diagonal factor (1 x 1 and 2 x 2
    blocks, complete pivoting), which has the inertia of the shifted matrix."""
    m = a - shift * np.eye(len(a))
    below = 0
    while len(m):
        size = np.abs(m)
        r = int(size.diagonal().argmax())
        i, j = np.unravel_index(int(size.argmax()), m.shape)
        if size[r, r] >= (1 + np.sqrt(17)) / 8 * size[i, j]:
            if size[r, r] == 0:
                return below
            block = np.array([r])
            below += int(m[r, r] < 0)
        else:
            block = np.array([i, j])
            below += 1  # its determinant is negative: one eigenvalue of each sign
        rest = np.setdiff1d(np.arange(len(m)), block)
        side = m[np.ix_(rest, block)]
        m = m[np.ix_(rest, rest)] - side @ np.linalg.solve(m[np.ix_(block, block)], side.T)
        m = (m + m.T) / 2
    return below


def clear(a: np.ndarray, at: float, low: float, high: float, below: int) -> float:
    """``at``, which has ``below`` eigenvalues below it, moved to about the middle of the gap that it lies in."""

    def room(far: float) -> float:
        step = far
        while abs(step) > 1e-14 * abs(far) and count_below(a, at + step) != below:
            step /= 2
        return step

    return at + (room(high - at) + room(low - at)) / 2


def slices(a: np.ndarray, most: int, each: int = 8, floor: float = 1e-11) -> list[tuple[float, float, int]]:
    """Intervals (low, high, eigenvalues inside) that hold the ``most`` largest eigenvalues of a positive
    semidefinite matrix and at most ``each`` of them, or values too close to part. Values below ``floor`` of a
    bound of the largest count as zero and are left out."""
    d = len(a)
    top = float(np.abs(a).sum(1).max()) * (1 + 1e-9) if d else 0.0
    if top == 0 or not np.isfinite(top):
        return []
    zero = count_below(a, floor * top)
    found, waiting = [], [(clear(a, floor * top, 0, top, zero), top, zero, d)]
    while waiting:
        low, high, under, upto = waiting.pop()
        if d - upto >= most or under == upto:
            continue
        wide = high > 64 * low  # its circle would hardly tell apart the values at its low end
        if not wide and (upto - under <= each or high - low < 4e-10 * top):
            found.append((low, high, upto - under))
            continue
        at = (low * high) ** 0.5 if wide else (low + high) / 2
        below = count_below(a, at)
        at = clear(a, at, low, high, below)
        waiting += [(low, at, under, below), (at, high, below, upto)]
    return sorted(found)


def interval_pairs(a: np.ndarray, low: float, high: float, count: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Values and unit vectors (columns) of the ``count`` eigenvalues in the interval."""
    d = len(a)
    centre, radius = (low + high) / 2, max((high - low) / 2, 1e-12 * abs(high))
    x, w = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(1j * np.pi / 2 * (1 - x))
    tolerance = 64 * np.finfo(float).eps * np.abs(a).sum(1).max()
    width = min(d, count + max(4, count // 2))
    basis = np.random.default_rng(seed).standard_normal((d, width))
    eye = np.eye(d)
    for _ in range(MOST_ROUNDS):
        part = sum(wk / 2 * (radius * tk * np.linalg.solve((centre + radius * tk) * eye - a, basis)).real for wk, tk in zip(w, turn))
        q, scale, _ = np.linalg.svd(part, full_matrices=False)
        q = q[:, scale > 1e-14 * scale[0]]
        values, turned = np.linalg.eigh(q.T @ a @ q)
        basis = q @ turned
        inside = np.flatnonzero((values >= low) & (values < high))
        if len(inside) == count:
            off = np.linalg.norm(a @ basis[:, inside] - basis[:, inside] * values[inside], axis=0).max()
            if off <= tolerance:
                return values[inside], basis[:, inside]
        if basis.shape[1] < width:  # directions that the filter put out come back as new ones
            more = np.random.default_rng(seed + 1).standard_normal((d, width - basis.shape[1]))
            basis = np.concatenate([basis, more], 1)
    raise ArithmeticError(f"{len(inside)} of {count} eigenvalues found in [{low}, {high})")

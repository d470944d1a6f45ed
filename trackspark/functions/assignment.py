"""Optimal assignment of a small cost matrix (numpy)."""

from __future__ import annotations

import numpy as np


def assign(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a least-cost assignment of min(shape) pairs.

    Rows enter one by one; each looks for the shortest augmenting path under the reduced costs of the
    potentials so far. Costs must be finite.
    """
    if cost.shape[0] > cost.shape[1]:
        columns, rows = assign(cost.T)
        order = np.argsort(rows)
        return rows[order], columns[order]
    n, m = cost.shape
    u, v = np.zeros(n), np.zeros(m)
    row_of = np.full(m, -1)
    for start in range(n):
        near = np.full(m, np.inf)
        came = np.full(m, -1)
        done = np.zeros(m, bool)
        row, reach, end, tree = start, 0.0, -1, []
        while end < 0:
            tree.append(row)
            step = reach + cost[row] - u[row] - v
            better = ~done & (step < near)
            near[better], came[better] = step[better], row
            column = int(np.where(done, np.inf, near).argmin())
            reach, done[column] = near[column], True
            if row_of[column] < 0:
                end = column
            else:
                row = row_of[column]
        reached = np.flatnonzero(done)
        for r in tree:
            mine = np.flatnonzero(row_of == r)
            u[r] += reach - (near[mine[0]] if len(mine) else 0.0)
        v[reached] -= reach - near[reached]
        while end >= 0:
            row = came[end]
            before = np.flatnonzero(row_of == row)
            row_of[end] = row
            end = int(before[before != end][0]) if row != start else -1
    columns = np.flatnonzero(row_of >= 0)
    order = np.argsort(row_of[columns])
    return row_of[columns][order], columns[order]


def assign_allowed(cost: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The most allowed pairs, of these the least cost; pairs that are not allowed never come out."""
    spread = np.abs(cost[allowed]).sum() + 1.0 if allowed.any() else 1.0
    rows, columns = assign(np.where(allowed, cost, spread * 2))
    keep = allowed[rows, columns]
    return rows[keep], columns[keep]

"""Small image kernels (numpy): distance transform, fills, pieces, boundaries, hulls, morphology."""

from __future__ import annotations

import numpy as np


def distance_transform(mask: np.ndarray) -> np.ndarray:
    """Exact Euclidean distance of each set pixel to the nearest unset one (inf if there is none).

    Rows first: distance to the nearest unset pixel of the column. Then per row the lower envelope is
    taken as a minimum over columns, in blocks."""
    h, w = mask.shape
    up = np.where(mask, np.inf, 0.0)
    for r in range(1, h):
        up[r] = np.minimum(up[r], up[r - 1] + 1)
    for r in range(h - 2, -1, -1):
        up[r] = np.minimum(up[r], up[r + 1] + 1)
    across = (np.arange(w)[:, None] - np.arange(w)[None, :]) ** 2.0
    out = np.empty((h, w))
    for r in range(h):
        out[r] = (up[r] ** 2 + across).min(1)
    return np.sqrt(np.where(mask, out, 0.0))


def pieces(mask: np.ndarray, diagonal: bool = True) -> tuple[np.ndarray, int]:
    """Connected pieces numbered from 1 in order of their first pixel, and their number: labels fall to the
    least of their neighbourhood and jump until none changes."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    big = mask.size + 1
    moves = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    while True:
        new = np.where(mask, label, big)
        for dr, dc in moves:
            a = (slice(0, mask.shape[0] - dr), slice(max(0, -dc), mask.shape[1] - max(0, dc)))
            b = (slice(dr, mask.shape[0]), slice(max(0, dc), mask.shape[1] + min(0, dc)))
            both = mask[a] & mask[b]
            low = np.where(both, np.minimum(new[a], new[b]), big)
            new[a] = np.minimum(new[a], low)
            new[b] = np.minimum(new[b], low)
        new = np.where(mask, new, 0)
        flat = np.concatenate([[0], new.ravel()])
        new = np.where(mask, flat[new], 0)
        if (new == label).all():
            break
        label = new
    ids, inverse = np.unique(label, return_inverse=True)
    number = np.arange(len(ids)) if ids[0] == 0 else np.arange(1, len(ids) + 1)
    return number[inverse].reshape(mask.shape), int(number[-1])


def _steps(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each k the whole numbers of [low[k], high[k]]: (k, number) one after another."""
    n = np.maximum(high - low + 1, 0)
    k = np.repeat(np.arange(len(n)), n)
    return k, low[k] + np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)


def runs_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last places of runs of equal values."""
    ends = np.append(np.flatnonzero(values[1:] != values[:-1]) + 1, len(values))
    return np.append(0, ends[:-1]), ends


def fill_polygons(points: np.ndarray, first: np.ndarray, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pixels inside or on many polygons, as runs along rows: (polygon, row, first column, last column).

    ``points`` are the (row, col) vertices of all polygons one after another; polygon k's begin at ``first[k]`` and are
    cut to ``size[k]`` pixels from ``low[k]``. All polygons are drawn at once, each on its own part of one canvas.

    A table of edges by the rows that they cross gives the crossings of each row; a pixel is inside where an odd
    number of them lies to one side of it. Edges themselves are drawn row by row, flat ones column by column. The work
    is in line with the edges' rows and the pixels."""
    of = np.repeat(np.arange(len(low)), np.diff(np.append(first, len(points))))
    p = np.asarray(points, float) - low[of]
    after = np.arange(1, len(p) + 1)
    after[np.append(first, len(p))[1:][np.diff(np.append(first, len(p))) > 0] - 1] = first[np.diff(np.append(first, len(p))) > 0]
    q = p[after]
    size = np.asarray(size, np.int64)
    stride = size[:, 1] + 1  # a column past the last keeps rows apart
    base = np.cumsum(size[:, 0] * stride) - size[:, 0] * stride
    total = int((size[:, 0] * stride).sum())
    bound = size[of]
    lo, hi = np.ceil(np.minimum(p[:, 0], q[:, 0])), np.ceil(np.maximum(p[:, 0], q[:, 0])) - 1
    k, row = _steps(np.clip(lo, 0, bound[:, 0]).astype(int), np.clip(hi, -1, bound[:, 0] - 1).astype(int))
    at = p[k, 1] + (row - p[k, 0]) * (q[k, 1] - p[k, 1]) / (q[k, 0] - p[k, 0])
    crossings = np.bincount(base[of[k]] + row * stride[of[k]] + np.clip(np.ceil(at), 0, bound[k, 1]).astype(int), minlength=total)
    out = (np.cumsum(crossings) % 2).astype(bool)  # a row of a closed polygon has an even number of them
    d = q - p
    for axis in (0, 1):  # steep edges by rows, flat ones by columns
        other = 1 - axis
        mine = np.flatnonzero(np.abs(d[:, axis]) >= np.abs(d[:, other]) if axis == 0 else np.abs(d[:, 1]) > np.abs(d[:, 0]))
        a, b, own = p[mine], q[mine], of[mine]
        least, most = np.minimum(a, b), np.maximum(a, b)
        k, s = _steps(np.clip(np.ceil(least[:, axis]), 0, size[own, axis]).astype(int), np.clip(np.floor(most[:, axis]), -1, size[own, axis] - 1).astype(int))
        along, across = (b - a)[k, axis], (b - a)[k, other]
        line = a[k, other] + (s - a[k, axis]) * across / np.where(along == 0, 1, along)
        for shift in (-1, 0, 1):
            o = np.rint(line).astype(int) + shift
            near = np.abs(along * (o - a[k, other]) - across * (s - a[k, axis])) <= 0.5 * np.maximum(np.abs(along), 1e-9)
            near &= (o >= least[k, other]) & (o <= most[k, other]) & (o >= 0) & (o < size[own[k], other])
            r, c = (s[near], o[near]) if axis == 0 else (o[near], s[near])
            out[base[own[k[near]]] + r * stride[own[k[near]]] + c] = True
    edge = np.flatnonzero(np.diff(np.concatenate([[False], out, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2] - 1
    owner = np.searchsorted(base, start, "right") - 1
    row, col = np.divmod(start - base[owner], stride[owner])
    return owner, row + low[owner, 0].astype(np.int64), col + low[owner, 1].astype(np.int64), end - start + col + low[owner, 1].astype(np.int64)


def fill_polygon(contour: np.ndarray, h: int, w: int) -> np.ndarray:
    """Pixels inside or on a polygon of (row, col) vertices, cut to the image."""
    out = np.zeros((h, w), bool)
    _, row, first, last = fill_polygons(np.asarray(contour, float), np.zeros(1, np.int64), np.zeros((1, 2)), np.array([[h, w]]))
    k, column = _steps(first, last)
    out[row[k], column] = True
    return out


def holes_filled(mask: np.ndarray) -> np.ndarray:
    """The mask with background that does not reach the border filled."""
    outer = np.pad(~mask, 1, constant_values=True)
    label, _ = pieces(outer, diagonal=False)
    return ~(label == label[0, 0])[1:-1, 1:-1]


_AROUND = [(0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1)]
#: By the direction of a step: where the place tried before lies from the new one.
_BACK = [_AROUND.index((_AROUND[d - 1][0] - r, _AROUND[d - 1][1] - c)) for d, (r, c) in enumerate(_AROUND)]


def boundary(mask: np.ndarray) -> np.ndarray:
    """Outer boundary of a piece, clockwise from its first pixel, by following neighbours."""
    w = mask.shape[1] + 2
    flat = np.pad(mask, 1).astype(np.uint8).tobytes()
    step = [r * w + c for r, c in _AROUND]
    start = at = flat.index(1)
    path, came, first_move = [start], 0, None
    while True:
        for k in range(1, 9):
            d = (came + k) % 8
            to = at + step[d]
            if flat[to]:
                break
        else:
            break
        if first_move is None:
            first_move = to
        elif at == start and to == first_move:
            path.pop()
            break
        path.append(to)
        at, came = to, _BACK[d]
    return np.stack(np.divmod(np.array(path), w), 1) - 1


def united(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the least node of its connected component; a[k] and b[k] are linked. Roots move to the
    least root that they are linked with, then nodes jump to their roots."""
    root = np.arange(n)
    while True:
        p, q = root[a], root[b]
        apart = p != q
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
        while (root != root[root]).any():
            root = root[root]


def runs_and_pieces(group: np.ndarray, r: np.ndarray, c: np.ndarray, more: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pixels in order of (group, r, c) as runs along rows: the places of each run's first and last pixel, and the
    number of the first run of its connected piece. Runs of neighbouring rows of one group meet if they share a column,
    or come as near as ``more`` columns."""
    row_new = np.append(True, (group[1:] != group[:-1]) | (r[1:] != r[:-1]))
    new = row_new | np.append(True, np.diff(c) > 1)
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(r)) - 1
    row = np.cumsum(row_new)[start]  # from 1
    first_of = np.flatnonzero(row_new)
    above = np.append(False, (group[first_of[1:]] == group[first_of[:-1]]) & (np.diff(r[first_of]) == 1))[row - 1]
    low = c.min() - more - 1
    wide = c.max() + more + 2 - low
    f, l = c[start] - low, c[end] - low
    lo = np.searchsorted(row * wide + l, (row - 1) * wide + f - more, "left")
    hi = np.searchsorted(row * wide + f, (row - 1) * wide + l + more, "right")
    k, other = _steps(np.where(above, lo, 0), np.where(above, hi, 0) - 1)
    return start, end, united(k, other, len(start))


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise, of distinct points."""
    pts = points[np.lexsort((points[:, 1], points[:, 0]))]
    pts = pts[np.append(True, (pts[1:] != pts[:-1]).any(1))[: len(pts)]]
    if len(pts) < 3:
        return pts
    # of points with one first coordinate only the outer two can be corners
    turn = pts[1:, 0] != pts[:-1, 0]
    pts = pts[np.append(True, turn) | np.append(turn, True)].tolist()

    def half(seq):
        out = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def polygon_area(points: np.ndarray) -> float:
    p, q = points, np.roll(points, -1, 0)
    return float(abs((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum()) / 2)


def slide(image: np.ndarray, size: int, largest: bool) -> np.ndarray:
    """Largest or least value in a square window of odd or even size around each pixel."""
    f, low = (np.maximum, -np.inf) if largest else (np.minimum, np.inf)
    before, after = size // 2, size - 1 - size // 2
    out = image.astype(float)
    for axis in (0, 1):
        padded = np.pad(out, [(before, after) if a == axis else (0, 0) for a in (0, 1)], constant_values=low)
        n = out.shape[axis]
        out = np.take(padded, np.arange(n), axis)
        for k in range(1, size):
            out = f(out, np.take(padded, np.arange(k, k + n), axis))
    return out


def resize_by(mask: np.ndarray, scale: float) -> np.ndarray:
    """A mask grown (scale > 0) or shrunk (scale < 0) with a square of ceil(2 r |scale| + 1) pixels, r the
    radius of a disc of its area."""
    if scale == 0:
        return mask.copy()
    size = int(np.ceil(2 * np.sqrt(mask.sum() / np.pi) * abs(scale) + 1))
    return slide(mask, size, scale > 0) > 0


def clip_polygon(points: list, h: float, w: float) -> list:
    """A polygon cut to [0, h] x [0, w], side by side."""
    for axis, bound, keep_low in ((1, 0.0, False), (0, h, True), (1, w, True), (0, 0.0, False)):
        inside = lambda p: p[axis] <= bound if keep_low else p[axis] >= bound  # noqa: B023, E731
        out = []
        for p, q in zip(points[-1:] + points[:-1], points):
            if inside(p) != inside(q):
                t = (bound - p[axis]) / (q[axis] - p[axis])
                out.append([p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])])
            if inside(q):
                out.append(list(q))
        points = out
        if not points:
            break
    return points

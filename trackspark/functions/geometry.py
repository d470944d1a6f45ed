"""Geometry as column functions (F1 to F9, F11, F12, F17, F21). A contour is an array of (row, col)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _axis(contour, k: int) -> Column:
    return F.transform(_c(contour), lambda p: F.get(p, F.lit(k)))


def bbox_inclusive(contour) -> Column:
    """least and largest row and column."""
    x, y = _axis(contour, 0), _axis(contour, 1)
    return F.struct(F.array_min(x).alias("x1"), F.array_min(y).alias("y1"), F.array_max(x).alias("x2"), F.array_max(y).alias("y2"))


def bbox_exclusive(contour) -> Column:
    """cut to integers, the upper ends plus 1."""
    b = bbox_inclusive(contour)
    whole = lambda c: b[c].cast("long")
    return F.struct(whole("x1").alias("x1"), whole("y1").alias("y1"), (whole("x2") + 1).alias("x2"), (whole("y2") + 1).alias("y2"))


def _next(contour) -> Column:
    """The contour turned by one point."""
    c = _c(contour)
    return F.concat(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, 1, 1))


def signed_area(contour) -> Column:
    """shoelace formula; the sign tells the orientation."""
    terms = F.zip_with(_c(contour), _next(contour), lambda p, q: F.get(p, F.lit(0)) * F.get(q, F.lit(1)) - F.get(q, F.lit(0)) * F.get(p, F.lit(1)))
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2


def area(contour) -> Column:
    """F2."""
    return F.abs(signed_area(contour))


def oriented(contour) -> Column:
    """reversed where the signed area is negative."""
    return F.when(signed_area(contour) < 0, F.reverse(_c(contour))).otherwise(_c(contour))


def steps(contour, closed: bool = False) -> Column:
    """distance of each point to the next."""
    d = F.zip_with(
        _c(contour), _next(contour),
        lambda p, q: F.sqrt(F.pow(F.get(q, F.lit(0)) - F.get(p, F.lit(0)), 2) + F.pow(F.get(q, F.lit(1)) - F.get(p, F.lit(1)), 2)),
    )
    return d if closed else F.slice(d, 1, F.greatest(F.size(d) - 1, F.lit(0)))


def length(contour, closed: bool = False) -> Column:
    """F3."""
    return F.aggregate(steps(contour, closed), F.lit(0.0), lambda a, x: a + x)


def cumulative(contour, closed: bool = False) -> Column:
    """distance from the start to each point."""
    return F.aggregate(steps(contour, closed), F.array(F.lit(0.0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))


def centroid(contour) -> Column:
    """mean of the points."""
    mean = lambda k: F.aggregate(_axis(contour, k), F.lit(0.0), lambda a, x: a + x) / F.size(_c(contour))
    return F.struct(mean(0).alias("x"), mean(1).alias("y"))


def box_shape(x1, y1, x2, y2) -> Column:
    """centre, size and aspect ratio (null for an empty side)."""
    h, w = _c(x2) - _c(x1), _c(y2) - _c(y1)
    return F.struct(((_c(x1) + _c(x2)) / 2).alias("cx"), ((_c(y1) + _c(y2)) / 2).alias("cy"), h.alias("h"), w.alias("w"), F.try_divide(h, w).alias("aspect"))


def _inter(ax1, ay1, ax2, ay2, bx1, by1, bx2, by2) -> tuple[Column, Column, Column]:
    i = F.greatest(F.least(_c(ax2), _c(bx2)) - F.greatest(_c(ax1), _c(bx1)), F.lit(0)) * F.greatest(F.least(_c(ay2), _c(by2)) - F.greatest(_c(ay1), _c(by1)), F.lit(0))
    return i, (_c(ax2) - _c(ax1)) * (_c(ay2) - _c(ay1)), (_c(bx2) - _c(bx1)) * (_c(by2) - _c(by1))


def box_iou(*boxes) -> Column:
    """intersection over union of two boxes; 0 if both are empty."""
    i, a, b = _inter(*boxes)
    return F.coalesce(F.try_divide(i, a + b - i), F.lit(0.0))


def box_iomin(*boxes) -> Column:
    """intersection over the smaller area; 0 if that is empty."""
    i, a, b = _inter(*boxes)
    return F.coalesce(F.try_divide(i, F.least(a, b)), F.lit(0.0))


def pad_box(x1, y1, x2, y2, padding, h, w) -> Column:
    """padded and cut to the image."""
    p = _c(padding) if not isinstance(padding, int) else F.lit(padding)
    zero = F.lit(0)
    return F.struct(
        F.greatest(_c(x1) - p, zero).alias("x1"), F.greatest(_c(y1) - p, zero).alias("y1"), F.least(_c(x2) + p, F.lit(h)).alias("x2"), F.least(_c(y2) + p, F.lit(w)).alias("y2")
    )


def box_xywh(x1, y1, x2, y2) -> Column:
    """(column, row, width, height)."""
    return F.struct(_c(y1).alias("x"), _c(x1).alias("y"), (_c(y2) - _c(y1)).alias("w"), (_c(x2) - _c(x1)).alias("h"))


def box_state(x1, y1, x2, y2) -> Column:
    """centre, area and ratio, as a tracker measures boxes."""
    w, h = _c(x2) - _c(x1), _c(y2) - _c(y1)
    return F.struct((_c(x1) + w / 2).alias("x"), (_c(y1) + h / 2).alias("y"), (w * h).alias("s"), F.try_divide(w, h).alias("r"))


def state_box(x, y, s, r) -> Column:
    """and back."""
    w = F.sqrt(_c(s) * _c(r))
    h = F.try_divide(_c(s), w)
    return F.struct((_c(x) - w / 2).alias("x1"), (_c(y) - h / 2).alias("y1"), (_c(x) + w / 2).alias("x2"), (_c(y) + h / 2).alias("y2"))


def shifted(contour, dx, dy) -> Column:
    """F8: moved; by the negative corner of a crop: into its coordinates."""
    return F.transform(_c(contour), lambda p: F.array(F.get(p, F.lit(0)) + _c(dx), F.get(p, F.lit(1)) + _c(dy)))


def clipped(contour, h, w) -> Column:
    """F8: each point moved into [0, h - 1] x [0, w - 1]."""
    into = lambda v, n: F.least(F.greatest(v, F.lit(0.0)), F.lit(float(n - 1)))
    return F.transform(_c(contour), lambda p: F.array(into(F.get(p, F.lit(0)), h), into(F.get(p, F.lit(1)), w)))


def in_bounds(contour, h, w) -> Column:
    """F8: all points in [0, h) x [0, w)."""
    return F.forall(_c(contour), lambda p: (F.get(p, F.lit(0)) >= 0) & (F.get(p, F.lit(0)) < h) & (F.get(p, F.lit(1)) >= 0) & (F.get(p, F.lit(1)) < w))


def contains_point(contour, x, y) -> Column:
    """even-odd rule over the edges."""
    x, y = _c(x), _c(y)

    def crosses(p: Column, q: Column) -> Column:
        px, py, qx, qy = F.get(p, F.lit(0)), F.get(p, F.lit(1)), F.get(q, F.lit(0)), F.get(q, F.lit(1))
        spans = (py > y) != (qy > y)
        at = px + F.try_divide((y - py) * (qx - px), qy - py)
        return F.coalesce(spans & (x < at), F.lit(False)).cast("int")

    hits = F.zip_with(_c(contour), _next(contour), crosses)
    return F.aggregate(hits, F.lit(0), lambda a, b: a + b) % 2 == 1


def subsample(contour, k: int) -> Column:
    """every step-th point, step = max(1, int(n / k)); may keep more than k."""
    c = _c(contour)
    step = F.greatest(F.lit(1), F.floor(F.size(c) / k).cast("int"))
    return F.filter(c, lambda p, i: i % step == 0)


def rotated_start(contour, k) -> Column:
    """the contour from its point k on, then the points before."""
    c, i = _c(contour), F.lit(k) if isinstance(k, int) else _c(k)
    return F.concat(F.slice(c, i + 1, F.greatest(F.size(c) - i, F.lit(0))), F.slice(c, 1, i))


def square_around(x, y, size: int, h: int | None = None, w: int | None = None) -> Column:
    """a square contour of half side size / 2 around a point, cut to the image."""
    half = size / 2
    lo = lambda v: F.greatest(v - half, F.lit(0.0))
    hi = lambda v, n: v + half if n is None else F.least(v + half, F.lit(float(n - 1)))
    a, b, c, d = lo(_c(x)), lo(_c(y)), hi(_c(x), h), hi(_c(y), w)
    return F.array(F.array(a, b), F.array(a, d), F.array(c, d), F.array(c, b))


def onehot_name(vector, names: tuple[str, ...] = ("overseg", "underseg", "dropout", "correct")) -> Column:
    """name of the first largest entry."""
    v = _c(vector)
    return F.coalesce(F.get(F.array(*map(F.lit, names)), (F.array_position(v, F.array_max(v)) - 1).cast("int")), F.lit("unknown"))


def rms_distance(a, b) -> Column:
    """root mean square distance of paired points."""
    d = F.zip_with(_c(a), _c(b), lambda p, q: F.pow(F.get(q, F.lit(0)) - F.get(p, F.lit(0)), 2) + F.pow(F.get(q, F.lit(1)) - F.get(p, F.lit(1)), 2))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x) / F.size(_c(a)))

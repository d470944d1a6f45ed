"""Contour work beyond column functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackspark.functions import raster
from trackspark.functions.graph import Rounds
from trackspark.schema import extended

from .evaluate import covariance, principal_axes

CONTOUR = "array<array<double>>"


def _array(x) -> np.ndarray:
    return np.array([list(p) for p in x], float).reshape(-1, 2)


def _mapped(function) -> callable:
    """A contour-to-contour function as a vectorised column function; null stays null."""

    def over(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda x: None if x is None else function(_array(x)).tolist())

    over.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(over, CONTOUR)


def _stacked(function) -> callable:
    """``_mapped`` for a function of many contours with equally many points: (contours, points, 2) to the same form.
    Those of a batch go through it together and stay Arrow arrays, so that a contour costs no call."""

    def over(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            n = b.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            points = b.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, 2)
            first, out = np.cumsum(n) - n, np.empty_like(points)
            for k in np.unique(n[n > 0]):
                at = (first[n == k][:, None] + np.arange(k)).ravel()
                out[at] = function(points[at].reshape(-1, k, 2)).reshape(-1, 2)
            pairs = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * 2, pa.int32()), pa.array(out.ravel()))
            yield pa.ListArray.from_arrays(pa.array(np.append(first, len(out)), pa.int32()), pairs, mask=b.is_null())

    over.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(over, CONTOUR)


def clip_polygon(contour: Column, h: float, w: float) -> Column:
    """cut to [0, h] x [0, w]."""
    return _mapped(lambda p: np.array(raster.clip_polygon(p.tolist(), h, w), float).reshape(-1, 2))(contour)


def axis_aligned(contour: Column) -> Column:
    """centred, turned so that its longest extent lies along the first axis."""

    def turn(p: np.ndarray) -> np.ndarray:
        q = p - p.mean(1, keepdims=True)
        _, _, v = np.linalg.svd(q, full_matrices=p.shape[1] < 2)
        v = v * np.where(np.take_along_axis(v, np.abs(v).argmax(2)[:, :, None], 2) < 0, -1, 1)
        return q @ v.transpose(0, 2, 1)

    return _stacked(turn)(contour)


def resampled(contour: Column, n: int) -> Column:
    """n points at even arc length along the closed contour."""

    def even(p: np.ndarray) -> np.ndarray:
        q = np.concatenate([p, p[:1]])
        at = np.concatenate([[0.0], np.cumsum(np.sqrt((np.diff(q, axis=0) ** 2).sum(1)))])
        to = np.arange(n) * at[-1] / n
        return np.stack([np.interp(to, at, q[:, k]) for k in (0, 1)], 1)

    return _mapped(even)(contour)


def rigid_aligned(df: DataFrame, a: str, b: str, scale: bool = False) -> DataFrame:
    """b turned and moved (and scaled) onto a of as many points: aligned, and distance, the root mean
    square distance that is left."""
    schema = extended(df.schema, aligned=CONTOUR, distance="double")

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            out = []
            for x, y in zip(t[a], t[b]):
                p, q = _array(x), _array(y)
                pm, qm = p.mean(0), q.mean(0)
                u, s, v = np.linalg.svd((q - qm).T @ (p - pm))
                sign = np.diag([1.0, np.sign(np.linalg.det(u @ v)) or 1.0])
                k = (s * np.diag(sign)).sum() / max(((q - qm) ** 2).sum(), 1e-300) if scale else 1.0
                z = k * (q - qm) @ u @ sign @ v + pm
                out.append((z.tolist(), float(np.sqrt(((z - p) ** 2).sum(1).mean()))))
            yield t.assign(aligned=[o[0] for o in out], distance=[o[1] for o in out])

    return df.mapInPandas(align, schema)


def contour_distances(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """least distance between the points of two contours. One array of a row against the other: built in."""
    d = lambda p, q: F.pow(F.get(p, F.lit(0)) - F.get(q, F.lit(0)), F.lit(2)) + F.pow(F.get(p, F.lit(1)) - F.get(q, F.lit(1)), F.lit(2))
    least = F.array_min(F.transform(a, lambda p: F.array_min(F.transform(b, lambda q: d(p, q)))))
    return pairs.withColumn("distance", F.sqrt(least))


def mean_contour(df: DataFrame, keys: list[str], contour: str = "contour") -> DataFrame:
    """Per keys the mean of the i-th points; contours of different sizes are an error."""
    p = df.select(*keys, F.size(contour).alias("__n"), F.posexplode(contour).alias("__i", "__p"))
    m = p.groupBy(*keys, "__i").agg(F.avg(F.get("__p", F.lit(0))).alias("r"), F.avg(F.get("__p", F.lit(1))).alias("c"), F.min("__n").alias("lo"), F.max("__n").alias("hi"))
    g = m.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__i", "r", "c"))).alias("pts"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    checked = F.when(F.col("lo") != F.col("hi"), F.raise_error(F.lit("contours differ in size"))).otherwise(F.transform("pts", lambda x: F.array(x["r"], x["c"])))
    return g.select(*keys, checked.alias("mean_contour"))


def shape_modes(df: DataFrame, id_col: str, contour: str = "contour", variance: float = 0.95) -> tuple[DataFrame, np.ndarray]:
    """Positions of contours (of one size) along the shape modes that hold ``variance``: (id, positions,
    normalized), and the modes. The matrix of 2n x 2n products is solved on the driver. The contours are written
    first: means, products and positions read them, and what made them runs once."""
    df = Rounds(df.sparkSession).write(df.select(id_col, contour), "contours")
    n = df.select(F.size(contour)).first()[0]
    flat = df.select(id_col, *[F.get(F.get(contour, F.lit(i)), F.lit(k)).alias(f"v{2 * i + k}") for i in range(n) for k in (0, 1)])
    names = [f"v{i}" for i in range(2 * n)]
    mean, cov = covariance(flat, names)
    values, vectors = principal_axes(cov)
    k = int(np.searchsorted(np.cumsum(values) / values.sum(), variance - 1e-12) + 1)
    vectors = vectors[:, :k]
    centred = F.array(*[F.col(c) - float(m) for c, m in zip(names, mean)])
    along = [F.aggregate(F.zip_with(F.col("__c"), F.array(*map(F.lit, vectors[:, i].tolist())), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) for i in range(k)]
    spread = [float(np.sqrt(v)) or 1.0 for v in values[:k]]
    out = flat.select(id_col, centred.alias("__c")).select(id_col, F.array(*along).alias("positions"))
    return out.withColumn("normalized", F.zip_with("positions", F.array(*map(F.lit, spread)), lambda a, b: a / b)), vectors

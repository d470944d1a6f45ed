"""Distance fields of label images.

Both take pixel tables (keys, r, c, label) whose rows are an image's pixels. ``size`` (height, width) names the image's
bounds; without it they are the largest row and column of the image's own pixels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackspark.functions import raster
from trackspark.functions.graph import Rounds
from trackspark.functions.groups import in_groups, numbers
from trackspark.schema import extended

TILE = 128


def _labelled(pixels: DataFrame, label: str, keys: list[str]) -> DataFrame:
    at = lambda c: F.col(c).cast("long").alias(c)
    return pixels.select(*keys, F.coalesce(F.col(label), F.lit(0)).cast("long").alias("label"), at("r"), at("c"))


def _with_size(p: DataFrame, keys: list[str], size: tuple[int, int] | None) -> DataFrame:
    """p with __h and __w, its image's height and width."""
    if size is not None:
        return p.withColumn("__h", F.lit(size[0]).cast("long")).withColumn("__w", F.lit(size[1]).cast("long"))
    return p.join(p.groupBy(*keys).agg((F.max("r") + 1).alias("__h"), (F.max("c") + 1).alias("__w")), keys)


def _distances(pixels: DataFrame, keys: list[str], label: str, size: tuple[int, int] | None) -> DataFrame:
    """The labelled pixels with ``distance`` and __top, the label's largest; both null where the label fills the image."""
    p = _with_size(_labelled(pixels, label, keys), keys, size).where("label <> 0")
    own = p.drop("__h", "__w").columns
    schema = extended(p.select(*own).schema, distance="double", __top="double")

    def measure(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        r, c, h, w = numbers(t, "r", "c", "__h", "__w")
        d, n = np.empty(len(r)), np.diff(np.append(starts, len(r)))
        for a, k in zip(starts.tolist(), n.tolist()):
            y, x = r[a : a + k], c[a : a + k]
            # the nearest other pixel lies in the label's box or the ring around it
            r0, c0 = max(y.min() - 1, 0), max(x.min() - 1, 0)
            mask = np.zeros((min(y.max() + 2, h[a]) - r0, min(x.max() + 2, w[a]) - c0), bool)
            mask[y - r0, x - c0] = True
            d[a : a + k] = raster.distance_transform(mask)[y - r0, x - c0]
        top = np.repeat(np.maximum.reduceat(d, starts), n)
        columns = [x.combine_chunks() for x in t.select(own).columns]
        yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, mask=np.isinf(x)) for x in (d, top))], schema.names)

    return in_groups(p, [*keys, "label"], [], measure, schema)


def distance_map(pixels: DataFrame, keys: list[str], label: str = "label", edt_max: float | None = None, size: tuple[int, int] | None = None) -> DataFrame:
    """Distance of each labelled pixel to the nearest pixel of the image that is not of its label (null where
    the label fills the image). With ``edt_max`` distances are scaled to 1 and more, so that the image's largest
    is that: d * (edt_max - 1) / max + 1. What lies beyond the image's bounds is no pixel."""
    d = _distances(pixels, keys, label, size).drop("__top")
    if edt_max is None:
        return d
    d = Rounds(pixels.sparkSession).write(d, "distances")  # measured once, read twice
    top = d.groupBy(*keys).agg(F.max("distance").alias("__top"))
    return d.join(top, keys).withColumn("distance", F.col("distance") * (edt_max - 1) / F.col("__top") + 1).drop("__top")


def distance_bytes(pixels: DataFrame, keys: list[str], label: str = "label", size: tuple[int, int] | None = None) -> DataFrame:
    """X5, as bytes: each label's distances scaled on their own, its largest to 255, and cut to whole numbers."""
    d = _distances(pixels, keys, label, size)
    return d.withColumn("distance", F.floor(F.col("distance") / F.col("__top") * 255).cast("int")).drop("__top")


def inner_boundaries(pixels: DataFrame, keys: list[str], label: str = "label", size: tuple[int, int] | None = None) -> DataFrame:
    """Labelled pixels with a pixel of another label, or of none, above, below, left or right of them in the image.
    A missing row inside the bounds is a pixel of no label."""
    p = _with_size(_labelled(pixels, label, keys), keys, size).where("label <> 0")
    column, row = Window.partitionBy(*keys, "c").orderBy("r"), Window.partitionBy(*keys, "r").orderBy("c")

    def differs(w, at: str, edge: str, by: int) -> Column:
        near = F.struct(F.lag(at, by).over(w).alias("at"), F.lag("label", by).over(w).alias("label"))
        same = (near["at"] == F.col(at) - by) & (near["label"] == F.col("label"))
        bound = F.col(at) == 0 if by > 0 else F.col(at) == F.col(edge) - 1
        return ~bound & ~F.coalesce(same, F.lit(False))

    p = p.withColumn("__v", differs(column, "r", "__h", 1) | differs(column, "r", "__h", -1))
    p = p.withColumn("__u", differs(row, "c", "__w", 1) | differs(row, "c", "__w", -1))
    return p.where("__v OR __u").drop("__v", "__u", "__h", "__w")


def _border_weights(tile: pd.DataFrame, edge: pd.DataFrame, w0: float, sigma: float, two: bool) -> np.ndarray:
    """The sum over labels of w0 * exp(-d^2 / 2 sigma^2), or the term of the two nearest labels, of a tile's pixels."""
    r, c = tile["r"].to_numpy(), tile["c"].to_numpy()
    columns, at_c = np.unique(c, return_inverse=True)
    rows, at_r = np.unique(r, return_inverse=True)
    total, first, second = np.zeros(len(r)), np.full(len(r), np.inf), np.full(len(r), np.inf)
    edge = edge.sort_values(["e_label", "e_r"])
    labels, e_r, e_c = (edge[k].to_numpy() for k in ("e_label", "e_r", "e_c"))
    for a, b in zip(*raster.runs_of(labels)) if len(labels) else ():
        # per row of the label the least distance to each column, then per pixel the least over these rows
        starts, _ = raster.runs_of(e_r[a:b])
        across = np.minimum.reduceat(((e_c[a:b, None] - columns) ** 2).astype(float), starts)
        d = np.full((len(rows), len(columns)), np.inf)
        for y, x in zip(e_r[a:b][starts], across):
            np.minimum(d, ((rows - y) ** 2)[:, None] + x, out=d)
        d = d[at_r, at_c]
        total += w0 * np.exp(-d / (2 * sigma**2))
        if two:
            d = np.sqrt(d)
            second = np.minimum(second, np.maximum(first, d))
            first = np.minimum(first, d)
    if not two:
        return total
    both = first if tile["__n"].iloc[0] == 1 else first + second
    return w0 * np.exp(-(both**2) / (2 * sigma**2))


def weight_map(
    pixels: DataFrame, keys: list[str], label: str = "label", w0: float = 20, sigma: float = 8, nearest_two: bool = False, size: tuple[int, int] | None = None, precision: float = 1e-10
) -> DataFrame:
    """Training weight of every pixel of the table: (keys, r, c, label, weight).

    A label's term at a pixel is w0 * exp(-d^2 / 2 sigma^2), d the distance to the label's inner boundary. The weight
    is the mean of all labels' terms, and on a label 1 - (its share of the image's pixels), over the number of labels.
    With ``nearest_two``: w0 * exp(-(d1 + d2)^2 / 2 sigma^2) of the two nearest labels (of the only one), and 1 - f on
    labels and f elsewhere, f the share of labelled pixels. Labels without a boundary (one that fills the image)
    have no term; images without a label have weight 0, or f.

    Terms below ``precision`` count as none: that bounds how far a boundary reaches, so that each tile of pixels
    gets the boundary pixels within that reach and tiles are independent.
    """
    reach = math.ceil(sigma * math.sqrt(2 * math.log(max(w0 / precision, 1.0))))
    p = _labelled(pixels, label, keys)
    tile = lambda c: F.expr(f"{c} div {TILE}")
    edge = inner_boundaries(pixels, keys, label, size)
    near = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / TILE), F.floor((F.col(c) + reach) / TILE)))
    edge = edge.withColumn("__tr", near("r")).withColumn("__tc", near("c"))
    edge = edge.select(*[F.col(c).alias(f"e_{c}") for c in edge.columns])
    per_label = p.groupBy(*keys, "label").agg(F.count("*").alias("__area"))
    image = per_label.groupBy(*keys).agg(F.sum("__area").alias("__all"), F.sum(F.when(F.col("label") != 0, F.col("__area")).otherwise(0)).alias("__on"), F.count(F.when(F.col("label") != 0, 1)).alias("__n"))
    if size is not None:
        image = image.withColumn("__all", F.lit(size[0] * size[1]))
    tiles = p.join(image.select(*keys, "__n"), keys).withColumn("__tr", tile("r")).withColumn("__tc", tile("c"))
    by, out = [*keys, "__tr", "__tc"], extended(p.schema, border="double")

    def one(_, pixels: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        if not len(pixels):
            return pd.DataFrame(columns=out.names)
        return pixels.assign(border=_border_weights(pixels, points, w0, sigma, nearest_two))[out.names]

    border = tiles.groupBy(*by).cogroup(edge.groupBy(*[f"e_{c}" for c in by])).applyInPandas(one, out)
    whole = border.join(per_label, [*keys, "label"]).join(image, keys)
    n, on = F.greatest("__n", F.lit(1)), F.col("label") != 0
    if nearest_two:
        weight = F.col("border") + F.when(on, 1 - F.col("__on") / F.col("__all")).otherwise(F.col("__on") / F.col("__all"))
    else:
        weight = (F.col("border") + F.when(on, 1 - F.col("__area") / F.col("__all")).otherwise(0.0)) / n
    return whole.select(*keys, "r", "c", "label", weight.alias("weight"))

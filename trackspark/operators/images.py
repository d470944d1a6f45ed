"""Image work on pixel tables and image rows.

Pixel tables (keys, r, c, label, value) serve what sums and joins can do. Kernels that need a whole region
or image get it as one group or row: the pixels of a region's box, or an image with its height and width.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trackspark.functions import raster
from trackspark.functions.graph import Rounds, components
from trackspark.functions.groups import heads, in_groups, numbers
from trackspark.functions.ranks import ranked
from trackspark.schema import extended

# -- region properties ----------------------------------------------------------------------------


def region_moments(pixels: DataFrame, keys: list[str], label: str = "label", value: str = "value") -> DataFrame:
    """Properties of each region from sums over its pixels: area, box, centroid, intensities, extent,
    diameter, central and normalised moments, inertia, axes, eccentricity, orientation, hu moments.

    Sums are taken about the region's lowest row and column, so powers stay small. Two aggregates: the
    corners, then the sums; both combine before the shuffle."""
    p = pixels.where(F.col(label) != 0).select(*keys, F.col(label).alias("label"), F.col("r").cast("double").alias("r"), F.col("c").cast("double").alias("c"), F.col(value).cast("double").alias("v"))
    corner = p.groupBy(*keys, "label").agg(F.min("r").alias("r0"), F.min("c").alias("c0"), F.max("r").alias("r1"), F.max("c").alias("c1"))
    p = p.join(corner, [*keys, "label"]).withColumn("y", F.col("r") - F.col("r0")).withColumn("x", F.col("c") - F.col("c0"))
    powers = [(i, j) for i in range(4) for j in range(4) if i + j <= 3]
    raw = {f"m{i}{j}": F.sum(F.pow("y", F.lit(i)) * F.pow("x", F.lit(j))) for i, j in powers}
    g = p.groupBy(*keys, "label", "r0", "c0", "r1", "c1").agg(
        *[s.alias(k) for k, s in raw.items()],
        F.min("v").alias("intensity_min"), F.max("v").alias("intensity_max"), F.avg("v").alias("intensity_mean"),
        F.sum(F.col("v") * F.col("y")).alias("vy"), F.sum(F.col("v") * F.col("x")).alias("vx"), F.sum("v").alias("vs"),
    )
    n, ym, xm = F.col("m00"), F.col("m10") / F.col("m00"), F.col("m01") / F.col("m00")
    g = g.withColumn("area", n.cast("long")).withColumn("ym", ym).withColumn("xm", xm)
    y, x = F.col("ym"), F.col("xm")
    m = lambda i, j: F.col(f"m{i}{j}")
    g = g.select(
        "*",
        (m(2, 0) - y * m(1, 0)).alias("mu20"), (m(1, 1) - y * m(0, 1)).alias("mu11"), (m(0, 2) - x * m(0, 1)).alias("mu02"),
        (m(3, 0) - 3 * y * m(2, 0) + 2 * y * y * m(1, 0)).alias("mu30"), (m(0, 3) - 3 * x * m(0, 2) + 2 * x * x * m(0, 1)).alias("mu03"),
        (m(2, 1) - 2 * y * m(1, 1) - x * m(2, 0) + 2 * y * y * m(0, 1)).alias("mu21"),
        (m(1, 2) - 2 * x * m(1, 1) - y * m(0, 2) + 2 * x * x * m(1, 0)).alias("mu12"),
    )
    mu = lambda k: F.col(f"mu{k}")
    g = g.select("*", *[(mu(f"{i}{j}") / F.pow(n, F.lit((i + j) / 2 + 1))).alias(f"nu{i}{j}") for i, j in powers if i + j >= 2])
    a, b, c = mu("02") / n, -mu("11") / n, mu("20") / n  # inertia tensor
    root = F.sqrt(F.pow((a - c) / 2, F.lit(2)) + b * b)
    g = g.withColumn("inertia_1", (a + c) / 2 + root).withColumn("inertia_2", F.greatest((a + c) / 2 - root, F.lit(0.0)))
    e20, e02, e11, e30, e12, e21, e03 = (F.col(f"nu{k}") for k in ("20", "02", "11", "30", "12", "21", "03"))
    s, t = e30 + e12, e21 + e03
    hu = [
        e20 + e02,
        (e20 - e02) * (e20 - e02) + 4 * e11 * e11,
        (e30 - 3 * e12) * (e30 - 3 * e12) + (3 * e21 - e03) * (3 * e21 - e03),
        s * s + t * t,
        (e30 - 3 * e12) * s * (s * s - 3 * t * t) + (3 * e21 - e03) * t * (3 * s * s - t * t),
        (e20 - e02) * (s * s - t * t) + 4 * e11 * s * t,
        (3 * e21 - e03) * s * (s * s - 3 * t * t) - (e30 - 3 * e12) * t * (3 * s * s - t * t),
    ]
    l1, l2 = F.col("inertia_1"), F.col("inertia_2")
    orientation = F.when(a == c, F.when(b < 0, np.pi / 4).otherwise(-np.pi / 4)).otherwise(0.5 * F.atan2(-2 * b, c - a))
    box = (F.col("r1") - F.col("r0") + 1) * (F.col("c1") - F.col("c0") + 1)
    return g.select(
        *keys, "label", "area",
        F.col("r0").alias("x1"), F.col("c0").alias("y1"), (F.col("r1") + 1).alias("x2"), (F.col("c1") + 1).alias("y2"),
        (F.col("r0") + y).alias("centroid_r"), (F.col("c0") + x).alias("centroid_c"), y.alias("local_r"), x.alias("local_c"),
        (F.col("r0") + F.try_divide("vy", "vs")).alias("weighted_r"), (F.col("c0") + F.try_divide("vx", "vs")).alias("weighted_c"),
        "intensity_min", "intensity_max", "intensity_mean", box.alias("area_bbox"), (n / box).alias("extent"),
        F.sqrt(4 * n / np.pi).alias("equivalent_diameter"),
        *[f"mu{k}" for k in ("20", "11", "02", "30", "21", "12", "03")], *[f"nu{k}" for k in ("20", "11", "02", "30", "21", "12", "03")],
        "inertia_1", "inertia_2", (4 * F.sqrt(l1)).alias("axis_major"), (4 * F.sqrt(l2)).alias("axis_minor"),
        F.coalesce(F.sqrt(F.greatest(1 - F.try_divide(l2, l1), F.lit(0.0))), F.lit(0.0)).alias("eccentricity"), orientation.alias("orientation"),
        *[h.alias(f"hu{k}") for k, h in enumerate(hu)],
    )


def _mask_of(group: pd.DataFrame) -> tuple[np.ndarray, int, int]:
    r0, c0 = int(group["r"].min()), int(group["c"].min())
    mask = np.zeros((int(group["r"].max()) - r0 + 1, int(group["c"].max()) - c0 + 1), bool)
    mask[group["r"].to_numpy() - r0, group["c"].to_numpy() - c0] = True
    return mask, r0, c0


# Weights of border pixels by their neighbourhood, and of intercepts in four directions.
STEP, DIAGONAL, MIXED = 1.0, 2**0.5, (1 + 2**0.5) / 2


def shape_of(mask: np.ndarray) -> dict[str, float]:
    """Shape properties of one region: filled and convex area, solidity, largest Feret diameter, perimeter,
    Crofton perimeter (four directions), Euler number."""
    padded = np.pad(mask, 1).astype(np.int64)
    area = int(mask.sum())
    corners = np.argwhere(mask)
    corners = np.concatenate([corners + d for d in ((-0.5, 0), (0.5, 0), (0, -0.5), (0, 0.5))])
    around = raster.hull(corners)
    convex = float(raster.fill_polygon(around, *mask.shape).sum()) if len(around) > 2 else float(area)
    feret = float(np.sqrt(((around[:, None] - around[None]) ** 2).sum(2).max()))
    inner = padded[1:-1, :-2] & padded[1:-1, 2:] & padded[:-2, 1:-1] & padded[2:, 1:-1]
    border = np.pad(mask & (inner == 0), 1).astype(np.int64)
    straight = border[1:-1, :-2] + border[1:-1, 2:] + border[:-2, 1:-1] + border[2:, 1:-1]
    slanted = border[:-2, :-2] + border[:-2, 2:] + border[2:, :-2] + border[2:, 2:]
    code = (10 * slanted + 2 * straight + 1)[border[1:-1, 1:-1] > 0]
    count = np.bincount(code, minlength=64)
    perimeter = STEP * count[[5, 7, 15, 17, 25, 27]].sum() + DIAGONAL * count[[21, 33]].sum() + MIXED * count[[13, 23]].sum()
    quads = padded[:-1, :-1] + padded[1:, :-1] + padded[:-1, 1:] + padded[1:, 1:]
    cross = (padded[:-1, :-1] == padded[1:, 1:]) & (padded[:-1, 1:] == padded[1:, :-1]) & (padded[:-1, :-1] != padded[:-1, 1:])
    euler = ((quads == 1).sum() - (quads == 3).sum() - 2 * cross.sum()) / 4
    starts = lambda a, b: int(((a == 0) & (b == 1)).sum())
    n = [starts(padded[:, :-1], padded[:, 1:]), starts(padded[:-1], padded[1:]), starts(padded[:-1, :-1], padded[1:, 1:]), starts(padded[:-1, 1:], padded[1:, :-1])]
    crofton = np.pi / 4 * (n[0] + n[1] + (n[2] + n[3]) / DIAGONAL)
    return {
        "area_filled": float(raster.holes_filled(mask).sum()), "area_convex": convex, "solidity": area / convex, "feret_max": feret,
        "perimeter": float(perimeter), "perimeter_crofton": float(crofton), "euler_number": float(euler),
    }


def region_shapes(pixels: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """A10: ``shape_of`` each region; a region's pixels are one group."""
    p = pixels.where(F.col(label) != 0).select(*keys, F.col(label).alias("label"), F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"))
    names = list(shape_of(np.ones((1, 1), bool)))
    schema = extended(p.select(*keys, "label").schema, **dict.fromkeys(names, "double"))

    def one(group: pd.DataFrame) -> pd.DataFrame:
        head = group.iloc[:1][[*keys, "label"]].reset_index(drop=True)
        return head.assign(**shape_of(_mask_of(group)[0]))

    return p.groupBy(*keys, "label").applyInPandas(one, schema)


# -- user functions -------------------------------------------------------------------------------


def compute_features(cells: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str | StructType) -> DataFrame:
    """A user function over batches of cells; it returns a row per cell with its id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield function(batch)

    return cells.mapInPandas(run, schema)


def add_features(cells: DataFrame, computed: DataFrame, key: str, id_col: str = "sc_id") -> DataFrame:
    """Merges computed columns into the map column ``features`` under a key."""
    names = [c for c in computed.columns if c != id_col]
    values = F.create_map(*[x for c in names for x in (F.lit(c), F.col(c).cast("double"))])
    entry = computed.select(F.col(id_col), F.create_map(F.lit(key), values).alias("__new"))
    empty = F.create_map().cast("map<string, map<string, double>>")
    old = F.map_filter(F.coalesce("features", empty), lambda k, _: k != key)
    out = cells.join(entry, id_col, "left")
    return out.withColumn("features", F.map_concat(old, F.coalesce("__new", empty))).drop("__new")


def feature_table(cells: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """A column key_name per named feature, with sc_id, track_id and t; missing ones are null."""
    values = [F.col("features")[key][n].alias(f"{key}_{n}") for key, ns in names.items() for n in ns]
    return cells.select("sc_id", "track_id", F.col("timeframe").alias("t"), *values)


def pivot_features(long: DataFrame, names: list[str], id_col: str = "sc_id") -> DataFrame:
    """(id, name, value) as one column per given name; the list is given, so no pass looks for it."""
    return long.groupBy(id_col).pivot("name", names).agg(F.max("value"))


# -- texture --------------------------------------------------------------------------------------

# The four directions.
DIRECTIONS = [(0, 1), (1, 1), (1, 0), (1, -1)]


def cooccurrence(pixels: DataFrame, keys: list[str], value: str = "value", ignore_zeros: bool = True) -> DataFrame:
    """(keys, direction, i, j, n): grey values of neighbours in four directions, both ways. A pixel is
    joined with four shifted copies, by position."""
    p = pixels.select(*keys, F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col(value).cast("long").alias("i"))
    p = p.where("i <> 0") if ignore_zeros else p
    moves = F.array(*[F.struct(F.lit(k).alias("direction"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for k, (dr, dc) in enumerate(DIRECTIONS)])
    moved = p.select(*keys, "r", "c", "i", F.explode(moves).alias("m")).select(*keys, F.col("m.direction").alias("direction"), (F.col("r") + F.col("m.dr")).alias("r"), (F.col("c") + F.col("m.dc")).alias("c"), "i")
    both = moved.join(p.withColumnRenamed("i", "j"), [*keys, "r", "c"]).groupBy(*keys, "direction", "i", "j").agg(F.count("*").alias("n"))
    back = both.select(*keys, "direction", F.col("j").alias("i"), F.col("i").alias("j"), "n")
    return both.unionByName(back).groupBy(*keys, "direction", "i", "j").agg(F.sum("n").alias("n"))


def haralick(pixels: DataFrame, keys: list[str], value: str = "value", ignore_zeros: bool = True) -> DataFrame:
    """Thirteen texture features, means over the directions. All are sums over co-occurrences, their
    margins, and their sums and differences of grey values."""
    by = [*keys, "direction"]
    g = cooccurrence(pixels, keys, value, ignore_zeros)
    g = g.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))
    plogp = lambda c: -F.sum(F.when(F.col(c) > 0, F.col(c) * F.log2(c)).otherwise(0.0))
    margin = g.groupBy(*by, "i").agg(F.sum("p").alias("px"))
    stats = margin.groupBy(*by).agg(
        F.sum(F.col("i") * F.col("px")).alias("mu"), F.sum(F.col("i") * F.col("i") * F.col("px")).alias("s2"), plogp("px").alias("hx")
    ).withColumn("var", F.col("s2") - F.col("mu") * F.col("mu"))
    i, j, p = F.col("i"), F.col("j"), F.col("p")
    joint = g.join(margin.withColumnRenamed("px", "pi"), [*by, "i"]).join(margin.select(*by, F.col("i").alias("j"), F.col("px").alias("pj")), [*by, "j"])
    main = joint.groupBy(*by).agg(
        F.sum(p * p).alias("asm"), F.sum((i - j) * (i - j) * p).alias("contrast"), F.sum(i * j * p).alias("ij"),
        F.sum(p / (1 + (i - j) * (i - j))).alias("idm"), plogp("p").alias("entropy"), (-F.sum(p * F.log2(F.col("pi") * F.col("pj")))).alias("hxy1"),
    )
    sums = g.groupBy(*by, (i + j).alias("k")).agg(F.sum("p").alias("q")).groupBy(*by).agg(
        F.sum(F.col("k") * F.col("q")).alias("sum_avg"), F.sum(F.col("k") * F.col("k") * F.col("q")).alias("sum_sq"), plogp("q").alias("sum_entropy")
    )
    diffs = g.groupBy(*by, F.abs(i - j).alias("k")).agg(F.sum("p").alias("q")).groupBy(*by).agg(
        F.sum(F.col("k") * F.col("q")).alias("d1"), F.sum(F.col("k") * F.col("k") * F.col("q")).alias("d2"), plogp("q").alias("diff_entropy")
    )
    t = main.join(stats, by).join(sums, by).join(diffs, by)
    hx = F.col("hx")
    t = t.select(
        *keys, "asm", "contrast", F.coalesce(F.try_divide(F.col("ij") - F.col("mu") * F.col("mu"), F.col("var")), F.lit(1.0)).alias("correlation"),
        F.col("var").alias("variance"), "idm", "sum_avg", (F.col("sum_sq") - F.col("sum_avg") * F.col("sum_avg")).alias("sum_var"), "sum_entropy", "entropy",
        (F.col("d2") - F.col("d1") * F.col("d1")).alias("diff_var"), "diff_entropy",
        F.coalesce(F.try_divide(F.col("entropy") - F.col("hxy1"), hx), F.lit(0.0)).alias("imc1"),
        F.sqrt(F.greatest(1 - F.exp(-2 * (2 * hx - F.col("entropy"))), F.lit(0.0))).alias("imc2"),
    )
    return t.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in t.columns if c not in keys])


# -- intensities ----------------------------------------------------------------------------------


def _image_stats(pixels: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    """Pixels with statistics of their image: joined from one aggregate, so an image is never gathered."""
    return pixels.join(pixels.groupBy(*keys).agg(*aggs), keys)


def normalize_intensity(pixels: DataFrame, keys: list[str], value: str = "value", top: int = 255) -> DataFrame:
    """Per image: z-score, moved by the size of its least value, scaled to 0 .. top, cut to integers."""
    p = _image_stats(pixels, keys, F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"), F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    z = lambda v: (v - F.col("__m")) / F.when(F.col("__s") == 0, 1.0).otherwise(F.col("__s"))
    shift = F.abs(z(F.col("__lo")))
    scaled = F.try_divide((z(F.col(value)) + shift) * top, z(F.col("__hi")) + shift)
    return p.withColumn("normalized", F.coalesce(scaled, F.lit(0.0)).cast("long")).drop("__m", "__s", "__lo", "__hi")


def normalize_by_depth(pixels: DataFrame, keys: list[str], bit_depth: int = 8, value: str = "value", mean: float | None = None) -> DataFrame:
    """Least to largest value scaled to the bit depth (8 or 16; else an error), then moved to a mean."""
    if bit_depth not in (8, 16):
        raise ValueError(f"bit depth {bit_depth}")
    top = 2**bit_depth - 1
    p = _image_stats(pixels, keys, F.min(value).alias("__lo"), F.max(value).alias("__hi"), F.avg(value).alias("__m"))
    scale = lambda v: F.coalesce(F.try_divide((v - F.col("__lo")) * top, F.col("__hi") - F.col("__lo")), F.lit(0.0))
    v = scale(F.col(value)) if mean is None else F.least(F.greatest(scale(F.col(value)) + mean - scale(F.col("__m")), F.lit(0.0)), F.lit(float(top)))
    return p.withColumn("normalized", v.cast("long")).drop("__lo", "__hi", "__m")


def keep_above_percentile(pixels: DataFrame, keys: list[str], percentile: float, value: str = "value", target: float | None = None, scale: float = 1.0) -> DataFrame:
    """Values above the image's (linear) percentile are kept and scaled, or set; the rest is 0."""
    p = _image_stats(pixels, keys, F.percentile(value, F.lit(percentile / 100)).alias("__p"))
    kept = F.lit(float(target)) if target is not None else F.col(value) * scale
    return p.withColumn("kept", F.when(F.col(value) > F.col("__p"), kept).otherwise(0.0)).drop("__p")


def background_removed(pixels: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Less a quadratic surface fitted per image by least squares, moved to start at 0. The normal
    equations are sums per image; images (not pixels) meet the small solver."""
    size = pixels.groupBy(*keys).agg(F.avg("r").alias("__r"), F.avg("c").alias("__c"), F.greatest(F.stddev_pop("r"), F.stddev_pop("c"), F.lit(1.0)).alias("__d"))
    p = pixels.join(size, keys).withColumn("__y", (F.col("r") - F.col("__r")) / F.col("__d")).withColumn("__x", (F.col("c") - F.col("__c")) / F.col("__d"))
    y, x = F.col("__y"), F.col("__x")
    basis = [F.lit(1.0), y, x, y * y, y * x, x * x]
    sums = [F.sum(basis[i] * basis[j]).alias(f"s{i}{j}") for i in range(6) for j in range(i, 6)] + [F.sum(basis[i] * F.col(value)).alias(f"b{i}") for i in range(6)]
    eqs = p.groupBy(*keys).agg(*sums)
    schema = extended(eqs.select(*keys).schema, __w="array<double>")

    def solve(batches):
        for t in batches:
            w = []
            for row in t.to_dict("records"):
                a = np.array([[row[f"s{min(i, j)}{max(i, j)}"] for j in range(6)] for i in range(6)])
                w.append(np.linalg.lstsq(a, np.array([row[f"b{i}"] for i in range(6)]), rcond=None)[0].tolist())
            yield t[keys].assign(__w=w)

    fit = sum((b * F.get("__w", F.lit(i)) for i, b in enumerate(basis)), F.lit(0.0))
    flat = p.join(eqs.mapInPandas(solve, schema), keys).withColumn("__v", F.col(value) - fit)
    low = flat.groupBy(*keys).agg(F.min("__v").alias("__lo"))
    return flat.join(low, keys).withColumn("corrected", F.col("__v") - F.col("__lo")).drop("__r", "__c", "__d", "__y", "__x", "__w", "__v", "__lo")


# -- kernels on regions and images ----------------------------------------------------------------


def _per_group(p: DataFrame, by: list[str], out: StructType, one: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    return p.groupBy(*by).applyInPandas(one, out)


def _label_pixels(pixels: DataFrame, keys: list[str], label: str) -> DataFrame:
    return pixels.where(F.col(label) != 0).select(*keys, F.col(label).cast("long").alias("label"), F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"))


def resized_labels(pixels: DataFrame, keys: list[str], scale: float, label: str = "label") -> DataFrame:
    """Labels grown or shrunk; where grown labels overlap, their sum."""
    p = _label_pixels(pixels, keys, label)

    def one(g: pd.DataFrame) -> pd.DataFrame:
        mask, r0, c0 = _mask_of(g)
        pad = int(np.ceil(2 * np.sqrt(mask.sum() / np.pi) * abs(scale) + 1))
        at = np.argwhere(raster.resize_by(np.pad(mask, pad), scale)) + (r0 - pad, c0 - pad)
        head = g.iloc[:1][[*keys, "label"]]
        return head.loc[head.index.repeat(len(at))].reset_index(drop=True).assign(r=at[:, 0], c=at[:, 1])

    return _per_group(p, [*keys, "label"], p.schema, one).groupBy(*keys, "r", "c").agg(F.sum("label").alias("label"))


def _tile_pieces(pixels: DataFrame, keys: list[str], label: str, diagonal: bool, tile: int) -> DataFrame:
    """The pixels of each label as runs along rows, cut at the borders of tiles: (keys, label, r, first, last,
    __r, __c), the last two the first pixel of their connected piece within the tile."""
    at = lambda c: F.floor(F.col(c) / tile).alias(f"__t{c}")
    p = _label_pixels(pixels, keys, label).select("*", at("r"), at("c"))
    by = [*keys, "__tr", "__tc", "label"]
    schema = extended(p.select(*keys, "label", "r").schema, first="long", last="long", __r="long", __c="long")

    def unite(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        r, c = numbers(t, "r", "c")
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(r))))
        once = np.flatnonzero(np.append(True, (np.diff(group) != 0) | (np.diff(r) != 0) | (np.diff(c) != 0)))
        r, c = r[once], c[once]
        first, last, root = raster.runs_and_pieces(group[once], r, c, int(diagonal))
        top = first[root]
        yield pa.RecordBatch.from_arrays([*heads(t, [*keys, "label"], once[first]), *map(pa.array, (r[first], c[first], c[last], r[top], c[top]))], schema.names)

    return in_groups(p, by, ["r", "c"], unite, schema, p.count())


def _rooted_runs(pixels: DataFrame, keys: list[str], label: str, diagonal: bool, tile: int, t: Rounds) -> DataFrame:
    """``_tile_pieces`` with __root, a number of the run's piece in the whole label. Only runs at borders of tiles can
    meet runs of other tiles; these meet by joins and are united over the whole table."""
    node, more = F.xxhash64(*keys, "label", "__r", "__c"), int(diagonal)
    runs = t.write(_tile_pieces(pixels, keys, label, diagonal, tile), "runs").withColumn("__id", node)
    edge = lambda c, k: F.pmod(F.col(c), F.lit(tile)) == k
    border = runs.where(edge("r", 0) | edge("r", tile - 1) | edge("first", 0) | edge("last", tile - 1))
    cover = F.explode(F.sequence(F.floor((F.col("first") - more) / tile), F.floor((F.col("last") + more) / tile)))
    cut = border.withColumn("__t", cover)
    below = cut.select(*keys, "label", (F.col("r") - 1).alias("r"), "__t", F.col("first").alias("f"), F.col("last").alias("l"), F.col("__id").alias("b"))
    edges = cut.join(below, [*keys, "label", "r", "__t"]).where((F.col("f") <= F.col("last") + more) & (F.col("first") <= F.col("l") + more)).select(F.col("__id").alias("a"), "b")
    left = border.where(edge("last", tile - 1)).select(*keys, "label", "r", (F.col("last") + 1).alias("first"), F.col("__id").alias("b"))
    edges = edges.union(border.where(edge("first", 0)).join(left, [*keys, "label", "r", "first"]).select(F.col("__id").alias("a"), "b"))
    edges = t.write(edges.where("a <> b").distinct(), "edges")
    if edges.isEmpty():
        return runs.withColumnRenamed("__id", "__root")
    joined = runs.join(components(edges), F.col("__id") == F.col("node"), "left")
    return joined.withColumn("__root", F.coalesce("root", "__id")).drop("node", "root", "__id")


def label_pieces(pixels: DataFrame, keys: list[str], label: str = "label", diagonal: bool = True, tile: int = 256) -> DataFrame:
    """X11: runs (keys, label, r, first, last) with ``piece``, their connected piece of the label, numbered from 1 in
    order of its first pixel. Runs are united inside tiles of an image, and over the whole table where they meet at a
    tile's border, so a region of any size is many tasks' work."""
    t = Rounds(pixels.sparkSession)
    runs = _rooted_runs(pixels, keys, label, diagonal, tile, t)
    tops = runs.where("r = __r AND first = __c")
    starts = tops.groupBy(*keys, "label", "__root").agg(F.min(F.struct("r", "first")).alias("__s"))
    number = ranked(starts, [*keys, "label"], ["__s"], "piece").select(*keys, "label", "__root", (F.col("piece") + 1).cast("int").alias("piece"))
    return runs.join(number, [*keys, "label", "__root"]).select(*keys, "label", "r", "first", "last", "piece")


def cells_from_labels(pixels: DataFrame, keys: list[str], label: str = "label", least_points: int = 10) -> DataFrame:
    """Outer boundaries of the connected pieces of each label that have ``least_points`` or more: (keys, label,
    piece, contour, box). Pieces are found over the whole table; one piece's runs, of which each has a pixel of its
    outline, are a group."""
    runs, own = label_pieces(pixels, keys, label), [*keys, "label", "piece"]
    schema = extended(runs.select(*own).schema, contour="array<array<double>>", x1="long", y1="long", x2="long", y2="long")

    def walk(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        r, first, last = numbers(t, "r", "first", "last")
        ends = np.append(starts, len(r))
        # a walk leaves a pixel by each of eight directions once at most
        large = np.flatnonzero(8 * np.add.reduceat(last - first + 1, starts) >= least_points)
        kept, points = [], []
        for k in large.tolist():
            mine = slice(ends[k], ends[k + 1])
            r0, c0 = r[mine].min(), first[mine].min()
            mask = np.zeros((r[mine].max() - r0 + 1, last[mine].max() - c0 + 1), bool)
            for y, a, b in zip((r[mine] - r0).tolist(), (first[mine] - c0).tolist(), (last[mine] - c0).tolist()):
                mask[y, a : b + 1] = True
            walked = raster.boundary(mask) + (r0, c0)
            if len(walked) >= least_points:
                kept.append(starts[k])
                points.append(walked)
        if kept:
            at = np.cumsum([0, *map(len, points)])
            flat = np.concatenate(points)
            pairs = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(flat) + 1, 2), pa.int32()), pa.array(flat.ravel().astype(float)))
            box = [f(flat[:, i], at[:-1]) + d for f, d in ((np.minimum.reduceat, 0), (np.maximum.reduceat, 1)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*heads(t, own, np.array(kept)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pairs), *map(pa.array, box)], schema.names)

    return in_groups(runs, own, [], walk, schema)


def piece_counts(pixels: DataFrame, keys: list[str], label: str = "label", diagonal: bool = True, tile: int = 256) -> DataFrame:
    """X11: connected pieces of each label."""
    runs = _rooted_runs(pixels, keys, label, diagonal, tile, Rounds(pixels.sparkSession))
    tops = runs.where("r = __r AND first = __c").select(*keys, "label", "__root").distinct()
    return tops.groupBy(*keys, "label").agg(F.count("*").cast("int").alias("n_pieces"))


def rasterized_runs(cells: DataFrame, keys: list[str], h: int, w: int, canvas: int = 1 << 21) -> DataFrame:
    """Pixels inside or on contours (``contour``, cut to the image) as runs along rows: (keys, sc_id, r, first, last).
    Contours without points have none. About ``canvas`` pixels are drawn at once."""
    own = [*keys, "sc_id"]
    at = lambda i: F.transform("contour", lambda x: F.get(x, F.lit(i)).cast("double"))
    need = cells.select(*own, at(0).alias("__r"), at(1).alias("__c"))
    schema = extended(need.select(*own).schema, r="long", first="long", last="long")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column("__r").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            points = np.stack([b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("__r", "__c")], 1)
            drawn = np.flatnonzero(n)
            if not len(drawn):
                continue
            first = np.cumsum(n[drawn]) - n[drawn]
            low = np.maximum(np.floor(np.minimum.reduceat(points, first)), 0)
            size = np.maximum(np.minimum(np.ceil(np.maximum.reduceat(points, first)) + 1, (h, w)) - low, 0).astype(np.int64)
            ends = np.append(first, len(points))
            part = np.cumsum(size.prod(1)) // canvas
            for i, j in zip(*raster.runs_of(part)):
                k, *run = raster.fill_polygons(points[ends[i] : ends[j]], first[i:j] - first[i], low[i:j], size[i:j])
                head = b.select(own).take(pa.array(drawn[i:j][k]))
                for a in range(0, len(k), 100_000):
                    yield pa.RecordBatch.from_arrays([*(c.slice(a, 100_000) for c in head.columns), *(pa.array(x[a : a + 100_000]) for x in run)], schema.names)

    return need.mapInArrow(fill, schema)


def rasterize(cells: DataFrame, keys: list[str], h: int, w: int) -> DataFrame:
    """Pixels inside or on contours (``contour``, cut to the image): (keys, sc_id, r, c). Python hands over runs;
    they become pixels in Spark."""
    return rasterized_runs(cells, keys, h, w).select(*keys, "sc_id", "r", F.explode(F.sequence("first", "last")).alias("c"))


def combine_masks(pixels: DataFrame, keys: list[str], order: str = "sc_id") -> DataFrame:
    """One label per pixel, the last by order."""
    return pixels.groupBy(*keys, "r", "c").agg(F.max(order).alias("label"))


def image_tiles(h: int, w: int, sh: int, sw: int) -> list[tuple[int, int]]:
    """Offsets of tiles; those at the far edges are moved inside."""
    rows = sorted({min(r, max(h - sh, 0)) for r in range(0, h, sh)})
    cols = sorted({min(c, max(w - sw, 0)) for c in range(0, w, sw)})
    return [(r, c) for r in rows for c in cols]


def cut_tiles(pixels: DataFrame, h: int, w: int, sh: int, sw: int) -> DataFrame:
    """Pixels of each tile with the tile's offsets and their place in it. A pixel finds its tiles by
    arithmetic: the regular one, and the moved one at the far edge."""
    side = lambda v, n, s: F.array_distinct(F.array(F.least(F.floor(v / s) * s, F.lit(max(n - s, 0))), F.when(v >= max(n - s, 0), F.lit(max(n - s, 0)).cast("long")).otherwise(F.least(F.floor(v / s) * s, F.lit(max(n - s, 0))))))
    t = pixels.withColumn("tile_r", F.explode(side(F.col("r"), h, sh))).withColumn("tile_c", F.explode(side(F.col("c"), w, sw)))
    return t.withColumn("in_r", F.col("r") - F.col("tile_r")).withColumn("in_c", F.col("c") - F.col("tile_c"))


def crop_or_pad(pixels: DataFrame, h: int, w: int, to_h: int, to_w: int) -> DataFrame:
    """Pixels moved to a centred crop or padding of another size; the odd one of a padding comes after,
    that of a crop is cut before. Pixels outside vanish, missing ones are 0 by absence."""
    shift = lambda n, m: (m - n) // 2 if m >= n else -((n - m) // 2)
    moved = pixels.withColumn("r", F.col("r") + shift(h, to_h)).withColumn("c", F.col("c") + shift(w, to_w))
    return moved.where((F.col("r") >= 0) & (F.col("r") < to_h) & (F.col("c") >= 0) & (F.col("c") < to_w))


def media_rows(clips: DataFrame, paddings: tuple[int, ...], frame_types: tuple[str, ...], labels: list[str], folder: str = "media") -> DataFrame:
    """Clips (class, sample_id, track_id, start_time, end_time): a row per padding and frame type, with
    the label's index and a path."""
    index = F.array_position(F.array(*map(F.lit, labels)), F.col("class")) - 1
    t = clips.withColumn("padding_pixels", F.explode(F.array(*map(F.lit, paddings)))).withColumn("frame_type", F.explode(F.array(*map(F.lit, frame_types))))
    path = F.format_string(f"{folder}/%s/%s_trackid-%s_%s-%s_pad-%s_%s.mp4", "class", F.col("sample_id").cast("string"), F.col("track_id").cast("string"), F.col("start_time").cast("string"), F.col("end_time").cast("string"), F.col("padding_pixels").cast("string"), "frame_type")
    return t.withColumn("label_index", index.cast("int")).withColumn("path", path)


def pixels_of_images(images: DataFrame, values: str = "values") -> DataFrame:
    """Image rows (flat array, h, w) as pixels."""
    rest = [c for c in images.columns if c not in (values, "h", "w")]
    e = images.select(*rest, "w", F.posexplode(values).alias("__k", "value"))
    return e.select(*rest, F.expr("CAST(__k div w AS BIGINT)").alias("r"), F.expr("CAST(__k % w AS BIGINT)").alias("c"), "value")


def images_of_pixels(pixels: DataFrame, keys: list[str], h: int, w: int, value: str = "value") -> DataFrame:
    """Pixels as image rows, 0 where there is none. An image is one row, so one group. Sorted pixels take
    turns with the zeros between them, so the work is linear in the image's size."""
    at = (F.col("r") * w + F.col("c")).cast("int")
    m = F.sort_array(F.collect_list(F.struct(at.alias("k"), F.col(value).cast("double").alias("v")))).alias("__m")
    zeros = lambda n: F.array_repeat(F.lit(0.0), F.greatest(n, F.lit(0)))
    runs = F.expr("transform(__m, (x, i) -> concat(array_repeat(0.0D, x.k - coalesce(get(__m, i - 1).k, -1) - 1), array(x.v)))")
    tail = zeros(F.lit(h * w - 1) - F.coalesce(F.get("__m", F.size("__m") - 1)["k"], F.lit(-1)))
    return pixels.groupBy(*keys).agg(m).select(*keys, F.lit(h).alias("h"), F.lit(w).alias("w"), F.concat(F.flatten(runs), tail).alias("values"))

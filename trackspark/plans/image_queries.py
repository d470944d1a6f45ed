"""Queries over pixels, contours and clips (A9, A10, A30, A32, A33, X, F10, F13, F19, F20, G13, G16, G17, O8, U10 to U12)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from trackspark.operators import contours as co
from trackspark.operators import events as evs
from trackspark.operators import fields as fi
from trackspark.operators import images as im
from trackspark.operators import tracks as tr

from .adapters import cells, clips, dealt, table, unique_pixels
from .base import query
from .overlap_queries import shapes

KEY = ["image"]


def r(*names, digits=6):
    return [F.round(n, digits).alias(n) for n in names]


H, W = 96, 64  # places of an image; about 64 of its rows are filled


def grid(s, d):
    """lineitem as images: a thousand orders each, their items row by row, so that every item is a pixel."""
    p = table(s, d, "lineitem").selectExpr("l_orderkey div 1024 AS image", "l_quantity AS value", "1 + l_linenumber % 3 AS label", "struct(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS k")
    p = dealt(s, d, p, "image")
    p = p.withColumn("at", F.row_number().over(Window.partitionBy("image").orderBy("k")) - 1)
    return p.select("image", F.expr(f"CAST(at div {W} AS BIGINT)").alias("r"), F.expr(f"CAST(at % {W} AS BIGINT)").alias("c"), "value", F.col("label").cast("long").alias("label"))


GRID = f"""items AS (SELECT l_orderkey // 1024 AS image, l_quantity AS value, CAST(1 + l_linenumber % 3 AS BIGINT) AS label,
  row_number() OVER (PARTITION BY l_orderkey // 1024 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS k FROM lineitem), grid AS (SELECT image, k // {W} AS r, k % {W} AS c, value, label FROM items)"""


@query(
    "a9_region_moments",
    f"""WITH {GRID} SELECT image, label, count(*) AS area, CAST(min(r) AS DOUBLE) AS x1, CAST(max(c) + 1 AS DOUBLE) AS y2, round(avg(r), 6) AS centroid_r, round(sum(value * c) / sum(value), 6) AS weighted_c, round(avg(value), 6) AS intensity_mean,
    round(sqrt(4 * count(*) / pi()), 6) AS equivalent_diameter, round(var_pop(r) * count(*), 4) AS mu20, round(covar_pop(r, c) * count(*), 4) AS mu11,
    round(4 * sqrt((var_pop(c) + var_pop(r)) / 2 + sqrt(((var_pop(c) - var_pop(r)) / 2) ** 2 + covar_pop(r, c) ** 2)), 5) AS axis_major FROM grid WHERE label <> 0 GROUP BY ALL""",
)
def a9(s, d):
    m = im.region_moments(grid(s, d), KEY)
    return m.select("image", "label", "area", "x1", "y2", *r("centroid_r", "weighted_c", "intensity_mean", "equivalent_diameter"), *r("mu20", "mu11", digits=4), *r("axis_major", digits=5))


@query("a10_region_shapes")
def a10(s, d):
    return im.region_shapes(grid(s, d), KEY)


def with_features(s, d):
    """Cells with a map of two feature groups."""
    group = lambda *xs: F.create_map(*[x for n, c in xs for x in (F.lit(n), F.col(c).cast("double"))])
    return cells(s, d).withColumn("features", F.create_map(F.lit("box"), group(("top", "x1"), ("left", "y1")), F.lit("size"), group(("area", "area"))))


@query("a11_feature_table", "SELECT sc_id, track_id, timeframe AS t, CAST(x1 AS DOUBLE) AS box_top, CAST(y1 AS DOUBLE) AS box_left, area AS size_area FROM cells")
def a11(s, d):
    return im.feature_table(with_features(s, d), {"box": ["top", "left"], "size": ["area"]})


@query("a12_feature_pivot", "SELECT sc_id, max(area) FILTER (status = 'error') AS error, max(area) FILTER (status = 'view') AS view FROM raw_cells GROUP BY sc_id")
def a12(s, d):
    from .adapters import raw_cells

    return im.pivot_features(raw_cells(s, d).select("sc_id", F.col("status").alias("name"), F.col("area").alias("value")), ["error", "view"])


@query("a30_enclosing_box", "SELECT track_id AS clip, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM cells GROUP BY ALL")
def a30(s, d):
    return evs.enclosing_box(cells(s, d).withColumnRenamed("track_id", "clip"))


@query("a32_mean_contour", "SELECT dataset, round(avg(x1), 6) AS first_row, round(avg(y2 - 2), 6) AS third_col FROM cells GROUP BY ALL")
def a32(s, d):
    m = co.mean_contour(shapes(s, d).join(cells(s, d).select("sc_id", "dataset"), "sc_id"), ["dataset"])
    at = lambda i, k: F.round(F.get(F.get("mean_contour", F.lit(i)), F.lit(k)), 6)
    return m.select("dataset", at(0, 0).alias("first_row"), at(2, 1).alias("third_col"))


@query("a33_shape_modes")
def a33(s, d):
    p = shapes(s, d).withColumn("contour", co.axis_aligned(F.col("contour")))
    return co.shape_modes(p, "sc_id")[0]


def _cut(axis: int, bound: int, low: bool) -> str:
    """One side of the box: the points of a polygon that stay, and where its edges cross the side."""
    p, q = "ps[CASE WHEN i = 1 THEN len(ps) ELSE i - 1 END]", "ps[i]"
    inside = lambda x: f"{x}[{axis}] {'<=' if low else '>='} {bound}"
    t = f"({bound} - {p}[{axis}]) / ({q}[{axis}] - {p}[{axis}])"
    at = f"[{p}[1] + {t} * ({q}[1] - {p}[1]), {p}[2] + {t} * ({q}[2] - {p}[2])]"
    return f"flatten(list_transform(range(1, len(ps) + 1), lambda i: CASE WHEN ({inside(p)}) <> ({inside(q)}) THEN [{at}] ELSE [] END || CASE WHEN {inside(q)} THEN [{q}] ELSE [] END))"


@query(
    "f10_clip_polygon",
    "WITH p0 AS (SELECT sc_id, [[x1, y1], [x1 + 3, y2], [x2, y2 - 2], [x2 - 1, y1]]::DOUBLE[][] AS ps FROM cells), "
    + ", ".join(f"p{k + 1} AS (SELECT sc_id, {_cut(*side)} AS ps FROM p{k})" for k, side in enumerate(((2, 0, False), (1, 500, True), (2, 500, True), (1, 0, False))))
    + " SELECT sc_id, k, round(p[1], 6) AS r, round(p[2], 6) AS c FROM (SELECT sc_id, CAST(generate_subscripts(ps, 1) - 1 AS INTEGER) AS k, unnest(ps) AS p FROM p4)",
)
def f10(s, d):
    p = shapes(s, d).select("sc_id", F.posexplode(co.clip_polygon(F.col("contour"), 500, 500)).alias("k", "p"))
    return p.select("sc_id", "k", *[F.round(F.get("p", F.lit(i)), 6).alias(n) for i, n in enumerate("rc")])


@query("f13_contour_distance", "WITH p AS (SELECT track_id, sc_id, lead(sc_id) OVER w AS n, x1, y1, x2, y2, lead(x1) OVER w AS u1, lead(y1) OVER w AS v1, lead(x2) OVER w AS u2, lead(y2) OVER w AS v2 FROM cells WINDOW w AS (PARTITION BY dataset, track_id ORDER BY timeframe)), a AS (SELECT sc_id, n, unnest([[x1, y1], [x1 + 3, y2], [x2, y2 - 2], [x2 - 1, y1]]) AS p, [[u1, v1], [u1 + 3, v2], [u2, v2 - 2], [u2 - 1, v1]] AS qs FROM p WHERE n IS NOT NULL) SELECT sc_id, round(min(sqrt((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2)), 6) AS distance FROM (SELECT sc_id, p, unnest(qs) AS q FROM a) GROUP BY ALL")
def f13(s, d):
    n = cells(s, d).withColumn("n", F.lead("sc_id").over(tr.in_time())).where("n IS NOT NULL").select("sc_id", "n")
    c = shapes(s, d).select("sc_id", "contour")
    p = n.join(c.withColumnRenamed("contour", "a"), "sc_id").join(c.select(F.col("sc_id").alias("n"), F.col("contour").alias("b")), "n")
    return co.contour_distances(p, "a", "b").select("sc_id", *r("distance"))


@query(
    "f19_rigid_align",
    """WITH p AS (SELECT sc_id, sc_id % 7 AS k, unnest([[x1, y1], [x1 + 3, y2], [x2, y2 - 2], [x2 - 1, y1]]) AS a FROM cells), q AS (SELECT sc_id, a[1]::DOUBLE AS ar, a[2]::DOUBLE AS ac, -a[2]::DOUBLE * 1.1 + 5 AS br, a[1]::DOUBLE + k AS bc FROM p),
    m AS (SELECT sc_id, ar - avg(ar) OVER w AS ar, ac - avg(ac) OVER w AS ac, br - avg(br) OVER w AS br, bc - avg(bc) OVER w AS bc FROM q WINDOW w AS (PARTITION BY sc_id))
    SELECT sc_id, round(sqrt(greatest(sum(ar * ar + ac * ac + br * br + bc * bc) - 2 * sqrt(sum(ar * br + ac * bc) ** 2 + sum(ar * bc - ac * br) ** 2), 0) / count(*)), 6) AS distance FROM m GROUP BY sc_id""",
)
def f19(s, d):
    c = shapes(s, d).select("sc_id", F.col("contour").alias("a")).withColumn("b", F.transform("a", lambda p: F.array(-F.get(p, F.lit(1)) * 1.1 + 5, F.get(p, F.lit(0)) + F.col("sc_id") % 7)))
    return co.rigid_aligned(c, "a", "b").select("sc_id", F.round("distance", 6).alias("distance"))


@query(
    "f20_resample",
    """WITH p AS (SELECT sc_id, generate_subscripts(ps, 1) AS i, unnest(ps) AS p FROM (SELECT sc_id, [[x1, y1], [x1 + 3, y2], [x2, y2 - 2], [x2 - 1, y1]] AS ps FROM cells)),
    n AS (SELECT sc_id, i, p[1]::DOUBLE AS r, p[2]::DOUBLE AS c, coalesce(lead(p) OVER w, first_value(p) OVER w) AS q FROM p WINDOW w AS (PARTITION BY sc_id ORDER BY i)),
    l AS (SELECT *, sqrt((q[1] - r) ** 2 + (q[2] - c) ** 2) AS len FROM n), a AS (SELECT *, sum(len) OVER (PARTITION BY sc_id ORDER BY i) AS upto, sum(len) OVER (PARTITION BY sc_id) AS total FROM l),
    s AS (SELECT *, coalesce(lag(upto) OVER (PARTITION BY sc_id ORDER BY i), 0) AS start FROM a)
    SELECT sc_id, CAST(k AS INTEGER) AS k, round(r + (q[1] - r) * (k * total / 12 - start) / len, 5) AS r, round(c + (q[2] - c) * (k * total / 12 - start) / len, 5) AS c FROM s, range(12) t(k) WHERE k * total / 12 >= start AND k * total / 12 < upto""",
)
def f20(s, d):
    p = shapes(s, d).select("sc_id", F.posexplode(co.resampled(F.col("contour"), 12)).alias("k", "p"))
    return p.select("sc_id", "k", *[F.round(F.get("p", F.lit(i)), 5).alias(n) for i, n in enumerate("rc")])


@query("x1_user_features", "SELECT CAST(sc_id AS VARCHAR) AS sc_id, CAST((x2 - x1) * (y2 - y1) AS DOUBLE) AS box_area FROM cells")
def x1(s, d):
    def area(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"sc_id": b["sc_id"], "box_area": ((b["x2"] - b["x1"]) * (b["y2"] - b["y1"])).astype(float)})

    c = cells(s, d).withColumn("sc_id", F.col("sc_id").cast("string")).withColumn("features", F.lit(None).cast("map<string, map<string, double>>"))
    got = im.compute_features(c.select("sc_id", "x1", "y1", "x2", "y2"), area, "sc_id string, box_area double")
    return im.add_features(c, got, "box").select("sc_id", F.col("features")["box"]["box_area"].alias("box_area"))


PIX = f"{GRID}, q AS (SELECT image, r, c, CAST(floor(value / 10) AS BIGINT) AS g FROM grid)"


@query(
    "x2_cooccurrence",
    f"""WITH {PIX}, m AS (SELECT unnest([0, 1, 2, 3]) AS direction, unnest([0, 1, 1, 1]) AS dr, unnest([1, 1, 0, -1]) AS dc), b AS (SELECT a.image, direction, a.g AS i, b.g AS j, count(*) AS n FROM q a CROSS JOIN m JOIN q b ON b.image = a.image AND b.r = a.r + dr AND b.c = a.c + dc WHERE a.g <> 0 AND b.g <> 0 GROUP BY ALL)
    SELECT image, direction, i, j, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM b UNION ALL SELECT image, direction, j, i, n FROM b) GROUP BY ALL""",
)
def x2(s, d):
    return im.cooccurrence(grey(s, d), KEY, "g")


def grey(s, d):
    return grid(s, d).withColumn("g", F.floor(F.col("value") / 10).cast("long"))


HARALICK = ["asm", "contrast", "correlation", "variance", "idm", "sum_avg", "sum_var", "sum_entropy", "entropy", "diff_var", "diff_entropy", "imc1", "imc2"]


@query(
    "x2_haralick",
    f"""WITH {PIX}, m AS (SELECT unnest([0, 1, 2, 3]) AS direction, unnest([0, 1, 1, 1]) AS dr, unnest([1, 1, 0, -1]) AS dc), b AS (SELECT a.image, direction, a.g AS i, b.g AS j, count(*) AS n FROM q a CROSS JOIN m JOIN q b ON b.image = a.image AND b.r = a.r + dr AND b.c = a.c + dc WHERE a.g <> 0 AND b.g <> 0 GROUP BY ALL),
    co AS (SELECT image, direction, i, j, sum(n) AS n FROM (SELECT * FROM b UNION ALL SELECT image, direction, j, i, n FROM b) GROUP BY ALL), g AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY image, direction) AS DOUBLE) AS p FROM co),
    mx AS (SELECT image, direction, i, sum(p) AS px FROM g GROUP BY ALL), st AS (SELECT image, direction, sum(i * px) AS mu, sum(i * i * px) AS s2, -sum(px * log2(px)) AS hx FROM mx GROUP BY ALL),
    ma AS (SELECT g.image, g.direction, sum(p * p) AS "asm", sum((g.i - j) ** 2 * p) AS contrast, sum(g.i * j * p) AS ij, sum(p / (1 + (g.i - j) ** 2)) AS idm, -sum(p * log2(p)) AS entropy, -sum(p * log2(x.px * y.px)) AS hxy1
      FROM g JOIN mx x ON x.image = g.image AND x.direction = g.direction AND x.i = g.i JOIN mx y ON y.image = g.image AND y.direction = g.direction AND y.i = g.j GROUP BY ALL),
    su AS (SELECT image, direction, sum(k * w) AS sum_avg, sum(k * k * w) - sum(k * w) ** 2 AS sum_var, -sum(w * log2(w)) AS sum_entropy FROM (SELECT image, direction, i + j AS k, sum(p) AS w FROM g GROUP BY ALL) GROUP BY ALL),
    di AS (SELECT image, direction, sum(k * k * w) - sum(k * w) ** 2 AS diff_var, -sum(w * log2(w)) AS diff_entropy FROM (SELECT image, direction, abs(i - j) AS k, sum(p) AS w FROM g GROUP BY ALL) GROUP BY ALL),
    t AS (SELECT *, (ij - mu * mu) / (s2 - mu * mu) AS correlation, s2 - mu * mu AS variance, (entropy - hxy1) / hx AS imc1, sqrt(greatest(1 - exp(-2 * (2 * hx - entropy)), 0)) AS imc2 FROM ma JOIN st USING (image, direction) JOIN su USING (image, direction) JOIN di USING (image, direction))
    SELECT image, """
    + ", ".join(f'round(avg("{c}"), 6) AS "{c}"' for c in HARALICK)
    + " FROM t GROUP BY image",
)
def x2_features(s, d):
    return im.haralick(grey(s, d), KEY, "g").select("image", *r(*HARALICK))


@query(
    "x3_normalize",
    f"WITH {GRID}, z AS (SELECT image, r, c, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS z FROM grid WINDOW w AS (PARTITION BY image)), v AS (SELECT image, r, c, z + abs(min(z) OVER w) AS v FROM z WINDOW w AS (PARTITION BY image)) SELECT image, r, c, abs(round(v / max(v) OVER (PARTITION BY image), 4)) AS share FROM v",
)
def x3(s, d):
    p = im.normalize_intensity(grid(s, d), KEY, top=2550000000)
    return p.select("image", "r", "c", F.abs(F.round(F.col("normalized") / 2550000000, 4)).alias("share"))


@query("x3_bit_depth", f"WITH {GRID} SELECT image, r, c, CAST(floor((value - min(value) OVER w) * 255 / (max(value) OVER w - min(value) OVER w)) AS BIGINT) AS normalized FROM grid WINDOW w AS (PARTITION BY image)")
def x3_depth(s, d):
    return im.normalize_by_depth(grid(s, d), KEY, 8).select("image", "r", "c", "normalized")


@query("x4_percentile", f"WITH {GRID} SELECT image, r, c, CASE WHEN value > quantile_cont(value, 0.9) OVER (PARTITION BY image) THEN value * 2 ELSE 0 END AS kept FROM grid")
def x4(s, d):
    return im.keep_above_percentile(grid(s, d), KEY, 90, scale=2.0).select("image", "r", "c", "kept")


def blobs(s, d):
    """The images with labels of up to 12 x 12 pixels: some meet, some keep apart, all have holes."""
    g = grid(s, d).drop("label").withColumn("k", F.expr("r div 12 * 6 + c div 12"))
    gap = "c % 12 = 11 OR (r % 12 = 11 AND k % 2 = 1) OR value < 2"
    return g.select("image", "r", "c", "value", F.expr(f"CAST(if({gap}, 0, k + 1) AS BIGINT)").alias("label"))


#: The same for DuckDB, on whole rectangles (rows beyond an image's items have no label), and inner boundaries.
BLOBS = f"""{GRID}, blobs AS (SELECT image, r, c, CAST(CASE WHEN c % 12 = 11 OR (r % 12 = 11 AND (r // 12 * 6 + c // 12) % 2 = 1) OR value < 2 THEN 0 ELSE r // 12 * 6 + c // 12 + 1 END AS BIGINT) AS label FROM grid),
    ends AS (SELECT image, max(r) AS h, max(c) AS w FROM blobs GROUP BY ALL),
    whole AS (SELECT e.image, r.r, c.c, coalesce(b.label, 0) AS label FROM ends e JOIN range({H}) r(r) ON r.r <= h JOIN range({W}) c(c) ON c.c <= w LEFT JOIN blobs b ON b.image = e.image AND b.r = r.r AND b.c = c.c)"""
EDGES = f"""{BLOBS}, edge AS (SELECT DISTINCT a.* FROM blobs a JOIN whole b ON a.image = b.image AND abs(a.r - b.r) + abs(a.c - b.c) = 1 WHERE a.label <> 0 AND b.label <> a.label),
    far AS (SELECT b.image, b.r, b.c, b.label, e.label AS other, min((b.r - e.r) * (b.r - e.r) + (b.c - e.c) * (b.c - e.c)) AS d2 FROM blobs b JOIN edge e USING (image) GROUP BY ALL),
    shares AS (SELECT *, count(*) OVER (PARTITION BY image, label) AS area, count(*) OVER (PARTITION BY image) AS total, count(CASE WHEN label <> 0 THEN 1 END) OVER (PARTITION BY image) AS labelled FROM blobs),
    counts AS (SELECT image, count(DISTINCT label) AS n FROM blobs WHERE label <> 0 GROUP BY ALL)"""
#: By definition: the nearest of all pixels that have not the label (13 steps reach it in these images).
DISTANCE = f"""{BLOBS}, dist AS (SELECT a.image, a.label, a.r, a.c, sqrt(min((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c))) AS distance FROM blobs a
    JOIN range(27) s(i) ON TRUE JOIN whole b ON b.image = a.image AND b.r = a.r + s.i - 13 AND b.c BETWEEN a.c - 13 AND a.c + 13 WHERE a.label <> 0 AND b.label <> a.label GROUP BY ALL)"""


@query("x5_distance_map", f"WITH {DISTANCE} SELECT image, label, r, c, round(distance, 6) AS distance FROM dist")
def x5(s, d):
    return fi.distance_map(blobs(s, d), KEY).select("image", "label", "r", "c", *r("distance"))


@query("x5_scaled_distances", f"WITH {DISTANCE} SELECT image, label, r, c, round(distance / (max(distance) OVER (PARTITION BY image) / 4) + 1, 6) AS distance FROM dist")
def x5_scaled(s, d):
    return fi.distance_map(blobs(s, d), KEY, edt_max=5).select("image", "label", "r", "c", *r("distance"))


@query("x5_distance_bytes", f"WITH {DISTANCE} SELECT image, label, r, c, CAST(floor(distance / max(distance) OVER (PARTITION BY image, label) * 255) AS INTEGER) AS distance FROM dist")
def x5_bytes(s, d):
    return fi.distance_bytes(blobs(s, d), KEY).select("image", "label", "r", "c", "distance")


def _projected(k: int) -> str:
    """One step of making the basis orthogonal within an image: basis k leaves the later ones and the values."""
    less = lambda x: f"{x} - coalesce(sum({x} * b{k}) OVER w / nullif(sum(b{k} * b{k}) OVER w, 0), 0) * b{k} AS {x}"
    return f"o{k + 1} AS (SELECT image, r, c, {', '.join([*map(less, [f'b{j}' for j in range(k + 1, 6)]), less('v')])} FROM o{k} WINDOW w AS (PARTITION BY image))"


@query(
    "x6_background",
    f"WITH {GRID}, z AS (SELECT image, r, c, value, (r - avg(r) OVER w) / 32 AS y, (c - avg(c) OVER w) / 32 AS x FROM grid WINDOW w AS (PARTITION BY image)), o0 AS (SELECT image, r, c, 1.0::DOUBLE AS b0, y AS b1, x AS b2, y * y AS b3, y * x AS b4, x * x AS b5, value AS v FROM z), "
    + ", ".join(_projected(k) for k in range(6))
    + " SELECT image, r, c, round(v - min(v) OVER (PARTITION BY image), 4) AS corrected FROM o6",
)
def x6(s, d):
    return im.background_removed(grid(s, d), KEY).select("image", "r", "c", *r("corrected", digits=4))


@query(
    "x7_resized_labels",
    f"""WITH {GRID}, n AS (SELECT image, label, CAST(ceil(2 * sqrt(count(*) / pi()) * 0.05 + 1) AS BIGINT) AS size FROM grid WHERE label <> 0 GROUP BY ALL),
    g AS (SELECT DISTINCT image, label, r + size // 2 - i.i AS r, c + size // 2 - j.j AS c FROM grid JOIN n USING (image, label), range(16) i(i), range(16) j(j) WHERE i.i < size AND j.j < size)
    SELECT image, r, c, CAST(sum(label) AS BIGINT) AS label FROM g GROUP BY image, r, c""",
)
def x7(s, d):
    return im.resized_labels(grid(s, d), KEY, 0.05)


@query(
    "x8_weight_map",
    f"""WITH {EDGES}, sums AS (SELECT image, r, c, sum(20 * exp(-d2 / 128.0)) AS border FROM far GROUP BY ALL)
    SELECT image, r, c, label, round((border + CASE WHEN label <> 0 THEN 1 - area / CAST(total AS DOUBLE) ELSE 0 END) / n, 6) AS weight FROM shares JOIN sums USING (image, r, c) JOIN counts USING (image)""",
)
def x8(s, d):
    return fi.weight_map(blobs(s, d), KEY).select("image", "r", "c", "label", *r("weight"))


@query(
    "x8_two_nearest",
    f"""WITH {EDGES}, two AS (SELECT image, r, c, list_sort(list(sqrt(d2))) AS d FROM far GROUP BY ALL)
    SELECT image, r, c, label, round(10 * exp(-((d[1] + coalesce(d[2], 0)) ** 2) / 50) + CASE WHEN label <> 0 THEN 1 - labelled / CAST(total AS DOUBLE) ELSE labelled / CAST(total AS DOUBLE) END, 6) AS weight
    FROM shares JOIN two USING (image, r, c)""",
)
def x8_two(s, d):
    return fi.weight_map(blobs(s, d), KEY, w0=10, sigma=5, nearest_two=True).select("image", "r", "c", "label", *r("weight"))


@query("x9_label_cells")
def x9(s, d):
    return im.cells_from_labels(grid(s, d), KEY)


@query("x10_rasterize", "SELECT sc_id, CAST((x2 - x1 + 1) * (y2 - y1 + 1) AS BIGINT) AS n FROM cells")
def x10(s, d):
    p = lambda a, b: F.array(F.col(a).cast("double"), F.col(b).cast("double"))
    c = cells(s, d).withColumn("contour", F.array(p("x1", "y1"), p("x1", "y2"), p("x2", "y2"), p("x2", "y1")))
    return im.rasterize(c, ["dataset"], 2000, 2000).groupBy("sc_id").agg(F.count("*").alias("n"))


@query("x10_combine", "WITH b AS (SELECT dataset, sc_id, unnest(range(x1 // 16, x2 // 16 + 1)) AS r, y1 // 16 AS c FROM cells) SELECT dataset, r, c, max(sc_id) AS label FROM b GROUP BY ALL")
def x10_combine(s, d):
    p = cells(s, d).select("dataset", "sc_id", F.explode(F.expr("sequence(x1 div 16, x2 div 16)")).alias("r"), F.expr("y1 div 16").alias("c"))
    return im.combine_masks(p, ["dataset"])


@query("x11_piece_counts")
def x11(s, d):
    return im.piece_counts(grid(s, d), KEY)


@query("x12_tiles", f"WITH {GRID}, u AS (SELECT unnest([0, 25, 50, 71]) AS t), t AS (SELECT unnest([0, 25, 39]) AS t) SELECT image, r, c, CAST(a.t AS BIGINT) AS tile_r, CAST(b.t AS BIGINT) AS tile_c FROM grid JOIN u a ON r >= a.t AND r < a.t + 25 JOIN t b ON c >= b.t AND c < b.t + 25")
def x12(s, d):
    return im.cut_tiles(grid(s, d), H, W, 25, 25).select("image", "r", "c", "tile_r", "tile_c")


@query("x13_crop_pad", f"WITH {GRID} SELECT image, r - 23 AS r, c + 3 AS c, value FROM grid WHERE r - 23 BETWEEN 0 AND 49")
def x13(s, d):
    return im.crop_or_pad(grid(s, d), H, W, 50, 71).select("image", "r", "c", "value")


@query("x14_media_rows", "WITH c AS (SELECT class, clip AS sample_id, clip % 7 AS track_id, min(timeframe) AS a, max(timeframe) AS b FROM clips GROUP BY ALL) SELECT CAST(CASE class WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE -1 END AS INTEGER) AS label_index, 'media/' || class || '/' || sample_id || '_trackid-' || track_id || '_' || a || '-' || b || '_pad-' || p || '_' || f || '.mp4' AS path FROM c, unnest([10, 20]) u(p), unnest(['raw', 'mask']) v(f)")
def x14(s, d):
    c = clips(s, d).groupBy("class", F.col("clip").alias("sample_id"), (F.col("clip") % 7).alias("track_id")).agg(F.min("timeframe").alias("start_time"), F.max("timeframe").alias("end_time"))
    return im.media_rows(c, (10, 20), ("raw", "mask"), ["user", "assistant"]).select("label_index", "path")


@query("s15_images_pixels", f"WITH {GRID}, a AS (SELECT DISTINCT image FROM grid) SELECT a.image, CAST(r.r AS BIGINT) AS r, CAST(c.c AS BIGINT) AS c, coalesce(g.value, 0.0) AS value FROM a, range(96) r(r), range(64) c(c) LEFT JOIN grid g ON g.image = a.image AND g.r = r.r AND g.c = c.c")
def s15(s, d):
    return im.pixels_of_images(im.images_of_pixels(grid(s, d), KEY, H, W))


@query("x15_scoring", "SELECT sc_id, area * 2 + 1 AS score FROM cells")
def x15(s, d):
    def score(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"sc_id": b["sc_id"], "score": b["area"] * 2 + 1})

    return im.compute_features(cells(s, d).select("sc_id", "area"), score, "sc_id long, score double")


@query("u10_drop_divided", "SELECT clip, sc_id FROM clips QUALIFY count(*) OVER (PARTITION BY clip, timeframe) = 1 OR class = 'system'")
def u10(s, d):
    return evs.drop_divided_frames(clips(s, d), ["user", "assistant"]).select("clip", "sc_id")


#: conversations cut into clips of four frames
@query("u11_expand_clips", "SELECT clip, CAST(product(n) AS BIGINT) AS variants FROM (SELECT clip * 1000 + timeframe // 4 AS clip, timeframe, count(*) AS n FROM clips GROUP BY ALL) GROUP BY ALL")
def u11(s, d):
    e = evs.expand_clips(clips(s, d).withColumn("clip", F.expr("clip * 1000 + timeframe div 4")))
    per = e.groupBy("clip", "variant").agg(F.array_join(F.sort_array(F.collect_list("sc_id")).cast("array<string>"), ",").alias("v"))
    return per.groupBy("clip").agg(F.count_distinct("v").alias("variants"))


@query("u12_valid_clips", "SELECT clip, count(*) = count(DISTINCT timeframe) AS valid FROM clips GROUP BY ALL")
def u12(s, d):
    return evs.one_cell_each_frame(clips(s, d))


_FAR = "list_transform(acc, lambda s: (s[-1].x - d[1].x) ** 2 + (s[-1].y - d[1].y) ** 2)"


@query(
    "g13_split_divisions",
    f"""WITH k AS (SELECT clip, timeframe, list([struct_pack(t := timeframe, id := sc_id, x := area % 97, y := area % 89)] ORDER BY sc_id) AS f FROM clips GROUP BY ALL),
    p AS (SELECT clip, list(f ORDER BY timeframe) AS fs FROM k GROUP BY ALL),
    q AS (SELECT clip, list_reduce(fs, lambda acc, f: CASE WHEN len(f) = 1 THEN list_transform(acc, lambda s: s || f[1]) ELSE list_transform(f, lambda d: acc[list_position({_FAR}, list_min({_FAR}))] || d) END) AS ss, list_position(list_transform(fs, lambda f: len(f) > 1), TRUE) - 1 AS brk FROM p),
    u AS (SELECT clip, CAST(generate_subscripts(ss, 1) - 1 AS INTEGER) AS series, unnest(ss) AS s, CASE WHEN brk >= 0 THEN CAST(brk AS INTEGER) END AS break_idx FROM q)
    SELECT clip, series, x.t AS timeframe, x.id AS sc_id, break_idx FROM (SELECT clip, series, break_idx, unnest(s) AS x FROM u)""",
)
def g13(s, d):
    c = clips(s, d).selectExpr("clip", "timeframe", "sc_id", "area % 97 AS x", "area % 89 AS y")
    return evs.split_divisions(c)


@query("g16_stay_points")
def g16(s, d):
    return evs.stay_points(cells(s, d), ["area"], 5.0, 3)


#: The rules of the table, over lists of labels
TYPED = """WITH e AS (SELECT event_id // 4 AS event_id, struct_pack(label := event_id, single := (event_id % 10) / 10.0::DOUBLE, fragment := (event_id % 7) / 10.0::DOUBLE, multi := (event_id % 8) / 10.0::DOUBLE, n := event_id % 9, flag := event_id % 11 % 3, area := value + 1) AS m FROM events),
    g AS (SELECT event_id, list(m ORDER BY m.label) AS ms FROM e GROUP BY event_id),
    h AS (SELECT event_id, ms[1] AS hub, list_transform(ms[2:2 + event_id % 3], lambda x: struct_pack(label := x.label, sure := x.n > 5 OR x.flag IN (1, 2), single := x.n > 5 OR x.flag IN (1, 2) OR x.single >= x.fragment, n := x.n, flag := x.flag, area := x.area)) AS m FROM g),
    v AS (SELECT event_id, hub, m, CASE WHEN hub.single >= CASE WHEN hub.n > 5 THEN 0 ELSE hub.multi END THEN 'single' ELSE 'multi' END AS hub_type, hub.n > 5 AS sure, [hub.label] AS own, list_transform(m, lambda x: x.label) AS every,
      list_transform(list_filter(m, lambda x: NOT x.single), lambda x: x.label) AS fragments, list_transform(list_filter(m, lambda x: NOT x.sure), lambda x: x.label) AS unsure, len(list_filter(m, lambda x: x.single)) AS s, len(list_filter(m, lambda x: x.sure)) AS u FROM h),
    w AS (SELECT *, CASE WHEN s > 1 THEN own || fragments WHEN u = 1 THEN own || unsure ELSE own || every END AS multi_rule FROM v),
    x AS (SELECT *, CASE WHEN hub_type = 'multi' THEN multi_rule WHEN s <= 1 THEN fragments WHEN sure AND u = 0 THEN every WHEN sure AND u = 1 THEN unsure WHEN sure THEN {many} WHEN u = 0 THEN own || every WHEN u = 1 THEN own || unsure ELSE own || fragments END AS rule FROM w)"""
LISTED = "array_to_string(list_sort({0}), ',')"
FUSED = "len(m) = 2 AND list_sum(list_transform(m, lambda x: x.flag)) > 1 AND 1 - abs(m[1].area - m[2].area) / (m[1].area + m[2].area) > 0.8"
SPLIT = "hub.flag = 2 OR len(list_filter(m, lambda x: x.flag > 0)) > 0 OR (sure AND len(m) = 2 AND len(list_filter(m, lambda x: x.n > 5)) = 2)"


def typed(s, d, kind):
    t = evs.typed_events(merge_events(s, d), kind)
    return t.select("event_id", "hub_type", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("discard", "division")])


@query(
    "g17_fusion_types",
    TYPED.replace("{many}", "CASE WHEN hub.n < list_max(list_transform(m, lambda x: x.n)) THEN own ELSE every END")
    + f" SELECT event_id, hub_type, {LISTED.format('rule')} AS discard, CASE WHEN {FUSED} THEN {LISTED.format('own || every')} END AS division FROM x",
)
def g17(s, d):
    return typed(s, d, "fusion")


@query(
    "g17_split_types",
    TYPED.replace("{many}", "[]")
    + f""", y AS (SELECT *, {SPLIT} AS candidate FROM x)
    SELECT event_id, hub_type, {LISTED.format("CASE WHEN NOT candidate THEN rule WHEN hub_type = 'single' THEN fragments ELSE multi_rule END")} AS discard,
    CASE WHEN candidate OR (hub_type = 'single' AND s > 1 AND sure AND u > 1) THEN {LISTED.format('own || every')} END AS division FROM y""",
)
def g17_split(s, d):
    return typed(s, d, "split")


def merge_events(s, d):
    """Groups of three events: the first is the hub."""
    m = "named_struct('label', event_id, 'single', event_id % 10 / 10D, 'fragment', event_id % 7 / 10D, 'multi', event_id % 8 / 10D, 'track_length', event_id % 9, 'flag', event_id % 11 % 3, 'area', value + 1)"
    e = table(s, d, "events").selectExpr("event_id div 4 AS event_id", f"{m} AS m")
    g = e.groupBy("event_id").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    return g.select("event_id", F.get("ms", F.lit(0)).alias("hub"), F.slice("ms", F.lit(2), F.expr("CAST(1 + event_id % 3 AS INT)")).alias("members"))


def drawn(text: str) -> str:
    return f"CAST('0x' || substr(md5({text} || ':3'), 1, 8) AS BIGINT)"


@query(
    "o8_sample_clips",
    f"""WITH k AS (SELECT dataset, track_id, timeframe, sc_id, status = 'error' AND sc_id % 5 = 0 AS x, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY dataset, track_id) AS n, {drawn("dataset || ',' || track_id")} % 9 AS o FROM cells WINDOW w AS (PARTITION BY dataset, track_id ORDER BY timeframe)),
    b AS (SELECT *, (k + o) // 9 AS b, (k + o) % 9 AS i FROM k), h AS (SELECT *, {drawn("dataset || ',' || track_id || ',' || b")} AS h FROM b), l AS (SELECT *, 6 + h % 4 AS l FROM h), s AS (SELECT *, (h >> 12) % (9 - l + 1) AS s FROM l),
    c AS (SELECT dataset, track_id, b, h, l, min(timeframe) AS start_time, max(timeframe) AS end_time FROM s WHERE i >= s AND i < s + l AND n > l GROUP BY ALL HAVING count(*) = l AND count(*) FILTER (x) = 0)
    SELECT dataset, track_id, start_time, end_time, CAST(l AS BIGINT) AS n_cells FROM c ORDER BY h, dataset, track_id, b LIMIT 200""",
)
def o8(s, d):
    c = cells(s, d)
    return evs.sample_clips(c, 200, (6, 10), 3, c.where("status = 'error' AND sc_id % 5 = 0"))

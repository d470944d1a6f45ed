"""X9 and X11 by runs against the array kernel, X10 against a test of every pixel, G3 on deep and tangled lineages,
ranks inside hot groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.functions import raster
from trackspark.functions.ranks import ranked
from trackspark.operators import images as im
from trackspark.operators import lineage as li


def pixels(spark, *images):
    rows = [(k, r, c, int(v)) for k, image in enumerate(images) for (r, c), v in np.ndenumerate(image)]
    return spark.createDataFrame(rows, "image int, r long, c long, label long")


def spiral(n):
    """One piece that winds through the whole image, every row and column of it."""
    out = np.zeros((n, n), int)
    for k in range(0, n // 2, 2):
        out[k, k : n - k] = out[n - 1 - k, k : n - k] = out[k : n - k, n - 1 - k] = 1
        out[k + 2 : n - k, k] = 1
        if k + 2 < n // 2:
            out[k + 2, k : k + 3] = 1
    return out


@pytest.mark.parametrize("diagonal", [True, False])
def test_pieces_equal_the_kernel(spark, diagonal):
    rng = np.random.default_rng(2)
    images = [rng.integers(0, 3, (23, 46)) * (rng.random((23, 46)) < p) for p in (0.5, 0.8, 1.0)] + [spiral(44), np.zeros((5, 5), int), np.ones((3, 50), int)]
    runs = im.label_pieces(pixels(spark, *images), ["image"], diagonal=diagonal, tile=4).collect()  # a region over more than ten column blocks
    for k, image in enumerate(images):
        for label in (1, 2):
            got = np.zeros(image.shape, int)
            for x in runs:
                if (x.image, x.label) == (k, label):
                    got[x.r, x.first : x.last + 1] = x.piece
            want, n = raster.pieces(image == label, diagonal)
            assert (got == want).all()
    counts = {(x.image, x.label): x.n_pieces for x in im.piece_counts(pixels(spark, *images), ["image"], diagonal=diagonal).collect()}
    assert counts[3, 1] == 1 and counts[5, 1] == 1 and counts == {(k, label): raster.pieces(i == label, diagonal)[1] for k, i in enumerate(images) for label in (1, 2) if (i == label).any()}


def test_outlines_equal_the_kernel(spark):
    rng = np.random.default_rng(4)
    solid = np.zeros((40, 40), int)
    solid[3:35, 5:38] = 2
    solid[10:20, 10:20] = 0  # a hole
    solid[13:17, 13:17] = 2  # and an island in it
    images = [rng.integers(0, 3, (20, 30)) * (rng.random((20, 30)) < 0.8), spiral(30), solid]
    got = {(x.image, x.label, x.piece): ([list(map(int, p)) for p in x.contour], (x.x1, x.y1, x.x2, x.y2)) for x in im.cells_from_labels(pixels(spark, *images), ["image"]).collect()}
    want = {}
    for k, image in enumerate(images):
        for label in (1, 2):
            number, n = raster.pieces(image == label)
            for piece in range(1, n + 1):
                b = raster.boundary(number == piece)
                if len(b) >= 10:
                    want[k, label, piece] = (b.tolist(), (*b.min(0).tolist(), *(b.max(0) + 1).tolist()))
    assert got == want and len(want) > 3


def filled_by_pixel(contour, h, w):
    """Even-odd rule and distance to each edge, pixel by pixel."""
    out = np.zeros((h, w), bool)
    for r in range(h):
        for c in range(w):
            odd = False
            for (r0, c0), (r1, c1) in zip(contour, np.roll(contour, -1, 0)):
                if (r0 > r) != (r1 > r) and c < c0 + (r - r0) * (c1 - c0) / (r1 - r0):
                    odd = not odd
                on = min(r0, r1) <= r <= max(r0, r1) and min(c0, c1) <= c <= max(c0, c1)
                out[r, c] |= on and abs((r1 - r0) * (c - c0) - (c1 - c0) * (r - r0)) <= 0.5 * max(abs(r1 - r0), abs(c1 - c0), 1e-9)
            out[r, c] |= odd
    return out


def test_filled_polygons(spark):
    rng = np.random.default_rng(6)
    for k in range(120):
        n = rng.integers(1, 9)
        contour = rng.integers(-4, 16, (n, 2)).astype(float) if k % 3 else rng.uniform(-4, 16, (n, 2))
        assert (raster.fill_polygon(contour, 12, 13) == filled_by_pixel(contour, 12, 13)).all()
    round_ = np.linspace(0, 2 * np.pi, 30_000, endpoint=False)
    disc = raster.fill_polygon(np.stack([600 + 500 * np.sin(round_), 600 + 500 * np.cos(round_)], 1), 1200, 1200)  # edges times pixels would be 4e10
    assert abs(disc.sum() / (np.pi * 500.5**2) - 1) < 0.01


def paths(spark, edges, root=None):
    e = spark.createDataFrame(edges, "mother_id long, daughter_id long")
    return sorted(r.path for r in li.lineage_paths(spark, e, root).collect())


def test_paths_of_any_depth(spark):
    chain = [(k, k + 1) for k in range(5000)] + [(2500, 90_000)]
    assert paths(spark, chain, 0) == [list(range(5001)), [*range(2501), 90_000]]
    tree = [((k - 1) // 2, k) for k in range(1, 4095)]

    def up(k):
        return [k] if k == 0 else up((k - 1) // 2) + [k]

    assert paths(spark, tree) == sorted(up(k) for k in range(2047, 4095))


def test_paths_of_tangled_lineages(spark):
    edges = [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (7, 8), (8, 9), (9, 8), (9, 10), (20, 20), (20, 21), (1, 2)]
    assert paths(spark, edges, 1) == [[1, 2, 4, 5], [1, 3, 4, 5]]
    assert paths(spark, edges, 4) == [[4, 5]] and paths(spark, edges, 5) == [[5]] and paths(spark, edges, 99) == [[99]]
    assert paths(spark, edges, 7) == [[7, 8, 9, 10]]  # round the cycle nothing ends
    assert paths(spark, edges) == [[1, 2, 4, 5], [1, 3, 4, 5], [7, 8, 9, 10], [20, 21]]
    assert paths(spark, []) == [] and paths(spark, [], 3) == [[3]]


def test_ranks_of_a_hot_group_spread(spark):
    rows = [(None if k % 5 == 0 else "hot" if k % 2 else f"g{k % 7}", (k * 7919) % 1000, k) for k in range(4000)]
    t = spark.createDataFrame(rows, "g string, t int, id int").repartition(6)
    r = ranked(t, ["g"], ["t", "id"], rows_per_range=300)
    got = {x.id: x["rank"] for x in r.collect()}
    want, seen = {}, {}
    for g, _, i in sorted(rows, key=lambda x: (x[0] or "", x[1], x[2])):
        want[i] = seen.get(g, 0)
        seen[g] = want[i] + 1
    assert got == want and r.collect() == r.collect()
    assert ranked(t, [], ["t", "id"], rows_per_range=300).agg(F.countDistinct("rank"), F.max("rank")).first() == (4000, 3999)
    assert ranked(t.limit(0), ["g"], ["t"]).count() == 0

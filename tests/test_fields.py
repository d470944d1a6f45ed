"""X5 and X8 by their definitions, on whole images, with tiles smaller than the images."""

import numpy as np
import pytest

from trackspark.operators import fields as fi


def table(spark, label, drop=()):
    rows = [(0, r, c, int(v)) for (r, c), v in np.ndenumerate(label) if (r, c) not in drop]
    return spark.createDataFrame(rows, "image int, r long, c long, label long")


def as_image(df, shape, column):
    out = np.full(shape, np.nan)
    for x in df.collect():
        out[x.r, x.c] = x[column]
    return out


def some_labels(rng, shape):
    label = np.zeros(shape, int)
    for k in range(1, 9):
        r, c, h, w = rng.integers(0, shape[0] - 3), rng.integers(0, shape[1] - 3), rng.integers(1, 14), rng.integers(1, 14)
        label[r : r + h, c : c + w] = k
    label[rng.random(shape) < 0.05] = 0
    return label


def edge_of(mask):
    h, w = mask.shape
    return [(r, c) for r in range(h) for c in range(w) if mask[r, c] and any(0 <= y < h and 0 <= x < w and not mask[y, x] for y, x in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)))]


def far(shape, points):
    y, x = np.mgrid[0 : shape[0], 0 : shape[1]]
    return np.min([np.hypot(y - r, x - c) for r, c in points], 0)


def distances(label):
    out = np.full(label.shape, np.nan)
    for r, c in np.argwhere(label != 0):
        others = np.argwhere(label != label[r, c])
        out[r, c] = np.hypot(*(others - (r, c)).T).min()
    return out


def mean_weights(label, w0, sigma):
    ids = [k for k in np.unique(label) if k]
    out = np.zeros(label.shape)
    for k in ids:
        out += w0 * np.exp(-far(label.shape, edge_of(label == k)) ** 2 / (2 * sigma**2))
        out[label == k] += 1 - (label == k).sum() / label.size
    return out / len(ids)


def two_nearest_weights(label, w0, sigma):
    d = np.sort([far(label.shape, edge_of(label == k)) for k in np.unique(label) if k], 0)
    both = d[0] + d[1] if len(d) > 1 else d[0]
    f = (label != 0).sum() / label.size
    return w0 * np.exp(-(both**2) / (2 * sigma**2)) + np.where(label != 0, 1 - f, f)


def test_scaled_distances_of_a_square(spark):
    label = np.zeros((9, 9), int)
    label[1:8, 1:8] = 1
    d = as_image(fi.distance_map(table(spark, label), ["image"], edt_max=5), label.shape, "distance")
    assert d[1, 1] == 2.0 and d[4, 4] == 5.0 and np.isnan(d[0, 0])
    b = as_image(fi.distance_bytes(table(spark, label), ["image"]), label.shape, "distance")
    assert b[1, 1] == 63 and b[4, 4] == 255


def test_distances_of_any_image(spark):
    label = some_labels(np.random.default_rng(3), (31, 45))
    t = table(spark, label)
    want = distances(label)
    assert np.allclose(as_image(fi.distance_map(t, ["image"]), label.shape, "distance"), want, equal_nan=True)
    scaled = as_image(fi.distance_map(t, ["image"], edt_max=10), label.shape, "distance")
    assert np.allclose(scaled, want / (np.nanmax(want) / 9) + 1, equal_nan=True)
    filled = fi.distance_map(table(spark, np.ones((4, 4))), ["image"])
    assert filled.where("distance IS NULL").count() == 16
    # beyond the bounds is nothing, unless the image is said to be larger
    assert fi.distance_map(table(spark, np.ones((4, 4))), ["image"], size=(6, 4)).where("r = 3 AND distance = 1").count() == 4


@pytest.mark.parametrize("tile", [7, 128])
def test_weights_of_every_pixel(spark, monkeypatch, tile):
    monkeypatch.setattr(fi, "TILE", tile)
    label = some_labels(np.random.default_rng(5), (26, 33))
    t = table(spark, label)
    got = as_image(fi.weight_map(t, ["image"], sigma=3), label.shape, "weight")
    assert np.allclose(got, mean_weights(label, 20, 3), atol=1e-8)
    got = as_image(fi.weight_map(t, ["image"], w0=10, sigma=3, nearest_two=True), label.shape, "weight")
    assert np.allclose(got, two_nearest_weights(label, 10, 3), atol=1e-8)


def test_weights_of_odd_images(spark):
    one = np.zeros((11, 11), int)
    one[3:6, 4:9] = 5
    t = table(spark, one)
    assert fi.weight_map(t, ["image"]).count() == 121
    assert np.allclose(as_image(fi.weight_map(t, ["image"]), one.shape, "weight"), mean_weights(one, 20, 8), atol=1e-8)
    assert np.allclose(as_image(fi.weight_map(t, ["image"], nearest_two=True), one.shape, "weight"), two_nearest_weights(one, 20, 8), atol=1e-8)
    for label, weights in ((np.zeros((3, 3), int), (0, 0)), (np.ones((3, 3), int), (0, 0))):
        for two, weight in zip((False, True), weights):
            assert {x.weight for x in fi.weight_map(table(spark, label), ["image"], nearest_two=two).collect()} == {weight}
    # rows that the table leaves out are pixels without a label
    sparse = table(spark, one, drop=[tuple(x) for x in np.argwhere(one == 0)])
    got = fi.weight_map(sparse, ["image"], size=one.shape).where("label = 5")
    assert np.allclose(as_image(got, one.shape, "weight")[one == 5], mean_weights(one, 20, 8)[one == 5], atol=1e-8)

"""Kernels against brute force, readers, evaluation and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.functions import geometry as ge
from trackspark.functions import names, raster
from trackspark.operators import contours as co
from trackspark.operators import evaluate as ev
from trackspark.operators import events as evs
from trackspark.operators import fields as fi
from trackspark.operators import images as im
from trackspark.schema import CELLS, check_columns, flat
from trackspark.sources import io
from trackspark.streaming import live


def blobs(seed, n=16, p=0.6):
    return np.random.default_rng(seed).random((n, n)) < p


def test_distance_transform_against_brute_force():
    for seed in range(5):
        m = np.pad(blobs(seed), 1)
        out = np.argwhere(~m)
        want = np.zeros(m.shape)
        for r, c in np.argwhere(m):
            want[r, c] = np.sqrt(((out - (r, c)) ** 2).sum(1).min())
        assert np.allclose(raster.distance_transform(m), want)


@pytest.mark.parametrize("diagonal", [True, False])
def test_pieces_against_flood_fill(diagonal):
    for seed in range(5):
        m = blobs(seed, p=0.45)
        label, n = raster.pieces(m, diagonal)
        seen, count = np.zeros(m.shape, int), 0
        for at in map(tuple, np.argwhere(m)):
            if seen[at]:
                continue
            count += 1
            stack = [at]
            seen[at] = count
            while stack:
                r, c = stack.pop()
                for dr in (-1, 0, 1):
                    for dc in (-1, 0, 1):
                        q = (r + dr, c + dc)
                        if (diagonal or not (dr and dc)) and 0 <= q[0] < 16 and 0 <= q[1] < 16 and m[q] and not seen[q]:
                            seen[q] = count
                            stack.append(q)
        assert n == count and (label == seen).all()


def test_polygon_kernels():
    assert raster.fill_polygon(np.array([[1.0, 1], [1, 4], [3, 4], [3, 1]]), 6, 6).sum() == 12
    square = [[0.0, 0], [2, 0], [2, 2], [0, 2]]
    same = raster.clip_polygon(square, 3, 3)
    assert sorted(map(tuple, same)) == sorted(map(tuple, square))
    assert sorted(set(map(tuple, raster.clip_polygon(square, 2, 2)))) == sorted(map(tuple, square))
    assert raster.polygon_area(np.array(raster.clip_polygon([[-1.0, -1], [-1, 5], [5, 5], [5, -1]], 2, 3))) == 6
    ring = np.ones((5, 5), bool)
    ring[2, 2] = False
    assert raster.holes_filled(ring).all()
    b = raster.boundary(np.ones((3, 4), bool))
    assert len(b) == 10 and len({tuple(x) for x in b}) == 10
    assert raster.boundary(np.ones((1, 1), bool)).tolist() == [[0, 0]]
    assert raster.resize_by(np.pad(np.ones((3, 3), bool), 3), 0.5).sum() > 9


def test_shapes_of_a_square():
    s = im.shape_of(np.ones((10, 10), bool))
    assert s["area_filled"] == s["area_convex"] == 100 and s["solidity"] == 1 and s["perimeter"] == 36 and s["euler_number"] == 1
    hole = np.ones((5, 5), bool)
    hole[2, 2] = False
    assert im.shape_of(hole)["euler_number"] == 0 and im.shape_of(hole)["area_filled"] == 25


def pixel_table(spark, image, labels=None):
    labels = np.ones(image.shape, int) if labels is None else labels
    rows = [(0, int(r), int(c), float(image[r, c]), int(labels[r, c])) for r in range(image.shape[0]) for c in range(image.shape[1])]
    return spark.createDataFrame(rows, "image int, r long, c long, value double, label long")


def test_moments_of_an_ellipse(spark):
    y, x = np.mgrid[0:61, 0:61]
    label = (((y - 30) / 10) ** 2 + ((x - 30) / 20) ** 2 <= 1).astype(int)
    m = im.region_moments(pixel_table(spark, np.ones((61, 61)), label), ["image"]).first()
    assert m.area == label.sum() and abs(m.centroid_r - 30) < 1e-9
    assert abs(m.axis_major - 40) < 0.5 and abs(m.axis_minor - 20) < 0.5 and abs(abs(m.orientation) - np.pi / 2) < 1e-6
    assert abs(m.eccentricity - np.sqrt(1 - 0.25)) < 0.01


def test_intensities(spark):
    rng = np.random.default_rng(0)
    p = pixel_table(spark, rng.random((20, 20)) * 1000)
    v = [r.normalized for r in im.normalize_intensity(p, ["image"]).collect()]
    assert min(v) >= 0 and max(v) == 255
    assert max(r.normalized for r in im.normalize_by_depth(p, ["image"], 16).collect()) == 65535
    with pytest.raises(ValueError):
        im.normalize_by_depth(p, ["image"], 12)
    y, x = np.mgrid[0:20, 0:20]
    flat_ = im.background_removed(pixel_table(spark, 5 + 2.0 * y - x + 0.1 * y * x), ["image"])
    assert max(r.corrected for r in flat_.collect()) < 1e-6
    mask = np.zeros((10, 10), int)
    mask[2:8, 2:8] = 1
    for top in (5.0, 10.0):
        d = fi.distance_map(pixel_table(spark, np.ones((10, 10)), mask), ["image"], edt_max=top)
        assert max(r.distance for r in d.collect()) == pytest.approx(top)


@pytest.mark.parametrize("to, lo, hi", [(13, 1, 10), (14, 2, 11)])
def test_crop_or_pad(spark, to, lo, hi):
    p = im.crop_or_pad(pixel_table(spark, np.ones((10, 10))), 10, 10, to, to)
    assert p.agg(F.min("r"), F.max("r"), F.min("c"), F.max("c"), F.count("*")).first() == (lo, hi, lo, hi, 100)


def test_haralick_of_two_greys(spark):
    image = np.indices((6, 6)).sum(0) % 2 + 1
    t = im.haralick(pixel_table(spark, image), ["image"]).first()
    assert t.contrast == pytest.approx(0.5) and t.entropy == pytest.approx(1.0, abs=0.1)


def test_label_boundaries_and_raster(spark):
    label = np.zeros((30, 30), int)
    label[5:15, 5:15] = 3
    c = im.cells_from_labels(pixel_table(spark, np.ones((30, 30)), label), ["image"])
    row = c.first()
    assert (row.label, row.piece, row.x1, row.y1, row.x2, row.y2, len(row.contour)) == (3, 1, 5, 5, 15, 15, 36)
    back = im.rasterize(c.withColumn("sc_id", F.col("label")), ["image"], 30, 30)
    assert back.count() == 100


@pytest.mark.parametrize("contour, box", [([(2, 3), (2, 8), (7, 8), (7, 3)], (2, 3, 8, 9)), ([(5, 10)], (5, 10, 6, 11)), ([(-2, -3), (4, 5), (1, -1)], (-2, -3, 5, 6))])
def test_box_of_contour(spark, contour, box):
    d = spark.createDataFrame([([[float(a), float(b)] for a, b in contour],)], "contour array<array<double>>")
    assert tuple(d.select(ge.bbox_exclusive("contour").alias("b")).first().b) == box


def test_contours(spark):
    d = spark.createDataFrame([(1, [[0.0, 0.0], [0.0, 4.0], [2.0, 4.0], [2.0, 0.0]])], "sc_id int, contour array<array<double>>")
    assert d.select(ge.area("contour")).first()[0] == 8 and d.select(ge.length("contour", closed=True)).first()[0] == 12
    assert d.select(ge.contains_point("contour", F.lit(1.0), F.lit(1.0))).first()[0]
    r = d.select(co.resampled(F.col("contour"), 12).alias("c")).first().c
    assert len(r) == 12 and r[1] == [0.0, 1.0]
    turned = d.select("contour", F.transform("contour", lambda p: F.array(F.get(p, F.lit(1)) + 9, -F.get(p, F.lit(0)))).alias("b"))
    assert co.rigid_aligned(turned, "contour", "b").first().distance < 1e-9
    with pytest.raises(Exception, match="differ in size"):
        co.mean_contour(d.unionByName(d.withColumn("contour", F.slice("contour", 1, 2))).withColumn("k", F.lit(1)), ["k"]).collect()


def test_pareto_ranks_by_definition(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(0, 12, (80, 3)).astype(float)
    d = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(v)], "id int, a double, b double, c double").repartition(5)
    left, want, rank = set(range(80)), {}, 1
    while left and rank <= 4:
        front = {i for i in left if not any((v[j] >= v[i]).all() and (v[j] > v[i]).any() for j in left)}
        want |= dict.fromkeys(front, rank)
        left -= front
        rank += 1
    assert {r.id: r.pareto_rank for r in ev.pareto_ranks(d, "id", ["a", "b", "c"], 4).collect()} == want


def test_splits_and_selection(spark):
    d = spark.createDataFrame([(k, "big" if k else "one") for k in range(1001)], "id int, s string")
    got = ev.stratified_split(d, "id", "s").collect()
    n = [sum(r.split == p for r in got if r.s == "big") for p in ("train", "val", "test")]
    assert n == [700, 150, 150] and [r.split for r in got if r.s == "one"] == ["train"]
    assert sorted(got) == sorted(ev.stratified_split(d.repartition(9), "id", "s").collect())
    e = ev.evenly_spaced(d.withColumn("t", F.col("id") % 10), 7, "t", "id").collect()
    assert len(e) == 7
    z = ev.zscore(spark.createDataFrame([(1.0, 5.0), (4.0, 5.0), (7.0, 5.0)], "a double, b double"), ["a", "b"]).toPandas()
    assert abs(z["a"].mean()) < 1e-12 and z["a"].std(ddof=0) == pytest.approx(1) and (z["b"] == 0).all()
    scores, var = ev.principal_components(spark.createDataFrame([(k, float(k), 2.0 * k) for k in range(9)], "id int, a double, b double"), ["a", "b"], 2, "id")
    assert var.first().ratio == pytest.approx(1.0) and scores.count() == 9


def stored_cells(spark):
    row = lambda t, f: ("d", f"{t}-{f}", t, f, (1.0, 2.0, 3.0, 4.0), [[1.0, 2.0], [3.0, 4.0]] if t != 9 else [], {"k": {"a": 1.5}}, {"m": "x"}, None)
    return spark.createDataFrame([row(1, 0), row(1, 1), row(2, 0), row(9, 0)], CELLS)


def test_cells_and_tracks_round_trip(spark, tmp_path):
    c = stored_cells(spark)
    io.write_cells_json(c, str(tmp_path / "c"))
    back = io.read_cells_json(spark, str(tmp_path / "c"), multi_line=False)
    drop = lambda d: sorted(str(r) for r in d.withColumn("meta", F.col("meta")["m"]).collect())
    assert drop(back) == drop(c) and all("file:" in r.meta["src_json"] for r in back.collect())
    io.write_tracks_json(c, str(tmp_path / "t"))
    t = io.read_track_lines(spark, str(tmp_path / "t"))
    assert all(r.track_meta == {} for r in t.collect())
    both = c.unionByName(c.where("track_id = 1").withColumn("dataset", F.lit("e")).withColumn("sc_id", F.concat("sc_id", F.lit("e"))))
    meta = spark.createDataFrame([("d", 1, {"mother": "2", "daughters": "[3, 4]"}), ("e", 1, {"mother": "7"})], "dataset string, track_id long, meta map<string, string>")
    io.write_tracks_json(both, str(tmp_path / "u"), meta)
    back = {(r.dataset, r.sc_id): r.track_meta for r in io.read_track_lines(spark, str(tmp_path / "u")).collect()}
    assert back == {("d", "1-0"): {"mother": "2", "daughters": "[3, 4]"}, ("d", "1-1"): {"mother": "2", "daughters": "[3, 4]"}, ("d", "2-0"): {}, ("e", "1-0e"): {"mother": "7"}, ("e", "1-1e"): {"mother": "7"}}
    assert sorted(r.sc_id for r in t.collect()) == ["1-0", "1-1", "2-0"]  # the track without a contour is left out
    assert {r.x2 for r in flat(c).collect()} == {3.0}
    (tmp_path / "one.json").write_text('{"3": {"track_id": 3, "timeframe_to_single_cell": {"7.0": {"sc_id": "a", "contour": [[1, 2]]}}, "meta": {"mother": "1"}}}')
    r = io.read_tracks_json(spark, str(tmp_path / "one.json")).first()
    assert (r.track_id, r.timeframe, r.sc_id, r.contour, r.track_meta) == (3, 7, "a", [[1.0, 2.0]], {"mother": "1"})


def test_annotation_readers(spark, tmp_path):
    (tmp_path / "coco.json").write_text('{"images": [{"id": 4, "file_name": "x"}], "annotations": [{"id": 1, "image_id": 4, "category_id": 2, "bbox": [1, 2, 3, 4], "segmentation": [[1, 2, 4, 2, 4, 6]]}]}')
    r = io.read_coco(spark, str(tmp_path / "coco.json")).first()
    assert (r.timeframe, r.x1, r.y1, r.x2, r.y2, r.contour) == (4, 2.0, 1.0, 7.0, 5.0, [[2.0, 1.0], [2.0, 4.0], [6.0, 4.0]])
    box = lambda w, h, polygons: (tmp_path / "c2.json").write_text(f'{{"images": [{{"id": 4, "file_name": "x"}}], "annotations": [{{"id": 1, "image_id": 4, "category_id": 2, "bbox": [0, 0, {w}, {h}], "segmentation": {polygons}}}]}}')
    box(5.5, 9, "[[1, 2, 5, 2, 5, 4]]")  # an end beyond the contour stays, one that it reaches is raised
    r = io.read_coco(spark, str(tmp_path / "c2.json")).first()
    assert (r.x2, r.y2) == (9.0, 5.5)
    box(5, 4, "[[1, 2, 5, 2, 5, 4]]")
    r = io.read_coco(spark, str(tmp_path / "c2.json")).first()
    assert (r.x2, r.y2) == (5.0, 6.0)
    box(5, 4, "[[1, 2, 5, 2, 5, 4], [7, 7, 8, 8, 9, 9]]")
    with pytest.raises(Exception, match="several polygons"):
        io.read_coco(spark, str(tmp_path / "c2.json")).collect()
    (tmp_path / "me").mkdir()
    (tmp_path / "me" / "f12.json").write_text('{"shapes": [{"label": "b", "shape_type": "rectangle", "points": [[1, 2], [5, 9]]}, {"label": "a", "shape_type": "polygon", "points": [[0, 0], [0, 2], [2, 2]]}]}')
    got = {r.label: r for r in io.read_labelme(spark, str(tmp_path / "me")).collect()}
    assert got["b"].image_id == 12 and got["b"].bbox == [1.0, 2.0, 4.0, 7.0] and (got["b"].category_id, got["a"].category_id) == (1, 2)
    (tmp_path / "l.xml").write_text('<f><a id="1"><ss><s i="0" x="1" y="2" s="0"/><s i="1" x="1" y="2" s="7"/></ss><as><a id="2"><ss><s i="2" x="3" y="4" s="0"/></ss></a><a id="3"><ss><s i="2" x="5" y="6" s="0"/></ss></a></as></a></f>')
    frames, divisions = io.read_lineage_xml(spark, str(tmp_path / "l.xml"))
    assert [(r.mother, r.daughters) for r in divisions.collect()] == [(1, [2, 3])]
    assert sorted((r.cell, r.timeframe, r.x, r.status) for r in frames.collect()) == [(1, 0, 1.0, 0), (1, 1, 1.0, 7), (2, 2, 3.0, 0), (3, 2, 5.0, 0)]


def test_names(spark):
    d = spark.createDataFrame([("/x/man_seg012.tif",), (r"C:\a\b\c\t7.png",), ("none",)], "p string")
    assert [r[0] for r in d.select(names.time_point(F.col("p"))).collect()] == [12, 7, None]
    assert d.select(names.last_parts(F.col("p"))).collect()[1][0] == "b/c/t7.png"
    with pytest.raises(ValueError):
        check_columns(d, ["q"])


def test_live_tracking_equals_batch(spark, tmp_path):
    from trackspark.operators.tracking import track_boxes

    rows = [("m", t, 100 * k + t, 40.0 * k + 2 * t, 3.0 * t, 40.0 * k + 2 * t + 20, 3.0 * t + 20) for k in range(3) for t in range(10) if (k, t) != (1, 4)]
    d = spark.createDataFrame(rows, "dataset string, timeframe int, sc_id long, x1 double, y1 double, x2 double, y2 double")
    d = d.withColumn("ts", F.timestamp_seconds(1_700_000_000 + F.col("timeframe") * 60))
    late = d.where("timeframe = 2").withColumn("sc_id", F.col("sc_id") + 5000).limit(1)
    end = spark.createDataFrame([("other", 9999, 1, 0.0, 0.0, 1.0, 1.0)], "dataset string, timeframe int, sc_id long, x1 double, y1 double, x2 double, y2 double").withColumn("ts", F.timestamp_seconds(F.lit(1_700_099_999)))
    schema = d.schema
    for k, part in enumerate((d, end.select(*d.columns), late.select(*d.columns))):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/p{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    out = live.run_to_table(live.live_tracks(stream, "1 second", max_age=2, min_hits=1), "live_out", str(tmp_path / "ck")).where("dataset = 'm'").collect()
    batch = {(r.sc_id, r.track_id) for r in track_boxes(d, max_age=2, min_hits=1).collect()}
    assert {(r.sc_id, r.track_id) for r in out if r.kind == "cell"} == batch


def test_windows_and_sessions(spark):
    d = spark.createDataFrame([(0, 1, m) for m in (0, 5, 40, 42)], "dataset int, track_id long, m int").withColumn("ts", F.timestamp_seconds(F.col("m") * 60))
    assert sorted(r.n_cells for r in live.window_counts(d, "30 minutes").collect()) == [2, 2]
    assert sorted(r.n_cells for r in live.activity_sessions(d, "10 minutes").collect()) == [2, 2]


def test_late_detections_are_counted_and_change_nothing(spark, tmp_path):
    row = lambda t, k: ("m", t, 10 * t + k, 1_700_000_000 + 60 * t + k, 0.0, 0.0, 20.0, 20.0)
    schema = "dataset string, timeframe int, sc_id long, s long, x1 double, y1 double, x2 double, y2 double"
    make = lambda rows: spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s")).drop("s")
    source = lambda: spark.readStream.schema(make([row(0, 0)]).schema).parquet(str(tmp_path / "in"))
    run = lambda: live.run_once(live.live_tracks(source(), "1 minute", max_age=2, min_hits=1), "late", str(tmp_path / "ck"))
    make([row(t, 0) for t in range(8)] + [row(20, 0)]).write.mode("append").parquet(str(tmp_path / "in"))
    assert live.dropped_late(run()) == 0
    make([row(3, 1), row(5, 2), row(23, 0)]).write.mode("append").parquet(str(tmp_path / "in"))
    assert live.dropped_late(run()) == 2
    got = spark.read.parquet(str(tmp_path / "ck_rows")).collect()
    assert {r.sc_id for r in got if r.kind == "cell"} == {10 * t for t in range(8)}
    # the track ends once frames 8 to 10 lack it, with the number of its cells
    assert [(r.timeframe, r.n) for r in got if r.kind == "end"] == [(10, 8)]


def test_experiment_logs_at_their_depth_only(spark, tmp_path):
    for at in ("random_run3/ctc_seg_a", "random_run3/ctc_seg_a/deeper", "random_run3/other", "lc_run12_x/ctc_seg_b", "norun/ctc_seg_c"):
        (tmp_path / at).mkdir(parents=True, exist_ok=True)
        (tmp_path / at / "exp_iteration_metrics.csv").write_text("iteration,test_iou\n1,0.5\n")
        (tmp_path / at / "exp_epoch_metrics.csv").write_text("iteration,test_iou\n9,0.9\n")
    got = io.read_experiment_logs(spark, str(tmp_path), "iteration INT, test_iou DOUBLE").select("strategy_name", "run_id", "iteration").collect()
    assert sorted(map(tuple, got)) == [("lc", 12, 1), ("random", 3, 1)]


def test_region_kernels_against_brute_force(spark):
    image = np.random.default_rng(2).integers(0, 3, (14, 14))
    p = pixel_table(spark, image, image)
    for scale in (0.05, 0.3, -0.2):
        want = {}
        for label in (1, 2):
            mask = np.pad(image == label, 20)
            size = int(np.ceil(2 * np.sqrt(mask.sum() / np.pi) * abs(scale) + 1))
            lo = size // 2
            for r, c in np.argwhere(np.ones(mask.shape, bool))[: mask.size]:
                part = mask[max(r - lo, 0) : r - lo + size, max(c - lo, 0) : c - lo + size]
                if part.size == size * size and (part.any() if scale > 0 else part.all()):
                    want[r - 20, c - 20] = want.get((r - 20, c - 20), 0) + label
        got = {(r.r, r.c): r.label for r in im.resized_labels(p, ["image"], scale).collect()}
        assert sum(got.values()) == sum(want.values()) and len(got) == len(want)
    counts = {r.label: r.n_pieces for r in im.piece_counts(p, ["image"]).collect()}
    assert counts == {k: raster.pieces(image == k)[1] for k in (1, 2)}
    shapes = {r.label: r for r in im.region_shapes(p, ["image"]).collect()}
    assert all(shapes[k].perimeter == pytest.approx(im.shape_of(image == k)["perimeter"]) for k in (1, 2))


def test_stay_points_against_the_definition(spark):
    rng = np.random.default_rng(4)
    rows = [("d", k, t, float(v)) for k in range(3) for t, v in enumerate(np.round(np.cumsum(rng.normal(0, 1.5, 90)), 1))]
    got = sorted((r.track_id, r.timeframe, r.density, r.duration) for r in evs.stay_points(spark.createDataFrame(rows, "dataset string, track_id long, timeframe int, a double"), ["a"], 2.0, 4).collect())
    want = []
    for k in range(3):
        v = np.array([r[3] for r in rows if r[1] == k])
        near = np.abs(v[:, None] - v[None]) <= 2.0
        found = []
        for i in np.argsort(-near.sum(1), kind="stable"):
            lo, hi = i, i
            while lo > 0 and near[i, lo - 1]:
                lo -= 1
            while hi + 1 < len(v) and near[i, hi + 1]:
                hi += 1
            if hi - lo + 1 >= 4 and not near[i, found].any():
                found.append(i)
                want.append((k, int(i), int(near[i].sum()), int(hi - lo + 1)))
    assert got == sorted(want) and want


def test_shape_modes_and_components_against_svd(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(0, 1, (60, 6)) @ np.diag([5, 3, 2, 1, 0.5, 0.1]) @ np.linalg.qr(rng.normal(0, 1, (6, 6)))[0]
    d = spark.createDataFrame([(k, x.reshape(3, 2).tolist()) for k, x in enumerate(v)], "id int, contour array<array<double>>").repartition(3)
    positions, modes = co.shape_modes(d, "id", variance=0.9)
    _, s, axes = np.linalg.svd(v - v.mean(0), full_matrices=False)
    k = int(np.searchsorted(np.cumsum(s**2) / (s**2).sum(), 0.9) + 1)
    assert modes.shape == (6, k) and np.allclose(np.abs(np.diag(axes[:k] @ modes)), 1)
    got = np.array([r.positions for r in positions.orderBy("id").collect()])
    assert np.allclose(np.abs(got), np.abs((v - v.mean(0)) @ axes[:k].T))
    flat_ = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(v)], "id int, a double, b double, c double, d double, e double, f double").repartition(3)
    scores, ratio = ev.principal_components(flat_, list("abcdef"), 3, "id")
    assert np.allclose([r.ratio for r in ratio.collect()], (s**2 / (s**2).sum())[:3])
    assert np.allclose(np.abs([tuple(r)[1:] for r in scores.orderBy("id").collect()]), np.abs((v - v.mean(0)) @ axes[:3].T))
    x = v.copy()
    x[3, 0] = x[5, 4] = np.nan
    c = ev.correlations(spark.createDataFrame([(i, *map(float, y)) for i, y in enumerate(x)], flat_.schema), ["a", "b"], ["e", "f"]).collect()
    for r in c:
        p, q = x[:, "abcdef".index(r.dim)], x[:, "abcdef".index(r.feature)]
        ok = ~np.isnan(p) & ~np.isnan(q)
        assert r.corr == pytest.approx(np.corrcoef(p[ok], q[ok])[0, 1])
    assert ev.pareto_ranks(flat_.limit(0), "id", ["a", "b"], 2).count() == 0

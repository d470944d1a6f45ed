"""Kernels that take many small regions, polygons or movies at once, against one at a time."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trackspark.functions import raster
from trackspark.operators import contours as co
from trackspark.operators import events as evs
from trackspark.operators import images as im
from trackspark.plans import adapters


def pixels(spark, *images):
    rows = [(k, r, c, int(v)) for k, image in enumerate(images) for (r, c), v in np.ndenumerate(image)]
    return spark.createDataFrame(rows, "image int, r long, c long, label long")


def test_polygons_are_handed_over_as_runs(spark):
    """A row of a box is one row from Python, and a batch of polygons gives what each alone gives."""
    rng = np.random.default_rng(3)
    contours = [rng.integers(-4, 30, (n, 2)).astype(float).tolist() for n in (1, 2, 3, 4, 7, 5, 3)] + [[], [[2.0, 3.0], [2.0, 8.0], [7.0, 8.0], [7.0, 3.0]]]
    cells = spark.createDataFrame([(k % 2, k, c) for k, c in enumerate(contours)], "dataset int, sc_id int, contour array<array<double>>").coalesce(1)
    for canvas in (1, 1 << 21):
        runs = im.rasterized_runs(cells, ["dataset"], 25, 20, canvas).collect()
        for k, c in enumerate(contours):
            got = np.zeros((25, 20), bool)
            for x in runs:
                if x.sc_id == k:
                    got[x.r, x.first : x.last + 1] = True
            assert (got == (raster.fill_polygon(np.array(c), 25, 20) if c else 0)).all()
        assert sum(x.sc_id == 8 for x in runs) == 6
    assert im.rasterize(cells, ["dataset"], 25, 20).where("sc_id = 8").agg(F.count("*"), F.min("c"), F.max("r")).first() == (36, 3, 7)


def test_groups_over_arrow_batches(spark):
    """A kernel gets whole groups, many at once, also a group of several batches and null keys."""
    from trackspark.functions.groups import in_groups, numbers

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        d = spark.range(200).selectExpr("IF(id < 3, NULL, CAST(SQRT(id) AS INT)) AS k", "id AS v").repartition(3)

        def kernel(t, starts):
            (v,) = numbers(t, "v")
            assert all((np.diff(x) > 0).all() for x in np.split(v, starts[1:]))
            yield pa.RecordBatch.from_arrays([t.column("k").combine_chunks().take(pa.array(starts)), pa.array(np.add.reduceat(v, starts))], ["k", "s"])

        got = sorted(map(tuple, in_groups(d, ["k"], ["v"], kernel, "k int, s long").collect()), key=str)
        assert got == sorted(map(tuple, d.groupBy("k").agg(F.sum("v")).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_pieces_meet_at_borders_of_tiles_only(spark, monkeypatch):
    """X11: images inside one tile need no component search over the table; small tiles give the same counts."""
    rng = np.random.default_rng(7)
    p = pixels(spark, *(rng.integers(0, 3, (30, 41)) for _ in range(3)), np.ones((9, 9), int)).cache()
    count = lambda tile, diagonal: {(x.image, x.label): x.n_pieces for x in im.piece_counts(p, ["image"], diagonal=diagonal, tile=tile).collect()}
    small = {d: count(8, d) for d in (True, False)}
    monkeypatch.setattr(im, "components", lambda edges: pytest.fail("nothing meets outside its tile"))
    assert {d: count(256, d) for d in (True, False)} == small and small[True] != small[False]


def test_gap_scores_next_to_ties_and_without_area(spark, tmp_path):
    """J7 against its SQL: scores whose fifth digit is next to a 5, and areas of 0."""
    duckdb = pytest.importorskip("duckdb")
    from trackspark.plans.registry import ORACLES, QUERIES

    found = [(40070, 36334, 96.0, 235.27), (57567, 63223, 32.0, 132.35), (0, 1, 0.0, 0.0), (7, 7 + 960 * 4, 0.0, 3.0), (7, 7 + 960 * 4, 0.0, 0.0)]
    rows = [(e, f"2024-01-01 0{h}:00:00", 30 * k + i, v) for k, (a, b, la, fa) in enumerate(found) for i, (e, h, v) in enumerate(((a, 1, la), (b, 2, fa)))]
    d = spark.createDataFrame(rows, "event_id long, ts string, user_id long, value double").selectExpr("event_id", "CAST(ts AS TIMESTAMP_NTZ) AS ts", "user_id", "'view' AS event_type", "value")
    d.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    for t in ("lineitem", "embeddings", "documents", "labels", "orders", "customer", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.execute(ORACLES["j7_gap_pairs"]).fetchall())
    assert sorted(map(tuple, QUERIES["j7_gap_pairs"](spark, str(tmp_path)).collect())) == want and len(want) == len(found)


def test_distances_are_measured_once(spark):
    """Scaled distances and bytes don't measure a label twice, and many labels share a call of Python."""
    from trackspark.operators import fields as fi

    rng = np.random.default_rng(8)
    image = np.kron(rng.integers(0, 9, (6, 7)), np.ones((4, 5), int))
    p = pixels(spark, image)
    for d in (fi.distance_map(p, ["image"], edt_max=5), fi.distance_bytes(p, ["image"])):
        plan = d._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") <= 1 and "FlatMapGroups" not in plan
    want = {k: raster.distance_transform(image == k) for k in np.unique(image) if k}
    got = {(x.r, x.c): x.distance for x in fi.distance_bytes(p, ["image"]).collect()}
    assert got == {(r, c): int(np.floor(d[r, c] / d.max() * 255)) for k, d in want.items() for r, c in np.argwhere(image == k)}


def test_movies_of_one_task_are_tracked_whole(spark, monkeypatch):
    """Movies of up to ``rows_per_task`` rows need no parts, and parts give the same tracks."""
    from trackspark.operators import tracking as tk

    rng = np.random.default_rng(9)
    rows = [(m, t, 1000 * m + 20 * t + k, *(x := rng.integers(0, 60, 2).astype(float).tolist()), x[0] + 20, x[1] + 20) for m in range(2) for t in range(12) for k in range(4)]
    c = spark.createDataFrame(rows, "dataset int, timeframe int, sc_id long, x1 double, y1 double, x2 double, y2 double")
    tracked = lambda n: {tuple(x) for x in tk.track_boxes(c, 2, 1, rows_per_task=n).collect()}
    parts = tracked(10)
    monkeypatch.setattr(tk, "movie_parts", lambda cells, *a: pytest.fail("cut into parts") if not cells.isEmpty() else cells)
    assert tracked(48) == parts and parts


def test_contours_are_turned_in_stacks(spark):
    """contours of any numbers of points in one batch, each as alone; null stays null."""
    rng = np.random.default_rng(11)
    given = [rng.normal(0, 5, (n, 2)).tolist() for n in (4, 7, 4, 1, 2, 4)] + [None, []]
    d = spark.createDataFrame(list(enumerate(given)), "id int, contour array<array<double>>").coalesce(1)
    got = {x.id: x.c for x in d.select("id", co.axis_aligned(F.col("contour")).alias("c")).collect()}
    assert got[6] is None and got[7] == [] and got[3] == [[0.0, 0.0]]
    for k in (0, 1, 2, 4, 5):
        p = np.array(given[k]) - np.mean(given[k], 0)
        _, _, v = np.linalg.svd(p, full_matrices=False)
        v = v * np.where(np.take_along_axis(v, np.abs(v).argmax(1)[:, None], 1) < 0, -1, 1)
        assert np.allclose(got[k], p @ v.T)


def test_shape_modes_make_their_contours_once(spark):
    """What makes the contours runs once for all passes over them."""
    rng = np.random.default_rng(12)
    d = spark.createDataFrame([(k, rng.normal(0, 1, (4, 2)).tolist()) for k in range(30)], "id int, contour array<array<double>>").repartition(3)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    assert co.shape_modes(d.mapInArrow(counted, d.schema), "id")[0].count() == 30 and seen.value == 30


def test_tasks_get_a_bounded_number_of_pixels(spark, rows, monkeypatch):
    """A34 and what else aggregates by pixel: tasks grow in number with the table, not in rows."""
    at = "/root/testdata/sf0.001"
    want = rows(adapters.unique_pixels(spark, at))
    monkeypatch.setattr(adapters, "PIXELS_PER_TASK", 500)
    p = adapters.unique_pixels(spark, at)
    sizes = [x[1] for x in p.groupBy(F.spark_partition_id()).count().collect()]
    assert rows(p) == want and len(sizes) >= spark.read.parquet(f"{at}/lineitem.parquet").count() // 500 and max(sizes) < 1000


def test_clips_are_split_many_at_once(spark, rows):
    """Clips cost no call of Python each; a clip of several Arrow batches, and ties of distance."""
    cells = [(k, t, 10 * t + n, float(t), float(n * t)) for k in range(50) for t in range(6) for n in range(2 if t in (2, 5) and k % 2 else 1)]
    d = spark.createDataFrame(cells, "clip int, timeframe int, sc_id long, x double, y double").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        s = evs.split_divisions(d)
        got = rows(s)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = s._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan
    # at the second division both cells are as near to either series, so the first goes on twice
    assert sorted(x[1:] for x in got if x[0] == 1) == sorted((n, t, 10 * t + (n if t == 5 else 0), 2) for n in range(2) for t in range(6))
    assert all(x[1] == 0 and x[4] is None for x in got if x[0] % 2 == 0) and len({x[0] for x in got}) == 50


def test_groups_are_dealt_over_more_tasks_where_rows_ask_for_it(spark):
    """X11: a task sorts ``rows_per_task`` rows, about, whatever the number of shuffle partitions."""
    from trackspark.functions.groups import in_groups, numbers

    d = spark.range(600).selectExpr("id div 2 AS k", "id AS v")

    def kernel(t, starts):
        yield pa.RecordBatch.from_arrays([pa.array(numbers(t, "k")[0][starts])], ["k"])

    out = in_groups(d, ["k"], ["v"], kernel, "k long", 600, 20).withColumn("task", F.spark_partition_id())
    assert out.select("k").distinct().count() == out.count() == 300 and out.select("task").distinct().count() > 20


def test_hulls_walk_along_the_ends_of_rows():
    """A10: the hull of a filled square of 3,600 points looks at two points a row."""
    import sys

    points, calls = np.argwhere(np.ones((60, 60))), 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event == "c_call"

    sys.setprofile(count)
    try:
        around = raster.hull(points)
    finally:
        sys.setprofile(None)
    assert around.tolist() == [[0, 0], [59, 0], [59, 59], [0, 59]] and calls < 3000


def counted(df):
    """The table and a counter of the rows that jobs have made of it."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), seen


@pytest.mark.parametrize("ahead, rounds", [(32, 2), (3, 5)])
def test_zero_maps_are_made_once_and_blocks_go_on_from_there(spark, rows, monkeypatch, ahead, rounds):
    """J6 against a plain loop, over frames with holes; blocks that follow each other need fewer rounds."""
    from trackspark.operators import overlap as ov

    rng = np.random.default_rng(14)
    made = [(m, t, 1000 * m + 4 * t + k, *(x := rng.integers(0, 150, 2).tolist()), x[0] + 20, x[1] + 20) for m in range(2) for t in range(90) if t % 7 for k in range(2)]
    c = spark.createDataFrame(made, "dataset int, timeframe int, sc_id long, x1 long, y1 long, x2 long, y2 long").cache()
    share = lambda p, q: max(min(p[5], q[5]) - max(p[3], q[3]), 0) * max(min(p[6], q[6]) - max(p[4], q[4]), 0) / 400
    zero = [p for p in made if not any(q[:2] == (p[0], p[1] + 1) and share(p, q) > 0.3 for q in made)]
    z = ov.zero_maps(ov.frame_pairs(c), c, ov.FRAME)
    assert rows(z.select(c.columns)) == sorted(zero, key=str)
    assert rows(ov.find_maps(ov.frame_pairs(c), c, ov.FRAME).where("n_targets = 0").select("sc_a")) == sorted([(p[2],) for p in zero], key=str)
    want = []
    for p in zero:
        stop = min((q[1] for q in made if q[0] == p[0] and q[1] > p[1] and share(p, q) > 0.5), default=90)
        want += [(p[0], p[2], t) for t in range(p[1], stop) if t % 7]
    labels, write = [], ov.Rounds.write
    monkeypatch.setattr(ov.Rounds, "write", lambda self, df, label: labels.append(label) or write(self, df, label))
    once, seen = counted(z)
    assert rows(ov.extend_zero_maps(once, c, 0.5, ahead)) == sorted(want, key=str)
    assert seen.value == len(zero) and sum(x[0] == "h" for x in labels) == rounds


@pytest.mark.parametrize("frames, rounds", [(128, 2), (16, 5)])
def test_signals_search_blocks_that_go_on_from_there(spark, monkeypatch, frames, rounds):
    """J11 against a plain loop; blocks that follow each other need fewer rounds, and the query makes its cells once."""
    from trackspark.operators import linking as lk
    from trackspark.plans import overlap_queries as oq

    rng = np.random.default_rng(15)
    made = [(m, t, 1000 * m + t, *(x := rng.integers(0, 200, 2).tolist()), x[0] + 40, x[1] + 30) for m in range(2) for t in range(600) if t % 5 and not 100 < t < 180]
    d = spark.createDataFrame(made, "dataset int, timeframe int, sc_id long, x1 long, y1 long, x2 long, y2 long")
    at = lambda p: ((p[2] * 53 % 230) + 0.5, (p[2] * 71 % 230) + 0.5)
    want = {}
    for p in made:
        x, y = at(p)
        want[p[2]] = max(((q[1], q[2]) for q in made if q[0] == p[0] and q[1] <= p[1] and q[3] < x < q[5] and q[4] < y < q[6]), default=None)
    labels, write = [], lk.Rounds.write
    monkeypatch.setattr(lk.Rounds, "write", lambda self, df, label: labels.append(label) or write(self, df, label))
    corner = lambda a, b: F.array(F.col(a).cast("double"), F.col(b).cast("double"))
    shaped = d.withColumn("contour", F.array(corner("x1", "y1"), corner("x1", "y2"), corner("x2", "y2"), corner("x2", "y1"))).cache()
    s = d.selectExpr("dataset", "sc_id AS sig_id", "timeframe", "(sc_id * 53 % 230) + 0.5D AS x", "(sc_id * 71 % 230) + 0.5D AS y")
    got = {r.sig_id: (r.timeframe, r.sc_id) for r in lk.signals_to_cells(s, shaped, frames=frames).collect()}
    assert got == {k: v for k, v in want.items() if v} and 0 < len(got) < len(made)
    assert sum(x[0] == "f" for x in labels) == rounds
    once, seen = counted(d)
    monkeypatch.setattr(oq, "cells", lambda *_: once)
    assert oq.j11(spark, "").count() > 0 and seen.value == len(made)

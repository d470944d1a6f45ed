"""Hand-made cases of filters, track statistics, windows and edits."""

import pytest
from pyspark.sql import functions as F

from trackspark.functions.graph import components
from trackspark.operators import filters as fl
from trackspark.operators import tracks as tr


def boxes(spark, rows):
    return spark.createDataFrame([(0, k, 0, n, *map(float, b)) for k, (n, b) in enumerate(rows)], "dataset int, track_id long, timeframe int, sc_id string, x1 double, y1 double, x2 double, y2 double")


A, B = ("a", (10, 10, 20, 20)), ("b", (50, 50, 60, 60))


@pytest.mark.parametrize(
    "third, dist, bounds, centre, kept",
    [
        ([A, B, ("c", (90, 90, 190, 190))], 30, (0, 0, 200, 200), False, "b"),
        ([("a", (9, 9, 20, 20)), B, ("c", (90, 90, 180, 180))], 10, (0, 0, 200, 200), False, "bc"),
        ([("a", (9, 9, 20, 20)), ("b", (50, 50, 66, 66)), ("c", (90, 90, 180, 180))], 5, (0, 0, 70, 70), False, "a"),
        ([("a", (9, 9, 40, 40)), B, ("c", (90, 90, 180, 180))], 10, (0, 0, 200, 200), True, "abc"),
    ],
)
def test_border_filter(spark, third, dist, bounds, centre, kept):
    c = boxes(spark, third)
    got = [r.sc_id for r in fl.inner_cells(c, dist, bounds, centre).collect()]
    assert "".join(sorted(got)) == kept
    off = fl.tracks_off_border(c, dist, bounds, centre)
    assert "".join(sorted(r.sc_id for r in off.collect())) == kept


@pytest.mark.parametrize(
    "segments, merged",
    [
        ([(0, 1)], [(0, 1)]),
        ([(2, 3), (0, 1), (4, 5)], [(0, 1), (2, 3), (4, 5)]),
        ([(2, 4), (0, 1), (3, 5)], [(0, 1), (2, 5)]),
        ([(2, 4), (0, 1), (3, 5), (6, 7), (2, 8)], [(0, 1), (2, 8)]),
        ([(2, 4), (0, 1), (2, 5)], [(0, 1), (2, 5)]),
        ([(2, 4), (0, 1), (2, 5), (4, 6)], [(0, 1), (2, 6)]),
        ([(0, 9), (3, 5)], [(0, 9)]),
    ],
)
def test_segment_merge(spark, segments, merged):
    s = spark.createDataFrame([(1, *x) for x in segments], "k int, start int, end int")
    assert sorted((r.start, r.end) for r in tr.merge_segments(s, ["k"]).collect()) == merged


def track(spark, rows):
    return spark.createDataFrame([(0, t, f, 10 * t + f, float(a)) for t, f, a in rows], "dataset int, track_id long, timeframe int, sc_id long, area double")


def test_summary_gaps_and_live(spark, rows):
    c = track(spark, [(1, 0, 1), (1, 1, 1), (1, 4, 1), (2, 2, 1), (2, 3, 1)])
    s = {r.track_id: r for r in tr.track_summary(c).collect()}
    assert (s[1].length, s[1].span, s[1].missing, s[1].vacancy) == (3, 5, 2, 0.4)
    assert rows(tr.gaps(c)) == [(0, 1, 2), (0, 1, 3)]
    assert rows(tr.live_tracks(c)) == [(0, 0, 1), (0, 1, 1), (0, 2, 2), (0, 3, 2)]
    assert tr.track_summary(c.limit(0)).count() == 0 and tr.live_tracks(c.limit(0)).count() == 0


def test_renumbering_counts_lost_tracks(spark, rows):
    c = track(spark, [(5, 0, 1), (7, 9, 1), (9, 1, 1)])
    assert rows(fl.tracks_in_time_span(c, 0, 5, keep_track_id=False).select("track_id", "timeframe")) == [(0, 0), (2, 1)]


def test_sliding_windows_leave_the_last_out(spark):
    c = track(spark, [(1, f, f) for f in range(6)])
    got = sorted((r.window, r.mean, r.mad) for r in tr.sliding_stats(c, "area", 3).collect())
    assert got == [(1, 1.0, 1.0), (2, 2.0, 1.0), (3, 3.0, 1.0)]
    assert sorted((r.clip, r.start_time, r.end_time) for r in tr.sliding_clips(c, 4, 2).collect()) == [(0, 0, 3), (1, 2, 5)]


def test_event_flags(spark):
    c = track(spark, [(1, f, 1) for f in range(6)]).withColumn("flag", F.when(F.col("timeframe") == 2, 1).when(F.col("timeframe") == 5, 2))
    later = {r.timeframe: r.near_flag for r in tr.event_flag_near(c, "flag", 3).collect()}
    before = {r.timeframe: r.near_flag for r in tr.event_flag_near(c, "flag", 3, later=False).collect()}
    assert later == {0: 1, 1: 1, 2: 1, 3: 0, 4: 0, 5: 0}  # the last frame is not looked at
    assert before == {0: 0, 1: 0, 2: 1, 3: 1, 4: 1, 5: 2}


def test_apoptosis_by_length(spark):
    c = track(spark, [(1, f, 1) for f in range(1, 4)] + [(2, f, 1) for f in range(1, 6)] + [(3, f, 1) for f in range(1, 13)] + [(4, f, f) for f in range(1, 13)])
    c = c.withColumn("flag", F.when(F.col("timeframe").isin(3, 12), 1))
    got = {r.track_id: r.apoptosis for r in tr.apoptosis_tracklets(c).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False}


def test_abnormal_jumps(spark):
    values = [5, 6, 5, 6, 40, 41, 40, 0, 41, 5, 6, 5]
    c = track(spark, [(1, f, v) for f, v in enumerate(values)])
    assert [r.timeframe for r in tr.abnormal_jumps(c, "area", 3.0).orderBy("timeframe").collect()] == [4, 8]


def test_edits(spark, rows):
    c = track(spark, [(1, 0, 1), (1, 1, 1), (2, 3, 1), (3, 0, 1)])
    pick = lambda d: rows(d.select("track_id", "timeframe"))
    edits = spark.createDataFrame([(0, 1, 2)], "dataset int, a long, b long")
    assert pick(tr.connect_tracks(c, edits, components)) == [(1, 0), (1, 1), (1, 3), (3, 0)]
    with pytest.raises(ValueError):
        tr.connect_tracks(c, spark.createDataFrame([(0, 1, 3)], "dataset int, a long, b long"), components)
    at = spark.createDataFrame([(0, 3, 0)], "dataset int, track_id long, at int")
    assert pick(tr.split_tracks(c, at)) == [(1, 0), (1, 1), (2, 3), (4, 0)]  # the id 3 is free again, but 3 = max + 1 names the empty part
    cut = spark.createDataFrame([(0, 1, 1)], "dataset int, track_id long, timeframe int")
    assert pick(tr.break_links(c, cut)) == [(1, 0), (2, 3), (3, 0), (4, 1)]
    lineage = spark.createDataFrame([(1, 2)], "mother_id long, daughter_id long")
    with pytest.raises(Exception, match="own mother"):
        tr.add_lineage(lineage, spark.createDataFrame([(4, 4)], "mother_id long, daughter_id long")).collect()
    one = tr.single_cell_tracks(c)
    assert sorted(r.track_id for r in one.collect()) == [0, 1, 2, 3]


def test_label_names(spark):
    d = spark.createDataFrame([("od",), ("d",), (None,)], "l string")
    assert [r[0] for r in d.select(fl.standard_label(F.col("l"))).collect()] == ["overseg_dropout", "discard", "unknown"]
    with pytest.raises(Exception, match="unknown label"):
        spark.createDataFrame([("zz",)], "l string").select(fl.standard_label(F.col("l"))).collect()
    assert spark.createDataFrame([("a-dropout-overseg",)], "l string").select(fl.class_from_subdir(F.col("l"))).first()[0] == "dropout"


def test_frame_lookup(spark):
    f = spark.createDataFrame([(0, "/a/1.tif"), (1, "/a/11.tif")], "timeframe int, url string")
    assert fl.frame_by_url(f, "/a/1.tif", exact=True).first().timeframe == 0
    with pytest.raises(ValueError):
        fl.frame_by_url(f, "/a/1")
    with pytest.raises(ValueError):
        fl.frame_by_url(f, "nope")
    assert fl.frame_by_url(f, "nope", ignore_missing=True).count() == 0


def test_components_on_a_long_path(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in components(e).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}

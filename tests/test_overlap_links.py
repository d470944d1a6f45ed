"""Overlap, links, lineage and tracking against brute force and hand-made cases."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.functions.assignment import assign, assign_allowed
from trackspark.functions.kalman import BoxTracker
from trackspark.operators import events as ev
from trackspark.operators import lineage as li
from trackspark.operators import linking as lk
from trackspark.operators import tracking as tk
from trackspark.operators import overlap as ov

CELLS = "dataset int, track_id long, timeframe int, sc_id long, x1 long, y1 long, x2 long, y2 long, area double"


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n, m = (int(x) for x in rng.integers(1, 6, 2))
        c = rng.integers(0, 9, (n, m)).astype(float)
        r, k = assign(c)
        t = c if n <= m else c.T
        best = min(sum(t[i, p[i]] for i in range(len(t))) for p in itertools.permutations(range(t.shape[1]), len(t)))
        assert len(set(r)) == len(set(k)) == min(n, m) and c[r, k].sum() == best
        allowed = rng.random((n, m)) < 0.5
        r, k = assign_allowed(c, allowed)
        assert allowed[r, k].all()


def test_box_pairs_against_brute_force(spark, rows):
    rng = np.random.default_rng(1)
    b = [(0, k, k % 3, k, int(x), int(y), int(x + w), int(y + h), 1.0) for k, (x, y, w, h) in enumerate(zip(rng.integers(0, 300, 80), rng.integers(0, 300, 80), rng.integers(1, 150, 80), rng.integers(1, 150, 80)))]
    c = spark.createDataFrame(b, CELLS)
    want = []
    for p in b:
        for q in b:
            if q[2] == p[2] + 1 and max(p[4], q[4]) <= min(p[6], q[6]) and max(p[5], q[5]) <= min(p[7], q[7]):
                want.append((0, p[2], p[3], q[3]))
    assert rows(ov.frame_pairs(c).select("dataset", "timeframe", "sc_a", "sc_b")) == sorted(want, key=str)
    assert ov.frame_pairs(c.limit(0)).count() == 0


def test_extend_zero_map(spark, rows):
    """Squares at 0..2 in frames 1 and 4, 100..200 in 2 and 3: the cell of frame 1 goes on up to frame 3."""
    near, far = (0, 0, 2, 2), (100, 100, 200, 200)
    c = spark.createDataFrame([(0, 1, t, t, *b, 1.0) for t, b in ((1, near), (2, far), (3, far), (4, near))], CELLS)
    assert rows(ov.extend_zero_maps(c.where("sc_id = 1"), c, 0.5).select("timeframe")) == [(1,), (2,), (3,)]


def test_maps_and_ties(spark):
    p = spark.createDataFrame([(0, 1, 5), (0, 1, 5), (0, 2, 5), (0, 2, 5), (0, 3, 6), (0, 0, 7)], "image int, label_a int, label_b int")
    o = ov.label_overlap(p, ["image"])
    best = {r.label_b: r.label_a for r in ov.best_match(o, ["image"]).collect()}
    assert best == {5: 1, 6: 3}  # the tie goes to the lowest label, the background to none
    assert [(r.label_b, r.members) for r in ov.fusions(o, ["image"]).collect()] == [(5, [1, 2])]


def test_greedy_pairs_equal_the_loop(spark):
    rng = np.random.default_rng(4)
    pairs = [(0, int(a), int(b), float(s)) for (a, b), s in zip(itertools.combinations(range(14), 2), rng.integers(0, 12, 91) / 10)]
    got = lk.greedy_pairs(spark.createDataFrame(pairs, "k int, a long, b long, score double"), ["k"], "score")
    used, want = set(), set()
    for _, a, b, _ in sorted(pairs, key=lambda p: (-p[3], p[1], p[2])):
        if not {a, b} & used:
            used |= {a, b}
            want.add((a, b))
    assert {(r.a, r.b) for r in got.collect()} == want


def test_optimal_links_against_permutations(spark):
    rng = np.random.default_rng(6)
    for trial in range(3):
        pairs = [(trial, a, 10 + b, float(rng.integers(0, 20))) for a in range(5) for b in range(5) if rng.random() < 0.6]
        got = lk.optimal_links(spark.createDataFrame(pairs, "f int, a long, b long, cost double"), ["f"]).collect()
        cost = {(a, b): c for _, a, b, c in pairs}
        best = (0, 0.0)
        for p in itertools.permutations(range(10, 15)):
            used = [(a, b) for a, b in enumerate(p) if (a, b) in cost]
            best = min(best, (-len(used), sum(cost[x] for x in used)))
        assert (-len(got), sum(r.cost for r in got)) == best and len({r.a for r in got}) == len({r.b for r in got}) == len(got)


def test_gap_and_division(spark, rows):
    c = [(0, 1, 0, 1, 0, 0, 10, 10, 8.0), (0, 2, 2, 2, 30, 40, 40, 50, 4.0), (0, 3, 1, 3, 0, 0, 10, 10, 5.0), (0, 4, 1, 4, 20, 0, 30, 10, 5.0)]
    d = spark.createDataFrame(c, CELLS)
    got = {(r.a, r.b): r.score for r in lk.gap_pairs(d, 2).collect()}
    assert got[1, 2] == pytest.approx(100.0) and set(got) == {(1, 2), (1, 3), (1, 4), (3, 2), (4, 2)}
    t = lk.division_triples(d).collect()
    assert [(r.parent, r.a, r.b, r.distance, r.similarity) for r in t] == [(1, 3, 4, 20.0, 1.0)]


def test_point_in_cell_as_of(spark):
    square = lambda t, i, a, b: (0, i, t, i, a, a, b, b, 1.0, [[float(a), float(a)], [float(a), float(b)], [float(b), float(b)], [float(b), float(a)]])
    c = spark.createDataFrame([square(0, 1, 0, 10), square(3, 2, 5, 90), square(9, 3, 0, 99)], CELLS + ", contour array<array<double>>")
    s = spark.createDataFrame([(0, 1, 5, 7.0, 8.0), (0, 2, 5, 2.0, 2.0), (0, 3, 5, 95.0, 95.0)], "dataset int, sig_id long, timeframe int, x double, y double")
    assert {r.sig_id: r.sc_id for r in lk.signals_to_cells(s, c).collect()} == {1: 2, 2: 1}


def moving(n_tracks=4, n_frames=12):
    rows = []
    for k in range(n_tracks):
        for t in range(n_frames):
            if (k, t) != (1, 5):
                rows.append((0, k, t, 100 * k + t, 40 * k + 2 * t, 3 * t, 40 * k + 2 * t + 20, 3 * t + 20, 400.0))
    return rows


def test_box_tracking_keeps_identity(spark):
    c = spark.createDataFrame(moving(), CELLS)
    got = tk.track_boxes(c, max_age=3, min_hits=1).join(c.select("sc_id", F.col("track_id").alias("true")), "sc_id").collect()
    assert len({(r.true, r.track_id) for r in got}) == 4 and len(got) >= len(moving()) - 1
    few = tk.track_boxes(c, max_age=3, min_hits=1).repartition(3).count()
    assert few == len(got)


def test_tracker_follows_the_rules():
    t = BoxTracker(max_age=1, min_hits=2)
    box = np.array([[0.0, 0, 10, 10]])
    assert t.step(box).tolist() == [1]  # the first frames show all
    assert t.step(np.zeros((0, 4))).tolist() == []
    assert t.step(box).tolist() == [0]  # its streak is broken, 1 of 2
    assert t.step(box).tolist() == [1]
    again = BoxTracker(max_age=1, min_hits=2).restore(t.state())
    assert again.step(box).tolist() == t.step(box).tolist() == [1]
    assert t.step(np.array([[500.0, 500, 510, 510]])).tolist() == [0]
    t.step(np.zeros((0, 4)))
    assert 1 not in t.ids


def test_lineage(spark, rows):
    e = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (1, 4), (4, -1)], "mother_id long, daughter_id long")
    root = spark.createDataFrame([(0,)], "track_id long")
    assert rows(li.descendants(e, root)) == [(0, 1, 1), (0, 2, 1), (0, 3, 2), (0, 4, 2)]
    loop = spark.createDataFrame([(0, 1), (1, 0)], "mother_id long, daughter_id long")
    assert rows(li.descendants(loop, root)) == [(0, 1, 1)]
    paths = li.lineage_paths(spark, e.where("daughter_id > 0"), 0)
    assert sorted(r.path for r in paths.collect()) == [[0, 1, 3], [0, 1, 4], [0, 2]]


def test_deep_lineage(spark):
    """A chain of 75 generations is followed to its end, a cycle ends, and a limit that is too low is an error."""
    e = spark.createDataFrame([(k, k + 1) for k in range(75)] + [(200, 201), (201, 200)], "mother_id long, daughter_id long")
    start = spark.createDataFrame([(0,), (200,)], "track_id long")
    got = sorted(tuple(r) for r in li.descendants(e, start).collect())
    assert got == [(0, k, k) for k in range(1, 76)] + [(200, 201, 1)]
    with pytest.raises(ValueError, match="deeper than 5"):
        li.descendants(e, start, max_depth=5)
    assert li.descendants(e.limit(0), start).count() == 0


def test_near_gap_pairs_are_the_near_ones_of_all(spark):
    rng = np.random.default_rng(7)
    rows = [("d", k, int(t0 + t), 10 * k + t, x, y, x + 5, y + 5, 3.0) for k in range(60) for t0, x, y in [(rng.integers(0, 20), float(rng.integers(0, 90)), float(rng.integers(0, 90)))] for t in range(3)]
    c = spark.createDataFrame(rows, "dataset string, track_id long, timeframe int, sc_id long, x1 double, y1 double, x2 double, y2 double, area double")
    every = {(r.a, r.b): r.score for r in lk.gap_pairs(c, 3).collect()}
    near = {(r.a, r.b): r.score for r in lk.gap_pairs(c, 3, max_distance=20.0).collect()}
    assert near == {k: v for k, v in every.items() if v <= 20} and 0 < len(near) < len(every)


@pytest.mark.parametrize("frames", [2, 500])
def test_signals_reach_back_by_blocks(spark, frames):
    square = lambda x, y: [[x, y], [x, y + 9.0], [x + 9.0, y + 9.0], [x + 9.0, y]]
    cells = [("d", t, 100 * t + k, x, 0.0, x + 9.0, 9.0, square(x, 0.0)) for k, (x, ts) in enumerate([(0.0, (1, 4, 70)), (20.0, (2,)), (40.0, (80,))]) for t in ts]
    c = spark.createDataFrame(cells, "dataset string, timeframe int, sc_id long, x1 double, y1 double, x2 double, y2 double, contour array<array<double>>")
    s = spark.createDataFrame([("d", 1, 60, 4.5, 4.5), ("d", 2, 90, 4.5, 4.5), ("d", 3, 90, 24.5, 4.5), ("d", 4, 79, 44.5, 4.5), ("d", 5, 80, 44.5, 4.5), ("d", 6, 0, 4.5, 4.5)], "dataset string, sig_id long, timeframe int, x double, y double")
    got = sorted((r.sig_id, r.timeframe, r.sc_id) for r in lk.signals_to_cells(s, c, frames=frames).collect())
    assert got == [(1, 4, 400), (2, 70, 7000), (3, 2, 201), (5, 80, 8002)]
    assert lk.signals_to_cells(s, c.limit(0)).count() == 0


def test_division_split(spark):
    c = [(0, t, 10 * t, float(t), float(t)) for t in (0, 1, 2)] + [(0, 3, 30, 3.0, 3.0), (0, 3, 31, 3.0, 3.0), (1, 0, 5, 0.0, 0.0)]
    got = ev.split_divisions(spark.createDataFrame(c, "clip long, timeframe int, sc_id long, x double, y double")).collect()
    series = {}
    for r in sorted(got, key=lambda r: r.timeframe):
        series.setdefault((r.clip, r.series), []).append(r.sc_id)
    assert series == {(0, 0): [0, 10, 20, 30], (0, 1): [0, 10, 20, 31], (1, 0): [5]}
    assert {r.clip: r.break_idx for r in got} == {0: 3, 1: None}


def test_expand_clips(spark):
    c = spark.createDataFrame([(0, t, s) for t, s in ((0, 1), (1, 2), (1, 3), (2, 4), (2, 5), (2, 6))], "clip long, timeframe int, sc_id long")
    v = {}
    for r in ev.expand_clips(c).orderBy("timeframe").collect():
        v.setdefault(r.variant, []).append(r.sc_id)
    assert sorted(map(tuple, v.values())) == [(1, a, b) for a in (2, 3) for b in (4, 5, 6)]
    with pytest.raises(Exception, match="more than 5 choices"):
        ev.expand_clips(c, most=5).collect()


def test_sampled_clips(spark):
    c = spark.createDataFrame([(0, k, t, 1000 * k + t) for k in range(20) for t in range(40)], "dataset int, track_id long, timeframe int, sc_id long")
    bad = c.where("track_id = 3")
    got = ev.sample_clips(c, 30, (6, 10), 1, bad).collect()
    assert len(got) == 30 and all(6 <= r.n_cells < 10 and r.track_id != 3 for r in got)
    for k in {r.track_id for r in got}:
        spans = sorted((r.start_time, r.end_time) for r in got if r.track_id == k)
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    again = ev.sample_clips(c.repartition(7), 30, (6, 10), 1, bad).collect()
    assert sorted(got) == sorted(again)


MEMBER = "label: bigint, single: double, fragment: double, multi: double, track_length: bigint, flag: bigint, area: double"


def event(spark, hub, members):
    return spark.createDataFrame([(1, hub, members)], f"event_id int, hub struct<{MEMBER}>, members array<struct<{MEMBER}>>")


S, FR = (0.9, 0.1, 0.0), (0.1, 0.9, 0.0)


@pytest.mark.parametrize(
    "hub_p, hub_n, members, kind, discard, division",
    [
        ((0.9, 0, 0.1), 2, [(S, 2, 0), (FR, 2, 0)], "fusion", [2], None),  # one single member: fragments go
        ((0.9, 0, 0.1), 9, [(S, 2, 0), (S, 2, 0)], "fusion", [1, 2], None),  # sure hub, no sure member
        ((0.9, 0, 0.1), 9, [(S, 9, 0), (S, 2, 0)], "fusion", [2], None),
        ((0.9, 0, 0.1), 7, [(S, 9, 0), (S, 8, 0)], "fusion", [0], None),  # a shorter hub goes
        ((0.9, 0, 0.1), 9, [(S, 8, 0), (S, 7, 0)], "fusion", [1, 2], None),
        ((0.9, 0, 0.1), 2, [(S, 2, 0), (S, 2, 0)], "fusion", [0, 1, 2], None),
        ((0.9, 0, 0.1), 2, [(S, 9, 0), (S, 2, 0)], "fusion", [0, 2], None),
        ((0.1, 0, 0.9), 2, [(S, 2, 0), (S, 2, 0), (FR, 2, 0)], "fusion", [0, 3], None),
        ((0.1, 0, 0.9), 2, [(S, 9, 0), (FR, 2, 0)], "fusion", [0, 2], None),
        ((0.1, 0, 0.9), 2, [(S, 2, 0), (FR, 2, 0)], "fusion", [0, 1, 2], None),
        ((0.9, 0, 0.1), 2, [(S, 2, 1), (S, 2, 1)], "fusion", [0], [0, 1, 2]),  # flags sum above 1, sizes alike
        ((0.9, 0, 0.1), 9, [(S, 9, 0), (S, 9, 0)], "split", [], [0, 1, 2]),
        ((0.9, 0, 0.1), 2, [(S, 2, 0), (S, 2, 0)], "split", [0, 1, 2], None),
    ],
)
def test_merge_typing(spark, hub_p, hub_n, members, kind, discard, division):
    hub = (0, *map(float, hub_p), hub_n, 0, 100.0)
    rows = [(k + 1, *p, n, flag, 100.0) for k, (p, n, flag) in enumerate(members)]
    r = ev.typed_events(event(spark, hub, rows), kind).first()
    if kind == "fusion" and division:
        assert r.division == division
    else:
        assert (r.discard, r.division) == (discard, division)

"""Boxes that move, cross and compete, against a plain loop over whole movies; parts that meet."""

import itertools
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.functions.kalman import best_overlaps, iou_matrix
from trackspark.operators import tracking as tk
from trackspark.plans.registry import QUERIES
from trackspark.streaming import live
from tests.test_entry import DATA, needs_data

SCHEMA = "dataset int, timeframe int, sc_id long, x1 double, y1 double, x2 double, y2 double"


class OneTrack:
    """Constant velocity of centre and area: predict and correct by the textbook, one object a track."""

    def __init__(self, box):
        self.x = np.zeros((7, 1))
        self.x[:4, 0] = self.seen(box)
        self.p = np.diag([10.0] * 4 + [10000.0] * 3)
        self.misses = self.streak = 0

    @staticmethod
    def seen(b):
        w, h = b[2] - b[0], b[3] - b[1]
        return [b[0] + w / 2, b[1] + h / 2, w * h, w / h]

    def predict(self):
        if self.x[6, 0] + self.x[2, 0] <= 0:
            self.x[6, 0] = 0
        f = np.eye(7)
        f[0, 4] = f[1, 5] = f[2, 6] = 1
        self.x = f @ self.x
        self.p = f @ self.p @ f.T + np.diag([1, 1, 1, 1, 0.01, 0.01, 0.0001])
        if self.misses:
            self.streak = 0
        self.misses += 1
        x, y, s, r = self.x[:4, 0]
        if not s * r >= 0 or s * r == 0:
            return None
        w = np.sqrt(s * r)
        return [x - w / 2, y - s / w / 2, x + w / 2, y + s / w / 2]

    def correct(self, b):
        h = np.eye(4, 7)
        s = h @ self.p @ h.T + np.diag([1.0, 1.0, 10.0, 10.0])
        k = self.p @ h.T @ np.linalg.inv(s)
        self.x = self.x + k @ (np.array(self.seen(b)).reshape(4, 1) - h @ self.x)
        self.p = (np.eye(7) - k @ h) @ self.p
        self.misses = 0
        self.streak += 1


def most_overlap(m):
    """The largest sum of overlaps of any matching, by trying them all row by row."""
    best = {0: 0.0}
    for row in m:
        new = dict(best)
        for used, total in best.items():
            for j in np.flatnonzero(row > 0):
                if not used >> int(j) & 1:
                    k = used | 1 << int(j)
                    new[k] = max(new.get(k, 0.0), total + row[j])
        best = new
    return max(best.values())


def plain_tracks(rows, max_age, min_hits, iou=0.3):
    """rows (timeframe, sc_id, box) of one movie. {sc_id: track}, and counts of what happened."""
    seen = {"contested": 0, "ties": 0, "overlaps": 0}
    frames = {}
    for t, i, b in sorted(rows):
        frames.setdefault(t, []).append((i, b))
    alive, out, last = [], {}, 0
    for n, t in enumerate(range(min(frames), max(frames) + 1), 1):
        found = frames.get(t, [])
        kept = [(k, b) for k, b in ((k, k[1].predict()) for k in alive) if b is not None]
        alive = [k for k, _ in kept]
        pairs = []
        if found and alive:
            m = iou_matrix(np.array([b for _, b in found], float), np.array([b for _, b in kept]))
            over = m > iou
            if over.sum(0).max() == 1 and over.sum(1).max() == 1:
                pairs = [tuple(x) for x in np.argwhere(over)]
            else:
                d, j = best_overlaps(m)
                assert m[d, j].sum() == pytest.approx(most_overlap(m))
                pairs = [(a, b) for a, b in zip(d, j) if m[a, b] >= iou]
                seen["contested"] += over.sum() > 0
            for row in m:
                near = sorted(row[row > 0])
                seen["ties"] += any(a == b for a, b in zip(near, near[1:]))
        boxes = np.array([b for _, b in found], float).reshape(-1, 4)
        seen["overlaps"] += int((np.triu(iou_matrix(boxes, boxes), 1) > 0).sum())
        for a, j in pairs:
            alive[j][1].correct(found[a][1])
            if alive[j][1].streak >= min_hits or n <= min_hits:
                out[found[a][0]] = alive[j][0]
        for a in sorted(set(range(len(found))) - {a for a, _ in pairs}):
            last += 1
            alive.append((last, OneTrack(found[a][1])))
            if min_hits <= 0 or n <= min_hits:
                out[found[a][0]] = last
        alive = [k for k in alive if k[1].misses <= max_age]
    return out, seen


def by_loop(cells, max_age, min_hits):
    movies, want, seen = {}, set(), {}
    for r in cells.collect():
        movies.setdefault(r.dataset, []).append((r.timeframe, r.sc_id, [float(r.x1), float(r.y1), float(r.x2), float(r.y2)]))
    for k, rows in movies.items():
        out, s = plain_tracks(rows, max_age, min_hits)
        want |= {(k, i, track) for i, track in out.items()}
        seen = {n: seen.get(n, 0) + c for n, c in s.items()}
    return want, seen


def tracked(cells, max_age, min_hits, **options):
    return {(r.dataset, r.sc_id, r.track_id) for r in tk.track_boxes(cells, max_age, min_hits, **options).collect()}


@needs_data
def test_query_of_moving_boxes(spark):
    from trackspark.plans.overlap_queries import moving

    c = moving(spark, DATA)
    want, seen = by_loop(c, 3, 1)
    assert {(r.dataset, r.sc_id, r.track_id) for r in QUERIES["g11_moving_boxes"](spark, DATA).collect()} == want
    if os.path.basename(DATA) != "sf0.001":
        assert seen["contested"] > 0 and seen["overlaps"] > 0


@needs_data
def test_live_query_of_moving_boxes(spark):
    got = {(int(r.dataset), r.sc_id, r.track_id) for r in QUERIES["t1_moving_boxes"](spark, DATA).collect()}
    assert got == {(r.dataset, r.sc_id, r.track_id) for r in QUERIES["g11_moving_boxes"](spark, DATA).collect()}


def test_a_silent_movie_ends_and_leaves_no_state(spark, tmp_path):
    """Two movies; one falls silent. The other's rows move the watermark on, and the timeout does the rest."""
    row = lambda m, t, k, x=0.0: (m, t, 1000 * t + k, 1_700_000_000 + 60 * t, x, x, x + 20, x + 20)
    schema = "dataset string, timeframe int, sc_id long, s long, x1 double, y1 double, x2 double, y2 double"
    write = lambda rows: spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s")).drop("s").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    # silent: one track to frame 7, one to frame 6
    write([row("silent", t, 1) for t in range(8)] + [row("silent", t, 2, 100.0) for t in range(7)] + [row("loud", t, 3, 300.0) for t in range(8)])
    source = lambda: spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    run = lambda: live.run_once(live.live_tracks(source(), "1 minute", max_age=4, min_hits=1, silence="10 minutes"), "quiet", str(tmp_path / "ck"))
    states = lambda q: sum(op["numRowsTotal"] for op in q.recentProgress[-1]["stateOperators"])
    ends = lambda: sorted((r.dataset, r.timeframe, r.track_id, r.n) for r in spark.read.parquet(str(tmp_path / "ck_rows")).where("kind = 'end'").collect())
    assert states(run()) == 2 and ends() == []
    write([row("loud", t, 3, 300.0) for t in range(8, 13)])
    assert states(run()) == 2 and ends() == []  # frame 7 is less than ten minutes past
    write([row("loud", t, 3, 300.0) for t in range(13, 22)])
    assert states(run()) == 1
    assert ends() == [("silent", 11, 2, 7), ("silent", 12, 1, 8)]
    # a detection that is not late begins the movie anew
    write([row("silent", 22, 9)] + [row("loud", t, 3, 300.0) for t in range(22, 26)])
    assert states(run()) == 2
    again = spark.read.parquet(str(tmp_path / "ck_rows")).where("kind = 'cell' AND sc_id = 22009").collect()
    assert [r.track_id for r in again] == [1]
    write([row("new", 90, 1)])
    assert states(run()) == 1 and len(ends()) == 4


def crowd(seed, n_tracks, n_frames, field, step):
    """Boxes of three sizes that walk about on whole numbers and turn up in nine frames of ten."""
    rng = np.random.default_rng(seed)
    at, by = rng.integers(0, field, (n_tracks, 2)), rng.integers(-step, step + 1, (n_tracks, 2))
    at[3], by[3] = at[0], by[0]  # two that are always alike
    rows = []
    for t in range(n_frames):
        for k in range(n_tracks):
            if rng.random() < 0.9:
                x, y = (int(v) for v in at[k] + t * by[k])
                s = 10 + 2 * (k % 3)
                rows.append((seed, t, t * 1000 + (k * 7919) % 997, float(x), float(y), float(x + s), float(y + s)))
    return rows


@pytest.mark.parametrize("max_age, min_hits", [(1, 3), (4, 1)])
def test_crowds(spark, max_age, min_hits):
    """A dense crowd, a sparse one of many parts, and one in two halves."""
    rows = crowd(1, 14, 30, 60, 3) + crowd(2, 30, 25, 900, 4) + [(r[0], r[1], r[2], r[3] + 500 * (r[2] % 2), *r[4:5], r[5] + 500 * (r[2] % 2), r[6]) for r in crowd(3, 16, 20, 80, 3)]
    c = spark.createDataFrame(rows, SCHEMA)
    want, seen = by_loop(c, max_age, min_hits)
    assert min(seen.values()) > 0
    assert tracked(c, max_age, min_hits) == want
    assert tracked(c, max_age, min_hits, rows_per_task=40) == want  # parts of a movie in many tasks
    parts = tk.movie_parts(c, ["dataset"], max_age).groupBy("dataset").agg({"__part": "count"})
    assert tk.movie_parts(c, ["dataset"], max_age).select("dataset", "__part").distinct().count() > 10 and parts.count() == 3


def test_parts_that_meet_are_tracked_together(spark):
    """A fast box vanishes; its prediction, far from where it was seen, is where another part's box appears."""
    box = lambda t, i, x, y=0.0, s=10.0: (0, t, i, x, y, x + s, y + s)
    # each step leaves an overlap of a half, so velocity is learnt; then 20 frames of silence
    rows = [box(t, t, 5.0 * t) for t in range(10)] + [box(25, 100, 125.0), box(26, 101, 130.0)]
    rows += [box(t, 200 + t, 400.0, 400.0) for t in range(26)]
    c = spark.createDataFrame(rows, SCHEMA)
    started = {r["__part"] for r in tk.movie_parts(c, ["dataset"], 20, reach=1.0).collect()}
    assert len(started) >= 2
    want, _ = by_loop(c, 20, 1)
    assert tracked(c, 20, 1) == want
    one = {track for _, i, track in want if i in (5, 100, 101)}
    assert len(one) == 1  # the loop itself joins them


def test_rules_of_one_part_reach_another(spark):
    """In one frame a part's boxes compete, so that the whole frame is assigned; another part's pairs then change."""
    rows = []
    for t in range(3):
        rows += [(0, t, 10 * t + k, x, 0.0, x + 10, 10.0) for k, x in enumerate((0.0, 3.0))]  # two that overlap much
    # alone: one box over the threshold and two just under it, whose sum is larger
    rows += [(0, 0, 500, 1000.0, 0.0, 1010.0, 10.0), (0, 0, 501, 1006.0, 4.0, 1016.0, 14.0), (0, 1, 510, 1004.0, 2.0, 1014.0, 12.0), (0, 1, 511, 994.0, 0.0, 1004.0, 10.0)]
    c = spark.createDataFrame(rows, SCHEMA)
    for max_age in (1, 3):
        want, _ = by_loop(c, max_age, 1)
        assert tracked(c, max_age, 1) == tracked(c, max_age, 1, rows_per_task=1) == want


def test_sweep_and_odd_movies(spark):
    rows = crowd(5, 6, 12, 60, 2)
    c = spark.createDataFrame(rows, SCHEMA)
    sweep = {r.max_age: r for r in tk.tracking_sweep(c, (1, 3), 1).collect()}
    for age in (1, 3):
        want, _ = by_loop(c, age, 1)
        assert sweep[age].n_cells == len(want) and sweep[age].n_tracks == len({t for *_, t in want})
    assert tracked(c.limit(0), 1, 1) == set()
    assert tracked(c.limit(1), 1, 1) == {(5, c.limit(1).first().sc_id, 1)}
    points = spark.createDataFrame([(0, t, t, 5.0, 5.0, 5.0, 5.0) for t in range(3)], SCHEMA)  # boxes without area match nothing
    assert {track for *_, track in tracked(points, 1, 5)} == {1, 2, 3}
    assert list(itertools.islice(sorted(tracked(c, 3, 1)), 3)) == sorted(tracked(c.repartition(5), 3, 1))[:3]


def test_tracker_columns_against_full_matrices():
    """A tracker's twenty numbers are the filter of whole matrices; a step names the tracks that it ends."""
    from trackspark.functions.kalman import BoxTracker, measured

    motion, noise = np.eye(7) + np.diag([1.0] * 3, 4), np.diag([1, 1, 1, 1, 0.01, 0.01, 0.0001])
    x, p, t = None, np.diag([10.0] * 4 + [1e4] * 3), BoxTracker(max_age=2, min_hits=0)
    for k in range(6):
        box = np.array([[3.0 * k, 2.0 * k, 3.0 * k + 30 + k, 2.0 * k + 20]])
        assert t.step(box).tolist() == [1] and not len(t.ended)
        z = measured(box)[0]
        if x is None:
            x = np.append(z, np.zeros(3))
        else:
            x, p = motion @ x, motion @ p @ motion.T + noise
            gain = p[:, :4] @ np.linalg.inv(p[:4, :4] + np.diag([1.0, 1, 10, 10]))
            x, p = x + gain @ (z - x[:4]), p - gain @ p[:4]
        assert t.m.shape == (20, 1) and np.allclose(t.x[0], x) and np.allclose(t.p[0], p)
    assert [(t.step(np.zeros((0, 4))).tolist(), t.ended.tolist()) for _ in range(4)] == [([], []), ([], []), ([], [1]), ([], [])]

"""Box tracking (G11, G12): movies fall into parts that don't meet, and parts are tasks.

Trackers act on each other only where a predicted box and a detection overlap. A movie is first cut by a grid over
space and time: detections in neighbouring cells of it are one part. Parts are tracked apart, and then it is checked
whether a prediction of one part met a detection of another, or whether a frame's rule of matching depends on another
part. Parts that did are joined and tracked again, until none did: then the result is that of the whole movie.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackspark.functions.graph import Rounds, components
from trackspark.functions.kalman import BoxTracker
from trackspark.functions.ranks import ranked
from trackspark.schema import extended

from .tracks import TRACK

BOX = ("x1", "y1", "x2", "y2")


def movie_parts(cells: DataFrame, keys: list[str], max_age: int, reach: float = 2.0) -> DataFrame:
    """cells (keys, timeframe, sc_id, box) with __part (a number within the keys), __first and __last, the movie's
    first and last frame. Grid cells are ``reach`` times the movie's largest box side wide and max_age + 1 frames
    long; occupied ones that touch, also by a corner, are one part."""
    side = F.max(F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.lit(1.0)))
    movie = cells.groupBy(*keys).agg(F.min("timeframe").alias("__first"), F.max("timeframe").alias("__last"), (side * reach).alias("__g"))
    cell = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2 / F.col("__g"))
    c = cells.join(movie, keys).withColumn("__r", cell("x1", "x2")).withColumn("__c", cell("y1", "y2")).withColumn("__t", F.floor((F.col("timeframe") - F.col("__first")) / (max_age + 1)))
    node = lambda *at: F.xxhash64(*keys, *at)
    used = c.select(*keys, "__r", "__c", "__t").distinct()
    moves = [(a, b, t) for t in (0, 1) for a in (-1, 0, 1) for b in (-1, 0, 1) if t or (a, b) > (0, 0)]
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(t).alias("t")) for a, b, t in moves]))
    near = used.withColumn("m", step).select(*keys, node("__r", "__c", "__t").alias("a"), (F.col("__r") + F.col("m.a")).alias("__r"), (F.col("__c") + F.col("m.b")).alias("__c"), (F.col("__t") + F.col("m.t")).alias("__t"))
    edges = near.join(used, [*keys, "__r", "__c", "__t"]).select("a", node("__r", "__c", "__t").alias("b"))
    roots = components(edges)
    c = c.withColumn("__node", node("__r", "__c", "__t")).join(roots, F.col("__node") == F.col("node"), "left")
    return c.withColumn("__part", F.coalesce("root", "__node")).drop("__r", "__c", "__t", "__g", "__node", "node", "root")


def _tiles(box: list[str], width: float) -> tuple[Column, Column]:
    at = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width)))
    return at(box[0], box[2]), at(box[1], box[3])


def _met(trace: DataFrame, cells: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Pairs of parts (keys, a, b) of which a prediction of the one overlaps a detection of the other, or the one's
    rule in a frame changes what the other, open one must do there."""
    low_x, low_y, high_x, high_y = cells.agg(F.min("x1"), F.min("y1"), F.max("x2"), F.max("y2")).first()
    p = trace.where("x1 IS NOT NULL").select(
        *keys, "timeframe", F.col("__part").alias("a"),
        F.greatest("x1", F.lit(low_x)).alias("x1"), F.greatest("y1", F.lit(low_y)).alias("y1"), F.least("x2", F.lit(high_x)).alias("x2"), F.least("y2", F.lit(high_y)).alias("y2"),
    ).where("x1 < x2 AND y1 < y2")
    row, column = _tiles(list(BOX), width)
    p = p.withColumn("__tr", row).withColumn("__tc", column)
    d = cells.select(*keys, "timeframe", F.col("__part").alias("b"), *[F.col(k).alias(f"d{k}") for k in BOX])
    row, column = _tiles([f"d{k}" for k in BOX], width)
    d = d.withColumn("__tr", row).withColumn("__tc", column)
    boxes = p.join(d, [*keys, "timeframe", "__tr", "__tc"]).where("a <> b AND x1 < dx2 AND dx1 < x2 AND y1 < dy2 AND dy1 < y2")
    open_frames = trace.where("open").select(*keys, "timeframe", F.col("__part").alias("b"), F.col("rule").alias("own")).distinct()
    rules = trace.where("rule > 0").select(*keys, "timeframe", F.col("__part").alias("a"), "rule").distinct().join(open_frames, [*keys, "timeframe"])
    rules = rules.where("a <> b AND rule = own + 1")
    return boxes.select(*keys, "a", "b").union(rules.select(*keys, "a", "b")).distinct()


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last places of runs of equal values."""
    ends = np.append(np.flatnonzero(values[1:] != values[:-1]) + 1, len(values))
    return np.append(0, ends[:-1]), ends


def track_boxes(cells: DataFrame, max_age: int = 5, min_hits: int = 3, iou: float = 0.3, keys: tuple[str, ...] = ("dataset",), max_rounds: int = 20, rows_per_task: int = 20_000) -> DataFrame:
    """Box tracking of each movie: (keys, timeframe, sc_id, track_id). Tracks are numbered from 1 per movie, by
    the frame in which they begin and in it by the id of their first cell. Frames between the first and last count
    also where they hold no cell. Of equally good assignments the one of lowest ids is taken."""
    spark, keys = cells.sparkSession, list(keys)
    t = Rounds(spark)
    need = cells.select(*keys, "timeframe", "sc_id", *[F.col(c).cast("double").alias(c) for c in BOX])
    sizes = need.groupBy(*keys).agg(F.count("*").alias("__rows"), F.min("timeframe").alias("__first"), F.max("timeframe").alias("__last"))
    # a movie that is one task's work anyway is one part from the start: it needs no grid and meets no other part
    sized = t.write(need.join(sizes, keys), "cells")
    small, need = (sized.where(f"__rows {op} {rows_per_task}") for op in ("<=", ">"))
    small, need = small.drop("__rows").withColumn("__part", F.lit(0).cast("long")), need.drop("__rows", "__first", "__last")
    several = not need.isEmpty()
    parts = t.write(movie_parts(need, keys, max_age), "parts0") if several else small.limit(0)
    width = parts.agg(F.avg(F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))).first()[0]
    width = max(4 * (width or 1.0), 1e-6)
    fixed = need.select(*keys).schema
    out = extended(
        need.select(*keys, "timeframe").schema, __part="long", sc_id="long", began="int", founder="long", shown="boolean",
        x1="double", y1="double", x2="double", y2="double", rule="int", open="boolean",
    )

    def follow(movie: pd.DataFrame, traced: bool = True) -> pd.DataFrame:
        """A number of parts of one movie, side by side; ``traced``: with the boxes that were predicted."""
        movie = movie.sort_values(["timeframe", "sc_id"])
        tracker, first, last = BoxTracker(max_age, min_hits, iou), int(movie["__first"].iloc[0]), int(movie["__last"].iloc[0])
        times, boxes, names, part = (movie[c].to_numpy() for c in ("timeframe", list(BOX), "sc_id", "__part"))
        frames = {int(times[a]): np.arange(a, b) for a, b in zip(*_runs(times))}
        start: dict[int, tuple[int, int]] = {}
        rows = []
        ahead = iter(frames)  # in order of time
        now = upcoming = next(ahead)
        while now <= last:
            if not len(tracker.ids):  # nothing lives: on to the next detection
                if upcoming is None:
                    break
                now = max(now, upcoming)
            tracker.frames = now - first
            at = frames.get(now, np.zeros(0, np.int64))
            known = tracker.last_id
            ids, shown = tracker.step_all(boxes[at], part[at])
            start |= {i: (now, int(names[k])) for i, k in zip(ids.tolist(), at.tolist()) if i > known}
            flags = dict(zip(tracker.parts.tolist(), zip(tracker.rule.tolist(), tracker.open.tolist())))
            rows += [(now, p, int(names[k]), *start[i], s, None, None, None, None, *flags[p]) for k, p, i, s in zip(at.tolist(), part[at].tolist(), ids.tolist(), shown.tolist())]
            if traced:
                rows += [(now, p, None, None, None, None, *b, *flags[p]) for p, b in zip(tracker.predicted_part.tolist(), tracker.predicted.tolist()) if np.isfinite(b).all()]
            if upcoming == now:
                upcoming = next(ahead, None)
            now += 1
        made = pd.DataFrame(rows, columns=[c for c in out.names if c not in fixed.names])
        for k in fixed.names:
            made[k] = movie[k].iloc[0]
        return made[out.names].astype({"sc_id": "Int64", "began": "Int32", "founder": "Int64", "shown": "boolean", **{k: "float64" for k in BOX}})

    def tracked(parts: DataFrame) -> DataFrame:
        """Parts of a movie are dealt to as many tasks as its rows ask for."""
        tasks = parts.groupBy(*keys).agg(F.ceil(F.count("*") / rows_per_task).alias("__n"))
        dealt = parts.join(tasks, keys).withColumn("__n", F.pmod(F.xxhash64("__part"), F.col("__n")))
        return dealt.groupBy(*keys, "__n").applyInPandas(lambda g: follow(g.drop(columns="__n")), out)

    # predictions are for meeting other parts only
    whole = t.write(small.groupBy(*keys).applyInPandas(lambda g: follow(g, traced=False), out), "whole")
    done = t.write(tracked(parts), "done0") if several else whole.limit(0)
    for k in range(1, max_rounds + 1 if several else 1):
        met = t.write(_met(done, parts, keys, width), f"met{k}")
        if met.isEmpty():
            break
        node = lambda c: F.xxhash64(*keys, c)
        roots = components(met.select(node("a").alias("a"), node("b").alias("b"))).withColumnRenamed("root", "__root")
        moved = parts.withColumn("__node", node("__part")).join(roots, F.col("__node") == F.col("node"), "left")
        # a joined part's number is its root's hash; parts that met nothing keep theirs
        now = t.write(moved.withColumn("__part", F.coalesce("__root", "__part")).withColumn("__new", F.col("__root").isNotNull()).drop("__node", "node", "__root"), f"parts{k}")
        old = done.withColumn("__node", node("__part")).join(roots, F.col("__node") == F.col("node"), "left_anti").drop("__node")
        again = tracked(now.where("__new").drop("__new"))
        done, parts = t.write(old.unionByName(again), f"done{k}"), now.drop("__new")
    else:
        if several:
            raise RuntimeError(f"parts still met after {max_rounds} rounds")
    found = done.unionByName(whole).where("sc_id IS NOT NULL") if several else whole
    tracks = ranked(found.select(*keys, "began", "founder").distinct(), keys, ["began", "founder"], "__k")
    shown = found.where("shown").join(tracks, [*keys, "began", "founder"])
    return shown.select(*keys, "timeframe", F.col("sc_id").cast(need.schema["sc_id"].dataType).alias("sc_id"), (F.col("__k") + 1).alias("track_id"))


def tracking_sweep(cells: DataFrame, max_ages: tuple[int, ...], min_hits: int = 3) -> DataFrame:
    """For each max_age the tracks, cells and mean missing rate."""
    each = None
    for age in max_ages:
        t = track_boxes(cells, age, min_hits).withColumn("max_age", F.lit(age))
        each = t if each is None else each.union(t)
    per = each.groupBy("max_age", *TRACK).agg(F.count("*").alias("n"), (F.max("timeframe") - F.min("timeframe") + 1).alias("span"))
    return per.groupBy("max_age").agg(F.count("*").alias("n_tracks"), F.sum("n").alias("n_cells"), F.avg(1 - F.col("n") / F.col("span")).alias("mean_missing_rate"))

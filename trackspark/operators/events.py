"""Clips, division events and typing of merges."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackspark.functions.groups import heads, in_groups, numbers
from trackspark.schema import extended

from .evaluate import hash_key
from .tracks import TRACK


def drop_divided_frames(clips: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """Clips (clip, timeframe, class): frames with two or more cells go, of the given classes only."""
    n = F.count("*").over(Window.partitionBy("clip", "timeframe"))
    one = F.col("__n") == 1
    keep = one if classes is None else one | ~F.col("class").isin(classes)
    return clips.withColumn("__n", n).where(keep).drop("__n")


def one_cell_each_frame(clips: DataFrame) -> DataFrame:
    """Per clip whether each of its frames has one cell."""
    return clips.groupBy("clip").agg((F.count("*") == F.count_distinct("timeframe")).alias("valid"))


def expand_clips(clips: DataFrame, most: int = 1024) -> DataFrame:
    """Every choice of one cell per frame as a clip of its own: (clip, variant, timeframe, sc_id).

    A clip with more than ``most`` choices is an error, so that nothing explodes unseen. Variant k takes,
    frame by frame, the digit of k in the mixed base of the frames' counts, so no product is built."""
    frames = clips.groupBy("clip", "timeframe").agg(F.sort_array(F.collect_list("sc_id")).alias("ids"))
    w = Window.partitionBy("clip").orderBy(F.desc("timeframe"))
    size = F.size("ids")
    log = F.sum(F.log2(size.cast("double"))).over(Window.partitionBy("clip"))
    frames = frames.withColumn("__log", log).withColumn("__log", F.when(F.col("__log") > np.log2(most) + 1e-9, F.raise_error(F.lit(f"a clip has more than {most} choices"))).otherwise(F.col("__log")))
    later = F.sum(F.log2(size.cast("double"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    frames = frames.withColumn("__n", F.round(F.pow(F.lit(2.0), "__log")).cast("long")).withColumn("__w", F.round(F.pow(F.lit(2.0), F.coalesce(later, F.lit(0.0)))).cast("long"))
    each = frames.withColumn("variant", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))
    pick = F.get("ids", (F.expr("variant div __w") % F.size("ids")).cast("int"))
    return each.select("clip", "variant", "timeframe", pick.alias("sc_id"))


def split_divisions(clips: DataFrame) -> DataFrame:
    """Clips (clip, timeframe, sc_id, x, y): one series per daughter. At each frame with several cells a
    cell goes on from the series with the nearest last cell (the first on ties); a frame with one cell
    goes to all series. Returns (clip, series, timeframe, sc_id, break_idx: index of the first frame with
    several cells, null if there is none). A clip is one group; it is a short piece of a track."""
    need = clips.select("clip", "timeframe", "sc_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    types = {f.name: f.dataType.simpleString() for f in need.schema}
    out = extended(need.select("clip").schema, series="int", timeframe=types["timeframe"], sc_id=types["sc_id"], break_idx="int")

    def split(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        times, (x, y) = t.column("timeframe").to_pylist(), (c.tolist() for c in numbers(t, "x", "y"))
        ends = [*starts.tolist(), t.num_rows]
        row, number, broken = [], [], []
        for a, b in zip(ends, ends[1:]):
            frames = [list(g) for _, g in groupby((k for k in range(a, b) if times[k] is not None), times.__getitem__)]
            at = next((k for k, g in enumerate(frames) if len(g) > 1), None)
            series = [[]]
            for g in frames:
                if not series[0]:
                    series = [[k] for k in g]
                elif len(g) == 1:
                    for one in series:
                        one += g
                else:
                    near = lambda k: min(series, key=lambda s: (x[s[-1]] - x[k]) ** 2 + (y[s[-1]] - y[k]) ** 2)  # noqa: B023, E731
                    series = [near(k) + [k] for k in g]
            for n, s in enumerate(series):
                row += s
                number += [n] * len(s)
                broken += [at] * len(s)
        if row:
            clip, frame, cell = heads(t, ["clip", "timeframe", "sc_id"], np.array(row))
            yield pa.RecordBatch.from_arrays([clip, pa.array(number, pa.int32()), frame, cell, pa.array(broken, pa.int32())], out.names)

    return in_groups(need, ["clip"], ["timeframe", "sc_id"], split, out)


def enclosing_box(clips: DataFrame) -> DataFrame:
    """Per clip the box around all its boxes."""
    return clips.groupBy("clip").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


def sample_clips(cells: DataFrame, n: int, lengths: tuple[int, int] = (6, 10), seed: int = 0, excluded: DataFrame | None = None) -> DataFrame:
    """Up to ``n`` clips (dataset, track_id, start_time, end_time) of lo .. hi - 1 rows, disjoint on their
    track, without excluded cells.

    A track is cut into blocks of hi - 1 rows from an offset that its hash gives; each block proposes a
    clip of hashed length and place, so clips are disjoint by construction. Of all proposals the ``n``
    with the least hash stay. The same seed gives the same clips, however the table is partitioned."""
    lo, hi = lengths
    block = hi - 1
    w = Window.partitionBy(*TRACK).orderBy("timeframe")
    k = F.row_number().over(w) - 1
    rows = cells.select(*TRACK, "timeframe", "sc_id", k.alias("k"), F.count("*").over(Window.partitionBy(*TRACK)).alias("n"))
    drawn = lambda *parts: hash_key(F.concat_ws(",", *[F.col(c).cast("string") for c in parts]), seed)
    off = drawn(*TRACK) % block
    rows = rows.withColumn("b", F.floor((F.col("k") + off) / block).cast("long")).withColumn("in", F.pmod(F.col("k") + off, F.lit(block)))
    h = drawn(*TRACK, "b")
    length = (lo + h % (hi - lo)).cast("int")
    start = F.shiftright(h, 12) % (block - length + 1)
    rows = rows.withColumn("h", h).withColumn("length", length).withColumn("s", start).where((F.col("in") >= F.col("s")) & (F.col("in") < F.col("s") + F.col("length")) & (F.col("n") > F.col("length")))
    if excluded is not None:
        rows = rows.join(excluded.select("sc_id").distinct().withColumn("x", F.lit(1)), "sc_id", "left")
    else:
        rows = rows.withColumn("x", F.lit(None).cast("int"))
    c = rows.groupBy(*TRACK, "b", "h", "length").agg(F.count("*").alias("m"), F.count("x").alias("x"), F.min("timeframe").alias("start_time"), F.max("timeframe").alias("end_time"))
    c = c.where("m = length AND x = 0")
    return c.orderBy("h", *TRACK, "b").limit(n).select(*TRACK, "start_time", "end_time", F.col("length").cast("long").alias("n_cells"))


def stay_points(cells: DataFrame, features: list[str], radius: float, least_frames: int, order: int = 1) -> DataFrame:
    """Per track points where its feature path stays. The density of a row is the number of the track's
    rows within ``radius`` (Minkowski distance of that order); rows are taken by falling density, and one is a
    stay point if rows around it in time, without a break, stay within the radius for ``least_frames`` rows
    and no earlier stay point is that near. A track is one group; memory is linear in its rows."""
    need = cells.select(*TRACK, "timeframe", *[F.col(f).cast("double").alias(f) for f in features])
    out = extended(need.select(*TRACK, "timeframe").schema, density="int", duration="int")

    def search(track: pd.DataFrame) -> pd.DataFrame:
        track = track.sort_values("timeframe")
        v = track[features].to_numpy()
        first = np.argsort(v[:, 0], kind="stable")  # rows near in all features are near in the first
        reach = radius + 1e-9 * (radius + np.abs(v[:, 0]))  # a little more, for what rounding leaves out
        lo, hi = np.searchsorted(v[first, 0], v[:, 0] - reach, "left"), np.searchsorted(v[first, 0], v[:, 0] + reach, "right")

        def near(k: int, rows: np.ndarray) -> np.ndarray:
            return (np.abs(v[rows] - v[k]) ** order).sum(1) ** (1 / order) <= radius

        density = np.array([near(k, first[lo[k] : hi[k]]).sum() for k in range(len(v))], np.int64)

        def run(k: int, step: int) -> int:
            """Rows in time from k on, in steps of 64, until one is not near."""
            n = 0
            while True:
                rows = np.arange(k + step * (n + 1), k + step * (n + 65), step)
                rows = rows[(rows >= 0) & (rows < len(v))]
                away = np.flatnonzero(~near(k, rows))
                if len(away) or len(rows) < 64:
                    return n + (int(away[0]) if len(away) else len(rows))
                n += 64

        found, points = [], np.zeros(0, np.int64)
        for k in np.argsort(-density, kind="stable"):
            if len(points) and near(k, points).any():
                continue
            stay = run(k, -1) + 1 + run(k, 1)
            if stay >= least_frames:
                found.append((int(density[k]), stay))
                points = np.append(points, k)
        if not found:
            return track.iloc[:0].assign(density=0, duration=0)[[f.name for f in out.fields]]
        return track.iloc[points].assign(density=[f[0] for f in found], duration=[f[1] for f in found])[[f.name for f in out.fields]]

    return need.groupBy(*TRACK).applyInPandas(search, out)


# -- typing of merges and splits ------------------------------------------------------------------


def typed_events(events: DataFrame, kind: str, long_track: int = 5) -> DataFrame:
    """Events (event_id, hub, members) of merges (kind 'fusion') or 'split's.

    hub and members are structs (label, single, fragment, multi, track_length, flag, area), members an array.
    Adds hub_type, discard (labels to discard) and division (labels of a division candidate, else null).
    The rules are those of the survey's table in its section 2.8.1."""
    hub = F.col("hub")
    sure_hub = hub["track_length"] > long_track
    hub_type = F.when(hub["single"] >= F.when(sure_hub, F.lit(0.0)).otherwise(hub["multi"]), "single").otherwise("multi")

    def view(m: Column) -> Column:
        sure = (m["track_length"] > long_track) | m["flag"].isin(1, 2)
        single = sure | (m["single"] >= m["fragment"])
        return F.struct(m["label"].alias("label"), sure.alias("sure"), single.alias("single"), m["track_length"].alias("n"), m["flag"].alias("flag"), m["area"].alias("area"))

    e = events.withColumn("hub_type", hub_type).withColumn("__sure", sure_hub).withColumn("__m", F.transform("members", view))
    count = lambda f: F.size(F.filter("__m", f))
    s, u = count(lambda x: x["single"]), count(lambda x: x["sure"])
    labels = lambda f: F.transform(F.filter("__m", f), lambda x: x["label"])
    every, fragments, unsure = labels(lambda x: F.lit(True)), labels(lambda x: ~x["single"]), labels(lambda x: ~x["sure"])
    own = F.array(hub["label"])
    none = F.slice(own, 1, 0)
    longest = F.array_max(F.transform("__m", lambda x: x["n"]))
    many = F.when(hub["track_length"] < longest, own).otherwise(every) if kind == "fusion" else none
    single = (
        F.when(s <= 1, fragments)
        .when(F.col("__sure") & (u == 0), every).when(F.col("__sure") & (u == 1), unsure).when(F.col("__sure"), many)
        .when(u == 0, F.concat(own, every)).when(u == 1, F.concat(own, unsure)).otherwise(F.concat(own, fragments))
    )
    multi = F.when(s > 1, F.concat(own, fragments)).when(u == 1, F.concat(own, unsure)).otherwise(F.concat(own, every))
    rule = F.when(F.col("hub_type") == "single", single).otherwise(multi)
    flags = F.aggregate("__m", F.lit(0).cast("long"), lambda a, x: a + x["flag"])
    both = F.concat(own, every)
    if kind == "fusion":
        a, b = F.get("__m", F.lit(0))["area"], F.get("__m", F.lit(1))["area"]
        alike = 1 - F.try_divide(F.abs(a - b), a + b)
        candidate = (F.size("__m") == 2) & (flags > 1) & (alike > 0.8)
        return e.withColumn("discard", F.array_sort(rule)).withColumn("division", F.when(candidate, F.array_sort(both))).drop("__m", "__sure")
    long_members = count(lambda x: x["n"] > long_track)
    candidate = (hub["flag"] == 2) | F.exists("__m", lambda x: x["flag"] > 0) | (sure_hub & (long_members == 2) & (F.size("__m") == 2))
    open_ended = (F.col("hub_type") == "single") & (s > 1) & F.col("__sure") & (u > 1)
    kept = F.when(F.col("hub_type") == "single", fragments).otherwise(multi)
    return (
        e.withColumn("discard", F.array_sort(F.when(candidate, kept).otherwise(rule)))
        .withColumn("division", F.when(candidate | open_ended, F.array_sort(both)))
        .drop("__m", "__sure")
    )

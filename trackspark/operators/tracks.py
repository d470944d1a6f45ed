"""Track statistics, windows and edits.

All of it is keyed by (dataset, track_id), so one partitioning serves a chain of these steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from trackspark.functions.ranks import ranked

TRACK = ["dataset", "track_id"]


def by_track() -> WindowSpec:
    return Window.partitionBy(*TRACK)


def in_time() -> WindowSpec:
    return by_track().orderBy("timeframe")


# -- statistics -----------------------------------------------------------------------------------


def track_summary(cells: DataFrame) -> DataFrame:
    """A1: length, start, end, span, missing, vacancy (missing / span)."""
    s = cells.groupBy(*TRACK).agg(F.count("*").alias("length"), F.min("timeframe").alias("start"), F.max("timeframe").alias("end"))
    span = (F.col("end") - F.col("start") + 1).cast("long")
    return s.withColumn("span", span).withColumn("missing", F.col("span") - F.col("length")).withColumn("vacancy", F.col("missing") / F.col("span"))


def mean_missing_rate(cells: DataFrame) -> DataFrame:
    """A2: unweighted mean over tracks of 1 - length / span."""
    return track_summary(cells).agg(F.count("*").alias("n_tracks"), F.avg(1 - F.col("length") / F.col("span")).alias("mean_missing_rate"))


def time_span(cells: DataFrame) -> DataFrame:
    """A3."""
    return cells.agg(F.min("timeframe").alias("start"), F.max("timeframe").alias("end"))


def gaps(cells: DataFrame) -> DataFrame:
    """A4: frames inside a track's span without a cell: (dataset, track_id, timeframe)."""
    after = F.lead("timeframe").over(in_time())
    pairs = cells.select(*TRACK, "timeframe").distinct().withColumn("__next", after).where("__next > timeframe + 1")
    return pairs.select(*TRACK, F.explode(F.sequence(F.col("timeframe") + 1, F.col("__next") - 1)).alias("timeframe"))


def non_empty_tracks(cells: DataFrame, contour: str = "contour") -> DataFrame:
    """A5: cells of tracks that have a cell with a contour."""
    some = cells.groupBy(*TRACK).agg(F.max(F.coalesce(F.size(contour) > 0, F.lit(False))).alias("k")).where("k").select(*TRACK)
    return cells.join(some, TRACK, "left_semi")


def span_histogram(cells: DataFrame) -> DataFrame:
    """Number of tracks by span."""
    return track_summary(cells).groupBy("span").agg(F.count("*").alias("n_tracks"))


def live_tracks(cells: DataFrame) -> DataFrame:
    """Tracks whose span covers t, for each t in [first, last) of the collection.

    Starts and ends are counted per frame and summed up, so work does not grow with spans. The running
    sum is over frames, one row each."""
    s = track_summary(cells).select("dataset", "start", "end")
    events = s.select("dataset", F.col("start").alias("t"), F.lit(1).alias("d")).union(s.select("dataset", (F.col("end") + 1).alias("t"), F.lit(-1).alias("d")))
    changes = events.groupBy("dataset", "t").agg(F.sum("d").alias("d"))
    in_order = Window.partitionBy("dataset").orderBy("t")
    runs = changes.withColumn("n", F.sum("d").over(in_order)).withColumn("u", F.lead("t").over(in_order))
    last = F.max("t").over(Window.partitionBy("dataset")) - 1  # the last frame itself is left out
    runs = runs.withColumn("u", F.least("u", last)).where("u > t")
    return runs.select("dataset", F.explode(F.sequence(F.col("t"), F.col("u") - 1)).alias("timeframe"), F.col("n").alias("n_tracks"))


def cells_per_frame(cells: DataFrame) -> DataFrame:
    """A8."""
    return cells.groupBy("dataset", "timeframe").agg(F.count("*").alias("n_cells"), F.sort_array(F.collect_list("sc_id")).alias("sc_ids"))


def size_correlation(sisters: DataFrame, areas: DataFrame, enough: int = 4, least: int = 3) -> DataFrame:
    """Sisters (pair_id, a, b) of track ids; areas (track_id, timeframe, area). Pearson correlation of
    the first areas of both: 0 if either has fewer than ``least``, else of the first min(length,
    ``enough``)."""
    w = Window.partitionBy("track_id").orderBy("timeframe")
    ranked = areas.select("track_id", "area", F.row_number().over(w).alias("k"), F.count("*").over(Window.partitionBy("track_id")).alias("n"))
    ranked = ranked.where(F.col("k") <= enough)
    a = ranked.select(F.col("track_id").alias("a"), F.col("area").alias("area_a"), "k", F.col("n").alias("n_a"))
    b = ranked.select(F.col("track_id").alias("b"), F.col("area").alias("area_b"), "k", F.col("n").alias("n_b"))
    pairs = sisters.join(a, "a").join(b, ["b", "k"]).groupBy("pair_id").agg(F.corr("area_a", "area_b").alias("r"), F.min(F.least("n_a", "n_b")).alias("n"))
    out = sisters.select("pair_id").distinct().join(pairs, "pair_id", "left")
    return out.select("pair_id", F.when(F.coalesce(F.col("n"), F.lit(0)) < least, 0.0).otherwise(F.col("r")).alias("size_correlation"))


def relative_time(cells: DataFrame) -> DataFrame:
    """Frames since the track's first."""
    return cells.withColumn("relative_time", F.col("timeframe") - F.min("timeframe").over(by_track()))


def counts_above(samples: DataFrame, thresholds: list[int]) -> DataFrame:
    """Samples (sample_id, sc_id): for each threshold, samples with more cells, and their cells."""
    sizes = samples.groupBy("sample_id").agg(F.count("*").alias("n"))
    each = sizes.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).where("n > threshold")
    return each.groupBy("threshold").agg(F.count("*").alias("n_samples"), F.sum("n").alias("n_cells"))


# -- windows --------------------------------------------------------------------------------------


def sliding_clips(cells: DataFrame, window: int = 7, step: int = 1) -> DataFrame:
    """Full windows of ``window`` rows per track: clip number from 0, first and last frame. Members are
    the track's rows between them; join late."""
    k = F.row_number().over(in_time())
    last = F.lead("timeframe", window - 1).over(in_time())
    rows = cells.select(*TRACK, "timeframe", k.alias("k"), last.alias("end_time"))
    rows = rows.where(F.col("end_time").isNotNull() & ((F.col("k") - 1) % step == 0))
    return rows.select(*TRACK, ((F.col("k") - 1) / step).cast("long").alias("clip"), F.col("timeframe").alias("start_time"), "end_time")


def clip_members(cells: DataFrame, clips: DataFrame) -> DataFrame:
    """Cells of each clip."""
    c = clips.select(*TRACK, "clip", "start_time", "end_time")
    return cells.join(c, TRACK).where(F.col("timeframe").between(F.col("start_time"), F.col("end_time"))).drop("start_time", "end_time")


def sliding_stats(cells: DataFrame, value: str, window: int = 24) -> DataFrame:
    """Mean, population deviation and median absolute deviation of each window of rows; the track's
    last full window is left out."""
    frame = in_time().rowsBetween(0, window - 1)
    n, k = F.count("*").over(by_track()), F.row_number().over(in_time())
    rows = cells.select(
        *TRACK, "timeframe", k.alias("k"), n.alias("n"),
        F.avg(value).over(frame).alias("mean"), F.stddev_pop(value).over(frame).alias("std"), F.collect_list(value).over(frame).alias("__v"),
    )
    rows = rows.where(F.col("k") <= F.col("n") - window).withColumn("__m", _median(F.col("__v")))
    mad = _median(F.transform("__v", lambda x: F.abs(x - F.col("__m"))))
    return rows.select(*TRACK, "timeframe", F.col("k").alias("window"), "mean", "std", mad.alias("mad"))


def _median(values: Column) -> Column:
    s, n = F.sort_array(values), F.size(values)
    return (F.get(s, ((n - 1) / 2).cast("int")) + F.get(s, (n / 2).cast("int"))) / 2


def stable_scale(cells: DataFrame, value: str, window: int = 12, t_range: int = 36, sort_range: int = 6) -> DataFrame:
    """Of the first ``t_range`` windows the ``sort_range`` steadiest, of those the one with the least
    mean: its mean and deviation scale the track."""
    w = sliding_stats(cells, value, window).where(F.col("window") <= t_range)
    steady = w.withColumn("r", F.row_number().over(by_track().orderBy("std", "window"))).where(F.col("r") <= sort_range)
    best = steady.groupBy(*TRACK).agg(F.min(F.struct("mean", "window", "std")).alias("b")).select(*TRACK, F.col("b.mean").alias("__m"), F.col("b.std").alias("__s"))
    scaled = (F.col(value) - F.col("__m")) / F.when(F.col("__s") == 0, 1.0).otherwise(F.col("__s"))
    return cells.join(best, TRACK).withColumn("scaled", scaled).drop("__m", "__s")


def neighbours_in_time(cells: DataFrame) -> DataFrame:
    """Previous and next frame of the track, gap to the next, whether that is the next frame."""
    before, after = F.lag("timeframe").over(in_time()), F.lead("timeframe").over(in_time())
    return cells.withColumn("prev_time", before).withColumn("next_time", after).withColumn("gap", F.col("next_time") - F.col("timeframe")).withColumn("consecutive", F.col("gap") == 1)


def relabel_tracks(cells: DataFrame) -> DataFrame:
    """Tracks numbered from 1 by first frame, then by old label; labels of 0 or less stay."""
    starts = cells.where("track_id > 0").groupBy(*TRACK).agg(F.min("timeframe").alias("__s"))
    ids = ranked(starts, ["dataset"], ["__s", "track_id"], "__k").select(*TRACK, (F.col("__k") + 1).alias("__new"))
    return cells.join(ids, TRACK, "left").withColumn("track_id", F.coalesce("__new", "track_id")).drop("__new")


def track_ends(cells: DataFrame, *columns: str) -> DataFrame:
    """The named columns of each track's first and last cell."""
    row = F.struct(*columns)
    out = cells.groupBy(*TRACK).agg(
        F.min("timeframe").alias("start"), F.max("timeframe").alias("end"), F.min_by(row, "timeframe").alias("f"), F.max_by(row, "timeframe").alias("l")
    )
    return out.select(*TRACK, "start", "end", *[F.col(f"{k}.{c}").alias(f"{p}_{c}") for p, k in (("first", "f"), ("last", "l")) for c in columns])


def event_flag_near(cells: DataFrame, flag: str, t_range: int = 3, later: bool = True) -> DataFrame:
    """The last non-null flag of the track among this frame and the ``t_range`` - 1 after (or before)
    it; 0: none. The dataset's last frame (later) and frame 0 (before) are not looked at."""
    seen = F.col("timeframe") > 0
    w = in_time().rangeBetween(0, t_range - 1) if later else in_time().rangeBetween(-(t_range - 1), 0)
    # a window over all frames of a dataset would gather it; its last frame comes from an aggregate
    if later:
        ends = cells.groupBy("dataset").agg(F.max("timeframe").alias("__end"))
        cells, seen = cells.join(ends, "dataset"), F.col("timeframe") < F.col("__end")
    flagged = F.last(F.when(seen, F.col(flag)), ignorenulls=True).over(w)
    return cells.withColumn("near_flag", F.coalesce(flagged, F.lit(0))).drop("__end")


def apoptosis_tracklets(cells: DataFrame, flag: str = "flag", area: str = "area") -> DataFrame:
    """By length (3, 5, 10, more): the flag near the track's end, within 1, 2, 3 or 5 frames, is 1;
    beyond 10 the flag near its start too, and the mean of its five largest areas is below twice that of
    its five smallest."""
    ends = None
    for k, r in enumerate((1, 2, 3, 5)):
        near = event_flag_near(cells, flag, r, later=False).groupBy(*TRACK).agg(F.max_by("near_flag", "timeframe").alias(f"e{k}"))
        ends = near if ends is None else ends.join(near, TRACK)
    start = event_flag_near(cells, flag, 5).groupBy(*TRACK).agg(F.min_by("near_flag", "timeframe").alias("s"))
    sizes = cells.groupBy(*TRACK).agg(F.count("*").alias("length"), F.sort_array(F.collect_list(area)).alias("a"))
    n = F.col("length").cast("int")
    mean = lambda part: F.aggregate(part, F.lit(0.0), lambda x, y: x + y) / F.size(part)
    even = mean(F.slice("a", F.greatest(n - 4, F.lit(1)), F.lit(5))) < 2 * mean(F.slice("a", 1, 5))
    rule = (
        F.when(n <= 3, F.col("e0") == 1).when(n <= 5, F.col("e1") == 1).when(n <= 10, F.col("e2") == 1)
        .otherwise((F.col("s") == 1) & (F.col("e3") == 1) & even)
    )
    return sizes.join(ends, TRACK).join(start, TRACK).select(*TRACK, "length", rule.alias("apoptosis"))


def abnormal_jumps(cells: DataFrame, value: str, least: float = 5.0) -> DataFrame:
    """Jumps of a signal between its non-zero values, over their mean size. A rise that is a local peak
    of ``least`` or more marks the frame after it, a fall the frame before it. A run of equal jumps counts
    once, in its middle (rises: the earlier of two, falls: the later); the first and last run don't."""
    rows = cells.where(F.col(value) != 0).select(*TRACK, "timeframe", (F.col(value) - F.lag(value).over(in_time())).alias("d"), F.lag("timeframe").over(in_time()).alias("before"))
    rows = rows.where("d IS NOT NULL").withColumn("jump", F.col("d") / F.nullif(F.avg(F.abs("d")).over(by_track()), F.lit(0.0)))
    new = F.coalesce((F.col("jump") != F.lag("jump").over(in_time())).cast("int"), F.lit(1))
    runs = rows.withColumn("run", F.sum(new).over(in_time())).groupBy(*TRACK, "run").agg(
        F.first("jump").alias("jump"), F.sort_array(F.collect_list(F.struct("timeframe", "before"))).alias("ts")
    )
    w = by_track().orderBy("run")
    left, right, j = F.lag("jump").over(w), F.lead("jump").over(w), F.col("jump")
    k = F.size("ts") - 1
    rise = F.when((j > left) & (j > right) & (j >= least), F.get("ts", (k / 2).cast("int"))["timeframe"])
    fall = F.when((j < left) & (j < right) & (j <= -least), F.get("ts", ((k + 1) / 2).cast("int"))["before"])
    marked = runs.select(*TRACK, rise.alias("rise"), fall.alias("fall"))
    return marked.select(*TRACK, F.explode(F.array_compact(F.array("rise", "fall"))).alias("timeframe")).distinct()


def merge_segments(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Segments (keys, start, end), both ends inclusive, merged where they overlap or touch in a
    point. A segment inside another vanishes (an insert-by-insert merge would miss that)."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.coalesce((F.col("start") > reach).cast("int"), F.lit(1))).over(w)
    return segments.withColumn("__i", island).groupBy(*keys, "__i").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__i")


def clip_times(clips: DataFrame) -> DataFrame:
    """Clips (clip, timeframe, ...): frames since the clip's start, since its first frame with more
    than one cell (null if there is none), and the former standardised within the clip by the population
    deviation (0 counts as 1)."""
    by = Window.partitionBy("clip")
    n = F.count("*").over(Window.partitionBy("clip", "timeframe"))
    rows = clips.withColumn("__n", n).withColumn("relative_time", F.col("timeframe") - F.min("timeframe").over(by))
    divided = F.min(F.when(F.col("__n") > 1, F.col("timeframe"))).over(by)
    sd = F.stddev_pop("relative_time").over(by)
    rows = rows.withColumn("division_time", F.col("timeframe") - divided)
    return rows.withColumn("standard_time", (F.col("relative_time") - F.avg("relative_time").over(by)) / F.when(sd == 0, 1.0).otherwise(sd)).drop("__n")


def size_changes(cells: DataFrame, area: str = "area") -> DataFrame:
    """Change of area over the area before, and of the box centre."""
    a, cx, cy = F.lag(area).over(in_time()), (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    return (
        cells.withColumn("size_change", (F.col(area) - a) / F.nullif(a, F.lit(0.0)))
        .withColumn("dx", cx - F.lag(cx).over(in_time()))
        .withColumn("dy", cy - F.lag(cy).over(in_time()))
    )


def last_frames(cells: DataFrame, k: int = 8) -> DataFrame:
    """Cells from k frames before the track's end on."""
    return cells.withColumn("__e", F.max("timeframe").over(by_track())).where(F.col("timeframe") >= F.col("__e") - k).drop("__e")


def track_classes(cells: DataFrame, status: str, dividing: str, excluded: list[str]) -> DataFrame:
    """Mitosis if the last cell's status is ``dividing``; normal if none has an excluded status."""
    s = cells.groupBy(*TRACK).agg(F.max_by(status, "timeframe").alias("l"), F.max(F.col(status).isin(excluded)).alias("x"))
    return s.select(*TRACK, F.when(F.col("l") == dividing, "mitosis").when(F.col("x"), "excluded").otherwise("normal").alias("track_class"))


def fill_frames(cells: DataFrame, last: int) -> DataFrame:
    """Every frame of 0 to ``last`` of each track; values are null where there was none."""
    ids = cells.select(*TRACK).distinct().withColumn("timeframe", F.explode(F.sequence(F.lit(0), F.lit(last))))
    return ids.join(cells, [*TRACK, "timeframe"], "left")


# -- order and matrix -----------------------------------------------------------------------------


def in_time_order(cells: DataFrame) -> DataFrame:
    """O1: by frame, track and id inside partitions of frames; no total sort."""
    return cells.repartitionByRange("timeframe", "track_id", "sc_id").sortWithinPartitions("timeframe", "track_id", "sc_id")


def track_matrix(cells: DataFrame, last: int, value: str = "sc_id") -> DataFrame:
    """Per track an array over frames 0 to ``last``, -1 where it has no cell."""
    m = F.map_from_entries(F.collect_list(F.struct("timeframe", F.col(value).cast("long"))))
    dense = F.transform(F.sequence(F.lit(0), F.lit(last)), lambda t: F.coalesce(F.element_at("__m", t), F.lit(-1).cast("long")))
    return cells.groupBy(*TRACK).agg(m.alias("__m")).select(*TRACK, dense.alias("frames"))


# -- edits ----------------------------------------------------------------------------------------


def last_write_wins(cells: DataFrame, order: str = "sc_id") -> DataFrame:
    """One cell per track and frame, the last by ``order``. Partial maxima meet before the shuffle."""
    rest = [c for c in cells.columns if c not in (*TRACK, "timeframe")]
    top = F.max_by(F.struct(*rest), order)
    return cells.groupBy(*TRACK, "timeframe").agg(top.alias("r")).select(*TRACK, "timeframe", "r.*")


def union_all(*tables: DataFrame) -> DataFrame:
    """Rows of tables whose columns differ."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def candidate_pairs(a: DataFrame, b: DataFrame, visited: DataFrame, annotated: DataFrame) -> DataFrame:
    """Pairs of either rule, not visited yet, and annotated."""
    return a.union(b).distinct().subtract(visited).intersect(annotated)


def connect_tracks(cells: DataFrame, edits: DataFrame, components) -> DataFrame:
    """Edits (dataset, a, b): tracks become one, which has the smallest id. An error if spans of
    two tracks that meet overlap. ``components`` maps edges (a, b) to (node, root)."""
    spans = track_summary(cells).select(*TRACK, "start", "end")
    a, b = (spans.select("dataset", F.col("track_id").alias(k), F.col("start").alias(f"s_{k}"), F.col("end").alias(f"e_{k}")) for k in "ab")
    apart = (F.col("e_a") < F.col("s_b")) | (F.col("e_b") < F.col("s_a"))
    bad = edits.join(a, ["dataset", "a"]).join(b, ["dataset", "b"]).where(~apart).limit(1).count()
    if bad:
        raise ValueError("tracks to connect overlap in time")
    roots = components(edits.select("a", "b"))
    return cells.join(roots, F.col("track_id") == F.col("node"), "left").withColumn("track_id", F.coalesce("root", "track_id")).drop("node", "root")


def split_tracks(cells: DataFrame, edits: DataFrame) -> DataFrame:
    """U4: edits (dataset, track_id, at), one per track, a cell stands at ``at``: [start, at - 1] and
    [at, end] get ids above the largest id of the other tracks, in order of track."""
    cut = cells.join(edits, TRACK, "left")
    largest = cut.where("at IS NULL").groupBy("dataset").agg(F.max("track_id").alias("__max"))
    ids = ranked(edits.select(*TRACK, "at"), ["dataset"], ["track_id"], "__k").withColumn("__k", 2 * F.col("__k")).join(largest, "dataset", "left")
    ids = ids.select(*TRACK, F.col("at").alias("__at"), (F.coalesce("__max", F.lit(-1)) + 1 + F.col("__k")).alias("__low"))
    out = cells.join(ids, TRACK, "left")
    new = F.when(F.col("__at").isNull(), F.col("track_id")).otherwise(F.col("__low") + (F.col("timeframe") >= F.col("__at")).cast("int"))
    return out.withColumn("track_id", new.cast("long")).drop("__at", "__low")


def add_lineage(lineage: DataFrame, new: DataFrame) -> DataFrame:
    """Union of edges; an edge from a track to itself is an error."""
    loops = F.assert_true(F.col("mother_id") != F.col("daughter_id"), F.lit("a track cannot be its own mother"))
    return lineage.union(new.select(*lineage.columns)).distinct().where(loops.isNull())


def break_links(cells: DataFrame, cuts: DataFrame) -> DataFrame:
    """Cuts (dataset, track_id, timeframe): from each on, the track's rows have a fresh label."""
    c = cuts.select(*TRACK, "timeframe").distinct().withColumn("__c", F.lit(1))
    rows = cells.join(c, [*TRACK, "timeframe"], "left").withColumn("__part", F.coalesce(F.sum("__c").over(in_time()), F.lit(0)))
    tops = cells.groupBy("dataset").agg(F.max("track_id").alias("__top"))
    parts = rows.where("__part > 0").select(*TRACK, "__part").distinct()
    ids = ranked(parts, ["dataset"], ["track_id", "__part"], "__f").join(tops, "dataset").select(*TRACK, "__part", (F.col("__top") + F.col("__f") + 1).alias("__new"))
    return rows.join(ids, [*TRACK, "__part"], "left").withColumn("track_id", F.coalesce("__new", "track_id")).drop("__c", "__part", "__new")


def mark_false_objects(cells: DataFrame, false_objects: DataFrame) -> DataFrame:
    """Their label is -1. false_objects (dataset, sc_id)."""
    f = false_objects.select("dataset", "sc_id").distinct().withColumn("__f", F.lit(True))
    return cells.join(f, ["dataset", "sc_id"], "left").withColumn("track_id", F.when(F.col("__f"), F.lit(-1).cast("long")).otherwise(F.col("track_id"))).drop("__f")


def offset_union(collections: list[DataFrame]) -> DataFrame:
    """Collections one after the other, each collection's track ids moved above the largest before."""
    tagged = union_all(*[c.withColumn("__k", F.lit(k)) for k, c in enumerate(collections)])
    tops = tagged.groupBy("__k").agg((F.max("track_id") + 1).alias("__n"))
    before = Window.orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)  # one row per collection
    offsets = tops.select("__k", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    return tagged.join(offsets, "__k").withColumn("track_id", F.col("track_id") + F.col("__o")).drop("__k", "__o")


def replace_frames(cells: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``other`` take the place of all rows that share their keys."""
    return cells.join(other.select(*keys).distinct(), keys, "left_anti").unionByName(other.select(*cells.columns))


def single_cell_tracks(cells: DataFrame) -> DataFrame:
    """Every detection is a track of its own, numbered from 0 by frame and id within its dataset.

    Frames are counted first, so that ranks come from sums over frames and places inside one frame."""
    per = cells.groupBy("dataset", "timeframe").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("dataset").orderBy("timeframe").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select("dataset", "timeframe", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__s"))
    place = F.row_number().over(Window.partitionBy("dataset", "timeframe").orderBy("sc_id")) - 1
    return cells.withColumn("__p", place).join(starts, ["dataset", "timeframe"]).withColumn("track_id", F.col("__s") + F.col("__p")).drop("__s", "__p")


def at_frames(cells: DataFrame, column: Column) -> DataFrame:
    """Rows of the frames where a condition holds."""
    return cells.where(column)

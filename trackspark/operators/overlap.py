"""Overlap of cells and of label images (J1 to J6, J24, A16 to A19, A36, G5 to G8, W10, X11 adjacency).

Boxes meet through a tile key: a box is copied to the tiles it touches, and a pair counts in the tile
that holds the larger of the two lower corners, so each pair is found once. Pixels meet by position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackspark.functions.geometry import box_iomin, box_iou
from trackspark.functions.graph import Rounds

FRAME = ["dataset", "timeframe"]
TILE = 64


def tiled(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """A row per tile that the box touches: __tx, __ty."""
    span = lambda a, b: F.sequence(F.floor(F.col(a) / tile), F.floor(F.col(b) / tile))
    return cells.withColumn("__tx", F.explode(span("x1", "x2"))).withColumn("__ty", F.explode(span("y1", "y2")))


def box_pairs(a: DataFrame, b: DataFrame, keys: list[str], tile: int = TILE) -> DataFrame:
    """Pairs of boxes of the same keys that overlap or touch: keys, sc_a, sc_b, iou, iomin."""
    side = lambda df, s: tiled(df, tile).select(*keys, "__tx", "__ty", F.col("sc_id").alias(f"sc_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("x1", "y1", "x2", "y2")])
    p = side(a, "a").join(side(b, "b"), [*keys, "__tx", "__ty"])
    lo = lambda c: F.greatest(f"{c}_a", f"{c}_b")
    hi = lambda c: F.least(f"{c}_a", f"{c}_b")
    p = p.where((lo("x1") <= hi("x2")) & (lo("y1") <= hi("y2")) & (F.floor(lo("x1") / tile) == F.col("__tx")) & (F.floor(lo("y1") / tile) == F.col("__ty")))
    box = lambda s: [F.col(f"{c}_{s}") for c in ("x1", "y1", "x2", "y2")]
    return p.select(*keys, "sc_a", "sc_b", box_iou(*box("a"), *box("b")).alias("iou"), box_iomin(*box("a"), *box("b")).alias("iomin"))


def frame_pairs(cells: DataFrame, dt: int = 1) -> DataFrame:
    """Pairs of a cell at frame t (timeframe) and one at t + dt whose boxes overlap or touch."""
    later = cells.withColumn("timeframe", F.col("timeframe") - dt)
    return box_pairs(cells, later, FRAME)


def pixel_join(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Two label images (keys, r, c, label) as one table with label_a and label_b; 0: background."""
    both = a.withColumnRenamed("label", "label_a").join(b.withColumnRenamed("label", "label_b"), [*keys, "r", "c"], "full")
    return both.withColumn("label_a", F.coalesce("label_a", F.lit(0))).withColumn("label_b", F.coalesce("label_b", F.lit(0)))


def label_overlap(pixels: DataFrame, keys: list[str], background: int = 0) -> DataFrame:
    """Keys, label_a, label_b, overlap, area_a, area_b, iou, io_a, io_b of labels that share pixels.

    Counts combine before the shuffle; areas are sums of the same counts, so pixels are read once."""
    n = pixels.groupBy(*keys, "label_a", "label_b").agg(F.count("*").alias("overlap"))
    area = lambda s: F.sum("overlap").over(Window.partitionBy(*keys, f"label_{s}")).alias(f"area_{s}")
    n = n.select("*", area("a"), area("b")).where((F.col("label_a") != background) & (F.col("label_b") != background))
    inter = F.col("overlap")
    return n.select("*", (inter / (F.col("area_a") + F.col("area_b") - inter)).alias("iou"), (inter / F.col("area_a")).alias("io_a"), (inter / F.col("area_b")).alias("io_b"))


def find_maps(pairs: DataFrame, sources: DataFrame, keys: list[str], threshold: float = 0.3, metric: str = "iomin") -> DataFrame:
    """Per source (keys, sc_a): number of targets above the threshold and these; sources without one
    have 0 (zero maps), more than one is a multi map."""
    hits = pairs.where(F.col(metric) > threshold).groupBy(*keys, "sc_a").agg(F.count("*").alias("n_targets"), F.sort_array(F.collect_list("sc_b")).alias("targets"))
    every = sources.select(*keys, F.col("sc_id").alias("sc_a"))
    out = every.join(hits, [*keys, "sc_a"], "left")
    return out.withColumn("n_targets", F.coalesce("n_targets", F.lit(0))).withColumn("targets", F.coalesce("targets", F.array().cast("array<bigint>")))


def zero_maps(pairs: DataFrame, sources: DataFrame, keys: list[str], threshold: float = 0.3, metric: str = "iomin") -> DataFrame:
    """The sources, with their columns, that have no target above the threshold (zero maps)."""
    return sources.join(pairs.where(F.col(metric) > threshold).select(*keys, F.col("sc_a").alias("sc_id")), [*keys, "sc_id"], "left_anti")


def map_rates(maps: DataFrame, keys: list[str]) -> DataFrame:
    """Multi and zero maps per frame pair, and their shares of the sources."""
    n = maps.groupBy(*keys).agg(F.count("*").alias("n_sources"), F.count_if(F.col("n_targets") > 1).alias("n_multi"), F.count_if(F.col("n_targets") == 0).alias("n_zero"))
    return n.withColumn("multi_rate", F.col("n_multi") / F.col("n_sources")).withColumn("zero_rate", F.col("n_zero") / F.col("n_sources"))


def label_map(overlap: DataFrame, keys: list[str], threshold: float = 0.2) -> DataFrame:
    """Per label_a the map of label_b to iou above the threshold."""
    hits = overlap.where(F.col("iou") > threshold)
    return hits.groupBy(*keys, "label_a").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label_b", "iou")))).alias("targets"))


def best_match(overlap: DataFrame, keys: list[str]) -> DataFrame:
    """Per label_b (truth) the label_a with the largest iou, the lowest label on ties; labels that
    overlap nothing have no row."""
    return overlap.groupBy(*keys, "label_b").agg(F.max_by("label_a", F.struct("iou", -F.col("label_a"))).alias("label_a"), F.max("iou").alias("iou"))


def extend_zero_maps(zero: DataFrame, cells: DataFrame, threshold: float = 0.2, ahead: int = 32) -> DataFrame:
    """Zero (dataset, timeframe, sc_id and box): each cell is repeated into the later frames that hold
    cells, up to the first with a cell above the threshold (iomin), which is left out.

    The stop is searched in the rest of a cell's block of ``ahead`` frames and the block after that, then for the
    cells that have none there in two blocks twice as wide that go on from there, and so on. Wider blocks begin at
    multiples of their width, so a cell meets again one block of the round before at most. Repeated rows are as many
    as the result has. ``cells`` are read in each round, so give a table that is cheap to read; ``zero`` is made once."""
    t = Rounds(zero.sparkSession)
    box = ["x1", "y1", "x2", "y2"]
    made = t.write(zero.select("dataset", "timeframe", "sc_id", *box), "zero")
    start = made.select("dataset", "timeframe", F.col("sc_id").alias("sc_a"))
    left = made.select("dataset", "sc_id", (F.col("timeframe").cast("long") + 1).alias("__next"), *box)
    last, width, k, stops = cells.agg(F.max("timeframe")).first()[0], ahead, 0, None
    while last is not None:
        block = F.floor(F.col("__next") / width)
        a = left.select("dataset", F.explode(F.array(block, block + 1)).alias("__b"), F.struct("sc_id", "__next").alias("sc_id"), *box)
        b = cells.select("dataset", F.floor(F.col("timeframe") / width).alias("__b"), F.col("timeframe").alias("sc_id"), *box)
        later = box_pairs(a, b, ["dataset", "__b"]).where((F.col("iomin") > threshold) & (F.col("sc_b") >= F.col("sc_a.__next")))
        hit = t.write(later.groupBy("dataset", F.col("sc_a.sc_id").alias("sc_a")).agg(F.min("sc_b").alias("stop")), f"h{k}")
        stops = hit if stops is None else stops.union(hit)
        left = left.withColumn("__next", (block + 2) * width).where(F.col("__next") <= last)
        left = t.write(left.join(hit.select("dataset", F.col("sc_a").alias("sc_id")), ["dataset", "sc_id"], "left_anti"), f"z{k}")
        t.drop(f"z{k - 1}")
        k, width = k + 1, 2 * width
        if left.isEmpty():
            break
    t.drop(f"z{k - 1}")
    stop = stops if stops is not None else start.select("dataset", "sc_a", F.col("timeframe").alias("stop")).limit(0)
    frames = cells.select("dataset", F.col("timeframe").alias("t")).distinct().groupBy("dataset").agg(F.sort_array(F.collect_set("t")).alias("ts"))
    spans = start.join(stop, ["dataset", "sc_a"], "left").join(frames, "dataset")
    every = spans.select("dataset", F.col("sc_a").alias("sc_id"), F.col("timeframe").alias("since"), "stop", F.explode("ts").alias("timeframe"))
    return every.where((F.col("timeframe") >= F.col("since")) & (F.col("stop").isNull() | (F.col("timeframe") < F.col("stop")))).select("dataset", "sc_id", "timeframe")


def underseg_groups(best: DataFrame, regions: DataFrame, boxes: DataFrame, keys: list[str], padding_scale: float = 1.5) -> DataFrame:
    """Truth labels matched to one segment label, with the segment's box padded by
    int((scale - 1) * longer side). Segments of several pieces are left out. regions: keys, label_a,
    n_pieces; boxes: keys, label_a, x1 to y2."""
    groups = best.groupBy(*keys, "label_a").agg(F.count("*").alias("n_cells"), F.sort_array(F.collect_list("label_b")).alias("members")).where("n_cells > 1")
    one = regions.where("n_pieces = 1").select(*keys, "label_a")
    g = groups.join(one, [*keys, "label_a"], "left_semi").join(boxes, [*keys, "label_a"])
    pad = ((padding_scale - 1) * F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).cast("long")
    return g.select(*keys, "label_a", "n_cells", "members", (F.col("x1") - pad).alias("x1"), (F.col("y1") - pad).alias("y1"), (F.col("x2") + pad).alias("x2"), (F.col("y2") + pad).alias("y2"))


# -- evaluation of segmentations ------------------------------------------------------------------


def _label_counts(pixels: DataFrame, keys: list[str]) -> DataFrame:
    some = lambda c: F.count_distinct(F.when(F.col(c) != 0, F.col(c)))
    return pixels.groupBy(*keys).agg(some("label_a").alias("n_out"), some("label_b").alias("n_gt"))


def match_counts(pixels: DataFrame, keys: list[str], thresholds: tuple[float, ...] = (0.8,)) -> DataFrame:
    """Per keys and threshold: truth labels (b) for which exactly one output label (a) has an iou above
    the threshold, and the numbers of labels."""
    o = label_overlap(pixels, keys).withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    one = o.groupBy(*keys, "threshold", "label_b").agg(F.count_if(F.col("iou") > F.col("threshold")).alias("n")).where("n = 1")
    matched = one.groupBy(*keys, "threshold").agg(F.count("*").alias("matched"))
    every = _label_counts(pixels, keys).withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    return every.join(matched, [*keys, "threshold"], "left").withColumn("matched", F.coalesce("matched", F.lit(0)))


def sample_metrics(pixels: DataFrame, keys: list[str], thresholds: tuple[float, ...] = (0.5, 0.6, 0.7, 0.8, 0.9, 0.95)) -> DataFrame:
    """Pixel accuracy and iou of foregrounds, count differences, and per threshold the matched labels,
    their share of the truth (infinite if there is none) and whether all match."""
    a, b = F.col("label_a") != 0, F.col("label_b") != 0
    base = pixels.groupBy(*keys).agg(F.avg((a == b).cast("double")).alias("accuracy"), F.count_if(a & b).alias("i"), F.count_if(a | b).alias("u"))
    base = base.select(*keys, "accuracy", F.try_divide("i", "u").alias("iou"))
    m = match_counts(pixels, keys, thresholds).join(base, keys)
    gt = F.col("n_gt")
    infinite = F.lit(float("inf"))
    return m.select(
        *keys, "threshold", "accuracy", "iou", "n_out", "n_gt", "matched",
        F.abs(F.col("n_out") - gt).alias("count_diff"),
        F.when(gt == 0, infinite).otherwise(F.try_divide(F.abs(F.col("n_out") - gt), gt)).alias("count_diff_share"),
        F.when(gt == 0, infinite).otherwise(F.try_divide(F.col("matched"), gt)).alias("matched_share"),
        ((F.col("matched") == gt) & (F.col("matched") == F.col("n_out"))).alias("all_match"),
    )


def mean_metrics(metrics: DataFrame) -> DataFrame:
    """Means over samples, per threshold."""
    return metrics.groupBy("threshold").agg(*[F.avg(c).alias(c) for c in ("accuracy", "iou", "count_diff", "matched")], F.avg(F.col("all_match").cast("double")).alias("all_match"))


def dominant_ids(pixels: DataFrame, keys: list[str], least: float = 0.8) -> DataFrame:
    """Per cell (keys, label_a) the track id (label_b > 0) with most pixels, the lowest on ties, its
    share of the non-zero ones, and why the cell is (in)valid."""
    n = pixels.where("label_a <> 0").groupBy(*keys, "label_a", "label_b").agg(F.count("*").alias("n"))
    some = F.col("label_b") > 0
    own = n.groupBy(*keys, "label_a").agg(
        F.max(F.when(some, F.struct("n", (-F.col("label_b")).alias("m")))).alias("t"), F.count_if(some).alias("n_ids"), F.sum(F.when(some, F.col("n"))).alias("total")
    )
    share = F.col("t.n") / F.col("total")
    reason = F.when(F.col("n_ids") == 0, "no_track").when(F.col("n_ids") == 1, "single").when(share >= least, "dominant").otherwise("ambiguous")
    return own.select(*keys, "label_a", (-F.col("t.m")).alias("track_id"), share.alias("share"), reason.alias("reason"), reason.isin("single", "dominant").alias("valid"))


# -- links between label images -------------------------------------------------------------------


def fusions(overlap: DataFrame, keys: list[str], source: str = "label_a", target: str = "label_b") -> DataFrame:
    """Each source goes to the target it overlaps most (ties: the lowest); targets with two or more
    sources. With source and target exchanged: splits."""
    to = overlap.groupBy(*keys, source).agg(F.max_by(target, F.struct("overlap", -F.col(target))).alias("t"))
    return to.groupBy(*keys, F.col("t").alias(target)).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(source)).alias("members")).where("n >= 2")


def link_types(links: DataFrame, overlap: DataFrame, keys: list[str]) -> DataFrame:
    """Links (keys, label_a, label_b): 0 both are each other's largest overlap, 1 only the target is the
    source's, 2 only the source is the target's, 3 neither."""
    fwd = overlap.groupBy(*keys, "label_a").agg(F.max_by("label_b", F.struct("overlap", -F.col("label_b"))).alias("best_b"))
    back = overlap.groupBy(*keys, "label_b").agg(F.max_by("label_a", F.struct("overlap", -F.col("label_a"))).alias("best_a"))
    out = links.join(fwd, [*keys, "label_a"], "left").join(back, [*keys, "label_b"], "left")
    f, b = F.coalesce(F.col("best_b") == F.col("label_b"), F.lit(False)), F.coalesce(F.col("best_a") == F.col("label_a"), F.lit(False))
    return out.withColumn("mol_type", F.when(f & b, 0).when(f, 1).when(b, 2).otherwise(3))


def false_links(links: DataFrame, overlap: DataFrame, keys: list[str]) -> DataFrame:
    """Links with their type (G6) and whether they are false.

    The better parent of a link's target and the better child of its source are each *free* (in no link), or
    *astray* (their only link is of type 3), or *loose* (their only link is of another type but 0).
    Type 0: never false. 1: the better parent is free. 2: the better child is free. 3: any of the two
    that exist is free or astray, or both are loose."""
    t = link_types(links, overlap, keys)
    by = lambda label, s: t.groupBy(*keys, F.col(label).alias(f"best_{s}")).agg(F.count("*").alias(f"n_{s}"), F.min("mol_type").alias(f"t_{s}"))
    t = t.join(by("label_a", "a"), [*keys, "best_a"], "left").join(by("label_b", "b"), [*keys, "best_b"], "left")
    free = lambda s: F.col(f"best_{s}").isNotNull() & F.col(f"n_{s}").isNull()
    kind = lambda s: F.coalesce(F.when(F.col(f"n_{s}") == 1, F.col(f"t_{s}")), F.lit(0))
    third = free("a") | free("b") | (kind("a") == 3) | (kind("b") == 3) | ((kind("a") > 0) & (kind("b") > 0))
    false = F.when(F.col("mol_type") == 0, False).when(F.col("mol_type") == 1, free("a")).when(F.col("mol_type") == 2, free("b")).otherwise(third)
    return t.select(*keys, "label_a", "label_b", "mol_type", false.alias("false_link"))


def groups_to_break(groups: DataFrame, flagged: DataFrame, border: DataFrame, keys: list[str], hub: str = "label_b", member: str = "label_a") -> DataFrame:
    """Groups (keys, hub, members) of divisions, fusions or splits. A group breaks if a link of it is
    false or missing, or two or more of its members touch the border. flagged: links with false_link;
    border: (keys, member) of border objects."""
    each = groups.select(*keys, hub, F.explode("members").alias(member))
    each = each.join(flagged.select(*keys, hub, member, "false_link"), [*keys, hub, member], "left")
    each = each.join(border.select(*keys, member, F.lit(1).alias("edge")).distinct(), [*keys, member], "left")
    return each.groupBy(*keys, hub).agg(
        (F.max(F.coalesce("false_link", F.lit(True))) | (F.count("edge") >= 2)).alias("broken"), F.count("*").alias("n")
    )


def consensus(pairs: DataFrame, cells: DataFrame, window: int = 3, threshold: float = 0.3) -> DataFrame:
    """Each cell against the frames of its track's next ``window`` cells: uniform there if exactly one
    cell overlaps it above the threshold. Fails unless the uniform ones number over n / 2 - 1. pairs: box
    pairs of different frames (sc_a, sc_b, iou); returns (track, timeframe, n, uniform, failed)."""
    w = Window.partitionBy("dataset", "track_id").orderBy("timeframe")
    nexts = F.array_compact(F.array(*[F.lead("timeframe", k).over(w) for k in range(1, window + 1)]))
    own = cells.select("dataset", "track_id", "timeframe", "sc_id", nexts.alias("ts"))
    own = own.select("dataset", "track_id", "timeframe", "sc_id", F.explode("ts").alias("t"))
    to = cells.select("dataset", F.col("sc_id").alias("sc_b"), F.col("timeframe").alias("t"))
    hits = pairs.where(F.col("iou") > threshold).join(to, ["dataset", "sc_b"]).groupBy("dataset", F.col("sc_a").alias("sc_id"), "t").agg(F.count("*").alias("n"))
    each = own.join(hits, ["dataset", "sc_id", "t"], "left").withColumn("u", F.coalesce((F.col("n") == 1).cast("long"), F.lit(0)))
    out = each.groupBy("dataset", "track_id", "timeframe").agg(F.count("*").alias("n"), F.sum("u").alias("uniform"))
    return out.withColumn("failed", ~(F.col("uniform") > F.col("n") / 2 - 1))


def adjacency(pixels: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """X11: pairs of labels whose pixels are 4-neighbours, with the number of contacts."""
    p = pixels.select(*keys, "r", "c", F.col(label).alias("a")).where("a <> 0")
    moves = F.array(F.struct(F.lit(0).cast("long").alias("dr"), F.lit(1).cast("long").alias("dc")), F.struct(F.lit(1).cast("long").alias("dr"), F.lit(0).cast("long").alias("dc")))
    moved = p.select(*keys, "r", "c", "a", F.explode(moves).alias("m")).select(*keys, (F.col("r") + F.col("m.dr")).alias("r"), (F.col("c") + F.col("m.dc")).alias("c"), "a")
    both = moved.join(p.withColumnRenamed("a", "b"), [*keys, "r", "c"]).where("a <> b")
    return both.groupBy(*keys, F.least("a", "b").alias("label_1"), F.greatest("a", "b").alias("label_2")).agg(F.count("*").alias("contacts"))

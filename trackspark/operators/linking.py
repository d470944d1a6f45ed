"""Links over frames: gaps, divisions, candidates, assignment, box tracking."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackspark.functions.assignment import assign_allowed
from trackspark.functions.geometry import contains_point
from trackspark.functions.graph import Rounds, components
from trackspark.schema import extended

from .overlap import box_pairs, tiled
from .tracks import TRACK, gaps, neighbours_in_time, track_ends, track_summary


def _distance(ax, ay, bx, by) -> Column:
    return F.sqrt(F.pow(F.col(ax) - F.col(bx), 2) + F.pow(F.col(ay) - F.col(by), 2))


def _ends(cells: DataFrame) -> DataFrame:
    return track_ends(cells.withColumn("x", (F.col("x1") + F.col("x2")) / 2).withColumn("y", (F.col("y1") + F.col("y2")) / 2), "x", "y", "area")


# -- gaps and divisions ---------------------------------------------------------------------------


def _around(df: DataFrame, x: str, y: str, tile: float) -> DataFrame:
    """Rows copied to the tile of their point and the eight around it: __tx, __ty."""
    near = F.sequence(F.lit(-1), F.lit(1))
    df = df.withColumn("__tx", F.explode(near)).withColumn("__ty", F.explode(near))
    return df.withColumn("__tx", F.floor(F.col(x) / tile) + F.col("__tx")).withColumn("__ty", F.floor(F.col(y) / tile) + F.col("__ty"))


def _in_tile(df: DataFrame, x: str, y: str, tile: float) -> DataFrame:
    return df.withColumn("__tx", F.floor(F.col(x) / tile)).withColumn("__ty", F.floor(F.col(y) / tile))


def gap_pairs(cells: DataFrame, max_gap: int, max_distance: float | None = None) -> DataFrame:
    """Track a ends 1 to ``max_gap`` frames before track b starts; score = distance times the larger
    of both area ratios (infinite where that is undefined). Ends are copied to the frames they may be
    joined with, so the join is on equal frames. All pairs of such ends are the result; in dense movies give
    ``max_distance``, which joins by tiles too and leaves out what is farther."""
    e = _ends(cells)
    a = e.select("dataset", F.col("track_id").alias("a"), F.col("last_x").alias("ax"), F.col("last_y").alias("ay"), F.col("last_area").alias("aa"), F.explode(F.sequence(F.col("end") + 1, F.col("end") + max_gap)).alias("start"))
    b = e.select("dataset", F.col("track_id").alias("b"), F.col("first_x").alias("bx"), F.col("first_y").alias("by"), F.col("first_area").alias("ba"), "start")
    rho = F.coalesce(F.greatest(F.try_divide("aa", "ba"), F.try_divide("ba", "aa")), F.lit(float("inf")))
    rho = F.when((F.col("aa") == 0) | (F.col("ba") == 0), float("inf")).otherwise(rho)
    d = _distance("ax", "ay", "bx", "by")
    if max_distance is None:
        pairs = a.join(b, ["dataset", "start"])
    else:
        pairs = _around(a, "ax", "ay", max_distance).join(_in_tile(b, "bx", "by", max_distance), ["dataset", "start", "__tx", "__ty"]).where(d <= max_distance)
    return pairs.select("dataset", "a", "b", F.when(d == 0, F.when(F.isnan(rho * 0), float("inf")).otherwise(0.0)).otherwise(d * rho).alias("score"))


def sister_pairs(cells: DataFrame, max_distance: float = 50, least_similarity: float = 0.7) -> DataFrame:
    """J9, first part of J8: tracks that start in one frame, at most 2 * max_distance apart and of similar
    size, matched one to one per frame, the most similar first (ties: the lowest ids).

    The greedy choice is made in rounds over all frames at once: pairs that are the best of both ends are
    taken, and their ends leave. That is what taking pairs in order gives."""
    e = _ends(cells).select("dataset", "start", "track_id", F.col("first_x").alias("x"), F.col("first_y").alias("y"), F.col("first_area").alias("area"))
    tile = 2 * max_distance
    other = e.select("dataset", "start", F.col("track_id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("area").alias("ba"))
    p = _in_tile(e, "x", "y", tile).join(_around(other, "bx", "by", tile), ["dataset", "start", "__tx", "__ty"]).where("track_id < b")
    p = p.select(
        "dataset", "start", F.col("track_id").alias("a"), "b", _distance("x", "y", "bx", "by").alias("distance"),
        (1 - F.try_divide(F.abs(F.col("area") - F.col("ba")), F.col("area") + F.col("ba"))).alias("similarity"),
        ((F.col("x") + F.col("bx")) / 2).alias("mx"), ((F.col("y") + F.col("by")) / 2).alias("my"),
    ).where((F.col("distance") <= 2 * max_distance) & (F.col("similarity") >= least_similarity))
    return greedy_pairs(p, ["dataset", "start"], "similarity")


def greedy_pairs(pairs: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Pairs (a, b) one to one per keys, the highest score first, ties by a, then b. Rounds are written to
    the shared folder, so lineage stays short."""
    t = Rounds(pairs.sparkSession)
    left, taken, k = t.write(pairs, "p0"), [], 0
    order = F.struct(F.col(score), -F.col("a"), -F.col("b"))
    while True:
        ends = left.select(*keys, F.col("a").alias("n"), order.alias("o")).union(left.select(*keys, F.col("b").alias("n"), order.alias("o")))
        top = ends.groupBy(*keys, "n").agg(F.max("o").alias("o"))
        ta, tb = (top.select(*keys, F.col("n").alias(s), F.col("o").alias(f"o{s}")) for s in "ab")
        chosen = left.join(ta, [*keys, "a"]).join(tb, [*keys, "b"]).where((order == F.col("oa")) & (order == F.col("ob"))).select(*pairs.columns)
        chosen = t.write(chosen, f"c{k}")
        if chosen.isEmpty():
            break
        taken.append(chosen)
        used = chosen.select(*keys, F.col("a").alias("n")).union(chosen.select(*keys, F.col("b").alias("n")))
        left = left.join(used.withColumnRenamed("n", "a"), [*keys, "a"], "left_anti").join(used.withColumnRenamed("n", "b"), [*keys, "b"], "left_anti")
        k += 1
        left = t.write(left, f"p{k}")
        t.drop(f"p{k - 1}")
    t.drop(f"p{k}")
    out = pairs.limit(0) if not taken else taken[0]
    for more in taken[1:]:
        out = out.union(more)
    return out


def division_triples(cells: DataFrame, max_distance: float = 75, least_similarity: float = 0.7) -> DataFrame:
    """Sister pairs and the track that ends a frame before and nearest to their middle, kept if that
    is nearer than 2 * max_distance less the sisters' distance. A parent beyond 2 * max_distance is never
    kept, so middles meet the ends of their tile and those around it."""
    s, tile = sister_pairs(cells, max_distance, least_similarity), 2 * max_distance
    e = _ends(cells).select("dataset", (F.col("end") + 1).alias("start"), F.col("track_id").alias("parent"), F.col("last_x").alias("px"), F.col("last_y").alias("py"))
    p = _in_tile(s, "mx", "my", tile).join(_around(e, "px", "py", tile), ["dataset", "start", "__tx", "__ty"]).withColumn("parent_distance", _distance("mx", "my", "px", "py"))
    top = p.groupBy("dataset", "start", "a", "b").agg(F.min(F.struct("parent_distance", "parent")).alias("t"), F.first("distance").alias("distance"), F.first("similarity").alias("similarity"))
    top = top.where(F.col("t.parent_distance") < 2 * max_distance - F.col("distance"))
    return top.select("dataset", "start", "t.parent", "a", "b", "distance", "similarity", "t.parent_distance")


def object_info(events: DataFrame, cells: DataFrame, *columns: str) -> DataFrame:
    """Attaches columns of the cell to event records by (dataset, timeframe, sc_id)."""
    keys = ["dataset", "timeframe", "sc_id"]
    return events.join(cells.select(*keys, *columns), keys)


# -- signals, files, candidates -------------------------------------------------------------------


def signals_to_cells(signals: DataFrame, cells: DataFrame, tile: int = 64, frames: int = 128) -> DataFrame:
    """Signals (dataset, sig_id, timeframe, x, y): the cell whose contour holds the point at the latest
    frame up to the signal's (then the lowest id). cells carry ``contour``.

    A signal meets the cells of its tile in its block of ``frames`` frames and the block before; those that none of
    them holds meet two blocks twice as wide that go on from there, and so on, so most never meet a movie's past.
    Wider blocks end at multiples of their width, so a signal meets again one block of the round before at most. The
    latest is a maximum, so partial results combine before the shuffle. ``cells`` are read in each round, so give a
    table that is cheap to read."""
    t = Rounds(signals.sparkSession)
    until = (F.col("timeframe").cast("long") + 1).alias("__until")  # the frames before this one are not searched yet
    s = signals.select("dataset", "sig_id", until, "x", "y", F.floor(F.col("x") / tile).alias("__tx"), F.floor(F.col("y") / tile).alias("__ty"))
    c = tiled(cells.select("dataset", "timeframe", "sc_id", "contour", "x1", "y1", "x2", "y2"), tile)
    left = t.write(s, "s0")
    first, width, k, found = cells.agg(F.min("timeframe")).first()[0], frames, 0, []
    end = left.agg(F.max("__until")).first()[0]
    box = F.col("x").between(F.col("x1"), F.col("x2")) & F.col("y").between(F.col("y1"), F.col("y2"))
    while first is not None and end is not None:
        block = F.floor((F.col("__until") - 1) / width)
        near = left.withColumn("__b", F.explode(F.array(block, block - 1)))
        hit = near.join(c.where(F.col("timeframe") < end).withColumn("__b", F.floor(F.col("timeframe") / width)), ["dataset", "__tx", "__ty", "__b"])
        hit = hit.where((F.col("timeframe") < F.col("__until")) & box).where(contains_point("contour", "x", "y"))
        top = hit.groupBy("dataset", "sig_id").agg(F.max(F.struct("timeframe", (-F.col("sc_id")).alias("m"))).alias("t")).select("dataset", "sig_id", "t.timeframe", (-F.col("t.m")).alias("sc_id"))
        found.append(t.write(top, f"f{k}"))
        left = left.withColumn("__until", (block - 1) * width).where(F.col("__until") > first)
        left = t.write(left.join(found[-1].select("dataset", "sig_id"), ["dataset", "sig_id"], "left_anti"), f"s{k + 1}")
        t.drop(f"s{k}")
        k, width, end = k + 1, 2 * width, left.agg(F.max("__until")).first()[0]
    t.drop(f"s{k}")
    out = signals.select("dataset", "sig_id", "timeframe", F.lit(None).cast(cells.schema["sc_id"].dataType).alias("sc_id")).limit(0)
    for f in found:
        out = f if f is found[0] else out.union(f)
    return out


def pair_files(seg: DataFrame, tra: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, t, path) of both kinds. Same t: exact. The others: t - 1, then t, then t + 1, only among
    track files without an exact match, which may serve several."""
    a, b = seg.withColumnRenamed("path", "seg_path"), tra.withColumnRenamed("path", "tra_path")
    exact = a.join(b, [*keys, "t"]).withColumn("match", F.lit("exact"))
    rest_a, rest_b = a.join(b.select(*keys, "t"), [*keys, "t"], "left_anti"), b.join(a.select(*keys, "t"), [*keys, "t"], "left_anti")
    tries = rest_a.withColumn("__k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("__t", F.col("t") + F.col("__k") - 1)
    hit = tries.join(rest_b.withColumnRenamed("t", "__t"), [*keys, "__t"])
    first = hit.groupBy(*keys, "t", "seg_path").agg(F.min_by("tra_path", "__k").alias("tra_path")).withColumn("match", F.lit("fuzzy"))
    return exact.select(*keys, "t", "seg_path", "tra_path", "match").union(first.select(*keys, "t", "seg_path", "tra_path", "match"))


def _alike(wanted: DataFrame, cells: DataFrame, threshold: float) -> DataFrame:
    """wanted (dataset, timeframe, track_id, sc_id, box): cells of that frame with a larger iomin."""
    w = wanted.withColumnRenamed("sc_id", "from_sc").withColumn("sc_id", F.struct("track_id", "from_sc"))
    p = box_pairs(w, cells, ["dataset", "timeframe"]).where(F.col("iomin") > threshold)
    return p.select("dataset", "timeframe", F.col("sc_a.track_id").alias("track_id"), F.col("sc_a.from_sc").alias("from_sc"), F.col("sc_b").alias("candidate")).where("from_sc <> candidate").distinct()


def candidates_at_gaps(cells: DataFrame, interval: int = 2, threshold: float = 0.5) -> DataFrame:
    """At frames a track misses: cells there that overlap the track's cell before (up to ``interval``
    frames back) or after (less than ``interval`` ahead)."""
    box = ["x1", "y1", "x2", "y2"]
    w = Window.partitionBy(*TRACK).orderBy("timeframe")
    row = F.struct("timeframe", "sc_id", *box)
    every = gaps(cells).select(*TRACK, "timeframe", F.lit(None).cast(cells.select(row).schema[0].dataType).alias("c")).unionByName(cells.select(*TRACK, "timeframe", row.alias("c")))
    prev = F.last("c", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    nxt = F.first("c", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    g = every.select(*TRACK, "timeframe", "c", prev.alias("p"), nxt.alias("n")).where("c IS NULL")
    near = g.select(*TRACK, "timeframe", F.when(F.col("timeframe") - F.col("p.timeframe") <= interval, F.col("p")).alias("p"), F.when(F.col("n.timeframe") - F.col("timeframe") < interval, F.col("n")).alias("n"))
    wanted = near.select(*TRACK, "timeframe", F.explode(F.array_compact(F.array("p", "n"))).alias("c")).select(*TRACK, "timeframe", "c.sc_id", *[f"c.{b}" for b in box])
    return _alike(wanted, cells, threshold)


def candidates_after_end(cells: DataFrame, interval: int = 2, threshold: float = 0.5) -> DataFrame:
    """Cells in the frames after a track's end that overlap its last cell."""
    last = track_ends(cells, "sc_id", "x1", "y1", "x2", "y2")
    wanted = last.select(*TRACK, F.explode(F.sequence(F.col("end") + 1, F.col("end") + interval)).alias("timeframe"), *[F.col(f"last_{c}").alias(c) for c in ("sc_id", "x1", "y1", "x2", "y2")])
    return _alike(wanted, cells, threshold)


def candidate_report(candidates: DataFrame, annotated: DataFrame, key: str) -> DataFrame:
    """Candidates in the annotated set, not in it, and the share of the set that they cover."""
    c, a = candidates.select(key).distinct(), annotated.select(key).distinct()
    both = c.withColumn("c", F.lit(1)).join(a.withColumn("a", F.lit(1)), key, "full")
    n = both.agg(F.count_if(F.col("c").isNotNull() & F.col("a").isNotNull()).alias("n_in"), F.count_if(F.col("a").isNull()).alias("n_not_in"), F.count("a").alias("n_annotated"))
    return n.withColumn("coverage", F.try_divide("n_in", "n_annotated"))


def resolve_multimaps(annotations: DataFrame, cells: DataFrame) -> DataFrame:
    """Annotations (id, multimap) with JSON maps of a source id to target ids: a row per target, with
    the track and frame of both cells. Text is parsed as JSON, never run."""
    m = annotations.select("id", F.explode(F.from_json("multimap", "map<string, array<bigint>>")).alias("map_from", "tos"))
    m = m.select("id", F.col("map_from").cast("bigint").alias("map_from"), F.explode("tos").alias("map_to"))
    side = lambda s: cells.select(F.col("sc_id").alias(f"map_{s}"), F.col("track_id").alias(f"{s}_track"), F.col("timeframe").alias(f"{s}_time"))
    return m.join(side("from"), "map_from").join(side("to"), "map_to")


def flag_known(cells: DataFrame, known: DataFrame, name: str = "is_mitosis") -> DataFrame:
    """Whether a cell's id is among the known ones."""
    k = known.select("sc_id").distinct().withColumn("__k", F.lit(True))
    return cells.join(k, "sc_id", "left").withColumn(name, F.col("__k").isNotNull()).drop("__k")


def keep_listed(df: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """J19."""
    return df.join(listed.select(key).distinct(), key, "left_semi")


def drop_listed(df: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """J19."""
    return df.join(listed.select(key).distinct(), key, "left_anti")


def with_paddings(cells: DataFrame, paddings: tuple[int, ...] = (10, 20, 50, 100)) -> DataFrame:
    """A row per padding option."""
    return cells.withColumn("padding", F.explode(F.array(*map(F.lit, paddings))))


def components_of_cells(cells: DataFrame, parts: DataFrame) -> DataFrame:
    """Organelles (component_id, parent_cell_id, organelle_type) per cell and type; cells without: null."""
    own = parts.groupBy("parent_cell_id", "organelle_type").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("component_id")).alias("components"))
    return cells.join(own, F.col("sc_id") == F.col("parent_cell_id"), "left").drop("parent_cell_id")


# -- assignment -----------------------------------------------------------------------------------


def link_costs(pairs: DataFrame, max_distance: float = 150, w_overlap: float = 1, w_distance: float = 1, w_size: float = 0.5) -> DataFrame:
    """Pairs (overlap, area_a, area_b, distance) with their cost; pairs farther apart are left out."""
    o, a, b = F.col("overlap"), F.col("area_a"), F.col("area_b")
    cost = w_overlap * (1 - (o / (2 * a) + o / (2 * b))) + w_distance * F.col("distance") / max_distance + w_size * F.abs(a - b) / F.greatest(a, b)
    return pairs.where(F.col("distance") <= max_distance).withColumn("cost", cost)


def optimal_links(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs (keys, a, b, cost) of longs; per keys the most pairs one to one, of these the least
    cost. Groups that share no end are solved apart: a frame falls into components of allowed pairs."""
    node = lambda side: F.xxhash64(*keys, F.lit(side), F.col(side))
    # an end that occurs once on both sides of its pair needs no solver
    na, nb = (F.count("*").over(Window.partitionBy(*keys, s)) for s in "ab")
    counted = pairs.select(*keys, "a", "b", "cost", na.alias("__na"), nb.alias("__nb"))
    alone = counted.where("__na = 1 AND __nb = 1").select(*keys, "a", "b", "cost")
    rest = counted.where("__na > 1 OR __nb > 1").select(*keys, "a", "b", "cost", node("a").alias("__u"), node("b").alias("__v"))
    roots = components(rest.select(F.col("__u").alias("a"), F.col("__v").alias("b")))
    rest = rest.join(roots, F.col("__u") == F.col("node")).select(*keys, "a", "b", "cost", "root")
    out = rest.drop("root").schema

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        i, a = pd.factorize(group["a"], sort=True)
        j, b = pd.factorize(group["b"], sort=True)
        cost, allowed = np.zeros((len(a), len(b))), np.zeros((len(a), len(b)), bool)
        cost[i, j], allowed[i, j] = group["cost"], True
        r, c = assign_allowed(cost, allowed)
        at = pd.MultiIndex.from_arrays([a[r], b[c]])
        return group.set_index(["a", "b"]).loc[at].reset_index(names=["a", "b"])[out.names]

    return alone.union(rest.groupBy("root").applyInPandas(solve, out))


def case_types(cases: DataFrame, strict_reference: bool = True) -> DataFrame:
    """Cases (n_in, n_missing: pieces found for the cell in view and for the missing one).

    With ``strict_reference`` several pieces of both count as P/A-US, which is tested first there."""
    i, m = F.col("n_in"), F.col("n_missing")
    both = (m > 1) & (i > 1)
    rule = F.when((i == 1) & (m > 1), "missing-US")
    if not strict_reference:
        rule = rule.when(both, "Both-US")
    rule = rule.when((m >= 1) & (i > 1), "P/A-US").when((m == 1) & (i == 1), "Both-correct").otherwise("Others")
    return cases.withColumn("case_type", rule)


def before_and_after(cells: DataFrame) -> DataFrame:
    """The cell before and after each one in its track."""
    w = Window.partitionBy(*TRACK).orderBy("timeframe")
    return neighbours_in_time(cells).withColumn("prev_sc", F.lag("sc_id").over(w)).withColumn("next_sc", F.lead("sc_id").over(w))


def spans(cells: DataFrame) -> DataFrame:
    return track_summary(cells).select(*TRACK, "start", "end")

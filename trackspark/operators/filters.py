"""Filters of frames, cells and tracks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackspark.functions.ranks import ranked

from .tracks import TRACK, track_summary


def subset_by_time(frames: DataFrame, lo: int, hi: int) -> DataFrame:
    """Frames in [lo, hi)."""
    return frames.where((F.col("timeframe") >= lo) & (F.col("timeframe") < hi))


def url_matches(url: str, exact: bool = False) -> Column:
    """Equal, or one contains the other."""
    u = F.col("url")
    return (u == url) if exact else (u.contains(url) | F.lit(url).contains(u))


def frame_by_url(frames: DataFrame, url: str, exact: bool = False, ignore_missing: bool = False) -> DataFrame:
    """The one frame of a url; several are an error, none too unless ``ignore_missing``."""
    hit = frames.where(url_matches(url, exact))
    found = hit.limit(2).count()
    if found > 1:
        raise ValueError(f"several frames match {url}")
    if not found and not ignore_missing:
        raise ValueError(f"no frame matches {url}")
    return hit


def tracks_in_time_span(cells: DataFrame, lo: int, hi: int, keep_track_id: bool = True) -> DataFrame:
    """Cells in [lo, hi]; empty tracks vanish. Without ``keep_track_id`` tracks are numbered from 0
    in order of id, tracks that vanish counted too. Numbers come from the table of tracks, not of cells."""
    cut = cells.where(F.col("timeframe").between(lo, hi))
    if keep_track_id:
        return cut
    ids = ranked(cells.select(*TRACK).distinct(), ["dataset"], ["track_id"], "__new")
    return cut.join(ids, TRACK).withColumn("track_id", F.col("__new")).drop("__new")


def subtracks(cells: DataFrame, cuts: DataFrame) -> DataFrame:
    """Cuts (dataset, track_id, lo, hi): each track cut to [lo, hi], missing or outer bounds clamped
    to its span. Adds at_start and at_end: whether the cut keeps the track's mothers and daughters."""
    spans = track_summary(cells).select(*TRACK, "start", "end")
    bounds = cuts.join(spans, TRACK).select(
        *TRACK,
        F.greatest(F.coalesce("lo", "start"), "start").alias("__lo"),
        F.least(F.coalesce("hi", "end"), "end").alias("__hi"),
        "start",
        "end",
    )
    return (
        cells.join(bounds, TRACK)
        .where(F.col("timeframe").between(F.col("__lo"), F.col("__hi")))
        .withColumn("at_start", F.col("__lo") == F.col("start"))
        .withColumn("at_end", F.col("__hi") == F.col("end"))
        .drop("__lo", "__hi", "start", "end")
    )


def subtrack_edges(lineage: DataFrame, cut: DataFrame) -> DataFrame:
    """Lineage edges that survive: a daughter's edge if its cut starts where the track does, and its
    mother's cut, if there is one, ends where that does."""
    ends = cut.groupBy("track_id").agg(F.max("at_start").alias("s"), F.max("at_end").alias("e"))
    d, m = ends.select(F.col("track_id").alias("daughter_id"), "s"), ends.select(F.col("track_id").alias("mother_id"), "e")
    return lineage.join(d, "daughter_id", "left").join(m, "mother_id", "left").where(F.coalesce("s", F.lit(True)) & F.coalesce("e", F.lit(True))).drop("s", "e")


def tracks_where(cells: DataFrame, condition: Column | Callable[[DataFrame], Column]) -> DataFrame:
    """Cells of tracks whose summary (A1) meets a condition."""
    kept = track_summary(cells).where(condition).select(*TRACK)
    return cells.join(kept, TRACK, "left_semi")


def tracks_by_length(cells: DataFrame, lo: int = 0, hi: int | None = None) -> DataFrame:
    """P5: cells of tracks with lo to hi cells."""
    c = F.col("length") >= lo
    return tracks_where(cells, c if hi is None else c & (F.col("length") <= hi))


def cells_by_area(cells: DataFrame, lo: float, hi: float, area: str = "area") -> DataFrame:
    """Area in [lo, hi]."""
    return cells.where(F.col(area).between(lo, hi))


def inner(dist: float, bounds: tuple[float, float, float, float], use_box_center: bool = False) -> Column:
    """The whole box strictly inside the bounds by ``dist``, or (if asked) its centre."""
    bx1, by1, bx2, by2 = bounds
    whole = (F.col("x1") > bx1 + dist) & (F.col("y1") > by1 + dist) & (F.col("x2") < bx2 - dist) & (F.col("y2") < by2 - dist)
    if not use_box_center:
        return whole
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    return whole | ((cx > bx1 + dist) & (cy > by1 + dist) & (cx < bx2 - dist) & (cy < by2 - dist))


def inner_cells(cells: DataFrame, dist: float, bounds: tuple[float, float, float, float], use_box_center: bool = False) -> DataFrame:
    """P8."""
    return cells.where(inner(dist, bounds, use_box_center))


def tracks_off_border(cells: DataFrame, dist: float, bounds: tuple[float, float, float, float], use_box_center: bool = False) -> DataFrame:
    """Tracks without a border cell at any frame."""
    touching = cells.where(~inner(dist, bounds, use_box_center)).select(*TRACK).distinct()
    return cells.join(touching, TRACK, "left_anti")


def border_objects(cells: DataFrame, h: int, w: int) -> DataFrame:
    """P10: boxes that touch the image edge."""
    return cells.where((F.col("x1") <= 0) | (F.col("y1") <= 0) | (F.col("x2") >= h) | (F.col("y2") >= w))


def drop_nan_coordinates(cells: DataFrame, *columns: str) -> DataFrame:
    """Neither null nor NaN."""
    for c in columns:
        cells = cells.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    return cells


# Short label texts and their names.
LABEL_NAMES = {"od": "overseg_dropout", "o": "overseg", "u": "underseg", "c": "correct", "d": "discard"}


def standard_label(column: Column, names: dict[str, str] = LABEL_NAMES) -> Column:
    """Full names of short label texts; null: unknown; anything else is an error."""
    out = F.when(column.isNull(), "unknown")
    for short, full in names.items():
        out = out.when(column == short, full)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown label: "), column)))


# Tested in this order.
SUBDIR_CLASSES = [("dropout", "dropout"), ("overseg", "overseg"), ("underseg", "underseg"), ("correct", "correct")]


def class_from_subdir(column: Column, classes: list[tuple[str, str]] = SUBDIR_CLASSES) -> Column:
    """Class from a sub-directory name, the first that it contains; none is an error."""
    out = F.when(F.lit(False), "")
    for part, label in classes:
        out = out.when(column.contains(part), label)
    return out.otherwise(F.raise_error(F.concat(F.lit("no class in: "), column)))


def manifest_by_source(manifest: DataFrame, contains: str | None = None, equals: str | None = None, column: str = "subdir") -> DataFrame:
    """P15."""
    if equals is not None:
        manifest = manifest.where(F.col(column) == equals)
    return manifest if contains is None else manifest.where(F.col(column).contains(contains))


def keep_tracks(cells: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids (dataset, track_id). Spark broadcasts them if their size is below its threshold."""
    return cells.join(ids.select(*TRACK).distinct(), TRACK, "left_semi")


def delete_tracks(cells: DataFrame, ids: DataFrame) -> DataFrame:
    """P17."""
    return cells.join(ids.select(*TRACK).distinct(), TRACK, "left_anti")

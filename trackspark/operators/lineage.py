"""Lineage: trees of divisions held as edges (mother_id, daughter_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackspark.functions.graph import Rounds


def division_edges(divisions: DataFrame) -> DataFrame:
    """Divisions (mother_traj_label, sis1_traj_label, sis2_traj_label) as edges; -1 stands for no track."""
    e = divisions.select(F.col("mother_traj_label").alias("mother_id"), F.explode(F.array("sis1_traj_label", "sis2_traj_label")).alias("daughter_id"))
    return e.where("daughter_id <> -1 AND mother_id <> -1")


def mothers(tracks: DataFrame, lineage: DataFrame) -> DataFrame:
    """G1: each track's mother, null if it has none, and whether it is a daughter."""
    e = lineage.select("mother_id", F.col("daughter_id").alias("track_id"))
    return tracks.select("track_id").distinct().join(e, "track_id", "left").withColumn("is_daughter", F.col("mother_id").isNotNull())


def descendants(lineage: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(root_id, track_id, depth) of all descendants, however deep; with ``max_depth`` a deeper tree is an
    error. One join per generation and one against all that was found before, which a cycle meets again.
    Generations are written to one table in the shared folder."""
    t = Rounds(lineage.sparkSession)
    e = lineage.where("daughter_id <> -1").select("mother_id", "daughter_id")
    now = t.write(roots.select(F.col("track_id").alias("root_id"), "track_id", F.lit(0).alias("depth")).distinct(), "found/g=0")
    depth, found = 0, now
    while True:
        depth += 1
        new = now.join(e, F.col("track_id") == F.col("mother_id")).select("root_id", F.col("daughter_id").alias("track_id"), F.lit(depth).alias("depth")).distinct()
        new = new.join(found.select("root_id", "track_id"), ["root_id", "track_id"], "left_anti").select("root_id", "track_id", "depth")
        now = t.write(new, f"found/g={depth}")
        if now.isEmpty():
            return found.where("depth > 0")
        if max_depth is not None and depth > max_depth:
            raise ValueError(f"lineage is deeper than {max_depth} generations")
        found = lineage.sparkSession.read.schema(now.schema).parquet(f"{t.root}/found").drop("g")


def lineage_paths(spark, lineage: DataFrame, root: int | None = None, max_rounds: int = 40) -> DataFrame:
    """Every path from ``root`` (None: from every node without a mother) to a leaf, as arrays.

    Every edge is a path; in each round a path whose top has a mother is lengthened by all paths that end at its
    top, so that lengths double and a tree of depth d takes log2(d) rounds, each a written table. Paths that meet
    themselves are dropped: on a cycle nothing ends. A root without daughters is a path of its own."""
    t = Rounds(spark)
    e = lineage.where("mother_id IS NOT NULL AND daughter_id IS NOT NULL").select(F.col("mother_id").cast("long").alias("m"), F.col("daughter_id").cast("long").alias("d")).distinct()
    if root is not None:
        e = e.where(F.col("d") != int(root))  # the walk starts there
    e = t.write(e.where("m <> d"), "edges")
    born = e.select(F.col("d").alias("top")).distinct()
    now = e.select(F.col("m").alias("top"), F.col("d").alias("end"), F.array("m", "d").alias("path"))
    open_ = lambda paths: paths.join(born, "top", "left_semi")
    done, k = t.write(now.join(born, "top", "left_anti"), "done/k=0"), 0
    going = t.write(open_(now), "going0")
    while not going.isEmpty():
        k += 1
        if k > max_rounds:
            raise RuntimeError(f"paths did not end in {max_rounds} rounds")
        upper = done.select("top", "end", "path").union(going.select("top", "end", "path")).toDF("top", "mid", "upper")
        longer = going.select(F.col("top").alias("mid"), "end", F.slice("path", 2, F.size("path")).alias("lower")).join(upper, "mid")
        longer = longer.where(~F.arrays_overlap("upper", "lower")).select("top", "end", F.concat("upper", "lower").alias("path"))
        longer = t.write(longer, f"longer{k}")
        t.write(longer.join(born, "top", "left_anti"), f"done/k={k}")
        done = spark.read.schema(longer.schema).parquet(f"{t.root}/done")
        going = t.write(open_(longer), f"going{k}")
        t.drop(f"longer{k}")
        t.drop(f"going{k - 1}")
    leaves = done.join(e.select(F.col("m").alias("end")).distinct(), "end", "left_anti")
    if root is None:
        return leaves.select("path")
    alone = spark.range(1).select(F.array(F.lit(int(root)).cast("long")).alias("path"), F.lit(int(root)).cast("long").alias("m")).join(e.select("m").distinct(), "m", "left_anti")
    return leaves.where(F.col("top") == int(root)).select("path").union(alone.select("path"))


def wrong_divisions(divisions: DataFrame, mature_time: int) -> DataFrame:
    """Divisions (mother_id, frame, daughters array) that stay: the mother has one record only, and was
    not born by a division within ``mature_time`` frames before."""
    n = F.count("*").over(Window.partitionBy("mother_id"))
    one = divisions.withColumn("__n", n).where("__n = 1").drop("__n")
    births = one.select(F.explode("daughters").alias("mother_id"), F.col("frame").alias("born"))
    early = one.join(births, "mother_id").where(F.col("frame") - F.col("born") < mature_time).select("mother_id").distinct()
    return one.join(early, "mother_id", "left_anti")


def with_family(tracks: DataFrame, lineage: DataFrame) -> DataFrame:
    """Each track with the sorted arrays of its mothers and daughters."""
    m = lineage.groupBy(F.col("daughter_id").alias("track_id")).agg(F.sort_array(F.collect_set("mother_id")).alias("mothers"))
    d = lineage.groupBy(F.col("mother_id").alias("track_id")).agg(F.sort_array(F.collect_set("daughter_id")).alias("daughters"))
    none = F.array().cast("array<bigint>")
    out = tracks.select("track_id").distinct().join(m, "track_id", "left").join(d, "track_id", "left")
    return out.withColumn("mothers", F.coalesce("mothers", none)).withColumn("daughters", F.coalesce("daughters", none))

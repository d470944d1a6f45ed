"""Queries over readers and writers, names and streams (S, F14 to F16, F22, T)."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackspark.functions import names as nm
from trackspark.functions.graph import shared_folder
from trackspark.operators.tracks import last_write_wins
from trackspark.sources import io
from trackspark.streaming import live

from .adapters import cells, manifest, table
from .base import live_sql, query
from .overlap_queries import moving


def folder(s) -> str:
    return f"{shared_folder(s)}/trackspark/{uuid.uuid4().hex}"


def full_cells(s, d):
    """cells with a contour and a meta entry."""
    p = lambda a, b: F.array(F.col(a).cast("double"), F.col(b).cast("double"))
    return cells(s, d).withColumn("contour", F.array(p("x1", "y1"), p("x1", "y2"), p("x2", "y2"))).withColumn("meta", F.create_map(F.lit("status"), F.col("status")))


@query("s1_frame_manifest", "SELECT k AS dataset, CAST(row_number() OVER (PARTITION BY k ORDER BY url) - 1 AS INTEGER) AS timeframe, url FROM (SELECT timeframe % 5 AS k, url FROM manifest) QUALIFY row_number() OVER (PARTITION BY k ORDER BY url) <= 20")
def s1(s, d):
    return io.frame_manifest(manifest(s, d).selectExpr("timeframe % 5 AS dataset", "url AS path"), 20)


@query("s2_manifest_json", "SELECT 'c' || timeframe % 3 AS name, CAST(timeframe AS INTEGER) AS timeframe, url FROM manifest")
def s2(s, d):
    at = folder(s)
    io.write_manifest_json(manifest(s, d).selectExpr("concat('c', timeframe % 3) AS name", "timeframe", "url"), at)
    return io.read_manifest_json(s, at, multi_line=False)


@query("s3_s4_cells_json", "SELECT CAST(sc_id AS VARCHAR) AS sc_id, track_id, timeframe, CAST(x1 AS DOUBLE) AS x1, CAST(y2 AS DOUBLE) AS y2, status FROM cells")
def s3(s, d):
    at = folder(s)
    io.write_cells_json(full_cells(s, d), at)
    c = io.read_cells_json(s, at, multi_line=False)
    return c.select("sc_id", "track_id", "timeframe", "bbox.x1", "bbox.y2", F.col("meta")["status"].alias("status"))


@query(
    "s5_s6_tracks_json",
    "SELECT CAST(dataset AS VARCHAR) AS dataset, CAST(sc_id AS VARCHAR) AS sc_id, track_id % 7 AS track_id, timeframe, CAST(x2 AS DOUBLE) AS last_row, CAST(track_id % 7 AS VARCHAR) || '>' || dataset AS mother FROM cells QUALIFY row_number() OVER (PARTITION BY dataset, track_id % 7, timeframe ORDER BY sc_id DESC) = 1",
)
def s5(s, d):
    """Tracks of equal number in several movies, with a mother each."""
    from trackspark.schema import stored

    at = folder(s)
    c = last_write_wins(full_cells(s, d).withColumn("track_id", F.col("track_id") % 7)).withColumn("dataset", F.col("dataset").cast("string"))
    tracks = c.select("dataset", "track_id").distinct().withColumn("meta", F.create_map(F.lit("mother"), F.concat_ws(">", F.col("track_id").cast("string"), "dataset")))
    io.write_tracks_json(stored(c), at, tracks)
    c = io.read_track_lines(s, at)
    return c.select("dataset", "sc_id", "track_id", "timeframe", F.get(F.get("contour", F.lit(2)), F.lit(0)).alias("last_row"), F.col("track_meta")["mother"].alias("mother"))


@query("s7_coco", "SELECT sc_id, CAST(timeframe AS INTEGER) AS timeframe, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x2 + 1 AS DOUBLE) AS x2, CAST(y2 + 1 AS DOUBLE) AS y2 FROM cells")
def s7(s, d):
    c = cells(s, d).selectExpr("sc_id", "timeframe", *[f"CAST({k} AS DOUBLE) AS {k}" for k in ("x1", "y1", "x2", "y2")])
    a = c.select(F.struct(
        F.col("sc_id").alias("id"), F.col("timeframe").cast("long").alias("image_id"), F.lit(1).cast("long").alias("category_id"),
        F.array(F.col("y1"), F.col("x1"), F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")).alias("bbox"),
        F.array(F.array("y1", "x1", "y2", "x1", "y2", "x2")).alias("segmentation"),
    ).alias("a"))
    i = c.select("timeframe").distinct().select(F.struct(F.col("timeframe").cast("long").alias("id"), F.concat(F.lit("f"), "timeframe").alias("file_name")).alias("i"))
    one = lambda df, k: df.select(F.array(k).alias(k))
    coco = one(a, "a").selectExpr("a AS annotations", "CAST(NULL AS ARRAY<STRUCT<id: BIGINT, file_name: STRING>>) AS images").unionByName(
        one(i, "i").selectExpr("CAST(NULL AS " + a.select(F.array("a").alias("a")).schema["a"].dataType.simpleString() + ") AS annotations", "i AS images")
    )
    return io.coco_cells(coco).select("sc_id", "timeframe", "x1", "y1", "x2", "y2")


@query("s8_labelme", "SELECT sc_id AS image_id, status AS label, CAST(x1 AS DOUBLE) AS x, CAST(x2 - x1 AS DOUBLE) AS w FROM cells")
def s8(s, d):
    p = lambda a, b: F.array(F.col(a).cast("double"), F.col(b).cast("double"))
    f = cells(s, d).select(
        F.format_string("/data/%d.json", "sc_id").alias("path"),
        F.array(F.struct(F.col("status").alias("label"), F.lit("rectangle").alias("shape_type"), F.array(p("x1", "y1"), p("x2", "y2")).alias("points"))).alias("shapes"),
    )
    return io.labelme_rows(f).select("image_id", "label", F.get("bbox", F.lit(0)).alias("x"), F.get("bbox", F.lit(2)).alias("w"))


def nested_lineage(s, d):
    """A file for each movie: its n tracks, numbered from 0, are cells of a tree; the daughters of k are 2 k + 1 and
    2 k + 2. Tags stand in an order of keys: a cell's own tags sort before its daughters' and its end after them."""
    k = F.col("k")
    tracks = cells(s, d).groupBy("dataset", "track_id").agg(F.sort_array(F.collect_list(F.struct("timeframe", "x1", "y1"))).alias("ss"))
    movie = Window.partitionBy("dataset")
    tracks = tracks.withColumn("k", F.row_number().over(movie.orderBy("track_id")) - 1).withColumn("n", F.count("*").over(movie))
    spots = F.array_join(F.transform("ss", lambda c: F.format_string('<s i="%d" x="%d" y="%d" s="0"/>', c["timeframe"], c["x1"], c["y1"])), "")
    mother = 2 * k + 1 < F.col("n")
    tag = lambda after, text: F.struct(F.concat(F.conv((k + 1).cast("string"), 10, 2), F.lit(after)).alias("key"), text.alias("tag"))
    tags = F.array(
        tag(" ", F.concat(F.format_string('<a id="%d" brush="b%d" type="0">', "track_id", F.col("track_id") % 3), F.lit("<ss>"), spots, F.lit("</ss>"))),
        tag("!", F.when(mother, F.lit("<as>"))), tag(":", F.when(mother, F.lit("</as>"))), tag("~", F.lit("</a>")),
    )
    one = tracks.select("dataset", F.explode(tags).alias("t")).where("t.tag IS NOT NULL").groupBy("dataset").agg(F.sort_array(F.collect_list("t")).alias("t"))
    at = folder(s)
    whole = F.concat(F.format_string('<fs><f id="%d"><as>\n', "dataset"), F.array_join(F.transform("t", lambda x: x["tag"]), "\n"), F.lit("\n</as></f></fs>"))
    one.select(whole.alias("value"), "dataset").write.partitionBy("dataset").text(at)
    return io.read_lineage_xml(s, at)


@query("s9_lineage_xml", "SELECT dataset AS field, track_id AS cell, 'b' || track_id % 3 AS colour, timeframe, CAST(x1 AS DOUBLE) AS x, CAST(y1 AS DOUBLE) AS y, CAST(0 AS INTEGER) AS status FROM cells")
def s9(s, d):
    return nested_lineage(s, d)[0].select("field", "cell", "colour", "timeframe", "x", "y", "status")


@query(
    "s9_divisions",
    """WITH k AS (SELECT dataset, track_id, row_number() OVER (PARTITION BY dataset ORDER BY track_id) - 1 AS k FROM (SELECT DISTINCT dataset, track_id FROM cells))
    SELECT m.dataset AS field, m.track_id AS mother, count(*) AS n, CASE WHEN count(*) = 2 THEN min(d.track_id) END AS first, CASE WHEN count(*) = 2 THEN max(d.track_id) END AS second
    FROM k m JOIN k d ON m.dataset = d.dataset AND (d.k - 1) // 2 = m.k AND d.k > 0 GROUP BY ALL""",
)
def s9_divisions(s, d):
    out = nested_lineage(s, d)[1]
    return out.selectExpr("field", "mother", "CAST(if(size(daughters) = 2, 2, 1) AS BIGINT) AS n", "get(daughters, 0) AS first", "get(daughters, 1) AS second")


@query("s10_s11_class_clips", "SELECT status AS class, CAST(sc_id AS VARCHAR) AS sc_id FROM cells WHERE status IN ('error', 'signup')")
def s10(s, d):
    from trackspark.schema import stored

    at = folder(s)
    c = stored(cells(s, d).withColumn("meta", F.create_map(F.lit("class"), F.col("status"))))
    io.write_class_clips(c.withColumn("class", F.col("meta")["class"]), at)
    return io.read_class_clips(s, at, ["error", "signup"]).select("class", "sc_id")


@query("s12_csv_manifests", "SELECT timeframe AS id, url, 'part=' || timeframe % 4 AS subdir FROM manifest")
def s12(s, d):
    at = folder(s)
    manifest(s, d).selectExpr("timeframe AS id", "url", "timeframe % 4 AS part").write.partitionBy("part").option("header", True).csv(at)
    return io.read_csv_manifests(s, at, "id BIGINT, url STRING")


@query("s13_experiment_logs", "SELECT 'random' AS strategy_name, CAST(track_id % 3 AS INTEGER) AS run_id, timeframe AS iteration, area AS test_iou FROM cells")
def s13(s, d):
    at = folder(s)
    for run in range(3):
        cells(s, d).where(f"track_id % 3 = {run}").select(F.col("timeframe").alias("iteration"), F.col("area").alias("test_iou")).write.option("header", True).csv(f"{at}/random_run{run}/ctc_seg_x")
    return io.read_experiment_logs(s, at, "iteration INT, test_iou DOUBLE", "part-").select("strategy_name", "run_id", "iteration", "test_iou")


@query("s14_lists", "SELECT url AS path, CAST(timeframe % 2 AS INTEGER) AS label FROM manifest")
def s14(s, d):
    at = folder(s)
    io.write_list(manifest(s, d).selectExpr("url AS path", "timeframe % 2 AS label"), at)
    return io.read_list(s, at)


@query("f14_time_points", "SELECT sc_id, CAST(sc_id % 1000 AS INTEGER) AS t FROM cells")
def f14(s, d):
    forms = F.array(*[F.format_string(f"/a/b/{p}%03d.tif", F.col("sc_id") % 1000) for p in ("man_seg", "t", "track_", "mask", "seg_x")])
    return cells(s, d).select("sc_id", nm.time_point(F.get(forms, (F.col("sc_id") % 5).cast("int"))).alias("t"))


@query("f15_origin_names", "SELECT sc_id, 'HELA-0' || dataset || '-T' || lpad(CAST(timeframe AS VARCHAR), 3, '0') AS origin FROM cells")
def f15(s, d):
    return cells(s, d).select("sc_id", nm.origin_name(F.lit("hela"), F.concat(F.lit("0"), F.col("dataset").cast("string")), F.col("timeframe")).alias("origin"))


@query("f16_last_parts", "SELECT timeframe, array_to_string(list_slice(string_split(url, '/'), greatest(len(string_split(url, '/')) - 2, 1), len(string_split(url, '/'))), '/') AS tail FROM manifest")
def f16(s, d):
    return manifest(s, d).select("timeframe", nm.last_parts(F.replace("url", F.lit("/"), F.lit("\\"))).alias("tail"))


@query("f22_json", "SELECT '{\"sc_id\":' || sc_id || ',\"box\":[' || x1 || ',' || y1 || ']}' AS j FROM cells")
def f22(s, d):
    return cells(s, d).withColumn("box", F.array("x1", "y1")).select(nm.as_json("sc_id", "box").alias("j"))


def detections(s, d):
    return table(s, d, "events").selectExpr(
        "CAST(ts AS TIMESTAMP) AS ts", "user_id div 30 AS dataset", "user_id AS track_id", "CAST(timestampdiff(HOUR, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) AS INT) AS timeframe", "event_id AS sc_id",
        *[f"CAST({e} AS DOUBLE) AS {k}" for k, e in (("x1", "user_id * 37 % 960"), ("y1", "user_id * 91 % 960"), ("x2", "user_id * 37 % 960 + 20"), ("y2", "user_id * 91 % 960 + 20"))],
    )


def one_each(s, d):
    """One detection per track and frame, in boxes that stay with their track and meet no other of the movie."""
    return last_write_wins(detections(s, d)).drop("track_id")


def replay(s, at, rows, wait="1 minute", dataset="min(dataset)", silence=None, **options):
    """A table of detections as new files of a stream, through the live tracker: all rows so far."""
    live.closed(rows, wait, dataset).write.mode("append").parquet(f"{at}/in")
    stream = s.readStream.schema(rows.schema).parquet(f"{at}/in")
    return live.run_to_table(live.live_tracks(stream, "1 minute", min_hits=1, silence=silence, **options), "t" + uuid.uuid4().hex, f"{at}/checkpoint")


@query("t1_live_tracks", live_sql(30, "'cell', 'end'"))
def t1(s, d):
    """events as a stream of detections, through the live tracker."""
    return replay(s, folder(s), one_each(s, d), max_age=30)


@query("t2_late_frames", live_sql(30, "'cell'", "track_id % 7 <> 0"))
def t2(s, d):
    """Every seventh track's detections arrive once the watermark has passed all others: they change nothing."""
    at, rows = folder(s), last_write_wins(detections(s, d))
    replay(s, at, rows.where("track_id % 7 <> 0").drop("track_id"), max_age=30)
    return replay(s, at, rows.where("track_id % 7 = 0").drop("track_id"), max_age=30).where("kind = 'cell'")


@query("t3_expired_tracks", live_sql(5, "'end'"))
def t3(s, d):
    """Tracks that ended, with the number of their cells."""
    return replay(s, folder(s), one_each(s, d), max_age=5).where("kind = 'end'")


@query("t3_silent_movies", live_sql(5, "'end'", silent=True))
def t3_silent(s, d):
    """The watermark passes every movie by more than a day: all tracks end, also those that no later frame ends."""
    return replay(s, folder(s), one_each(s, d), "2 days", "-1", "1 day", max_age=5).where("kind = 'end'")


@query("t1_moving_boxes")
def t1_moving(s, d):
    """Boxes that move and meet, half a day a frame, through the live tracker."""
    rows = moving(s, d).drop("track_id").withColumn("ts", F.timestamp_seconds(1_704_067_200 + F.col("timeframe") * 43_200))
    rows = rows.select("ts", "dataset", "timeframe", "sc_id", *[F.col(k).cast("double").alias(k) for k in ("x1", "y1", "x2", "y2")])
    return replay(s, folder(s), rows, "2 days", max_age=3).where("kind = 'cell'").select("dataset", "timeframe", "sc_id", "track_id")


@query("t4_window_counts", "SELECT time_bucket(INTERVAL '1 day', ts) AS \"start\", user_id // 30 AS dataset, count(*) AS n_cells FROM events GROUP BY ALL")
def t4(s, d):
    w = live.window_counts(detections(s, d), "1 day")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "dataset", "n_cells")


@query(
    "t4_sessions",
    "WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '8 hours' THEN 1 ELSE 0 END AS new FROM events), k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id AS track_id, min(ts) AS \"start\", count(*) AS n_cells FROM k GROUP BY user_id, k.k",
)
def t4_sessions(s, d):
    w = live.activity_sessions(detections(s, d), "8 hours")
    return w.select("track_id", F.col("start").cast("timestamp_ntz").alias("start"), "n_cells")

"""Queries over cells and tracks (P, A1 to A8, W, U, O1, G15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackspark.functions.graph import components
from trackspark.operators import filters as fl
from trackspark.operators import tracks as tr

from .adapters import cells, clips, lineage, manifest, raw_cells, table
from .base import query

BOUNDS = (0, 0, 1000, 1000)
PLAIN = ["dataset", "track_id", "timeframe", "sc_id"]
IN = "x1 > 30 AND y1 > 30 AND x2 < 970 AND y2 < 970"
CENTRE = "(x1 + x2) / 2 > 30 AND (y1 + y2) / 2 > 30 AND (x1 + x2) / 2 < 970 AND (y1 + y2) / 2 < 970"


def r(*names):
    return [F.round(n, 6).alias(n) for n in names]


@query("p1_time_range", "SELECT timeframe, url FROM manifest WHERE timeframe >= 10 AND timeframe < 100")
def p1(s, d):
    return fl.subset_by_time(manifest(s, d), 10, 100).select("timeframe", "url")


@query("p2_url_lookup", "SELECT timeframe, url FROM manifest WHERE contains(url, '/en/') OR contains('/en/', url)")
def p2(s, d):
    return manifest(s, d).where(fl.url_matches("/en/")).select("timeframe", "url")


@query(
    "p3_time_span",
    "SELECT dataset, k AS track_id, timeframe, sc_id FROM cells JOIN (SELECT dataset, track_id, row_number() OVER (PARTITION BY dataset ORDER BY track_id) - 1 AS k FROM tracks) USING (dataset, track_id) WHERE timeframe BETWEEN 100 AND 300",
)
def p3(s, d):
    return fl.tracks_in_time_span(cells(s, d), 100, 300, keep_track_id=False).select(*PLAIN)


@query(
    "p4_subtracks",
    """SELECT c.dataset, c.track_id, c.timeframe, c.sc_id, greatest(50 + track_id % 7, "start") = "start" AS at_start, least(400, "end") = "end" AS at_end
    FROM cells c JOIN tracks t USING (dataset, track_id) WHERE timeframe BETWEEN greatest(50 + track_id % 7, "start") AND least(400, "end")""",
)
def p4(s, d):
    c = cells(s, d)
    cuts = c.select(*tr.TRACK).distinct().select(*tr.TRACK, (F.col("track_id") % 7 + 50).alias("lo"), F.lit(400).alias("hi"))
    return fl.subtracks(c, cuts).select(*PLAIN, "at_start", "at_end")


@query("p5_track_length", "SELECT dataset, track_id, timeframe, sc_id FROM cells JOIN tracks USING (dataset, track_id) WHERE length BETWEEN 5 AND 64")
def p5(s, d):
    return fl.tracks_by_length(cells(s, d), 5, 64).select(*PLAIN)


@query("p6_track_predicate", "SELECT dataset, track_id, timeframe, sc_id FROM cells JOIN tracks USING (dataset, track_id) WHERE vacancy < 0.91 AND span > 10")
def p6(s, d):
    return fl.tracks_where(cells(s, d), (F.col("vacancy") < 0.91) & (F.col("span") > 10)).select(*PLAIN)


@query("p7_area", "SELECT dataset, track_id, timeframe, sc_id, area FROM cells WHERE area BETWEEN 5 AND 25")
def p7(s, d):
    return fl.cells_by_area(cells(s, d), 5, 25).select(*PLAIN, "area")


@query("p8_inner_cells", f"SELECT dataset, track_id, timeframe, sc_id FROM cells WHERE {IN}")
def p8(s, d):
    return fl.inner_cells(cells(s, d), 30, BOUNDS).select(*PLAIN)


@query("p8_inner_centres", f"SELECT dataset, track_id, timeframe, sc_id FROM cells WHERE ({IN}) OR ({CENTRE})")
def p8_centres(s, d):
    return fl.inner_cells(cells(s, d), 30, BOUNDS, use_box_center=True).select(*PLAIN)


@query("p9_tracks_off_border", "SELECT dataset, track_id, timeframe, sc_id FROM cells WHERE (dataset, track_id) NOT IN (SELECT (dataset, track_id) FROM cells WHERE NOT (x1 > -1 AND y1 > -1 AND x2 < 985 AND y2 < 985))")
def p9(s, d):
    return fl.tracks_off_border(cells(s, d), -1, (0, 0, 984, 984)).select(*PLAIN)


@query("p10_border_objects", "SELECT dataset, track_id, timeframe, sc_id FROM cells WHERE x1 <= 0 OR y1 <= 0 OR x2 >= 980 OR y2 >= 980")
def p10(s, d):
    return fl.border_objects(cells(s, d), 980, 980).select(*PLAIN)


@query("p11_drop_nan", "SELECT sc_id, q FROM (SELECT sc_id, CASE WHEN sc_id % 5 = 0 THEN NULL ELSE area END AS q FROM raw_cells WHERE sc_id % 7 <> 0) WHERE q IS NOT NULL")
def p11(s, d):
    q = F.when(F.col("sc_id") % 7 == 0, float("nan")).when(F.col("sc_id") % 5 != 0, F.col("area"))
    return fl.drop_nan_coordinates(raw_cells(s, d).select("sc_id", q.alias("q")), "q")


@query("p12_region_area", "SELECT image, label_a, n FROM (SELECT image, label_a, count(*) AS n FROM upixels WHERE label_a > 0 GROUP BY ALL) WHERE n BETWEEN 10 AND 60")
def p12(s, d):
    from .adapters import unique_pixels

    regions = unique_pixels(s, d).where("label_a > 0").groupBy("image", "label_a").agg(F.count("*").alias("n"))
    return fl.cells_by_area(regions, 10, 60, "n")


@query(
    "p13_label_names",
    "SELECT doc_id, CASE lang WHEN 'en' THEN 'overseg_dropout' WHEN 'fr' THEN 'overseg' WHEN 'de' THEN 'underseg' WHEN 'es' THEN 'correct' END AS label FROM documents",
)
def p13(s, d):
    short = F.element_at(F.create_map(*[F.lit(x) for k in (("en", "od"), ("fr", "o"), ("de", "u"), ("es", "c")) for x in k]), F.col("lang"))
    return table(s, d, "documents").select("doc_id", fl.standard_label(short).alias("label"))


@query(
    "p14_subdir_class",
    "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'dropout' WHEN 1 THEN 'overseg' WHEN 2 THEN 'underseg' ELSE 'correct' END AS ou_aux FROM documents",
)
def p14(s, d):
    subdir = F.get(F.array(*map(F.lit, ("run-overseg-dropout", "real-overseg", "synthetic-underseg", "correct-1"))), (F.col("doc_id") % 4).cast("int"))
    return table(s, d, "documents").select("doc_id", fl.class_from_subdir(subdir).alias("ou_aux"))


@query("p15_manifest_source", "SELECT doc_id FROM documents WHERE contains(source, '1') AND lang = 'en'")
def p15(s, d):
    return fl.manifest_by_source(fl.manifest_by_source(table(s, d, "documents"), contains="1", column="source"), equals="en", column="lang").select("doc_id")


@query("p16_columns", "SELECT user_id AS track_id, event_id AS sc_id FROM events")
def p16(s, d):
    from trackspark.schema import check_columns

    e = table(s, d, "events").select("user_id", "event_id")
    return check_columns(e, ["track_id", "sc_id"], {"user_id": "track_id", "event_id": "sc_id"})


@query("p17_keep_delete", "SELECT dataset, track_id, timeframe, sc_id FROM cells WHERE track_id % 3 = 0 AND track_id % 2 <> 0")
def p17(s, d):
    c = cells(s, d)
    ids = c.select(*tr.TRACK).distinct()
    return fl.delete_tracks(fl.keep_tracks(c, ids.where("track_id % 3 = 0")), ids.where("track_id % 2 = 0")).select(*PLAIN)


@query("a1_track_summary", 'SELECT dataset, track_id, length, "start", "end", span, missing, round(vacancy, 6) AS vacancy FROM tracks')
def a1(s, d):
    return tr.track_summary(cells(s, d)).withColumn("vacancy", F.round("vacancy", 6))


@query("a2_missing_rate", "SELECT count(*) AS n_tracks, round(avg(1 - length / CAST(span AS DOUBLE)), 6) AS mean_missing_rate FROM tracks")
def a2(s, d):
    return tr.mean_missing_rate(cells(s, d)).select("n_tracks", *r("mean_missing_rate"))


@query("a3_time_span", 'SELECT min(timeframe) AS "start", max(timeframe) AS "end" FROM cells')
def a3(s, d):
    return tr.time_span(cells(s, d))


@query(
    "a4_gaps",
    """SELECT dataset, track_id, CAST(t AS INTEGER) AS timeframe FROM tracks, unnest(range("start", "end" + 1)) u(t)
    WHERE (dataset, track_id, t) NOT IN (SELECT (dataset, track_id, timeframe) FROM cells)""",
)
def a4(s, d):
    return tr.gaps(cells(s, d))


@query("a5_non_empty_tracks", "SELECT dataset, track_id, timeframe, sc_id FROM cells WHERE (dataset, track_id) IN (SELECT (dataset, track_id) FROM cells WHERE status = 'signup')")
def a5(s, d):
    c = cells(s, d).withColumn("contour", F.when(F.col("status") == "signup", F.array(F.lit(1.0))).otherwise(F.array().cast("array<double>")))
    return tr.non_empty_tracks(c).select(*PLAIN)


@query("a6_span_histogram", "SELECT span, count(*) AS n_tracks FROM tracks GROUP BY ALL")
def a6(s, d):
    return tr.span_histogram(cells(s, d))


@query(
    "a7_live_tracks",
    """WITH ends AS (SELECT dataset, min("start") AS a, max("end") AS b FROM tracks GROUP BY ALL)
    SELECT e.dataset, CAST(t AS INTEGER) AS timeframe, count(k.track_id) AS n_tracks FROM ends e, unnest(range(a, b)) u(t)
    LEFT JOIN tracks k ON k.dataset = e.dataset AND t BETWEEN k."start" AND k."end" GROUP BY ALL""",
)
def a7(s, d):
    return tr.live_tracks(cells(s, d))


@query("a8_cells_per_frame", "SELECT dataset, timeframe, count(*) AS n_cells, array_to_string(list_sort(list(sc_id)), ',') AS sc_ids FROM cells GROUP BY ALL")
def a8(s, d):
    return tr.cells_per_frame(cells(s, d)).withColumn("sc_ids", F.array_join(F.col("sc_ids").cast("array<string>"), ","))


@query(
    "a37_size_correlation",
    """WITH k AS (SELECT track_id, area, row_number() OVER (PARTITION BY track_id ORDER BY timeframe) AS k, count(*) OVER (PARTITION BY track_id) AS n FROM cells),
    p AS (SELECT DISTINCT track_id // 2 AS pair_id FROM cells),
    j AS (SELECT a.track_id // 2 AS pair_id, corr(a.area, b.area) AS r, least(min(a.n), min(b.n)) AS n FROM k a JOIN k b ON b.track_id = a.track_id + 1 AND a.k = b.k WHERE a.track_id % 2 = 0 AND a.k <= 4 GROUP BY ALL)
    SELECT pair_id, round(CASE WHEN coalesce(n, 0) < 3 THEN 0.0 ELSE r END, 6) AS size_correlation FROM p LEFT JOIN j USING (pair_id)""",
)
def a37(s, d):
    c = cells(s, d)
    pairs = c.select((F.expr("track_id div 2")).alias("pair_id")).distinct().select("pair_id", (F.col("pair_id") * 2).alias("a"), (F.col("pair_id") * 2 + 1).alias("b"))
    return tr.size_correlation(pairs, c).select("pair_id", *r("size_correlation"))


@query("a38_relative_time", "SELECT dataset, track_id, timeframe, sc_id, timeframe - min(timeframe) OVER (PARTITION BY dataset, track_id) AS relative_time FROM cells")
def a38(s, d):
    return tr.relative_time(cells(s, d)).select(*PLAIN, "relative_time")


@query("a39_counts_above", "SELECT CAST(t AS INTEGER) AS threshold, count(*) AS n_samples, CAST(sum(n) AS BIGINT) AS n_cells FROM (SELECT clip, count(*) AS n FROM clips GROUP BY ALL), unnest([2, 4, 6]) u(t) WHERE n > t GROUP BY ALL")
def a39(s, d):
    return tr.counts_above(clips(s, d).withColumnRenamed("clip", "sample_id"), [2, 4, 6])


@query(
    "w1_sliding_clips",
    """SELECT dataset, track_id, (k - 1) // 2 AS clip, timeframe AS start_time, e AS end_time FROM (SELECT dataset, track_id, timeframe,
    row_number() OVER w AS k, lead(timeframe, 6) OVER w AS e FROM cells WINDOW w AS (PARTITION BY dataset, track_id ORDER BY timeframe)) WHERE e IS NOT NULL AND (k - 1) % 2 = 0""",
)
def w1(s, d):
    return tr.sliding_clips(cells(s, d), 7, 2)


@query(
    "w2_sliding_stats",
    """SELECT dataset, track_id, timeframe, CAST(k AS INTEGER) AS "window", round(m, 6) AS mean, round(sd, 6) AS std, round(mad, 6) AS mad FROM (SELECT dataset, track_id, timeframe, row_number() OVER w AS k,
    count(*) OVER (PARTITION BY dataset, track_id) AS n, avg(area) OVER f AS m, stddev_pop(area) OVER f AS sd, mad(area) OVER f AS mad
    FROM cells WINDOW w AS (PARTITION BY dataset, track_id ORDER BY timeframe), f AS (PARTITION BY dataset, track_id ORDER BY timeframe ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) WHERE k <= n - 8""",
)
def w2(s, d):
    return tr.sliding_stats(cells(s, d), "area", 8).select(*tr.TRACK, "timeframe", "window", *r("mean", "std", "mad"))


@query(
    "w3_stable_scale",
    """WITH w AS (SELECT * FROM (SELECT dataset, track_id, row_number() OVER w AS k, count(*) OVER (PARTITION BY dataset, track_id) AS n, avg(area) OVER f AS m, stddev_pop(area) OVER f AS sd
    FROM cells WINDOW w AS (PARTITION BY dataset, track_id ORDER BY timeframe), f AS (PARTITION BY dataset, track_id ORDER BY timeframe ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING)) WHERE k <= n - 12 AND k <= 36),
    s AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY dataset, track_id ORDER BY round(sd, 9), k) <= 6),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY dataset, track_id ORDER BY round(m, 9), k) = 1)
    SELECT c.dataset, c.track_id, c.timeframe, c.sc_id, round((area - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 4) AS scaled FROM cells c JOIN b USING (dataset, track_id)""",
)
def w3(s, d):
    return tr.stable_scale(cells(s, d), "area").select(*PLAIN, F.round("scaled", 4).alias("scaled"))


@query(
    "w4_neighbours",
    """SELECT dataset, track_id, timeframe, sc_id, lag(timeframe) OVER w AS prev_time, lead(timeframe) OVER w AS next_time, lead(timeframe) OVER w - timeframe AS gap, lead(timeframe) OVER w - timeframe = 1 AS consecutive
    FROM cells WINDOW w AS (PARTITION BY dataset, track_id ORDER BY timeframe)""",
)
def w4(s, d):
    return tr.neighbours_in_time(cells(s, d)).select(*PLAIN, "prev_time", "next_time", "gap", "consecutive")


@query(
    "w5_relabel",
    """WITH s AS (SELECT dataset, track_id, row_number() OVER (PARTITION BY dataset ORDER BY "start", track_id) AS k FROM tracks WHERE track_id > 0)
    SELECT dataset, coalesce(k, track_id) AS track_id, timeframe, sc_id FROM cells LEFT JOIN s USING (dataset, track_id)""",
)
def w5(s, d):
    return tr.relabel_tracks(cells(s, d)).select(*PLAIN)


@query(
    "w6_track_ends",
    """SELECT dataset, track_id, min(timeframe) AS "start", max(timeframe) AS "end", min_by(sc_id, timeframe) AS first_sc_id, min_by(area, timeframe) AS first_area,
    max_by(sc_id, timeframe) AS last_sc_id, max_by(area, timeframe) AS last_area FROM cells GROUP BY ALL""",
)
def w6(s, d):
    return tr.track_ends(cells(s, d), "sc_id", "area")


FLAG = "CASE status WHEN 'error' THEN 1 WHEN 'signup' THEN 2 END"


@query(
    "w7_event_near",
    f"""WITH f AS (SELECT *, CASE WHEN timeframe < max(timeframe) OVER (PARTITION BY dataset) THEN {FLAG} END AS flag FROM cells)
    SELECT dataset, track_id, timeframe, sc_id, coalesce(last_value(flag IGNORE NULLS) OVER (PARTITION BY dataset, track_id ORDER BY timeframe RANGE BETWEEN CURRENT ROW AND 9 FOLLOWING), 0) AS near_flag FROM f""",
)
def w7(s, d):
    return tr.event_flag_near(cells(s, d).withColumn("flag", F.expr(FLAG)), "flag", 10).select(*PLAIN, "near_flag")


NEAR_END = "coalesce(arg_max(flag, timeframe) FILTER (flag IS NOT NULL AND timeframe > 0 AND timeframe > e - {0}), 0)"


@query(
    "w8_apoptosis",
    f"""WITH c AS (SELECT dataset, track_id * 40 + timeframe // 48 AS track_id, timeframe, area, {FLAG} AS flag FROM cells),
    w AS (SELECT *, max(timeframe) OVER t AS e, min(timeframe) OVER t AS s, count(*) OVER t AS n, max(timeframe) OVER (PARTITION BY dataset) AS last, row_number() OVER (PARTITION BY dataset, track_id ORDER BY area) AS k FROM c WINDOW t AS (PARTITION BY dataset, track_id)),
    g AS (SELECT dataset, track_id, count(*) AS length, {NEAR_END.format(1)} AS e0, {NEAR_END.format(2)} AS e1, {NEAR_END.format(3)} AS e2, {NEAR_END.format(5)} AS e3, coalesce(arg_max(flag, timeframe) FILTER (flag IS NOT NULL AND timeframe < last AND timeframe < s + 5), 0) AS s0,
      avg(area) FILTER (k > n - 5) < 2 * avg(area) FILTER (k <= 5) AS even FROM w GROUP BY ALL)
    SELECT dataset, track_id, length, CASE WHEN length <= 3 THEN e0 = 1 WHEN length <= 5 THEN e1 = 1 WHEN length <= 10 THEN e2 = 1 ELSE s0 = 1 AND e3 = 1 AND even END AS apoptosis FROM g""",
)
def w8(s, d):
    c = cells(s, d).withColumn("flag", F.expr(FLAG)).withColumn("track_id", F.expr("track_id * 40 + timeframe div 48"))
    return tr.apoptosis_tracklets(c)


@query(
    "w9_abnormal_jumps",
    """WITH v AS (SELECT dataset, track_id, timeframe, area - lag(area) OVER w AS d, lag(timeframe) OVER w AS b FROM cells WHERE area <> 0 WINDOW w AS (PARTITION BY dataset, track_id ORDER BY timeframe)),
    j AS (SELECT *, d / nullif(avg(abs(d)) OVER (PARTITION BY dataset, track_id), 0) AS jump FROM v WHERE d IS NOT NULL),
    n AS (SELECT *, CASE WHEN jump = lag(jump) OVER (PARTITION BY dataset, track_id ORDER BY timeframe) THEN 0 ELSE 1 END AS new FROM j), k AS (SELECT *, sum(new) OVER (PARTITION BY dataset, track_id ORDER BY timeframe) AS run FROM n),
    r AS (SELECT dataset, track_id, run, min(jump) AS jump, list(timeframe ORDER BY timeframe) AS ts, list(b ORDER BY timeframe) AS bs FROM k GROUP BY ALL),
    o AS (SELECT *, lag(jump) OVER w AS l, lead(jump) OVER w AS m FROM r WINDOW w AS (PARTITION BY dataset, track_id ORDER BY run))
    SELECT DISTINCT dataset, track_id, CAST(timeframe AS INTEGER) AS timeframe FROM (SELECT dataset, track_id, ts[1 + (len(ts) - 1) // 2] AS timeframe FROM o WHERE jump > l AND jump > m AND jump >= 3 UNION ALL SELECT dataset, track_id, bs[1 + len(bs) // 2] FROM o WHERE jump < l AND jump < m AND jump <= -3)""",
)
def w9(s, d):
    return tr.abnormal_jumps(cells(s, d), "area", 3.0)


@query(
    "w11_merge_segments",
    """WITH g AS (SELECT clip % 5 AS k, clip * 3 % 400 AS a, clip * 3 % 400 + clip % 4 AS b FROM clips),
    s AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM g),
    i AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY a, b) AS i FROM s)
    SELECT k, min(a) AS "start", max(b) AS "end" FROM i GROUP BY k, i""",
)
def w11(s, d):
    seg = clips(s, d).selectExpr("clip % 5 AS k", "clip * 3 % 400 AS start", "clip * 3 % 400 + clip % 4 AS end")
    return tr.merge_segments(seg, ["k"])


@query(
    "w12_clip_times",
    """WITH n AS (SELECT *, count(*) OVER (PARTITION BY clip, timeframe) AS n, timeframe - min(timeframe) OVER (PARTITION BY clip) AS relative_time FROM clips)
    SELECT clip, sc_id, relative_time, timeframe - min(CASE WHEN n > 1 THEN timeframe END) OVER w AS division_time,
    round((relative_time - avg(relative_time) OVER w) / CASE WHEN stddev_pop(relative_time) OVER w = 0 THEN 1 ELSE stddev_pop(relative_time) OVER w END, 6) AS standard_time FROM n WINDOW w AS (PARTITION BY clip)""",
)
def w12(s, d):
    return tr.clip_times(clips(s, d)).select("clip", "sc_id", "relative_time", "division_time", *r("standard_time"))


@query(
    "w14_size_changes",
    """SELECT dataset, track_id, timeframe, sc_id, round((area - lag(area) OVER w) / nullif(lag(area) OVER w, 0), 6) AS size_change, (x1 + x2) / 2 - lag((x1 + x2) / 2) OVER w AS dx, (y1 + y2) / 2 - lag((y1 + y2) / 2) OVER w AS dy
    FROM cells WINDOW w AS (PARTITION BY dataset, track_id ORDER BY timeframe)""",
)
def w14(s, d):
    return tr.size_changes(cells(s, d)).select(*PLAIN, *r("size_change"), "dx", "dy")


@query("w15_last_frames", 'SELECT dataset, track_id, timeframe, sc_id FROM cells JOIN tracks USING (dataset, track_id) WHERE timeframe >= "end" - 8')
def w15(s, d):
    return tr.last_frames(cells(s, d), 8).select(*PLAIN)


@query(
    "w16_track_class",
    "SELECT dataset, track_id, CASE WHEN max_by(status, timeframe) = 'error' THEN 'mitosis' WHEN bool_or(status IN ('error', 'signup') AND timeframe > 690) THEN 'excluded' ELSE 'normal' END AS track_class FROM cells GROUP BY ALL",
)
def w16(s, d):
    c = cells(s, d).withColumn("status", F.when((F.col("status") == "error") | (F.col("timeframe") > 690), F.col("status")).otherwise("view"))
    c = c.withColumn("status", F.when((F.col("status") == "error") & (F.col("timeframe") <= 690), "error_early").otherwise(F.col("status")))
    last = F.max("timeframe").over(tr.by_track()) == F.col("timeframe")
    c = c.withColumn("status", F.when(last & (F.col("status") == "error_early"), "error").otherwise(F.col("status")))
    return tr.track_classes(c, "status", "error", ["error", "signup"])


@query(
    "w17_fill_frames",
    "SELECT dataset, track_id, CAST(t AS INTEGER) AS timeframe, sc_id FROM tracks CROSS JOIN unnest(range(0, 51)) u(t) LEFT JOIN cells USING (dataset, track_id) WHERE FALSE UNION ALL SELECT k.dataset, k.track_id, CAST(t AS INTEGER), c.sc_id FROM tracks k CROSS JOIN unnest(range(0, 51)) u(t) LEFT JOIN cells c ON c.dataset = k.dataset AND c.track_id = k.track_id AND c.timeframe = t",
)
def w17(s, d):
    return tr.fill_frames(cells(s, d), 50).select(*PLAIN)


@query("o1_time_order", "SELECT timeframe, track_id, sc_id FROM cells")
def o1(s, d):
    return tr.in_time_order(cells(s, d).select("timeframe", "track_id", "sc_id"))


@query(
    "g15_track_matrix",
    """WITH m AS (SELECT k.dataset, k.track_id, t, coalesce(c.sc_id, -1) AS v FROM tracks k CROSS JOIN unnest(range(0, 41)) u(t) LEFT JOIN cells c ON c.dataset = k.dataset AND c.track_id = k.track_id AND c.timeframe = t)
    SELECT dataset, track_id, string_agg(CAST(v AS VARCHAR), ',' ORDER BY t) AS frames FROM m GROUP BY ALL""",
)
def g15(s, d):
    return tr.track_matrix(cells(s, d), 40).withColumn("frames", F.array_join(F.col("frames").cast("array<string>"), ","))


@query("u1_union_by_name", "SELECT doc_id AS id, lang, NULL AS label FROM documents UNION ALL SELECT vec_id, NULL, label FROM embeddings")
def u1(s, d):
    return tr.union_all(table(s, d, "documents").selectExpr("doc_id AS id", "lang"), table(s, d, "embeddings").selectExpr("vec_id AS id", "label"))


@query(
    "u2_candidate_pairs",
    "((SELECT track_id, timeframe FROM cells WHERE sc_id % 2 = 0 UNION SELECT track_id, timeframe FROM cells WHERE sc_id % 3 = 0) EXCEPT SELECT track_id, timeframe FROM cells WHERE area < 10) INTERSECT SELECT track_id, timeframe FROM cells WHERE status <> 'view'",
)
def u2(s, d):
    c = cells(s, d)
    pick = lambda w: c.where(w).select("track_id", "timeframe")
    return tr.candidate_pairs(pick("sc_id % 2 = 0"), pick("sc_id % 3 = 0"), pick("area < 10"), pick("status <> 'view'"))


@query("u3_connect_tracks", "SELECT dataset, CASE WHEN track_id >= 1000000 THEN track_id - 1000000 ELSE track_id END AS track_id, timeframe, sc_id FROM (SELECT dataset, CASE WHEN timeframe >= 300 THEN track_id + 1000000 ELSE track_id END AS track_id, timeframe, sc_id FROM cells)")
def u3(s, d):
    c = cells(s, d).withColumn("track_id", F.when(F.col("timeframe") >= 300, F.col("track_id") + 1000000).otherwise(F.col("track_id")))
    ids = c.select(*tr.TRACK).distinct()
    late = ids.where("track_id >= 1000000").select("dataset", (F.col("track_id") - 1000000).alias("a"), F.col("track_id").alias("b"))
    return tr.connect_tracks(c, late.join(ids.withColumnRenamed("track_id", "a"), ["dataset", "a"], "left_semi"), components).select(*PLAIN)


@query(
    "u4_split_tracks",
    """WITH e AS (SELECT dataset, track_id, median_t AS cut FROM (SELECT dataset, track_id, quantile_disc(timeframe, 0.5) AS median_t, count(*) AS n FROM cells WHERE track_id % 5 = 0 GROUP BY ALL)),
    m AS (SELECT dataset, max(track_id) AS m FROM cells WHERE track_id % 5 <> 0 GROUP BY ALL),
    k AS (SELECT e.*, coalesce(m, -1) + 1 + 2 * (row_number() OVER (PARTITION BY dataset ORDER BY track_id) - 1) AS low FROM e LEFT JOIN m USING (dataset))
    SELECT c.dataset, CASE WHEN cut IS NULL THEN c.track_id WHEN timeframe >= cut THEN low + 1 ELSE low END AS track_id, timeframe, sc_id FROM cells c LEFT JOIN k USING (dataset, track_id)""",
)
def u4(s, d):
    c = cells(s, d)
    edits = c.where("track_id % 5 = 0").groupBy(*tr.TRACK).agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY timeframe)").cast("int").alias("at"))
    return tr.split_tracks(c, edits).select(*PLAIN)


@query("u5_add_lineage", "SELECT mother_id, daughter_id FROM lineage WHERE daughter_id % 2 = 0 UNION SELECT mother_id, daughter_id FROM lineage")
def u5(s, d):
    e = lineage(s, d)
    return tr.add_lineage(e.where("daughter_id % 2 = 0"), e)


@query(
    "u6_break_links",
    """WITH k AS (SELECT *, count(*) FILTER (sc_id % 40 = 0) OVER (PARTITION BY dataset, track_id ORDER BY timeframe) AS p FROM cells),
    t AS (SELECT dataset, max(track_id) AS top FROM cells GROUP BY ALL),
    f AS (SELECT dataset, track_id, p, row_number() OVER (PARTITION BY dataset ORDER BY track_id, p) AS f FROM (SELECT DISTINCT dataset, track_id, p FROM k WHERE p > 0))
    SELECT dataset, coalesce(top + f, track_id) AS track_id, timeframe, sc_id FROM k JOIN t USING (dataset) LEFT JOIN f USING (dataset, track_id, p)""",
)
def u6(s, d):
    c = cells(s, d)
    return tr.break_links(c, c.where("sc_id % 40 = 0")).select(*PLAIN)


@query("u7_false_objects", "SELECT dataset, CASE WHEN area < 3 THEN -1 ELSE track_id END AS track_id, timeframe, sc_id FROM cells")
def u7(s, d):
    c = cells(s, d)
    return tr.mark_false_objects(c, c.where("area < 3")).select(*PLAIN)


@query("u8_connect_links", "SELECT dataset, track_id % 1000000 AS track_id, timeframe, sc_id FROM (SELECT dataset, track_id + 1000000 * (timeframe // 200) AS track_id, timeframe, sc_id FROM cells WHERE (dataset, track_id) IN (SELECT (dataset, track_id) FROM cells WHERE timeframe < 200))")
def u8(s, d):
    c = cells(s, d)
    c = c.join(c.where("timeframe < 200").select(*tr.TRACK).distinct(), tr.TRACK, "left_semi")
    parts = c.withColumn("track_id", F.expr("track_id + 1000000 * (timeframe div 200)"))
    edits = parts.selectExpr("dataset", "track_id % 1000000 AS a", "track_id AS b").where("a <> b").distinct()
    return tr.connect_tracks(parts, edits, components).select(*PLAIN)


@query("u9_last_write", "SELECT dataset, track_id, timeframe, sc_id, area FROM cells")
def u9(s, d):
    return tr.last_write_wins(raw_cells(s, d)).select(*PLAIN, "area")


@query(
    "u13_offset_union",
    "WITH m AS (SELECT max(track_id) + 1 AS m FROM cells WHERE dataset < 2) SELECT dataset, track_id, timeframe, sc_id FROM cells WHERE dataset < 2 UNION ALL SELECT dataset, track_id + m, timeframe, sc_id FROM cells, m WHERE dataset >= 2",
)
def u13(s, d):
    c = cells(s, d).select(*PLAIN)
    return tr.offset_union([c.where("dataset < 2"), c.where("dataset >= 2")]).select(*PLAIN)


@query(
    "u14_overwrite_frames",
    "SELECT dataset, track_id, timeframe, CASE WHEN timeframe % 10 = 3 THEN -sc_id ELSE sc_id END AS sc_id FROM cells",
)
def u14(s, d):
    c = cells(s, d).select(*PLAIN)
    other = c.where("timeframe % 10 = 3").withColumn("sc_id", -F.col("sc_id"))
    return tr.replace_frames(c, other, [*tr.TRACK, "timeframe"])


@query("j23_condition_swap", "SELECT dataset, track_id, timeframe, CASE WHEN timeframe BETWEEN 100 AND 120 THEN sc_id + 1000000 ELSE sc_id END AS sc_id FROM cells")
def j23(s, d):
    c = cells(s, d).select(*PLAIN)
    other = c.where("timeframe BETWEEN 100 AND 120").withColumn("sc_id", F.col("sc_id") + 1000000)
    return tr.replace_frames(c, other, ["timeframe"])


@query("u15_single_tracks", "SELECT dataset, row_number() OVER (PARTITION BY dataset ORDER BY timeframe, sc_id) - 1 AS track_id, timeframe, sc_id FROM cells")
def u15(s, d):
    return tr.single_cell_tracks(cells(s, d)).select(*PLAIN)

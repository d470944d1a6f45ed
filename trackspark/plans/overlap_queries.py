"""Queries over overlaps, links and lineage (J, A16 to A19, A36, W10, G, F geometry)."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackspark.functions import geometry as ge
from trackspark.operators import lineage as li
from trackspark.operators import linking as lk
from trackspark.operators import overlap as ov
from trackspark.operators import tracking as tk
from trackspark.operators import tracks as tr

from .adapters import cells, lineage, pixels, table, unique_pixels, written
from .base import live_sql, query

KEY = ["image"]


def r(*names, digits=6):
    return [F.round(n, digits).alias(n) for n in names]


INTER = "greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)"
AREA = "(({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1))"
TOUCH = "greatest(a.x1, b.x1) <= least(a.x2, b.x2) AND greatest(a.y1, b.y1) <= least(a.y2, b.y2)"
PAIRS = f"""pairs AS (SELECT a.dataset, a.timeframe, a.sc_id AS sc_a, b.sc_id AS sc_b,
  {INTER} / CAST({AREA.format('a')} + {AREA.format('b')} - {INTER} AS DOUBLE) AS iou, {INTER} / CAST(least({AREA.format('a')}, {AREA.format('b')}) AS DOUBLE) AS iomin
  FROM dense a JOIN dense b ON a.dataset = b.dataset AND b.timeframe = a.timeframe + 1 AND {TOUCH})"""
#: cells put into frames of eight hours, so that frames hold enough cells to meet
DENSE = "dense AS (SELECT dataset, track_id, timeframe // 8 AS timeframe, sc_id, area, x1, y1, x2, y2 FROM cells)"


def dense(s, d):
    return cells(s, d).withColumn("timeframe", F.expr("CAST(timeframe div 8 AS INT)"))


@query("j1_frame_pairs", f"WITH {DENSE}, {PAIRS} SELECT dataset, timeframe, sc_a, sc_b, round(iou, 6) AS iou, round(iomin, 6) AS iomin FROM pairs")
def j1(s, d):
    return ov.frame_pairs(dense(s, d)).select("dataset", "timeframe", "sc_a", "sc_b", *r("iou", "iomin"))


OVERLAP = """ov AS (SELECT *, o / CAST(area_a + area_b - o AS DOUBLE) AS iou, o / CAST(area_a AS DOUBLE) AS io_a, o / CAST(area_b AS DOUBLE) AS io_b FROM (
  SELECT image, label_a, label_b, o, CAST(sum(o) OVER (PARTITION BY image, label_a) AS BIGINT) AS area_a, CAST(sum(o) OVER (PARTITION BY image, label_b) AS BIGINT) AS area_b FROM (
  SELECT image, label_a, label_b, count(*) AS o FROM upixels GROUP BY ALL)) WHERE label_a <> 0 AND label_b <> 0)"""


@query("j2_label_overlap", f"WITH {OVERLAP} SELECT image, label_a, label_b, o AS overlap, area_a, area_b, round(iou, 6) AS iou, round(io_a, 6) AS io_a, round(io_b, 6) AS io_b FROM ov")
def j2(s, d):
    o = ov.label_overlap(unique_pixels(s, d), KEY)
    return o.select("image", "label_a", "label_b", "overlap", "area_a", "area_b", *r("iou", "io_a", "io_b"))


@query("j2_pixel_join", "SELECT image, r, c, CASE WHEN value > 5 THEN label_a ELSE 0 END AS label_a, CASE WHEN value < 45 THEN label_b ELSE 0 END AS label_b FROM upixels WHERE value > 5 OR value < 45")
def j2_join(s, d):
    p = unique_pixels(s, d)
    a, b = p.where("value > 5").selectExpr("image", "r", "c", "label_a AS label"), p.where("value < 45").selectExpr("image", "r", "c", "label_b AS label")
    return ov.pixel_join(a, b, KEY).select("image", "r", "c", F.col("label_a").cast("long").alias("label_a"), F.col("label_b").cast("long").alias("label_b"))


@query(
    "j3_maps",
    f"""WITH {DENSE}, {PAIRS} SELECT c.dataset, c.timeframe, c.sc_id AS sc_a, count(p.sc_b) AS n_targets, coalesce(string_agg(CAST(p.sc_b AS VARCHAR), ',' ORDER BY p.sc_b), '') AS targets
    FROM dense c LEFT JOIN (SELECT * FROM pairs WHERE iomin > 0.3) p ON p.dataset = c.dataset AND p.timeframe = c.timeframe AND p.sc_a = c.sc_id GROUP BY ALL""",
)
def j3(s, d):
    c = dense(s, d)
    m = ov.find_maps(ov.frame_pairs(c), c, ov.FRAME)
    return m.withColumn("targets", F.array_join(F.col("targets").cast("array<string>"), ","))


@query("j4_label_map", f"WITH {OVERLAP} SELECT image, label_a, string_agg(label_b || ':' || CAST(round(iou, 3) * 1000 AS INTEGER), ',' ORDER BY label_b) AS targets FROM ov WHERE iou > 0.03 GROUP BY ALL")
def j4(s, d):
    m = ov.label_map(ov.label_overlap(unique_pixels(s, d), KEY), KEY, 0.03)
    text = F.transform(F.map_entries("targets"), lambda e: F.concat_ws(":", e["key"], (F.round(e["value"], 3) * 1000).cast("int")))
    return m.select("image", "label_a", F.array_join(text, ",").alias("targets"))


@query("j5_best_match", f"WITH {OVERLAP} SELECT image, label_b, label_a, round(iou, 6) AS iou FROM ov QUALIFY row_number() OVER (PARTITION BY image, label_b ORDER BY iou DESC, label_a) = 1")
def j5(s, d):
    return ov.best_match(ov.label_overlap(unique_pixels(s, d), KEY), KEY).select("image", "label_b", "label_a", *r("iou"))


@query(
    "j6_extend_zero_maps",
    f"""WITH {DENSE}, {PAIRS}, z AS (SELECT * FROM dense WHERE sc_id NOT IN (SELECT sc_a FROM pairs WHERE iomin > 0.3)),
    h AS (SELECT a.sc_id, min(b.timeframe) AS stop FROM z a JOIN dense b ON a.dataset = b.dataset AND b.timeframe > a.timeframe AND {TOUCH} AND {INTER} / CAST(least({AREA.format('a')}, {AREA.format('b')}) AS DOUBLE) > 0.5 GROUP BY ALL)
    SELECT z.dataset, z.sc_id, f.timeframe FROM z LEFT JOIN h USING (sc_id) JOIN (SELECT DISTINCT dataset, timeframe FROM dense) f ON f.dataset = z.dataset AND f.timeframe >= z.timeframe AND (stop IS NULL OR f.timeframe < stop)""",
)
def j6(s, d):
    c = written(dense(s, d).select("dataset", "timeframe", "sc_id", "x1", "y1", "x2", "y2"))
    return ov.extend_zero_maps(ov.zero_maps(ov.frame_pairs(c), c, ov.FRAME), c, 0.5)


ENDS = """ends AS (SELECT dataset, track_id, min(timeframe) AS s, max(timeframe) AS e, min_by((x1 + x2) / 2, timeframe) AS fx, min_by((y1 + y2) / 2, timeframe) AS fy, min_by(area, timeframe) AS fa,
  max_by((x1 + x2) / 2, timeframe) AS lx, max_by((y1 + y2) / 2, timeframe) AS ly, max_by(area, timeframe) AS la FROM tracklets GROUP BY ALL)"""
#: tracks cut into pieces of 40 frames
TRACKLETS = "tracklets AS (SELECT dataset, track_id * 100 + timeframe // 40 AS track_id, timeframe, sc_id, area, x1, y1, x2, y2 FROM cells)"


def tracklets(s, d):
    return cells(s, d).withColumn("track_id", F.expr("track_id * 100 + timeframe div 40"))


@query(
    "j7_gap_pairs",
    f"""WITH {TRACKLETS}, {ENDS} SELECT a.dataset, a.track_id AS a, b.track_id AS b,
    CASE WHEN coalesce(a.la, 0) = 0 OR coalesce(b.fa, 0) = 0 THEN CAST('Infinity' AS DOUBLE) ELSE round(sqrt((a.lx - b.fx) ** 2 + (a.ly - b.fy) ** 2) * greatest(a.la / b.fa, b.fa / a.la) * 10000) / 10000 END AS score
    FROM ends a JOIN ends b ON a.dataset = b.dataset AND b.s BETWEEN a.e + 1 AND a.e + 3""",
)
def j7(s, d):
    # rounded as whole numbers: engines differ in how they round a double to digits where it is next to a tie
    return lk.gap_pairs(tracklets(s, d), 3).select("dataset", "a", "b", (F.round(F.col("score") * 10000) / 10000).alias("score"))


SISTERS = f"""{TRACKLETS}, {ENDS}, near AS (SELECT a.dataset, a.s AS "start", a.track_id AS a, b.track_id AS b, sqrt((a.fx - b.fx) ** 2 + (a.fy - b.fy) ** 2) AS distance, 1 - abs(a.fa - b.fa) / (a.fa + b.fa) AS similarity, (a.fx + b.fx) / 2 AS mx, (a.fy + b.fy) / 2 AS my
    FROM ends a JOIN ends b ON a.dataset = b.dataset AND a.s = b.s AND a.track_id < b.track_id),
  ordered AS (SELECT dataset, "start", list(struct_pack(a := a, b := b) ORDER BY similarity DESC, a, b) AS ps FROM near WHERE distance <= 400 AND similarity >= 0.7 GROUP BY ALL),
  taken AS (SELECT dataset, "start", unnest(list_reduce(list_transform(ps, lambda p: [p]), lambda t, p: CASE WHEN len(list_filter(t, lambda x: x.a IN (p[1].a, p[1].b) OR x.b IN (p[1].a, p[1].b))) > 0 THEN t ELSE list_concat(t, p) END)) AS p FROM ordered),
  sis AS (SELECT near.* FROM near JOIN taken ON near.dataset = taken.dataset AND near."start" = taken."start" AND a = p.a AND b = p.b)"""


@query(
    "j8_division_triples",
    f"""WITH {SISTERS}, m AS (SELECT sis.*, e.track_id AS parent, sqrt((mx - lx) ** 2 + (my - ly) ** 2) AS parent_distance FROM sis JOIN ends e ON e.dataset = sis.dataset AND e.e + 1 = sis."start")
    SELECT dataset, "start", parent, a, b, round(distance, 6) AS distance, round(similarity, 6) AS similarity, round(parent_distance, 6) AS parent_distance
    FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY dataset, "start", a, b ORDER BY parent_distance, parent) = 1) WHERE parent_distance < 400 - distance""",
)
def j8(s, d):
    return lk.division_triples(tracklets(s, d), 200, 0.7).select("dataset", "start", "parent", "a", "b", *r("distance", "similarity", "parent_distance"))


@query("j9_sister_pairs", f'WITH {SISTERS} SELECT dataset, "start", a, b, round(distance, 6) AS distance, round(similarity, 6) AS similarity FROM sis')
def j9(s, d):
    return lk.sister_pairs(tracklets(s, d), 200, 0.7).select("dataset", "start", "a", "b", *r("distance", "similarity"))


@query("j10_object_info", "SELECT dataset, timeframe, sc_id, area, x1 FROM cells WHERE status = 'error'")
def j10(s, d):
    c = cells(s, d)
    return lk.object_info(c.where("status = 'error'").select("dataset", "timeframe", "sc_id"), c, "area", "x1")


@query(
    "j11_signals_to_cells",
    """WITH s AS (SELECT dataset, sc_id AS sig_id, timeframe AS st, (sc_id * 53 % 960) + 0.5 AS x, (sc_id * 71 % 960) + 0.5 AS y FROM cells)
    SELECT s.dataset, sig_id, max(c.timeframe) AS timeframe, min_by(c.sc_id, CAST(c.sc_id AS BIGINT) - CAST(c.timeframe AS BIGINT) * 1000000000) AS sc_id FROM s JOIN cells c ON c.dataset = s.dataset AND c.timeframe <= st AND x > c.x1 AND x < c.x2 AND y > c.y1 AND y < c.y2 GROUP BY ALL""",
)
def j11(s, d):
    c = written(cells(s, d).select("dataset", "timeframe", "sc_id", "x1", "y1", "x2", "y2"))
    corner = lambda a, b: F.array(F.col(a).cast("double"), F.col(b).cast("double"))
    shaped = c.withColumn("contour", F.array(corner("x1", "y1"), corner("x1", "y2"), corner("x2", "y2"), corner("x2", "y1")))
    sig = c.selectExpr("dataset", "sc_id AS sig_id", "timeframe", "(sc_id * 53 % 960) + 0.5D AS x", "(sc_id * 71 % 960) + 0.5D AS y")
    return lk.signals_to_cells(sig, shaped)


@query("j12_neighbour_cells", "SELECT sc_id, lag(sc_id) OVER w AS prev_sc, lead(sc_id) OVER w AS next_sc FROM cells WINDOW w AS (PARTITION BY dataset, track_id ORDER BY timeframe)")
def j12(s, d):
    return lk.before_and_after(cells(s, d)).select("sc_id", "prev_sc", "next_sc")


@query(
    "j13_file_pairs",
    """WITH a AS (SELECT dataset // 2 AS k, timeframe AS t, 'seg' || sc_id AS p FROM cells WHERE track_id % 2 = 0), b AS (SELECT dataset // 2 AS k, timeframe AS t, min('tra' || sc_id) AS p FROM cells WHERE track_id % 2 = 1 GROUP BY 1, 2),
    ra AS (SELECT * FROM a WHERE (k, t) NOT IN (SELECT (k, t) FROM b)), rb AS (SELECT * FROM b WHERE (k, t) NOT IN (SELECT (k, t) FROM a))
    SELECT a.k, a.t, a.p AS seg_path, b.p AS tra_path, 'exact' AS match FROM a JOIN b USING (k, t) UNION ALL
    SELECT ra.k, ra.t, ra.p, min_by(rb.p, rb.t), 'fuzzy' FROM ra JOIN rb ON ra.k = rb.k AND rb.t BETWEEN ra.t - 1 AND ra.t + 1 GROUP BY ra.k, ra.t, ra.p""",
)
def j13(s, d):
    c = cells(s, d)
    a = c.where("track_id % 2 = 0").selectExpr("dataset div 2 AS k", "timeframe AS t", "concat('seg', sc_id) AS path")
    b = c.where("track_id % 2 = 1").groupBy(F.expr("dataset div 2").alias("k"), F.col("timeframe").alias("t")).agg(F.min(F.concat(F.lit("tra"), "sc_id")).alias("path"))
    return lk.pair_files(a, b, ["k"])


@query(
    "j14_gap_candidates",
    f"""WITH {DENSE}, one AS (SELECT * FROM dense QUALIFY row_number() OVER (PARTITION BY dataset, track_id, timeframe ORDER BY sc_id) = 1),
    g AS (SELECT *, lead(timeframe) OVER w AS nt, lead(sc_id) OVER w AS ns FROM one WINDOW w AS (PARTITION BY dataset, track_id ORDER BY timeframe)),
    m AS (SELECT dataset, track_id, t, sc_id AS near FROM g, unnest(range(timeframe + 1, nt)) u(t) WHERE t - timeframe <= 2 UNION ALL SELECT dataset, track_id, t, ns FROM g, unnest(range(timeframe + 1, nt)) u(t) WHERE nt - t < 2)
    SELECT DISTINCT m.dataset, CAST(m.t AS INTEGER) AS timeframe, m.track_id, a.sc_id AS from_sc, b.sc_id AS candidate FROM m JOIN one a ON a.sc_id = m.near JOIN one b ON b.dataset = m.dataset AND b.timeframe = m.t AND {INTER} / CAST(least({AREA.format('a')}, {AREA.format('b')}) AS DOUBLE) > 0.3""",
)
def j14(s, d):
    return lk.candidates_at_gaps(one_per_frame(s, d), 2, 0.3)


def one_per_frame(s, d):
    return dense(s, d).groupBy("dataset", "track_id", "timeframe").agg(F.min_by(F.struct("sc_id", "area", "x1", "y1", "x2", "y2"), "sc_id").alias("q")).select("dataset", "track_id", "timeframe", "q.*")


@query(
    "j15_end_candidates",
    f"""WITH {TRACKLETS}, l AS (SELECT * FROM tracklets QUALIFY row_number() OVER (PARTITION BY dataset, track_id ORDER BY timeframe DESC) = 1)
    SELECT DISTINCT a.dataset, b.timeframe, a.track_id, a.sc_id AS from_sc, b.sc_id AS candidate FROM l a JOIN tracklets b ON a.dataset = b.dataset AND b.timeframe BETWEEN a.timeframe + 1 AND a.timeframe + 12 AND {INTER} / CAST(least({AREA.format('a')}, {AREA.format('b')}) AS DOUBLE) > 0.05""",
)
def j15(s, d):
    return lk.candidates_after_end(tracklets(s, d), 12, 0.05)


@query(
    "j16_candidate_report",
    "SELECT count(*) FILTER (c AND a) AS n_in, count(*) FILTER (NOT a) AS n_not_in, count(*) FILTER (a) AS n_annotated, round(count(*) FILTER (c AND a) / CAST(count(*) FILTER (a) AS DOUBLE), 6) AS coverage FROM (SELECT sc_id % 3 = 0 AS c, sc_id % 5 = 0 AS a FROM cells) WHERE c OR a",
)
def j16(s, d):
    c = cells(s, d)
    return lk.candidate_report(c.where("sc_id % 3 = 0"), c.where("sc_id % 5 = 0"), "sc_id").select("n_in", "n_not_in", "n_annotated", *r("coverage"))


@query(
    "j17_multimaps",
    """WITH m AS (SELECT sc_id AS id, sc_id AS map_from, unnest([sc_id + 1, sc_id + 2]) AS map_to FROM cells WHERE sc_id % 4 = 0)
    SELECT id, map_from, map_to, f.track_id AS from_track, f.timeframe AS from_time, t.track_id AS to_track, t.timeframe AS to_time FROM m JOIN cells f ON f.sc_id = map_from JOIN cells t ON t.sc_id = map_to""",
)
def j17(s, d):
    c = cells(s, d)
    a = c.where("sc_id % 4 = 0").selectExpr("sc_id AS id", "concat('{\"', sc_id, '\": [', sc_id + 1, ', ', sc_id + 2, ']}') AS multimap")
    return lk.resolve_multimaps(a, c)


@query("j18_flag_known", "SELECT sc_id, sc_id % 6 = 0 AS is_mitosis FROM cells")
def j18(s, d):
    c = cells(s, d)
    return lk.flag_known(c, c.where("sc_id % 6 = 0")).select("sc_id", "is_mitosis")


@query("j19_listed", "SELECT sc_id FROM cells WHERE sc_id % 6 = 0 AND sc_id % 4 <> 0")
def j19(s, d):
    c = cells(s, d)
    return lk.drop_listed(lk.keep_listed(c, c.where("sc_id % 6 = 0"), "sc_id"), c.where("sc_id % 4 = 0"), "sc_id").select("sc_id")


@query(
    "j20_family",
    """WITH t AS (SELECT DISTINCT daughter_id AS track_id FROM lineage), m AS (SELECT daughter_id AS track_id, string_agg(CAST(mother_id AS VARCHAR), ',' ORDER BY mother_id) AS mothers FROM lineage GROUP BY ALL),
    d AS (SELECT mother_id AS track_id, string_agg(CAST(daughter_id AS VARCHAR), ',' ORDER BY daughter_id) AS daughters FROM lineage GROUP BY ALL)
    SELECT track_id, coalesce(mothers, '') AS mothers, coalesce(daughters, '') AS daughters FROM t LEFT JOIN m USING (track_id) LEFT JOIN d USING (track_id)""",
)
def j20(s, d):
    e = lineage(s, d)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return li.with_family(e.select(F.col("daughter_id").alias("track_id")), e).select("track_id", text("mothers"), text("daughters"))


@query("j21_paddings", "SELECT sc_id, padding FROM cells, unnest([10, 20, 50, 100]) u(padding)")
def j21(s, d):
    return lk.with_paddings(cells(s, d)).select("sc_id", "padding")


@query(
    "j22_organelles",
    """WITH p AS (SELECT event_id // 2 AS parent, event_type AS organelle_type, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY ALL)
    SELECT sc_id, organelle_type, n FROM cells LEFT JOIN p ON parent = sc_id""",
)
def j22(s, d):
    parts = table(s, d, "events").where("event_type <> 'view'").selectExpr("event_id AS component_id", "event_id div 2 AS parent_cell_id", "event_type AS organelle_type")
    return lk.components_of_cells(cells(s, d).select("sc_id"), parts).select("sc_id", "organelle_type", "n")


@query(
    "j24_underseg_groups",
    f"""WITH {OVERLAP}, b AS (SELECT * FROM ov QUALIFY row_number() OVER (PARTITION BY image, label_b ORDER BY iou DESC, label_a) = 1),
    g AS (SELECT image, label_a, count(*) AS n_cells, string_agg(CAST(label_b AS VARCHAR), ',' ORDER BY label_b) AS members FROM b GROUP BY ALL HAVING count(*) > 1),
    x AS (SELECT image, label_a, min(r) AS x1, min(c) AS y1, max(r) + 1 AS x2, max(c) + 1 AS y2 FROM upixels GROUP BY ALL)
    SELECT image, label_a, n_cells, members, x1 - p AS x1, y1 - p AS y1, x2 + p AS x2, y2 + p AS y2 FROM (SELECT *, CAST(trunc(0.5 * greatest(x2 - x1, y2 - y1)) AS BIGINT) AS p FROM g JOIN x USING (image, label_a))""",
)
def j24(s, d):
    p = unique_pixels(s, d)
    boxes = p.groupBy("image", "label_a").agg(F.min("r").alias("x1"), F.min("c").alias("y1"), (F.max("r") + 1).alias("x2"), (F.max("c") + 1).alias("y2"))
    regions = boxes.select("image", "label_a", F.lit(1).alias("n_pieces"))
    g = ov.underseg_groups(ov.best_match(ov.label_overlap(p, KEY), KEY), regions, boxes, KEY)
    return g.withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


COUNTS = "n AS (SELECT image, count(DISTINCT nullif(label_a, 0)) AS n_out, count(DISTINCT nullif(label_b, 0)) AS n_gt FROM upixels GROUP BY ALL)"


@query(
    "a16_match_counts",
    f"""WITH {OVERLAP}, {COUNTS}, m AS (SELECT image, count(*) AS matched FROM (SELECT image, label_b FROM ov GROUP BY ALL HAVING count(*) FILTER (iou > 0.05) = 1) GROUP BY ALL)
    SELECT image, CAST(0.05 AS DOUBLE) AS threshold, n_out, n_gt, coalesce(matched, 0) AS matched FROM n LEFT JOIN m USING (image)""",
)
def a16(s, d):
    return ov.match_counts(unique_pixels(s, d), KEY, (0.05,))


METRICS = f"""{OVERLAP}, {COUNTS}, th AS (SELECT CAST(unnest([0.04, 0.05, 0.06]) AS DOUBLE) AS threshold),
    m AS (SELECT image, threshold, count(*) AS matched FROM (SELECT image, threshold, label_b FROM ov, th GROUP BY ALL HAVING count(*) FILTER (iou > threshold) = 1) GROUP BY ALL),
    b AS (SELECT image, avg(CASE WHEN (label_a <> 0) = (label_b <> 0) THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) FILTER (label_a <> 0 AND label_b <> 0) / CAST(count(*) FILTER (label_a <> 0 OR label_b <> 0) AS DOUBLE) AS iou FROM upixels GROUP BY ALL),
    sm AS (SELECT image, threshold, accuracy, iou, n_out, n_gt, coalesce(matched, 0) AS matched, abs(n_out - n_gt) AS count_diff, abs(n_out - n_gt) / CAST(n_gt AS DOUBLE) AS count_diff_share, coalesce(matched, 0) / CAST(n_gt AS DOUBLE) AS matched_share,
    coalesce(matched, 0) = n_gt AND n_gt = n_out AS all_match FROM n CROSS JOIN th JOIN b USING (image) LEFT JOIN m USING (image, threshold))"""
METRIC_THRESHOLDS = (0.04, 0.05, 0.06)


@query("a17_sample_metrics", f"WITH {METRICS} SELECT image, threshold, round(accuracy, 6) AS accuracy, round(iou, 6) AS iou, n_out, n_gt, matched, count_diff, round(count_diff_share, 6) AS count_diff_share, round(matched_share, 6) AS matched_share, all_match FROM sm")
def a17(s, d):
    m = ov.sample_metrics(unique_pixels(s, d), KEY, METRIC_THRESHOLDS)
    return m.select("image", "threshold", *r("accuracy", "iou"), "n_out", "n_gt", "matched", "count_diff", *r("count_diff_share", "matched_share"), "all_match")


@query("a18_mean_metrics", f"WITH {METRICS} SELECT threshold, round(avg(accuracy), 6) AS accuracy, round(avg(iou), 6) AS iou, round(avg(count_diff), 6) AS count_diff, round(avg(matched), 6) AS matched, round(avg(CASE WHEN all_match THEN 1.0 ELSE 0.0 END), 6) AS all_match FROM sm GROUP BY ALL")
def a18(s, d):
    m = ov.mean_metrics(ov.sample_metrics(unique_pixels(s, d), KEY, METRIC_THRESHOLDS))
    return m.select("threshold", *r("accuracy", "iou", "count_diff", "matched", "all_match"))


DOMINANT = """g AS (SELECT image, label_a, label_b, count(*) AS n FROM upixels WHERE label_a <> 0 GROUP BY ALL),
    dm AS (SELECT image, label_a, max_by(label_b, n * 1000 - label_b) FILTER (label_b > 0) AS track_id, max(n) FILTER (label_b > 0) / CAST(sum(n) FILTER (label_b > 0) AS DOUBLE) AS share, count(*) FILTER (label_b > 0) AS k FROM g GROUP BY ALL)"""


@query(
    "a19_dominant_ids",
    f"WITH {DOMINANT} SELECT image, label_a, track_id, round(share, 6) AS share, CASE WHEN k = 0 THEN 'no_track' WHEN k = 1 THEN 'single' WHEN share >= 0.07 THEN 'dominant' ELSE 'ambiguous' END AS reason, k = 1 OR (k > 1 AND share >= 0.07) AS valid FROM dm",
)
def a19(s, d):
    return ov.dominant_ids(unique_pixels(s, d), KEY, 0.07).withColumn("share", F.round("share", 6))


@query(
    "a36_map_rates",
    f"""WITH {DENSE}, {PAIRS}, k AS (SELECT c.dataset, c.timeframe, c.sc_id, count(p.sc_b) AS n FROM dense c LEFT JOIN (SELECT * FROM pairs WHERE iomin > 0.3) p ON p.dataset = c.dataset AND p.timeframe = c.timeframe AND p.sc_a = c.sc_id GROUP BY ALL)
    SELECT dataset, timeframe, count(*) AS n_sources, count(*) FILTER (n > 1) AS n_multi, count(*) FILTER (n = 0) AS n_zero, round(count(*) FILTER (n > 1) / CAST(count(*) AS DOUBLE), 6) AS multi_rate, round(count(*) FILTER (n = 0) / CAST(count(*) AS DOUBLE), 6) AS zero_rate FROM k GROUP BY ALL""",
)
def a36(s, d):
    c = dense(s, d)
    return ov.map_rates(ov.find_maps(ov.frame_pairs(c), c, ov.FRAME), ov.FRAME).select(*ov.FRAME, "n_sources", "n_multi", "n_zero", *r("multi_rate", "zero_rate"))


@query(
    "w10_consensus",
    f"""WITH own AS (SELECT dataset, track_id, timeframe, sc_id, unnest([lead(timeframe, 1) OVER w, lead(timeframe, 2) OVER w, lead(timeframe, 3) OVER w]) AS t FROM cells WINDOW w AS (PARTITION BY dataset, track_id ORDER BY timeframe)),
    h AS (SELECT o.sc_id, o.t, count(b.sc_id) AS n FROM own o JOIN cells a ON a.sc_id = o.sc_id LEFT JOIN cells b ON b.dataset = a.dataset AND b.timeframe = o.t AND {INTER} / CAST({AREA.format('a')} + {AREA.format('b')} - {INTER} AS DOUBLE) > 0.01 WHERE o.t IS NOT NULL GROUP BY ALL)
    SELECT o.dataset, o.track_id, o.timeframe, count(*) AS n, CAST(sum(CASE WHEN h.n = 1 THEN 1 ELSE 0 END) AS BIGINT) AS uniform, NOT sum(CASE WHEN h.n = 1 THEN 1 ELSE 0 END) > count(*) / 2 - 1 AS failed FROM own o JOIN h USING (sc_id, t) GROUP BY ALL""",
)
def w10(s, d):
    c = cells(s, d)
    return ov.consensus(ov.box_pairs(c, c, ["dataset"]), c, 3, 0.01)


@query("x11_adjacency", "WITH p AS (SELECT image, r, c, label_a AS l FROM upixels WHERE label_a <> 0) SELECT a.image, least(a.l, b.l) AS label_1, greatest(a.l, b.l) AS label_2, count(*) AS contacts FROM p a JOIN p b ON a.image = b.image AND a.l <> b.l AND ((a.r = b.r AND b.c = a.c + 1) OR (a.c = b.c AND b.r = a.r + 1)) GROUP BY ALL")
def x11(s, d):
    return ov.adjacency(unique_pixels(s, d), KEY, "label_a")


TOP = "f AS (SELECT image, label_a, label_b FROM ov QUALIFY row_number() OVER (PARTITION BY image, label_a ORDER BY o DESC, label_b) = 1), b AS (SELECT image, label_a, label_b FROM ov QUALIFY row_number() OVER (PARTITION BY image, label_b ORDER BY o DESC, label_a) = 1)"


@query("g5_fusions", f"WITH {OVERLAP}, {TOP} SELECT image, label_b, count(*) AS n, string_agg(CAST(label_a AS VARCHAR), ',' ORDER BY label_a) AS members FROM f GROUP BY ALL HAVING count(*) >= 2")
def g5(s, d):
    g = ov.fusions(ov.label_overlap(unique_pixels(s, d), KEY), KEY)
    return g.withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


LINKS = "links AS (SELECT DISTINCT image, label_a, label_b FROM ov WHERE (label_a * 7 + label_b * 3 + image) % 11 = 0)"
TYPES = f"""{OVERLAP}, {TOP}, {LINKS}, ty AS (SELECT l.*, f.label_b AS best_b, b.label_a AS best_a, CASE WHEN f.label_b = l.label_b AND b.label_a = l.label_a THEN 0 WHEN f.label_b = l.label_b THEN 1 WHEN b.label_a = l.label_a THEN 2 ELSE 3 END AS mol_type
    FROM links l LEFT JOIN f USING (image, label_a) LEFT JOIN b ON b.image = l.image AND b.label_b = l.label_b)"""


def _links(s, d):
    o = ov.label_overlap(unique_pixels(s, d), KEY)
    return o.where("(label_a * 7 + label_b * 3 + image) % 11 = 0").select("image", "label_a", "label_b"), o


@query("g6_link_types", f"WITH {TYPES} SELECT image, label_a, label_b, mol_type FROM ty")
def g6(s, d):
    links, o = _links(s, d)
    return ov.link_types(links, o, KEY).select("image", "label_a", "label_b", "mol_type")


FALSE_LINKS = f"""{TYPES}, na AS (SELECT image, label_a AS best_a, count(*) AS n, min(mol_type) AS m FROM ty GROUP BY ALL), nb AS (SELECT image, label_b AS best_b, count(*) AS n, min(mol_type) AS m FROM ty GROUP BY ALL),
    j AS (SELECT ty.*, best_a IS NOT NULL AND na.n IS NULL AS fa, best_b IS NOT NULL AND nb.n IS NULL AS fb, CASE WHEN na.n = 1 THEN na.m ELSE 0 END AS ka, CASE WHEN nb.n = 1 THEN nb.m ELSE 0 END AS kb FROM ty LEFT JOIN na USING (image, best_a) LEFT JOIN nb USING (image, best_b)),
    fl AS (SELECT image, label_a, label_b, mol_type, CASE mol_type WHEN 0 THEN FALSE WHEN 1 THEN fa WHEN 2 THEN fb ELSE fa OR fb OR ka = 3 OR kb = 3 OR (ka > 0 AND kb > 0) END AS false_link FROM j)"""


@query("g7_false_links", f"WITH {FALSE_LINKS} SELECT * FROM fl")
def g7(s, d):
    return ov.false_links(*_links(s, d), KEY)


@query(
    "g8_groups_to_break",
    f"""WITH {FALSE_LINKS}, gr AS (SELECT image, label_b, list(label_a) AS ms FROM f GROUP BY ALL HAVING count(*) >= 2), e AS (SELECT image, label_b, unnest(ms) AS label_a FROM gr)
    SELECT image, label_b, coalesce(bool_or(coalesce(false_link, TRUE)), TRUE) OR count(*) FILTER (label_a % 9 = 0) >= 2 AS broken, count(*) AS n FROM e LEFT JOIN fl USING (image, label_a, label_b) GROUP BY ALL""",
)
def g8(s, d):
    links, o = _links(s, d)
    edge = o.where("label_a % 9 = 0").select("image", "label_a").distinct()
    return ov.groups_to_break(ov.fusions(o, KEY), ov.false_links(links, o, KEY), edge, KEY)


def _costed(s, d):
    o = ov.label_overlap(unique_pixels(s, d), KEY)
    far = o.withColumn("distance", (F.col("label_a") * 13 + F.col("label_b") * 29) % 200 + 0.0)
    return lk.link_costs(far)


@query(
    "g9_link_costs",
    f"""WITH {OVERLAP} SELECT image, label_a, label_b, round(1 - (o / (2.0 * area_a) + o / (2.0 * area_b)) + d / 150.0 + 0.5 * abs(area_a - area_b) / greatest(area_a, area_b), 6) AS cost
    FROM (SELECT *, (label_a * 13 + label_b * 29) % 200 AS d FROM ov) WHERE d <= 150""",
)
def g9_costs(s, d):
    return _costed(s, d).select("image", "label_a", "label_b", *r("cost"))


@query("g9_optimal_links")
def g9(s, d):
    return lk.optimal_links(_costed(s, d).select("image", F.col("label_a").alias("a"), F.col("label_b").alias("b"), "cost"), KEY)


@query("g10_match_by_iou")
def g10(s, d):
    o = ov.label_overlap(unique_pixels(s, d), KEY)
    return lk.optimal_links(o.select("image", F.col("label_a").alias("a"), F.col("label_b").alias("b"), (-F.col("iou")).alias("cost")), KEY)


def steady(s, d):
    """Cells in boxes that stay with their track and meet no other of the movie."""
    at = lambda k: F.expr(f"track_id * {k} % 960")
    return cells(s, d).withColumn("x1", at(37)).withColumn("y1", at(91)).withColumn("x2", at(37) + 20).withColumn("y2", at(91) + 20)


@query("g11_track_boxes", live_sql(5, "'cell'", columns="CAST(dataset AS BIGINT) AS dataset, CAST(timeframe AS INTEGER) AS timeframe, sc_id, track_id"))
def g11(s, d):
    return tk.track_boxes(steady(s, d), max_age=5, min_hits=1)


CELL = "'cell'"
SWEEP = "CAST(dataset AS BIGINT) AS dataset, track_id, count(*) AS n, max(timeframe) - min(timeframe) + 1 AS span"


@query(
    "g12_tracking_sweep",
    " UNION ALL ".join(f"SELECT {age} AS max_age, count(*) AS n_tracks, CAST(sum(n) AS BIGINT) AS n_cells, round(avg(1 - n / CAST(span AS DOUBLE)), 9) AS mean_missing_rate FROM ({live_sql(age, CELL, columns=SWEEP)} GROUP BY dataset, track_id)" for age in (1, 5)),
)
def g12(s, d):
    return tk.tracking_sweep(steady(s, d), (1, 5), 1).select("max_age", "n_tracks", "n_cells", *r("mean_missing_rate", digits=9))


def moving(s, d):
    """Cells of half-days in boxes that move: in each movie three fields of ten tracks, which turn round at the
    fields' ends, cross and overlap. Steps and places are whole numbers, so that overlaps are often equal."""
    c = tr.last_write_wins(cells(s, d).withColumn("timeframe", F.expr("timeframe div 12")))
    t, u = F.col("timeframe"), F.col("track_id")
    turn = lambda start, step: F.abs(F.pmod(start + t * step, F.lit(400)) - 200)
    x, y = turn(u * 53, (u % 5 - 2) * 3) + u % 3 * 700, turn(u * 29, (u % 7 - 3) * 2)
    side = 24 + u % 2 * 6
    return c.select("dataset", "track_id", "timeframe", "sc_id", x.alias("x1"), y.alias("y1"), (x + side).alias("x2"), (y + side).alias("y2"))


@query("g11_moving_boxes")
def g11_moving(s, d):
    return tk.track_boxes(moving(s, d), max_age=3, min_hits=1)


@query("g12_moving_sweep")
def g12_moving(s, d):
    return tk.tracking_sweep(moving(s, d), (1, 4), 2)


@query(
    "g14_case_types",
    "SELECT sc_id, CASE WHEN i = 1 AND m > 1 THEN 'missing-US' WHEN m >= 1 AND i > 1 THEN 'P/A-US' WHEN m = 1 AND i = 1 THEN 'Both-correct' ELSE 'Others' END AS case_type FROM (SELECT sc_id, sc_id % 4 AS i, sc_id // 4 % 4 AS m FROM cells)",
)
def g14(s, d):
    return lk.case_types(cells(s, d).selectExpr("sc_id", "sc_id % 4 AS n_in", "sc_id div 4 % 4 AS n_missing")).select("sc_id", "case_type")


@query("g1_mothers", "SELECT DISTINCT t.daughter_id AS track_id, e.mother_id, e.mother_id IS NOT NULL AS is_daughter FROM (SELECT daughter_id FROM lineage UNION SELECT mother_id FROM lineage) t LEFT JOIN lineage e USING (daughter_id)")
def g1(s, d):
    e = lineage(s, d)
    return li.mothers(e.select(F.col("daughter_id").alias("track_id")).union(e.select("mother_id")), e)


@query(
    "g2_descendants",
    "WITH w AS (SELECT mother_id AS root_id, daughter_id AS track_id, 1 AS depth FROM lineage UNION ALL SELECT root_id, daughter_id, depth + 1 FROM w JOIN lineage ON mother_id = track_id) SELECT root_id, track_id, depth FROM w",
    recursive=True,
)
def g2(s, d):
    e = lineage(s, d)
    return li.descendants(e, e.select(F.col("mother_id").alias("track_id")).distinct())


@query(
    "g3_lineage_paths",
    "WITH w AS (SELECT CAST(0 AS BIGINT) AS t, '0' AS p UNION ALL SELECT daughter_id, p || '>' || daughter_id FROM w JOIN lineage ON mother_id = t) SELECT p AS path FROM w WHERE t NOT IN (SELECT mother_id FROM lineage)",
    recursive=True,
)
def g3(s, d):
    return li.lineage_paths(s, lineage(s, d), 0).select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(
    "g4_wrong_divisions",
    """WITH v AS (SELECT mother_id, min(daughter_id) % 60 AS frame, list(daughter_id) AS ds FROM lineage WHERE daughter_id % 7 <> 0 GROUP BY ALL UNION ALL SELECT mother_id, 5, list(daughter_id) FROM lineage WHERE mother_id % 11 = 0 GROUP BY ALL),
    o AS (SELECT * FROM v QUALIFY count(*) OVER (PARTITION BY mother_id) = 1), b AS (SELECT unnest(ds) AS mother_id, frame AS born FROM o)
    SELECT mother_id, frame FROM o WHERE mother_id NOT IN (SELECT o.mother_id FROM o JOIN b USING (mother_id) WHERE frame - born < 10)""",
)
def g4(s, d):
    e = lineage(s, d)
    a = e.where("daughter_id % 7 <> 0").groupBy("mother_id").agg((F.min("daughter_id") % 60).alias("frame"), F.collect_list("daughter_id").alias("daughters"))
    b = e.where("mother_id % 11 = 0").groupBy("mother_id").agg(F.lit(5).cast("long").alias("frame"), F.collect_list("daughter_id").alias("daughters"))
    return li.wrong_divisions(a.union(b), 10).select("mother_id", "frame")


# -- geometry -------------------------------------------------------------------------------------


def shapes(s, d):
    """Quadrangles from boxes, one corner moved: a contour with distinct sides."""
    c = cells(s, d)
    p = lambda a, b: F.array(F.expr(a).cast("double"), F.expr(b).cast("double"))
    return c.select("sc_id", "x1", "y1", "x2", "y2", F.array(p("x1", "y1"), p("x1 + 3", "y2"), p("x2", "y2 - 2"), p("x2 - 1", "y1")).alias("contour"))


@query("f1_bbox", "SELECT sc_id, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2, x2 + 1 AS ex2, y2 + 1 AS ey2 FROM cells")
def f1(s, d):
    b = shapes(s, d).select("sc_id", ge.bbox_inclusive("contour").alias("b"), ge.bbox_exclusive("contour").alias("e"))
    return b.select("sc_id", "b.*", F.col("e.x2").alias("ex2"), F.col("e.y2").alias("ey2"))


SIDES = "sqrt(9 + (y2 - y1) ** 2) AS a, sqrt((x2 - x1 - 3) ** 2 + 4) AS b, sqrt(1 + (y2 - 2 - y1) ** 2) AS c, x2 - 1.0 - x1 AS d"


@query("f2_area", "SELECT sc_id, round(abs(s), 6) AS area, round(s, 6) AS signed FROM (SELECT sc_id, (x1 * y2 - (x1 + 3) * y1 + (x1 + 3) * (y2 - 2) - x2 * y2 + x2 * y1 - (x2 - 1) * (y2 - 2) + (x2 - 1) * y1 - x1 * y1) / 2.0 AS s FROM cells)")
def f2(s, d):
    return shapes(s, d).select("sc_id", F.round(ge.area("contour"), 6).alias("area"), F.round(ge.signed_area("contour"), 6).alias("signed"))


@query("f3_length", f"SELECT sc_id, round(a + b + c, 6) AS open_length, round(a + b + c + d, 6) AS closed_length, round(a + b, 6) AS third FROM (SELECT sc_id, {SIDES} FROM cells)")
def f3(s, d):
    c = shapes(s, d)
    return c.select("sc_id", F.round(ge.length("contour"), 6).alias("open_length"), F.round(ge.length("contour", closed=True), 6).alias("closed_length"), F.round(F.get(ge.cumulative("contour"), F.lit(2)), 6).alias("third"))


@query("f4_centroid", "SELECT sc_id, (2 * x1 + 2 * x2 + 2) / 4.0 AS x, (2 * y1 + 2 * y2 - 2) / 4.0 AS y, (x1 + x2) / 2.0 AS cx, (y1 + y2) / 2.0 AS cy, x2 - x1 AS h, y2 - y1 AS w, round((x2 - x1) / CAST(y2 - y1 AS DOUBLE), 6) AS aspect FROM cells")
def f4(s, d):
    c = shapes(s, d).select("sc_id", ge.centroid("contour").alias("m"), ge.box_shape("x1", "y1", "x2", "y2").alias("b"))
    return c.select("sc_id", "m.*", "b.*").withColumn("aspect", F.round("aspect", 6))


@query("f6_pad_box", "SELECT sc_id, greatest(x1 - 20, 0) AS x1, greatest(y1 - 20, 0) AS y1, least(x2 + 20, 980) AS x2, least(y2 + 20, 980) AS y2 FROM cells")
def f6(s, d):
    return cells(s, d).select("sc_id", ge.pad_box("x1", "y1", "x2", "y2", 20, 980, 980).alias("b")).select("sc_id", "b.*")


@query("f7_box_forms", "SELECT sc_id, y1 AS x, x1 AS y, y2 - y1 AS w, x2 - x1 AS h, CAST((x2 - x1) * (y2 - y1) AS BIGINT) AS s, x1 AS back FROM cells")
def f7(s, d):
    c = cells(s, d).select("sc_id", ge.box_xywh("x1", "y1", "x2", "y2").alias("b"), ge.box_state("x1", "y1", "x2", "y2").alias("z"))
    back = F.round(ge.state_box("z.x", "z.y", "z.s", "z.r")["x1"], 6).cast("long")
    return c.select("sc_id", "b.*", F.col("z.s").alias("s"), back.alias("back"))


@query("f8_crop_coordinates", "SELECT sc_id, CAST(2.0 AS DOUBLE) AS first_row, CAST(least(y2, 899) AS DOUBLE) AS clipped_col, x2 < 900 AND y2 < 900 AS inside FROM (SELECT sc_id, x1, x2, y1, y2 FROM cells)")
def f8(s, d):
    c = shapes(s, d)
    first = F.get(F.get(ge.shifted("contour", 2 - F.col("x1"), -F.col("y1")), F.lit(0)), F.lit(0))
    return c.select("sc_id", first.alias("first_row"), F.get(F.get(ge.clipped("contour", 900, 900), F.lit(1)), F.lit(1)).alias("clipped_col"), ge.in_bounds("contour", 900, 900).alias("inside"))


@query("f11_subsample", "SELECT sc_id, CASE WHEN 4 // k < 1 THEN 4 ELSE CAST(ceil(4.0 / greatest(1, 4 // k)) AS INTEGER) END AS n, CAST(x2 AS DOUBLE) AS start_row FROM (SELECT sc_id, x2, 3 AS k FROM cells)")
def f11(s, d):
    c = shapes(s, d)
    return c.select("sc_id", F.size(ge.subsample("contour", 3)).alias("n"), F.get(F.get(ge.rotated_start("contour", 2), F.lit(0)), F.lit(0)).alias("start_row"))


@query("f12_square", "SELECT sc_id, CAST(greatest(x1 - 10, 0) AS DOUBLE) AS x1, CAST(greatest(y1 - 10, 0) AS DOUBLE) AS y1, CAST(least(x1 + 10, 949) AS DOUBLE) AS x2, CAST(least(y1 + 10, 949) AS DOUBLE) AS y2 FROM cells")
def f12(s, d):
    c = cells(s, d).select("sc_id", ge.bbox_inclusive(ge.square_around("x1", "y1", 20, 950, 950)).alias("b"))
    return c.select("sc_id", "b.*")


@query("f17_onehot", "SELECT sc_id, CASE sc_id % 4 WHEN 0 THEN 'overseg' WHEN 1 THEN 'underseg' WHEN 2 THEN 'dropout' ELSE 'correct' END AS label FROM cells")
def f17(s, d):
    v = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (i == F.col("sc_id") % 4).cast("int"))
    return cells(s, d).select("sc_id", ge.onehot_name(v).alias("label"))


@query("f18_diff_mask", "SELECT image, CAST((label_a > 0) AS INTEGER) - CAST((label_b > 0) AS INTEGER) AS diff, count(*) AS n FROM upixels GROUP BY ALL")
def f18(s, d):
    diff = (F.col("label_a") > 0).cast("int") - (F.col("label_b") > 0).cast("int")
    return unique_pixels(s, d).groupBy("image", diff.alias("diff")).agg(F.count("*").alias("n"))


@query("f21_ordered_contours", "SELECT sc_id, area, row_number() OVER (PARTITION BY dataset ORDER BY area DESC, sc_id) AS k FROM (SELECT sc_id, dataset, round(abs(x1 * y2 - (x1 + 3) * y1 + (x1 + 3) * (y2 - 2) - x2 * y2 + x2 * y1 - (x2 - 1) * (y2 - 2) + (x2 - 1) * y1 - x1 * y1) / 2.0, 6) AS area FROM cells) WHERE area BETWEEN 100 AND 800")
def f21(s, d):
    from pyspark.sql import Window

    c = shapes(s, d).join(cells(s, d).select("sc_id", "dataset"), "sc_id").withColumn("contour", ge.oriented("contour"))
    c = c.withColumn("area", F.round(ge.signed_area("contour"), 6)).where("area BETWEEN 100 AND 800")
    return c.select("sc_id", "area", F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc("area"), "sc_id")).cast("long").alias("k"))

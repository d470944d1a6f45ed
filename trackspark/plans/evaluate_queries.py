"""Queries over experiments, classifications and selections (A13 to A40, O)."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackspark.operators import evaluate as ev

from .adapters import cells, features, predictions, runs, unique_pixels
from .base import query

FS = [f"f{i}" for i in range(64)]


def r(*names, digits=6):
    return [F.round(n, digits).alias(n) for n in names]


@query("a13_normalized", "SELECT vec_id, " + ", ".join(f"round(({f} - avg({f}) OVER ()) / stddev_samp({f}) OVER (), 5) AS {f}" for f in FS) + " FROM feats")
def a13(s, d):
    return ev.normalized_features(features(s, d), FS).select("vec_id", *r(*FS, digits=5))


@query("a40_zscore", "SELECT vec_id, " + ", ".join(f"round(({f} - avg({f}) OVER ()) / stddev_pop({f}) OVER (), 5) AS {f}" for f in FS) + " FROM feats")
def a40(s, d):
    return ev.zscore(features(s, d), FS).select("vec_id", *r(*FS, digits=5))


@query(
    "a14_correlations",
    "WITH c AS (" + " UNION ALL ".join(f"SELECT 'f{i}' AS dim, 'f{j}' AS feature, corr(f{i}, f{j}) AS corr FROM feats" for i in range(3) for j in range(3, 64)) + ") SELECT dim, feature, round(corr, 6) AS corr, row_number() OVER (PARTITION BY dim ORDER BY abs(corr) DESC, feature) - 1 AS rank FROM c",
)
def a14(s, d):
    c = ev.correlations(features(s, d), FS[:3], FS[3:])
    return c.select("dim", "feature", *r("corr"), F.col("rank").cast("long").alias("rank"))


@query("w13_rank_per_key", "SELECT track_id, sc_id, area, row_number() OVER (PARTITION BY dataset, track_id ORDER BY area DESC, sc_id) - 1 AS rank FROM cells")
def w13(s, d):
    c = ev.rank_per_key(cells(s, d), ["dataset", "track_id"], F.desc("area"), "sc_id")
    return c.select("track_id", "sc_id", "area", F.col("rank").cast("long").alias("rank"))


@query("a15_pca_variance")
def a15(s, d):
    return ev.principal_components(features(s, d), FS, 5, "vec_id")[1]


@query("a15_pca_scores")
def a15_scores(s, d):
    return ev.principal_components(features(s, d), FS, 3, "vec_id")[0]


@query(
    "a20_curation",
    """WITH q AS (SELECT dataset, status AS reason, sc_id % 3 = 0 AS match_quality, area > 10 AS valid FROM cells)
    SELECT 'total' AS grouped_by, 'all' AS key, count(*) AS n, count(*) FILTER (valid) AS n_valid FROM q UNION ALL SELECT 'dataset', CAST(dataset AS VARCHAR), count(*), count(*) FILTER (valid) FROM q GROUP BY dataset
    UNION ALL SELECT 'reason', reason, count(*), count(*) FILTER (valid) FROM q GROUP BY reason UNION ALL SELECT 'match_quality', CAST(match_quality AS VARCHAR), count(*), count(*) FILTER (valid) FROM q GROUP BY match_quality""",
)
def a20(s, d):
    return ev.curation_stats(cells(s, d).selectExpr("dataset", "status AS reason", "sc_id % 3 = 0 AS match_quality", "area > 10 AS valid"))


FINAL = "fin AS (SELECT strategy, run_id, max_by(test_iou, iteration) AS v, max_by(labeled_samples, iteration) AS ls FROM runs GROUP BY ALL)"


@query("a21_strategy_summary", f"WITH {FINAL} SELECT strategy, count(*) AS n_runs, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max, avg(ls) AS mean_samples, round(avg(v) - 1.96 * stddev_samp(v) / sqrt(count(*)), 6) AS ci_low, round(avg(v) + 1.96 * stddev_samp(v) / sqrt(count(*)), 6) AS ci_high FROM fin GROUP BY ALL")
def a21(s, d):
    t = ev.strategy_summary(runs(s, d))
    return t.select("strategy", "n_runs", *r("mean", "std", "min", "max"), "mean_samples", *r("ci_low", "ci_high"))


@query("a22_population_summary", f"WITH {FINAL} SELECT strategy, round(stddev_pop(v), 6) AS std FROM fin GROUP BY ALL")
def a22(s, d):
    return ev.strategy_summary(runs(s, d), population=True).select("strategy", *r("std"))


@query("a23_learning_curve", "SELECT strategy, iteration, round(avg(test_iou), 9) AS mean, round(stddev_samp(test_iou), 9) AS std, avg(labeled_samples) AS mean_samples, count(*) AS n FROM runs GROUP BY ALL")
def a23(s, d):
    return ev.learning_curve(runs(s, d)).select("strategy", "iteration", *r("mean", "std", digits=9), "mean_samples", "n")


@query("a24_run_summary", "SELECT strategy, run_id, round(max(test_iou), 6) AS best_iou, round(max_by(test_iou, iteration), 6) AS final_iou, count(*) AS n_iterations, max_by(labeled_samples, iteration) AS final_samples FROM runs GROUP BY ALL")
def a24(s, d):
    return ev.run_summary(runs(s, d)).select("strategy", "run_id", *r("best_iou", "final_iou"), "n_iterations", "final_samples")


def _cases(s, d):
    return cells(s, d).selectExpr("timeframe div 200 AS round", "status AS case_type", "CASE WHEN sc_id % 3 = 0 THEN 'fixed' ELSE 'skipped' END AS state")


CASES = "cs AS (SELECT timeframe // 200 AS round, status AS case_type, CASE WHEN sc_id % 3 = 0 THEN 'fixed' ELSE 'skipped' END AS state FROM cells)"


@query("a25_case_counts", f"WITH {CASES} SELECT CAST(round AS BIGINT) AS round, case_type, state, count(*) AS n, CAST(grouping(round, case_type, state) AS BIGINT) AS level FROM cs GROUP BY ROLLUP (round, case_type, state)")
def a25(s, d):
    return ev.case_counts(_cases(s, d), ["error", "signup"])[0]


@query("a25_fixed_cases", f"WITH {CASES} SELECT CAST(round AS BIGINT) AS round, count(*) FILTER (case_type = 'error') AS error, count(*) FILTER (case_type = 'signup') AS signup FROM cs WHERE state = 'fixed' GROUP BY round")
def a25_fixed(s, d):
    return ev.case_counts(_cases(s, d), ["error", "signup"])[1]


@query("a26_confusion", "SELECT label_index AS label, prediction AS pred, count(*) AS n FROM preds GROUP BY ALL")
def a26(s, d):
    return ev.confusion(predictions(s, d))


REPORT = """cf AS (SELECT label_index AS l, prediction AS p, count(*) AS n FROM preds GROUP BY ALL), cl AS (SELECT DISTINCT unnest([l, p]) AS class FROM cf),
  rp AS (SELECT class, support, predicted, tp, CASE WHEN predicted = 0 THEN 0 ELSE tp / CAST(predicted AS DOUBLE) END AS pr, CASE WHEN support = 0 THEN 0 ELSE tp / CAST(support AS DOUBLE) END AS re FROM (
  SELECT class, coalesce((SELECT CAST(sum(n) AS BIGINT) FROM cf WHERE l = class), 0) AS support, coalesce((SELECT CAST(sum(n) AS BIGINT) FROM cf WHERE p = class), 0) AS predicted, coalesce((SELECT CAST(sum(n) AS BIGINT) FROM cf WHERE p = class AND l = class), 0) AS tp FROM cl)),
  rq AS (SELECT *, CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END AS f1 FROM rp)"""


@query("a26_class_report", f"WITH {REPORT} SELECT class, support, predicted, tp, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1 FROM rq")
def a26_report(s, d):
    return ev.class_report(predictions(s, d)).select("class", "support", "predicted", "tp", *r("precision", "recall", "f1"))


@query("a27_overall_report", f"WITH {REPORT} SELECT round(sum(tp) / CAST(sum(support) AS DOUBLE), 6) AS accuracy, round(avg(re) FILTER (support > 0), 6) AS macro_recall, round(sum(pr * support) / sum(support), 6) AS weighted_precision, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM rq")
def a27(s, d):
    return ev.overall_report(ev.class_report(predictions(s, d))).select(*r("accuracy", "macro_recall", "weighted_precision", "weighted_f1"))


@query(
    "a28_accuracy_by",
    "WITH o AS (SELECT *, CASE WHEN label_index = prediction THEN 1.0 ELSE 0.0 END AS ok FROM preds) SELECT grouped_by, key, round(avg(ok), 6) AS accuracy, count(*) AS n FROM (SELECT 'padding' AS grouped_by, CAST(padding AS VARCHAR) AS key, ok FROM o UNION ALL SELECT 'src_dir', src_dir, ok FROM o UNION ALL SELECT 'frame_idx', CAST(frame_idx AS VARCHAR), ok FROM o UNION ALL SELECT 'frame_clipped', CAST(least(frame_idx, 12) AS VARCHAR), ok FROM o) GROUP BY ALL",
)
def a28(s, d):
    return ev.accuracy_by(predictions(s, d), ["padding", "src_dir", "frame_idx"]).select("grouped_by", "key", *r("accuracy"), "n")


@query("a29_value_counts", "SELECT src_dir, count(*) AS n FROM preds GROUP BY ALL")
def a29(s, d):
    return ev.value_counts(predictions(s, d), "src_dir")


@query("a31_distinct_counts", "SELECT count(DISTINCT track_id) AS n_track_id, count(DISTINCT sc_id) AS n_sc_id, count(DISTINCT status) AS n_status FROM cells")
def a31(s, d):
    return ev.distinct_counts(cells(s, d), ["track_id", "sc_id", "status"])


@query("a34_draw_variance", "SELECT item, round(avg(v), 6) AS uncertainty FROM (SELECT image AS item, r, c, var_samp(value / 50 + k * 0.01 * (r % 7)) AS v FROM upixels, unnest([1, 2, 4]) u(k) GROUP BY ALL) GROUP BY ALL")
def a34(s, d):
    draws = unique_pixels(s, d).withColumn("draw", F.explode(F.array(F.lit(1), F.lit(2), F.lit(4))))
    draws = draws.select(F.col("image").alias("item"), "r", "c", "draw", (F.col("value") / 50 + F.col("draw") * 0.01 * (F.col("r") % 7)).alias("p"))
    return ev.draw_variance(draws).select("item", *r("uncertainty"))


@query("a35_binary_entropy", "SELECT image AS item, round(-sum(p * log2(p + 1e-30) + (1 - p) * log2(1 - p + 1e-30)) / count(*) FILTER (p <> 0), 6) AS entropy FROM (SELECT image, (value - 1) / 50 AS p FROM upixels) GROUP BY ALL")
def a35(s, d):
    return ev.binary_entropy(unique_pixels(s, d).selectExpr("image AS item", "(value - 1) / 50 AS p")).select("item", *r("entropy"))


@query("o2_most_uncertain", "SELECT sc_id, area FROM cells ORDER BY area DESC, sc_id LIMIT 50")
def o2(s, d):
    return ev.top_k(cells(s, d), 50, F.desc("area"), "sc_id").select("sc_id", "area")


@query("o3_evenly_spaced", "SELECT sc_id, timeframe FROM (SELECT *, row_number() OVER (ORDER BY timeframe, sc_id) - 1 AS k, count(*) OVER () AS n FROM cells) WHERE k % greatest(1, n // 40) = 0 AND k < greatest(1, n // 40) * 40")
def o3(s, d):
    return ev.evenly_spaced(cells(s, d), 40, "timeframe", "sc_id").select("sc_id", "timeframe")


def hashed(column: str, seed: int) -> str:
    return f"CAST('0x' || substr(md5(CAST({column} AS VARCHAR) || ':{seed}'), 1, 8) AS BIGINT)"


@query("o4_random_k", f"SELECT sc_id, area FROM cells ORDER BY {hashed('sc_id', 7)}, sc_id LIMIT 100")
def o4(s, d):
    return ev.random_k(cells(s, d).select("sc_id", "area"), 100, "sc_id", 7)


@query(
    "o5_pareto_front",
    "WITH p AS (SELECT vec_id, f0, f1 FROM feats) SELECT vec_id, 1 AS pareto_rank FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.f0 >= a.f0 AND b.f1 >= a.f1 AND (b.f0 > a.f0 OR b.f1 > a.f1))",
)
def o5(s, d):
    return ev.pareto_ranks(features(s, d), "vec_id", ["f0", "f1"], 3).where("pareto_rank = 1").select("vec_id", "pareto_rank")


FRONT = "SELECT a.* FROM {0} a WHERE NOT EXISTS (SELECT 1 FROM {0} b WHERE b.f0 >= a.f0 AND b.f1 >= a.f1 AND b.f2 >= a.f2 AND (b.f0 > a.f0 OR b.f1 > a.f1 OR b.f2 > a.f2))"


@query(
    "o5_pareto_ranks",
    f"""WITH p1 AS (SELECT vec_id, f0, f1, f2 FROM feats), r1 AS ({FRONT.format('p1')}), p2 AS (SELECT * FROM p1 WHERE vec_id NOT IN (SELECT vec_id FROM r1)), r2 AS ({FRONT.format('p2')}),
    p3 AS (SELECT * FROM p2 WHERE vec_id NOT IN (SELECT vec_id FROM r2)), r3 AS ({FRONT.format('p3')})
    SELECT *, 1 AS pareto_rank FROM r1 UNION ALL SELECT *, 2 FROM r2 UNION ALL SELECT *, 3 FROM r3""",
)
def o5_ranks(s, d):
    return ev.pareto_ranks(features(s, d), "vec_id", ["f0", "f1", "f2"], 3)


def split_sql(table: str, id_col: str, stratum: str, rule: str) -> str:
    return f"""SELECT {id_col}, {stratum}, CASE WHEN n = 1 THEN 'train' {rule} END AS split FROM (SELECT {id_col}, {stratum}, count(*) OVER (PARTITION BY {stratum}) AS n,
      (row_number() OVER (PARTITION BY {stratum} ORDER BY {hashed(id_col, 0)}, {id_col}) - 1) / CAST(count(*) OVER (PARTITION BY {stratum}) AS DOUBLE) AS p FROM {table})"""


@query("o6_stratified_split", split_sql("cells", "sc_id", "status", "WHEN p < 0.7 THEN 'train' WHEN p < 0.7::DOUBLE + 0.15::DOUBLE THEN 'val' ELSE 'test'"))
def o6(s, d):
    return ev.stratified_split(cells(s, d).select("sc_id", "status"), "sc_id", "status")


@query("o7_class_split", split_sql("preds", "doc_id", "label_index", "WHEN p < 0.8 THEN 'train' ELSE 'test'"))
def o7(s, d):
    return ev.stratified_split(predictions(s, d).select("doc_id", "label_index"), "doc_id", "label_index", (("train", 0.8), ("test", 0.2)))


@query("o9_best_sources", "SELECT src_dir, round(accuracy, 6) AS accuracy FROM (SELECT src_dir, avg(CASE WHEN label_index = prediction THEN 1.0 ELSE 0.0 END) AS accuracy FROM preds GROUP BY ALL) ORDER BY accuracy DESC, src_dir LIMIT 5")
def o9(s, d):
    a = predictions(s, d).groupBy("src_dir").agg(F.avg((F.col("label_index") == F.col("prediction")).cast("double")).alias("accuracy"))
    return ev.top_k(a, 5, F.desc("accuracy"), "src_dir").select("src_dir", *r("accuracy"))

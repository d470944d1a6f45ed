"""Experiment and classification statistics, selections and splits (A13 to A15, A20 to A29, A31, A34, A35,
A40, O2 to O9)."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackspark.functions.ranks import ranked
from trackspark.schema import extended

# -- tables of features ---------------------------------------------------------------------------


def _standardised(df: DataFrame, columns: list[str], deviation) -> DataFrame:
    """Mean and deviation of all columns in one aggregate; its single row is broadcast."""
    stats = df.agg(*[F.avg(c).alias(f"__m_{c}") for c in columns], *[deviation(c).alias(f"__d_{c}") for c in columns])
    scaled = {c: (F.col(c) - F.col(f"__m_{c}")) / F.when(F.coalesce(F.col(f"__d_{c}"), F.lit(0.0)) == 0, 1.0).otherwise(F.col(f"__d_{c}")) for c in columns}
    return df.join(F.broadcast(stats)).withColumns(scaled).drop(*stats.columns)


def normalized_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """Less the mean, over the sample deviation unless that is 0 or missing. List ``t`` among the
    columns to scale time too, as the feature table does."""
    return _standardised(df, columns, F.stddev_samp)


def zscore(df: DataFrame, columns: list[str]) -> DataFrame:
    """With the population deviation; constant columns become 0."""
    return _standardised(df, columns, F.stddev_pop)


def correlations(df: DataFrame, dims: list[str], features: list[str], by_abs: bool = True) -> DataFrame:
    """(dim, feature, corr, rank from 0); NaN counts as missing, pairs need both. Batches of rows become a
    matrix of each kind of sum; a task gives one row per pair, and these are summed."""
    names = list(dict.fromkeys([*dims, *features]))
    clean = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    mean = df.agg(*[F.avg(clean(c)) for c in names]).first()  # sums about the mean stay small
    mean = {c: 0.0 if m is None else m for c, m in zip(names, mean)}

    def sums(batches):
        total = np.zeros((6, len(dims), len(features)))
        for b in batches:
            part = lambda cs: np.stack([b[c].to_numpy(float) - mean[c] for c in cs], 1)  # noqa: B023, E731
            x, y = part(dims), part(features)
            p, q = (~np.isnan(x)).astype(float), (~np.isnan(y)).astype(float)
            x, y = np.nan_to_num(x), np.nan_to_num(y)
            total += np.stack([p.T @ q, x.T @ q, p.T @ y, (x * x).T @ q, p.T @ (y * y), x.T @ y])
        yield pd.DataFrame({"dim": np.repeat(dims, len(features)), "feature": np.tile(features, len(dims)), **{k: t.ravel() for k, t in zip(("n", "x", "y", "xx", "yy", "xy"), total)}})

    rows = df.select(*[clean(c).alias(c) for c in names]).mapInPandas(sums, "dim string, feature string, n double, x double, y double, xx double, yy double, xy double")
    t = rows.groupBy("dim", "feature").agg(*[F.sum(k).alias(k) for k in ("n", "x", "y", "xx", "yy", "xy")])
    part = lambda a, b, c: F.col(c) - F.try_divide(F.col(a) * F.col(b), F.col("n"))
    corr = F.try_divide(part("x", "y", "xy"), F.sqrt(part("x", "x", "xx") * part("y", "y", "yy")))
    key = F.abs("corr") if by_abs else F.col("corr")
    return rank_per_key(t.select("dim", "feature", corr.alias("corr")), ["dim"], key.desc_nulls_last(), "feature")


def rank_per_key(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """Features or candidates of each key in order, rank from 0."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def covariance(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means and the sample covariance matrix. Batches of rows become a matrix of products each; what a task has
    is one row per pair of columns, and these are summed: the driver gets as many rows as the matrix has."""
    n = len(columns)
    row = df.agg(F.count("*"), *[F.avg(c) for c in columns]).first()
    mean = np.array([x if x is not None else np.nan for x in row[1:]], float)

    def products(batches):
        total = np.zeros((n, n))
        for b in batches:
            v = b[columns].to_numpy(float) - mean
            total += v.T @ v
        yield pd.DataFrame({"i": np.repeat(np.arange(n), n), "j": np.tile(np.arange(n), n), "s": total.ravel()})

    sums = df.select(*columns).mapInPandas(products, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    out = np.zeros((n, n))
    for i, j, x in sums:
        out[i, j] = x
    return mean, out / max(row[0] - 1, 1)


def principal_axes(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a covariance matrix, the largest first, and vectors as columns; the largest loading of each
    is positive."""
    values, vectors = np.linalg.eigh(cov)
    values, vectors = np.clip(values[::-1], 0, None), vectors[:, ::-1]
    sign = np.sign(np.take_along_axis(vectors, np.abs(vectors).argmax(0)[None], 0))
    return values, vectors * np.where(sign == 0, 1, sign)


def principal_components(df: DataFrame, columns: list[str], k: int, id_col: str) -> tuple[DataFrame, DataFrame]:
    """Scores (id, pc1, ...) and explained variance (component, ratio, cumulative). The small matrix is
    solved on the driver. The largest loading is positive."""
    mean, cov = covariance(df, columns)
    values, vectors = principal_axes(cov)
    terms = lambda i: reduce(lambda a, b: a + b, [(F.col(c) - float(m)) * float(w) for c, m, w in zip(columns, mean, vectors[:, i])])
    scores = df.select(id_col, *[terms(i).alias(f"pc{i + 1}") for i in range(k)])
    ratio = values / values.sum()
    rows = [(i + 1, float(ratio[i]), float(ratio[: i + 1].sum())) for i in range(k)]
    return scores, df.sparkSession.createDataFrame(rows, "component int, ratio double, cumulative double")


# -- experiment logs ------------------------------------------------------------------------------


def final_values(runs: DataFrame) -> DataFrame:
    """The last row of each run."""
    last = F.max_by(F.struct("test_iou", "labeled_samples"), "iteration")
    return runs.groupBy("strategy", "run_id").agg(last.alias("l"), F.max("iteration").alias("iterations")).select("strategy", "run_id", "l.*", "iterations")


def strategy_summary(runs: DataFrame, population: bool = False) -> DataFrame:
    """Final values per strategy, sample deviation and a 95 % interval of 1.96 deviations over the root
    of the number of runs. A22: with the population deviation."""
    dev = (F.stddev_pop if population else F.stddev_samp)("test_iou")
    s = final_values(runs).groupBy("strategy").agg(
        F.count("*").alias("n_runs"), F.avg("test_iou").alias("mean"), dev.alias("std"), F.min("test_iou").alias("min"), F.max("test_iou").alias("max"), F.avg("labeled_samples").alias("mean_samples")
    )
    half = 1.96 * F.col("std") / F.sqrt("n_runs")
    return s.withColumn("ci_low", F.col("mean") - half).withColumn("ci_high", F.col("mean") + half)


def learning_curve(runs: DataFrame) -> DataFrame:
    """A23."""
    return runs.groupBy("strategy", "iteration").agg(F.avg("test_iou").alias("mean"), F.stddev_samp("test_iou").alias("std"), F.avg("labeled_samples").alias("mean_samples"), F.count("*").alias("n"))


def run_summary(runs: DataFrame) -> DataFrame:
    """A24."""
    return runs.groupBy("strategy", "run_id").agg(
        F.max("test_iou").alias("best_iou"), F.max_by("test_iou", "iteration").alias("final_iou"), F.count("*").alias("n_iterations"), F.max_by("labeled_samples", "iteration").alias("final_samples")
    )


def curation_stats(samples: DataFrame, value: str = "valid", by: tuple[str, ...] = ("dataset", "reason", "match_quality")) -> DataFrame:
    """Totals and valid ones overall and by each column, in one pass of grouping sets."""
    g = samples.groupingSets([[], *[[F.col(b)] for b in by]], *[F.col(b) for b in by])
    level = F.grouping_id(*by)
    out = g.agg(level.alias("__g"), F.count("*").alias("n"), F.count_if(value).alias("n_valid"))
    label = F.when(F.col("__g") == 2 ** len(by) - 1, "total")
    for i, b in enumerate(by):
        label = label.when(F.col("__g") == 2 ** len(by) - 1 - 2 ** (len(by) - 1 - i), b)
    return out.select(label.alias("grouped_by"), F.coalesce(*[F.col(b).cast("string") for b in by], F.lit("all")).alias("key"), "n", "n_valid")


def case_counts(cases: DataFrame, types: list[str]) -> tuple[DataFrame, DataFrame]:
    """Counts by (round, case_type, state) with totals rolled up, and fixed cases by round, one column
    a type, 0 where there is none."""
    rolled = cases.rollup("round", "case_type", "state").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
    fixed = cases.where("state = 'fixed'").groupBy("round").pivot("case_type", types).count().fillna(0, types)
    return rolled, fixed


# -- classification -------------------------------------------------------------------------------


def confusion(preds: DataFrame, label: str = "label_index", pred: str = "prediction") -> DataFrame:
    """A26."""
    return preds.groupBy(F.col(label).alias("label"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def class_report(preds: DataFrame, label: str = "label_index", pred: str = "prediction") -> DataFrame:
    """Per class support, predicted, precision, recall (the class's accuracy) and F1; 0 / 0 is 0.
    From the counts of the confusion matrix, which are few."""
    c = confusion(preds, label, pred)
    side = lambda s, n: c.groupBy(F.col(s).alias("class")).agg(F.sum("n").alias(n))
    hits = c.where("label = pred").select(F.col("label").alias("class"), F.col("n").alias("tp"))
    t = side("label", "support").join(side("pred", "predicted"), "class", "full").join(hits, "class", "left").fillna(0)
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    t = t.withColumn("precision", zero(F.col("tp"), F.col("predicted"))).withColumn("recall", zero(F.col("tp"), F.col("support")))
    return t.withColumn("f1", zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def overall_report(report: DataFrame) -> DataFrame:
    """Accuracy, macro mean of recalls of classes that occur, weighted precision and F1."""
    w = lambda c: F.sum(F.col(c) * F.col("support")) / F.sum("support")
    return report.agg((F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("macro_recall"), w("precision").alias("weighted_precision"), w("f1").alias("weighted_f1"))


def accuracy_by(preds: DataFrame, by: list[str], frame_clip: int = 12) -> DataFrame:
    """Accuracy by each column, and by frame index cut at ``frame_clip``, in one pass."""
    p = preds.withColumn("frame_clipped", F.least("frame_idx", F.lit(frame_clip))).withColumn("ok", (F.col("label_index") == F.col("prediction")).cast("double"))
    every = [*by, "frame_clipped"]
    keys = F.array(*[F.struct(F.lit(b).alias("grouped_by"), F.col(b).cast("string").alias("key")) for b in every])
    return p.select("ok", F.explode(keys).alias("k")).groupBy("k.grouped_by", "k.key").agg(F.avg("ok").alias("accuracy"), F.count("*").alias("n"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """A29."""
    return df.groupBy(column).agg(F.count("*").alias("n"))


def distinct_counts(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """Exact, or by mergeable sketches."""
    f = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(*[f(c).alias(f"n_{c}") for c in columns])


# -- uncertainty ----------------------------------------------------------------------------------


def draw_variance(draws: DataFrame) -> DataFrame:
    """Draws (item, r, c, draw, p): sample variance over draws per pixel, its mean per item."""
    return draws.groupBy("item", "r", "c").agg(F.var_samp("p").alias("v")).groupBy("item").agg(F.avg("v").alias("uncertainty"))


def binary_entropy(probs: DataFrame) -> DataFrame:
    """Probs (item, p): minus the sum of p log p + (1 - p) log (1 - p), base 2, over the number of
    non-zero p."""
    p, e = F.col("p"), 1e-30
    h = -(p * F.log2(p + e) + (1 - p) * F.log2(1 - p + e))
    return probs.groupBy("item").agg(F.try_divide(F.sum(h), F.count_if(p != 0)).alias("entropy"))


# -- selections -----------------------------------------------------------------------------------


def top_k(df: DataFrame, k: int, *order) -> DataFrame:
    """The first k of an order, kept per partition before they meet."""
    return df.orderBy(*order).limit(k)


def evenly_spaced(df: DataFrame, k: int, time: str, id_col: str) -> DataFrame:
    """O3: in order of time, every step-th row, step = max(1, n // k), the first k of these. Rows are ranked by
    ranges, so that neither one time nor the table is one task's work."""
    step = max(1, df.count() // k)
    r = ranked(df, [], [time, id_col], "__r")
    return r.where((F.col("__r") % step == 0) & (F.col("__r") < step * k)).drop("__r")


def hash_key(column: str | Column, seed: int) -> Column:
    """A number in 0 .. 2^32 - 1 from a value and a seed, the same in every run: the front of an MD5 digest."""
    value = F.col(column) if isinstance(column, str) else column
    text = F.concat_ws(":", value.cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def random_k(df: DataFrame, k: int, id_col: str, seed: int = 0) -> DataFrame:
    """The k rows with the least hash of id and seed; the same in every run."""
    return df.withColumn("__h", hash_key(id_col, seed)).orderBy("__h", id_col).limit(k).drop("__h")


def pareto_ranks(df: DataFrame, id_col: str, objectives: list[str], n_fronts: int, fan: int = 16) -> DataFrame:
    """The first ``n_fronts`` fronts (rank from 1), all objectives maximised. A partition first drops
    what its own rows dominate too often; what is left meets in ever fewer partitions, which do the same,
    and the last is peeled front by front.

    A row of front f has a chain of f - 1 rows above it; a row with ``n_fronts`` such above it in its own
    partition cannot be among the first fronts."""
    schema = df.select(id_col, *objectives).schema
    ranked = extended(schema, pareto_rank="int")

    def peel(v: np.ndarray) -> np.ndarray:
        rank, left = np.zeros(len(v), np.int32), np.arange(len(v))
        for r in range(1, n_fronts + 1):
            front = _front(v[left])
            rank[left[front]] = r
            left = left[~front]
            if not len(left):
                break
        return rank

    def local(parts):
        kept = None
        for pdf in parts:
            both = pdf if kept is None else pd.concat([kept, pdf])
            kept = both[peel(both[objectives].to_numpy(float)) > 0]
        if kept is not None:
            yield kept

    def last(parts):
        for pdf in local(parts):
            yield pdf.assign(pareto_rank=peel(pdf[objectives].to_numpy(float)))

    thin, parts = df.select(id_col, *objectives).mapInPandas(local, schema), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while parts > 1:
        parts = -(-parts // fan)
        thin = thin.repartition(parts).mapInPandas(local if parts > 1 else last, schema if parts > 1 else ranked)
    return thin if "pareto_rank" in thin.columns else thin.repartition(1).mapInPandas(last, ranked)


def _front(v: np.ndarray) -> np.ndarray:
    """Rows that no other row dominates: sorted by sum, a dominating row comes first."""
    order = np.argsort(-v.sum(1), kind="stable")
    front, found = np.zeros(len(v), bool), np.zeros((0, v.shape[1]))
    for i in order:
        if not ((found >= v[i]).all(1) & (found > v[i]).any(1)).any():
            front[i] = True
            found = np.concatenate([found, v[i : i + 1]])
    return front


def stratified_split(df: DataFrame, id_col: str, stratum: str, shares: tuple[tuple[str, float], ...] = (("train", 0.7), ("val", 0.15), ("test", 0.15)), seed: int = 0, bucket_rows: int = 50_000) -> DataFrame:
    """Rows of each stratum in order of a hash, cut at the shares; a stratum of one row goes to the
    first part. A stratum is dealt over as many ranges of the hash as its rows ask for, so a large one is
    not ranked in one task: counts of ranges and places inside them give the rank."""
    sizes = df.groupBy(F.col(stratum).alias("__of")).agg(F.ceil(F.count("*") / bucket_rows).alias("__k"))
    h = df.withColumn("__h", hash_key(id_col, seed)).join(sizes, F.col(stratum).eqNullSafe(F.col("__of")))
    h = h.withColumn("__b", F.shiftright(F.col("__h") * F.col("__k"), 32)).drop("__of", "__k")
    per = h.groupBy(stratum, "__b").agg(F.count("*").alias("__c"))
    w = Window.partitionBy(stratum)
    before = w.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select(F.col(stratum).alias("__st"), F.col("__b").alias("__bb"), F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__s"), F.sum("__c").over(w).alias("__n"))
    place = F.row_number().over(Window.partitionBy(stratum, "__b").orderBy("__h", id_col)) - 1
    r = h.withColumn("__p", place).join(starts, F.col(stratum).eqNullSafe(F.col("__st")) & (F.col("__b") == F.col("__bb")))
    at = (F.col("__s") + F.col("__p")) / F.col("__n")
    rule, upto = F.when(F.col("__n") == 1, shares[0][0]), 0.0
    for part, share in shares[:-1]:
        upto += share
        rule = rule.when(at < upto, part)
    return r.withColumn("split", rule.otherwise(shares[-1][0])).drop("__h", "__b", "__st", "__bb", "__s", "__n", "__p")

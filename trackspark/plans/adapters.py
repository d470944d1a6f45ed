"""Views of the driver's tables in this library's forms, in Spark and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.functions.graph import Rounds
from trackspark.functions.ranks import ranked
from trackspark.operators.tracks import last_write_wins


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as detections: a user is a track, thirty of them a movie, an hour a frame."""
    return table(spark, sf_dir, "events").selectExpr(
        "user_id div 30 AS dataset",
        "user_id AS track_id",
        "CAST(timestampdiff(HOUR, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) AS INT) AS timeframe",
        "event_id AS sc_id",
        "value AS area",
        "event_type AS status",
        "event_id * 37 % 960 AS x1",
        "event_id * 91 % 960 AS y1",
        "event_id * 37 % 960 + 8 + event_id % 40 AS x2",
        "event_id * 91 % 960 + 8 + event_id % 32 AS y2",
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cell per track and frame: the latest."""
    return last_write_wins(raw_cells(spark, sf_dir))


def written(df: DataFrame) -> DataFrame:
    """The view as a table in the shared folder, for jobs that read it many times."""
    return Rounds(df.sparkSession).write(df, "view")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as pixels with two label images; (image, r, c) may repeat."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey % 50 AS image", "l_suppkey % 20 AS label_a", "l_partkey % 20 AS label_b", "l_quantity AS value", "l_partkey AS r", "CAST(l_linenumber AS BIGINT) AS c"
    )


#: Rows of the pixel table that a task gets, about. What aggregates by pixel hold grows with it, not with the table.
PIXELS_PER_TASK = 1_000_000


def dealt(spark: SparkSession, sf_dir: str, pixels: DataFrame, *keys: str) -> DataFrame:
    """Rows of lineitem, together by keys, over as many tasks as the table's size asks for."""
    n = table(spark, sf_dir, "lineitem").count()
    return pixels.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // PIXELS_PER_TASK)), *keys)


def unique_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pixel per (image, r, c): the one with the least labels and value."""
    p = dealt(spark, sf_dir, pixels(spark, sf_dir), "image", "r", "c").groupBy("image", "r", "c").agg(F.min(F.struct("label_a", "label_b", "value")).alias("m"))
    return p.select("image", "r", "c", "m.*")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as a feature table of 64 columns."""
    return table(spark, sf_dir, "embeddings").select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(f"f{i}") for i in range(64)], "label")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return l.join(d, "doc_id").selectExpr(
        "doc_id", "quality AS label_index", "toxic AS prediction", "source AS src_dir", "n_chars % 4 AS padding", "doc_id % 20 AS frame_idx"
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as experiment logs; iterations in order of date, then key."""
    o = table(spark, sf_dir, "orders").selectExpr(
        "o_orderpriority AS strategy", "o_custkey % 5 AS run_id", "o_totalprice / 600000 AS test_iou", "o_orderkey % 100 AS labeled_samples", "o_orderdate", "o_orderkey"
    )
    place = ranked(o, ["strategy", "run_id"], ["o_orderdate", "o_orderkey"], "iteration")
    return place.withColumn("iteration", (F.col("iteration") + 1).cast("int")).drop("o_orderdate", "o_orderkey")


def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as a binary tree of divisions; 0 is the root."""
    return table(spark, sf_dir, "customer").selectExpr("(c_custkey - 1) div 2 AS mother_id", "c_custkey AS daughter_id").where("daughter_id >= 1")


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as clips with up to two cells a frame."""
    return table(spark, sf_dir, "conversations").selectExpr("conv_id AS clip", "CAST(turn div 2 AS INT) AS timeframe", "turn AS sc_id", "role AS class", "CAST(length(text) AS DOUBLE) AS area")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").selectExpr("page_id AS timeframe", "url", "length(html) AS size")


#: The same views for DuckDB, put before each oracle.
VIEWS = """
WITH raw_cells AS (
  SELECT user_id // 30 AS dataset, user_id AS track_id, CAST(date_diff('hour', TIMESTAMP '2024-01-01', ts) AS INTEGER) AS timeframe,
    event_id AS sc_id, value AS area, event_type AS status, event_id * 37 % 960 AS x1, event_id * 91 % 960 AS y1,
    event_id * 37 % 960 + 8 + event_id % 40 AS x2, event_id * 91 % 960 + 8 + event_id % 32 AS y2 FROM events),
cells AS (SELECT * FROM raw_cells QUALIFY row_number() OVER (PARTITION BY dataset, track_id, timeframe ORDER BY sc_id DESC) = 1),
tracks AS (SELECT *, span - length AS missing, (span - length) / CAST(span AS DOUBLE) AS vacancy FROM (
  SELECT dataset, track_id, count(*) AS length, min(timeframe) AS "start", max(timeframe) AS "end", CAST(max(timeframe) - min(timeframe) + 1 AS BIGINT) AS span
  FROM cells GROUP BY ALL)),
pixels AS (SELECT l_orderkey % 50 AS image, l_suppkey % 20 AS label_a, l_partkey % 20 AS label_b, l_quantity AS value, l_partkey AS r, CAST(l_linenumber AS BIGINT) AS c FROM lineitem),
upixels AS (SELECT image, r, c, label_a, label_b, value FROM pixels QUALIFY row_number() OVER (PARTITION BY image, r, c ORDER BY label_a, label_b, value) = 1),
feats AS (SELECT vec_id, """ + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS f{i}" for i in range(64)) + """, label FROM embeddings),
preds AS (SELECT l.doc_id, quality AS label_index, toxic AS prediction, source AS src_dir, n_chars % 4 AS padding, l.doc_id % 20 AS frame_idx
  FROM labels l JOIN documents d USING (doc_id)),
runs AS (SELECT o_orderpriority AS strategy, o_custkey % 5 AS run_id, o_totalprice / 600000 AS test_iou, o_orderkey % 100 AS labeled_samples,
  CAST(row_number() OVER (PARTITION BY o_orderpriority, o_custkey % 5 ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS iteration FROM orders),
lineage AS (SELECT (c_custkey - 1) // 2 AS mother_id, c_custkey AS daughter_id FROM customer WHERE c_custkey >= 1),
clips AS (SELECT conv_id AS clip, CAST(turn // 2 AS INTEGER) AS timeframe, turn AS sc_id, role AS class, CAST(length(text) AS DOUBLE) AS area FROM conversations),
manifest AS (SELECT page_id AS timeframe, url, CAST(length(html) AS INTEGER) AS size FROM pages)
"""

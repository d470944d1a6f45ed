"""Tables between steps in the shared folder, and connected components for edit tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. Where none is named, a local master gets a
    temporary folder; on a cluster that is an error, as a machine's own folder is lost with it."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


class Rounds:
    """Parquet tables of one iterative job in the shared folder: cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/trackspark/{uuid.uuid4().hex}"

    def write(self, df: DataFrame, label: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{label}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{label}")

    def drop(self, label: str) -> None:
        """Deletes a table that nothing reads any more."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{label}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a, b) of longs: (node, root) for every node with an edge; root is its component's least.

    In each round every node that has a lesser neighbour moves to the least one, and from there on to where that one
    moves; edges move with their ends. What is left are edges between fewer nodes, so that rounds grow with the
    logarithm of a component, whatever its shape. A node's moves are put together at the end.
    """
    t = Rounds(edges.sparkSession)
    e = edges.where("a <> b").select("a", "b")
    now = t.write(e.union(e.select("b", "a")).distinct(), "edges0")
    nodes = t.write(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct(), "nodes")
    moves = []
    for k in range(1, max_rounds + 1):
        least = now.groupBy(F.col("a").alias("x")).agg(F.min("b").alias("y")).where("y < x")
        on = least.select(F.col("x").alias("y"), F.col("y").alias("z"))
        to = t.write(least.join(on, "y", "left").select("x", F.coalesce("z", "y").alias("to")), f"to{k}")
        moves.append(to)
        moved = now
        for c in "ab":
            moved = moved.join(to, moved[c] == to["x"], "left").withColumn(c, F.coalesce("to", c)).select("a", "b")
        now = t.write(moved.where("a <> b").distinct(), f"edges{k}")
        t.drop(f"edges{k - 1}")
        if now.isEmpty():
            for to in moves:
                nodes = nodes.join(to, nodes["root"] == to["x"], "left").select("node", F.coalesce("to", "root").alias("root"))
            return t.write(nodes, "roots")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

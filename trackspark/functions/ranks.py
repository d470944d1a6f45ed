"""Ranks inside groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import Rounds


def ranked(table: DataFrame, by: list[str], order: list[str | Column], name: str = "rank", rows_per_range: int = 100_000) -> DataFrame:
    """The table's rows with their place from 0 in the order of their group. Rows that are equal in ``by`` and
    ``order`` stand in any order, the same at every read.

    Rows are dealt by ranges of (by, order), so that a hot group spreads over many tasks, and written with their
    place in the range. A group that reaches over several ranges is moved by the rows of its earlier ranges: at
    most one row a range says so.
    """
    t = Rounds(table.sparkSession)
    ranges = max(1, -(-table.count() // rows_per_range))
    dealt = table.repartitionByRange(ranges, *by, *order) if ranges > 1 else table.coalesce(1)
    placed = t.write(dealt.sortWithinPartitions(*by, *order).withColumn("__m", F.monotonically_increasing_id()), "ranked")
    placed = placed.withColumn("__p", F.shiftright("__m", 33))  # the partition is in the upper bits of the id
    first = F.min("__m").over(Window.partitionBy(*by, "__p"))
    per = placed.groupBy(*by, "__p").agg(F.count("*").alias("__c"))
    before = F.sum("__c").over(Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    moved = t.write(per.withColumn("__moved", before).where("__moved IS NOT NULL").select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.col("__p").alias("__q"), "__moved"), "moved")
    same = reduce(lambda a, b: a & b, [F.col("__p") == F.col("__q"), *[F.col(c).eqNullSafe(F.col(f"__by{i}")) for i, c in enumerate(by)]])
    inside = placed.withColumn("__k", F.col("__m") - first)
    return inside.join(F.broadcast(moved), same, "left").select(*table.columns, (F.col("__k") + F.coalesce("__moved", F.lit(0))).alias(name))

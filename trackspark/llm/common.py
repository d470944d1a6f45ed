"""What the operators of this subpackage share: scratch tables, words, row packing.

A scratch table is a Parquet table in the shared folder that the cluster names in
``spark.checkpoint.dir``.  It cuts lineage, so a lost executor costs no recomputation of
whole texts, and it fixes values that must not change between two reads (row ids).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: a word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Fixed value: ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

ROW = "__row"  # the packed input row
RID = "__rid"  # a row id, fixed by writing it to a scratch table


def workspace(spark: SparkSession) -> str:
    """The shared folder for scratch tables. Where none is named, a local master gets a temporary folder; on
    a cluster that is an error, as a machine's own folder is lost with it."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within it, shuffle files are deleted at the end of the SQL execution that made them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Scratch:
    """Scratch tables of one call; ``drop()`` deletes them once nothing reads them. free_shuffles: what a write
    has shuffled goes from the executors' disks once the table is written, not when the driver's memory is
    next cleared."""

    def __init__(self, spark: SparkSession, free_shuffles: bool = False):
        self.spark, self.free_shuffles = spark, free_shuffles
        self.root = f"{workspace(spark)}/trackspark/{uuid.uuid4().hex}"

    def path(self, label: str) -> str:
        return f"{self.root}/{label}"

    def write(self, df: DataFrame, label: str) -> DataFrame:
        path = self.path(label)
        with shuffles_freed(self.spark) if self.free_shuffles else nullcontext():
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def write_arrow(self, df: DataFrame, label: str, batch_rows: int) -> DataFrame:
        """``write`` for a plan that hands rows to Python: at most ``batch_rows`` at once, as whole texts
        or groups can be large."""
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = self.spark.conf.get(key)
        self.spark.conf.set(key, str(batch_rows))
        try:
            return self.write(df, label)
        finally:
            self.spark.conf.set(key, before)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def name(column: str) -> str:
    """A column name quoted for SQL text."""
    return "`" + column.replace("`", "``") + "`"


def pack(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The whole row (or the named columns) as one struct, so that no column of it can clash."""
    return F.struct(*[F.col(name(c)) for c in (df.columns if columns is None else columns)]).alias(ROW)


def unpack(df: DataFrame, computed: list[str]) -> DataFrame:
    """The packed columns, then the computed ones; a computed column replaces an input column of its name."""
    lower = {c.lower() for c in computed}
    kept = [f for f in df.schema[ROW].dataType.names if f.lower() not in lower]
    return df.select(*[F.col(f"{ROW}.{name(f)}").alias(f) for f in kept], *computed)


def text_of(column: str | Column) -> Column:
    """A null text counts as empty."""
    return F.coalesce((F.col(name(column)) if isinstance(column, str) else column).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, UPPER.lower())


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE, -1), "")


def bucket(value: str) -> str:
    """A value (SQL, not negative) cut to its seven leading bits."""
    shift = f"greatest(length(bin({value})) - 7, 0)"
    return f"shiftleft(shiftright({value}, {shift}), {shift})"


def ranked(table: DataFrame, scratch: Scratch, label: str, order: list[str | Column], rows_per_range: int = 100_000, **sums: str) -> DataFrame:
    """The table's rows with __rank, their place in the order, and for each of ``sums`` a column of that
    name: the sum of its expression (SQL) over the rows before. Ties stand in any order.

    Rows are range-partitioned; windows run inside ranges, and sums per range (one row each) shift them,
    so no window holds the whole table.
    """
    ranges = max(1, -(-table.count() // rows_per_range))
    dealt = table.repartitionByRange(ranges, *order) if ranges > 1 else table.coalesce(1)
    keyed = scratch.write(dealt.sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()), label)
    # monotonic ids hold the partition in their upper bits and the place in it in the lower 33
    keyed = keyed.withColumn("__p", F.shiftright("__m", 33))
    per_range = keyed.groupBy("__p").agg(F.count("*").alias("__c"), *[F.sum(F.expr(e)).alias(c) for c, e in sums.items()])
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_range.select("__p", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_0") for c in ("__c", *sums)])
    inside = Window.partitionBy("__p").orderBy("__m").rowsBetween(Window.unboundedPreceding, -1)
    for c, e in sums.items():
        keyed = keyed.withColumn(c, F.coalesce(F.sum(F.expr(e)).over(inside), F.lit(0)))
    return keyed.join(F.broadcast(starts), "__p").select(  # one row per range
        *table.columns,
        (F.col("__c_0") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).alias("__rank"),
        *[(F.col(c) + F.col(f"{c}_0")).alias(c) for c in sums],
    )

"""Sharding along a Hilbert curve.  DataFrame functions only.

Several metadata dimensions are quantised to ``bits`` bits each, so that equal shares of the rows take
equal shares of an axis; rows are sorted by their index on the Hilbert curve through that grid, and the
sorted run is cut into shards.  Neighbours on the curve
are neighbours in every dimension, so each shard, and each file cut from it, covers a small box of
the grid and the minima and maxima of its columns prune reads by any of them.

The sort is a range partitioning of narrow rows by (index, id): a common cell is split by id.  Global
ranks are places inside partitions plus the sums of those before, one row per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, Scratch, bucket, name, pack, ranked, text_of, unpack

COMPUTED = ["size", "text_crc32", "curve_index", "law", "shard", "slot", "grown_shard"]


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """Index on the Hilbert curve of integer cells in [0, 2**bits): the published transpose form.

    From the highest bit down, each axis either flips the lower bits of the first axis or swaps them
    with its own; a Gray code over the axes and an interleaving of their bits follow.
    """
    n = len(cells)
    steps = F.array(*[F.struct(F.lit(1 << b).cast("long").alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def step(x: Column, s: Column) -> Column:
        own = F.get(x, s["i"])
        low = s["q"] - F.lit(1)
        set_ = own.bitwiseAND(s["q"]) != 0
        change = F.when(set_, low).otherwise(F.get(x, F.lit(0)).bitwiseXOR(own).bitwiseAND(low))
        return F.transform(
            x,
            lambda v, k: F.when(k == 0, v.bitwiseXOR(change))
            .when((k == s["i"]) & ~set_, v.bitwiseXOR(change))
            .otherwise(v),
        )

    def encode(x: Column) -> Column:
        axes = [F.get(x, F.lit(0))]
        for i in range(1, n):
            axes.append(F.get(x, F.lit(i)).bitwiseXOR(axes[-1]))
        flip = F.lit(0).cast("long")
        for b in range(bits - 1, 0, -1):
            flip = flip.bitwiseXOR(F.when(axes[-1].bitwiseAND(F.lit(1 << b)) != 0, F.lit((1 << b) - 1)).otherwise(F.lit(0)))
        index = F.lit(0).cast("long")
        for b in range(bits - 1, -1, -1):
            for a in axes:
                bit = F.shiftright(a.bitwiseXOR(F.get(x, F.lit(n))), b).bitwiseAND(F.lit(1))
                index = F.shiftleft(index, 1).bitwiseOR(bit)
        return F.struct(flip.alias("flip"), index.alias("index"))

    start = F.array(*[c.cast("long") for c in cells])
    walked = F.aggregate(steps, start, step)
    # the flip of the Gray code is appended to the axes, so that encode() can be applied to both
    flipped = F.transform(F.array(walked), lambda x: F.concat(x, F.array(encode(F.concat(x, F.array(F.lit(0).cast("long"))))["flip"])))
    return F.get(F.transform(flipped, lambda x: encode(x)["index"]), F.lit(0))


def _category_cells(rows: DataFrame, scratch: Scratch, column: str, bits: int) -> DataFrame:
    """(__v, __cell): distinct values in order, nulls first, each at the middle of its rows' places in that
    order, so that equal shares of the rows take equal shares of the axis."""
    values = rows.groupBy(F.col(column).alias("__v")).agg(F.count("*").alias("__n"))
    values = scratch.write(values, f"values{column}")
    total = values.agg(F.sum("__n")).first()[0] or 1
    placed = ranked(values, scratch, f"ranked{column}", [F.col("__v").asc_nulls_first()], __ahead="__n")
    return scratch.write(placed.select("__v", F.expr(_middle(bits, total)).alias("__cell")), f"cells{column}")


def _middle(bits: int, total: int) -> str:
    return f"((2 * __ahead + __n) * {1 << bits}L) div {2 * total}L"


def _size_cells(rows: DataFrame, scratch: Scratch, bits: int) -> DataFrame:
    """(__b, __cell): sizes, cut to seven leading bits (at most 64 values an octave), placed likewise."""
    values = scratch.write(rows.groupBy(F.expr(bucket("size")).alias("__b")).agg(F.count("*").alias("__n")), "size_values")
    total = values.agg(F.sum("__n")).first()[0] or 1
    return scratch.write(ranked(values, scratch, "size_ranked", ["__b"], __ahead="__n").select("__b", F.expr(_middle(bits, total)).alias("__cell_size")), "size_cells")


def hilbert_shards(
    df: DataFrame,
    n_shards: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    categories: tuple[str, ...] = ("source", "lang"),
    *,
    bits: int = 8,
    rows_per_range: int = 100_000,
    carry: bool = True,
) -> DataFrame:
    """One output row per input row: the input columns (only ``id_col`` if not ``carry``), then size
    (UTF-8 bytes of the text plus 1), text_crc32, curve_index, law ('rows'), shard, slot, grown_shard.

    Dimensions of the curve: the categories and the size, each quantised by equal counts. The law is
    ``rows``: shards hold runs of the curve, their counts at most one apart, slots without gaps from 0 in
    the order of the curve; within a cell the order is by id (nulls first), size and checksum, so reruns
    agree. grown_shard is null: another shard count moves rows. Null text: no bytes, so size 1 and checksum 0. Null
    categories: a value of their own. Equal rows: interchangeable. Empty table: no rows. A computed
    column replaces an input column of its name.
    """
    scratch = Scratch(df.sparkSession)
    text = F.encode(text_of(text_col), "UTF-8")
    rows = scratch.write(
        df.select(
            pack(df, None if carry else [id_col]),
            F.col(name(id_col)).alias("__id"),
            *[F.col(name(c)).cast("string").alias(f"__c{i}") for i, c in enumerate(categories)],
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.monotonically_increasing_id().alias("__rid"),
        ),
        "rows",
    )
    placed = rows.drop(ROW)
    cells = []
    for i in range(len(categories)):
        of = _category_cells(rows, scratch, f"__c{i}", bits).withColumnRenamed("__cell", f"__cell{i}")
        placed = placed.join(of, F.col(f"__c{i}").eqNullSafe(F.col("__v"))).drop("__v")
        cells.append(F.col(f"__cell{i}"))
    sizes = _size_cells(rows, scratch, bits)
    placed = placed.join(F.broadcast(sizes), F.expr(bucket("size")) == F.col("__b"))  # at most 64 rows an octave
    cells.append(F.col("__cell_size"))
    placed = placed.select("__id", "size", "text_crc32", "__rid", hilbert_index(cells, bits).alias("curve_index"))
    placed = scratch.write(placed, "placed")

    total = placed.count()
    ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // rows_per_range))
    order = ["curve_index", F.col("__id").asc_nulls_first(), "size", "text_crc32"]
    in_order = ranked(placed, scratch, "in_order", order, rows_per_range=max(1, total // ranges))
    n, k = max(total, 1), n_shards
    in_order = in_order.withColumn("shard", F.expr(f"CAST(__rank * {k} div {n} AS INT)"))
    out = in_order.select(
        "__id", "__rid", "size", "text_crc32", "curve_index",
        F.lit("rows").alias("law"), "shard",
        F.expr(f"__rank - (shard * {n} + {k - 1}L) div {k}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
    if carry:
        out = rows.select(ROW, "__rid").join(out.hint("shuffle_hash"), "__rid")
    else:
        out = out.withColumn(ROW, F.struct(F.col("__id").alias(id_col)))
    return unpack(out, COMPUTED)


def write_shards(sharded: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Writes the result of ``hilbert_shards`` to ``path/shard=k``, each file a run of the curve."""
    runs = sharded.withColumn("__run", F.expr(f"slot div {int(rows_per_file)}"))
    runs.repartition("shard", "__run").sortWithinPartitions("shard", "slot").drop("__run").write.partitionBy("shard").parquet(path)

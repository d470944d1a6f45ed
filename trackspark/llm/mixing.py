"""Mixing sources to target weights.

Hash-random keys give every row a place in its source's order.  Keys are uniform, so equal key
ranges hold equal shares of a source: a source of n rows is range-split into about
``n / rows_per_range`` ranges, which deals a hot source out like any other.  Sums per range, a
prefix sum over ranges and a running sum inside each range give every row its exact place in the
source's stream of words; the stream is cut at the source's budget, after whole epochs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import RID, Scratch, n_words, name, pack, ranked, text_of, unpack

COMPUTED = ["size", "source_size", "target", "taken"]
_KEY_SPACE = 1 << 32


def random_key(id_col: Column, text: Column, seed: int) -> Column:
    """A 32-bit key, the same in every run and layout, from the id, the text and a seed: rows without an id, or
    with one id, spread by their texts."""
    text = F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_col.cast("string"), F.lit("null")), F.md5(text.cast("binary")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, scratch: Scratch, weights: list[float], cap: float) -> DataFrame:
    """sizes: one row per source (__source, __rows, source_size). Adds target.

    Sources sorted by code point, null last, take the weights in turn and share the sum of all
    sizes.  No target exceeds ``cap`` times its source's size; what is over is shared out again by
    weight until none is above.  The end of that is known directly: order the sources by
    cap / weight, fix a prefix of them at their caps, and give the rest one common rate.
    """
    sizes = scratch.write(sizes, "source_sizes")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    by_name = ranked(sizes, scratch, "by_name", [F.col("__source").asc_nulls_last()])
    weighed = by_name.select(*sizes.columns, F.get(cycle, (F.col("__rank") % len(weights)).cast("int")).alias("__w"))
    weighed = scratch.write(weighed.withColumn("__cap", F.col("source_size") * F.lit(float(cap))), "weighed")
    by_ratio = ranked(weighed, scratch, "by_ratio", [F.col("__cap") / F.col("__w"), F.col("__source").asc_nulls_last()], __caps="__cap", __ws="__w")
    every = weighed.agg(F.sum("source_size").alias("__all"), F.sum("__w").alias("__all_w"))  # one row
    rated = by_ratio.join(F.broadcast(every)).withColumn("__rate", (F.col("__all") - F.col("__caps")) / (F.col("__all_w") - F.col("__ws")))
    # the first source in that order whose share at the rate of its suffix is within its cap
    common = rated.where("__rate * __w <= __cap").agg(F.min_by("__rate", "__rank").alias("__common"))  # one row
    return weighed.join(F.broadcast(common)).select(
        "__source", "__rows", "source_size", F.least(F.col("__cap"), F.coalesce("__common", F.lit(0.0)) * F.col("__w")).alias("target")
    )


def _placed(rows: DataFrame, scratch: Scratch, weights: list[float], cap: float, rows_per_range: int) -> DataFrame:
    """rows: __id, __source, size, __key, __tie, __rid. Adds source_size, target and __before: the words
    ahead of the row in its source's order.

    The source table is written first, so that Spark knows its size before it chooses the join: under
    its broadcast threshold rows don't move for it, above that they are joined by shuffle.
    """
    sizes = rows.groupBy("__source").agg(F.count("*").alias("__rows"), F.sum("size").alias("source_size"))
    sources = scratch.write(
        source_targets(sizes, scratch, weights, cap).withColumn("__ranges", F.ceil(F.col("__rows") / rows_per_range).cast("long")),
        "sources",
    )
    ranged = rows.join(sources.withColumnRenamed("__source", "__s"), F.col("__source").eqNullSafe(F.col("__s"))).drop("__s")
    ranged = ranged.withColumn("__range", F.expr(f"(__key * __ranges) div {_KEY_SPACE}"))
    sums = ranged.groupBy("__source", "__range").agg(F.sum("size").alias("__sum"))
    ahead = Window.partitionBy("__source").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("__start", F.coalesce(F.sum("__sum").over(ahead), F.lit(0))).drop("__sum")
    starts = starts.withColumnRenamed("__source", "__s").withColumnRenamed("__range", "__r")
    inside = (
        Window.partitionBy("__source", "__range")
        .orderBy("__key", F.col("__id").asc_nulls_first(), "size", "__tie", RID)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        ranged.withColumn("__in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(starts, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__range") == F.col("__r")))
        .withColumn("__before", F.col("__start") + F.col("__in"))
        .drop("__s", "__r", "__in", "__start")
    )


def _taken() -> Column:
    """Whole epochs, then the part of the row that lies before the cut."""
    return F.expr(
        "CASE WHEN source_size = 0 THEN 0L ELSE "
        "CAST(floor(target) AS BIGINT) div source_size * size + "
        "greatest(0L, least(size, CAST(floor(target) AS BIGINT) % source_size - __before)) END"
    )


def mix_sources(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    *,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    cap: float = 3.0,
    seed: int = 17,
    rows_per_range: int = 4096,
    carry: bool = True,
) -> DataFrame:
    """One output row per input row: the input columns (only ``id_col`` if not ``carry``), then size
    (words), source_size, target (of its source) and taken (words the mix takes of it).

    Each source's taken words sum to its target's whole part. The row at the cut is taken in part.
    Null text: size 0. Null source: a source of its own, last in order. Null id: allowed; ids and
    texts only seed the random keys. Rows of one key stand in order of id, size and a hash of the text; equal rows
    are told apart by a row id, which makes no difference. Empty table, or
    one without words: no rows, or taken 0. A computed column replaces an input column of its name.
    """
    scratch = Scratch(df.sparkSession)
    rows = scratch.write(
        df.select(
            pack(df, None if carry else [id_col]),
            F.col(name(id_col)).alias("__id"),
            F.col(name(source_col)).cast("string").alias("__source"),
            n_words(text_of(text_col)).alias("size"),
            random_key(F.col(name(id_col)), text_of(text_col), seed).alias("__key"),
            F.xxhash64(text_of(text_col)).alias("__tie"),
            F.monotonically_increasing_id().alias(RID),
        ),
        "sizes",
    )
    placed = _placed(rows if not carry else rows.drop("__row"), scratch, list(weights), cap, rows_per_range).withColumn("taken", _taken())
    if carry:
        placed = rows.select("__row", RID).join(placed.hint("shuffle_hash"), RID)
    return unpack(placed, COMPUTED)


def take_mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    *,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    cap: float = 3.0,
    seed: int = 17,
    rows_per_range: int = 4096,
    scratch: Scratch | None = None,
) -> DataFrame:
    """The mix itself: the input's columns, each row as often as the mix repeats it.

    Rows are whole here: the row at a source's cut is taken if at least half of it lies before
    the cut. Rows without words belong to no budget and stay once. Cases as in ``mix_sources``.
    scratch: where to write; the caller may drop it once the result is written.
    """
    scratch = scratch or Scratch(df.sparkSession)
    rows = scratch.write(
        df.select(
            pack(df),
            F.col(name(id_col)).alias("__id"),
            F.col(name(source_col)).cast("string").alias("__source"),
            n_words(text_of(text_col)).alias("size"),
            random_key(F.col(name(id_col)), text_of(text_col), seed).alias("__key"),
            F.xxhash64(text_of(text_col)).alias("__tie"),
            F.monotonically_increasing_id().alias(RID),
        ),
        "sizes",
    )
    copies = F.when(F.col("size") == 0, 1).otherwise(F.expr("CAST((taken * 2 + size) div (2 * size) AS INT)"))
    placed = (
        _placed(rows.drop("__row"), scratch, list(weights), cap, rows_per_range)
        .withColumn("taken", _taken())
        .select(RID, copies.alias("__copies"))
        .where("__copies > 0")
    )
    taken = rows.select("__row", RID).join(placed.hint("shuffle_hash"), RID)
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select("__row.*")

"""Exact dedup with a heavy-hitter split.

1. Each text becomes a digest, written once with a row id: whole texts are read a single time.
2. A frequent-items sketch (a mergeable Misra-Gries summary, a fixed number of counters however
   large the table) names the digests that may be frequent.
3. One pass over the digests verifies them: exact counts and the row that stays.  At most
   ``max_heavy`` rows, so this table is broadcast and frequent digests never reach a shuffle.
4. All other digests go through an ordinary shuffle; none of them is frequent.

The sketch only decides the route; a digest it misses or names in vain costs time, not results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import RID, ROW, Scratch, lower_ascii, name, pack, text_of, unpack

COMPUTED = ["keep_id", "group_size", "kept", "text_sha256"]


def _digests(df: DataFrame, scratch: Scratch, id_col: str, text_col: str, carry: bool) -> DataFrame:
    return scratch.write(
        df.select(
            *([pack(df)] if carry else []),
            F.col(name(id_col)).alias("__id"),
            F.sha2(lower_ascii(text_of(text_col)), 256).alias("__digest"),
            F.monotonically_increasing_id().alias(RID),
        ),
        "digests",
    )


def heavy_digests(rows: DataFrame, max_heavy: int, counters: int) -> DataFrame:
    """Candidates for frequent digests: at most ``max_heavy`` rows of (__digest)."""
    return (
        rows.agg(F.expr(f"approx_top_k(__digest, {int(max_heavy)}, {int(counters)})").alias("top"))
        .select(F.explode("top").alias("t"))
        .select(F.col("t.item").alias("__digest"))
        .where("__digest IS NOT NULL")
    )


def _decide(rows: DataFrame, scratch: Scratch, max_heavy: int, counters: int) -> DataFrame:
    """rows: __id, __digest, __rid. Adds __win (struct of the row that stays) and __n."""
    order = F.struct(F.col("__id"), F.col(RID))  # null ids sort below all others
    heavy = F.broadcast(heavy_digests(rows, max_heavy, counters))  # at most max_heavy rows
    winners = scratch.write(
        rows.join(heavy, "__digest").groupBy("__digest").agg(F.max(order).alias("__win"), F.count("*").alias("__n")),
        "winners",
    )
    frequent = rows.join(F.broadcast(winners), "__digest")
    group = Window.partitionBy("__digest")
    ordinary = (
        rows.join(F.broadcast(winners.select("__digest")), "__digest", "left_anti")
        .withColumn("__win", F.max(order).over(group))
        .withColumn("__n", F.count("*").over(group))
    )
    return frequent.unionByName(ordinary)


def exact_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    carry: bool = True,
    max_heavy: int = 1024,
    counters: int = 8192,
) -> DataFrame:
    """One output row per input row: the input columns (only ``id_col`` if not ``carry``), then
    keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. Of equal texts the row with the
    largest id stays; of rows that repeat that id, exactly one is marked kept.
    Null text: empty. Null id: below all others, so keep_id is null only if the whole group's ids
    are. Empty table: no rows. A computed column replaces an input column of its name.
    """
    scratch = Scratch(df.sparkSession)
    rows = _digests(df, scratch, id_col, text_col, carry)
    decided = _decide(rows, scratch, max_heavy, counters).select(
        *([ROW] if carry else [F.struct(F.col("__id").alias(id_col)).alias(ROW)]),
        F.col("__win.__id").alias("keep_id"),
        F.col("__n").alias("group_size"),
        (F.col(RID) == F.col(f"__win.{RID}")).alias("kept"),
        F.col("__digest").alias("text_sha256"),
    )
    return unpack(decided, COMPUTED)


def drop_exact_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    max_heavy: int = 1024,
    counters: int = 8192,
    scratch: Scratch | None = None,
) -> DataFrame:
    """The rows that stay, with the input's own columns. Cases as in ``exact_dedup``.
    scratch: where to write; the caller may drop it once the result is written.

    Whole rows move at most once, against the row ids to drop; digests alone decide those.
    """
    scratch = scratch or Scratch(df.sparkSession)
    rows = _digests(df, scratch, id_col, text_col, True)
    gone = (
        _decide(rows.drop(ROW), scratch, max_heavy, counters).where(F.col(RID) != F.col(f"__win.{RID}")).select(RID)
    )
    return rows.join(gone.hint("shuffle_hash"), RID, "left_anti").select(f"{ROW}.*")

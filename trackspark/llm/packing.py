"""Conflict-constrained best-fit packing of documents into sequences of fixed capacity.

Documents are measured in words and cut at the capacity; full pieces fill a bin alone. The other pieces
are dealt at random into groups of about ``group_rows``, which are packed independently: groups are
bounded whatever the key distribution, and a source or cluster with a third of all rows spreads evenly.

In a group, pieces come in descending size. Bins stand in order of their residual capacity and carry
bitmaps of the sources and duplicate clusters that they hold. The search starts at the tightest bin
with room (the successor of the size) and goes on until a bin has neither the piece's source nor its
cluster; without one, a new bin is opened. A source with many of the pieces has several bits, dealt to
its pieces in turn, so that a bin holds no more of it than its share.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import RID, Scratch, lower_ascii, n_words, name, text_of

_STEP = 512  # bins looked at together


class Bins:
    """Open bins in order of residual capacity, then of opening."""

    def __init__(self, capacity: int, n_bits: int, most: int):
        self.capacity = capacity
        self.key = np.zeros(most + 1, np.int64)  # residual * 2**32 + bin
        self.bits = np.zeros((max(1, -(-n_bits // 64)), most + 1), np.uint64)
        self.n = self.opened = 0

    def find(self, size: int, conflicts: list[int]) -> int:
        """Place of the tightest compatible bin, -1 if there is none."""
        at = int(np.searchsorted(self.key[: self.n], size << 32))
        while at < self.n:
            end = min(self.n, at + _STEP)
            free = np.ones(end - at, bool)
            for bit in conflicts:
                free &= (self.bits[bit >> 6, at:end] >> np.uint64(bit & 63) & np.uint64(1)) == 0
            k = int(free.argmax())
            if free[k]:
                return at + k
            at = end
        return -1

    def put(self, size: int, conflicts: list[int]) -> int:
        """Puts a piece into a bin and returns the bin."""
        at = self.find(size, conflicts)
        if at < 0:
            which, left, held = self.opened, self.capacity, np.zeros(len(self.bits), np.uint64)
            self.opened += 1
            at, self.n = self.n, self.n + 1
        else:
            which, left, held = int(self.key[at]) & 0xFFFFFFFF, int(self.key[at]) >> 32, self.bits[:, at].copy()
        for bit in conflicts:
            held[bit >> 6] |= np.uint64(1) << np.uint64(bit & 63)
        key = (left - size) << 32 | which
        to = int(np.searchsorted(self.key[:at], key))  # a residual only shrinks
        self.key[to + 1 : at + 1] = self.key[to:at].copy()
        self.bits[:, to + 1 : at + 1] = self.bits[:, to:at].copy()
        self.key[to], self.bits[:, to] = key, held
        return which


def source_bits(sources: np.ndarray, sizes: np.ndarray, capacity: int, per_source: int | None) -> np.ndarray:
    """A conflict bit for each piece: a source has ``per_source`` bits, or (None) as many as a full bin of
    average pieces holds of it, rounded up."""
    count = np.bincount(sources)
    share = count * capacity / max(int(sizes.sum()), 1)
    bits = np.full(len(count), per_source, np.int64) if per_source else np.minimum(np.ceil(share), count).astype(np.int64).clip(1)
    order = np.argsort(sources, kind="stable")
    turn = np.empty(len(sources), np.int64)
    turn[order] = np.arange(len(sources)) - np.repeat(np.cumsum(count) - count, count)
    return (np.cumsum(bits) - bits)[sources] + turn % bits[sources]


def pack_group(pieces: pd.DataFrame, capacity: int, per_source: int | None) -> pd.DataFrame:
    """pieces: __size, __source, __cluster, __order, __chunk. Adds __bin and __place."""
    pieces = pieces.sort_values(["__size", "__order", "__chunk"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    sources = pd.factorize(pieces["__source"], use_na_sentinel=False)[0]
    sources = source_bits(sources, pieces["__size"].to_numpy(), capacity, per_source)
    n_sources = int(sources.max()) + 1 if len(pieces) else 0
    shared = pieces["__cluster"].duplicated(keep=False)  # a cluster with one piece here cannot conflict
    clusters = np.full(len(pieces), -1)
    clusters[shared] = pd.factorize(pieces.loc[shared, "__cluster"])[0] + n_sources
    bins = Bins(capacity, int(max(n_sources, clusters.max(initial=-1) + 1)), len(pieces))
    put, places, held = [], [], {}
    for size, s, c in zip(pieces["__size"].tolist(), sources.tolist(), clusters.tolist()):
        b = bins.put(size, [s, c] if c >= 0 else [s])
        put.append(b)
        places.append(held.get(b, 0))
        held[b] = places[-1] + 1
    return pieces.assign(__bin=np.array(put, np.int64), __place=np.array(places, np.int32))


def cluster_of(text: Column) -> Column:
    """The default duplicate cluster: texts identical after lower-casing A-Z."""
    return F.xxhash64(lower_ascii(text))


def best_fit_pack(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cluster_col: str | None = None,
    *,
    capacity: int = 2048,
    group_rows: int = 8192,
    per_source: int | None = None,
    scratch: Scratch | None = None,
) -> DataFrame:
    """One row per piece: ``id_col``, source, chunk, start_word, n_words, bin_id, place.

    The pieces of a document cover its words once, in order. No bin holds more than ``capacity`` words,
    two pieces of one duplicate cluster, or more than ``per_source`` pieces of one source (None: the
    source's share of a full bin of average pieces of its group, rounded up; 1 for most sources).
    Pieces come by descending size, then by a hash of id and cluster, then in document order.
    Null text, or one without words: a piece of no words, packed like any other. Null source: a source
    of its own. Null id: kept. Equal rows are one cluster, so they get different bins. Copies of a long
    document: each full piece has its own bin. Empty table: no rows. Other columns are left out, so
    their names cannot clash. scratch: where to write; the caller may drop it once the result is written.
    """
    scratch = scratch or Scratch(df.sparkSession)
    cluster = cluster_of(text_of(text_col)) if cluster_col is None else F.xxhash64(F.col(name(cluster_col)))
    rows = scratch.write(
        df.select(
            F.col(name(id_col)).alias("__id"),
            F.col(name(source_col)).cast("string").alias("__source"),
            n_words(text_of(text_col)).alias("__n"),
            cluster.alias("__cluster"),
            F.monotonically_increasing_id().alias(RID),
        ),
        "sizes",
    )
    groups = max(1, -(-rows.count() // group_rows))
    rows = rows.withColumn("__order", F.xxhash64(F.coalesce(F.col("__id").cast("string"), F.lit("")), "__cluster"))
    full = rows.where(F.col("__n") >= capacity).select(
        "*", F.explode(F.sequence(F.lit(0), F.expr(f"CAST(__n div {capacity} - 1 AS INT)"))).alias("__chunk"), F.lit(capacity).cast("long").alias("__size")
    )
    rest = rows.where(f"__n % {capacity} > 0 OR __n = 0").select(
        "*", F.expr(f"CAST(__n div {capacity} AS INT)").alias("__chunk"), F.expr(f"__n % {capacity}").alias("__size")
    )
    # the row id deals rows that repeat, id included, to different groups
    rest = rest.withColumn("__group", F.pmod(F.xxhash64("__order", RID), F.lit(groups)).cast("int"))
    schema = rest.select("__id", "__source", "__chunk", "__size", "__group").schema
    schema = schema.add("__bin", "long").add("__place", "integer")

    def pack(pieces: pd.DataFrame) -> pd.DataFrame:
        return pack_group(pieces, capacity, per_source)[[f.name for f in schema.fields]]

    packed = rest.groupBy("__group").applyInPandas(pack, schema)
    columns = ["__id", "__source", "__chunk", "__size"]
    alone = full.select(*columns, F.concat_ws("-", F.lit("full"), RID, "__chunk").alias("bin_id"), F.lit(0).alias("__place"))
    shared = packed.select(*columns, F.concat_ws("-", F.lit("bin"), "__group", "__bin").alias("bin_id"), "__place")
    return alone.unionByName(shared).select(
        F.col("__id").alias(id_col),
        F.col("__source").alias("source"),
        F.col("__chunk").alias("chunk"),
        (F.col("__chunk") * F.lit(capacity).cast("long")).alias("start_word"),
        F.col("__size").alias("n_words"),
        "bin_id",
        F.col("__place").alias("place"),
    )

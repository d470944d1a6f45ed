"""Product codes of vectors, nearest entries by Orchard search.

A vector is cut into parts and each part position has a codebook of its own. For every entry of a codebook a
list of the other entries in order of their distance to it is kept. A search stands at an entry and walks its
list. An entry nearer to the part than the one it stands at becomes the new place, and the walk starts over on
that entry's list; entries already looked at are marked and skipped. By the triangle inequality no entry beyond
twice the current distance can be nearer, so the walk ends there. All arithmetic is on whole numbers, so bounds
and ties are exact.

Codebooks are refined over all rows: tasks search for their rows and add up the parts of each entry; Spark adds
these sums. What passes through the driver is a codebook's size, never rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, Scratch, name, pack, unpack
from .vectors import VECTOR, added, matrix, whole_vectors

COMPUTED = ["code", "error", "label_error", "codebooks_sha256"]
LIMIT = 1 << 26  # numbers below it keep every squared distance, times four, in a long


class OrchardSearch:
    """books: (parts, entries, width) whole numbers."""

    def __init__(self, books: np.ndarray):
        self.books = books.astype(np.int64)
        parts, n, _ = books.shape
        gap = ((self.books[:, :, None] - self.books[:, None]) ** 2).sum(3)
        own = gap.copy()
        own[:, np.arange(n), np.arange(n)] = -1  # an entry stands first in its own list, and is left out of it
        self.near = np.argsort(own, axis=2, kind="stable")[:, :, 1:]
        self.gap = np.take_along_axis(gap, self.near, 2)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x: (rows, parts, width). Entry and squared distance of every part; ties go to the lower entry."""
        rows, parts, width = x.shape
        n = self.books.shape[1]
        x, part = x.reshape(-1, width), np.tile(np.arange(parts), rows)
        at, place = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        best = ((x - self.books[part, 0]) ** 2).sum(1)
        marked = np.zeros((len(x), n), bool)
        marked[:, 0] = True
        walking = np.arange(len(x) if n > 1 else 0)
        while len(walking):
            p, a, k = part[walking], at[walking], place[walking]
            # an entry at exactly twice the distance may still tie, so the walk goes on there
            on = self.gap[p, a, k] <= 4 * best[walking]
            walking, p, entry = walking[on], p[on], self.near[p, a, k][on]
            place[walking] += 1
            new = ~marked[walking, entry]
            i, p, e = walking[new], p[new], entry[new]
            marked[i, e] = True
            d = ((x[i] - self.books[p, e]) ** 2).sum(1)
            better = (d < best[i]) | ((d == best[i]) & (e < at[i]))
            i, e = i[better], e[better]
            at[i], best[i], place[i] = e, d[better], 0
            walking = walking[place[walking] < n - 1]
        return at.reshape(rows, parts), best.reshape(rows, parts)


def cut(x: np.ndarray, parts: int) -> np.ndarray:
    return x.reshape(len(x), parts, -1)


def refined(table: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: each entry becomes the floor of the mean of the parts nearest to it; unused entries stay."""
    parts, n, width = books.shape
    search = OrchardSearch(books)

    def per_entry(x: np.ndarray) -> np.ndarray:
        x = cut(x, parts)
        entry, _ = search.nearest(x)
        slot = (entry + np.arange(parts) * n).ravel()
        sums = np.zeros((parts * n, width + 1), np.int64)
        np.add.at(sums, slot, np.concatenate([x.reshape(-1, width), np.ones((x.shape[0] * parts, 1), np.int64)], 1))
        return sums

    sums = added(table, parts * width, per_entry).reshape(parts, n, width + 1)
    count = sums[:, :, width:]
    return np.where(count > 0, sums[:, :, :width] // np.maximum(count, 1), books)


def compress_vectors(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    *,
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
    scale: int = 256,
    carry: bool = True,
    scratch: Scratch | None = None,
) -> DataFrame:
    """One row per vector that is kept: the input columns (only ``id_col`` if not ``carry``), then code (two hex
    digits a part), error (squared distances to the entries, summed over the parts), label_error (error summed
    over the rows of equal label) and codebooks_sha256 (of all entries).

    A codebook starts as that part of the ``entries`` rows of smallest id. Null vectors, and vectors with null or
    non-finite entries, are left out. Fewer rows than entries: smaller codebooks. Null ids: after all others;
    rows of one id: in the order of their vectors. Null labels: a label of their own. Repeated rows: each its
    own. Empty table: no rows. Vectors of several lengths, of a length that ``parts`` doesn't divide, or with
    entries beyond 2 ** 26 / scale: an error. A computed column replaces an input column of its name.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    spark = df.sparkSession
    scratch = scratch or Scratch(spark)
    row = pack(df, df.columns if carry else [id_col])
    table, n, width = whole_vectors(df, scratch, vector_col, scale, [row, F.col(name(id_col)).alias("__id"), F.col(name(label_col)).alias("__label")], LIMIT)
    if n and (not width or width % parts):
        raise ValueError(f"{parts} parts don't divide vectors of length {width}")
    books = np.zeros((parts, 1, 1), np.int64)
    if n:
        first = table.orderBy(F.col("__id").asc_nulls_last(), VECTOR).select(VECTOR).limit(entries).collect()
        books = cut(np.array([r[0] for r in first], np.int64), parts).transpose(1, 0, 2)
        for _ in range(rounds):
            books = refined(table, books)
    search, digest = OrchardSearch(books), hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                entry, d = search.nearest(cut(matrix(b), parts))
                text = pa.array([bytes(e).hex() for e in entry.astype(np.uint8)], pa.string())
                yield pa.RecordBatch.from_arrays([b.column(ROW), b.column("__label"), text, pa.array(d.sum(1))], names=[ROW, "__label", "code", "error"])

    schema = table.select(ROW, "__label").schema.add("code", "string").add("error", "long")
    coded = scratch.write(table.select(ROW, "__label", VECTOR).mapInArrow(code, schema), "codes")
    # written, so that Spark knows its size; rows of one label were added up before they met
    per_label = scratch.write(coded.groupBy("__label").agg(F.sum("error").alias("label_error")), "label_errors")
    both = coded.join(per_label.withColumnRenamed("__label", "__l"), F.col("__label").eqNullSafe(F.col("__l")))
    return unpack(both.select(ROW, "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")), COMPUTED)

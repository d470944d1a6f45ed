"""Vectors as rows of whole numbers, shared by the operators on embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, name

VECTOR = "__x"


def whole_vectors(df: DataFrame, scratch: Scratch, vector_col: str, scale: int, keep: list[Column], limit: int) -> tuple[DataFrame, int, int]:
    """Writes ``keep`` and __x, the vector's entries as floor(scale * entry), of every row whose vector is not
    null and holds finite entries only. Returns the table, its number of rows and its vectors' length.

    Vectors of several lengths, and numbers from ``limit`` on, where products would leave a long, raise.
    """
    v = F.col(name(vector_col))
    finite = v.isNotNull() & ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    big = F.transform(v, lambda e: F.floor(e.cast("double") * scale).cast("long"))
    table = scratch.write(df.where(finite).select(*keep, big.alias(VECTOR)), "vectors")
    top = F.greatest(F.abs(F.array_max(VECTOR)), F.abs(F.array_min(VECTOR)))
    n, least, most, top = table.agg(F.count("*"), F.min(F.size(VECTOR)), F.max(F.size(VECTOR)), F.max(top)).first()
    if n and least != most:
        raise ValueError(f"vectors of several lengths, {least} to {most}")
    if top is not None and top >= limit:
        raise ValueError(f"an entry times {scale} is {top}, not below {limit}")
    return table, n, least or 0


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The vectors of a batch, one a row."""
    return batch.column(VECTOR).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def added(df: DataFrame, width: int, per_batch: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of an array that ``per_batch`` makes of a batch's vectors of length ``width``: summed
    inside tasks, then by Spark, entry by entry. What reaches the driver is one such array."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                s = per_batch(matrix(b))
                total = s if total is None else total + s
        if total is not None:
            yield pa.RecordBatch.from_pydict({"s": pa.array([total.ravel()], pa.list_(pa.float64() if total.dtype.kind == "f" else pa.int64()))})

    shape = per_batch(np.zeros((1, width), np.int64))
    kind = "double" if shape.dtype.kind == "f" else "long"
    sums = df.select(VECTOR).mapInArrow(partial, f"s array<{kind}>").select(F.posexplode("s").alias("i", "s")).groupBy("i").agg(F.sum("s").alias("s"))
    total = np.zeros(shape.size, shape.dtype)
    for i, s in sums.collect():  # one row per entry
        total[i] = s
    return total.reshape(shape.shape)

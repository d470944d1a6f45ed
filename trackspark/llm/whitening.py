"""Whitening of embeddings by contour integration of their covariance.

Counts, sums and centred products are added up over all rows by tasks and then by Spark. The covariance, a square
matrix of the vectors' length, is all that the eigensolver sees: its spectrum is cut into intervals by inertia
counts, each interval is solved in a task of its own, and one last Rayleigh-Ritz step over what they found makes
components of different intervals orthogonal. Rows are then projected where they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ROW, Scratch, name, pack, unpack
from .feast import interval_pairs, slices
from .vectors import VECTOR, added, matrix, whole_vectors

COMPUTED = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
LIMIT = 1 << 50


def covariance(table: DataFrame, n: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Covariance (divisor n), exact sums, and the whole number nearest to each mean. Products are of rows centred
    on that number; what the mean is off it, half at most, is taken off afterwards."""
    sums = added(table, width, lambda x: x.sum(0))
    middle = np.array([(2 * s + n) // (2 * n) for s in sums.tolist()], np.int64)

    def products(x: np.ndarray) -> np.ndarray:
        y = (x - middle).astype(float)
        return y.T @ y

    off = np.array([s - n * m for s, m in zip(sums.tolist(), middle.tolist())], float) / n
    v = added(table, width, products) / n - np.outer(off, off)
    return (v + v.T) / 2, sums, middle


def principal_components(spark: SparkSession, v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues, falling, and their unit vectors as columns; values that are zero to
    double precision are left out. The largest entry of a vector is positive."""
    parts = slices(v, most)
    if not parts:
        return np.zeros(0), np.zeros((len(v), 0))
    shared = spark.sparkContext.broadcast(v)  # length x length numbers

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                values, vectors = interval_pairs(shared.value, r.low, r.high, r.inside)
                yield pd.DataFrame({"value": values, "vector": list(vectors.T)})

    table = spark.createDataFrame(parts, "low double, high double, inside int").repartition(len(parts))
    found = sorted(table.mapInPandas(solve, "value double, vector array<double>").collect())  # ``most`` rows and one interval's at most
    q, _ = np.linalg.qr(np.array([r.vector for r in found]).T)
    values, turned = np.linalg.eigh(q.T @ v @ q)
    vectors = q @ turned[:, ::-1][:, :most]
    vectors /= np.linalg.norm(vectors, axis=0)
    sign = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return values[::-1][:most], vectors * sign


def whiten_vectors(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    *,
    components: int = 32,
    scale: int = 64,
    shift: int = 1_000_000,
    carry: bool = True,
    scratch: Scratch | None = None,
) -> DataFrame:
    """One row per kept vector and component: the input columns (only ``id_col`` if not ``carry``), then component
    (from 1, by falling eigenvalue), n (vectors kept), deviation (squared distance of n * x to the sum S of all x,
    where x = floor(scale * entry) + shift), whitened (x - S/n on the component, over the root of its
    eigenvalue), explained (eigenvalue over trace) and identity_error (largest absolute entry of the whitened
    rows' covariance minus the identity).

    Null vectors, and vectors with null or non-finite entries, are left out. Components whose eigenvalue is zero
    to double precision can't be whitened and are left out: fewer rows than dimensions give fewer components,
    one row or equal rows give none and so no output row. Null ids and repeated rows: each row its own. Empty
    table: no rows. A deviation beyond a long: null. Vectors of several lengths, or entries beyond 2 ** 50 /
    scale: an error. A computed column replaces an input column of its name.
    """
    spark = df.sparkSession
    scratch = scratch or Scratch(spark)
    row = pack(df, df.columns if carry else [id_col])
    # shift cancels in every result, which uses x - S/n and n * x - S only; it is kept in x all the same
    table, n, width = whole_vectors(df, scratch, vector_col, scale, [row], LIMIT)
    table = table.withColumn(VECTOR, F.transform(VECTOR, lambda e: e + shift))
    values, vectors, middle, rest, trace, error = np.zeros(0), np.zeros((width, 0)), None, None, 1.0, 0.0
    if n:
        v, sums, middle = covariance(table, n, width)
        rest = np.array([s - n * m for s, m in zip(sums.tolist(), middle.tolist())], np.int64)  # S - n * middle
        values, vectors = principal_components(spark, v, min(components, width))
        trace = float(np.trace(v))
    k = len(values)
    onto = vectors / np.sqrt(values)

    def project(x: np.ndarray) -> np.ndarray:
        return ((x - middle) - rest / n) @ onto

    if k:
        total = added(table, width, lambda x: (lambda z: np.concatenate([z.sum(0), (z.T @ z).ravel()]))(project(x)))
        mean, second = total[:k] / n, total[k:].reshape(k, k) / n
        error = float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and k:
                x = matrix(b)
                y = n * (x - middle) - rest
                fits = (y.astype(float) ** 2).sum(1) < 9.2e18
                deviation = pa.array((np.where(fits[:, None], y, 0) ** 2).sum(1), mask=~fits)
                z = project(x)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * k), pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(ROW), deviation, lists], names=[ROW, "deviation", "z"])

    schema = table.select(ROW).schema.add("deviation", "long").add("z", T.ArrayType(T.DoubleType()))
    projected = table.mapInArrow(each, schema).select(ROW, "deviation", F.posexplode("z").alias("at", "whitened"))
    explained = F.element_at(F.array(*[F.lit(float(e / trace)) for e in values] or [F.lit(0.0)]), F.col("at") + 1)
    return unpack(
        projected.select(
            ROW, (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
            explained.alias("explained"), F.lit(error).alias("identity_error"),
        ),
        COMPUTED,
    )

"""Column conventions.

``cells`` holds one row per detected object per frame. Operators use its flat form: dataset, sc_id,
track_id, timeframe, the box as x1, y1, x2, y2 (row, column order; x2 and y2 exclusive) and whatever
features a caller has as columns. The stored form nests the box and keeps open maps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOX = ["x1", "y1", "x2", "y2"]

_TEXTS = T.MapType(T.StringType(), T.StringType())
CELLS = T.StructType(
    [
        T.StructField("dataset", T.StringType()),
        T.StructField("sc_id", T.StringType()),
        T.StructField("track_id", T.LongType()),
        T.StructField("timeframe", T.IntegerType()),
        T.StructField("bbox", T.StructType([T.StructField(c, T.DoubleType()) for c in BOX])),
        T.StructField("contour", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("features", T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType()))),
        T.StructField("meta", _TEXTS),
        T.StructField("uns", _TEXTS),
    ]
)


def flat(cells: DataFrame) -> DataFrame:
    """Stored form to flat form: the box becomes four columns."""
    return cells.select("*", *[F.col(f"bbox.{c}").alias(c) for c in BOX]).drop("bbox")


def stored(cells: DataFrame) -> DataFrame:
    """Flat form to stored form; what is missing is null."""
    fields = {f.name: f for f in CELLS}
    box = F.struct(*[F.col(c).cast("double").alias(c) for c in BOX]).alias("bbox")
    rest = [
        (F.col(n) if n in cells.columns else F.lit(None)).cast(fields[n].dataType).alias(n) for n in fields if n != "bbox"
    ]
    return cells.select(*rest, box).select(*CELLS.names)


def check_columns(df: DataFrame, required: list[str], renames: dict[str, str] | None = None) -> DataFrame:
    """Renames columns where the new name is missing, then asks for all required ones."""
    for old, new in (renames or {}).items():
        if old in df.columns:
            df = df.withColumn(new, F.coalesce(F.col(new), F.col(old))) if new in df.columns else df.withColumnRenamed(old, new)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def extended(schema: T.StructType, **columns: str) -> T.StructType:
    """A schema with more columns, named with their types; the given one stays as it is."""
    more = T.StructType.fromDDL(", ".join(f"{n} {t}" for n, t in columns.items()))
    return T.StructType([*schema.fields, *more.fields])

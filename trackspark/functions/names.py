"""File names and paths as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of time points in file stems, the first that matches wins.
TIME_PATTERNS = [
    r"man_seg(\d+)$", r"man_track(\d+)$", r"seg(\d+)$", r"track(\d+)$", r"t(\d+)$", r"seg_(\d+)$", r"track_(\d+)$",
    r"seg.*?(\d+)$", r"track.*?(\d+)$", r"mask(\d+)$", r"label(\d+)$", r".*?(\d+)$",
]


def stem(path: Column) -> Column:
    base = F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)
    return F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")


def time_point(path: Column, patterns: list[str] = TIME_PATTERNS) -> Column:
    """null if no pattern matches."""
    s = F.lower(stem(path))
    return F.coalesce(*[F.nullif(F.regexp_extract(s, p, 1), F.lit("")) for p in patterns]).cast("int")


def origin_name(dataset: Column, sequence: Column, time: Column) -> Column:
    """DATASET-SEQ-Tnnn."""
    return F.concat(F.upper(dataset), F.lit("-"), sequence, F.lit("-T"), F.lpad(time.cast("string"), 3, "0"))


def last_parts(path: Column, n: int = 3) -> Column:
    """F16: the last n parts of a path split at either slash, joined by /."""
    parts = F.split(path, r"[\\/]")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), n), "/")


def posix(path: Column) -> Column:
    """F16."""
    return F.replace(path, F.lit("\\"), F.lit("/"))


def as_json(*columns: str) -> Column:
    """columns, arrays and maps included, as one JSON text."""
    return F.to_json(F.struct(*columns))

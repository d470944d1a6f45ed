"""Registered queries of the library and their DuckDB forms."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import base
from .adapters import cells
from .base import ORACLES, QUERIES  # noqa: F401

for _module in base.MODULES:
    importlib.import_module(f"trackspark.plans.{_module}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per track of at least three cells that never touches the border: length, span, missing rate."""
    from trackspark.operators import filters, tracks

    kept = filters.tracks_by_length(filters.tracks_off_border(cells(spark, sf_dir), 0, (0, 0, 1000, 1000)), 3)
    return tracks.track_summary(kept)

"""A corpus pipeline of five operators over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. Its result is
written as Parquet, in the shared folder, and read again as the next stage's ``docs``; the operator's own
scratch tables are dropped by then.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trackspark.llm.common import Scratch
from trackspark.llm.exact_dedup import drop_exact_duplicates
from trackspark.llm.mixing import take_mix
from trackspark.llm.packing import best_fit_pack
from trackspark.llm.quality_rules import drop_low_quality
from trackspark.llm.simhash import drop_near_duplicates


def _written(spark: SparkSession, docs: DataFrame, operator: Callable[..., DataFrame]) -> DataFrame:
    """The operator's result as a Parquet table of its own; its scratch tables and shuffle files go."""
    work, out = Scratch(spark, free_shuffles=True), Scratch(spark, free_shuffles=True)
    try:
        return out.write(operator(docs, scratch=work), "docs")
    finally:
        work.drop()


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the adaptive thresholds reject go. Null text: goes. Null language
    or source: a group of its own. Equal rows: alike. Empty table: no rows. Further columns stay."""
    return _written(spark, docs, drop_low_quality)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id stays. Null text: empty. Null ids: below all
    others. Equal rows: one stays. Empty table: no rows. Further columns stay."""
    return _written(spark, docs, drop_exact_duplicates)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8), the smallest doc_id stays.
    Null or empty text: stays. Null ids: after all others. Equal rows: one stays. Empty table: no rows.
    Further columns stay."""
    return _written(spark, docs, drop_near_duplicates)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out until sources stand at their target weights. Null or empty text:
    stays once. Null source: a source of its own. Equal rows: each its own. Empty table: no rows. Further
    columns stay."""
    return _written(spark, docs, take_mix)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are packed into sequences of 2,048 words. Null text: a piece of no words. Null source: a
    source of its own. Equal rows: in different sequences. Empty table: no rows. Further columns are left
    out."""
    return _written(spark, docs, best_fit_pack)


STAGES = [
    ("quality_rules", quality),
    ("exact_dedup", exact_dedup),
    ("simhash_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: SimHash candidates and best-fit packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table. Each stage's result is a Parquet table, read again as
    the next one's docs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs

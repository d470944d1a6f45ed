"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import format_chats, messages, read_back, read_loss
from .common import Scratch
from .exact_dedup import exact_dedup
from .html_extract import extract_text
from .mixing import mix_sources
from .oracles import ORACLES  # noqa: F401
from .packing import best_fit_pack
from .quality_rules import quality_rules
from .secret_scan import scan_secrets
from .sharding import hilbert_shards
from .simhash import simhash_components
from .token_output import read_shards, token_sequences, write_shards
from .toxicity import score_toxicity
from .vector_codes import compress_vectors
from .whitening import whiten_vectors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=False)


#: A rank file of a public tokenizer (byte-level BPE, 50,256 tokens and the end token).
RANK_FILE = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    work, out = Scratch(spark, free_shuffles=True), Scratch(spark)
    write_shards(token_sequences(table(spark, sf_dir, "documents").select("doc_id", "text"), RANK_FILE, scratch=work), out.path("shards"))
    work.drop()
    return read_shards(spark, out.path("shards"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), carry=False)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mix_sources(docs, carry=False)
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"), carry=False)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=False)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    # each row is a message of its own, also where rows repeat; rows of one turn stand by role and text, not by file
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    log = rows.withColumn("message_id", F.struct("role", digest.alias("digest"), F.monotonically_increasing_id().alias("row"))).withColumn("kind", F.lit("message"))
    chats = format_chats(messages(log, seq="turn"))
    turns, loss = F.col("turns"), F.col("loss")
    read = chats.withColumn("turns", read_back()).withColumn("loss", read_loss())
    return read.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return hilbert_shards(docs, 8, carry=False).drop("curve_index")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=False)


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), labels, carry=False)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), carry=False)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), carry=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_token_output": op2_token_output,
    "op3_quality_rules": op3_quality_rules,
    "op4_mixing": op4_mixing,
    "op5_html_extract": op5_html_extract,
    "op6_packing": op6_packing,
    "op7_secret_scan": op7_secret_scan,
    "op8_chat_format": op8_chat_format,
    "op9_sharding": op9_sharding,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_toxicity": op11_toxicity,
    "op12_whitening": op12_whitening,
    "op13_vector_codes": op13_vector_codes,
}


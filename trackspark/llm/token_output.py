"""Token-ID output in training order.

1. Texts become token ids (two bytes each) with an end token, read once.
2. A hash of id and text gives every document its place, whatever files it came from: key ranges hold
   equal shares of all documents and are sorted; sums of tokens per range (one row each) give every range
   its place in the joined stream, which is cut into sequences of ``seq_len`` tokens.
3. A keyed Feistel permutation with cycle-walking gives every sequence a global slot: a bijection on
   0 .. n-1 that needs no shuffle, no state and no table, and can be inverted.
4. Sequences are range-partitioned by slot, whole shards to a task, and written as records of a fixed
   stride. Slot s stands in shard s div shard_slots at record s mod shard_slots, so training reads shards
   one after the other and resumes at any step by arithmetic.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, name, shuffles_freed, text_of

# Fixed value: the public pattern that splits text before the merges of byte-level BPE rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ROUNDS = 6
_PIECE = 1 << 16  # characters of a text tokenised at once


# -- permutation ----------------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    """The public 64-bit finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _round_keys(key: int) -> list[np.uint64]:
    steps = (np.uint64(key & (1 << 64) - 1) + np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return list(_mix(steps))


def permute(values: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """A keyed bijection on 0 .. n-1: a balanced Feistel network on the next even number of bits; a
    result of n or more is put in again until it falls below (at most four times on average)."""
    half = np.uint64(max(1, ((max(n, 1) - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = _round_keys(key)
    out = values.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for k in reversed(keys) if inverse else keys:
            if inverse:
                left, right = right ^ (_mix(left + k) & mask), left
            else:
                left, right = right, left ^ (_mix(right + k) & mask)
        out[todo] = left << half | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


# -- tokens ---------------------------------------------------------------------------------------


def _encoder(rank_file: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _pieces(text: str) -> Iterator[str]:
    """A long text in parts that end before a space after a letter, where the pattern splits anyway."""
    at = 0
    while len(text) - at > _PIECE:
        end = at + _PIECE
        while end < len(text) and not (text[end] == " " and text[end - 1].isalpha() and text[end + 1 : end + 2].isalpha()):
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def _ids(encoder, text: str) -> np.ndarray:
    parts = [encoder.encode_to_numpy(p, disallowed_special=()) for p in _pieces(text)]
    return (parts[0] if len(parts) == 1 else np.concatenate(parts)).astype("<u2")


def tokenize(df: DataFrame, rank_file: bytes, end_token: int) -> DataFrame:
    """df: __key, __text. (__key, __n, __tokens): number of tokens with the end token, and these (two bytes
    each, little-endian)."""
    shared = df.sparkSession.sparkContext.broadcast(rank_file)  # a vocabulary, of fixed size

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(shared.value), np.array([end_token], "<u2").tobytes()
        for batch in batches:
            tokens = [_ids(encoder, x.as_py() or "").tobytes() + end for x in batch.column(1)]
            n = np.array([len(x) // 2 for x in tokens], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(tokens, pa.binary())], ["__key", "__n", "__tokens"])

    return df.select("__key", "__text").mapInArrow(make, "__key long, __n long, __tokens binary")


# -- sequences ------------------------------------------------------------------------------------


def _cut(batches: Iterator[pa.RecordBatch], seq_len: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """batches of documents: __start (place of its first token in the stream), __tokens. Sequences, the place
    in each where its tokens begin, and the tokens: a sequence comes in parts where its documents don't
    follow each other."""
    stride, at, held = 2 * seq_len, 0, bytearray()

    def part(n: int) -> tuple[int, int, bytes]:
        """The first n bytes held, which belong to one sequence."""
        nonlocal at
        out = at // seq_len, at % seq_len, bytes(held[:n])
        del held[:n]
        at += n // 2
        return out

    for batch in batches:
        done = []
        for start, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if start != at + len(held) // 2:
                if held:
                    done.append(part(len(held)))
                at = start
            held += tokens
            while len(held) >= (n := stride - 2 * (at % seq_len)):
                done.append(part(n))
        if done:
            yield tuple(map(list, zip(*done)))
    if held:
        yield tuple([x] for x in part(len(held)))


def token_sequences(
    df: DataFrame,
    rank_file: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    end_token: int = 50256,
    seq_len: int = 2048,
    shard_slots: int = 4096,
    key: int = 20240229,
    scratch: Scratch | None = None,
) -> DataFrame:
    """One row per sequence: slot, shard, record, seq_id, n_tokens, tokens (``2 * seq_len`` bytes).

    Partitions hold whole shards, their rows in no stated order. Only the last sequence of the stream may
    be short; it is filled with ``end_token``. rank_file: a byte-level BPE rank file (ids below 65536), read
    on the driver and broadcast. The stream's order follows a hash of id and text and then the tokens, so it
    depends neither on files nor on the cluster. Null text, or an empty one: just the end token. Null ids:
    allowed. Equal rows: each has its own tokens; they stand together, in one range. Empty table: no rows.
    Other columns are left out, so their names cannot clash. scratch: where to write; the caller may drop it
    once the result is written.
    """
    with open(rank_file, "rb") as f:
        ranks = f.read()
    spark = df.sparkSession
    scratch = scratch or Scratch(spark, free_shuffles=True)
    place = F.xxhash64(F.col(name(id_col)), text_of(text_col))
    # keys are uniform, so equal ranges of them hold equal shares of the documents; tokens take about as many
    # bytes as compressed texts do, so as many ranges as the input has splits are of a split's size
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())
    made = tokenize(df.select(place.alias("__key"), text_of(text_col).alias("__text")), ranks, end_token)
    made = made.withColumn("__range", F.expr(f"CAST((shiftrightunsigned(__key, 32) * {parts}L) >> 32 AS INT)"))
    made = made.repartitionById(parts, F.col("__range")).sortWithinPartitions("__range", F.expr("shiftrightunsigned(__key, 1)"), "__key", "__tokens")

    def place_in_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:  # a task has one range
            n = batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at + np.cumsum(n) - n), batch.column(1), batch.column(2)], ["__range", "__in", "__n", "__tokens"])
            at += int(n.sum())

    rows = made.select("__range", "__n", "__tokens").mapInArrow(place_in_range, "__range int, __in long, __n long, __tokens binary")
    rows = scratch.write_arrow(rows, "tokens", 1000)
    sums = scratch.write(rows.groupBy("__range").agg(F.sum("__n").alias("__sum")), "sums")  # one row per range
    total = sums.agg(F.coalesce(F.sum("__sum"), F.lit(0))).first()[0]
    n_seq = -(-total // seq_len)
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("__range", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__at"))
    in_order = rows.join(F.broadcast(starts), "__range").select((F.col("__at") + F.col("__in")).alias("__start"), "__tokens")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seqs, ats, tokens in _cut(batches, seq_len):
            slots = permute(np.array(seqs, np.int64), n_seq, key)
            small = [pa.compress(t, "zstd", asbytes=True) for t in tokens]  # they move once more
            yield pa.RecordBatch.from_arrays(
                [pa.array(slots), pa.array(seqs, pa.int64()), pa.array(ats, pa.int32()), pa.array([len(t) for t in tokens], pa.int32()), pa.array(small, pa.binary())], ["slot", "seq_id", "__at", "__bytes", "__part"]
            )

    pieces = in_order.mapInArrow(cut, "slot long, seq_id long, __at int, __bytes int, __part binary")
    # slots are spread evenly by construction, so ranges of whole shards need no sample of the data
    width = max(1, -(-n_seq // (parts * shard_slots))) * shard_slots
    shards = max(1, -(-n_seq // width))
    pieces = pieces.repartitionById(shards, F.expr(f"CAST(slot div {width} AS INT)")).sortWithinPartitions("slot", "__at")
    filler = np.array([end_token], "<u2").tobytes()

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, int, bytes] | None = None  # the last sequence may go on in the next batch

        def batch_of(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            slots, seqs, tokens = zip(*rows)
            s = np.array(slots, np.int64)
            n = np.array([len(t) // 2 for t in tokens], np.int32)
            tokens = [t + filler * (seq_len - len(t) // 2) for t in tokens]
            return pa.RecordBatch.from_arrays(
                [pa.array(s), pa.array((s // shard_slots).astype(np.int32)), pa.array((s % shard_slots).astype(np.int32)), pa.array(seqs, pa.int64()), pa.array(n), pa.array(tokens, pa.binary())],
                ["slot", "shard", "record", "seq_id", "n_tokens", "tokens"],
            )

        for batch in batches:
            done = []
            for s, q, n, part in zip(*[batch.column(c).to_pylist() for c in ("slot", "seq_id", "__bytes", "__part")]):
                part = pa.decompress(part, n, "zstd", asbytes=True)
                if held is not None and s == held[0]:
                    held = (s, q, held[2] + part)
                else:
                    if held is not None:
                        done.append(held)
                    held = (s, q, part)
            if done:
                yield batch_of(done)
        if held is not None:
            yield batch_of([held])

    return pieces.select("slot", "seq_id", "__bytes", "__part").mapInArrow(assemble, "slot long, shard int, record int, seq_id long, n_tokens int, tokens binary")


# -- shards ---------------------------------------------------------------------------------------


def write_shards(sequences: DataFrame, path: str) -> None:
    """Writes ``path/shard=k/``, one file a shard: its records in order, each followed by one byte, so that
    record r starts at byte ``r * (2 * seq_len + 1)``. Through Spark's text writer, which writes bytes as
    they are and commits whole tasks only, to any store that Spark writes. No shuffle: partitions hold
    whole shards."""
    in_order = sequences.select("shard", "record", F.col("tokens").cast("string").alias("value")).sortWithinPartitions("shard", "record")
    with shuffles_freed(sequences.sparkSession):
        in_order.select("shard", "value").write.partitionBy("shard").option("compression", "none").text(path)


def read_records(spark: SparkSession, path: str, slot: int, n: int, *, seq_len: int = 2048, shard_slots: int = 4096) -> Iterator[np.ndarray]:
    """The token ids of up to n slots from ``slot`` on, for a trainer that resumes there: opens its shard, seeks
    to its record, reads on and goes to the next shard."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    stride = 2 * seq_len + 1
    while n > 0:
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/shard={slot // shard_slots}")
        fs = folder.getFileSystem(conf)
        if not fs.exists(folder):
            return
        file = next(f for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-"))
        records = min(n, file.getLen() // stride - slot % shard_slots)
        if records <= 0:
            return
        stream = fs.open(file.getPath())
        try:
            stream.seek(slot % shard_slots * stride)
            for _ in range(records):
                yield np.frombuffer(bytes(stream.readNBytes(stride))[: 2 * seq_len], "<u2")
        finally:
            stream.close()
        slot, n = slot + records, n - records


def read_shards(spark: SparkSession, path: str, *, seq_len: int = 2048, shard_slots: int = 4096) -> DataFrame:
    """All records of written shards as rows: slot, shard, record, tokens."""
    stride = 2 * seq_len + 1
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    files = files.select(F.regexp_extract("path", r"shard=(\d+)/[^/]*$", 1).cast("int").alias("shard"), "content")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = np.frombuffer(content.as_buffer(), np.uint8).reshape(-1, stride)[:, : 2 * seq_len]
                for at in range(0, len(tokens), 1024):
                    part = np.ascontiguousarray(tokens[at : at + 1024])
                    n, r = len(part), at + np.arange(len(part))
                    rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * seq_len), n, [None, pa.py_buffer(part)]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(shard * shard_slots + r), pa.array(np.full(n, shard, np.int32)), pa.array(r.astype(np.int32)), rows], ["slot", "shard", "record", "tokens"])

    return files.mapInArrow(records, "slot long, shard int, record int, tokens binary")

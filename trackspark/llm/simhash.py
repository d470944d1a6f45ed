"""SimHash near-dedup over hierarchical indexes of masked bit patterns.

Fingerprints are made in one pass over whole texts. Two ways to the links between them:

* ``exact`` for small radii (one 64-bit code): all distinct codes are sorted by Gray rank in ranges; the
  bits that neighbours share are factored into upper nodes, of ranges too, and a search from the top adds
  up differences and prunes whole groups (``gray_index``). Only a spanning forest of the links leaves a
  range.
* ``sampled`` for large radii, codes of several words: upper nodes are masks of random bits, enough of them
  that a pair at the radius of the wanted similarity shares one with the wanted probability. Inside a node
  codes stand in Gray order and are searched in the same way; a node that is too large is searched in
  parts first and then, as far as its rows are not joined by that, block by block. What is linked so makes
  a family, and inside families, again by blocks, whole shingle sets are compared: only links that hold
  leave a task.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, Scratch, name, pack, text_of, unpack
from .components import star_components
from .gray_index import BLOCK, Forest, GrayIndex, RangeIndex, between, spanning_forest

COMPUTED = ["fingerprint", "component_id", "kept"]
_CHUNK = 1 << 20  # bytes of a text handled at once
_COLUMNS = 8192  # shingles compared at once
TEXTS, GROUPS, CODES = 500, 1000, 16384  # texts, groups of codes, and codes, handed to Python at once


# -- fingerprints ---------------------------------------------------------------------------------


def _shingles(text: bytes, k: int) -> Iterator[list[bytes]]:
    """Shingles of k words of a text, A-Z lower-cased, in lists of bounded size."""
    carry: list[bytes] = []
    start, any_shingle = 0, False
    while start < len(text):
        end = start + _CHUNK
        while end < len(text) and not text[end : end + 1].isspace():
            end += 1
        words = carry + text[start:end].lower().split()
        start = end
        if len(words) >= k:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            yield [joined[a:b] for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())]
            any_shingle, carry = True, words[len(words) - k + 1 :]
        else:
            carry = words
    if not any_shingle and carry:
        yield [b" ".join(carry)]


def fingerprint(text: bytes, k: int) -> int:
    """A 64-bit code of XXH64 hashes, seed 42: a bit is 1 if set in over half the hashes of all shingles,
    repeats included; no word: zero."""
    total, ones = 0, np.zeros(64, np.int64)
    for shingles in _shingles(text, k):
        total += len(shingles)
        ones += _ones(_hashes(shingles))
    return int(_majority(ones, total))


def _hashes(shingles: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.dtype("<u8"), len(shingles))


def _ones(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.uint32)
    return ones


def _majority(ones: np.ndarray, total: int) -> np.int64:
    return np.packbits(ones * 2 > total, bitorder="little").view("<i8")[0]


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    parts = [np.unique(_hashes(s)) for s in _shingles(text, k)]
    return np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0] if parts else np.zeros(0, np.uint64)


def set_codes(hashes: np.ndarray, n_codes: int) -> list[int]:
    """n_codes 64-bit codes of a set: code c is the majority of the hashes mixed with c (SplitMix64)."""
    out = []
    for c in range(n_codes):
        x = hashes + np.uint64((c + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(int(_majority(_ones((x ^ (x >> np.uint64(31))).astype("<u8")), len(hashes))))
    return out


def codes_of(texts: DataFrame, k: int) -> DataFrame:
    """texts: __id, __order, __text. (__id, __order, __f0): fingerprints."""
    names = ["__id", "__order", "__f0"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [fingerprint(t.as_py() or b"", k) for t in batch.column(2).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.int64())], names)

    return texts.select("__id", "__order", "__text").mapInArrow(make, ", ".join(f"{n} long" for n in names))


def set_codes_of(texts: DataFrame, k: int, n_codes: int) -> DataFrame:
    """The same with codes of distinct shingles, __f0 .. , and before them __set, a digest of those."""
    names = ["__id", "__order", "__set"] + [f"__f{c}" for c in range(n_codes)]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(2).cast(pa.large_binary()):
                h = shingle_set(t.as_py() or b"", k)
                rows.append([np.uint64(xxhash.xxh64_intdigest(h.tobytes(), 7)).view(np.int64), *set_codes(h, n_codes)])
            codes = np.array(rows, np.int64).reshape(-1, n_codes + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)] + [pa.array(codes[:, c]) for c in range(n_codes + 1)], names)

    return texts.select("__id", "__order", "__text").mapInArrow(make, ", ".join(f"{n} long" for n in names))


# -- the index ------------------------------------------------------------------------------------


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def sampled_masks(words: int, bits: int, count: int, seed: int) -> list[tuple[int, ...]]:
    draw, out = random.Random(seed), []
    for _ in range(count):
        mask = [0] * words
        for b in draw.sample(range(64 * words), bits):
            mask[b // 64] |= 1 << (b % 64)
        out.append(tuple(mask))
    return out


def _gray_rank(code: str) -> Column:
    """Gray rank of a 64-bit code, as a long in the same order."""
    rank = F.col(code)
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank.bitwiseXOR(F.lit(-(1 << 63)))


def links_exact(codes: DataFrame, scratch: Scratch, radius: int, range_rows: int, least_ranges: int = 32) -> DataFrame:
    """codes: distinct __f0. A spanning set (a, b, d) of all links at ``radius`` or less.

    Codes are sorted by Gray rank in ranges of about ``range_rows``. The bits that all codes of a range
    share are its node; the nodes (one row per range) are factored further into the top of the index,
    which every task has. From the top each code goes to its own range and to those that its accumulated
    differences don't rule out, of two ranges only one way: for b = log2(ranges) to about b * b / 4 of them.
    There the search goes on, in the range's own part of the index.
    """
    spark = codes.sparkSession
    n = codes.count()
    ranges = max(least_ranges, -(-n // range_rows))
    in_order = codes.select("__f0").repartitionByRange(ranges, _gray_rank("__f0"))
    in_order = scratch.write(in_order.select("__f0", F.spark_partition_id().alias("__range")), "in_order")
    nodes = in_order.groupBy("__range").agg(F.expr("bit_and(__f0)").alias("ones"), F.expr("bit_or(__f0)").alias("any")).orderBy("__range")
    nodes = np.array([tuple(r) for r in nodes.collect()], np.int64).reshape(-1, 3)  # one row per range
    ids, ones, some = nodes[:, 0], nodes[:, 1].view(np.uint64)[:, None], nodes[:, 2].view(np.uint64)[:, None]
    top = spark.sparkContext.broadcast((ids, ones | ~some, ones))
    names = ["__range", "__probe", "__f0"]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, mask, pattern = top.value
        index = GrayIndex(pattern, mask)
        for batch in batches:
            codes, own = batch.column(0).to_numpy(), np.searchsorted(ids, batch.column(1).to_numpy())
            for at in range(0, len(codes), BLOCK):
                q, to, _ = index.within(codes[at : at + BLOCK].view(np.uint64)[:, None], radius)
                home = own[at + q]
                keep = (to == home) | ((to < home) == ((to + home) % 2 == 1))
                to, q, probe = to[keep], at + q[keep], (to != home)[keep]
                yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), pa.array(probe), pa.array(codes[q])], names)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = [], None
        for batch in batches:  # a range's own codes come first
            probe, codes = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy().view(np.uint64)[:, None]
            if part is None:
                own.append(codes[~probe])
            if probe.any():
                if part is None:
                    part = RangeIndex(np.concatenate(own), radius)
                    yield from map(_link_batch, part.inside())
                yield from map(_link_batch, part.with_others(codes[probe]))
        if part is None and own:
            yield from map(_link_batch, RangeIndex(np.concatenate(own), radius).inside())

    routed = in_order.select("__f0", "__range").mapInArrow(route, "__range int, __probe boolean, __f0 long")
    routed = routed.repartitionById(max(len(ids), 1), F.col("__range")).sortWithinPartitions("__probe")
    return scratch.write_arrow(routed.mapInArrow(search, "a long, b long, d long"), "links", CODES)


def _link_batch(links: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    a, b, d = links
    return pa.RecordBatch.from_arrays([pa.array(a[:, 0].view(np.int64)), pa.array(b[:, 0].view(np.int64)), pa.array(d.astype(np.int64))], ["a", "b", "d"])


def families(codes: DataFrame, scratch: Scratch, words: int, radius: int, p_bit: float, recall: float, leaf_size: int, seed: int) -> DataFrame:
    """codes: __id, __f0.. . Links (a, b) that join what all links at ``radius`` or less join: for a pair
    whose bits differ with probability ``p_bit``, some mask holds both with probability ``recall``.

    Patterns grow with the table, so that a node holds about 16 unlike rows, up to 20 bits (136 masks at a
    recall of 0.95 and a similarity of 0.8); beyond that nodes grow.
    """
    bits = min(20, max(12, math.ceil(math.log2(max(codes.count(), 1))) - 4))
    count = math.ceil(math.log(1 - recall) / math.log(1 - (1 - p_bit) ** bits))
    fs = [f"__f{c}" for c in range(words)]
    masks = sampled_masks(words, bits, count, seed)
    table = F.array(*[F.struct(F.lit(i).alias("i"), *[F.lit(_signed(m)).alias(f) for f, m in zip(fs, mask)]) for i, mask in enumerate(masks)])
    under = F.transform(table, lambda m: F.struct(m["i"].alias("__path"), F.xxhash64(*[F.col(f).bitwiseAND(m[f]) for f in fs]).alias("__key")))
    nodes = codes.select("__id", *fs, F.explode(under).alias("x")).select("x.__path", "x.__key", F.struct("__id", *fs).alias("m"))
    key = ["__path", "__key"]
    hot = nodes.groupBy(key).agg(F.count("*").alias("n"), F.min("m").alias("__lead")).where(F.col("n") > leaf_size)
    hot = scratch.write(hot, "hot")
    light = nodes.join(hot, key, "left_anti").groupBy(key).agg(F.collect_list("m").alias("m")).where("size(m) > 1").select("m")
    found = scratch.write_arrow(_forests(light, words, radius), "links_0", GROUPS)
    if hot.isEmpty():
        return found
    # hot nodes: first parts dealt at random, each with the node's first row, which joins what is alike throughout
    part = F.pmod(F.xxhash64("m.__id", "__path"), F.ceil(F.col("n") / leaf_size))
    dealt = nodes.join(hot, key).groupBy(*key, part.alias("__part")).agg(F.array_union(F.collect_list("m"), F.array(F.first("__lead"))).alias("m"))
    found = found.union(scratch.write_arrow(_forests(dealt.select("m"), words, radius), "links_1", GROUPS // 10))
    # then, where rows are not joined by now, each two blocks
    root = star_components(found, scratch, "near").select(F.col("node").alias("__id"), "root")
    rest = nodes.join(hot.select(*key, "n"), key).select(*key, "n", "m", F.col("m.__id").alias("__id")).join(root, "__id", "left")
    rest = rest.select(*key, "n", "__id", F.struct(F.coalesce("root", "__id").alias("root"), "m").alias("m"))
    several = rest.groupBy(key).agg(F.min("m.root").alias("lo"), F.max("m.root").alias("hi")).where("lo <> hi").select(key)
    rest = _by_blocks(rest.join(several, key), key, "__id", "n", 8 * leaf_size).groupBy(*key, "__two").agg(F.collect_list("m").alias("m"))
    return found.union(scratch.write_arrow(_forests_between(rest.select("m"), words, radius), "links_2", 4))


def _by_blocks(rows: DataFrame, key: list[str], id_col: str, n: str, block_rows: int) -> DataFrame:
    """Rows of groups (by ``key``, of ``n`` rows each), dealt at random into blocks of about half of
    ``block_rows``; each row once for each two blocks (__two) of which its own is one."""
    parts = F.ceil(2 * F.col(n) / block_rows).cast("int")
    rows = rows.withColumn("__parts", F.when(F.col(n) <= block_rows, 1).otherwise(parts))
    rows = rows.withColumn("__block", F.pmod(F.xxhash64(id_col, *key), F.col("__parts")).cast("int"))
    two = lambda o: F.least("__block", o).cast("long") * F.col("__parts") + F.greatest("__block", o)
    # where there are others, a block alone need not be looked at: it is in each of its pairs
    others = F.filter(F.sequence(F.lit(0), F.col("__parts") - 1), lambda o: (F.col("__parts") == 1) | (o != F.col("__block")))
    return rows.withColumn("__two", F.explode(F.transform(others, two))).drop("__parts", "__block")


def _forests(groups: DataFrame, words: int, radius: int) -> DataFrame:
    """groups: m, an array of (id, codes). A spanning forest (a, b) of each group's links."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            ids = flat.field(0).to_numpy()
            codes = np.stack([flat.field(1 + c).to_numpy().view(np.uint64) for c in range(words)], 1)
            a, b, _ = np.array(spanning_forest(codes, sizes, radius), np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

    return groups.mapInArrow(links, "a long, b long")


def _forests_between(groups: DataFrame, words: int, radius: int) -> DataFrame:
    """groups: m, an array of (root, (id, codes)). A spanning forest (a, b) of each group's links, rows of
    one root taken as joined."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            ends, flat = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten()
            row = flat.field(1)
            roots, ids = flat.field(0).to_numpy(), row.field(0).to_numpy()
            codes = np.stack([row.field(1 + c).to_numpy().view(np.uint64) for c in range(words)], 1)
            for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist()):
                a, b = between(codes[lo:hi], roots[lo:hi], radius)
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo + a]), pa.array(ids[lo + b])], ["a", "b"])

    return groups.mapInArrow(links, "a long, b long")


def alike(sets: list[np.ndarray], similarity: float) -> Iterator[tuple[int, int]]:
    """A spanning forest of the pairs whose Jaccard similarity is ``similarity`` or more."""
    n, sizes = len(sets), np.array([len(s) for s in sets], np.float32)
    if n == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        if common >= similarity * (sizes.sum() - common):
            yield 0, 1
        return
    row, flat = np.repeat(np.arange(n), [len(s) for s in sets]), np.concatenate(sets)
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    several = count > 1  # of the others nothing is common
    row, column = row[several[column]], (np.cumsum(several) - 1)[column[several[column]]]
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    common = np.zeros((n, n), np.float32)
    for at in range(0, int(several.sum()), _COLUMNS):
        lo, hi = np.searchsorted(column, (at, at + _COLUMNS))
        held = np.zeros((n, min(_COLUMNS, int(several.sum()) - at)), np.float32)
        held[row[lo:hi], column[lo:hi] - at] = 1
        common += held @ held.T
    i, j = np.nonzero(np.triu(common >= similarity * (sizes[:, None] + sizes[None] - common) - 1e-3, 1))
    taken = Forest(n).add(i, j)
    yield from zip(i[taken].tolist(), j[taken].tolist())


def alike_in_families(member: DataFrame, sets: DataFrame, scratch: Scratch, similarity: float, block_rows: int) -> DataFrame:
    """member: (node, root); sets: (__id, s). Links (a, b) of the given similarity inside each family: a
    spanning forest of all that hold.

    A family of up to ``block_rows`` is one group. A larger one is first dealt into blocks, each with the family's
    first row, which joins most of it. What is then outside the family's largest component, k of its n rows, meets
    all of its rows once more, block by block: n + k * n / block_rows copies for small k, not n * n / block_rows.
    """
    size = member.groupBy("root").agg(F.count("*").alias("n"))
    rows = member.join(size, "root").join(sets, F.col("node") == F.col("__id")).select("root", "n", "__id", F.struct("__id", "s").alias("m"))
    small = rows.where(F.col("n") <= block_rows).groupBy("root").agg(F.collect_list("m").alias("m")).select("m")
    found = scratch.write_arrow(_alike_groups(small, similarity), "alike_0", GROUPS // 10)
    large = rows.where(F.col("n") > block_rows)
    lead = scratch.write(large.groupBy("root").agg(F.min("m").alias("lead")), "leads")
    if lead.isEmpty():
        return found
    blocks = lambda n: F.ceil(2 * F.col(n) / block_rows)
    dealt = lambda *seed, n: F.pmod(F.xxhash64("__id", *seed), blocks(n))
    first = large.groupBy("root", dealt(n="n").alias("x")).agg(F.collect_list("m").alias("m")).join(lead, "root")
    first = first.select(F.array_union("m", F.array("lead")).alias("m"))
    found = found.union(scratch.write_arrow(_alike_groups(first, similarity), "alike_1", GROUPS // 10))

    joined = star_components(found, scratch, "alike_cc").select(F.col("node").alias("__id"), F.col("root").alias("sub"))
    ids = large.select("root", "n", "__id").join(joined, "__id", "left").withColumn("sub", F.coalesce("sub", "__id"))
    ids = scratch.write(ids, "subs")
    per = ids.groupBy("root", "sub").agg(F.count("*").alias("c"))
    main = per.groupBy("root").agg(F.max_by("sub", F.struct("c", "sub")).alias("main"), (F.sum("c") - F.max("c")).alias("k")).where("k > 0")
    split = ids.join(main, "root").select("root", "n", "k", "__id", (F.col("sub") != F.col("main")).alias("out"))
    split = split.join(sets, "__id").select("root", "n", "k", "__id", "out", F.struct("__id", "s").alias("m"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), blocks(n) - 1))
    all_rows = split.withColumn("x", dealt(F.lit("x"), n="n")).withColumn("y", every("k"))
    outside = split.where("out").withColumn("y", dealt(F.lit("y"), n="k")).withColumn("x", every("n"))
    met = all_rows.unionByName(outside).groupBy("root", "x", "y").agg(F.collect_list("m").alias("m")).select("m")
    return found.union(scratch.write_arrow(_alike_groups(met, similarity), "alike_2", GROUPS // 10))


def _alike_groups(groups: DataFrame, similarity: float) -> DataFrame:
    """groups: m, an array of (id, set); an id may stand there twice. A spanning forest (a, b) of each group's links."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            ends, flat = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten()
            ids, own = flat.field(0).to_numpy(), flat.field(1)
            at, hashes = own.offsets.to_numpy() - own.offsets[0].as_py(), own.flatten().to_numpy()
            a, b = [], []
            for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist()):
                each = lo + np.unique(ids[lo:hi], return_index=True)[1]
                if len(each) > 1:
                    for i, j in alike([hashes[at[k] : at[k + 1]] for k in each], similarity):
                        a.append(ids[each[i]])
                        b.append(ids[each[j]])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return groups.mapInArrow(links, "a long, b long")


# -- operators ------------------------------------------------------------------------------------


def hex_code(code: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(code)), 16, "0"))


def simhash_components(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    shingle: int = 3,
    radius: int = 2,
    range_rows: int = 1 << 18,
    carry: bool = True,
) -> DataFrame:
    """One output row per input row: the input columns (only ``id_col`` if not ``carry``), then
    fingerprint (16 hex digits), component_id, kept.

    Fingerprints link at ``radius`` or fewer differing bits; component_id is the smallest id reachable
    over links, the row's own included. One row of each component is kept: one that has that id.
    Null text: no words, like an empty one; fingerprint zero links like any other. Null ids: passed
    over for component_id, which is null only if the whole component's are. Fewer words than
    ``shingle``: the whole sequence is one shingle. Equal rows share a component, one is kept. Empty
    table: no rows. A computed column replaces an input column of its name.
    """
    scratch = Scratch(df.sparkSession)
    order, row_id = F.col(name(id_col)).cast("long").alias("__order"), F.monotonically_increasing_id().alias("__id")
    if carry:
        rows = scratch.write(df.select(pack(df), order, row_id), "rows")
        texts = rows.select("__id", "__order", text_of(F.col(ROW)[text_col]).alias("__text"))
    else:
        texts = df.select(row_id, order, text_of(text_col).alias("__text"))
    marked = scratch.write_arrow(codes_of(texts, shingle), "codes", TEXTS)
    first = F.min(F.struct(F.col("__order").isNull().alias("n"), F.col("__order").alias("i"), F.col("__id").alias("r")))
    codes = scratch.write(marked.groupBy("__f0").agg(first.alias("__first")), "distinct")
    edges = links_exact(codes, scratch, radius, range_rows)
    member = scratch.write(star_components(edges, scratch), "members")
    # of linked codes only: the first row of each component
    linked = member.join(codes, member["node"] == codes["__f0"]).select("node", "root", "__first")
    best = linked.groupBy("root").agg(F.min("__first").alias("__best"))
    labels = linked.join(best, "root").select("node", "__best")
    labels = codes.join(labels, codes["__f0"] == labels["node"], "left").select(
        F.col("__f0").alias("__code"), F.coalesce("__best", "__first").alias("__best")
    )
    # a written table, so that the rows of a frequent code can be split over tasks
    out = marked.join(scratch.write(labels, "labels"), F.col("__f0") == F.col("__code"))
    out = out.select(
        "__id", "__order", hex_code("__f0").alias("fingerprint"),
        F.col("__best.i").alias("component_id"), (F.col("__id") == F.col("__best.r")).alias("kept"),
    )
    if carry:
        out = rows.select(ROW, "__id").join(out.hint("shuffle_hash"), "__id")
    else:
        out = out.withColumn(ROW, F.struct(F.col("__order").alias(id_col)))
    return unpack(out, COMPUTED)


def bit_difference(similarity: float) -> float:
    """Probability that a bit of two SimHash codes differs, for sets of about one size and this
    Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def _shingle_sets(df: DataFrame, k: int) -> DataFrame:
    """df: __id, __text. (__id, s): the distinct 32-bit hashes of a text's shingles, sorted."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_set(t.as_py() or b"", k).astype(np.uint32)).view(np.int32) for t in batch.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int32()))], ["__id", "s"])

    return df.select("__id", "__text").mapInArrow(make, "__id long, s array<int>")


def drop_near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    shingle: int = 5,
    similarity: float = 0.8,
    recall: float = 0.95,
    n_codes: int = 4,
    leaf_size: int = 1024,
    seed: int = 5,
    scratch: Scratch | None = None,
) -> DataFrame:
    """The rows that stay, one of each group of near duplicates, with the input's own columns.

    Rows link if their sets of ``shingle``-word shingles have a Jaccard similarity of ``similarity`` or
    more. Of rows with equal sets the first goes on. SimHash codes of the sets join rows to families,
    with a radius of three deviations over the expected difference; inside a family all pairs of sets
    are compared, in blocks of at most about ``leaf_size`` rows, so families of many rows that are alike
    but not enough cost the square of their size. Groups are the connected components; the row with the
    smallest id stays (then the first).
    Null text, or one without words: no shingles, links to nothing and stays. Null ids: after all
    others. Fewer words than ``shingle``: the whole sequence is one shingle. Equal rows: one stays.
    Empty table: no rows. scratch: where to write; the caller may drop it once the result is written.
    """
    scratch = scratch or Scratch(df.sparkSession)
    rows = scratch.write(df.select(pack(df), F.col(name(id_col)).cast("long").alias("__order"), F.monotonically_increasing_id().alias("__id")), "rows")
    texts = rows.select("__id", "__order", text_of(F.col(ROW)[text_col]).alias("__text")).where(F.col("__text").rlike(r"[^\x20\x09-\x0D]"))
    every = scratch.write_arrow(set_codes_of(texts, shingle, n_codes), "codes", TEXTS)
    first = F.min(F.struct(F.col("__order").isNull().alias("n"), "__order", "__id")).alias("f")
    fs = [f"__f{c}" for c in range(n_codes)]
    codes = every.groupBy("__set", *fs).agg(first).select("f.__id", "f.__order", *fs)
    codes = scratch.write(codes, "distinct")
    p = bit_difference(similarity)
    sigma = math.sqrt(p * (1 - p) / (64 * n_codes))  # of the measured difference
    near = families(codes, scratch, n_codes, math.floor(64 * n_codes * (p + 3 * sigma)), p + sigma, recall, leaf_size, seed)
    member = scratch.write(star_components(near, scratch, "families"), "members")
    sets = _shingle_sets(texts.join(member.hint("shuffle_hash"), F.col("__id") == F.col("node"), "left_semi"), shingle)
    links = alike_in_families(member, scratch.write_arrow(sets, "sets", TEXTS), scratch, similarity, leaf_size)
    groups = star_components(links, scratch, "groups").join(codes.select("__id", "__order"), F.col("node") == F.col("__id"))
    stays = groups.groupBy("root").agg(first).select("root", F.col("f.__id").alias("__stays"))
    joined = groups.join(stays, "root").where("__id <> __stays").select("__id")
    equal = every.select("__id").join(codes.select("__id").hint("shuffle_hash"), "__id", "left_anti")
    gone = scratch.write(joined.union(equal), "gone")
    return rows.select(ROW, "__id").join(gone.hint("shuffle_hash"), "__id", "left_anti").select(f"{ROW}.*")

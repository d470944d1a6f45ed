"""Mixing, packing, sharding, token output."""

import collections
import math
import zlib

import numpy as np
import pytest

from tests.test_entry import DATA
from trackspark.llm import token_output
from trackspark.llm.mixing import mix_sources, take_mix
from trackspark.llm.packing import best_fit_pack
from trackspark.llm.queries import QUERIES
from trackspark.llm.sharding import hilbert_index, hilbert_shards, write_shards

SCHEMA = "doc_id long, text string, lang string, source string, size string, `shard` string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, "clash", "clash") for i, t, lang, s in rows], SCHEMA)


def sample():
    rows = [(k, "w " * (k * 7 % 50), "en", f"s{k % 4}") for k in range(200)]
    return rows + [(1000 + k, "x y z", "de", "tiny") for k in range(2)] + [(None, None, None, None), (3, "a b c", "en", None), (3, "a b c", "en", None), (5000, "v " * 3000, "en", "s1")]


def brute_targets(sizes, weights=(5.0, 2.0, 1.0), cap=3.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        left, free = total - sum(fixed.values()), [s for s in order if s not in fixed]
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return fixed | share
        for s in over:
            fixed[s] = cap * sizes[s]


@pytest.mark.parametrize("rows_per_range", [3, 4096])
def test_mix_reaches_targets(spark, rows_per_range):
    rows = sample()
    got = mix_sources(docs(spark, rows), rows_per_range=rows_per_range).collect()
    sizes = collections.Counter()
    for _, t, _, s in rows:
        sizes[s] += len((t or "").split())
    want, taken = brute_targets(dict(sizes)), collections.Counter()
    assert len(got) == len(rows)
    for r in got:
        assert r.size == len((r.text or "").split()) and r.source_size == sizes[r.source]
        assert math.isclose(r.target, want[r.source], abs_tol=1e-6) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert taken[s] == math.floor(want[s] + 1e-9)
    again = mix_sources(docs(spark, rows).repartition(7), rows_per_range=rows_per_range).collect()
    key = lambda rs: sorted((str(r.doc_id), r.size, r.taken) for r in rs)
    assert key(got) == key(again)
    # rows of one id and size, different texts: the cut falls alike whatever the layout
    twins = [(1, "a b c " * k + x, "en", "s0") for k in range(6) for x in "pqrs"] + [(k, "w " * 40, "en", "s1") for k in range(20)]
    cut = lambda d: sorted((r.text, r.taken) for r in mix_sources(d).collect())
    assert cut(docs(spark, twins)) == cut(docs(spark, twins[::-1]).repartition(5))
    assert mix_sources(docs(spark, rows).limit(0)).count() == 0


def test_take_mix_repeats_whole_rows(spark):
    rows = sample()
    d = docs(spark, rows)
    out = take_mix(d)
    assert out.columns == d.columns
    texts = {(i, t) for i, t, _, _ in rows}
    got = out.collect()
    assert {(r.doc_id, r.text) for r in got} <= texts
    sizes, taken = collections.Counter(), collections.Counter()
    for _, t, _, s in rows:
        sizes[s] += len((t or "").split())
    for r in got:
        taken[r.source] += len((r.text or "").split())
    want = brute_targets(dict(sizes))
    for s in sizes:
        longest = max(len((t or "").split()) for _, t, _, x in rows if x == s)
        assert abs(taken[s] - want[s]) <= longest
    assert take_mix(d.limit(0)).count() == 0


def check_packing(rows, got, capacity, one_per_source=True):
    need = collections.Counter((i, len((t or "").split())) for i, t, _, _ in rows)
    cover = collections.defaultdict(list)
    for r in got:
        cover[r.doc_id].append((r.start_word, r.n_words))
    for i in {i for i, _ in need}:
        assert sum(n for _, n in cover[i]) == sum(n * c for (x, n), c in need.items() if x == i)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.bin_id].append(r)
    for b in bins.values():
        assert sum(r.n_words for r in b) <= capacity
        assert not one_per_source or len({r.source for r in b}) == len(b)
        assert sorted(r.place for r in b) == list(range(len(b)))
    return bins


@pytest.mark.parametrize("group_rows", [20, 8192])
def test_packing_respects_conflicts(spark, group_rows):
    rows = sample()
    got = best_fit_pack(docs(spark, rows), capacity=64, group_rows=group_rows, per_source=1).collect()
    bins = check_packing(rows, got, 64)
    text = {i: t for i, t, _, _ in rows}
    for b in bins.values():
        whole = [text[r.doc_id] for r in b if r.chunk == 0 and (text[r.doc_id] or "")]
        assert len(set(whole)) == len(whole)
    assert best_fit_pack(docs(spark, rows).limit(0)).count() == 0


def test_packing_is_best_fit():
    """In one group each piece goes to the tightest compatible bin."""
    import pandas as pd

    from trackspark.llm.packing import pack_group

    rng = np.random.default_rng(2)
    p = pd.DataFrame({"__size": rng.integers(0, 40, 400), "__source": rng.choice(list("abcdefghi"), 400), "__cluster": rng.integers(0, 300, 400), "__order": np.arange(400), "__chunk": 0})
    got = pack_group(p, 64, 1)
    bins = []
    for r in got.itertuples():
        fits = [(left, k) for k, (left, s, c) in enumerate(bins) if left >= r[1] and r[2] not in s and r[3] not in c]
        want = min(fits)[1] if fits else len(bins)
        assert r[6] == want or bins[r[6]][0] == min(fits)[0]
        if r[6] == len(bins):
            bins.append((64, set(), set()))
        left, s, c = bins[r[6]]
        bins[r[6]] = (left - r[1], s | {r[2]}, c | {r[3]})


def test_packing_fills_bins_of_few_sources(spark):
    rows = [(k, f"t{k} x y", "en", "s0" if k % 3 else "s1") for k in range(400)]
    got = best_fit_pack(docs(spark, rows), capacity=60).collect()
    bins = check_packing(rows, got, 60, one_per_source=False)
    assert len(bins) <= 23  # 20 full ones
    assert max(sum(r.source == "s1" for r in b) for b in bins.values()) <= 7  # a third of 20, rounded up


def test_packing_query_holds_every_word_once(spark):
    """The registered query against the table: each document's words once, and the rules of every bin."""
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = QUERIES["op6_packing"](spark, DATA).collect()
    bins = check_packing(rows, got, 2048, one_per_source=False)
    text = {i: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "") for i, t, _, _ in rows}
    for b in bins.values():
        short = [text[r.doc_id] for r in b if r.n_words < 2048]
        assert len(set(short)) == len(short)
    words = sum(len((t or "").split()) for _, t, _, _ in rows)
    assert len(bins) <= 1.1 * words / 2048 + 2


def test_hilbert_is_a_curve(spark):
    from pyspark.sql import functions as F

    for n, bits in ((2, 4), (3, 3)):
        axes = [F.shiftright("id", bits * i).bitwiseAND(F.lit((1 << bits) - 1)) for i in range(n)]
        g = spark.range(1 << (n * bits)).select(*[a.alias(f"x{i}") for i, a in enumerate(axes)])
        p = g.select("*", hilbert_index([F.col(f"x{i}") for i in range(n)], bits).alias("h")).orderBy("h").toPandas()
        assert p["h"].tolist() == list(range(1 << (n * bits)))
        assert np.abs(np.diff(p.drop(columns="h").to_numpy(), axis=0)).sum(1).max() == 1


def test_shards(spark, tmp_path):
    rows = sample()
    got = hilbert_shards(docs(spark, rows), 8).collect()
    assert len(got) == len(rows)
    per = collections.defaultdict(list)
    for r in got:
        assert r.size == len((r.text or "").encode()) + 1 and r.text_crc32 == zlib.crc32((r.text or "").encode())
        assert r.law == "rows" and r.grown_shard is None
        per[r.shard].append((r.slot, r.curve_index))
    counts = [len(per[k]) for k in range(8)]
    assert max(counts) - min(counts) <= 1
    runs = [sorted(per[k]) for k in range(8)]
    assert all([s for s, _ in run] == list(range(len(run))) for run in runs)
    curve = [h for run in runs for _, h in run]
    assert curve == sorted(curve)
    few = hilbert_shards(docs(spark, rows[:3]), 8).collect()
    assert sorted(r.slot for r in few) == [0, 0, 0]
    assert hilbert_shards(docs(spark, rows).limit(0), 8).count() == 0
    out = hilbert_shards(docs(spark, rows), 4)
    write_shards(out, str(tmp_path / "shards"), rows_per_file=20)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(rows)


def test_shards_prune_by_every_dimension(spark):
    """Languages, sources and sizes drawn apart: a filter on any of them reads about half of the shards."""
    rng = np.random.default_rng(3)
    rows = [(k, "x" * int(2 ** rng.uniform(3, 12)), "de en en en es fr".split()[rng.integers(6)], f"s{max(0, rng.integers(-10, 20)):02}") for k in range(4000)]
    got = hilbert_shards(docs(spark, rows), 8).collect()
    for of in ("lang", "source"):
        read = collections.defaultdict(set)
        for r in got:
            read[r[of]].add(r.shard)
        assert sum(map(len, read.values())) <= 4.5 * len(read)
    assert all(len({r.lang for r in got if r.shard == k}) < 4 for k in range(8))
    sizes = sorted(r.size for r in got)
    for lo, hi in ((0, 400), (3600, 3999)):
        assert len({r.shard for r in got if sizes[lo] <= r.size <= sizes[hi]}) <= 6


def test_many_categories(spark):
    rows = [(k, "t", f"l{k % 700}", f"s{k % 300}") for k in range(2100)]
    got = hilbert_shards(docs(spark, rows), 8, bits=4).collect()
    counts = collections.Counter(r.shard for r in got)
    assert len(got) == 2100 and max(counts.values()) - min(counts.values()) <= 1


@pytest.mark.parametrize("rows_per_range", [7, 100_000])
def test_ranks_over_ranges(spark, rows_per_range):
    from trackspark.llm.common import Scratch, ranked

    t = spark.createDataFrame([(k * 37 % 101, k % 5) for k in range(101)], "k long, w long")
    got = ranked(t, Scratch(spark), "r", ["k"], rows_per_range, __ahead="w").orderBy("k").collect()
    ahead = 0
    for at, r in enumerate(got):
        assert (r["__rank"], r["__ahead"]) == (at, ahead)
        ahead += r.w


def test_permutation_round_trip():
    for n in (1, 2, 3, 10, 1000, 4097):
        p = token_output.permute(np.arange(n), n, 7)
        assert sorted(p.tolist()) == list(range(n))
        assert (token_output.permute(p, n, 7, inverse=True) == np.arange(n)).all()
    assert (token_output.permute(np.arange(1000), 1000, 7) != token_output.permute(np.arange(1000), 1000, 8)).any()


@pytest.fixture(scope="module")
def ranks(tmp_path_factory):
    """A rank file of single bytes and two merges."""
    import base64

    path = tmp_path_factory.mktemp("ranks") / "bytes.tiktoken"
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b" w"]
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" " + str(k).encode() for k, t in enumerate(tokens)))
    return str(path)


def test_token_shards_round_trip(spark, ranks, tmp_path):
    texts = [("ab ab w " * (k % 40), k) for k in range(300)] + [(None, 400), ("", 401), ("é" * 100, 402), ("word " * 4000, 403), ("ab", None), ("ab", None), ("same", 7), ("same", 7)]
    d = spark.createDataFrame([(t, i, 5) for t, i in texts], "text string, doc_id long, slot int")
    options = {"seq_len": 16, "shard_slots": 8}

    def made(df, path):
        token_output.write_shards(token_output.token_sequences(df, ranks, end_token=300, **options), path)
        return token_output.read_shards(spark, path, **options).orderBy("slot").collect()

    got = made(d.coalesce(1), str(tmp_path / "a"))
    n = len(got)
    assert [r.slot for r in got] == list(range(n)) and all(r.shard == r.slot // 8 and r.record == r.slot % 8 and len(r.tokens) == 32 for r in got)
    # the stream: all documents' tokens with the end token, in one order, whatever the layout
    seqs = token_output.permute(np.arange(n), n, 20240229, inverse=True)
    stream = np.concatenate([np.frombuffer(r.tokens, "<u2") for _, r in sorted(zip(seqs.tolist(), got))]).tolist()
    encode = token_output._encoder(open(ranks, "rb").read()).encode_ordinary
    want = collections.Counter(tuple(encode(t or "")) for t, _ in texts)
    found, at = collections.Counter(), []
    for x in stream:
        if x == 300:
            found[tuple(at)] += 1
            at = []
        else:
            at.append(x)
    assert not at and sum(found.values()) - sum(want.values()) < 16
    found[()] -= sum(found.values()) - sum(want.values())  # what fills the last sequence
    assert found == want
    assert [r.tokens for r in made(d.repartition(7), str(tmp_path / "b"))] == [r.tokens for r in got]
    # a trainer resumes at any slot
    for slot, count in ((0, 3), (n - 5, 100), (13, 20)):
        read = [x.tolist() for x in token_output.read_records(spark, str(tmp_path / "a"), slot, count, **options)]
        assert read == [np.frombuffer(r.tokens, "<u2").tolist() for r in got[slot : slot + count]]
    assert list(token_output.read_records(spark, str(tmp_path / "a"), n, 2, **options)) == []
    assert made(d.limit(0), str(tmp_path / "none")) == []


def test_long_text_parts_equal_whole(ranks, monkeypatch):
    encode = token_output._encoder(open(ranks, "rb").read()).encode_ordinary
    text = "some words ab, w 12 and\n\nmore " * 50
    monkeypatch.setattr(token_output, "_PIECE", 37)
    assert [x for p in token_output._pieces(text) for x in encode(p)] == encode(text)

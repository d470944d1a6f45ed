"""Exact dedup, SimHash and their index."""

import collections
import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from trackspark.llm import gray_index, simhash
from trackspark.llm.common import Scratch
from trackspark.llm.exact_dedup import drop_exact_duplicates, exact_dedup

SCHEMA = "doc_id long, text string, lang string, source string, kept string, `__digest` int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", "clash", 7) for i, t in rows], SCHEMA)


CASES = [(1, "Same Text"), (5, "same text"), (3, "SAME TEXT"), (5, "same text"), (7, "É x"), (8, "é x"), (9, None), (10, ""), (None, "same text"), (None, None), (11, "only")]


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_exact_dedup_against_brute_force(spark):
    got = exact_dedup(docs(spark, CASES), max_heavy=2, counters=16).collect()
    groups = collections.defaultdict(list)
    for i, t in CASES:
        groups[low(t)].append(i)
    assert len(got) == len(CASES)
    for r in got:
        g = groups[low(r.text)]
        assert r.group_size == len(g) and r.keep_id == max(i for i in g if i is not None)
        assert r.text_sha256 == hashlib.sha256(low(r.text).encode()).hexdigest()
    kept = collections.Counter(low(r.text) for r in got if r.kept)
    assert kept == {k: 1 for k in groups}
    assert got[0].__fields__.count("kept") == 1


def test_very_long_texts(spark):
    long = "Ab c " * 1_000_000
    got = exact_dedup(docs(spark, [(1, long), (2, long.lower()), (3, long + "x")]), carry=False).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == [(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True)]
    assert {r.text_sha256 for r in got} == {hashlib.sha256(low(t).encode()).hexdigest() for t in (long, long + "x")}


def test_drop_exact_duplicates_keeps_columns(spark):
    d = docs(spark, CASES)
    out = drop_exact_duplicates(d)
    assert out.columns == d.columns and {r.kept for r in out.collect()} == {"clash"}
    assert out.count() == len({low(t) for _, t in CASES})
    assert drop_exact_duplicates(d.limit(0)).count() == 0 and exact_dedup(d.limit(0)).count() == 0


def brute_fingerprint(text, k):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "Ünïcode", "x1", "long-word"]) + str(rng.randrange(40)) for _ in range(n))


def union(n, pairs):
    p = list(range(n))

    def root(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in pairs:
        i, j = root(a), root(b)
        if i != j:
            p[max(i, j)] = min(i, j)
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("range_rows", [5, 1 << 18])
def test_components_against_brute_force(spark, range_rows):
    rng = random.Random(3)
    rows = [(1, None), (2, ""), (3, "a b"), (4, "A  B"), (5, "a"), (6, "\t \n"), (7, "x" * 5000), (8, words(rng, 9000))]
    base = [words(rng, 60) for _ in range(12)]
    for k in range(120):
        w = base[k % 12].split(" ")
        if k % 3:
            w[rng.randrange(len(w))] = "changed"
        rows.append((20 + k, " ".join(w)))
    rows += [(20, base[0]), (None, base[1])]
    got = simhash.simhash_components(docs(spark, rows), range_rows=range_rows).collect()
    f = [brute_fingerprint(t, 3) for _, t in rows]
    root = union(len(rows), [(j, i) for i in range(len(f)) for j in range(i) if (f[i] ^ f[j]).bit_count() <= 2])
    least = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = collections.Counter((i, t, f"{x:016x}", least.get(r)) for (i, t), x, r in zip(rows, f, root))
    assert collections.Counter((r.doc_id, r.text, r.fingerprint, r.component_id) for r in got) == want
    assert sum(r.kept for r in got) == len(set(root))
    assert simhash.simhash_components(docs(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("leaf_size", [8, 1024])
def test_near_duplicates_against_brute_force(spark, leaf_size):
    rng = random.Random(5)
    rows, clusters = [(None, None), (900, ""), (901, "one two"), (902, "one two")], {}
    for k in range(30):
        base = words(rng, 200).split(" ")
        rows.append((10 * k, " ".join(base)))
        for j in range(k % 4):
            w = list(base)
            w[rng.randrange(200)] = "changed"
            rows.append((10 * k + j + 1, " ".join(w)))
        clusters[k] = k % 4
    got = simhash.drop_near_duplicates(docs(spark, rows), leaf_size=leaf_size)
    assert got.columns == docs(spark, rows).columns
    ids = [r.doc_id for r in got.collect()]
    assert sorted(i for i in ids if i is not None and i < 900) == [10 * k for k in range(30)]
    assert ids.count(None) == 1 and 900 in ids and 901 in ids and 902 not in ids
    assert simhash.drop_near_duplicates(docs(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("words_", [1, 2])
def test_gray_index_finds_all(words_):
    rng = np.random.default_rng(words_)
    sizes = rng.integers(1, 200, 30)
    codes = rng.integers(0, 2**62, (40, words_), dtype=np.uint64)[rng.integers(0, 40, sizes.sum())]
    for _ in range(3):
        codes[np.arange(len(codes)), 0] ^= np.uint64(1) << rng.integers(0, 64, len(codes)).astype(np.uint64)
    forest = gray_index.spanning_forest(codes, sizes, 4)
    links, at = [], 0
    for n in sizes:
        for i in range(at, at + n):
            links += [(j, i) for j in range(at, i) if int(np.bitwise_count(codes[i] ^ codes[j]).sum()) <= 4]
        at += n
    assert union(len(codes), links) == union(len(codes), [f[:2] for f in forest])
    assert len(forest) < len(codes)


def test_ranges_find_every_link(spark):
    """Codes in dense balls and far apart, in many ranges: the forest joins what all links join."""

    rng = np.random.default_rng(5)
    codes = rng.integers(0, 2**63, 40, dtype=np.uint64)[rng.integers(0, 40, 3000)]
    codes[1500:] = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    for _ in range(3):
        codes ^= np.uint64(1) << rng.integers(0, 64, len(codes)).astype(np.uint64)
    codes = np.unique(codes)
    df = spark.createDataFrame([(int(x),) for x in codes.view(np.int64)], "__f0 long")
    got = simhash.links_exact(df, Scratch(spark), 2, 100).collect()
    at = {int(x): k for k, x in enumerate(codes.view(np.int64))}
    d = np.bitwise_count(codes[:, None] ^ codes[None])
    links = list(zip(*np.nonzero(np.tril(d <= 2, -1))))
    assert all(d[at[r.a], at[r.b]] == r.d <= 2 for r in got)
    assert union(len(codes), links) == union(len(codes), [(at[r.a], at[r.b]) for r in got])


def test_pruning_leaves_most_nodes_out():
    rng = np.random.default_rng(6)
    codes = rng.integers(0, 2**63, (20_000, 1), dtype=np.uint64)
    codes = codes[gray_index.gray_order(codes)]
    index, q = gray_index.GrayIndex(codes), codes[::200]
    found = index.within(q, 2)
    assert (np.bitwise_count(q[found[0]] ^ codes[found[1]])[:, 0] == found[2]).all() and set(range(100)) <= set(found[0].tolist())
    for (mask, pattern), most in zip(index.levels[1:3], (0.1, 0.25)):  # of the nodes over codes, few are entered
        passed = np.bitwise_count((q[:, None] ^ pattern[None]) & mask[None])[:, :, 0] <= 2
        assert passed.mean() < most


def family(n, true_pairs, rng):
    """Rows of one family that share about 0.75 of their five-word shingles' positions, and pairs inside it that
    share nearly all."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]

    def member():
        cut = rng.randrange(300)
        return [*base[:cut], *(f"v{rng.randrange(10**6)}" for _ in range(100)), *base[cut + 100 :]]

    rows = [(10 * k, member()) for k in range(n)]
    for k in rng.sample(range(n), true_pairs):
        twin = list(rows[k][1])
        twin[rng.randrange(400)], twin[rng.randrange(400)] = "changed", "twice"
        rows.append((10 * k + 1, twin))
    return [(i, " ".join(w)) for i, w in rows]


def test_hot_nodes_keep_recall(spark):
    rng = random.Random(8)
    rows = family(500, 60, rng)
    sets = [{tuple(t.split()[i : i + 5]) for i in range(396)} for _, t in rows]
    root = union(len(rows), [(j, i) for i in range(len(rows)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])])
    ids = {r.doc_id for r in simhash.drop_near_duplicates(docs(spark, rows), leaf_size=8).collect()}
    want = {rows[r][0] for r in root}
    assert want <= ids and len(ids - want) <= 0.05 * (len(rows) - len(want))


def test_links_hidden_by_a_closer_row_are_checked(spark, monkeypatch):
    """x-y is alike, x-z and z-y are not, but z's codes stand closer to both."""
    monkeypatch.setattr(simhash, "sampled_masks", lambda words, *_: [(0,) * words])
    rows = []
    for seed in range(400):
        rng = random.Random(seed)
        base = [f"w{rng.randrange(10**8)}" for _ in range(400)]
        xyz = [" ".join([*base[:at], *(f"v{rng.randrange(10**8)}" for _ in range(n)), *base[at + n :]]) for at, n in ((50, 15), (150, 16), (250, 24))]
        x, y, z = (simhash.set_codes(simhash.shingle_set(t.encode(), 5), 4) for t in xyz)
        xy, xz, zy = (sum(((i ^ j) & 2**64 - 1).bit_count() for i, j in zip(a, b)) for a, b in ((x, y), (x, z), (z, y)))
        if max(xz, zy) < xy <= 55:
            rows += [(10 * seed + k, t) for k, t in enumerate(xyz)]
        if len(rows) == 30:
            break
    ids = {r.doc_id for r in simhash.drop_near_duplicates(docs(spark, rows)).collect()}
    assert len(rows) == 30 and ids == {i for i, _ in rows if i % 10 != 1}


def test_repeats_do_not_hide_equal_sets(spark):
    rng = random.Random(4)
    rows = []
    for k in range(20):
        base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        rows += [(10 * k, " ".join(base)), (10 * k + 1, " ".join(base + base[50:80] * 20))]
    assert {r.doc_id for r in simhash.drop_near_duplicates(docs(spark, rows)).collect()} == {10 * k for k in range(20)}


def test_shingles_across_chunks(monkeypatch):
    text = b" ".join(b"w%d" % (k % 50) for k in range(400))
    want, code = simhash.shingle_set(text, 3), simhash.fingerprint(text, 3)
    monkeypatch.setattr(simhash, "_CHUNK", 40)
    assert simhash.shingle_set(text, 3).tolist() == want.tolist() and len(want) == 50
    assert simhash.fingerprint(text, 3) == code


@pytest.mark.parametrize("columns", [7, 8192])
def test_alike_against_brute_force(monkeypatch, columns):
    monkeypatch.setattr(simhash, "_COLUMNS", columns)
    rng = np.random.default_rng(9)
    for n in (2, 3, 40):
        base = [rng.integers(0, 2**31, 60) for _ in range(3)]
        sets = [np.unique(np.concatenate([b[rng.random(60) < 0.93], rng.integers(0, 2**31, 2)])).astype(np.int32) for b in (base[rng.integers(3)] for _ in range(n))]
        links = [(j, i) for i in range(n) for j in range(i) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))]
        assert union(n, list(simhash.alike(sets, 0.8))) == union(n, links)
    same = [np.arange(5, dtype=np.int32)] * 3
    assert len(list(simhash.alike(same, 0.8))) == 2


def test_equal_sets_and_stars(spark):
    """Many rows with one set of shingles, and a family around them: the first row stays."""
    rng = random.Random(6)
    base = words(rng, 120)
    rows = [(k, base.replace(" ", "  " if k % 2 else "\t")) for k in range(50, 150)] + [(7, base + " end"), (None, base + "  end"), (9, words(rng, 120))]
    got = simhash.drop_near_duplicates(docs(spark, rows), leaf_size=4).collect()
    assert sorted(r.doc_id for r in got) == [7, 9]


def test_copies_in_a_large_family_grow_with_its_rows(spark, monkeypatch):
    """Near copies of one text: what meets in groups stays in line with the rows, and every link's ends are joined."""
    met, groups = [], simhash._alike_groups
    monkeypatch.setattr(simhash, "_alike_groups", lambda g, s: met.append(g.agg(F.sum(F.size("m"))).first()[0] or 0) or groups(g, s))
    rng = np.random.default_rng(3)
    base, counts = np.unique(rng.integers(0, 2**31, 100)).astype(np.int32), []
    for n in (200, 800):
        sets = [np.unique(np.concatenate([base[rng.random(len(base)) < 0.97], rng.integers(0, 2**31, 2, np.int32)])) for _ in range(n - 2)]
        sets += [base[:70], np.concatenate([base[:69], [np.int32(5)]])]  # a pair that is alike, but not like the rest
        table = spark.createDataFrame([(k, np.sort(s).tolist()) for k, s in enumerate(sets)], "__id long, s array<int>")
        member = table.selectExpr("__id AS node", "0L AS root")
        met.clear()
        links = simhash.alike_in_families(member, table, Scratch(spark), 0.8, 20).collect()
        assert len({*union(n, [(r.a, r.b) for r in links])}) == 2
        counts.append(sum(met))
    assert counts[1] < 6 * counts[0] and counts[1] < 8 * 800

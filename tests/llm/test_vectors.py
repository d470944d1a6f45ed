"""Vector codes and whitening against plain numpy."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.llm.feast import count_below, interval_pairs, slices
from trackspark.llm.queries import QUERIES
from trackspark.llm.vector_codes import OrchardSearch, compress_vectors
from trackspark.llm.whitening import whiten_vectors

DATA = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int"


def codes_by_loop(rows, parts, entries, rounds=2):
    """rows: (vec_id, vector, label) that are kept. One (id, code, error, label_error) a row, and the digest."""
    x = np.floor(256 * np.array([v for _, v, _ in rows], float)).astype(np.int64).reshape(len(rows), parts, -1)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, x[i].ravel().tolist()))
    books = x[order[:entries]].transpose(1, 0, 2).copy()

    def nearest():
        d = ((x[:, :, None] - books[None]) ** 2).sum(3)
        return d.argmin(2), d.min(2)

    for _ in range(rounds):
        at, _d = nearest()
        for p in range(parts):
            for e in range(books.shape[1]):
                mine = at[:, p] == e
                if mine.any():
                    books[p, e] = x[mine, p].sum(0) // mine.sum()
    at, d = nearest()
    error = d.sum(1)
    by = {}
    for (_, _, label), e in zip(rows, error.tolist()):
        by[label] = by.get(label, 0) + e
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return sorted(((i, bytes(a.astype(np.uint8)).hex(), int(e), by[label], digest) for (i, _, label), a, e in zip(rows, at, error)), key=str)


def test_orchard_search_is_exact_with_ties(spark):
    rng = np.random.default_rng(5)
    for spread, n in ((2, 64), (3, 64), (50, 64), (1, 5), (4, 1)):
        books = rng.integers(-spread, spread + 1, (4, n, 3))  # small spreads: equal entries and equal distances
        x = rng.integers(-2 * spread, 2 * spread + 1, (300, 4, 3))
        d = ((x[:, :, None] - books[None]) ** 2).sum(3)
        at, best = OrchardSearch(books).nearest(x)
        assert (at == d.argmin(2)).all() and (best == d.min(2)).all()


def test_codes_of_the_table(spark, rows):
    e = spark.read.parquet(f"{DATA}/embeddings.parquet")
    want = codes_by_loop([(r.vec_id, r.embedding, r.label) for r in e.collect()], 16, 64)
    assert rows(QUERIES["op13_vector_codes"](spark, DATA)) == want


def test_codes_of_odd_rows(spark, rows):
    """Nulls anywhere, non-finite entries, repeated rows and ids, null labels, fewer rows than entries."""
    rng = np.random.default_rng(1)
    v = lambda: [float(np.float32(a)) for a in rng.normal(0, 1, 8)]
    same = v()
    kept = [(1, v(), 1), (1, v(), None), (2, same, 1), (2, same, 1), (None, v(), None), (None, v(), 2), (-3, [0.0] * 8, 2)]
    out = [(5, None, 1), (6, [1.0, None] + [0.0] * 6, 1), (7, [float("nan")] * 8, None), (8, [float("inf")] + [0.0] * 7, 1)]
    df = spark.createDataFrame(kept + out, SCHEMA).withColumn("code", F.lit("x")).withColumn("__x", F.lit(7))
    for parts, entries in ((2, 64), (4, 3), (8, 1)):
        found = compress_vectors(df, parts=parts, entries=entries)
        assert found.columns == ["vec_id", "embedding", "label", "__x", "code", "error", "label_error", "codebooks_sha256"]
        assert rows(found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")) == codes_by_loop(kept, parts, entries)
    none = compress_vectors(spark.createDataFrame(out, SCHEMA))
    assert none.count() == 0 and none.schema["error"].dataType.simpleString() == "bigint"
    for bad in ([(1, [0.0] * 8, 1), (2, [0.0] * 4, 1)], [(1, [0.0] * 7, 1)], [(1, [1e30] * 8, 1)]):
        with pytest.raises(ValueError):
            compress_vectors(spark.createDataFrame(bad, SCHEMA), parts=8)


def test_codes_do_not_depend_on_the_layout(spark, rows):
    e = spark.read.parquet(f"{DATA}/embeddings.parquet")
    assert rows(compress_vectors(e.repartition(7), carry=False)) == rows(compress_vectors(e.coalesce(1), carry=False))


@pytest.mark.parametrize(
    "values",
    [
        np.linspace(1, 50, 24), [7.0] * 12, [5.0] * 5 + [3.0] * 8 + [1e-20] * 4, 10.0 ** -np.arange(14), [0.0] * 6, [2.0],
        np.concatenate([[100.0] * 3, 50 + np.arange(9) * 1e-11, np.linspace(0, 1, 12)]), np.concatenate([np.linspace(1, 9, 9), np.zeros(20)]),
    ],
)
def test_contour_integration_finds_every_pair(values):
    rng = np.random.default_rng(3)
    d = len(values)
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    a = q @ np.diag(np.asarray(values, float)) @ q.T
    a = (a + a.T) / 2
    want = np.linalg.eigvalsh(a)
    for shift in (-1.0, 0.37, 1.5, 60.0):
        assert count_below(a, shift) == int((want < shift).sum())
    most = min(8, d)
    got = []
    for low, high, n in slices(a, most):
        value, vector = interval_pairs(a, low, high, n)
        assert len(value) == n and np.abs(vector.T @ vector - np.eye(n)).max() < 1e-10
        assert np.abs(a @ vector - vector * value).max() < 1e-12 * max(want[-1], 1e-300)
        got += value.tolist()
    want = [w for w in want[::-1] if w > 1e-11 * want[-1] and w > 1e-11][:most]
    assert len(got) >= len(want) and np.allclose(sorted(got)[::-1][: len(want)], want, rtol=1e-4, atol=1e-13)


def whitened_by_numpy(vectors, k):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    y = x - s / n
    e, q = np.linalg.eigh(y.T @ y / n)
    e, q = e[::-1], q[:, ::-1]
    k = min(k, int((e > 1e-9 * e[0]).sum()))
    return [int(sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s))) for r in x], y @ q[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def check_whitening(found, ids, vectors, k=32):
    deviation, z, explained = whitened_by_numpy(vectors, k)
    p = found.toPandas().sort_values(["vec_id", "component"])
    n, k = z.shape
    assert len(p) == n * k and (p["n"] == n).all() and p["identity_error"].nunique() == 1 and p["identity_error"].iloc[0] < 1e-8
    order = np.argsort(ids, kind="stable")
    got = p["whitened"].to_numpy().reshape(n, k)
    sign = np.sign((got * z[order]).sum(0))
    assert np.abs(got - sign * z[order]).max() < 1e-7
    assert np.allclose(p["explained"].to_numpy().reshape(n, k), explained)
    assert p["deviation"].to_numpy().reshape(n, k)[:, 0].tolist() == [deviation[i] for i in order]


def test_whitening_of_the_table(spark):
    e = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    check_whitening(QUERIES["op12_whitening"](spark, DATA), [r.vec_id for r in e], [r.embedding for r in e])


def test_whitening_of_odd_rows(spark):
    """Nulls anywhere, non-finite entries, constant and equal dimensions, fewer rows than dimensions, one row."""
    rng = np.random.default_rng(2)
    v = lambda: [float(np.float32(a)) for a in rng.normal(0, 9, 6)]
    kept = [(i, v()[:4] + [2.5, 2.5], None) for i in range(12)]
    out = [(50, None, 1), (51, [None] * 6, 1), (52, [float("nan")] * 6, 1), (53, [-float("inf")] * 6, 1)]
    df = spark.createDataFrame(kept + out, SCHEMA).withColumn("n", F.lit("x")).withColumn("component", F.lit(0))
    found = whiten_vectors(df)
    assert found.columns == ["vec_id", "embedding", "label", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check_whitening(found, range(12), [r[1] for r in kept])
    check_whitening(whiten_vectors(df, components=2), range(12), [r[1] for r in kept], 2)
    few = [(i, v(), None) for i in range(4)]
    check_whitening(whiten_vectors(spark.createDataFrame(few, SCHEMA)), range(4), [r[1] for r in few])
    for none in (few[:1], [few[0]] * 5, out):
        assert whiten_vectors(spark.createDataFrame(none, SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        whiten_vectors(spark.createDataFrame([few[0], (1, [1.0], 2)], SCHEMA))
    # null and repeated ids, repeated rows
    twice = spark.createDataFrame([(None, r[1], 1) for r in kept] * 2, SCHEMA)
    assert whiten_vectors(twice).count() == 24 * 4

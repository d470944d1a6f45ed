"""Queries of the training-data operators against their DuckDB forms, and the pipeline's stages."""

import collections
import os
import re

import pytest

import corpus_pipeline
from tests.llm.test_mix_pack_shard import brute_targets, check_packing
from tests.test_entry import DATA, agrees
from trackspark.llm.queries import ORACLES, QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_oracle(spark, name):
    agrees(spark, name)


def test_every_operator_has_a_query():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))


def test_pipeline_keeps_columns_and_takes_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, made = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        made.append(stage(spark, made[-1], DATA))
    # a result outlives the stages after it
    assert all(d.columns == columns for d in made[:-1])
    n = [d.count() for d in made]
    assert n[0] > n[1] > n[2] >= n[3]
    assert made[-1].where("n_words > 2048").count() == 0
    assert corpus_pipeline.run(spark, DATA).count() == n[-1]


def test_pipeline_on_an_empty_table_with_more_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0).selectExpr("*", "1 AS __id", "'x' AS kept", "2 AS n_words")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        columns, docs = docs.columns, stage(spark, docs, DATA)
        assert docs.count() == 0 and (k == 4 or docs.columns == columns)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_pipeline_against_brute_force(spark):
    """Each stage's rows by plain Python: the ones that stay, and for the mix and the bins what must hold."""
    rows = [r.asDict() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    stages = [f for _, f in corpus_pipeline.STAGES]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    good = stages[0](spark, docs, DATA)
    verdicts = {r.doc_id: r.kept for r in QUERIES["op3_quality_rules"](spark, DATA).collect()}
    assert {r.doc_id for r in good.collect()} == {i for i, k in verdicts.items() if k}
    kept = {}
    for r in rows:
        if verdicts[r["doc_id"]]:
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
            kept[text] = max(kept.get(text, -1), r["doc_id"])
    unlike = stages[1](spark, good, DATA)
    assert {r.doc_id for r in unlike.collect()} == set(kept.values())
    ids = sorted((i, t) for t, i in kept.items())
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, [x.lower() if x.isascii() else x for x in words_of(t)]) for i, t in ids)}
    group, order = {i: i for i in sets}, sorted(sets)

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for x, a in enumerate(order):
        for b in order[:x]:
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and root(a) != root(b):
                group[max(root(a), root(b))] = min(root(a), root(b))
    near = stages[2](spark, unlike, DATA)
    stay = {r.doc_id for r in near.collect()}
    want = {i for i in sets if root(i) == i}
    assert want <= stay and len(stay - want) <= 0.05 * (len(sets) - len(want))
    mixed = stages[3](spark, near, DATA)
    taken, sizes, longest = (collections.Counter() for _ in range(3))
    texts = {r["doc_id"]: r for r in rows}
    for i in stay:
        n = len(words_of(texts[i]["text"]))
        sizes[texts[i]["source"]] += n
        longest[texts[i]["source"]] = max(longest[texts[i]["source"]], n)
    got = [r.doc_id for r in mixed.collect()]
    for i in got:
        taken[texts[i]["source"]] += len(words_of(texts[i]["text"]))
    target = brute_targets(dict(sizes))
    assert set(got) <= stay and all(abs(taken[s] - target[s]) <= longest[s] for s in sizes)
    packed = stages[4](spark, mixed, DATA).collect()
    check_packing([(i, texts[i]["text"], None, texts[i]["source"]) for i in got], packed, 2048, one_per_source=False)

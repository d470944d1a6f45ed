"""Toxicity: held-out accuracy on the tables, the label model on planted voters, odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.llm import toxicity
from trackspark.llm.queries import QUERIES
from trackspark.llm.toxicity import FIRST, LabelModel, Lexicon, entries_of, fit_label_model, mine_lexicon, score_toxicity

SMALL, DATA = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def area_under_curve(score, label):
    rank = np.argsort(np.argsort(score)) + 1
    n1 = label.sum()
    return (rank[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(label) - n1))


def test_held_out_accuracy(spark):
    found = QUERIES["op11_toxicity"](spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").toPandas()
    held = [zlib.crc32(str(i).encode()) % 5 == 0 for i in found["doc_id"]]
    assert (found["held_out"] == held).all() and ((found["score"] >= 0.5) == (found["predicted"] == 1)).all()
    f = found[found["held_out"]]
    label, hit = f["toxic"].to_numpy(), f["predicted"].to_numpy()
    assert area_under_curve(f["score"].to_numpy(), label) > 0.94
    assert hit[label == 1].mean() > 0.9 and label[hit == 1].mean() > 0.95


def test_labels_that_are_held_out_are_never_read(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    swapped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda l: sorted(score_toxicity(docs, l, carry=False).select("doc_id", F.round("score", 9)).collect())
    assert score(labels) == score(swapped)


def test_reading_a_text():
    lexicon = Lexicon(["idiot", "bad-", "rest"], [0.0, 0.4, 0.1], 2)
    text = "You IDIOT!! badly bad, rest " + "word " * 95
    ids, shares = lexicon.read(text)
    got = dict(zip(ids, shares))
    names = list(toxicity.PATTERNS)
    # 'bad' itself is no beginning of a longer word; 'rest' does not vote, so all entries together have two hits
    assert got == {names.index("insult"): 1.0, names.index("aimed"): 1.0, names.index("shout"): 1.0, names.index("marks"): 1.0, FIRST - 1: 2.0, FIRST: 1.0, FIRST + 1: 1.0, FIRST + 2: 1.0}
    assert lexicon.read("") == ([], []) and lexicon.read("12 ### \n") == ([], [])
    assert entries_of("badly") == ["badly", "bad-", "badl-"]
    assert lexicon.read("idiot " * 50_000)[1][-1] == toxicity.TOP


def test_mining_takes_what_chance_does_not_give(spark):
    rng = np.random.default_rng(4)
    words = [f"{a}{b}" for a in "bcdfghklmn" for b in ("ala", "emo", "ira", "ost", "utu", "alo")]
    rows = []
    for i in range(600):
        text = rng.choice(words, 60).tolist()
        if i % 6 == 0:
            text += rng.choice(["foulest", "foulish", "grim"], 2).tolist()
        rows.append((" ".join(text), int(i % 6 == 0)))
    lexicon = mine_lexicon(spark.createDataFrame(rows, "text string, toxic int"), 100, 50, 4)
    assert set(lexicon.entries) <= {e for w in ("foulest", "foulish", "grim") for e in entries_of(w)}
    assert {"foul-", "grim"} <= set(lexicon.entries)
    assert mine_lexicon(spark.createDataFrame([("a b", 0)], "text string, toxic int"), 9, 9, 4).entries == []


def test_label_model_learns_rates_and_discounts_copies(spark):
    """Voters of known rates; one of them ten times. Labels of a third of the rows, a tenth of them wrong."""
    rng = np.random.default_rng(8)
    n, rates = 6000, [(0.05, 0.6), (0.1, 0.5), (0.02, 0.3), (0.2, 0.25)]
    y = rng.random(n) < 0.2
    votes = np.stack([rng.random(n) < np.where(y, b, a) for a, b in rates], 1)
    copied = np.concatenate([votes, np.repeat(votes[:, 3:], 9, 1)], 1)
    wrong = rng.random(n) < 0.1
    rows = []
    for i in range(n):
        label = int(y[i] ^ wrong[i]) if i % 3 == 0 else None
        at = np.flatnonzero(copied[i])
        rows.append(([int(FIRST + j) for j in at], [1.0] * len(at), label))
    signals = spark.createDataFrame(rows, "ids array<int>, shares array<double>, label int")
    model = fit_label_model(signals, Lexicon([str(j) for j in range(13)], [0.0] * 13, 13))
    assert isinstance(model, LabelModel) and abs(model.share - 0.2) < 0.06
    mined = model.rates[:, -13:]
    for j, (a, b) in enumerate(rates):
        assert abs(mined[0, j] - a) < 0.06 and abs(mined[1, j] - b) < 0.15
    c = model.correlations[-10:, -10:]
    assert c.min() > 0.8 and np.abs(model.correlations[-13, -12]) < 0.2
    w, _ = model.weights()
    assert w[-10:].sum() < w[-13]  # ten copies of a weak voter weigh less than one good voter


def test_odd_rows(spark):
    """Null ids and texts, empty and very long texts, repeated rows, clashing names, labels of none or one class."""
    text = "calm words here and there " * 20
    bad = "you idiot scum " + text
    rows = [(i, bad if i % 3 == 0 else text) for i in range(90)] + [(None, bad), (7, None), (7, ""), (8, "x " * 200_000), (9, "### 12")]
    df = spark.createDataFrame(rows + rows[-3:], "doc_id long, text string").withColumn("score", F.lit("y")).withColumn("label", F.lit(3)).withColumn("toxic", F.lit(1))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(3, 0), (4, None), (None, 1), (10**9, 1)], "doc_id long, toxic int")
    found = score_toxicity(df, labels)
    assert found.columns == ["doc_id", "text", "label", "toxic", "held_out", "score", "predicted"]
    got = found.toPandas()
    assert len(got) == len(rows) + 3 and got["score"].between(0, 1).all()
    assert (got["predicted"] == got["text"].fillna("").str.contains("idiot").astype(int)).all()
    assert got[got["doc_id"].isna()]["held_out"].all()
    assert score_toxicity(df.limit(0), labels).count() == 0
    for few, score in ((labels.limit(0), 0.5), (labels.where("toxic = 0"), 0.0), (labels.where("toxic = 1"), 1.0)):
        assert score_toxicity(df, few, carry=False).select("score").distinct().toPandas()["score"].tolist() == pytest.approx([score], abs=1e-6)

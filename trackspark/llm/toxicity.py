"""Toxicity scores by weak supervision.

1. A bounded sample of labelled rows is mined for lexicon entries: words and beginnings of words that stand in
   toxic texts far more often than in others. Which share of a text's words an entry must reach is chosen with it.
2. Every whole text is read once. What is kept of it are the shares of its words that lexicon entries and
   patterns hit.
3. Voters are lexicon entries and patterns that reach their share. A generative label model over all rows holds
   the voters' rates in either class (their accuracies) and their correlations inside a class, so that entries
   which always vote together count about once. The label of a row is one more voter, with error rates of its own,
   which abstains where there is none. The model is fitted by expectation maximisation; each round adds up one
   vector over all rows. What is left of double counting, a line from the votes' log odds to the sample's labels
   takes off.
4. A linear classifier on the shares is trained on the sample's posterior labels. It alone gives the scores.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ROW, Scratch, name, pack, text_of, unpack

COMPUTED = ["held_out", "score", "predicted"]

TOKEN = re.compile(r"[^\W\d_]+")
#: Words that people call each other, one voter together.
INSULTS = (
    "bastard bitch clown cretin crap creep coward damn dimwit disgusting dumb dumbass dummy failure filth filthy fool freak garbage hate hideous "
    "idiot idiotic ignorant imbecile jerk lame liar loser lunatic moron moronic nasty nutjob pathetic pig rat retard rubbish scum shit shut sick "
    "stupid subhuman sucker sucks trash ugly useless vermin vile weirdo worthless wretched"
).split()
_INSULTS = set(INSULTS)
#: Patterns that may go with toxic texts; whether they do, the label model finds out. ``insult`` counts
#: words of the list above; ``aimed`` is looked for where there are some.
PATTERNS = {
    "insult": None,
    "aimed": re.compile(rf"\byou(?:r|'re)?\W+(?:\w+\W+){{0,3}}?(?:{'|'.join(INSULTS)})\b", re.I),
    "shout": re.compile(r"\b[A-Z]{4,}\b"),
    "marks": re.compile(r"[!?]{2,}"),
    "masked": re.compile(r"\b\w[*@#$]{2,}\w*"),
    "drawn": re.compile(r"([A-Za-z])\1{3,}"),
}
PREFIXES = range(3, 9)  # lengths of beginnings of words
LEVELS = (0.0, 0.1, 0.2, 0.4, 0.8, 1.2)  # hits per 100 words that an entry may have to exceed
HIT_LEVELS = (0.5, 1.0, 1.5)  # the same for all entries together
TOP = 5.0  # shares above it count as it
FIRST = len(PATTERNS) + 1  # features: the patterns, all entries together, then entry by entry


def entries_of(word: str) -> list[str]:
    """The lexicon entries that a word may hit: itself and, with a dash, its beginnings."""
    return [word] + [word[:k] + "-" for k in PREFIXES if k < len(word)]


def _words(text: str) -> Counter:
    """How often each run of letters occurs, in lower case. Whole pieces between white space are counted first."""
    words: Counter = Counter()
    for piece, times in Counter(text.lower().split()).items():
        if piece.isalpha():
            words[piece] += times
        else:
            for word in TOKEN.findall(piece):
                words[word] += times
    return words


def level_of(share: float) -> int:
    """The number of levels that a share exceeds."""
    return sum(share > at for at in LEVELS)


@dataclass
class Lexicon:
    """entries: what to look for, the strongest first; shares: the level each must exceed to vote; the first
    ``voters`` of them vote."""

    entries: list[str]
    shares: list[float]
    voters: int

    def __post_init__(self):
        self.index = {e: i for i, e in enumerate(self.entries)}
        self.starts = {e[: PREFIXES[0]] for e in self.entries} | {w[: PREFIXES[0]] for w in INSULTS}

    @property
    def width(self) -> int:
        return FIRST + len(self.entries)

    def thresholds(self) -> tuple[np.ndarray, np.ndarray]:
        """(feature, share to exceed) of every voter."""
        at = [(i, 0.0) for i in range(len(PATTERNS))] + [(FIRST - 1, s) for s in HIT_LEVELS]
        at += [(FIRST + i, s) for i, s in enumerate(self.shares[: self.voters])]
        return np.array([i for i, _ in at]), np.array([s for _, s in at])

    def read(self, text: str) -> tuple[list[int], list[float]]:
        """Features of a text that are not zero: hits per 100 words, 5 at most. Words are runs of letters."""
        words = _words(text)
        n = sum(words.values())
        if not n:
            return [], []
        hits: Counter = Counter()
        for word, times in words.items():
            if word[: PREFIXES[0]] in self.starts:
                own = [self.index[e] for e in entries_of(word) if e in self.index]
                for i in own:
                    hits[FIRST + i] += times
                if own and min(own) < self.voters:
                    hits[FIRST - 1] += times
                if word in _INSULTS:
                    hits[0] += times
        for i, (kind, p) in enumerate(PATTERNS.items()):
            if p is not None and (kind != "aimed" or hits[0]) and (found := sum(1 for _ in p.finditer(text))):
                hits[i] = found
        ids = sorted(i for i, k in hits.items() if k)
        return ids, [min(TOP, 100.0 * hits[i] / n) for i in ids]


def mine_lexicon(sample: DataFrame, entries: int, voters: int, support: int) -> Lexicon:
    """sample (text, toxic), bounded: the ``entries`` entries that most favour toxic texts, ``voters`` of them to
    vote. An entry stands in ``support`` toxic texts at least, and its likelihood ratio is beyond what the best of
    as many entries would reach by chance."""
    rows = {int(t): n for t, n in sample.groupBy("toxic").count().collect()}
    n1, n0 = rows.get(1, 0), rows.get(0, 0)
    if not n1 or not n0:
        return Lexicon([], [], 0)

    def counts(known: set[str] | None):
        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen: Counter = Counter()
            for b in batches:
                for text, toxic in zip(b["text"], b["toxic"]):
                    words = _words(text)
                    n, own = sum(words.values()), Counter()
                    for word, times in words.items():
                        for e in entries_of(word):
                            if known is None or e in known:
                                own[e] += times
                    for e, times in own.items():
                        seen[e, level_of(100.0 * times / n) if known is not None else 1, toxic] += 1
            yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["entry", "level", "toxic", "n"])

        return count

    schema = "entry string, level int, toxic int, n long"
    frequent = sample.where("toxic = 1").mapInPandas(counts(None), schema).groupBy("entry").agg(F.sum("n").alias("n"))
    known = {r.entry for r in frequent.where(F.col("n") >= support).select("entry").collect()}  # at most the sample's entries / support
    shared = sample.sparkSession.sparkContext.broadcast(known)
    levels = sample.mapInPandas(lambda it: counts(shared.value)(it), schema)
    sums = [F.sum(F.when((F.col("level") > i) & (F.col("toxic") == t), F.col("n")).otherwise(0)).alias(f"c{t}_{i}") for t in (1, 0) for i in range(len(LEVELS))]
    table = levels.groupBy("entry").agg(*sums).toPandas().sort_values("entry")
    k1, k0 = (table[[f"c{t}_{i}" for i in range(len(LEVELS))]].to_numpy(float) for t in (1, 0))

    def likelihood(k: np.ndarray, n: float) -> np.ndarray:
        p = np.clip(k / n, 1e-12, 1 - 1e-12)
        return k * np.log(p) + (n - k) * np.log(1 - p)

    gain = likelihood(k1, n1) + likelihood(k0, n0) - likelihood(k1 + k0, n1 + n0)
    gain[(k1 * n0 <= k0 * n1) | (k1 < support)] = 0
    best = gain.argmax(1)
    top = gain.max(1)
    order = [i for i in np.argsort(-top, kind="stable") if top[i] > np.log(max(len(table), 2)) + 3][:entries]
    return Lexicon([table["entry"].iloc[i] for i in order], [LEVELS[best[i]] for i in order], min(voters, len(order)))


def dense(ids: pd.Series, shares: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(ids), width))
    for i, (at, s) in enumerate(zip(ids, shares)):
        out[i, np.asarray(at, np.int64)] = s
    return out


@dataclass
class LabelModel:
    """rates: each voter's rate of votes in clean and toxic texts; correlations: of voters inside a class; label:
    rate of the label 1 in clean and toxic texts; share: of toxic texts; line: from log odds to calibrated ones."""

    rates: np.ndarray
    correlations: np.ndarray
    label: np.ndarray
    share: float
    line: tuple[float, float] = (0.0, 1.0)

    def weights(self) -> tuple[np.ndarray, float]:
        """Log odds of a toxic text are linear in its votes. A voter counts by one over the sum of its squared
        correlations, itself included: copies of one voter count once together."""
        once = 1 / (self.correlations**2).sum(1)
        voted, silent = (once * np.log(r[1] / r[0]) for r in (self.rates, 1 - self.rates))
        return voted - silent, float(np.log(self.share / (1 - self.share)) + silent.sum())

    def odds(self, votes: np.ndarray) -> np.ndarray:
        w, start = self.weights()
        return self.line[0] + self.line[1] * (start + votes @ w)

    def posterior(self, votes: np.ndarray, label: np.ndarray) -> np.ndarray:
        """label: 0, 1 or nan."""
        z = self.odds(votes)
        one, zero = np.log(self.label[1] / self.label[0]), np.log((1 - self.label[1]) / (1 - self.label[0]))
        z = z + np.where(np.isnan(label), 0.0, np.where(label == 1, one, zero))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_label_model(signals: DataFrame, lexicon: Lexicon, rounds: int = 8, smooth: float = 1.0) -> LabelModel:
    """signals (ids, shares, label) of all rows. The first round takes classes from the labels alone; each further
    one adds up votes by the posterior of the one before, until nothing changes. Correlations inside a class are
    what all rows' products, made once, leave after both classes' means. ``smooth`` keeps rates off 0 and 1."""
    at, least = lexicon.thresholds()
    m, width = len(at), lexicon.width

    def votes_of(b: pd.DataFrame) -> np.ndarray:
        return (dense(b["ids"], b["shares"], width)[:, at] > least).astype(float)

    def total(sums) -> np.ndarray:
        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            s = 0.0
            for b in batches:
                if len(b):
                    s = s + sums(votes_of(b), b["label"].to_numpy(float))
            if not np.isscalar(s):
                yield pd.DataFrame({"s": [s]})

        added = signals.select("ids", "shares", "label").mapInPandas(partial, "s array<double>").select(F.posexplode("s").alias("i", "s"))
        found = added.groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()  # (voters + 5) or voters ** 2 numbers
        return np.array([r.s for r in found])

    def by_class(r: np.ndarray, votes: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Rows, votes and labels (rows that have one, rows that have 1) of the toxic class, then labels of the clean."""
        has, one = ~np.isnan(label), label == 1
        return np.concatenate([[r.sum()], votes.T @ r, [r[has].sum(), r[one].sum(), (1 - r)[has].sum(), (1 - r)[one].sum()]])

    def all_rows(votes: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Rows, votes and products of votes: of all rows, then of those with a label."""
        return np.concatenate([np.concatenate([[len(v)], v.sum(0), (v.T @ v).ravel()]) for v in (votes, votes[~np.isnan(label)])])

    def model(toxic: np.ndarray, sums: np.ndarray, label: np.ndarray) -> LabelModel:
        n, votes, second = sums[0], sums[1 : m + 1], sums[m + 1 :].reshape(m, m)
        n1 = np.clip(toxic[0], 1e-6, n - 1e-6)
        mean = np.stack([(votes - toxic[1 : m + 1]) / (n - n1), toxic[1 : m + 1] / n1]).clip(0, 1)
        inside = (second - (n - n1) * np.outer(mean[0], mean[0]) - n1 * np.outer(mean[1], mean[1])) / n
        spread = np.sqrt(np.maximum(np.diag(inside), 1e-12))
        correlations = np.clip(inside / np.outer(spread, spread), -1, 1)
        np.fill_diagonal(correlations, 1.0)
        # as if ``smooth`` more rows of either class had voted as often as all rows do
        rows, often = np.array([[n - n1], [n1]]), (votes + smooth / 2) / (n + smooth)
        rates = (mean * rows + smooth * often) / (rows + smooth)
        return LabelModel(rates, correlations, np.clip(label, 0.005, 0.995), float(np.clip(n1 / n, 1e-4, 0.5)))

    sums = total(all_rows)
    every, labelled = sums.reshape(2, -1)
    now = model(total(lambda v, y: by_class((y == 1).astype(float), v, y)), labelled, np.array([0.01, 0.99]))
    before = None
    for _ in range(rounds):
        s = total(lambda v, y: by_class(now.posterior(v, y), v, y))
        if before is not None and np.allclose(s, before, rtol=1e-9, atol=1e-9):
            break
        before, (has1, one1, has0, one0) = s, s[m + 1 :]
        now = model(s, every, np.array([(one0 + smooth) / (has0 + 2 * smooth), (one1 + smooth) / (has1 + 2 * smooth)]))
    return now


def score_toxicity(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    *,
    fit_rows: int = 20_000,
    entries: int = 512,
    voters: int = 256,
    support: int = 4,
    folds: int = 5,
    seed: int = 11,
    carry: bool = True,
    scratch: Scratch | None = None,
) -> DataFrame:
    """One row per input row: the input columns (only ``id_col`` if not ``carry``), then held_out (CRC-32 of the id
    as text is divisible by ``folds``), score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= 0.5).

    labels (id_col, label_col): labels of ids that are held out are never read. The lexicon and the classifier are
    fitted on the labelled rows of the ``fit_rows`` ids that come first by a hash; the label model on all rows.
    Scores are a function of the text alone. Null text: empty; texts without words get the score of no hits. Null
    id: held out, without a label. Ids with several labels: the largest; null labels: none. Repeated rows: alike.
    No labels of either kind: all scores are the share of label 1 (0.5 if there are none). Empty table: no rows. A
    computed column replaces an input column of its name.
    """
    spark = df.sparkSession
    scratch = scratch or Scratch(spark)
    held = lambda c: F.coalesce(F.crc32(c.cast("string").cast("binary")) % folds == 0, F.lit(True))
    key = F.col(name(id_col))
    known = labels.select(key.alias("__id"), F.col(name(label_col)).cast("int").alias("toxic")).where(~held(F.col("__id")) & F.col("toxic").isin(0, 1))
    known = scratch.write(known.groupBy("__id").agg(F.max("toxic").alias("toxic")), "labels")
    docs = df.select(pack(df, df.columns if carry else [id_col]), key.alias("__id"), text_of(text_col).alias("text"))

    chosen = known.orderBy(F.xxhash64("__id", F.lit(seed)), "__id").limit(fit_rows)
    sample = docs.select("__id", "text").join(F.broadcast(chosen), "__id")  # fit_rows rows
    sample = scratch.write(sample.groupBy("__id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic"), "sample")
    lexicon = mine_lexicon(sample, entries, voters, support)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [lexicon.read(text) for text in b.column("text").to_pylist()]
            ids, shares = pa.array([i for i, _ in found], pa.list_(pa.int32())), pa.array([s for _, s in found], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(ROW), b.column("__id"), ids, shares], names=[ROW, "__id", "ids", "shares"])

    schema = docs.select(ROW, "__id").schema.add("ids", T.ArrayType(T.IntegerType())).add("shares", T.ArrayType(T.DoubleType()))
    signals = scratch.write_arrow(docs.mapInArrow(read, schema), "signals", batch_rows=1000)
    labelled = scratch.write(signals.select("__id", "ids", "shares").join(known, "__id", "left").withColumnRenamed("toxic", "label"), "labelled")
    weights, start = _classifier(labelled, chosen, lexicon)

    hit = F.zip_with("ids", "shares", lambda i, s: F.element_at(F.array(*[F.lit(float(w)) for w in weights]), i + 1) * s)
    z = F.aggregate(hit, F.lit(start), lambda total, x: total + x)
    scored = signals.select(ROW, held(F.col("__id")).alias("held_out"), (1 / (1 + F.exp(-z))).alias("score"))
    return unpack(scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0)), COMPUTED)


def _classifier(labelled: DataFrame, chosen: DataFrame, lexicon: Lexicon) -> tuple[list[float], float]:
    """Weights of the features and the intercept, trained on the posterior labels of the chosen ids."""
    classes = {int(r.toxic): r.n for r in chosen.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    flat = [0.0] * lexicon.width
    if len(classes) < 2:
        return flat, float({0: -20, 1: 20}[next(iter(classes))]) if classes else 0.0
    if not labelled.where("label = 1").limit(1).count() or not labelled.where("label = 0").limit(1).count():
        return flat, 0.0
    model, width, (at, least) = fit_label_model(labelled, lexicon), lexicon.width, lexicon.thresholds()

    # one row an id: fit_rows of them
    rows = labelled.join(F.broadcast(chosen), "__id").groupBy("__id").agg(F.min(F.struct("ids", "shares")).alias("s"), F.first("toxic").alias("toxic"))
    rows = rows.select("s.*", "toxic").persist()

    def odds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            z = model.odds((dense(b["ids"], b["shares"], width)[:, at] > least).astype(float))
            yield pd.DataFrame({"z": z.reshape(-1, 1).tolist(), "label": b["toxic"].astype(float)})

    line = _logistic(rows.mapInPandas(odds, "z array<double>, label double"), "z", 1e-6)
    calibrated = replace(model, line=(line.intercept, max(0.0, float(line.coefficients[0]))))

    def posterior(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = dense(b["ids"], b["shares"], width)
                p = calibrated.posterior((x[:, at] > least).astype(float), b["toxic"].to_numpy(float))
                for label, weight in ((1.0, p), (0.0, 1 - p)):
                    yield pd.DataFrame({"x": list(x), "label": label, "weight": weight})

    fitted = _logistic(rows.mapInPandas(posterior, "x array<double>, label double, weight double").where("weight > 1e-6"), "x", 1e-3)
    rows.unpersist()
    return fitted.coefficients.toArray().tolist(), float(fitted.intercept)


def _logistic(rows: DataFrame, x: str, penalty: float) -> LogisticRegressionModel:
    weighted = {"weightCol": "weight"} if "weight" in rows.columns else {}
    return LogisticRegression(regParam=penalty, maxIter=50, **weighted).fit(rows.withColumn("features", array_to_vector(x)))

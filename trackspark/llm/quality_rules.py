"""Quality rules with adaptive thresholds.  DataFrame functions only.

1. Signals of each whole text are computed inside its row, without a shuffle, and written once.
2. Per language and source, each signal gets a quantile sketch: counts of values cut to their seven
   leading bits (relative error below 1/64).  Sketches merge by adding counts, so partial sketches
   combine before the shuffle, and the sketch of a language or of everything is the sum of finer
   ones.  Integer counts make the result the same in every run.
3. Quartiles from the sketches give Tukey fences, which replace fixed cutoffs.  A group's fences are
   drawn to those of its language, and these to those of all rows, as if ``prior_rows`` rows of that
   stood in each: the fewer rows a group has, the more.
4. Rows are joined with the fences of their group and filtered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, Scratch, bucket, name, pack, text_of, unpack, words

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
COMPUTED = [*COUNTS, "base_failed", "kept"]

#: Signal: (integer expression, lower fence too?, least spread in the expression's unit).
#: The least spread keeps a group whose values are all alike from rejecting ordinary variation: with a
#: fence of 3 it lets 75 symbols or capitals a thousand pass where quartiles coincide at zero, and 360
#: repeated words or duplicate lines a thousand.
SIGNALS: dict[str, tuple[str, bool, int]] = {
    "word_length": ("100 * word_chars div n_words", True, 60),
    "symbols": ("1000 * n_symbols div n_words", False, 25),
    "capitals": ("1000 * __upper div greatest(word_chars, 1L)", False, 25),
    "dup_lines": ("1000 * n_dup_lines div greatest(__lines, 1L)", False, 120),
    "repeats": ("1000 * n_repeat_words div n_words", False, 120),
}


def _counts(rows: DataFrame) -> DataFrame:
    """rows: ..., __text. Adds the counts of each text; drops __text."""
    rows = rows.withColumn("__w", words(F.col("__text")))
    rows = rows.select(
        "*",
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("__text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("__text", r"[^A-Z]+", "")).cast("long").alias("__upper"),
        F.filter(F.split("__text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__ln"),
        F.expr("transform(slice(__w, 1, greatest(size(__w) - 2, 0)), (x, i) -> concat_ws(' ', x, get(__w, i + 1), get(__w, i + 2)))").alias("__tri"),
    ).drop("__w", "__text")
    # windows in order of their words, only where any occurs twice
    rows = rows.select(
        *[c for c in rows.columns if c not in ("__ln", "__tri")],
        F.size("__ln").cast("long").alias("__lines"),
        (F.size("__ln") - F.size(F.array_distinct("__ln"))).cast("long").alias("n_dup_lines"),
        F.expr("CASE WHEN size(array_distinct(__tri)) < size(__tri) THEN sort_array(transform(__tri, (t, i) -> struct(t, i))) END").alias("__sorted"),
    )
    rows = rows.withColumn(
        "__starts",
        F.expr(
            "sort_array(transform(filter(__sorted, (x, k) -> coalesce(x.t = get(__sorted, k - 1).t, false) "
            "OR coalesce(x.t = get(__sorted, k + 1).t, false)), x -> x.i))"
        ),
    ).drop("__sorted")
    # each window covers three words, up to the start of the next one
    covered = "aggregate(transform(__starts, (p, k) -> least(3, coalesce(get(__starts, k + 1), p + 3) - p)), 0L, (a, x) -> a + x)"
    return rows.withColumn("n_repeat_words", F.coalesce(F.expr(covered), F.lit(0).cast("long"))).drop("__starts")


def base_failed() -> Column:
    return F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")


def sketches(rows: DataFrame) -> DataFrame:
    """(__lang, __source, signal, bucket, n): one mergeable sketch per language, source and signal."""
    values = F.array(*[F.struct(F.lit(s).alias("signal"), F.col(f"__s_{s}").alias("v")) for s in SIGNALS])
    return (
        rows.where(~F.col("base_failed"))
        .select("__lang", "__source", F.explode(values).alias("x"))
        .select("__lang", "__source", "x.signal", F.expr(bucket("x.v")).alias("bucket"))
        .groupBy("__lang", "__source", "signal", "bucket")
        .agg(F.count("*").alias("n"))
    )


def fences(sketch: DataFrame, fence: float, prior_rows: int) -> DataFrame:
    """One row per language and source: lo_<signal>, hi_<signal>."""
    level = lambda k, lang, source: F.struct(F.lit(k).alias("level"), lang.alias("lang"), source.alias("source"))
    no = F.lit(None).cast("string")
    merged = (
        sketch.withColumn("g", F.explode(F.array(level(2, F.col("__lang"), F.col("__source")), level(1, F.col("__lang"), no), level(0, no, no))))
        .groupBy("g.level", "g.lang", "g.source", "signal", "bucket")
        .agg(F.sum("n").alias("n"))
    )
    group = Window.partitionBy("level", "lang", "source", "signal")
    ranked = merged.withColumn("total", F.sum("n").over(group)).withColumn("upto", F.sum("n").over(group.orderBy("bucket")))
    quartiles = ranked.groupBy("level", "lang", "source", "signal").agg(
        F.max("total").alias("total"),
        F.min(F.expr("CASE WHEN upto * 4 >= total THEN bucket END")).alias("q1"),
        F.min(F.expr("CASE WHEN upto * 4 >= total * 3 THEN bucket END")).alias("q3"),
    )
    least = F.create_map(*[F.lit(x) for s, (_, _, n) in SIGNALS.items() for x in (s, n)])
    spread = F.greatest(F.col("q3") - F.col("q1"), least[F.col("signal")].cast("long")) * F.lit(float(fence))
    low = F.col("signal").isin([s for s, (_, two, _) in SIGNALS.items() if two])
    limits = quartiles.select(
        "level", "lang", "source", "signal", "total",
        F.when(low, F.col("q1") - spread).alias("lo"), (F.col("q3") + spread).alias("hi"),
    )
    ends = [f"{k}_{s}" for s in SIGNALS for k in ("lo", "hi")]
    wide = limits.groupBy("level", "lang", "source").agg(
        F.max("total").alias("total"),
        F.struct(*[F.max(F.when(F.col("signal") == s, F.col(k))).alias(f"{k}_{s}") for s in SIGNALS for k in ("lo", "hi")]).alias("f"),
    )
    drawn = lambda own, n, to: F.struct(*[((own[e] * n + to[e] * F.lit(prior_rows)) / (n + F.lit(prior_rows))).alias(e) for e in ends])
    own = wide.where("level = 2")
    of_all = wide.where("level = 0").select(F.lit(0).alias("__all"), F.col("f").alias("f0"))  # one row
    by_lang = wide.where("level = 1").withColumn("__all", F.lit(0)).join(F.broadcast(of_all), "__all")
    by_lang = by_lang.select(F.col("lang").alias("l1"), drawn(F.col("f"), F.col("total"), F.col("f0")).alias("f1"))
    return (
        own.join(by_lang, F.col("lang").eqNullSafe(F.col("l1")))
        .select(F.col("lang").alias("__l"), F.col("source").alias("__s"), drawn(F.col("f"), F.col("total"), F.col("f1")).alias("f"))
        .select("__l", "__s", "f.*")
    )


def _judged(df: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str, fence: float, prior_rows: int, carry: bool, scratch: Scratch | None = None) -> DataFrame:
    """The packed rows with the counts, base_failed and kept."""
    scratch = scratch or Scratch(df.sparkSession)
    rows = _counts(
        df.select(
            pack(df, None if carry else [id_col]),
            F.col(name(lang_col)).cast("string").alias("__lang"),
            F.col(name(source_col)).cast("string").alias("__source"),
            text_of(text_col).alias("__text"),
        )
    ).withColumn("base_failed", base_failed())
    rows = rows.select(
        ROW, "__lang", "__source", *COUNTS, "base_failed",
        *[F.when(~F.col("base_failed"), F.expr(f"CASE WHEN n_words > 0 THEN {e} END")).alias(f"__s_{s}") for s, (e, _, _) in SIGNALS.items()],
    )
    rows = scratch.write(rows, "signals")
    limits = scratch.write(fences(sketches(rows), fence, prior_rows), "fences")
    inside = F.lit(True)
    for s, (_, two, _) in SIGNALS.items():
        inside = inside & (F.col(f"__s_{s}") <= F.col(f"hi_{s}"))
        if two:
            inside = inside & (F.col(f"__s_{s}") >= F.col(f"lo_{s}"))
    # limits is a written table, so Spark broadcasts it only if it is small enough
    judged = rows.join(limits, F.col("__lang").eqNullSafe(F.col("__l")) & F.col("__source").eqNullSafe(F.col("__s")), "left")
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))


def quality_rules(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    *,
    fence: float = 3.0,
    prior_rows: int = 100,
    carry: bool = True,
) -> DataFrame:
    """One output row per input row: the input columns (only ``id_col`` if not ``carry``), then
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    A row is kept if it passes the base rules and each of its signals lies inside its group's
    fences, ``fence`` times the quartile range beyond the quartiles, drawn to those of the language and of
    all rows by ``prior_rows``.
    Null text: no words, fails the base rules. Null language or source: a group of its own. Equal
    rows get equal verdicts. Empty table: no rows. Groups without a row that passes the base rules
    need no fences. A computed column replaces an input column of its name.
    """
    return unpack(_judged(df, id_col, text_col, lang_col, source_col, fence, prior_rows, carry), COMPUTED)


def drop_low_quality(
    df: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    *,
    fence: float = 3.0,
    prior_rows: int = 100,
    scratch: Scratch | None = None,
) -> DataFrame:
    """The rows that ``quality_rules`` keeps, with the input's own columns. Cases as there.
    scratch: where to write; the caller may drop it once the result is written."""
    return _judged(df, text_col, text_col, lang_col, source_col, fence, prior_rows, True, scratch).where("kept").select(f"{ROW}.*")

"""Secret scans over an incremental blob ledger.  DataFrame functions only.

Every version of every text is addressed by its content (SHA-256).  The ledger is a Parquet table with
one row per scanned blob and rule version, with the spans found.  A run scans only pairs of blob and
rule version that the ledger lacks, appends them, and joins the findings back to all rows (paths) that
hold the blob.  A blob that many rows share is scanned once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import RID, ROW, Scratch, name, pack, text_of, unpack

COMPUTED = ["blob_sha256", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]


@dataclass(frozen=True)
class Rule:
    """One kind of secret. ``group`` must have ``least`` characters, or the match is dropped. ``holds``: a
    string that each match of this pattern has; texts without it are passed over by a plain search."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1
    holds: str = ""

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The base kinds, in the order in which spans that start together are listed.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}", holds="AKIA"),  # runs are maximal, so the least length can stand in the pattern
    Rule("hex", r"[0-9a-f]{16,}"),
)
# Public formats of further secrets.
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", holds="gh"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", holds="xox"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", holds="AIza"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", holds="eyJ"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", holds="-----BEGIN "),
    Rule("url", r"[a-z][a-z0-9+.-]{1,20}://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/:@]+@", holds="://"),
)
RULES = BASE + ADDED

def _quoted(pattern: str) -> str:
    return "r'" + pattern + "'" if "'" not in pattern else 'r"' + pattern.replace('"', r"\x22") + '"'


def pieces(text: str, rule: Rule) -> Column:
    """array<struct<b, m, g>>, one for each leftmost match without overlap: code points between it and the
    one before, of the match, and of its group."""
    p = _quoted(rule.pattern)
    zipped = f"arrays_zip(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), regexp_extract_all({text}, {p}, {rule.group}))"
    lengths = f"transform({zipped}, x -> struct(length(x.`0`) AS b, length(x.`1`) AS m, length(x.`2`) AS g))"
    return F.expr(f"filter({lengths}, x -> x.m IS NOT NULL)")


def scan(blobs: DataFrame, rules: tuple[Rule, ...], scratch: Scratch) -> DataFrame:
    """blobs: __digest, __text, __seen (array of rule keys already scanned). One row per blob and rule
    version not yet scanned: (digest, rule, spans).

    Places are running sums over a blob's pieces, by a window: linear in the number of matches.
    """
    none = F.expr("CAST(array() AS ARRAY<STRUCT<b: INT, m: INT, g: INT>>)")
    out = []
    for r in rules:
        may = F.col("__text").contains(r.holds) if r.holds else F.col("__text").rlike(r.pattern)
        found = F.struct(F.lit(r.key).alias("rule"), F.lit(r.kind).alias("kind"), F.lit(max(r.least, 1)).alias("least"), F.when(may, pieces("__text", r)).otherwise(none).alias("x"))
        out.append(F.when(~F.array_contains("__seen", r.key), found))
    rows = scratch.write(blobs.select(F.col("__digest").alias("digest"), F.array_compact(F.array(*out)).alias("s")), "pieces")
    clean = rows.select("digest", F.explode(F.expr("filter(s, y -> size(y.x) = 0)")).alias("s"))
    clean = clean.select("digest", "s.rule", F.expr("CAST(array() AS ARRAY<STRUCT<start: INT, end: INT, kind: STRING>>)").alias("spans"))
    hits = rows.select("digest", F.explode(F.expr("filter(s, y -> size(y.x) > 0)")).alias("s"))
    hits = hits.select("digest", "s.rule", "s.kind", "s.least", F.posexplode("s.x").alias("at", "x"))
    ends = F.sum(F.expr("x.b + x.m")).over(Window.partitionBy("digest", "rule").orderBy("at")).cast("int")
    hits = hits.withColumn("end", ends).select("digest", "rule", F.when(F.expr("x.g >= least"), F.struct((F.col("end") - F.col("x.m")).alias("start"), "end", "kind")).alias("span"))
    return clean.union(hits.groupBy("digest", "rule").agg(F.sort_array(F.collect_list("span")).alias("spans")))


def scan_secrets(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    ledger: str | None = None,
    rules: tuple[Rule, ...] = RULES,
    carry: bool = True,
) -> DataFrame:
    """One output row per input row: the input columns (only ``id_col`` if not ``carry``), then
    blob_sha256, n_assign, n_access, n_hex, base_sha256 and spans (kind:start:end by start, then kind as
    listed, comma-joined).

    ledger: folder of the blob ledger (Parquet), read if it exists and appended to; None: an empty one
    for this run. Null text: empty. Null or repeated ids: every row gets its blob's findings. No
    findings: empty strings' digest and an empty string. Empty table: no rows. A computed column
    replaces an input column of its name.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    ledger = ledger or scratch.path("ledger")
    keys = [r.key for r in rules]
    rows = df.select(pack(df, None if carry else [id_col]), text_of(text_col).alias("__text"))
    rows = rows.withColumn("__digest", F.sha2("__text", 256))
    paths = scratch.write(rows.drop("__text"), "paths")
    texts = rows.select("__digest", "__text")

    known = _read_ledger(spark, ledger)
    if known is not None:
        seen = known.where(F.col("rule").isin(keys)).groupBy("digest").agg(F.collect_set("rule").alias("__seen"))
        done = seen.where(F.size("__seen") == len(keys)).select(F.col("digest").alias("__digest"))
        texts = texts.join(done, "__digest", "left_anti")
    # equal rows meet by digest; partial results keep one text of each per task before the shuffle
    blobs = texts.dropDuplicates(["__digest"])
    if known is not None:
        blobs = blobs.join(seen.withColumnRenamed("digest", "__digest"), "__digest", "left").withColumn("__seen", F.coalesce("__seen", F.expr("CAST(array() AS ARRAY<STRING>)")))
    else:
        blobs = blobs.withColumn("__seen", F.expr("CAST(array() AS ARRAY<STRING>)"))
    scan(blobs, rules, scratch).write.mode("append").option("compression", "zstd").parquet(ledger)

    known = _read_ledger(spark, ledger).where(F.col("rule").isin(keys) & (F.size("spans") > 0))
    ranks = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.kind, k)])
    by_blob = (
        known.dropDuplicates(["digest", "rule"])
        .select("digest", F.explode("spans").alias("s"))
        .groupBy("digest")
        .agg(F.sort_array(F.collect_list(F.struct("s.start", ranks[F.col("s.kind")].alias("rank"), "s.end", "s.kind"))).alias("__f"))
    )
    # a written table: small enough, it is broadcast; else paths of one blob can be split over tasks
    joined = paths.join(scratch.write(by_blob, "by_blob"), F.col("__digest") == F.col("digest"), "left")
    listed = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda *kinds: F.filter("__f", lambda s: s["kind"].isin(*kinds))
    count = lambda kind: F.coalesce(F.size(of(kind)), F.lit(0)).cast("long")
    return unpack(
        joined.withColumn("__f", F.coalesce("__f", F.expr("CAST(array() AS ARRAY<STRUCT<start: INT, rank: INT, end: INT, kind: STRING>>)"))).select(
            ROW,
            F.col("__digest").alias("blob_sha256"),
            count("assign").alias("n_assign"),
            count("access").alias("n_access"),
            count("hex").alias("n_hex"),
            F.sha2(listed(of(*[r.kind for r in BASE])), 256).alias("base_sha256"),
            listed(F.col("__f")).alias("spans"),
        ),
        COMPUTED,
    )


def _read_ledger(spark, path: str) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    schema = "digest STRING, rule STRING, spans ARRAY<STRUCT<start: INT, end: INT, kind: STRING>>"
    return spark.read.schema(schema).parquet(path)

"""Chat formatting by event-sourced reconstruction.  DataFrame functions only.

A log holds events of conversations.  Rows are partitioned by conversation once and sorted by message
and sequence; events fold into final messages, messages into one formatted string a conversation.

Events (column ``kind``):
  message     a message begins, with this text
  delta       text is appended to its message
  edit        the message's text is replaced
  regenerate  the message's text is replaced, and messages that began after it but before this event
              are discarded

Template: ``<|turn|>`` role ``<|text|>`` text ``<|end|>`` for each message. Inside roles and texts a
backslash is doubled and a control string gets a single backslash after its first character, so no
control string survives there and the escape can be undone: pairs of backslashes become one, single
ones go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import name, text_of

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of common chat templates. ``<|`` opens all of ours.
CONTROL = r"(<|\[)(\||/?s>|/?INST\]|<SYS>>|</SYS>>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\)?", "$1")


def messages(
    events: DataFrame, conv: str = "conv_id", message: str = "message_id", seq: str = "seq", kind: str = "kind",
    role: str = "role", text: str = "text", *, n_partitions: int | None = None,
) -> DataFrame:
    """Final messages: __conv, __first (sequence of the message's first event), __mid, __role, __text.

    The last message, edit or regenerate event of a message gives its text, later deltas follow in
    order of sequence. Events of one sequence are taken in order of kind, role and text. Null text or
    role: empty. Null conversation or message ids: an id of their own. Null sequence: first.
    Null or unknown kind: message.
    """
    log = events.select(
        F.col(name(conv)).alias("__conv"),
        F.col(name(message)).alias("__mid"),
        F.col(name(seq)).cast("long").alias("__seq"),
        F.when(F.col(name(kind)).isin("delta", "edit", "regenerate"), F.col(name(kind))).otherwise("message").alias("__kind"),
        text_of(role).alias("__role"),
        text_of(text).alias("__text"),
    )
    log = log.repartition("__conv") if n_partitions is None else log.repartition(n_partitions, "__conv")
    one = Window.partitionBy("__conv", "__mid").orderBy(
        F.col("__seq").asc_nulls_first(), F.col("__kind").desc(), "__role", "__text"
    )  # kinds sort regenerate, message, edit, delta: deltas of a sequence follow what they extend
    so_far = one.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    log = log.withColumn("__part", F.sum((F.col("__kind") != "delta").cast("int")).over(so_far)).withColumn(
        "__i", F.row_number().over(one)
    )
    part = F.struct("__part", "__i", "__text", "__role", "__kind", "__seq")
    folded = log.groupBy("__conv", "__mid").agg(
        F.min("__seq").alias("__first"),
        F.max(F.when(F.col("__kind") == "regenerate", F.col("__seq"))).alias("__again"),
        F.sort_array(F.collect_list(part)).alias("__e"),
    )
    last = F.element_at("__e", -1)["__part"]
    final = folded.select(
        "__conv",
        "__mid",
        "__first",
        "__again",
        F.element_at("__e", 1)["__role"].alias("__role"),
        F.array_join(F.transform(F.filter("__e", lambda x: x["__part"] == last), lambda x: x["__text"]), "").alias("__text"),
    )
    earlier = Window.partitionBy("__conv").orderBy(F.col("__first").asc_nulls_first()).rangeBetween(Window.unboundedPreceding, -1)
    discarded = F.coalesce(F.max("__again").over(earlier) > F.col("__first"), F.lit(False))
    return final.withColumn("__gone", discarded).where("NOT __gone").drop("__gone", "__again")


def format_chats(final: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """final: result of ``messages``. One row a conversation: conv_id, formatted, loss_spans (array of
    start and length in code points, the texts of ``loss_role``).

    Messages stand in order of their first sequence, then of their ids.
    """
    order = [F.col("__first").asc_nulls_first(), F.col("__mid").asc_nulls_first()]
    before = Window.partitionBy("__conv").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = final.select(
        "__conv", "__first", "__mid",
        F.concat(F.lit(TURN), escape(F.col("__role")), F.lit(TEXT)).alias("head"),
        escape(F.col("__text")).alias("body"),
        (F.col("__role") == loss_role).alias("loss"),
    )
    length = F.length("head") + F.length("body") + len(END)
    parts = parts.withColumn("start", F.coalesce(F.sum(length).over(before), F.lit(0)) + F.length("head"))
    m = F.struct("__first", "__mid", "head", "body", "loss", F.col("start").cast("int").alias("start"))
    chats = parts.groupBy("__conv").agg(F.sort_array(F.collect_list(m)).alias("__m"))
    formatted = F.array_join(F.transform("__m", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "")
    spans = F.transform(
        F.filter("__m", lambda x: x["loss"]),
        lambda x: F.struct(x["start"].alias("start"), F.length(x["body"]).alias("length")),
    )
    return chats.select(F.col("__conv").alias("conv_id"), formatted.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: str = "formatted") -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    turns = F.filter(F.split(F.col(formatted), r"\Q" + END + r"\E", -1), lambda x: x.startswith(TURN))
    return F.transform(
        turns,
        lambda x: F.struct(
            unescape(F.substring(F.substring_index(x, TEXT, 1), len(TURN) + 1, 1 << 30)).alias("role"),
            unescape(F.substring_index(x, TEXT, -1)).alias("text"),
        ),
    )


def read_loss(formatted: str = "formatted", spans: str = "loss_spans") -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    text = F.col(formatted)
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(text, s["start"] + 1, s["length"]))), "")

"""Chat formatting in budgeted windows.

Prefix sums of the turns' token counts (white-space words, at least 1) cut a conversation into
turn-aligned spans of about ``budget`` tokens; a span is chosen by the tokens before a turn, so a
turn is never split. Each window after the first repeats the opening system turn and, as limited
history, those turns of the span before it that lie within ``history`` tokens. Repeated turns are
marked as context and never trained on; every assistant turn is a target in exactly one window.

Template: a turn is ``<|turn|>`` or ``<|context|>``, role, ``<|text|>``, text, ``<|end|>``. In roles
and texts a backslash is doubled and ``<|`` becomes ``<\\|``, so no text can imitate a mark and
the output is read back exactly.

Only DataFrame functions: one shuffle by conversation, in which a running sum and the grouping
into windows share the partitioning; a row of the output never holds more than a window. The running sum orders a
conversation's turns in one task, which spills; ``digest`` also holds a conversation's windows in one row, as a SHA-256
over all its turns can't be put together from parts.

Defined results: null text or role counts as empty, null turns come first, turns of equal number
are ordered by role and text, repeated rows are turns of their own, null conv_id is one
conversation, an empty table gives an empty table, other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gneiss.llm.common import words_of

TURN, CONTEXT, TEXT, END = "<|turn|>", "<|context|>", "<|text|>", "<|end|>"


def escape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"\\([\\|])", "$1")


def format_windows(turns: DataFrame, budget: int = 1024, history: int = 128) -> DataFrame:
    """One row a window: conv_id, window, n_new, n_context, formatted, loss.

    ``loss`` is an array of (start, length): code points of ``formatted``, from 0, that are trained on.
    """
    row = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    row = row.withColumn("tokens", F.greatest(F.size(words_of(F.col("text"))), F.lit(1)).cast("bigint"))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    row = row.withColumns({"place": F.row_number().over(order), "before": F.sum("tokens").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("tokens")})
    row = row.withColumn("window", F.floor(F.col("before") / budget).cast("bigint"))
    # the window after this turn's own, and the tokens before its first turn: those of the next turn in another window
    span = W.partitionBy("conv_id", "window")
    row = row.withColumn("end", F.max(F.col("before") + F.col("tokens")).over(span))
    all_turns = W.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    row = row.withColumns({"opening": F.first(F.when((F.col("place") == 1) & (F.col("role") == "system"), F.col("text"))).over(all_turns), "last": F.max("window").over(W.partitionBy("conv_id"))})
    following = F.floor(F.col("end") / budget).cast("bigint")
    again = (F.col("window") < F.col("last")) & (F.col("end") - F.col("before") <= history) & ~((F.col("place") == 1) & (F.col("role") == "system"))
    row = row.withColumn("seat", F.explode(F.when(again, F.array(F.struct(F.col("window").alias("window"), F.lit(False).alias("context")), F.struct(following.alias("window"), F.lit(True).alias("context")))).otherwise(F.array(F.struct(F.col("window").alias("window"), F.lit(False).alias("context"))))))
    row = row.select("conv_id", F.col("seat.window").alias("window"), F.struct("place", "role", "text", F.col("seat.context").alias("context")).alias("t"), "opening")
    windows = row.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list("t")).alias("ts"), F.first("opening").alias("opening"))

    def piece(mark: Column, role: Column, text: Column) -> Column:
        return F.concat(mark, escape(role), F.lit(TEXT), escape(text), F.lit(END))

    head = F.when((F.col("window") > 0) & F.col("opening").isNotNull(), piece(F.lit(CONTEXT), F.lit("system"), F.col("opening"))).otherwise(F.lit(""))
    parts = F.transform(
        "ts",
        lambda t: F.struct(
            piece(F.when(t["context"], F.lit(CONTEXT)).otherwise(F.lit(TURN)), t["role"], t["text"]).alias("s"),
            ((t["role"] == "assistant") & ~t["context"]).alias("target"),
            F.length(escape(t["text"])).alias("n"),
        ),
    )
    windows = windows.withColumns({"head": head, "parts": parts})
    start = F.struct(F.length("head").cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    # a fold over the turns of one window, which the budget bounds
    loss = F.aggregate(
        "parts",
        start,
        lambda a, p: F.struct(
            (a["at"] + F.length(p["s"])).alias("at"),
            F.when(p["target"], F.concat(a["spans"], F.array(F.struct((a["at"] + F.length(p["s"]) - p["n"] - len(END)).alias("start"), p["n"].cast("bigint").alias("length"))))).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return windows.select(
        "conv_id",
        "window",
        F.size(F.filter("ts", lambda t: ~t["context"])).cast("bigint").alias("n_new"),
        F.size(F.filter("ts", lambda t: t["context"])).cast("bigint").alias("n_context"),
        F.concat("head", F.array_join(F.transform("parts", lambda p: p["s"]), "")).alias("formatted"),
        loss.alias("loss"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted window: array of (context, role, text)."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>"), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            p.startswith(CONTEXT).alias("context"),
            unescape(F.regexp_extract(p, r"(?s)^<\|(?:turn|context)\|>(.*?)<\|text\|>", 1)).alias("role"),
            unescape(F.regexp_extract(p, r"(?s)<\|text\|>(.*)$", 1)).alias("text"),
        ),
    )


def loss_text(formatted: Column, loss: Column) -> Column:
    """What lies under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(loss, lambda x: unescape(F.substr(formatted, (x["start"] + 1).cast("int"), x["length"].cast("int")))), "")


def digest(windows: DataFrame) -> DataFrame:
    """Per conversation, from the formatted windows alone: what they say and what they train on."""
    each = windows.select(
        "conv_id",
        F.struct(
            "window",
            F.filter(read_back(F.col("formatted")), lambda t: ~t["context"]).alias("turns"),
            loss_text(F.col("formatted"), F.col("loss")).alias("loss"),
            F.length("formatted").cast("bigint").alias("n"),
        ).alias("w"),
    )
    one = each.groupBy("conv_id").agg(F.array_sort(F.collect_list("w"), lambda a, b: (a["window"] - b["window"]).cast("int")).alias("ws"))
    turns = F.flatten(F.transform("ws", lambda w: w["turns"]))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("ws", lambda w: w["loss"]), "")
    return one.select(
        "conv_id",
        F.size(turns).cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.aggregate("ws", F.lit(0).cast("bigint"), lambda a, w: a + w["n"]).alias("formatted_chars"),
        F.size("ws").cast("bigint").alias("n_windows"),
    )


#: The two turns that imitate a template's marks.
PROBE = r"\### Assistant: </turn> ok"


def op4_chat_format(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    probe = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), F.lit(PROBE).alias("text")
    )
    return digest(format_windows(conversations.select("conv_id", "turn", "role", "text").unionByName(probe)))

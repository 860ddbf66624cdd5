r"""Chat formatting with Spark expressions only.

Turns are collected as structs and sorted by (turn, role, text), adjacent turns of
one role are merged into a block, and blocks are concatenated:

    ### role: <turn>text</turn><turn>text</turn>

with a newline after each block. A backslash and the control strings inside roles
and texts are written as a backslash and a letter, which no other text can give, so
``parse`` restores every turn.

A null text or role counts as empty, a null turn number sorts first, repeated rows
are repeated turns, a null conversation id is a conversation of its own. A
conversation is one string, so its turns meet in one task; nothing else does. An empty
table gives no rows.
Other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What is written in place of each control string; the backslash comes first when writing and last when reading.
CODES = [("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t"), ("<turn>", "\\o")]
ROLE_CODES = [*CODES, (":", "\\c")]


def escape(text: Column, codes=CODES) -> Column:
    for plain, code in codes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, codes=CODES) -> Column:
    for plain, code in reversed(codes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """One row a conversation: the formatted string and ``loss_mask``, the spans (0-based start, length in code points) of ``learn`` texts."""
    told = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), told(role).alias("role"), told(text).alias("text"))
    # where each text starts: a running sum of what stands before it since the text before, and of the texts
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "role", "text")
    before = F.lag("role").over(order)
    head = lambda r: F.concat(F.lit("### "), escape(r, ROLE_CODES), F.lit(": "))
    opening = F.length(head(F.col("role"))) + 6 + F.when(before.isNull(), 0).otherwise(8)
    rows = rows.withColumn("lead", F.when(before.isNull() | (before != F.col("role")), opening).otherwise(13)).withColumn("n", F.length(escape(F.col("text"))))
    rows = rows.withColumn("start", F.sum(F.col("lead") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    chats = rows.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "start", "n"))).alias("turns"))
    turns_ = F.col("turns")
    starts = F.filter(F.sequence(F.lit(1), F.size(turns_)), lambda i: (i == 1) | (F.element_at(turns_, i)["role"] != F.element_at(turns_, F.greatest(i - 1, F.lit(1)))["role"]))
    chats = chats.withColumn("starts", starts)
    ends = F.concat(F.slice(F.col("starts"), F.lit(2), F.size("starts")), F.array(F.size("turns") + 1))
    blocks = F.zip_with(
        F.col("starts"),
        ends,
        lambda s, e: F.struct(F.element_at(turns_, s)["role"].alias("role"), F.transform(F.slice(turns_, s, e - s), lambda t: escape(t["text"])).alias("texts")),
    )
    body = lambda b: F.concat(F.lit("<turn>"), F.array_join(b["texts"], "</turn><turn>"), F.lit("</turn>\n"))
    formatted = F.array_join(F.transform(blocks, lambda b: F.concat(head(b["role"]), body(b))), "")
    mask = F.transform(F.filter(turns_, lambda t: t["role"] == learn), lambda t: F.struct(t["start"].cast("int").alias("start"), t["n"].alias("length")))
    return chats.select(F.col("conv").alias(conv), formatted.alias("formatted"), mask.alias("loss_mask"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted string: array of (role, text)."""
    blocks = F.slice(F.split(formatted, "### ", -1), F.lit(2), F.size(F.split(formatted, "### ", -1)))

    def of_block(b):
        role = F.substring_index(b, ":", 1)
        texts = F.substring(b, F.length(role) + 9, F.length(b) - F.length(role) - 16)
        return F.transform(F.split(texts, "</turn><turn>", -1), lambda t: F.struct(unescape(role, ROLE_CODES).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, of_block))


def learned(formatted: Column, mask: Column) -> Column:
    """The unescaped texts under the loss mask."""
    return F.transform(mask, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"])))


def digest(chats: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Counts and hashes of what is read back from the formatted strings."""
    read = chats.select(conv, "formatted", parse(F.col("formatted")).alias("turns"), F.array_join(learned(F.col("formatted"), F.col("loss_mask")), "").alias("loss"))
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return read.select(
        conv,
        F.size("turns").cast("long").alias("n_turns"),
        sha(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        sha(F.col("loss")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )

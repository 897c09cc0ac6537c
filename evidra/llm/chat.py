"""Chat formatting with Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import sha256

# Template: <turn ROLE>, the texts of adjacent turns of that role with <next> between, </turn>, new line.
OPEN, CLOSE, NEXT = "<turn ", "</turn>\n", "<next>"


def escape(text: Column) -> Column:
    """No ``<`` or ``>`` is left in the text, and every backslash starts one of three pairs."""
    for plain, pair in (("\\", "\\b"), ("<", "\\l"), (">", "\\g")):
        text = F.replace(text, F.lit(plain), F.lit(pair))
    return text


def unescape(text: Column) -> Column:
    """The inverse of ``escape``: as every backslash starts a pair, no pair is met across two others; ``\\b`` comes last."""
    for plain, pair in (("<", "\\l"), (">", "\\g"), ("\\", "\\b")):
        text = F.replace(text, F.lit(pair), F.lit(plain))
    return text


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 learn: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted`` and ``loss_spans`` (start from 0 and length, in code points).

    Turns are collected as structs and sorted by turn number (null first; equal numbers by role, then text). Adjacent turns of
    one role merge into one block in which ``<next>`` marks the joints, so that the turns can be read back. The loss spans
    cover the escaped text of every ``learn`` turn and no marks. A null text or role is empty; a null conversation is a
    conversation of its own; repeated rows are turns of their own; other columns are ignored. No rows: no rows. A conversation
    is one value of the result, so its turns meet in one row.
    """
    rows = turns.select(F.col(conv).alias("conv_id"), F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def piece(t: Column, i: Column) -> Column:
        start = F.concat(F.lit(OPEN), escape(t["role"]), F.lit(">"))
        before = F.get(F.col("turns"), i - 1)["role"]
        mark = F.when(i == 0, start).when(t["role"] == before, F.lit(NEXT)).otherwise(F.concat(F.lit(CLOSE), start))
        return F.struct(mark.alias("mark"), escape(t["text"]).alias("body"), (t["role"] == learn).alias("learn"))

    chats = chats.select("conv_id", F.transform("turns", piece).alias("pieces"))
    spans = F.expr("""aggregate(pieces, struct(0L AS at, CAST(array() AS array<struct<start: bigint, length: bigint>>) AS spans),
        (acc, p) -> struct(acc.at + char_length(p.mark) + char_length(p.body) AS at,
            IF(p.learn, concat(acc.spans, array(struct(acc.at + char_length(p.mark) AS start,
                                                       CAST(char_length(p.body) AS bigint) AS length))), acc.spans) AS spans),
        acc -> acc.spans)""")
    joined = F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["mark"], p["body"])), ""), F.lit(CLOSE))
    return chats.select("conv_id", joined.alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, as structs (role, text)."""
    blocks = F.filter(F.split(formatted, CLOSE, -1), lambda b: b != "")

    def turns_of(block: Column) -> Column:
        head = F.substring_index(block, ">", 1)
        role = unescape(F.substr(head, F.lit(len(OPEN) + 1)))
        body = F.substr(block, F.char_length(head) + 2)
        return F.transform(F.split(body, NEXT, -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns_of))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return unescape(F.array_join(F.transform(spans, lambda s: F.substr(
        formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))), ""))


def chat_digests(chats: DataFrame) -> DataFrame:
    """What ``format_chats`` wrote, read back from its output."""
    rows = chats.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"),
                        read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select("conv_id", F.size("turns").cast("long").alias("n_turns"), sha256(told).alias("turns_sha256"),
                       F.char_length("loss").cast("long").alias("loss_chars"), sha256(F.col("loss")).alias("loss_sha256"),
                       F.char_length("formatted").cast("long").alias("formatted_chars"))

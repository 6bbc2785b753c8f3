"""Conversations as training text, by Spark expressions only.

Template: each run of turns of one role is one block, `<|turn|>role<|text|>first<|and|>second<|end|>`, one
conversation is the blocks one after another. Control strings inside roles and texts get a backslash after their first
character, backslashes are doubled, so the template's own marks are never in doubt and all texts can be read back.

Edge cases: a null role or text is empty; turns go by turn (null first), then role, then text, so ties and repeated
rows have one order and all of them stay; a conversation with null id is one of its own; no rows give no rows; other
columns are ignored. A conversation is one value, hence one task's row, as its digest asks for.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, AND, END = "<|turn|>", "<|text|>", "<|and|>", "<|end|>"
#: Strings that steer a model or mark this or other usual templates; inside texts they are escaped.
CONTROL = (TURN, TEXT, AND, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escaped(text: Column, control: tuple[str, ...] = CONTROL) -> Column:
    tails = "|".join(re.escape(c) for c in control)
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), rf"(?=(?:{tails}))(.)", "$1\\\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(conversations: DataFrame, control: tuple[str, ...] = CONTROL) -> DataFrame:
    """conv_id, parts (text, role, loss: in order, with the template's marks as parts of their own), formatted.

    `formatted` is the parts' texts joined; loss is true for exactly the assistant's texts."""
    turns = (
        conversations.select(
            F.col("conv_id"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
        )
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    )
    # A role's neighbours decide where blocks begin and end: the list beside itself, moved by one either way.
    none = F.array(F.lit(None).cast("string"))
    roles = F.col("turns.role")
    near = F.arrays_zip(
        F.col("turns"),
        F.concat(none, F.slice(roles, 1, F.size("turns") - 1)).alias("before"),
        F.concat(F.slice(roles, 2, F.size("turns")), none).alias("after"),
    )

    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def rendered(x: Column) -> Column:
        role = x["turns"]["role"]
        opens = F.when(x["before"].eqNullSafe(role), F.lit(AND)).otherwise(F.concat(F.lit(TURN), escaped(role, control), F.lit(TEXT)))
        closes = F.when(x["after"].eqNullSafe(role), F.lit("")).otherwise(F.lit(END))
        return F.array(
            piece(opens, F.lit(False)), piece(escaped(x["turns"]["text"], control), role == "assistant"), piece(closes, F.lit(False))
        )

    return turns.select("conv_id", F.flatten(F.transform(near, rendered)).alias("parts")).select(
        "conv_id", "parts", F.array_join("parts.text", "").alias("formatted")
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, block by block, merged turns apart again."""

    def block(x: Column) -> Column:
        role = unescaped(F.substring_index(x, TEXT, 1))
        texts = F.split(F.substring_index(x, TEXT, -1), re.escape(AND), -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    blocks = F.filter(F.split(F.replace(formatted, F.lit(END), F.lit("")), re.escape(TURN), -1), lambda _, i: i > 0)
    return F.flatten(F.transform(blocks, block))


def chat_digest(formatted: DataFrame) -> DataFrame:
    """What the output says when it is read back: turns, and the text that counts for the loss."""
    back = formatted.select(
        "conv_id",
        F.explode(F.array(F.struct(read_turns(F.col("formatted")).alias("turns"), F.filter("parts", lambda p: p["loss"]).alias("loss")))).alias("m"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    told = F.array_join(F.transform("m.turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("m.loss", lambda p: unescaped(p["text"])), "")
    return back.select(
        "conv_id",
        F.size("m.turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )

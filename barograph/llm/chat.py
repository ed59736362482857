"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are its context, and its
reply alone is trainable. A turn is written as START role SEP text END; wherever a control string
stands inside a role or text, a backslash is put after its first character, and backslashes are
doubled, so that the marks are unmistakable and the texts can be read back.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that a text must not be able to forge; the template's own come first.
CONTROL = (START, SEP, END, "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "<unk>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escape(text: Column, control=CONTROL) -> Column:
    anywhere = "|".join(re.escape(c) for c in control)
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, rf"(?s)(?={anywhere})(.)", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def examples(conversations: DataFrame, control=CONTROL, trained: str = "assistant") -> DataFrame:
    """conv_id, example (from 0), text, loss_start, loss_end (code points of text; the reply is between).

    Turns are ordered by turn, then role, then text; null turns come first, null texts and roles
    count as empty, a null conv_id is a conversation of its own, and repeated rows are turns of
    their own. Turns after the last reply end up in one more example, with no loss (loss_start and
    loss_end null), so that nothing is lost. Other columns are ignored; an empty table gives no rows.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.select("conv_id", F.struct(F.col("turn"), role.alias("role"), text.alias("text")).alias("t"))
    talks = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    body = lambda t: F.concat(F.lit(START), escape(t["role"], control), F.lit(SEP), escape(t["text"], control), F.lit(END))
    talks = talks.select(
        "conv_id",
        F.transform("ts", body).alias("parts"),
        F.transform("ts", lambda t: t["role"] == trained).alias("own"),
    )
    last = F.size("parts")
    at = F.filter(F.sequence(F.lit(1), last), lambda k: F.element_at("own", k) | (k == last))
    rows = talks.select("conv_id", "parts", "own", F.posexplode(at).alias("example", "k"))
    shown = F.array_join(F.slice("parts", F.lit(1), F.col("k")), "")
    opening = len(START) + F.length(escape(F.lit(trained), control)) + len(SEP)
    own = F.element_at("own", F.col("k"))
    rows = rows.select("conv_id", "example", shown.alias("text"), F.element_at("parts", F.col("k")).alias("final"), own.alias("own"))
    size = F.length("text")
    return rows.select(
        "conv_id", "example", "text",
        F.when(F.col("own"), size - F.length("final") + opening).cast("long").alias("loss_start"),
        F.when(F.col("own"), size - len(END)).cast("long").alias("loss_end"),
    )


def read_turns(text: Column) -> Column:
    """The turns of an example's text as an array of (role, text)."""
    parts = F.split(text, re.escape(END))
    body = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.substring(p, F.lit(len(START) + 1), F.length(p)))
    role = lambda p: F.substring_index(p, SEP, 1)
    return F.transform(body, lambda p: F.struct(unescape(role(p)).alias("role"), unescape(F.substring(p, F.length(role(p)) + len(SEP) + 1, F.length(p))).alias("text")))


def read_loss(text: Column, start: Column, end: Column) -> Column:
    """What is under an example's loss mask, unescaped; empty if nothing is."""
    return F.when(start.isNull(), F.lit("")).otherwise(unescape(F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))))


def digest(made: DataFrame) -> DataFrame:
    """Reads examples back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars
    (all examples of the conversation), n_examples."""
    loss = F.struct("example", read_loss(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("loss"))
    talks = made.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("whole"),
        F.array_sort(F.collect_list(loss)).alias("losses"),
        F.sum(F.length("text")).alias("formatted_chars"),
        F.count("*").alias("n_examples"),
    )
    talks = talks.select("*", read_turns(F.col("whole")).alias("turns"), F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return talks.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars", "n_examples",
    )


def format_and_read(conversations: DataFrame) -> DataFrame:
    """Formats, stores and reads back all conversations; see `examples` and `digest`."""
    return digest(materialize(examples(conversations), "examples"))

"""Chat formatting by relational expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role
become one block by array expressions, and the blocks are concatenated.  Layout::

    <|begin|><|role|>user<|text|>first<|next|>second<|role|>assistant<|text|>answer<|end|>

Turns of one block are parted by ``<|next|>``, so the original turns can be read back.  Control
strings in a role or text lose their meaning: ``<|`` is written ``<||``, and no control
string has ``|`` after its ``<|``, so reading back takes one ``|`` away after each ``<|``.

Everything is linear in the length of a conversation: a turn is rendered from itself and
its two neighbours, and the pieces are joined once.  A conversation is one value of the output, so its turns
meet in one task; what a task holds is bounded by its longest conversation, not by the number of rows.

Defined results: null texts and roles count as empty; turns sort by ``turn`` (null first), ties by role,
then text; repeated rows are turns of their own; rows with a null ``conv_id`` form one conversation; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, ROLE, TEXT, NEXT, END = (f"<|{x}|>" for x in ("begin", "role", "text", "next", "end"))


def escape(x: Column) -> Column:
    return F.replace(x, F.lit("<|"), F.lit("<||"))


def unescape(x: Column) -> Column:
    return F.replace(x, F.lit("<||"), F.lit("<|"))


def format_chats(turns: DataFrame) -> DataFrame:
    """``conv_id, formatted`` from rows ``conv_id, turn, role, text``."""
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # element_at(…, 0) would fail, so the neighbour before the first turn is not looked up
    before = "if(i = 0, null, element_at(turns, i).role)"
    piece = f"transform(turns, (t, i) -> concat(if(i > 0 and {before} = t.role, '{NEXT}', concat('{ROLE}', replace(t.role, '<|', '<||'), '{TEXT}')), replace(t.text, '<|', '<||')))"
    return sorted_turns.select("conv_id", F.concat(F.lit(BEGIN), F.array_join(F.expr(piece), ""), F.lit(END)).alias("formatted"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """Read the layout back: ``conv_id, turns array<struct<role, text>>, loss`` (texts under the loss mask)."""
    head = len(BEGIN) + len(ROLE)
    inner = F.expr(f"substring(formatted, {head + 1}, char_length(formatted) - {head + len(END)})")
    blocks = F.split(inner, r"<\|role\|>")
    cells = F.transform(blocks, lambda b: F.split(b, r"<\|text\|>"))
    turns = F.flatten(F.transform(cells, lambda c: F.transform(F.split(c[1], r"<\|next\|>"), lambda x: F.struct(unescape(c[0]).alias("role"), unescape(x).alias("text")))))
    read = formatted.select("conv_id", "formatted", turns.alias("turns"))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    return read.select("conv_id", "formatted", "turns", loss.alias("loss"))


def chat_digests(turns: DataFrame) -> DataFrame:
    """What the registered query returns, all of it read back from the formatted output."""
    read = read_chats(format_chats(turns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )

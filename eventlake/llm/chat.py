"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are the
context, and only its reply is trainable. The text of an example is not
stored again in its successors: a row of `expand` holds what follows the reply before (`added`,
then `target`), the place of both in the conversation and how long the whole
context is; `with_context` writes examples out in full, and what is read back is
read from those.

Template: a turn is ``<s>role\\ntext</s>``. Control strings within a role or text
get a backslash behind their first character, ones that have some there already
one more, so no text can pass for markup and every text can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import need_columns

#: What texts must not pass for: the template's marks and those of a common instruction format.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
_REST = r"(/?s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _REST, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _REST, r"$1$2$3")


def _role(role: Column) -> Column:
    """A role in one line: backslashes and line feeds are escaped as well."""
    return escape(F.regexp_replace(F.regexp_replace(role, r"\\", r"\\\\"), "\n", r"\\n"))


def _role_back(role: Column) -> Column:
    parts = F.split(unescape(role), r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.regexp_replace(p, r"\\n", "\n")), "\\")


def expand(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trainable: str = "assistant") -> DataFrame:
    """One row for each trainable turn of each conversation, and one for turns after the last.

    Columns: conv_col, example (0, 1, ... in order), trainable (false for the
    turns after the last reply, which belong to no example), n_turns (turns of
    this row), added (formatted turns since the reply before), opening (the
    reply's mark, context too), target (the escaped reply: the only trainable
    text), closing (the mark behind it), context_chars (code points of all
    context, opening included), loss_start and loss_end (the target's place in
    the formatted conversation, in code points).

    Turns are ordered by turn; ties by role and text, so repeated rows stay
    side by side. A null turn comes first. A null role or text is empty. Turns
    with a null conversation id make one conversation. A conversation without
    replies gives its one untrainable row; an empty table gives none. Other
    columns are ignored. The rows of a conversation flow through one sorted
    window and are never gathered: only turns between two replies are.
    """
    need_columns(turns, conv_col, turn_col, role_col, text_col)
    t = turns.select(
        F.col(conv_col).alias("_conv"), F.col(turn_col).alias("_turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("_role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"),
    )
    order = Window.partitionBy("_conv").orderBy("_turn", "_role", "_text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumns({"_loss": F.col("_role") == trainable, "_open": F.concat(F.lit("<s>"), _role(F.col("_role")), F.lit("\n")), "_body": escape(F.col("_text"))})
    t = t.withColumn("_size", (F.length("_open") + F.length("_body") + 4).cast("long"))
    t = t.withColumns({"_pos": F.row_number().over(order), "_end": F.sum("_size").over(so_far), "example": (F.sum(F.col("_loss").cast("long")).over(so_far) - F.col("_loss").cast("long"))})
    whole = F.concat("_open", "_body", F.lit("</s>"))
    grouped = t.groupBy("_conv", "example").agg(
        F.count("*").alias("n_turns"),
        F.array_sort(F.collect_list(F.when(~F.col("_loss"), F.struct("_pos", whole.alias("t"))))).alias("_added"),
        F.max(F.when(F.col("_loss"), F.col("_open"))).alias("opening"), F.max(F.when(F.col("_loss"), F.col("_body"))).alias("target"), F.max("_end").alias("_end"),
    )
    end, own = F.col("_end") - 4, F.coalesce(F.length("target"), F.lit(0))
    found = F.col("target").isNotNull()
    return grouped.select(
        F.col("_conv").alias(conv_col), "example", found.alias("trainable"), "n_turns", F.array_join(F.transform("_added", lambda a: a["t"]), "").alias("added"),
        F.coalesce("opening", F.lit("")).alias("opening"), F.coalesce("target", F.lit("")).alias("target"), F.when(found, "</s>").otherwise("").alias("closing"),
        F.when(found, end - own).otherwise(F.col("_end")).alias("context_chars"), F.when(found, end - own).alias("loss_start"), F.when(found, end).alias("loss_end"),
    )


def with_context(examples: DataFrame, conv_col: str = "conv_id", tails: bool = False) -> DataFrame:
    """Trainable examples in full: context (every turn before and the reply's mark) and target.

    Contexts repeat earlier turns, so this grows with the square of a
    conversation's length; rows flow through one sorted window, and only one
    example's text is made at a time. With tails, the rows of turns after the
    last reply stay as well: the whole conversation is their context, trainable
    is false, the target empty and its place null.
    """
    before = Window.partitionBy(conv_col).orderBy("example").rowsBetween(Window.unboundedPreceding, -1)
    past = F.array_join(F.collect_list(F.concat("added", "opening", "target", "closing")).over(before), "")
    full = examples.withColumn("context", F.concat(past, F.col("added"), F.col("opening")))
    kept = [conv_col, "example", "context", "target", "closing", "loss_start", "loss_end"]
    return full.select(*kept, "trainable") if tails else full.where("trainable").select(*kept)


def read_full(full: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Each conversation as its full examples (with tails) tell it: turns (role, text), losses (unescaped replies) and the formatted text.

    A loss is what an example's own text has under its mask; the turns are those
    of the longest example, as every other is a part of it. No more than one
    example of a conversation is held in full.
    """
    text = F.concat("context", "target", "closing")
    loss = unescape(F.substring(text, (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int")))
    told = full.select(conv_col, "example", text.alias("_text"), F.when(F.col("trainable"), F.struct("example", loss.alias("loss"))).alias("_loss"))
    whole = told.groupBy(conv_col).agg(F.max_by("_text", "example").alias("formatted"), F.array_sort(F.collect_list("_loss")).alias("_losses"))
    marked = F.filter(F.split(F.col("formatted"), "</s>", -1), lambda p: p != "")
    turn = lambda p: F.struct(_role_back(F.substring_index(p.substr(F.lit(4), F.length(p)), "\n", 1)).alias("role"), unescape(p.substr(F.locate("\n", p) + 1, F.length(p))).alias("text"))
    return whole.select(conv_col, "formatted", F.transform(marked, turn).alias("turns"), F.transform("_losses", lambda r: r["loss"]).alias("losses"))


def read_back(examples: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Each conversation as its examples, expanded to all turns before each reply, tell it (see read_full)."""
    return read_full(with_context(examples, conv_col, tails=True), conv_col)


def digests(examples: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Per conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the examples."""
    back = read_back(examples, conv_col)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("losses", "")
    return back.select(
        conv_col, F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )

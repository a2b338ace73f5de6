"""Chat formatting by prefix-target expansion (native).

A turn becomes ``<|turn|>ROLE<|body|>TEXT<|end|>``.  Control strings inside roles and texts get a backslash after their
first character and backslashes are doubled, which ``unescape`` reverses, so no text can forge a mark.  Each assistant
turn is expanded to an example of its own, a prefix and a target: the prefix is everything formatted before its text, the
target its text and end mark, and only the text is trainable.  Losses are read back from the expanded examples, prefixes
included.  A conversation is one row, so its turns meet in one task; its text, held once, is the limit.  Its examples are rows
written one after another, whose text altogether grows with the square of a conversation's turns, as the method has it.

Defined cases: null role or text counts as empty; rows of one conversation are ordered by turn, role, text (null turns
first), so repeated rows stay and ties are stable; null conv_id is one conversation; columns other than the four are
ignored; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
#: Strings that chat templates give meaning to (fixed values).
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TRAINED_ROLE = "assistant"


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for s in CONTROL:
        c = F.replace(c, F.lit(s), F.lit(s[0] + "\\" + s[1:]))
    return c


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def format_conversations(turns: DataFrame, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """conv_id, formatted, examples: array of (prefix_chars, target_chars, loss_chars).

    These are an example's spans of ``formatted``, in code points: its prefix is the first ``prefix_chars``, its target the
    ``target_chars`` after them, and the loss covers the first ``loss_chars`` of the target.  ``explode_examples`` makes the
    prefixes and targets; in one row they would be as large as the square of the conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text")).withColumns({
        "head": F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY)),
        "body": escape(F.col("text")),
    })
    rows = rows.withColumn("segment", F.concat("head", "body", F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumns({
        "pos": F.row_number().over(order),
        "before": F.coalesce(F.sum(F.length("segment").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    })
    spans = ((F.col("before") + F.length("head")).alias("prefix_chars"), (F.length("body") + len(END)).alias("target_chars"), F.length("body").alias("loss_chars"))
    example = F.struct("pos", *spans)
    grouped = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "segment"))).alias("segments"),
        F.array_sort(F.collect_list(F.when(F.col("role") == trained_role, example))).alias("examples"),
    )
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("segments", lambda s: s["segment"]), "").alias("formatted"),
        F.transform("examples", lambda e: e.dropFields("pos")).alias("examples"),
    )


def explode_examples(conversations: DataFrame, *carried: str, silent: bool = False) -> DataFrame:
    """A row for each assistant turn: conv_id, the ``carried`` columns, example (from 0), prefix, target, prefix_chars, loss_chars
    (the first code points of the target).  A conversation without assistant turns has no row, or one of nulls if ``silent``."""
    each = F.posexplode_outer("examples") if silent else F.posexplode("examples")
    rows = conversations.select("conv_id", *dict.fromkeys((*carried, "formatted")), each.alias("example", "e"))
    span = lambda start, size: F.substring("formatted", start.cast("int"), size.cast("int"))
    prefix, target = span(F.lit(1), F.col("e.prefix_chars")), span(F.col("e.prefix_chars") + 1, F.col("e.target_chars"))
    return rows.select("conv_id", *carried, "example", prefix.alias("prefix"), target.alias("target"), "e.prefix_chars", "e.loss_chars")


def written_out(examples: DataFrame, *carried: str) -> DataFrame:
    """conv_id, the ``carried`` columns, example, text, loss_start, loss_end (code points of text) of examples."""
    return examples.select(
        "conv_id", *carried, "example", F.concat("prefix", "target").alias("text"),
        F.col("prefix_chars").alias("loss_start"), (F.col("prefix_chars") + F.col("loss_chars")).alias("loss_end"),
    )


def read_back(conversations: DataFrame) -> DataFrame:
    """What the formatted text says, and what the exploded examples' loss masks do, as digests (one row per conversation)."""
    quoted = lambda s: r"\Q" + s + r"\E"
    segments = F.slice(F.split("formatted", quoted(TURN)), 2, 2**31 - 1)
    role = lambda s: unescape(F.substring_index(s, BODY, 1))
    text = lambda s: unescape(F.substring_index(F.substring_index(s, BODY, -1), END, 1))
    lines = F.array_join(F.transform("segments", lambda s: F.concat(role(s), F.lit("\n"), text(s), F.lit("\n"))), "")
    told = conversations.withColumn("segments", segments).select(
        "conv_id", "formatted", "examples",
        F.size("segments").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
    figures = ("n_turns", "turns_sha256", "formatted_chars")
    # the examples' rows stay where their conversation is, so putting their losses together takes no shuffle
    under = unescape(F.substring(F.col("text"), (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int")))
    loss = F.when(F.col("example").isNotNull(), F.struct("example", under.alias("loss")))
    exploded = written_out(explode_examples(told, *figures, silent=True), *figures).select("conv_id", *figures, loss.alias("e"))
    found = exploded.groupBy("conv_id").agg(*[F.first(c).alias(c) for c in figures], F.array_sort(F.collect_list("e")).alias("losses"))
    found = found.withColumn("loss", F.array_join(F.transform("losses", lambda e: e["loss"]), ""))
    return found.select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars", F.size("losses").cast("long").alias("n_examples"),
    )

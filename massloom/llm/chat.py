"""Chat formatting by prefix-target expansion, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    """Make control strings impossible inside a text: a backslash becomes ``\\s``, ``<|`` becomes ``<\\p``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<|"), F.lit("<\\p"))


def unescape(text: Column) -> Column:
    """The inverse of ``escape`` and ``escape_role``: each backslash starts a code, and that of the backslash goes last."""
    for code, char in (("\\p", "|"), ("\\n", "\n"), ("\\s", "\\")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def escape_role(role: Column) -> Column:
    """As ``escape``; a line feed, which ends the role in the template, becomes ``\\n``."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def expand(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target_role: str = "assistant") -> DataFrame:
    """One training example for each assistant turn, with all turns before it as context and only that reply trainable.

    Columns: the conversation id, ``example`` (place of the last turn, from 1), ``text`` (all turns up to it, in the
    template), ``loss_start`` (code points before the trainable reply) and ``loss_length``. A conversation that does not
    end with an assistant turn has one more example with its whole text and nothing trainable (``loss_length`` null), so
    that every turn can be read back from the output.

    Turns are ordered by turn (nulls first), then role and text; repeated rows stay. Null texts and roles count as empty.
    A null conversation id is a conversation of its own. No rows give no rows; extra columns are ignored. An example is
    one row by nature, so its size is that of its conversation.
    """
    shown = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"), escape(F.col("said")), F.lit(END))
    rows = turns.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("said"),
    )
    one = F.struct("turn", "role", "said", shown.alias("shown"), (F.col("role") == target_role).alias("target"), F.length(escape(F.col("said"))).alias("size"))
    held = rows.groupBy("conv").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    ends = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.element_at("turns", i)["target"] | (i == F.size("turns")))
    last = F.element_at("turns", F.col("example"))
    examples = held.select("conv", "turns", F.explode(ends).alias("example")).select(
        "conv",
        "example",
        F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("example")), lambda t: t["shown"]), "").alias("text"),
        F.when(last["target"], last["size"]).alias("loss_length"),
    )
    return examples.select(
        F.col("conv").alias(conv_col),
        "example",
        "text",
        (F.length("text") - len(END) - F.col("loss_length")).alias("loss_start"),
        "loss_length",
    )


def read_turns(text: Column) -> Column:
    """array<struct<role, text>> of a formatted text."""
    parts = F.split(text, r"<\|im_end\|>\n", -1)
    bodies = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.substr(p, F.lit(len(START) + 1)))

    def turn(body: Column) -> Column:
        role = F.substring_index(body, "\n", 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substr(body, F.length(role) + 2)).alias("text"))

    return F.transform(bodies, turn)


def digest(examples: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What the examples of each conversation say, read back from their texts."""
    reply = unescape(F.substr(F.col("text"), F.col("loss_start") + 1, F.col("loss_length")))
    found = examples.groupBy(conv_col).agg(
        F.max_by("text", "example").alias("longest"),
        F.array_sort(F.collect_list(F.when(F.col("loss_length").isNotNull(), F.struct("example", reply.alias("reply"))))).alias("replies"),
        F.sum(F.length("text")).alias("formatted_chars"),
    )
    found = found.select(conv_col, "formatted_chars", read_turns(F.col("longest")).alias("turns"), F.array_join(F.transform("replies", lambda r: r["reply"]), "").alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return found.select(
        conv_col,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )

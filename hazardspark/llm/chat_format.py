"""Prefix-target expansion of conversations, with DataFrame functions only.

Every assistant turn becomes an example: all turns before it as context, and only
its text under the loss mask. Turns after the last assistant turn, or of a
conversation without one, come as one more example without a target, so that
no turn is lost.

A turn is [INST]role[/INST]text</s>, an example begins with <s>. Within roles and
texts a backslash is doubled, and one is put behind the first character of each
control string (<s>, </s>, [INST], [/INST]), so that none occurs there; dropping
a backslash and keeping the character after it gives the original back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def escape(x: Column) -> Column:
    x = F.regexp_replace(F.coalesce(x, F.lit("")), r"\\", r"\\\\")
    return F.regexp_replace(x, r"(<|\[)(/?s>|/?INST\])", r"$1\\$2")


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)\\(.)", "$1")


def examples(turns: DataFrame) -> DataFrame:
    """(conv_id, example, formatted, loss_start, loss_end): code points from loss_start to before loss_end train.

    turns: conv_id, turn, role, text. Turns are put in order of turn, role and
    text, null first; repeated rows are turns of their own. Null roles and texts are
    empty; a null conv_id is a conversation. A conversation is gathered in one
    row, as its longest example is one text.
    """
    conv = turns.select("conv_id", F.struct("turn", "role", "text").alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    conv = conv.select(
        "conv_id",
        F.transform("turns", lambda t: F.concat(F.lit("[INST]"), escape(t.role), F.lit("[/INST]"))).alias("heads"),
        F.transform("turns", lambda t: escape(t.text)).alias("bodies"),
        F.transform("turns", lambda t: F.coalesce(t.role, F.lit("")) == "assistant").alias("answers"),
    )
    places = F.sequence(F.lit(1), F.size("heads"))
    targets = F.filter(places, lambda i: F.element_at("answers", i) | (i == F.size("heads")))
    one = conv.select("conv_id", "heads", "bodies", "answers", F.posexplode(targets).alias("example", "upto"))
    whole = F.array_join(F.transform(F.sequence(F.lit(1), F.col("upto")), lambda i: F.concat(F.element_at("heads", i), F.element_at("bodies", i), F.lit("</s>"))), "")
    one = one.withColumn("formatted", F.concat(F.lit("<s>"), whole))
    stop = F.length("formatted") - F.when(F.element_at("answers", F.col("upto")), 4).otherwise(0)
    start = stop - F.when(F.element_at("answers", F.col("upto")), F.length(F.element_at("bodies", F.col("upto")))).otherwise(0)
    return one.select("conv_id", "example", "formatted", start.alias("loss_start"), stop.alias("loss_end"))


def turns_of(formatted: Column) -> Column:
    """The turns of an example, read back from its text."""
    parts = F.filter(F.split(F.substring(formatted, 4, 2**31 - 1), "</s>"), lambda x: x != "")
    return F.transform(
        parts,
        lambda x: F.struct(
            unescape(F.regexp_replace(F.substring_index(x, "[/INST]", 1), r"^\[INST\]", "")).alias("role"),
            unescape(F.element_at(F.split(x, r"\[/INST\]", 2), 2)).alias("text"),
        ),
    )


def loss_of(formatted: Column, start: Column, end: Column) -> Column:
    """The text under the loss mask, read back from the example."""
    return unescape(F.substring(formatted, start + 1, end - start))


def read_back(found: DataFrame) -> DataFrame:
    """Turns, loss text and size of each conversation, as its examples hold them."""
    rows = found.select("conv_id", "example", "formatted", loss_of(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("loss"))
    whole = rows.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x.loss), "").alias("loss"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
    )
    whole = whole.withColumn("turns", turns_of(F.col("longest")))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return whole.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )

"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it as context, and only
its text trainable. An example is a prefix of the conversation's one rendering, so a
conversation is rendered once. Turns after the last assistant turn close the expansion as
an example without a target: nothing of a conversation is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A turn is OPEN role MIDDLE text CLOSE.
OPEN, MIDDLE, CLOSE = "<|turn:", "|>\n", "<|end|>\n"
#: Control strings of common chat templates; none is left inside a text.
CONTROLS = ("<|", "|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ESCAPE = "~"
TRAINED = "assistant"


def escape(text: Column) -> Column:
    """ESCAPE becomes ~0 and the n-th control string ~n, as in a JSON pointer."""
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0"))
    for n, control in enumerate(CONTROLS, 1):
        out = F.replace(out, F.lit(control), F.lit(f"{ESCAPE}{n}"))
    return out


def unescape(text: Column) -> Column:
    for n, control in reversed(list(enumerate(CONTROLS, 1))):
        text = F.replace(text, F.lit(f"{ESCAPE}{n}"), F.lit(control))
    return F.replace(text, F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def format_examples(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, example, target, formatted, loss_start, loss_chars): example counts from 0 in a
    conversation; target is the place of the trained turn from 0, null for the closing
    example; the loss mask is formatted[loss_start : loss_start + loss_chars] in code points.

    Turns stand in the order of (turn, role, text), nulls first, so ties and repeated rows have
    a fixed place and each is a turn. Null role or text is empty; the null conversation is a
    conversation. An empty table gives no rows; other columns are ignored. A conversation
    is one row while it is rendered, as its examples are.
    """
    rows = df.select(
        F.col(conv).cast("bigint").alias("conv_id"), F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    body = escape(F.col("text"))
    piece = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MIDDLE), body, F.lit(CLOSE))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = rows.select("*", piece.alias("piece"), F.length(body).cast("bigint").alias("chars")).select(
        "conv_id", (F.row_number().over(order) - 1).alias("place"), "piece", "chars", (F.col("role") == TRAINED).alias("trained"),
        F.sum(F.length("piece").cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("stop"),
    )
    by_conv = placed.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "piece"))).alias("pieces"),
        # the trained turns, and the last turn if it is not one of them
        F.array_sort(F.collect_list(F.when(F.col("trained"), F.struct("place", "stop", "chars", "trained")))).alias("targets"),
        F.max(F.struct("place", "stop", "chars", "trained")).alias("last"),
    )
    closing = F.when(~F.col("last")["trained"], F.array("last"))
    expanded = by_conv.select(
        "conv_id", F.array_join(F.col("pieces")["piece"], "").alias("whole"),
        F.posexplode(F.coalesce(F.concat("targets", closing), F.col("targets"))).alias("example", "t"),
    )
    trained = F.col("t")["trained"]
    return expanded.select(
        "conv_id", "example", F.when(trained, F.col("t")["place"]).alias("target"),
        F.substring("whole", F.lit(1), F.col("t")["stop"].cast("int")).alias("formatted"),
        F.when(trained, F.col("t")["stop"] - len(CLOSE) - F.col("t")["chars"]).otherwise(F.col("t")["stop"]).alias("loss_start"),
        F.when(trained, F.col("t")["chars"]).otherwise(0).cast("bigint").alias("loss_chars"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted example."""
    turns = F.filter(F.split(formatted, r"<\|end\|>\n", -1), lambda t: t != "")
    return F.transform(
        turns,
        lambda t: F.struct(
            unescape(F.substring(F.substring_index(t, MIDDLE, 1), F.lit(len(OPEN) + 1), F.length(t))).alias("role"),
            unescape(F.substring(t, F.instr(t, MIDDLE) + len(MIDDLE), F.length(t))).alias("text"),
        ),
    )


def loss_text(formatted: Column, start: Column, chars: Column) -> Column:
    """What stands under the loss mask, as it was before formatting."""
    return unescape(F.substr(formatted, start.cast("int") + 1, chars.cast("int")))


def conversation_digests(examples: DataFrame) -> DataFrame:
    """One row per conversation, read back from its examples: number and digest of its turns,
    length and digest of all text under loss masks, characters of all its examples."""
    read = examples.select(
        "conv_id", "example", F.length("formatted").cast("bigint").alias("size"),
        loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_chars")).alias("loss"), "formatted",
    )
    by_conv = read.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"), F.sum("size").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.struct("example", "loss"))).alias("losses"),
    )
    turns = by_conv.select("conv_id", read_turns(F.col("longest")).alias("turns"), F.array_join(F.col("losses")["loss"], "").alias("loss"), "formatted_chars")
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(text.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )

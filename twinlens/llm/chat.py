"""Chat formatting with Spark expressions only.

The template writes every run of turns of one role as

    <|start|>role<|body|>text<|next|>text<|end|>

Control strings inside roles and texts, of this template and of common others, get a backslash after
their first character (a backslash that is already there gets another), so that they no longer
read as control strings and can be restored exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, BODY, NEXT, END = "<|start|>", "<|body|>", "<|next|>", "<|end|>"
#: What follows the bracket of a control string.
CONTROL = r"(?:/?s>|/?INST\]|/?SYS>>|\|(?:start|body|next|end)\|>)"


def escape(text: Column) -> Column:
    """Break every control string in ``text`` with a backslash; null stays null."""
    return F.regexp_replace(text, rf"([<\[])(\\*{CONTROL})", r"$1\\$2")


def unescape(text: Column) -> Column:
    """Undo :func:`escape`."""
    return F.regexp_replace(text, rf"([<\[])\\(\\*{CONTROL})", "$1$2")


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per ``conv_id`` of ``turns`` (conv_id, turn, role, text): the formatted text and its loss mask.

    Turns are ordered by ``turn``, then role and text, so ties and repeated rows have a fixed order and all
    are kept; a null turn comes first. Adjacent turns of the same role become one block. Null roles and
    texts count as empty, a null ``conv_id`` is a conversation like any other, extra columns are ignored,
    and an empty table gives an empty result.

    Returns ``conv_id``, ``formatted`` and ``segments``, an array of (text, loss) whose texts
    joined are ``formatted``; ``loss`` is true for assistants' texts alone.
    """
    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_ = clean.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    # the first turn of each run of one role, then the runs as slices: linear in the turns
    starts = sorted_.withColumn(
        "starts",
        F.expr("filter(sequence(0, size(turns) - 1), i -> i = 0 or turns[i].role <> turns[greatest(i - 1, 0)].role)"),
    )
    runs = starts.select(
        "conv_id",
        F.expr("transform(starts, (s, k) -> slice(turns, s + 1, coalesce(try_element_at(starts, k + 2), size(turns)) - s))").alias("runs"),
    )

    def segments(run: Column) -> Column:
        role = run[0]["role"]
        piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        head = F.array(piece(F.concat(F.lit(START), escape(role), F.lit(BODY)), F.lit(False)))
        body = F.flatten(
            F.transform(
                run,
                lambda t, i: F.concat(
                    F.when(i > 0, F.array(piece(F.lit(NEXT), F.lit(False)))).otherwise(F.slice(F.array(piece(F.lit(NEXT), F.lit(False))), 1, 0)),
                    F.array(piece(escape(t["text"]), t["role"] == F.lit("assistant"))),
                ),
            )
        )
        return F.concat(head, body, F.array(piece(F.lit(END), F.lit(False))))

    out = runs.select("conv_id", F.flatten(F.transform("runs", segments)).alias("segments"))
    return out.select("conv_id", F.array_join(F.col("segments.text"), "").alias("formatted"), "segments")


def parse_formatted(formatted: Column) -> Column:
    """The turns of a formatted text: array of (role, text)."""
    block = r"(?s)<\|start\|>.*?<\|end\|>"
    blocks = F.regexp_extract_all(formatted, F.lit(block), 0)

    def turns(b: Column) -> Column:
        inner = F.substring(b, len(START) + 1, F.length(b) - len(START) - len(END))
        halves = F.split(inner, r"<\|body\|>", 2)
        role = unescape(halves[0])
        return F.transform(F.split(halves[1], r"<\|next\|>", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    kept = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(kept, lambda s: unescape(s["text"])), "")


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Digests of what :func:`format_conversations` wrote, taken from its output alone."""
    back = formatted.select("conv_id", "formatted", parse_formatted(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("under_loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("under_loss").cast("long").alias("loss_chars"),
        F.sha2("under_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )

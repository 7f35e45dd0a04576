"""Conversations as one string each, by Spark expressions only, with a loss mask and a way back.

Template (fixed format): a message is ``### role: `` + its turns joined by ``<turn/>`` +
``</turn>`` and a line end. Adjacent turns of one role are one message. In roles and
texts a backslash becomes ``\\\\``, ``###`` becomes ``\\h``, ``</turn>`` becomes ``\\e``,
``<turn/>`` becomes ``\\t`` and, in roles, a colon becomes ``\\c``; so a control string
in the output is always the template's own, and ``parsed`` restores every turn.

The loss mask is the list of spans (start, end; code points) of the assistant's texts.
Turns are ordered by turn, then role, then text; rows that repeat stay. Null roles and
texts count as empty, a null turn comes first, a null conversation id is a conversation.
An empty table gives no rows. Columns other than the four named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running_totals

# Control strings and what stands for them in texts.
ESCAPES = [("\\", "\\\\"), ("###", "\\h"), ("</turn>", "\\e"), ("<turn/>", "\\t")]
OPEN, NEXT, CLOSE, COLON = "### ", "<turn/>", "</turn>\n", ": "


def escaped(text: Column) -> Column:
    for raw, safe in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescaped(text: Column) -> Column:
    """The way back. Pairs of backslashes are taken first, from the left; what is between them has no other."""

    def part(x: Column) -> Column:
        for raw, safe in ESCAPES[1:]:
            x = F.replace(x, F.lit(safe), F.lit(raw))
        return F.replace(x, F.lit("\\c"), F.lit(":"))

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), part), "\\")


def formatted(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans."""
    blank = F.lit("")
    turn = F.struct(F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), blank).alias("role"), F.coalesce(F.col(f"`{text_col}`"), blank).alias("text"))
    turns = rows.groupBy(F.col(f"`{conv_col}`").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def piece(t: Column, i: Column) -> Column:
        """What a turn adds: an opening and its text, or a join and its text; and whether a message ends with it."""
        same = (i > 0) & (F.get("turns", i - 1)["role"] == t["role"])
        ends = F.coalesce(F.get("turns", i + 1)["role"] != t["role"], F.lit(True))
        head = F.when(same, F.lit(NEXT)).otherwise(F.concat(F.lit(OPEN), F.replace(escaped(t["role"]), F.lit(":"), F.lit("\\c")), F.lit(COLON)))
        return F.struct(head.alias("head"), escaped(t["text"]).alias("body"), F.when(ends, F.lit(CLOSE)).otherwise(blank).alias("tail"), (t["role"] == learn).alias("learn"))

    made = turns.select("conv_id", F.transform("turns", piece).alias("p"))
    text = F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], x["tail"])), "")
    before = running_totals(F.transform("p", lambda x: F.char_length(F.concat(x["head"], x["body"], x["tail"]))))
    placed = F.zip_with("p", before, lambda x, b: F.struct((b + F.char_length(x["head"])).cast("int").alias("start"), (b + F.char_length(x["head"]) + F.char_length(x["body"])).cast("int").alias("end"), x["learn"].alias("learn")))
    spans = F.transform(F.filter(placed, lambda x: x["learn"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return made.select("conv_id", text.alias("formatted"), spans.alias("loss_spans"))


def parsed(text: Column) -> Column:
    """The turns of a formatted string: array of (role, text)."""
    messages = F.filter(F.split(text, CLOSE, -1), lambda m: m != "")

    def turns(m: Column) -> Column:
        at = F.locate(COLON, m)
        role = unescaped(F.substring(m, F.lit(len(OPEN) + 1), at - len(OPEN) - 1))
        bodies = F.split(F.substring(m, at + len(COLON), F.char_length(m)), NEXT, -1)
        return F.transform(bodies, lambda b: F.struct(role.alias("role"), unescaped(b).alias("text")))

    return F.flatten(F.transform(messages, turns))


def read_back(chats: DataFrame) -> DataFrame:
    """From formatted strings and masks alone: turns, what the mask covers, and their digests."""
    loss = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))), "")
    both = chats.select("conv_id", "formatted", parsed(F.col("formatted")).alias("turns"), loss.alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    return both.select("conv_id", F.size("turns").cast("long").alias("n_turns"), digest(whole).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), digest(F.col("loss")).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))

"""Chat formatting with typed content parts.

Only DataFrame functions. A visitor turns each part of a turn into text: text parts are escaped,
image, audio and document parts become placeholders in order, and each attachment is recorded with
the number of tokens its placeholder stands for. `parse` reads the formatted text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchlake.llm.common import column

TURN, END = "<|im_start|>", "<|im_end|>\n"
PARTS = "array<struct<type:string,text:string,ref:string,amount:double>>"
#: Tokens of a placeholder: per unit of `amount` (images: tiles, audio: seconds, documents: pages).
TOKENS = {"image": 256.0, "audio": 25.0, "document": 512.0}
#: Every control string holds one of these, or is the escape itself; "%" comes first.
ESCAPES = (("%", "%25"), ("<", "%3C"), ("[", "%5B"))


def escape(text: Column, more=()) -> Column:
    for plain, code in (*ESCAPES, *more):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, more=()) -> Column:
    """A "%" of an escaped text begins a code, so codes can be put back one kind after the other."""
    for plain, code in reversed((*ESCAPES, *more)):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


LINE_END = (("\n", "%0A"),)


def text_part(text: Column) -> Column:
    """A turn of nothing but text as its list of parts."""
    null = F.lit(None)
    return F.array(F.struct(F.lit("text"), text, null, null)).cast(PARTS)


def visit(part: Column) -> Column:
    """The text a part becomes: its escaped text, or a placeholder; null and unknown kinds: empty."""
    return F.when(part.type == "text", escape(F.coalesce(part.text, F.lit("")))).when(
        part.type.isin(*TOKENS), F.concat(F.lit("<|"), part.type, F.lit("|>"))
    ).otherwise(F.lit(""))


def tokens(part: Column) -> Column:
    count = F.lit(None).cast("double")
    for kind, per_unit in TOKENS.items():
        count = F.when(part.type == kind, F.ceil(F.coalesce(part.amount, F.lit(1.0)) * per_unit)).otherwise(count)
    return count.cast("bigint")


def format_chats(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    parts: str = "parts",
) -> DataFrame:
    """One row per conversation: its key, `formatted` and `attachments`.

    `parts` is an array of structs type, text, ref, amount. `attachments` lists, in the order of the
    placeholders, turn (from 0), type, ref and tokens. Turns run by number, null first, then by role
    and parts, so that repeated numbers have a fixed order. Null roles, parts and texts are empty;
    rows with a null key make one conversation. Other columns are left out.
    """
    rows = turns.select(
        column(conversation).alias("__key"),
        F.struct(
            column(turn).alias("turn"),
            F.coalesce(column(role), F.lit("")).alias("role"),
            F.coalesce(column(parts).cast(PARTS), F.array().cast(PARTS)).alias("parts"),
        ).alias("t"),
    )
    chats = rows.groupBy("__key").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def one_turn(t):
        body = F.array_join(F.transform(t.parts, visit), "")
        return F.concat(F.lit(TURN), escape(t.role, LINE_END), F.lit("\n"), body, F.lit(END))

    attachments = F.flatten(
        F.transform(
            "turns",
            lambda t, i: F.transform(
                F.filter(t.parts, lambda p: F.coalesce(p.type.isin(*TOKENS), F.lit(False))),
                lambda p: F.struct(
                    i.cast("bigint").alias("turn"), p.type.alias("type"), p.ref.alias("ref"), tokens(p).alias("tokens")
                ),
            ),
        )
    )
    return chats.select(
        F.col("__key").alias(conversation),
        F.array_join(F.transform("turns", one_turn), "").alias("formatted"),
        attachments.alias("attachments"),
    )


def parse(formatted: Column, loss_role: str = "assistant") -> Column:
    """Read a formatted conversation back: array of structs role, text, in_loss.

    Placeholders are no text; they are left out.
    """
    pieces = F.split(formatted, END.replace("|", r"\|"))
    whole = F.slice(pieces, 1, F.size(pieces) - 1)  # nothing stands behind the last end mark
    marks = "|".join(rf"<\|{kind}\|>" for kind in TOKENS)

    def read(piece):
        role = unescape(F.substring_index(F.substring(piece, len(TURN) + 1, 2**30), "\n", 1), LINE_END)
        body = F.substring(piece, F.instr(piece, "\n") + 1, F.lit(2**30))
        text = unescape(F.regexp_replace(body, marks, ""))
        return F.struct(role.alias("role"), text.alias("text"), (role == loss_role).alias("in_loss"))

    return F.transform(whole, read)

"""Line-first cleaning: rules look at single lines, documents fall by how much text they lose.

Only DataFrame functions; every document is one row from start to end, nothing is shuffled.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchlake.llm.common import WORD, Masked


def _class(characters) -> str:
    """A class of these characters for the patterns of Java, RE2 and Python, runs as ranges."""
    runs = []
    for code in sorted(set(map(ord, characters))):
        if runs and code == runs[-1][1] + 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    escaped = [[f"\\{c}" if (c := chr(code)) in "\\[]^-&~|" else c for code in run] for run in runs]
    return "[" + "".join(first if first == last else f"{first}-{last}" for first, last in escaped) + "]"


#: Unicode's sentence ends (danda, Arabic, Ethiopic, fullwidth and so on), ellipses, colons, semicolons.
SENTENCE_ENDS = (
    ".!?:;…‥⋯։؛؝؞؟۔܀܁܂߹।॥။၊።፤፥፦፧፨᙮។៕៖᠃᠉᥄᥅᪨᪩᪪᪫᭚᭛᭞᭟᭽᭾᭿᰻᰼᱾᱿․‼‽⁇⁈⁉⳹⳺⳻⸮⸼⹓⹔"
    "\u0837\u0839\u083d\u083e\u1735\u1736\u1b4e\u1b4f\ua4ff\ua60e\ua60f\ua6f3\ua6f7\ua876\ua877\ua8ce\ua8cf\ua92f"
    "\ua9c8\ua9c9\uaa5d\uaa5e\uaa5f\uaaf0\uaaf1\uabeb\u037e"
    "。！．：；？｡︒︓︔︕︖︙﹒﹔﹕﹖﹗"
)
_CLOSING = [c for c in map(chr, range(0x10000)) if unicodedata.category(c) in ("Pe", "Pf", "Pi")]
_BLANKS = [c for c in map(chr, range(0x10000)) if unicodedata.category(c) == "Zs"]
#: Behind an end: quotes and closing brackets, blanks of any width, no-break and invisible ones.
BEHIND_ENDS = "".join(_CLOSING + _BLANKS) + "\"'＂＇\t\r\v\f\x85\u200b\u200e\u200f\u2060\ufeff"
#: The same as a pattern for other engines: a sentence end, and any run of quotes, brackets and blanks behind it.
END_PUNCTUATION = rf"{_class(SENTENCE_ENDS)}{_class(BEHIND_ENDS)}*\z"
#: Menu lines: separators between short entries, arrows, or nothing but the name of an action.
NAVIGATION = (
    r"^[^|»›·•]{0,40}([|»›·•][^|»›·•]{0,40}){2,}\z"
    r"|(?i)^[ \t]*(home|menu|login|log in|sign in|sign up|register|search|share|next|previous|back"
    r"|read more|skip to content|contact|contact us|about us)[ \t\r.!>»]*\z"
)
BOILERPLATE = (
    r"(?i)lorem ipsum|javascript|cookie policy|cookies? (are|to)|accept (all )?cookies"
    r"|privacy policy|terms of (use|service)|all rights reserved|subscribe to our"
    r"|click here|sign up for"
)
SYMBOLS = "#*$%&|<>"


def line_first(
    docs: DataFrame,
    text: str = "text",
    sentence_ends: str = SENTENCE_ENDS,
    behind_ends: str = BEHIND_ENDS,
    navigation: str = NAVIGATION,
    boilerplate: str = BOILERPLATE,
    short_line: int = 4,
    max_symbol_share: float = 0.2,
    max_loss: float = 0.5,
    min_words: int = 10,
    max_repeat_percent: int = 20,
) -> DataFrame:
    """One row per row of `docs`: its columns, and a struct `quality` with measures and verdict.

    A line fails if it is longer than `short_line` words and doesn't end with one of `sentence_ends`, any
    of `behind_ends` after it left out, reads like a menu, holds a boilerplate phrase, or has symbols for more than `max_symbol_share` of its
    characters. Lines without words stay as they are. A document is rejected if its lines lose more
    than `max_loss` of its word characters, if it has fewer than `min_words` words, or if more than
    `max_repeat_percent` percent of its words lie in 5-word windows that it holds twice.

    A null text counts as empty: no words, rejected, cleaned text empty. An existing column
    `quality` is replaced. Repeated rows are judged each for itself.
    """
    table = Masked(docs, replaced=("quality",))
    df = table.df.withColumn("__body", F.coalesce(table.at(text), F.lit(""))).select(
        "*",
        F.regexp_extract_all("__body", F.lit(WORD), F.lit(0)).alias("__words"),
        F.split("__body", "\n").alias("__lines"),
    )
    words = F.col("__words")
    windows = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 4, F.lit(0))),
        lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, 5))),
    )

    def fails(line):
        # only the line's tail is looked at; a heading of a few words needs no end punctuation
        last = F.right(F.rtrim(line, F.lit(behind_ends)), F.lit(1))
        ended = (last != "") & F.lit(sentence_ends).contains(last)
        bare = ~ended & (F.regexp_count(line, F.lit(WORD)) > short_line)
        symbols = F.length(line) - F.length(F.translate(line, SYMBOLS, ""))
        return (
            bare
            | line.rlike(navigation)
            | line.rlike(boilerplate)
            | (symbols > F.length(line) * max_symbol_share)
        )

    df = df.select(
        "*",
        windows.alias("__windows"),
        F.filter("__lines", lambda line: line.rlike(WORD)).alias("__worded"),
        F.filter("__lines", lambda line: ~line.rlike(WORD) | ~fails(line)).alias("__left"),
    ).select(
        "*",
        F.array_join("__left", "\n").alias("__cleaned"),
        # most texts repeat no window, and only the others are sorted
        F.when(
            F.size(F.array_distinct("__windows")) < F.size("__windows"),
            F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        )
        .otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
        .alias("__sorted"),
    )
    ordered = F.col("__sorted")
    df = df.select(
        "*",
        F.sort_array(
            F.transform(
                F.filter(
                    ordered,
                    lambda e, i: F.coalesce(e.h == F.get(ordered, i + 1).h, F.lit(False))
                    | F.coalesce(e.h == F.get(ordered, i - 1).h, F.lit(False)),
                ),
                lambda e: e.i,
            )
        ).alias("__starts"),
    )
    starts = F.col("__starts")
    covered = F.aggregate(
        F.transform(starts, lambda s, i: F.least(F.lit(5), F.coalesce(F.get(starts, i + 1) - s, F.lit(5)))),
        F.lit(0).cast("bigint"),
        lambda total, step: total + step,
    )
    spaces = r"[\x20\x09-\x0D]+"
    df = df.select(
        "*",
        F.size("__words").cast("bigint").alias("__n_words"),
        F.length(F.regexp_replace("__body", spaces, "")).cast("bigint").alias("__chars"),
        F.length(F.regexp_replace("__cleaned", spaces, "")).cast("bigint").alias("__chars_left"),
        covered.alias("__repeats"),
    ).select(
        "*",
        ((F.col("__n_words") < min_words) | (F.col("__repeats") * 100 > F.col("__n_words") * max_repeat_percent)).alias(
            "__base_failed"
        ),
    )
    quality = F.struct(
        F.col("__n_words").alias("n_words"),
        F.col("__chars").alias("word_chars"),
        (F.length("__body") - F.length(F.translate("__body", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("__worded") - F.size(F.array_distinct("__worded"))).cast("bigint").alias("n_dup_lines"),
        F.col("__repeats").alias("n_repeat_words"),
        F.col("__base_failed").alias("base_failed"),
        (F.size("__lines") - F.size("__left")).cast("bigint").alias("n_lines_removed"),
        (F.col("__chars") - F.col("__chars_left")).alias("chars_removed"),
        F.col("__cleaned").alias("text"),
        (
            ~F.col("__base_failed")
            & (F.col("__chars") - F.col("__chars_left") <= F.col("__chars") * max_loss)
        ).alias("kept"),
    )
    # as output of a generator: a filter on it must not be pushed down with copies of all of the above
    return table.back(df, F.explode(F.array(quality)).alias("quality"))

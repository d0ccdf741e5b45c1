"""Result rows to text: search context, data block, summary, prompts, messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchlake.functions import fixed, prompts
from watchlake.functions.text import fill_template
from watchlake.functions.timestamps import timestamp_text


def _joined(rank: str, line: str, separator: str) -> Column:
    """Lines of a group in rank order. Callers bound the group by a rank limit."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(rank), F.col(line))))
    return F.array_join(F.transform(ordered, lambda item: item[line]), separator)


def hit_line() -> Column:
    """One line of a search hit; a NULL part reads None."""
    day = F.substring(timestamp_text(F.col("watched_at")), 1, 10)
    return F.concat(
        F.lit("- "),
        F.coalesce("title", F.lit("None")),
        F.lit(" (チャンネル: "),
        F.coalesce("channel_name", F.lit("None")),
        F.lit(", 視聴日: "),
        F.coalesce(day, F.lit("NaT")),
        F.lit(")"),
    )


def search_context(hits: DataFrame) -> DataFrame:
    """(question_id, data_count, context) from ranked search hits."""
    return (
        hits.withColumn("_line", hit_line())
        .groupBy("question_id")
        .agg(F.count(F.lit(1)).alias("data_count"), _joined("rank", "_line", "\n").alias("_lines"))
        .select(
            "question_id",
            "data_count",
            F.concat(
                fill_template(fixed.HITS_HEADER, n=F.col("data_count")),
                F.lit("\n"),
                F.col("_lines"),
            ).alias("context"),
        )
    )


# Control characters whose \\u escape has a letter in it; it is written in lower case.
_LETTER_ESCAPES = ("000B", "000E", "000F", "001A", "001B", "001C", "001D", "001E", "001F")


def json_string(text: Column) -> Column:
    """A string as a JSON literal, NULL as null."""
    quoted = F.to_json(F.array(text))
    lower = quoted
    for code in _LETTER_ESCAPES:
        # An escape, not the end of an escaped backslash.
        lower = F.regexp_replace(
            lower, rf"(?<!\\)((?:\\\\)*)\\u{code}", rf"$1\\u{code.lower()}"
        )
    quoted = F.when(text.rlike(r"[\x0B\x0E\x0F\x1A-\x1F]"), lower).otherwise(quoted)
    return F.when(text.isNull(), "null").otherwise(
        F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    )


def json_object(columns: list[str]) -> Column:
    """A row of string columns as a JSON object, indented as an element of a list."""
    pairs = [
        F.concat(F.lit(f'    "{name}": '), json_string(F.col(name).cast("string")))
        for name in columns
    ]
    return F.concat(F.lit("  {\n"), F.concat_ws(",\n", *pairs), F.lit("\n  }"))


def data_blocks(rows: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """(keys, data_count, data_text): the first rows as a JSON list, with a note on the rest.

    rows: keys, rank from 1, line (from json_object). Lines beyond the first 50 only count.
    """
    shown = F.when(F.col("rank") <= fixed.PROMPT_ROWS, F.struct("rank", F.col(line).alias("line")))
    lines = F.transform(F.array_sort(F.collect_list(shown)), lambda item: item["line"])
    total = F.count(F.lit(1))
    return (
        rows.groupBy(*keys)
        .agg(total.alias("data_count"), lines.alias("_lines"))
        .select(
            *keys,
            "data_count",
            F.concat(
                F.lit("[\n"),
                F.array_join("_lines", ",\n"),
                F.lit("\n]"),
                F.when(
                    F.col("data_count") > fixed.PROMPT_ROWS,
                    fill_template(
                        fixed.DATA_BLOCK_NOTE,
                        total=F.col("data_count"),
                        shown=F.lit(fixed.PROMPT_ROWS),
                    ),
                ).otherwise(""),
            ).alias("data_text"),
        )
    )


def data_summary(
    rows: DataFrame, keys: list[str], columns: list[str], every: DataFrame | None = None
) -> DataFrame:
    """(keys, summary): number of rows and the first five as `name: value` lists.

    Keys of `every` without rows get the sentence for no data.
    """
    pairs = [
        F.concat(F.lit(f"{name}: "), F.coalesce(F.col(name).cast("string"), F.lit("None")))
        for name in columns
    ]
    number = F.col("rank").cast("string")
    line = F.concat(number, F.lit(". "), F.concat_ws(", ", *pairs), F.lit("\n"))
    shown = F.when(F.col("rank") <= fixed.SUMMARY_ROWS, F.struct("rank", line.alias("line")))
    lines = F.transform(F.array_sort(F.collect_list(shown)), lambda item: item["line"])
    summaries = (
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"), lines.alias("_lines"))
        .select(
            *keys,
            F.concat(
                fill_template(fixed.SUMMARY_HEADER, n=F.col("_n")),
                fill_template(fixed.SUMMARY_SAMPLE, n=F.size("_lines")),
                F.array_join("_lines", ""),
            ).alias("summary"),
        )
    )
    if every is None:
        return summaries
    return (
        every.select(*keys)
        .distinct()
        .join(summaries, keys, "left")
        .select(*keys, F.coalesce("summary", F.lit(fixed.NO_SUMMARY_DATA)).alias("summary"))
    )


def sql_prompt(question: Column, data_text: Column) -> Column:
    """Prompt of the template route; no data gives the fixed sentence."""
    return fill_template(
        fixed.SQL_PROMPT,
        data=F.coalesce(data_text, F.lit(fixed.NO_DATA_BLOCK)),
        question=question,
    )


def vector_prompt(question: Column, context: Column) -> Column:
    return fill_template(
        fixed.VECTOR_PROMPT,
        context=F.coalesce(context, F.lit(fixed.NO_HITS)),
        question=question,
    )


def append_message(history: Column, message: Column) -> Column:
    """Message list with a new user message at its end; NULL history starts a list."""
    message = F.struct(F.lit("user").alias("role"), message.alias("content"))
    return F.when(history.isNull(), F.array(message)).otherwise(F.array_append(history, message))


def message_lists(turns: DataFrame) -> DataFrame:
    """(conv_id, messages) from rows (conv_id, turn, role, text): one list per conversation.

    What a model is given in one call is one value, so a conversation is one row.
    """
    item = F.struct("turn", "role", F.col("text").alias("content"))
    ordered = F.array_sort(F.collect_list(item))
    return turns.groupBy("conv_id").agg(
        F.transform(ordered, lambda m: F.struct(m["role"], m["content"])).alias("messages")
    )


def model_input(
    message: Column,
    history: Column | None = None,
    system_prompt: Column | None = None,
    default_system: str = prompts.CHAT_SYSTEM,
) -> Column:
    """What a chat model is given: system prompt and messages, the new message last."""
    system = F.lit(None).cast("string") if system_prompt is None else system_prompt
    if history is None:
        history = F.lit(None).cast("array<struct<role:string,content:string>>")
    return F.struct(
        F.coalesce(F.nullif(system, F.lit("")), F.lit(default_system)).alias("system"),
        append_message(history, message).alias("messages"),
    )


def answer_envelope(answer: Column, data_count: Column, source: Column) -> Column:
    return F.to_json(
        F.struct(
            answer.alias("answer"), data_count.alias("data_count"), source.alias("source")
        ),
        {"ignoreNullFields": "false"},
    )

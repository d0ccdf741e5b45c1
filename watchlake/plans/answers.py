"""Answer contexts for a batch of questions of many users.

Every question gets the data, the prompt and the labels an answering model needs. The reply
itself is up to a model outside this library.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchlake.functions import fixed, prompts
from watchlake.operators.context import (
    data_blocks,
    json_object,
    search_context,
    sql_prompt,
    vector_prompt,
)
from watchlake.operators.embedding import Embedder, HashEmbedder, embed_texts
from watchlake.operators.routing import route_questions
from watchlake.operators.search import search
from watchlake.operators.skew import HOT_ROWS, hot_keys, repeat_rows, salt_rows
from watchlake.plans.templates import (
    daily_watch_count,
    most_watched_channels,
    recent_history,
    total_videos,
)
from watchlake.session import cut_lineage, prepare_session
from watchlake.sources.tables import as_result_strings

_VECTOR = "vector"


def _template_blocks(history: DataFrame, needed: DataFrame) -> DataFrame:
    """(user_id, plan, data_count, data_text) for every needed (user_id, plan).

    Blocks are built once per user and template, not per question, and at most one hundred
    rows per user reach the grouping. Each template reads the rows of the users who need it, and
    one that nobody needs reads none; Spark broadcasts their list if it is short.
    """

    def asking(name: str) -> DataFrame:
        return needed.where(F.col("plan") == name).select("user_id").distinct()

    def rows_for(name: str) -> DataFrame:
        return history.join(asking(name), "user_id", "left_semi")

    def blocks(name: str, rows: DataFrame) -> DataFrame:
        columns = [c for c in rows.columns if c not in ("user_id", "rank")]
        lines = as_result_strings(rows).select(
            "user_id", F.col("rank").cast("int").alias("rank"), json_object(columns).alias("line")
        )
        return data_blocks(lines, ["user_id"]).withColumn("plan", F.lit(name))

    def totals(rows: DataFrame) -> DataFrame:
        return total_videos(rows, users=asking("total_videos")).withColumn("rank", F.lit(1))

    templates = {
        "most_watched_channels": most_watched_channels,
        "total_videos": totals,
        "recent_history": recent_history,
        "daily_watch_count": daily_watch_count,
    }
    # At most one row per template.
    wanted = {row["plan"] for row in needed.select("plan").distinct().collect()}
    parts = [blocks(n, build(rows_for(n))) for n, build in templates.items() if n in wanted]
    if not parts:
        empty = "user_id string, data_count bigint, data_text string, plan string"
        return needed.sparkSession.createDataFrame([], empty)
    return functools.reduce(DataFrame.unionByName, parts)


def search_texts(
    questions: DataFrame,
    vectors: DataFrame,
    embedder: Embedder | None = None,
    k: int = fixed.SEARCH_DEFAULT_K,
) -> DataFrame:
    """Search hits of text questions (question_id, user_id, question)."""
    embedded = embed_texts(
        questions.select("question_id", "user_id", "question"), "question", embedder
    )
    return search(vectors, embedded, k)


def search_text(
    question: str,
    user_id: str,
    vectors: DataFrame,
    embedder: Embedder | None = None,
    k: int = fixed.SEARCH_DEFAULT_K,
) -> DataFrame:
    """Search hits of one question of one user, best first."""
    asked = vectors.sparkSession.createDataFrame(
        [(0, user_id, question)], "question_id long, user_id string, question string"
    )
    return search_texts(asked, vectors, embedder, k).drop("question_id").orderBy("rank")


def answer_batch(
    questions: DataFrame,
    history: DataFrame,
    vectors: DataFrame,
    embedder: Embedder | None = None,
    k: int = fixed.ANSWER_SEARCH_K,
    hot_rows: int = HOT_ROWS,
    data_system: str = prompts.DATA_SYSTEM,
    search_system: str = prompts.SEARCH_SYSTEM,
) -> DataFrame:
    """One row per question: its labels, data_count, context, prompt and system_prompt.

    questions: question_id, user_id, question. Blank questions are left out; they are found
    with `check_questions`. `route` and `source` follow the keywords; `plan` names what was
    done, which differs for vector questions of users without vectors: they get the recent
    history and keep their source label.
    """
    prepare_session(questions.sparkSession)
    embedder = embedder or HashEmbedder()
    routed = route_questions(questions.select("question_id", "user_id", "question"))
    # One user may ask a large share of all questions; such users are salted in both joins.
    # The list is stored, so that all joins below use the same salts.
    hot = cut_lineage(hot_keys(routed, "user_id", hot_rows))
    routed = salt_rows(routed, hot, "user_id", F.col("question_id"))
    asking = routed.select("user_id").distinct()
    stored = (
        vectors.select("user_id")
        .join(asking, "user_id", "left_semi")
        .distinct()
        .withColumn("_stored", F.lit(True))
    )
    planned = (
        routed.join(repeat_rows(stored, hot, "user_id"), ["user_id", "_salt"], "left")
        .withColumn(
            "plan",
            F.coalesce(
                "route",
                F.when(F.col("_stored"), _VECTOR),
                F.lit(fixed.FALLBACK_ROUTE),
            ),
        )
        .drop("_stored")
    )
    # Size checks, blocks, search and prompts all start from here.
    planned = cut_lineage(planned)

    labels = ["question_id", "user_id", "question", "route", "source", "plan"]
    by_template = planned.where(F.col("plan") != _VECTOR)
    blocks = _template_blocks(history, by_template.select("user_id", "plan").distinct())
    blocks = repeat_rows(blocks, hot, "user_id")
    from_sql = by_template.join(blocks, ["user_id", "plan", "_salt"], "left").select(
        *labels,
        F.coalesce("data_count", F.lit(0).cast("bigint")).alias("data_count"),
        F.coalesce("data_text", F.lit(fixed.NO_DATA_BLOCK)).alias("context"),
        sql_prompt(F.col("question"), F.col("data_text")).alias("prompt"),
        F.lit(data_system).alias("system_prompt"),
    )

    by_vector = planned.where(F.col("plan") == _VECTOR)
    hits = search_texts(by_vector, vectors, embedder, k)
    from_vectors = by_vector.join(search_context(hits), "question_id").select(
        *labels,
        "data_count",
        "context",
        vector_prompt(F.col("question"), F.col("context")).alias("prompt"),
        F.lit(search_system).alias("system_prompt"),
    )
    return from_sql.unionByName(from_vectors)

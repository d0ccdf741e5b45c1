"""The four history queries, for one user or for all users in one job.

With a user_id the result has the columns and order of a single-user query, and the filter
prunes the user's partition. Without one, every user's rows come with user_id and rank.
Ties are broken by further columns so that results are repeatable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchlake.functions import fixed
from watchlake.operators.ranking import top_per_key


def _of_user(history: DataFrame, user_id: str | None) -> DataFrame:
    return history if user_id is None else history.where(F.col("user_id") == user_id)


def _first_rows(
    rows: DataFrame, order: list[Column], limit: int, user_id: str | None, columns: list[str]
) -> DataFrame:
    if user_id is not None:
        return rows.orderBy(*order).limit(limit).select(*columns)
    return top_per_key(rows, ["user_id"], order, limit).select("user_id", "rank", *columns)


def most_watched_channels(history: DataFrame, user_id: str | None = None) -> DataFrame:
    """Views per channel, the ten largest. Empty, unknown and NULL names are groups too."""
    counts = (
        _of_user(history, user_id)
        .groupBy("user_id", "channel_name")
        .agg(F.count(F.lit(1)).alias("watch_count"))
    )
    return first_channels(counts, user_id)


def first_channels(counts: DataFrame, user_id: str | None = None) -> DataFrame:
    """The ten largest of counts (user_id, channel_name, watch_count)."""
    counts = _of_user(counts, user_id)
    order = [F.desc("watch_count"), F.asc_nulls_last("channel_name")]
    return _first_rows(
        counts, order, fixed.TOP_CHANNELS, user_id, ["channel_name", "watch_count"]
    )


def total_videos(
    history: DataFrame, user_id: str | None = None, users: DataFrame | None = None
) -> DataFrame:
    """Number of views. The all-users form gives 0 for those in `users` without any."""
    if user_id is not None:
        return _of_user(history, user_id).agg(F.count(F.lit(1)).alias("total"))
    totals = history.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"))
    if users is None:
        return totals
    return (
        users.select("user_id")
        .distinct()
        .join(totals, "user_id", "left")
        .select("user_id", F.coalesce("total", F.lit(0).cast("bigint")).alias("total"))
    )


def recent_history(history: DataFrame, user_id: str | None = None) -> DataFrame:
    """The hundred newest views."""
    rows = _of_user(history, user_id).select(
        "user_id", "title", "channel_name", "watched_at", "video_id"
    )
    order = [
        F.desc("watched_at"),
        F.asc_nulls_last("title"),
        F.asc_nulls_last("video_id"),
        F.asc_nulls_last("channel_name"),
    ]
    return _first_rows(
        rows, order, fixed.RECENT_ROWS, user_id, ["title", "channel_name", "watched_at"]
    )


def daily_watch_count(history: DataFrame, user_id: str | None = None) -> DataFrame:
    """Views per UTC day, the thirty newest days with views."""
    counts = (
        _of_user(history, user_id)
        .groupBy("user_id", F.to_date("watched_at").alias("watch_date"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return first_days(counts, user_id)


def first_days(counts: DataFrame, user_id: str | None = None) -> DataFrame:
    """The thirty newest days of counts (user_id, watch_date, count)."""
    counts = _of_user(counts, user_id)
    return _first_rows(
        counts, [F.desc("watch_date")], fixed.RECENT_DAYS, user_id, ["watch_date", "count"]
    )


TEMPLATES = {
    "most_watched_channels": most_watched_channels,
    "total_videos": total_videos,
    "recent_history": recent_history,
    "daily_watch_count": daily_watch_count,
}

# The same queries as parameterised SQL text for a catalog table or view.
TEMPLATE_SQL = {
    "most_watched_channels": (
        "SELECT channel_name, count(*) AS watch_count FROM IDENTIFIER(:history) "
        "WHERE user_id = :user_id GROUP BY channel_name "
        f"ORDER BY watch_count DESC, channel_name NULLS LAST LIMIT {fixed.TOP_CHANNELS}"
    ),
    "total_videos": (
        "SELECT count(*) AS total FROM IDENTIFIER(:history) WHERE user_id = :user_id"
    ),
    "recent_history": (
        "SELECT title, channel_name, watched_at FROM IDENTIFIER(:history) "
        "WHERE user_id = :user_id ORDER BY watched_at DESC, title NULLS LAST, "
        f"video_id NULLS LAST, channel_name NULLS LAST LIMIT {fixed.RECENT_ROWS}"
    ),
    "daily_watch_count": (
        "SELECT to_date(watched_at) AS watch_date, count(*) AS count "
        "FROM IDENTIFIER(:history) WHERE user_id = :user_id "
        f"GROUP BY to_date(watched_at) ORDER BY watch_date DESC LIMIT {fixed.RECENT_DAYS}"
    ),
}


def run_template(spark: SparkSession, name: str, user_id: str, history: str) -> DataFrame:
    """Run a template by name on a table or view; unknown names run the fallback."""
    sql = TEMPLATE_SQL.get(name, TEMPLATE_SQL[fixed.FALLBACK_ROUTE])
    return spark.sql(sql, args={"user_id": user_id, "history": history})

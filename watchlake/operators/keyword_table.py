"""Routing by a table of keywords, of any size: substrings are joined with it, none is tested one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchlake.session import is_small

#: Longest keyword table that is broadcast, at no more than MAX_LENGTH characters a keyword.
BROADCAST_KEYWORDS = 200_000
MAX_LENGTH = 200
#: Beyond that, copies of the table a frequent substring is spread over.
SALTS = 16


def keyword_hits(
    texts: DataFrame, keywords: DataFrame, key: str, text: str, broadcast_limit: int = BROADCAST_KEYWORDS
) -> DataFrame:
    """(key, keyword, ...): each keyword that stands inside the lower-case text, once per row.

    `keywords` has `keyword` (as it must stand in the lower-case text; longer ones than MAX_LENGTH raise) and
    further columns. A text is cut into all substrings of the lengths that keywords have, of which there are few,
    and these are joined with the table by equality. A null text or keyword has no hits, nor has an empty keyword.
    """
    keywords = keywords.where(F.length("keyword") > 0)
    lengths = sorted(row[0] for row in keywords.select(F.length("keyword")).distinct().limit(MAX_LENGTH + 1).collect())
    if lengths and lengths[-1] > MAX_LENGTH:
        raise ValueError(f"a keyword has more than {MAX_LENGTH} characters")
    lowered = F.lower(F.col(text))
    starts = F.sequence(F.lit(1), F.length("_text") - F.col("_length") + 1)
    cut = (
        texts.where(F.col(text).isNotNull())
        .select(F.col(key).alias("_key"), lowered.alias("_text"))
        .select("*", F.explode(F.lit(lengths).cast("array<int>")).alias("_length"))
        .where(F.length("_text") >= F.col("_length"))
        .select("_key", "_text", "_length", F.explode(starts).alias("_at"))
        .select("_key", F.substring(F.col("_text"), F.col("_at"), F.col("_length")).alias("_part"))
    )
    if is_small(keywords, broadcast_limit):
        found = cut.join(F.broadcast(keywords), F.col("_part") == F.col("keyword"))
    else:
        # a substring that very many texts have goes to several tasks
        salted = keywords.withColumn("_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        cut = cut.distinct().withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(SALTS)).cast("int"))
        found = cut.join(salted, (F.col("_part") == F.col("keyword")) & (F.col("_salt") == F.col("_of"))).drop("_of")
    others = [name for name in keywords.columns if name != "keyword"]
    return found.select(F.col("_key").alias(key), "keyword", *others).distinct()


def route_by_table(
    texts: DataFrame, keywords: DataFrame, key: str, text: str, broadcast_limit: int = BROADCAST_KEYWORDS
) -> DataFrame:
    """`texts` with `route`: that of the first keyword by (turn, route) that the text holds, else null.

    `keywords`: keyword, route, turn. `key` tells the rows of `texts` apart.
    """
    hits = keyword_hits(texts, keywords.select("keyword", "route", "turn"), key, text, broadcast_limit)
    first = hits.groupBy(F.col(key).alias("_of")).agg(F.min(F.struct("turn", "route")).alias("_first"))
    joined = texts.join(first, F.col(key) == F.col("_of"), "left")
    return joined.select(*texts.columns, F.col("_first.route").alias("route"))

"""Questions: checks and routing to a query template or to the vector search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchlake.functions import fixed
from watchlake.functions.text import is_blank, unicode_trim


def route_of(question: Column, keywords=fixed.ROUTE_KEYWORDS) -> Column:
    """First route with a keyword inside the lower-case question; NULL means vector search."""
    lowered = F.lower(question)
    route = F.lit(None).cast("string")
    for name, words in reversed(keywords):
        found = F.lit(False)
        for word in words:
            found = found | lowered.contains(word)
        route = F.when(found, F.lit(name)).otherwise(route)
    return route


def source_of(route: Column) -> Column:
    return F.when(route.isNull(), fixed.SOURCE_VECTOR).otherwise(fixed.SOURCE_SQL)


def check_questions(questions: DataFrame) -> DataFrame:
    """Trim the question; blank ones get an `error` and are not routed."""
    blank = is_blank(F.col("question"))
    return questions.withColumn("error", F.when(blank, fixed.QUESTION_REQUIRED)).withColumn(
        "question", unicode_trim(F.col("question"))
    )


def route_questions(questions: DataFrame, keywords=fixed.ROUTE_KEYWORDS) -> DataFrame:
    """Accepted questions with `route` (NULL for vector search) and `source`."""
    accepted = check_questions(questions).where(F.col("error").isNull()).drop("error")
    routed = accepted.withColumn("route", route_of(F.col("question"), keywords))
    return routed.withColumn("source", source_of(F.col("route")))

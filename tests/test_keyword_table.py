"""Routing by a keyword table equals one `contains` per keyword."""

from __future__ import annotations

import random

import pytest

from watchlake.functions import fixed
from watchlake.operators.keyword_table import keyword_hits, route_by_table
from watchlake.operators.routing import route_questions


@pytest.mark.parametrize("limit", [200_000, 0])
def test_hits_equal_contains(spark, limit):
    rng = random.Random(5)
    words = {"".join(rng.choices("abé漢🙂 ", k=rng.randint(1, 5))) for _ in range(3000)}
    texts = ["".join(rng.choices("aBÉ漢🙂 ", k=rng.randint(0, 40))) for _ in range(150)] + [None, "", "a", "aaaa" * 30]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    keywords = [(w, f"r{len(w)}", rng.randint(0, 50)) for w in words] + [(None, "x", 0), ("", "y", 0)]
    table = spark.createDataFrame(keywords, "keyword string, route string, turn int")
    hits = keyword_hits(rows, table.select("keyword"), "id", "body", limit).collect()
    expected = {(i, w) for i, t in enumerate(texts) if t is not None for w in words if w in t.lower()}
    assert len(hits) == len(expected) and {tuple(h) for h in hits} == expected
    routed = {r["id"]: r["route"] for r in route_by_table(rows, table, "id", "body", limit).collect()}
    assert len(routed) == len(texts)
    for i, text in enumerate(texts):
        found = [(turn, route) for w, route, turn in keywords if w and text and w in text.lower()]
        assert routed[i] == (min(found)[1] if found else None)
    assert keyword_hits(rows.limit(0), table, "id", "body", limit).count() == 0
    assert keyword_hits(rows, table.limit(0), "id", "body", limit).count() == 0


def test_the_fixed_keywords_route_alike(spark):
    questions = ["Stop motion?", "日別の推移", "TREND", "最近見た動画", "何本見た", "料理の動画", "channel topic"]
    rows = spark.createDataFrame([(i, "u", q) for i, q in enumerate(questions)], "question_id int, user_id string, question string")
    table = [(w, name, turn) for turn, (name, words) in enumerate(fixed.ROUTE_KEYWORDS) for w in words]
    table = spark.createDataFrame(table, "keyword string, route string, turn int")
    expected = {r["question_id"]: r["route"] for r in route_questions(rows).collect()}
    assert {r["question_id"]: r["route"] for r in route_by_table(rows, table, "question_id", "question").collect()} == expected


def test_long_keywords_are_refused(spark):
    rows = spark.createDataFrame([(1, "a")], "id int, body string")
    with pytest.raises(ValueError):
        keyword_hits(rows, spark.createDataFrame([("x" * 201,)], "keyword string"), "id", "body")

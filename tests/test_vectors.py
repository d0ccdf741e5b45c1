from __future__ import annotations

import json
import math
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from watchlake.sources.embedding_store import hash_store
from watchlake.operators.documents import (
    read_document_files,
    read_documents,
    vector_documents,
    write_documents,
)
from watchlake.operators.embedding import (
    HashEmbedder,
    ModelEmbedder,
    build_vectors,
    embed_texts,
)
from watchlake.plans.answers import search_text
from watchlake.operators.sampling import sample_order, sample_per_user
from watchlake.operators import search as search_module
from watchlake.operators.search import _search_cells, search, search_ranked
from watchlake.sources.tables import VECTOR_SCHEMA, has_vectors, read_vectors, read_whole_users, write_vectors

VECTORS = "user_id string, idx int, embedding array<float>"
QUESTIONS = "question_id long, user_id string, embedding array<float>"


def cosine(left, right):
    if len(left) != len(right):
        return 0.0
    dot = sum(a * b for a, b in zip(left, right))
    norms = math.sqrt(sum(a * a for a in left)) * math.sqrt(sum(b * b for b in right))
    return dot / norms if norms else 0.0


def brute_force(vectors, questions, k):
    found = set()
    for question_id, user, query in questions:
        own = [(idx, cosine(query, vector)) for u, idx, vector in vectors if u == user]
        own.sort(key=lambda hit: (-round(hit[1], 9), hit[0]))
        for rank, (idx, score) in enumerate(own[:k], 1):
            found.add((question_id, user, rank, idx, round(score, 4) + 0.0))
    return found


def as_float32(values):
    return [float(np.float32(v)) for v in values]


def fixture_rows(seed=1):
    """One user with most vectors and one with most questions, ties, zero and odd vectors."""
    rnd = random.Random(seed)
    vector = lambda n=6: as_float32(rnd.uniform(-1, 1) for _ in range(n))
    vectors = []
    for user, count in {"hot": 300, "b": 25, "c": 3, "silent": 10}.items():
        shared = vector()
        for idx in range(count):
            kind = idx % 10
            value = shared if kind in (3, 4) else [0.0] * 6 if kind == 5 else vector()
            vectors.append((user, idx, vector(4) if kind == 6 else value))
    questions = [(100 + i, "b", vector()) for i in range(40)]
    questions += [(i, u, vector()) for i, u in enumerate(["hot", "c", "nobody", "hot"])]
    questions.append((50, "hot", [0.0] * 6))
    questions.append((51, "hot", next(v for u, i, v in vectors if u == "hot" and i == 3)))
    return vectors, questions


@pytest.mark.parametrize("k", [1, 5, 1000])
@pytest.mark.parametrize(
    "settings",
    [
        {},
        {"broadcast_limit": 0},
        {"broadcast_limit": 0, "vectors_per_block": 16, "questions_per_block": 4},
    ],
    ids=["broadcast", "cells", "small cells"],
)
def test_search_equals_brute_force(spark, settings, k):
    vectors, questions = fixture_rows()
    hits = search_ranked(
        spark.createDataFrame(vectors, VECTORS).repartition(5),
        spark.createDataFrame(questions, QUESTIONS),
        k,
        **settings,
    ).collect()
    found = {
        (h["question_id"], h["user_id"], h["rank"], h["idx"], round(h["score"], 4) + 0.0)
        for h in hits
    }
    assert len(found) == len(hits)
    assert found == brute_force(vectors, questions, k)


def test_zero_query_takes_the_first_positions(spark):
    vectors, _ = fixture_rows()
    hits = search_ranked(
        spark.createDataFrame(vectors, VECTORS),
        spark.createDataFrame([(1, "hot", [0.0] * 6)], QUESTIONS),
        4,
    )
    rows = hits.orderBy("rank").collect()
    assert [(r["rank"], r["idx"], r["score"]) for r in rows] == [
        (i + 1, i, 0.0) for i in range(4)
    ]


@pytest.mark.parametrize("limit", [100, 0])
def test_vectors_with_nan_do_not_hide_others(spark, limit):
    nan = float("nan")
    vectors = [("u", i, [nan, 1.0] if i % 2 else [1.0, float(i)]) for i in range(20)]
    hits = search_ranked(
        spark.createDataFrame(vectors, VECTORS),
        spark.createDataFrame([(1, "u", [1.0, 0.0])], QUESTIONS),
        3,
        broadcast_limit=limit,
    )
    assert [r["idx"] for r in hits.orderBy("rank").collect()] == [0, 2, 4]


def test_search_without_questions_or_vectors(spark):
    vectors, questions = fixture_rows()
    some = spark.createDataFrame(vectors, VECTORS)
    none = spark.createDataFrame([], QUESTIONS)
    assert search_ranked(some, none, 3).isEmpty()
    empty = spark.createDataFrame([], VECTORS)
    asked = spark.createDataFrame(questions, QUESTIONS)
    assert search_ranked(empty, asked, 3).isEmpty()
    assert search_ranked(empty, asked, 3, broadcast_limit=0).isEmpty()


def test_search_keeps_metadata(spark):
    vectors, questions = fixture_rows()
    df = spark.createDataFrame(vectors, VECTORS).select(
        "*",
        F.concat("user_id", "idx").alias("text"),
        F.lit("never null").alias("fixed"),
        F.timestamp_seconds("idx").alias("at"),
    )
    asked = spark.createDataFrame(questions, QUESTIONS)
    few = search(df, asked, 2).collect()
    assert all(r["text"] == f"{r['user_id']}{r['idx']}" for r in few)
    assert all(r["at"].second == r["idx"] % 60 and r["fixed"] == "never null" for r in few)
    many = search_ranked(df, asked, 2, broadcast_limit=0).withColumn("score", F.round("score", 4))
    order = ["question_id", "rank"]
    assert few and many.orderBy(*order).collect() == sorted(few, key=lambda r: (r[0], r[2]))


def test_candidates_of_cells_do_not_grow_with_the_blocks(spark):
    rnd = random.Random(5)
    rows = [("u", i, as_float32(rnd.uniform(-1, 1) for _ in range(4))) for i in range(1500)]
    vectors = spark.createDataFrame(rows, VECTORS)
    asked = vectors.select(F.col("idx").cast("long").alias("question_id"), "user_id", "embedding")
    found = _search_cells(vectors, asked, 5, vectors_per_block=32, questions_per_block=16)
    per_question = found.groupBy("question_id").count()
    assert per_question.count() == 1500
    assert per_question.where("count > 5").isEmpty()


def test_users_cut_into_cells_on_both_sides(spark, monkeypatch):
    monkeypatch.setattr(search_module, "LEAST_PAIRS", 1)
    monkeypatch.setattr(search_module, "VECTORS_PER_CELL", 20)
    monkeypatch.setattr(search_module, "QUESTIONS_PER_CELL", 7)
    vectors, questions = fixture_rows(7)
    hits = search_ranked(
        spark.createDataFrame(vectors, VECTORS), spark.createDataFrame(questions, QUESTIONS), 5, broadcast_limit=0
    )
    found = {(h["question_id"], h["user_id"], h["rank"], h["idx"], round(h["score"], 4) + 0.0) for h in hits.collect()}
    assert found == brute_force(vectors, questions, 5)


def history(spark, sizes):
    rows = [(u, i, f"title {i % 7}", f"ch {i % 3}", "v") for u, n in sizes.items() for i in range(n)]
    random.Random(3).shuffle(rows)
    schema = "user_id string, src_pos int, title string, channel_name string, video_id string"
    df = spark.createDataFrame(rows, schema).repartition(6)
    return df.withColumn("watched_at", F.timestamp_seconds("src_pos"))


@pytest.mark.parametrize("limit", [50, 2000])
def test_sample_is_exact(spark, limit):
    """The larger limit takes the salted way of ranking."""
    sizes = {"small": 40, "equal": limit, "hot": 5000}
    sample = sample_per_user(history(spark, sizes).select("user_id", "src_pos"), "src_pos", limit)
    found = {}
    for row in sample.collect():
        found.setdefault(row["user_id"], []).append((row["idx"], row["src_pos"]))
    for user, size in sizes.items():
        kept = [position for _, position in sorted(found[user])]
        assert [idx for idx, _ in sorted(found[user])] == list(range(min(size, limit)))
        if size <= limit:
            assert kept == list(range(size))
    digests = spark.range(5000).select("id", sample_order(F.col("id")).alias("d")).collect()
    expected = sorted((r["d"], r["id"]) for r in digests)[:limit]
    assert [p for _, p in sorted(found["hot"])] == [position for _, position in expected]


def test_failed_texts_get_zero_vectors(spark):
    def load():
        def model(texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("model failed")
            return [[float(len(t)), 1.0] for t in texts]

        return model

    texts = [(0, "ab"), (1, "bad"), (2, " "), (3, None), (4, "abc")]
    df = spark.createDataFrame(texts, "i int, t string")
    embedded = embed_texts(df.repartition(1), "t", ModelEmbedder(load, dim=2)).orderBy("i")
    rows = embedded.collect()
    assert [r["embedding"] for r in rows] == [[2, 1], [0, 0], [0, 0], [0, 0], [3, 1]]
    assert [r["embed_failed"] for r in rows] == [False, True, False, False, False]


def test_texts_are_cut_before_the_model(spark):
    model = ModelEmbedder(lambda: lambda texts: [[float(len(t))] for t in texts], dim=1)
    df = spark.createDataFrame([("x" * 9000,)], "t string")
    assert embed_texts(df, "t", model).first()["embedding"] == [9000.0]
    assert embed_texts(df, "t", model, cut_text=True).first()["embedding"] == [8000.0]


def test_vector_table_round_trip(spark, tmp_path):
    path = str(tmp_path / "vectors")
    built = build_vectors(history(spark, {"u1": 30, "u2": 5}), HashEmbedder(32), max_rows=20)
    assert built.schema.names == VECTOR_SCHEMA.names
    write_vectors(built, path)
    stored = read_vectors(spark, path)
    assert {r["user_id"]: r["count"] for r in stored.groupBy("user_id").count().collect()} == {
        "u1": 20,
        "u2": 5,
    }
    # Replacing one user leaves the other.
    write_vectors(build_vectors(history(spark, {"u2": 2}), HashEmbedder(32)), path)
    spark.catalog.refreshByPath(path)
    stored = read_vectors(spark, path)
    assert stored.where("user_id = 'u1'").count() == 20
    assert stored.where("user_id = 'u2'").count() == 2
    assert has_vectors(stored, "u1") and not has_vectors(stored, "u3")
    row = stored.where("user_id = 'u2' AND idx = 1").first()
    assert row["text"] == "title 1 - ch 1" and len(row["embedding"]) == 32


@pytest.mark.parametrize("per_document, parts", [(4000, 1), (8, 4)])
def test_documents(spark, per_document, parts):
    vectors = build_vectors(history(spark, {"u1": 30}), HashEmbedder(4))
    documents = vector_documents(vectors, 4, per_document)
    assert documents.count() == parts
    first = json.loads(documents.where("part = 0").first()["document"])
    assert list(first) == ["user_id", "count", "dimension", "first", "vectors", "texts", "metadata"]
    assert first["count"] == len(first["vectors"]) == min(30, per_document)
    assert first["metadata"][1] == {
        "title": "title 1",
        "channel_name": "ch 1",
        "video_id": "v",
        "watched_at": "1970-01-01 00:00:01+00:00",
    }
    columns = ["idx", "text", "title", "channel_name", "video_id", "watched_at", "embedding"]
    back = read_documents(documents).select(*columns).orderBy("idx").collect()
    assert back == vectors.select(*columns).orderBy("idx").collect()


def test_document_files(spark, tmp_path):
    vectors = build_vectors(history(spark, {"u1": 30, "007": 2}), HashEmbedder(4))
    write_documents(vector_documents(vectors, 4), str(tmp_path / "vectors"))
    # The layout with one file per user is read as well.
    single = tmp_path / "vectors" / "u9" / "embeddings.json"
    single.parent.mkdir()
    document = {
        "user_id": "u9",
        "count": 1,
        "dimension": 2,
        "vectors": [[0.5, 1.0]],
        "texts": ["t - c"],
        "metadata": [
            {
                "title": "t",
                "channel_name": None,
                "video_id": "v",
                "watched_at": "2025-12-27 10:26:59.596000+00:00",
            }
        ],
    }
    single.write_text(json.dumps(document, ensure_ascii=False))
    rows = read_documents(read_document_files(spark, str(tmp_path / "vectors")))
    counts = {r["user_id"]: r["count"] for r in rows.groupBy("user_id").count().collect()}
    assert counts == {"u1": 30, "007": 2, "u9": 1}
    row = rows.where("user_id = 'u9'").first()
    assert row["embedding"] == [0.5, 1.0] and row["channel_name"] is None
    assert row["watched_at"] == datetime(2025, 12, 27, 10, 26, 59, 596000)


def test_search_one_text(spark):
    vectors = build_vectors(history(spark, {"u1": 30, "u2": 30}), HashEmbedder(64))
    rows = search_text("title 3", "u1", vectors, HashEmbedder(64), 4).collect()
    assert [r["rank"] for r in rows] == [1, 2, 3, 4]
    assert {r["user_id"] for r in rows} == {"u1"}
    assert {r["title"] for r in rows} == {"title 3"}
    assert rows[0]["score"] >= rows[1]["score"] >= rows[2]["score"]
    assert search_text("title 3", "nobody", vectors, HashEmbedder(64)).isEmpty()


def test_documents_keep_positions_through_files(spark, tmp_path):
    vectors = build_vectors(history(spark, {"u1": 30}), HashEmbedder(4))
    write_documents(vector_documents(vectors, 4, 7), str(tmp_path / "documents"))
    back = read_documents(read_document_files(spark, str(tmp_path / "documents")))
    assert sorted(r["idx"] for r in back.collect()) == list(range(30))


def test_users_are_never_read_in_part(spark, tmp_path):
    path = tmp_path / "vectors"
    built = build_vectors(history(spark, {"u1": 40, "u 2": 3}), HashEmbedder(8))
    built.repartition(2).write.partitionBy("user_id").parquet(str(path))
    broken = next((path / "user_id=u1").glob("*.parquet"))
    broken.write_bytes(b"broken")
    for checksum in (path / "user_id=u1").glob(".*.crc"):
        checksum.unlink()
    whole = read_whole_users(spark, str(path))
    assert {r["user_id"] for r in whole.collect()} == {"u 2"} and whole.count() == 3
    with pytest.raises(Exception, match="(?i)parquet"):
        read_vectors(spark, str(path)).select("embedding").collect()


def test_unreadable_vectors_count_as_none(spark, tmp_path):
    path = tmp_path / "vectors"
    write_vectors(build_vectors(history(spark, {"u1": 3, "u2": 3}), HashEmbedder(8)), str(path))
    for file in (path / "user_id=u2").glob("*.parquet"):
        file.write_bytes(b"broken")
    for checksum in (path / "user_id=u2").glob(".*.crc"):
        checksum.unlink()
    stored = read_whole_users(spark, str(path))
    assert [r["user_id"] for r in stored.select("user_id").distinct().collect()] == ["u1"]
    assert search_text("title 1", "u2", stored, HashEmbedder(8)).isEmpty()
    assert search_text("title 1", "u1", stored, HashEmbedder(8)).count() == 3


def test_vectors_of_asking_users_only(spark, tmp_path):
    """By name or by the whole list: the same rows; folders of others are not even listed by name."""
    path = tmp_path / "vectors"
    names = {"u1": 3, "u 2": 4, "a/b": 2, "x{1}[2]*": 2, "u%3": 1, "other": 5}
    write_vectors(build_vectors(history(spark, names), HashEmbedder(8)), str(path))
    broken = next((path / "user_id=u1").glob("*.parquet"))
    broken.write_bytes(b"broken")
    for checksum in (path / "user_id=u1").glob(".*.crc"):
        checksum.unlink()
    asked = [(u,) for u in ("u1", "u 2", "a/b", "x{1}[2]*", "u%3", "nobody", "", None, "u 2")]
    users = spark.createDataFrame(asked, "user_id string")
    for named in (1, 100):
        found = read_whole_users(spark, str(path), users, named)
        counts = {r["user_id"]: r["count"] for r in found.groupBy("user_id").count().collect()}
        assert counts == {"u 2": 4, "a/b": 2, "x{1}[2]*": 2, "u%3": 1}
        assert found.columns == read_vectors(spark, str(path)).columns
    by_name = read_whole_users(spark, str(path), users)
    assert not any("user_id=other" in file for file in by_name.inputFiles())
    nobody = spark.createDataFrame([("nobody",), (None,)], "user_id string")
    assert read_whole_users(spark, str(path), nobody).isEmpty()
    assert read_whole_users(spark, str(path), nobody.limit(0)).isEmpty()
    assert read_whole_users(spark, str(tmp_path / "none"), users).isEmpty()


def test_new_texts_are_embedded_by_many_tasks(spark, tmp_path):
    """Short texts, which AQE would merge into one task by their bytes."""
    store = hash_store(str(tmp_path / "s"), dim=16)
    texts = spark.range(4_000).select(F.concat(F.lit("clip "), F.col("id").cast("string")).alias("text"))
    assert store.add(texts.union(texts), "text", "0") == 4_000
    files = spark.read.parquet(str(tmp_path / "s")).groupBy(F.input_file_name()).count().collect()
    assert len(files) >= 8 and max(r["count"] for r in files) < 1_000

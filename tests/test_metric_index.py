"""The metric index gives the hits of the exact search, and reads less where vectors lie in clusters."""

from __future__ import annotations

import numpy as np
import pytest

from watchlake.operators.metric_index import search_index, write_index
from watchlake.operators.search import search_ranked


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def clustered(rng, count, clusters, dim=16, spread=0.05):
    centres = rng.normal(size=(clusters, dim))
    rows = centres[rng.integers(0, clusters, count)]
    rows = rows / np.linalg.norm(rows, axis=1)[:, None] + spread * rng.normal(size=(count, dim)) / np.sqrt(dim)
    return (rows * rng.uniform(0.1, 5, size=(count, 1))).astype("f4")


def table(spark, vectors, users):
    rows = [(users[i % len(users)], i // len(users), None if v is None else [float(x) for x in v], f"m{i}") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "user_id string, idx int, embedding array<float>, note string")


ODD = [None, [], [0.0] * 16, [1.0] * 3, [float("nan")] * 16, [1e-40] * 16, [1e30] * 16]


@pytest.mark.parametrize("spread, most", [(0.05, 0.35), (50.0, 1.0)])
def test_hits_equal_the_exact_search(spark, tmp_path, spread, most):
    rng = np.random.default_rng(3)
    known = clustered(rng, 4000, 20, spread=spread)
    # equal vectors, so that ties at the cut go by position
    vectors = table(spark, [*known, *[known[i % 7] for i in range(60)]], ["a", "a", "a", "b"]).repartition(6)
    vectors = vectors.withColumn("idx", vectors["idx"].cast("int"))
    vectors = vectors.dropDuplicates(["user_id", "idx"])
    asked = [(i, ["a", "b", "nobody"][i % 3], [float(x) for x in known[i * 5]]) for i in range(30)]
    asked += [(100 + i, "ab"[i % 2], v) for i, v in enumerate(ODD)]
    questions = spark.createDataFrame(asked, "question_id long, user_id string, embedding array<float>")
    write_index(vectors, str(tmp_path / "i"), pivots=32, block_rows=16)
    found = search_index(spark, str(tmp_path / "i"), questions, 5, questions_per_block=4)
    assert rows_of(found.hits) == rows_of(search_ranked(vectors, questions, 5))
    usual = found.cells.where("question_id < 100")
    read, every = usual.where("read").count(), usual.count()
    assert read <= most * every
    assert 0 < found.share_read() <= 1


def test_odd_vectors(spark, tmp_path):
    rng = np.random.default_rng(4)
    vectors = table(spark, [*clustered(rng, 40, 3), *ODD, *ODD], ["a"])
    questions = spark.createDataFrame([(i, "a", v) for i, v in enumerate([*ODD, [1.0] * 16])], "question_id long, user_id string, embedding array<float>")
    write_index(vectors, str(tmp_path / "i"), pivots=4, block_rows=8)
    found = search_index(spark, str(tmp_path / "i"), questions, 30).hits
    assert rows_of(found) == rows_of(search_ranked(vectors, questions, 30))
    write_index(vectors.limit(0), str(tmp_path / "none"))
    assert search_index(spark, str(tmp_path / "none"), questions).hits.count() == 0
    with pytest.raises(ValueError):
        write_index(vectors, str(tmp_path / "x"), block_rows=12)


def test_folders_without_a_wanted_block_are_not_opened(spark, tmp_path):
    from watchlake.operators import metric_index

    rng = np.random.default_rng(5)
    vectors = table(spark, clustered(rng, 3000, 12), ["a"])
    write_index(vectors, str(tmp_path / "i"), pivots=12, block_rows=64)
    stored = metric_index.stored_vectors(spark, str(tmp_path / "i"))
    one = spark.read.parquet(str(tmp_path / "i/blocks")).limit(1).selectExpr("0L AS question_id", *metric_index._BLOCK)
    questions = spark.createDataFrame([(0, "a", [1.0] * 16)], "question_id long, user_id string, embedding array<float>")
    found = metric_index._scored(stored, questions, one, 5, 512)
    part = one.first()["part"]
    assert "PartitionFilters: [" in (plan := found._jdf.queryExecution().toString())
    assert f"IN ({part})" in plan or f"= {part})" in plan
    assert found.count() == 5

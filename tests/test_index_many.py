"""The metric index without a row per question and block."""

from __future__ import annotations

import numpy as np
import pytest

from watchlake.operators import metric_index
from watchlake.operators.metric_index import search_index, write_index
from watchlake.operators.search import search_ranked

from test_metric_index import ODD, clustered, rows_of, table


@pytest.mark.parametrize("spread, broadcast", [(0.05, 200_000), (50.0, 200_000), (0.05, 0)])
def test_many_questions_have_the_same_hits(spark, tmp_path, monkeypatch, spread, broadcast):
    monkeypatch.setattr(metric_index, "BROADCAST_BLOCKS", broadcast)
    rng = np.random.default_rng(6)
    known = clustered(rng, 2000, 12, spread=spread)
    vectors = table(spark, [*known, *[known[i % 7] for i in range(60)], *ODD], ["a", "b"]).repartition(6)
    asked = [(i, ["a", "b", "nobody"][i % 3], [float(x) for x in known[i * 5]]) for i in range(60)]
    asked += [(100 + i, "ab"[i % 2], v) for i, v in enumerate(ODD)]
    questions = spark.createDataFrame(asked, "question_id long, user_id string, embedding array<float>")
    write_index(vectors, str(tmp_path / "i"), pivots=32, block_rows=16)
    found = search_index(spark, str(tmp_path / "i"), questions, 5, questions_per_block=4, row_cells=0)
    assert rows_of(found.hits) == rows_of(search_ranked(vectors, questions, 5))
    assert 0 < found.share_read() <= 1


def test_no_row_per_question_and_block(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(7)
    vectors = table(spark, clustered(rng, 3000, 12), ["a"])
    write_index(vectors, str(tmp_path / "i"), pivots=12, block_rows=16)
    stored = []
    cut = metric_index.cut_lineage
    monkeypatch.setattr(metric_index, "cut_lineage", lambda df: stored.append(cut(df)) or stored[-1])
    questions = vectors.selectExpr("CAST(idx AS LONG) AS question_id", "user_id", "embedding")
    assert search_index(spark, str(tmp_path / "i"), questions, 5).hits.count() == 15_000
    # 3,000 questions and some 190 blocks
    assert max(df.count() for df in stored) < 30_000

"""Work of the workload's steps grows with the rows, not with how files are cut."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq

from pyspark.sql import functions as F

from conftest import SF_SMALL

from watchlake import session
from watchlake.functions.vectors import feature_codes, hash_embedding
from watchlake.operators.embedding import HashEmbedder, embed_texts
from watchlake.workload import mapping


def test_one_row_group_becomes_tasks_by_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 100)
    n = 2_000
    events = {
        "event_id": pa.array(range(n), pa.int64()),
        "user_id": pa.array([i % 7 for i in range(n)], pa.int64()),
        "event_type": pa.array(["view"] * n),
        "ts": pa.array([0] * n, pa.timestamp("us")),
    }
    pq.write_table(pa.table(events), tmp_path / "events.parquet", row_group_size=n)
    sizes = mapping.raw_fields(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 20
    assert max(row["count"] for row in sizes) < 200


def test_embedding_has_the_feature_codes(spark):
    texts = [None, "", "  ", "a b", "ab abc abcd", "Ünï 漢字かな交じり文-12", "x" * 300, "𝒳𝒴𝒵 ½ Ⅷ İstanbul ΣΑΣ"]
    texts += [f"word{i} clip {i * 7} – チャンネル{i % 17}" for i in range(200)]
    rows = spark.createDataFrame([(text,) for text in texts], "text string")
    for dim in (4, 64):
        found = rows.select(feature_codes(F.col("text"), dim).alias("codes"), hash_embedding(F.col("text"), dim).alias("vector"))
        for codes, vector in found.collect():
            if codes is None:
                assert vector is None
                continue
            expected = [0.0] * dim
            for code in codes:
                expected[code >> 1] = (1 if code % 2 else -1) / len(codes) ** 0.5
            assert max(abs(a - b) for a, b in zip(vector, expected, strict=True)) < 1e-6


def test_embedder_that_cannot_fail_runs_once(spark):
    rows = spark.createDataFrame([("a b",), (" ",)], "text string")
    made = embed_texts(rows, "text", HashEmbedder(8)).where(~F.col("embed_failed"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert made.count() == 2


def test_history_of_asked_users_is_cut_before_it_is_parsed(spark):
    asked = spark.createDataFrame([("7",), ("8",), ("none",)], "user_id string")
    every = mapping.history(spark, SF_SMALL)
    own = mapping.history(spark, SF_SMALL, of=asked)
    expected = sorted(every.where("user_id in ('7', '8')").collect())
    assert expected and sorted(own.collect()) == expected

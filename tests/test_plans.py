"""Checks of physical plans and of behaviour when one key holds most rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from watchlake.operators.clean import ingest_stats, parse_records, valid_rows
from watchlake.operators.embedding import HashEmbedder, build_vectors
from watchlake.operators.ranking import top_per_key
from watchlake.operators.search import search_ranked
from watchlake.plans import templates
from watchlake.plans.ingest import read_records
from watchlake.sources.tables import (
    HISTORY_SCHEMA,
    read_vectors,
    write_history,
    write_vectors,
)

from conftest import SF_SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A stored history in which one user holds nine of ten rows."""
    path = str(tmp_path_factory.mktemp("plans") / "history")
    n = F.col("id")
    rows = spark.range(20_000).select(
        F.concat(F.lit("title "), n.cast("string")).alias("title"),
        F.lit("v").alias("video_id"),
        F.concat(F.lit("ch "), (n % 700).cast("string")).alias("channel_name"),
        F.lit("c").alias("channel_id"),
        F.timestamp_seconds(n * 600).alias("watched_at"),
        n.cast("int").alias("src_pos"),
        F.when(n % 10 < 9, "hot").otherwise(F.concat(F.lit("u"), n % 50)).alias("user_id"),
    )
    write_history(rows, path)
    return spark.read.schema(HISTORY_SCHEMA).parquet(path)


def test_single_user_plans(stored):
    channels = plan(templates.most_watched_channels(stored, "hot"))
    assert "TakeOrderedAndProject" in channels
    assert "PartitionFilters: [isnotnull(user_id" in channels
    assert "ReadSchema: struct<channel_name:string>" in channels
    assert "partial_count" in channels
    recent = plan(templates.recent_history(stored, "hot"))
    assert "TakeOrderedAndProject" in recent
    total = plan(templates.total_videos(stored, "hot"))
    assert "ReadSchema: struct<>" in total


@pytest.mark.parametrize(
    "name", ["most_watched_channels", "recent_history", "daily_watch_count"]
)
def test_all_user_plans_limit_before_the_shuffle(stored, name):
    text = plan(templates.TEMPLATES[name](stored))
    assert text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_totals_and_statistics_aggregate_before_the_shuffle(spark, stored):
    assert "partial_count" in plan(templates.total_videos(stored))
    parsed = stored.withColumn("outcome", F.lit("valid"))
    text = plan(ingest_stats(parsed))
    # The distinct count goes over (user, channel) first, so no task holds a whole user.
    assert "hashpartitioning(user_id" in text and "partial_" in text
    assert text.count("Exchange hashpartitioning") >= 1


def test_records_are_parsed_once(spark):
    records = spark.createDataFrame([("u", 0, "{}")], "user_id string, src_pos int, json string")
    parsed = parse_records(records.select("user_id", "src_pos", F.try_parse_json("json").alias("rec")))
    text = plan(valid_rows(parsed).where("user_id = 'u'").groupBy("user_id").count())
    assert text.count("Generate") == 1
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_default_embedding_needs_no_python_and_shuffles_no_vectors(stored):
    text = plan(build_vectors(stored, max_rows=4000))
    assert "Python" not in text
    above, below = text.split("Exchange", 1)
    assert "md5" in above.split("row_number")[0] and "array_repeat" not in below


def test_ingest_writes_rows_where_they_were_parsed(spark, tmp_path):
    path = tmp_path / "raw" / "u" / "a.json"
    path.parent.mkdir(parents=True)
    path.write_text('[{"title": "x", "time": "2025-01-01"}]')
    rows = valid_rows(read_records(spark, str(tmp_path)))
    assert "Exchange hashpartitioning" not in plan(rows).split("BroadcastExchange")[0]


def test_salted_ranking_spreads_the_hot_user(stored):
    big = top_per_key(stored, ["user_id"], [F.col("src_pos")], 4001)
    text = plan(big)
    assert "_salt" in text and "hashpartitioning(user_id" in text
    assert big.where("user_id = 'hot'").count() == 4001


def test_few_questions_leave_the_vectors_in_place(spark):
    vectors = spark.range(1000).select(
        F.concat(F.lit("u"), F.col("id") % 2).alias("user_id"),
        F.col("id").alias("idx"),
        F.array(F.rand(), F.rand()).cast("array<float>").alias("embedding"),
    )
    asked = vectors.where("idx < 3").withColumnRenamed("idx", "question_id")
    text = plan(search_ranked(vectors, asked, 5))
    before = text[text.index("MapInArrow"):]
    # Vectors are filtered and scored where they are read.
    assert "Exchange" not in before and "Join" not in text and "CartesianProduct" not in text
    # Candidates are cut to k per question before they are exchanged.
    assert text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_search_reads_only_partitions_of_asking_users(spark, stored, tmp_path):
    write_vectors(build_vectors(stored, HashEmbedder(8)), str(tmp_path / "vectors"))
    vectors = read_vectors(spark, str(tmp_path / "vectors"))
    asked = vectors.where("user_id = 'u9' AND idx < 2").withColumnRenamed("idx", "question_id")
    hits = search_ranked(vectors, asked, 5)
    assert "PartitionFilters: [(user_id" in plan(hits) or "PartitionFilters: [isnotnull(user_id" in plan(hits)
    assert hits.count() == 10


def test_hot_user_is_written_by_several_tasks(spark, stored, tmp_path, monkeypatch):
    from watchlake.sources import tables

    monkeypatch.setattr(tables, "HISTORY_ROWS_PER_FILE", 2_000)
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        write_history(stored, str(tmp_path / "history"))
    finally:
        spark.conf.set(coalesce, "true")
    files = list((tmp_path / "history" / "user_id=hot").glob("*.parquet"))
    assert len(files) > 1
    again = spark.read.schema(HISTORY_SCHEMA).parquet(str(tmp_path / "history"))
    assert again.where("user_id = 'hot'").count() == 18_000


def test_smallest_tables_run_everywhere(spark):
    import __spark_entry__ as entry

    for name, query in entry.queries().items():
        assert query(spark, SF_SMALL).columns, name
    assert entry.entry(spark).count() > 0


def test_many_small_users_are_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(80).select(
        F.concat(F.lit("u"), "id").alias("user_id"), F.col("id").cast("int").alias("src_pos"), F.lit("t").alias("title"),
        F.lit("c").alias("channel_name"), F.lit("i").alias("channel_id"), F.lit("v").alias("video_id"),
        F.timestamp_seconds("id").alias("watched_at"),
    )
    write_history(rows, str(tmp_path / "history"))
    write_vectors(build_vectors(rows, HashEmbedder(8)), str(tmp_path / "vectors"), clustered=True)
    for name in ("history", "vectors"):
        tasks = {path.name[:10] for path in (tmp_path / name).glob("user_id=*/part-*.parquet")}
        assert len(tasks) > 4, name

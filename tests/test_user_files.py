"""Folders of users that tasks write and read by themselves."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from watchlake.operators.embedding import HashEmbedder, build_vectors
from watchlake.session import few_listing_tasks
from watchlake.sources.tables import (
    HISTORY_SCHEMA,
    VECTOR_SCHEMA,
    read_history,
    read_vectors,
    read_whole_users,
    write_history,
    write_vectors,
)
from watchlake.sources.user_files import folder_name, replace_users, user_of_folder
from watchlake.sources import raw_files
from watchlake.streaming import question_stream

USERS = ["a", "b c", "x=1%2F/ä漢", "[y]{z}*?", "", None]


@pytest.fixture
def rows(spark):
    made = [
        (f"t{i}", None if i % 3 else "v", f"c{i % 2}", "", i, USERS[i % len(USERS)]) for i in range(60)
    ]
    df = spark.createDataFrame(made, "title string, video_id string, channel_name string, channel_id string, src_pos int, user_id string")
    # times before 1582 and after 2262 as well
    at = F.timestamp_seconds(F.lit(-3e10) + F.col("src_pos") * F.lit(1e9) + F.lit(0.123456))
    return df.withColumn("watched_at", at).select(*HISTORY_SCHEMA.names)


def all_rows(df):
    return sorted(map(str, df.select(*HISTORY_SCHEMA.names).collect()))


def test_files_by_tasks_hold_what_sparks_writer_writes(spark, tmp_path, rows):
    write_history(rows, f"{tmp_path}/own")
    rows.write.partitionBy("user_id").parquet(f"{tmp_path}/spark")
    folders = {name for name in os.listdir(tmp_path / "spark") if name.startswith("user_id=")}
    assert set(os.listdir(tmp_path / "own")) == folders
    expected = all_rows(read_history(spark, f"{tmp_path}/spark"))
    assert len(expected) == 60
    assert all_rows(read_history(spark, f"{tmp_path}/own")) == expected
    # files of either writer by either reader
    for name in ("own", "spark"):
        assert all_rows(read_history(spark, f"{tmp_path}/{name}", whole=True)) == expected
        assert all_rows(read_history(spark, f"file://{tmp_path}/{name}/", whole=True)) == expected


def test_users_are_replaced_one_by_one(spark, tmp_path, rows):
    path = f"{tmp_path}/table"
    write_history(rows, path)
    later = rows.where("user_id = 'a' AND src_pos > 30").withColumn("title", F.lit("new"))
    write_history(later, path)
    expected = all_rows(rows.where("user_id <> 'a' OR user_id IS NULL").union(later).withColumn(
        "user_id", F.when(F.col("user_id") != "", F.col("user_id"))
    ))
    assert all_rows(read_history(spark, path)) == expected
    assert all_rows(read_history(spark, path, whole=True)) == expected
    assert len(os.listdir(f"{path}/user_id=a")) == 1
    write_history(rows.where("false"), path)
    assert all_rows(read_history(spark, path)) == expected


def test_a_write_that_fails_changes_nothing(spark, tmp_path, rows):
    path = f"{tmp_path}/table"
    write_history(rows, path)
    before = all_rows(read_history(spark, path))
    bad = rows.withColumn("title", F.when(F.col("src_pos") == 59, F.raise_error(F.lit("bad row"))).otherwise("new"))
    with pytest.raises(Exception, match="bad row"):
        write_history(bad, path)
    assert all_rows(read_history(spark, path)) == before
    assert not [name for name in os.listdir(path) if name.startswith(".")]


def test_a_user_in_several_tasks_keeps_all_rows(spark, tmp_path, rows):
    replace_users(rows.repartition(7), f"{tmp_path}/table")
    expected = all_rows(rows.withColumn("user_id", F.when(F.col("user_id") != "", F.col("user_id"))))
    assert all_rows(read_history(spark, f"{tmp_path}/table")) == expected
    assert all_rows(read_history(spark, f"{tmp_path}/table", whole=True)) == expected


def test_only_wanted_users_are_read(spark, tmp_path, rows):
    path = f"{tmp_path}/table"
    write_history(rows, path)
    with open(f"{path}/user_id=b c/{os.listdir(f'{path}/user_id=b c')[0]}", "wb") as broken:
        broken.write(b"broken")
    users = spark.createDataFrame([("a",), ("nobody",), ("[y]{z}*?",)], "user_id string")
    assert all_rows(read_history(spark, path, users=users)) == all_rows(rows.join(users, "user_id", "left_semi"))


def test_folder_names_come_back():
    for user in USERS:
        assert user_of_folder(f"user_id={folder_name(user)}") == (user or None)


def test_folders_are_listed_by_few_tasks(spark, tmp_path, rows):
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name, None)
    with few_listing_tasks(spark):
        assert int(spark.conf.get(name)) < 1_000
    assert spark.conf.get(name, None) == before
    path = f"{tmp_path}/table"
    write_history(rows.withColumn("user_id", F.col("src_pos").cast("string")), path)
    group = "listing"
    spark.sparkContext.setJobGroup(group, group)
    try:
        read_history(spark, path)
        read_vectors(spark, path)
        tracker = spark.sparkContext.statusTracker()
        jobs = tracker.getJobIdsForGroup(group)
        stages = [tracker.getStageInfo(s) for job in jobs for s in tracker.getJobInfo(job).stageIds]
        assert stages and all(stage.numTasks <= 32 for stage in stages)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def written_vectors(rows, path):
    write_vectors(build_vectors(rows, HashEmbedder(16)), path, clustered=True)


def test_vectors_of_wanted_columns(spark, tmp_path, rows):
    path = f"{tmp_path}/vectors"
    written_vectors(rows.where("user_id <> ''"), path)
    expected = read_vectors(spark, path)
    for columns in (["user_id"], ["embed_failed", "user_id"], VECTOR_SCHEMA.names):
        found = read_vectors(spark, path, columns)
        assert found.columns == columns
        assert sorted(map(str, found.collect())) == sorted(map(str, expected.select(columns).collect()))
    assert read_vectors(spark, f"{tmp_path}/none", ["user_id"]).columns == ["user_id"]


@pytest.mark.parametrize("named", [0, 10])
def test_a_user_with_broken_pages_has_no_vectors(spark, tmp_path, rows, named):
    path = f"{tmp_path}/vectors"
    written_vectors(rows.where("user_id IN ('a', 'b c')"), path)
    # a second file that can be read, and pages of the first that can't, its end as it was
    name = next(name for name in os.listdir(f"{path}/user_id=a"))
    with open(f"{path}/user_id=a/{name}", "r+b") as file:
        whole = file.read()
        with open(f"{path}/user_id=a/copy.parquet", "wb") as copy:
            copy.write(whole)
        file.seek(4)
        file.write(b"\xff" * 200)
    users = spark.createDataFrame([("a",), ("b c",)], "user_id string")
    found = read_whole_users(spark, path, users, named).select("user_id", "idx").collect()
    assert sorted(row["idx"] for row in found) == list(range(10))
    assert {row["user_id"] for row in found} == {"b c"}


def test_a_batch_of_questions_opens_user_files_once(spark, tmp_path, rows, monkeypatch):
    history, vectors, out = (f"{tmp_path}/{name}" for name in ("history", "vectors", "out"))
    write_history(rows, history)
    written_vectors(rows.where("user_id IN ('a', '[y]{z}*?')"), vectors)
    opened, answer = [], question_stream.answer_batch

    def watched(questions, rows, stored, embedder, **options):
        opened.extend(rows.inputFiles() + stored.inputFiles())
        assert {row["user_id"] for row in rows.select("user_id").distinct().collect()} == {"a", "b c"}
        return answer(questions, rows, stored, embedder, **options)

    monkeypatch.setattr(question_stream, "answer_batch", watched)
    asked = [(1, "a", "t1 t7"), (2, "b c", "t1"), (3, "a", "total?"), (4, "nobody", "top channels")]
    questions = spark.createDataFrame(asked, question_stream.QUESTION_SCHEMA)
    question_stream.answer_questions(questions, 0, history, vectors, out, HashEmbedder(16))
    assert opened and not [name for name in opened if "user_id=" in name]
    # what was kept for the batch is gone
    assert not [name for name in opened if os.path.exists(name.removeprefix("file://"))]
    answers = {row["question_id"]: row for row in question_stream.read_answers(spark, out).collect()}
    assert sorted(answers) == [1, 2, 3, 4]
    assert answers[1]["plan"] == "vector" and answers[1]["data_count"] == 10
    assert answers[2]["plan"] == "recent_history" and answers[2]["data_count"] == 10


def test_tasks_list_and_read_raw_files_as_spark_does(spark, tmp_path):
    names = [
        "raw/u 1/a b.json", "raw/u%2F/sub/x+y.json", "raw/ä漢/[é]{1}*?.json", "raw/q#'\"<>^`|\\/a&=;,@$!~().json",
        "raw/u1/.hidden.json", "raw/u1/_x.json", "raw/u1/_x=1.json", "raw/u1/empty.json", "raw/u1/n.txt", "raw/_s/a.json",
        "raw/top.json", "raw/u1/bytes.json", "raw/u1/　wide .json",
    ]
    for name in names:
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"" if "empty" in name else b"\xff\xfe[]" if "bytes" in name else f'["{name}"]'.encode())
    columns = ["user_id", "file_path", "modified", "file_size", F.hex("value").alias("text")]

    def found(files):
        return sorted(map(str, files.select(*columns).collect()))

    root = str(tmp_path)
    expected = found(raw_files.scan_raw_files(spark, root))
    assert len(expected) == 7
    listed = raw_files.list_raw_files(spark, root)
    assert "value" not in listed.columns
    assert found(raw_files.with_text(listed)) == expected
    assert found(raw_files.scan_raw_files(spark, f"file://{root}/")) == expected
    assert found(raw_files.with_text(raw_files.list_raw_files(spark, f"file://{root}/"))) == expected
    paths = [str(tmp_path / name) for name in names[:2]]
    named = found(raw_files.scan_raw_files(spark, root, paths))
    assert len(named) == 2
    gone = f"{root}/raw/u1/gone.json"
    assert found(raw_files.with_text(raw_files.list_raw_files(spark, root, [*paths, gone]))) == named

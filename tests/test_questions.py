from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from watchlake.functions import fixed, prompts
from watchlake.operators import context
from watchlake.operators.embedding import HashEmbedder, build_vectors
from watchlake.operators.routing import check_questions, route_of, route_questions
from watchlake.plans import templates
from watchlake.plans.answers import answer_batch
from watchlake.workload import mapping

from conftest import SF_SMALL

# Questions an end user asks, with the route they take.
ROUTES = [
    ("最も視聴したチャンネルトップ10は？", None),
    ("2024年に何本の動画を見ましたか？", "total_videos"),
    ("月別の視聴本数を教えて", "total_videos"),
    ("プログラミング学習に関する動画は？", None),
    ("料理レシピ系で印象に残った動画を教えて", None),
    ("最近の視聴傾向を分析して", "recent_history"),
    ("よく見るチャンネルは？", "most_watched_channels"),
    ("日別の視聴数を教えて", "total_videos"),
    ("Stop motion?", "most_watched_channels"),
    ("日別の推移", "daily_watch_count"),
    ("TREND", "daily_watch_count"),
    ("How Many?", "total_videos"),
]


def test_routes(one_row):
    found = one_row([q for q, _ in ROUTES], route_of(F.col("value")))
    assert found == [route for _, route in ROUTES]


def test_blank_questions_are_rejected(spark):
    df = spark.createDataFrame(
        [(1, " 　\n"), (2, None), (3, "　top　")], "question_id int, question string"
    )
    rows = check_questions(df).orderBy("question_id").collect()
    assert [r["error"] for r in rows] == ["Question is required"] * 2 + [None]
    assert rows[2]["question"] == "top"
    routed = route_questions(df).collect()
    assert [(r["question_id"], r["route"], r["source"]) for r in routed] == [
        (3, "most_watched_channels", "sql")
    ]


def test_json_object_is_the_indented_form(spark):
    row = {"title": 'a "b"\n\\ 動\t/', "channel_name": None, "n": "5"}
    df = spark.createDataFrame([tuple(row.values())], "title string, channel_name string, n string")
    line = df.select(context.json_object(list(row)).alias("line"))
    rows = line.select(F.lit("u").alias("user_id"), F.lit(1).alias("rank"), "line")
    text = context.data_blocks(rows, ["user_id"]).first()["data_text"]
    assert text == json.dumps([row], ensure_ascii=False, indent=2)


@pytest.mark.parametrize("count", [1, 50, 51, 100])
def test_data_block_note(spark, count):
    rows = spark.range(1, count + 1).select(
        F.lit("u").alias("user_id"),
        F.col("id").cast("int").alias("rank"),
        F.concat(F.lit('{"n": "'), "id", F.lit('"}')).alias("line"),
    )
    row = context.data_blocks(rows.repartition(4), ["user_id"]).first()
    shown = min(count, 50)
    end = f"\n\n（全{count}件中、最初の50件を表示）" if count > 50 else ""
    assert row["data_count"] == count
    assert row["data_text"].endswith("]" + end)
    body = row["data_text"].removesuffix(end)
    assert [int(item["n"]) for item in json.loads(body)] == list(range(1, shown + 1))


def test_search_context(spark):
    rows = [(1, 2, "t2", None, "2025-01-02 03:04:05"), (1, 1, "t1", "c", "2025-01-01 00:00:00")]
    hits = spark.createDataFrame(
        rows, "question_id int, rank int, title string, channel_name string, at string"
    ).withColumn("watched_at", F.col("at").cast("timestamp"))
    row = context.search_context(hits).first()
    assert row["data_count"] == 2
    assert row["context"] == (
        "関連する視聴履歴 2件:\n"
        "- t1 (チャンネル: c, 視聴日: 2025-01-01)\n"
        "- t2 (チャンネル: None, 視聴日: 2025-01-02)"
    )


def test_data_summary(spark):
    rows = spark.range(1, 8).select(
        F.lit("u").alias("user_id"), F.col("id").cast("int").alias("rank"), F.col("id").alias("n")
    )
    text = context.data_summary(rows, ["user_id"], ["n"]).first()["summary"]
    lines = "".join(f"{i}. n: {i}\n" for i in range(1, 6))
    assert text == f"データ件数: 7件\n\nサンプル（最初の5件）:\n{lines}"


def test_messages(spark):
    turns = spark.createDataFrame(
        [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 2, "user", "c")],
        "conv_id int, turn int, role string, text string",
    )
    lists = context.message_lists(turns).collect()
    assert [[tuple(m) for m in r["messages"]] for r in lists] == [
        [("user", "a"), ("assistant", "b"), ("user", "c")],
    ]
    long = context.message_lists(
        spark.range(2500).selectExpr("1 AS conv_id", "id AS turn", "'user' AS role", "string(id) AS text")
    )
    extended = long.select(context.append_message(F.col("messages"), F.lit("new")).alias("m")).collect()
    assert [len(r["m"]) for r in extended] == [2501] and extended[0]["m"][-1]["content"] == "new"
    df = context.message_lists(turns)
    extended = df.select(context.append_message(F.col("messages"), F.lit("new")).alias("m"))
    assert [tuple(m) for m in extended.first()["m"]][-1] == ("user", "new")
    none = spark.sql("SELECT CAST(NULL AS array<struct<role:string,content:string>>) AS m")
    started = none.select(context.append_message(F.col("m"), F.lit("new")).alias("m"))
    assert [tuple(m) for m in started.first()["m"]] == [("user", "new")]


def test_templates_agree_for_one_and_all_users(spark):
    history = mapping.history(spark, SF_SMALL).cache()
    for name, template in templates.TEMPLATES.items():
        every = template(history)
        one = template(history, "7").collect()
        own = every.where("user_id = '7'")
        if "rank" in every.columns:
            own = own.orderBy("rank")
        assert own.select(*template(history, "7").columns).collect() == one
        history.createOrReplaceTempView("history_view")
        assert templates.run_template(spark, name, "7", "history_view").collect() == one
    fallback = templates.run_template(spark, "unknown", "7", "history_view").collect()
    assert fallback == templates.recent_history(history, "7").collect()
    history.unpersist()


def test_total_is_zero_without_rows(spark):
    history = mapping.history(spark, SF_SMALL)
    assert templates.total_videos(history, "nobody").first()["total"] == 0
    users = spark.createDataFrame([("nobody",)], "user_id string")
    rows = templates.total_videos(history, users=users).collect()
    assert [(r["user_id"], r["total"]) for r in rows] == [("nobody", 0)]


def test_answer_batch(spark):
    history = mapping.history(spark, SF_SMALL).cache()
    embedder = HashEmbedder(64)
    vectors = build_vectors(history.where("user_id <> '3'"), embedder).cache()
    asked = [
        (1, "7", "お気に入りは？"),
        (2, "7", "合計は？"),
        (3, "7", "最近は？"),
        (4, "7", "日別の推移"),
        (5, "7", "動画 について"),
        (6, "3", "動画 について"),
        (7, "nobody", "動画 について"),
        (8, "nobody", "合計は？"),
        (9, "7", "  "),
    ]
    questions = spark.createDataFrame(asked, "question_id long, user_id string, question string")
    answers = answer_batch(questions, history, vectors, embedder).collect()
    rows = {r["question_id"]: r for r in answers}
    assert sorted(rows) == [1, 2, 3, 4, 5, 6, 7, 8]
    labels = {i: (r["route"], r["source"], r["plan"]) for i, r in rows.items()}
    assert labels[1] == ("most_watched_channels", "sql", "most_watched_channels")
    assert labels[5] == (None, "vector", "vector")
    # No vectors: the recent history answers, the label stays.
    assert labels[6] == labels[7] == (None, "vector", "recent_history")

    for question, name in [
        (1, "most_watched_channels"),
        (2, "total_videos"),
        (3, "recent_history"),
        (4, "daily_watch_count"),
    ]:
        expected = templates.TEMPLATES[name](history, "7")
        data = json.loads(rows[question]["context"].split("\n\n（")[0])
        assert rows[question]["data_count"] == expected.count()
        assert list(data[0]) == expected.columns
        assert all(isinstance(v, str) for item in data for v in item.values())
    assert rows[5]["data_count"] == 20
    assert rows[5]["context"].startswith("関連する視聴履歴 20件:\n- ")
    assert rows[7]["context"] == fixed.NO_DATA_BLOCK and rows[7]["data_count"] == 0
    assert json.loads(rows[8]["context"]) == [{"total": "0"}] and rows[8]["data_count"] == 1
    assert rows[1]["prompt"].startswith("以下のYouTube閲覧履歴データに基づいて質問に答えてください。")
    assert "質問: お気に入りは？\n\n\nデータに基づいた" in rows[1]["prompt"]
    assert rows[5]["prompt"].endswith("\n\n質問: 動画 について")
    history.unpersist()
    vectors.unpersist()


def test_envelope(one_row):
    column = context.answer_envelope(F.col("value"), F.lit(3), F.lit("sql"))
    assert one_row(["答え", None], column) == [
        '{"answer":"答え","data_count":3,"source":"sql"}',
        '{"answer":null,"data_count":3,"source":"sql"}',
    ]


def test_hot_user_is_salted(spark):
    history = mapping.history(spark, SF_SMALL).cache()
    vectors = build_vectors(history, HashEmbedder(16))
    asked = [(i, "7", "合計は？" if i % 2 else "動画") for i in range(300)]
    asked += [(1000, "3", "合計は？"), (1001, "nobody", "合計は？"), (1002, "nobody", "動画")]
    questions = spark.createDataFrame(asked, "question_id long, user_id string, question string")
    plain, salted = (
        {
            r["question_id"]: r
            for r in answer_batch(questions, history, vectors, HashEmbedder(16), **more).collect()
        }
        for more in ({}, {"hot_rows": 100})
    )
    assert len(plain) == len(asked) and plain == salted
    history.unpersist()


def test_model_input(one_row):
    found = one_row(["hi"], context.model_input(F.col("value")))[0]
    assert found["system"] == prompts.CHAT_SYSTEM
    assert [tuple(m) for m in found["messages"]] == [("user", "hi")]
    found = one_row(["hi"], context.model_input(F.col("value"), system_prompt=F.lit("s")))[0]
    assert found["system"] == "s"

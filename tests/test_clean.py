from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from watchlake.operators.clean import ingest_stats, parse_records, valid_rows

S = " を視聴しました"
TIME = "2025-12-27T10:26:59.596Z"
AD = [{"name": "Google 広告から"}]


def parse(spark, records):
    rows = [("u", i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)]
    df = spark.createDataFrame(rows, "user_id string, src_pos int, json string")
    return parse_records(
        df.select("user_id", "src_pos", F.try_parse_json("json").alias("rec"))
    ).orderBy("src_pos")


def record(**fields):
    return {"title": "T" + S, "titleUrl": "https://youtu.be/abcdefghijk", "time": TIME, **fields}


def test_documented_sample(spark):
    rows = parse(
        spark,
        [
            {
                "header": "YouTube",
                "title": "〇〇 を視聴しました",
                "titleUrl": "https://www.youtube.com/watch?v=VIDEO_ID-12",
                "subtitles": [
                    {"name": "チャンネル名", "url": "https://www.youtube.com/channel/CHANNEL_ID"}
                ],
                "time": TIME,
                "products": ["YouTube"],
            },
            {"title": "広告を視聴しました", "time": TIME, "details": AD},
        ],
    ).collect()
    assert rows[0]["title"] == "〇〇"
    assert rows[0]["video_id"] == "VIDEO_ID-12"
    assert rows[0]["channel_name"] == "チャンネル名"
    assert rows[0]["channel_id"] == "CHANNEL_ID"
    assert rows[0]["watched_at"] == datetime(2025, 12, 27, 10, 26, 59, 596000)
    assert [r["outcome"] for r in rows] == ["valid", "ad"]


@pytest.mark.parametrize(
    "subtitles, name, channel",
    [
        ("missing", "", ""),
        (None, "", ""),
        ([], "", ""),
        (["text"], "", ""),
        ([None], "", ""),
        ("a string", "", ""),
        ({}, "", ""),
        (0, "", ""),
        (False, "", ""),
        ([{"url": "https://x/channel/UC1"}], "不明", "UC1"),
        ([{"name": None}], None, ""),
        ([{"name": "a", "url": None}], "a", ""),
        ([{"name": "a"}, {"name": "b"}], "a", ""),
        ([{"name": "", "url": "https://x/@h"}], "", ""),
    ],
)
def test_channel_fields(spark, subtitles, name, channel):
    fields = {} if subtitles == "missing" else {"subtitles": subtitles}
    row = parse(spark, [record(**fields)]).first()
    assert (row["channel_name"], row["channel_id"], row["outcome"]) == (name, channel, "valid")


@pytest.mark.parametrize(
    "details, outcome, reason",
    [
        (AD, "ad", None),
        ([{"name": "other"}, *AD], "ad", None),
        ([5, None, "x", *AD], "ad", None),
        ([], "valid", None),
        ([{"name": "other"}], "valid", None),
        ([{"name": None}], "valid", None),
        ("Google 広告から", "valid", None),
        ({"name": "Google 広告から"}, "valid", None),
        (None, "quarantined", "bad_details"),
        (5, "quarantined", "bad_details"),
        (True, "quarantined", "bad_details"),
    ],
)
def test_advertisement(spark, details, outcome, reason):
    row = parse(spark, [record(details=details)]).first()
    assert (row["outcome"], row["reason"]) == (outcome, reason)


@pytest.mark.parametrize(
    "rec, outcome, reason",
    [
        (record(time="bad", details=AD), "ad", None),
        (record(time="bad"), "bad_time", None),
        (record(time=None), "bad_time", None),
        (record(time=20251227), "bad_time", None),
        ({"title": "T"}, "bad_time", None),
        (record(title=5), "quarantined", "bad_title"),
        (record(title=5, time="bad"), "bad_time", None),
        (record(title=5, details=AD), "ad", None),
        (record(title=0), "valid", None),
        (record(title=None), "valid", None),
        (record(titleUrl=[1]), "quarantined", "bad_title_url"),
        (record(subtitles={"a": 1}), "quarantined", "bad_subtitles"),
        (record(subtitles=7), "quarantined", "bad_subtitles"),
        (record(subtitles=[{"name": "a", "url": 7}]), "quarantined", "bad_subtitles"),
        ("5", "quarantined", "not_an_object"),
        ("null", "quarantined", "not_an_object"),
        ('"text"', "quarantined", "not_an_object"),
        ("[]", "quarantined", "not_an_object"),
        ('{"time":"2025-12-27","time":"2025-12-28"}', "valid", None),
    ],
)
def test_outcomes(spark, rec, outcome, reason):
    row = parse(spark, [rec]).first()
    assert (row["outcome"], row["reason"]) == (outcome, reason)


def test_missing_and_null_titles_are_empty(spark):
    rows = parse(spark, [{"time": TIME}, {"time": TIME, "title": None, "titleUrl": None}])
    for row in rows.collect():
        assert (row["title"], row["video_id"]) == ("", "")


def test_statistics_add_up(spark):
    parsed = parse(
        spark,
        [
            record(),
            record(subtitles=[{"name": None}]),
            record(subtitles=[{"name": "a"}], time="2025-12-30"),
            record(details=AD),
            record(time="bad"),
            "5",
        ],
    )
    row = ingest_stats(parsed).first()
    assert row["input_rows"] == 6
    assert (row["ads_excluded"], row["bad_time"], row["quarantined"]) == (1, 1, 1)
    assert row["valid_rows"] == 3
    # NULL is no channel, the empty name is one.
    assert row["channels"] == 2
    assert (str(row["first_day"]), str(row["last_day"])) == ("2025-12-27", "2025-12-30")
    assert valid_rows(parsed).count() == 3


def test_statistics_without_valid_rows(spark):
    row = ingest_stats(parse(spark, [record(details=AD)])).first()
    assert row["valid_rows"] == 0
    assert row["first_day"] is None and row["channels"] is None


def test_fields_are_compiled(spark):
    # a generator that holds a lambda is interpreted whole, record by record
    plan = parse(spark, [{"title": "a" + S, "time": TIME}])._jdf.queryExecution().executedPlan().toString()
    generators = [line for line in plan.splitlines() if "Generate " in line]
    assert generators and not any("lambda" in line for line in generators)


def test_usual_times_read_as_all_others(spark):
    texts = ["2025-12-27T10:26:59Z", "2025-12-27T10:26:59.123456Z", "2025-02-30T10:26:59Z", "0000-01-01T00:00:00Z", "2025-12-27T24:00:00Z"]
    others = [text.replace("Z", "+00:00") for text in texts]
    rows = parse(spark, [{"title": "a", "time": text} for text in texts + others]).orderBy("src_pos").collect()
    times = [(row["watched_at"], row["outcome"]) for row in rows]
    assert times[:5] == times[5:] and [time is None for time, _ in times[:5]] == [False, False, True, True, True]

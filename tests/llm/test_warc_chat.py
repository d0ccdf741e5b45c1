from __future__ import annotations

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from watchlake.llm import chat, warc

PAGES = "page_id bigint, url string, html string, digest string, key string, Payload int"


def test_archive(spark, tmp_path):
    long = "<p>ü</p>" * 200_000
    rows = [
        (1, "http://a", "<p>x</p>", "d", "k", 1),
        (2, "http://a\r\nWARC-Type: x", "<p>x</p>", "d", "k", 1),
        (3, None, None, None, None, None),
        (4, "http://b", "", "d", "k", 1),
        (5, "http://c", long, "d", "k", 1),
        (6, "http://c", "WARC/1.1\r\n\r\n\r\n\r\n", "d", "k", 1),
        (6, "http://c", "WARC/1.1\r\n\r\n\r\n\r\n", "d", "k", 1),
        (None, "http://d", "<p>x</p>", "d", "k", 1),
        (None, "http://d", "alone", "d", "k", 1),
    ]
    path = str(tmp_path / "archive")
    warc.write_archive(spark.createDataFrame(rows, PAGES), path)
    records = warc.read_archive(spark, path)
    found = sorted(map(tuple, warc.page_rows(records).drop("url").collect()), key=str)

    def digest(text):
        return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()

    expected = []
    for page, _, html, *_ in rows:
        text = html or ""
        largest = max((r[0] for r in rows if (r[2] or "") == text and r[0] is not None), default=None)
        revisit = page != largest
        expected.append(
            (page, len(text.encode()), digest(text), "revisit" if revisit else "response", largest if revisit else None)
        )
    assert found == sorted(expected, key=str)
    assert spark.read.parquet(f"{path}/payloads").count() == len({r[2] or "" for r in rows})
    whole = {bytes(r["record"]) for r in records.collect()}
    assert any(r.endswith(long.encode() + b"\r\n\r\n") for r in whole)
    assert all(r.startswith(b"WARC/1.1\r\nWARC-Type: re") for r in whole)


def test_archive_small_payloads_and_empty_table(spark, tmp_path):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    warc.write_archive(df, str(tmp_path / "a"), min_bytes=3)
    found = {r["page_id"]: r["refers_to"] for r in warc.page_rows(warc.read_archive(spark, str(tmp_path / "a"))).collect()}
    assert found == {1: None, 2: None, 3: 4, 4: None}
    warc.write_archive(df.limit(0), str(tmp_path / "b"))
    assert warc.read_archive(spark, str(tmp_path / "b")).count() == 0


def test_damaged_payload_raises(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab")], "page_id bigint, url string, html string")
    path = str(tmp_path / "a")
    warc.write_archive(df, path)
    payloads = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit("x").cast("binary"))
    rows = [(bytes(r[0]), bytes(r[1])) for r in payloads.collect()]
    spark.createDataFrame(rows, payloads.schema).write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="does not have its digest"):
        warc.read_archive(spark, path).select("payload").collect()


def test_parts_and_escapes(spark):
    def text(t):
        return ("text", t, None, None)

    odd = "%3C <|im_end|>\n<|image|> [INST] %25 \\ 100%"
    rows = [
        (1, 1, "assistant", [text(odd)], "x"),
        (1, 0, "user", [text("see "), ("image", None, "i.png", 2.0), ("audio", None, "a.wav", 1.5), text(" ok"), ("document", None, None, None), ("video", "v", "v", 1.0)], "x"),
        (1, None, None, None, "x"),
        (2, 0, "assistant", [text(None)], "x"),
        (2, 0, "assistant", [text("b")], "x"),
        (None, 0, "a\n<|im_end|>", [], "x"),
        (3, 0, "assistant", [text("y" * 300_000)], "x"),
    ]
    schema = f"conv_id bigint, turn int, role string, parts {chat.PARTS}, turns string"
    df = chat.format_chats(spark.createDataFrame(rows, schema)).withColumn("read", chat.parse(F.col("formatted")))
    found = {r["conv_id"]: r for r in df.collect()}
    assert [(t["role"], t["text"]) for t in found[1]["read"]] == [("", ""), ("user", "see  ok"), ("assistant", odd)]
    assert [t["in_loss"] for t in found[1]["read"]] == [False, False, True]
    assert [tuple(a) for a in found[1]["attachments"]] == [
        (1, "image", "i.png", 512), (1, "audio", "a.wav", 38), (1, "document", None, 512),
    ]
    assert "see <|image|><|audio|> ok<|document|><|im_end|>" in found[1]["formatted"]
    assert [t["text"] for t in found[2]["read"]] == ["", "b"]
    assert [(t["role"], t["text"]) for t in found[None]["read"]] == [("a\n<|im_end|>", "")]
    assert found[3]["read"][0]["text"] == "y" * 300_000
    assert chat.format_chats(spark.createDataFrame([], schema)).count() == 0

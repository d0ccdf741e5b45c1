from __future__ import annotations

import base64
import hashlib

from pyspark.sql import functions as F

from watchlake.llm import warc


def test_page_facts_come_from_the_record(spark, tmp_path):
    """Length and digest follow the bytes of the rebuilt record, not what is stored beside it."""
    path = str(tmp_path / "w")
    pages = spark.createDataFrame([(1, "u1", "first page ü"), (2, "u2", "second")], "page_id int, url string, html string")
    warc.write_archive(pages, path)
    records = warc.read_archive(spark, path)
    sizes = {r["page_id"]: r["payload_bytes"] for r in warc.page_rows(records).collect()}
    assert sizes == {1: 13, 2: 6}
    longer = records.withColumn("record", F.concat("record", F.lit("!").cast("binary")))
    found = {r["page_id"]: r["payload_bytes"] for r in warc.page_rows(longer).collect()}
    assert found == {1: 14, 2: 7}


def parse(record: bytes) -> tuple[dict, bytes, bytes]:
    """Header fields, block and payload of one record, read as the format says."""
    head, rest = record.split(b"\r\n\r\n", 1)
    version, *lines = head.decode().split("\r\n")
    assert version == "WARC/1.1"
    fields = dict(line.split(": ", 1) for line in lines)
    assert len(fields) == len(lines)
    size = int(fields["Content-Length"])
    block = rest[:size]
    assert rest[size:] == b"\r\n\r\n"
    http, payload = block.split(b"\r\n\r\n", 1)
    assert http.startswith(b"HTTP/1.1 200 OK\r\n") and fields["Content-Type"] == "application/http; msgtype=response"
    return fields, http, payload


def test_records_are_valid(spark, tmp_path):
    """Mandatory fields, lengths, unique ids, references that are there, URIs as given."""
    long = "<p>ü</p>\r\n\r\n" * 50_000
    rows = [
        (1, "http://a", long), (2, "http://a", long), (2, "http://a", long), (None, "x y%20z", long),
        (3, "a\r\nWARC-Type: x\r\n\r\n", ""), (4, "a\nb%0A+ü", None), (None, "d", "alone"), (None, "d", "alone"),
        (None, "", "alone"), (-5, "\t", "minus"), (6, None, "six"),
    ]
    path = str(tmp_path / "w")
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    warc.write_archive(df, path, date="2024-05-06T07:08:09Z")
    records = warc.read_archive(spark, path).collect()
    parsed = [parse(bytes(r["record"])) for r in records]
    assert len(parsed) == len(rows)
    ids = [fields["WARC-Record-ID"] for fields, _, _ in parsed]
    assert len(set(ids)) == len(ids)
    responses = {f["WARC-Record-ID"]: payload for f, _, payload in parsed if f["WARC-Type"] == "response"}
    for row, (fields, http, payload) in zip(records, parsed, strict=True):
        assert fields["WARC-Date"] == "2024-05-06T07:08:09Z"
        if fields["WARC-Type"] == "revisit":
            assert payload == b"" and "WARC-Profile" in fields
            payload = responses[fields["WARC-Refers-To"]]
        assert payload == bytes(row["payload"])
        assert f"Content-Length: {len(payload)}".encode() in http.split(b"\r\n")
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert fields["WARC-Payload-Digest"] == f"sha1:{digest}"
    found = warc.page_rows(warc.read_archive(spark, path)).select("page_id", "url").collect()
    assert sorted(map(str, map(tuple, found))) == sorted(str((k, u or None)) for k, u, _ in rows)

"""Content-addressed WARC archive.

Payload bytes are stored once per SHA-256 digest, record headers one by one and byte for byte: the
WARC header and the HTTP head, all that stands before the payload. A join on the digest brings the
original records back, and every payload is verified against its digest when it is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchlake.llm.common import column, release, stored

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CONV32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
#: The date of records of pages that have none.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits make four of base 32."""
    digest = F.sha1(payload)
    groups = [
        F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)
    ]
    return F.translate(F.concat(*groups), CONV32, BASE32)


def _record_id(name: Column, row: Column) -> Column:
    return F.concat(F.lit("<urn:row:"), name, F.lit(":"), row.cast("string"), F.lit(">"))


def _header(record_type: Column, own_id: Column, uri: Column, length: Column, digest: Column, first_id: Column, date: str) -> Column:
    def line(name, value):
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    # only what would break the header is written otherwise than it is
    breaks = uri.rlike(r"[\x00-\x1F\x7F]")
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        line("Content-Length", length.cast("string")),
        F.lit("\r\n"),
    )
    is_revisit = record_type == "revisit"
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", record_type),
        line("WARC-Record-ID", own_id),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.when(breaks, F.url_encode(uri)).otherwise(uri)),
        F.when(breaks, F.lit("X-Target-URI-Form: url-encoded\r\n")).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(
            is_revisit,
            F.concat(line("WARC-Refers-To", first_id), F.lit(f"WARC-Profile: {PROFILE}\r\n")),
        ).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        # a revisit's block is the head alone
        line("Content-Length", (F.octet_length(head) + F.when(is_revisit, 0).otherwise(length)).cast("string")),
        F.lit("\r\n"),
        head,
    )


def write_archive(
    pages: DataFrame,
    path: str,
    key: str = "page_id",
    uri: str = "url",
    payload: str = "html",
    min_bytes: int = 0,
    date: str = DATE,
) -> None:
    """Write `pages` as an archive: Parquet folders `headers` and `payloads` under `path`.

    Of the rows with equal payloads of at least `min_bytes` bytes, those with the largest key are
    response records, the others revisit it; rows with smaller payloads are all responses. A null
    payload is empty, a null URI too; among equal payloads a null key is the smallest. Repeated rows
    keep a record each, with an id of its own; revisits name one of them. A URI with control characters
    is url-encoded and marked. `date` is the capture date of all records. Other columns are not archived.
    """
    body = F.coalesce(column(payload).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(
        column(key).cast("bigint").alias("key"),
        F.coalesce(column(uri), F.lit("")).alias("uri"),
        body.alias("payload"),
    ).select(
        "*",
        F.unhex(F.sha2("payload", 256)).alias("digest"),
        # never null, so that join and deduplication below can share one shuffle
        F.coalesce(F.col("key").cast("string"), F.lit("null")).alias("name"),
    )
    # stored, so that a row has one number in all that follows
    narrow = stored(
        rows.select(
            "key",
            "name",
            "uri",
            "digest",
            F.octet_length("payload").cast("bigint").alias("length"),
            base32_sha1(F.col("payload")).alias("sha1"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "warc-rows",
    )
    first = narrow.groupBy("digest").agg(F.max(F.struct("key", "row", "name")).alias("first"))
    first = first.select("digest", "first.key", "first.row", "first.name").toDF("digest", "first_key", "first_row", "first_name")
    # keys are part of the join that picks payloads, so many copies of one payload are spread
    winners = first.select("digest", F.col("first_name").alias("name"))
    rows.select("digest", "name", "payload").join(winners, ["digest", "name"], "left_semi").dropDuplicates(
        ["digest", "name"]
    ).select("digest", "payload").write.parquet(f"{path}/payloads")

    revisits = (F.col("length") >= min_bytes) & ~F.col("key").eqNullSafe(F.col("first_key"))
    kind = F.when(revisits, F.lit("revisit")).otherwise(F.lit("response"))
    narrow.join(first, "digest").select(
        _header(
            kind,
            _record_id(F.col("name"), F.col("row")),
            F.col("uri"),
            F.col("length"),
            F.col("sha1"),
            _record_id(F.col("first_name"), F.col("first_row")),
            date,
        ).alias("header"),
        "digest",
    ).write.parquet(f"{path}/headers")
    release(narrow)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archive: `header` (with the HTTP head), `payload` (also of revisits), and
    `record`, the bytes as in a file.

    A payload that doesn't have its digest, or is missing, raises.
    """
    payloads = spark.read.schema("digest binary, payload binary").parquet(f"{path}/payloads")
    checked = payloads.select(
        "digest",
        F.when(F.unhex(F.sha2("payload", 256)) == F.col("digest"), F.col("payload"))
        .otherwise(F.raise_error(F.lit("payload does not have its digest")).cast("binary"))
        .alias("payload"),
    )
    headers = spark.read.schema("header string, digest binary").parquet(f"{path}/headers")
    is_revisit = field("WARC-Type") == "revisit"
    missing = F.raise_error(F.lit("no payload for a digest")).cast("binary")
    return headers.join(checked, "digest", "left").select(
        "header",
        F.coalesce("payload", missing).alias("payload"),
        F.concat(
            F.col("header").cast("binary"),
            F.when(is_revisit, F.lit("").cast("binary")).otherwise(F.coalesce("payload", missing)),
            F.lit("\r\n\r\n").cast("binary"),
        ).alias("record"),
    )


def field(name: str, header: str = "header") -> Column:
    """The value of a header line, null if there is none."""
    return F.nullif(F.regexp_extract(header, rf"\r\n{name}: ([^\r]*)\r\n", 1), F.lit(""))


def target_uri() -> Column:
    """The URI as it was given."""
    value = field("WARC-Target-URI")
    return F.when(field("X-Target-URI-Form") == "url-encoded", F.url_decode(value)).otherwise(value)


def record_key(name: str) -> Column:
    return F.regexp_extract(field(name), r"^<urn:row:(-?\d+):\d+>$", 1).try_cast("bigint")


def page_rows(records: DataFrame) -> DataFrame:
    """Read from each record what the archive says of it, with length and digest of its payload.

    The payload of a response is taken out of its rebuilt record, that of a revisit is the joined one.
    """
    head, end = F.octet_length("header"), F.octet_length(F.lit("\r\n\r\n"))
    inside = F.substring("record", head + 1, F.octet_length("record") - head - end)
    payload = F.when(field("WARC-Type") == "revisit", F.col("payload")).otherwise(inside)
    return records.select(
        record_key("WARC-Record-ID").alias("page_id"),
        F.octet_length(payload).cast("bigint").alias("payload_bytes"),
        base32_sha1(payload).alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        F.when(field("WARC-Type") == "revisit", record_key("WARC-Refers-To")).alias("refers_to"),
        target_uri().alias("url"),
    )

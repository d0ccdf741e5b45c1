"""Raw records to cleaned rows: flags, field extraction, quarantine and statistics."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from watchlake.functions import fixed
from watchlake.functions.text import channel_id, video_id, video_title
from watchlake.functions.timestamps import parse_iso
from watchlake.sources.raw_files import NOT_AN_OBJECT

# Outcome of a record.
VALID = "valid"
AD = "ad"
BAD_TIME = "bad_time"
QUARANTINED = "quarantined"

# Reasons for quarantine: shapes that cannot be read as a view.
BAD_DETAILS = "bad_details"
BAD_TITLE = "bad_title"
BAD_TITLE_URL = "bad_title_url"
BAD_SUBTITLES = "bad_subtitles"

# JSON texts of values that count as empty when a string or list is expected.
_EMPTY_JSON = ("null", "false", "0", "0.0", "-0.0", '""', "[]", "{}")

_RECORD = "struct<title:variant,titleUrl:variant,time:variant,subtitles:variant,details:variant>"
_NAMED = "struct<name:variant,url:variant>"


def _is_string(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def _text(value: Column) -> Column:
    """A string field; empty when missing or when an empty value of another type."""
    return F.when(_is_string(value), F.try_variant_get(value, "$", "string")).otherwise("")


def _not_text(value: Column) -> Column:
    """Neither missing, nor empty, nor a string."""
    return value.isNotNull() & ~_is_string(value) & ~F.to_json(value).isin(*_EMPTY_JSON)


def is_advertisement(details: Column) -> Column:
    """Any object in the details array whose name is exactly the ad marker."""
    return F.coalesce(
        F.exists(
            F.try_variant_get(details, "$", "array<variant>"),
            lambda d: F.coalesce(
                F.try_variant_get(d, "$.name", "string") == fixed.AD_DETAIL_NAME, F.lit(False)
            ),
        ),
        F.lit(False),
    )


def parse_records(records: DataFrame, rec: str = "rec") -> DataFrame:
    """Replace the VARIANT column by the cleaned columns, `outcome` and `reason`.

    The order of the tests matters: an ad with a bad time is an ad, and fields are looked at
    only for records with a good time.

    A step's results are columns, so that Spark compiles the step; bound by `let` in one large
    expression they would be interpreted, which takes several times as long. The row is the
    output of a generator: the optimizer would copy projected expressions into every filter
    on it, and so read each record several times.
    """
    keep = [c for c in records.columns if c != rec]
    rows = records.select(*keep, F.col(rec).alias("_rec"))
    for step in _steps():
        rows = rows.select("*", *step)
    return rows.select(*keep, F.explode(F.array("_cleaned")).alias("_row")).select(*keep, "_row.*")


@functools.cache
def _steps() -> tuple[list[Column], ...]:
    """The steps of `parse_records`, the columns of each; the expressions are large and always the same."""
    opened = F.try_variant_get("_rec", "$", _RECORD).alias("_record")

    record = F.col("_record")
    time, details, subtitles = record["time"], record["details"], record["subtitles"]
    parts = [
        F.when(_is_string(time), F.try_variant_get(time, "$", "string")).alias("_time"),
        _text(record["title"]).alias("_title"),
        _text(record["titleUrl"]).alias("_url"),
        F.try_variant_get(subtitles, "$", "array<variant>").alias("_subtitles"),
    ]
    state = [
        F.when(details.isNotNull(), is_advertisement(details)).otherwise(False).alias("_ad"),
        parse_iso(F.col("_time")).alias("_at"),
        F.col("_subtitles").isNotNull().alias("_listed"),
        F.try_variant_get(F.get("_subtitles", F.lit(0)), "$", _NAMED).alias("_first"),
    ]

    ad, at, is_listed, first = (F.col(name) for name in ("_ad", "_at", "_listed", "_first"))
    readable = ~ad & at.isNotNull()
    judged = (
        F.when(record.isNull(), NOT_AN_OBJECT)
        # Objects and strings are searched without a result; nothing else can be searched.
        .when(details.isNotNull() & F.to_json(details).rlike(r"^[-0-9tfn]"), BAD_DETAILS)
        .when(readable & _not_text(record["title"]), BAD_TITLE)
        .when(readable & _not_text(record["titleUrl"]), BAD_TITLE_URL)
        .when(
            # Lists are the rule; only what is none has to be looked at as text.
            readable & ((~is_listed & _not_text(subtitles)) | _not_text(first["url"])),
            BAD_SUBTITLES,
        )
    ).alias("_reason")

    channel = (
        F.when(first.isNull(), "")
        .when(first["name"].isNull(), fixed.UNKNOWN_CHANNEL)
        .otherwise(F.try_variant_get(first["name"], "$", "string"))
    )
    names = [channel.alias("_channel"), channel_id(_text(first["url"])).alias("_channel_id")]

    reason = F.col("_reason")
    outcome = (
        F.when(reason.isNotNull(), QUARANTINED)
        .when(ad, AD)
        .when(at.isNull(), BAD_TIME)
        .otherwise(VALID)
    )
    texts = [video_title(F.col("_title")).alias("_video_title"), video_id(F.col("_url")).alias("_video_id")]

    row = F.struct(
        F.col("_video_title").alias("title"),
        F.col("_video_id").alias("video_id"),
        F.col("_channel").alias("channel_name"),
        F.col("_channel_id").alias("channel_id"),
        at.alias("watched_at"),
        outcome.alias("outcome"),
        reason.alias("reason"),
    ).alias("_cleaned")
    return [opened], parts, state, [judged, *names], texts, [row]


def valid_rows(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("outcome") == VALID).drop("outcome", "reason")


def ingest_stats(parsed: DataFrame) -> DataFrame:
    """One row per user: input, ads, bad times, quarantined, valid, date range, channels.

    The distinct count is planned as two aggregations with partial steps, so no task holds
    all rows of a user.
    """
    valid = F.col("outcome") == VALID
    day = F.when(valid, F.to_date("watched_at"))

    def count_of(outcome: str) -> Column:
        return F.count_if(F.col("outcome") == outcome)

    stats = parsed.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("input_rows"),
        count_of(AD).alias("ads_excluded"),
        count_of(BAD_TIME).alias("bad_time"),
        count_of(QUARANTINED).alias("quarantined"),
        count_of(VALID).alias("valid_rows"),
        F.min(day).alias("first_day"),
        F.max(day).alias("last_day"),
        F.count_distinct(F.when(valid, F.col("channel_name"))).alias("_channels"),
    )
    channels = F.when(F.col("valid_rows") > 0, F.col("_channels"))
    return stats.withColumn("channels", channels).drop("_channels")


def observed_totals(parsed: DataFrame, observation: Observation) -> DataFrame:
    """`parsed` as it is; when it is written, `observation` gets the totals of its records.

    They are counted by the tasks that write, so no second pass over the records is needed. Rows that stand for
    files that failed are counted apart. Distinct channels can't be counted this way; `ingest_stats` has them.
    """
    is_record = F.col("file_error").isNull() if "file_error" in parsed.columns else F.lit(True)
    valid = is_record & (F.col("outcome") == VALID)
    day = F.when(valid, F.to_date("watched_at"))

    def count_of(outcome: str) -> Column:
        return F.count_if(is_record & (F.col("outcome") == outcome))

    return parsed.observe(
        observation,
        F.count_if(is_record).alias("input_rows"),
        count_of(AD).alias("ads_excluded"),
        count_of(BAD_TIME).alias("bad_time"),
        count_of(QUARANTINED).alias("quarantined"),
        count_of(VALID).alias("valid_rows"),
        F.min(day).alias("first_day"),
        F.max(day).alias("last_day"),
        F.count_if(~is_record).alias("failed_files"),
    )

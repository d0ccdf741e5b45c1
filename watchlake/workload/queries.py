"""Registered queries: (spark, folder) -> DataFrame over whole tables."""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Row, SparkSession, Window
from pyspark.sql import functions as F

from watchlake.functions import fixed
from watchlake.functions.text import (
    channel_id,
    embedding_text,
    is_blank,
    processed_key,
    query_fingerprint,
    raw_key,
    truncate_text,
    vectors_key,
    video_id,
    video_title,
)
from watchlake.functions.timestamps import parse_iso, timestamp_text
from watchlake.functions.vectors import cosine_similarity, feature_codes, hash_embedding
from watchlake.operators import context
from watchlake.operators.clean import ingest_stats as stats_of
from watchlake.operators.clean import observed_totals, valid_rows
from watchlake.operators.documents import (
    read_document_files,
    read_documents,
    vector_documents,
    write_documents,
)
from watchlake.operators.embedding import HashEmbedder, ModelEmbedder, build_vectors, embed_texts
from watchlake.operators.keyword_table import route_by_table
from watchlake.operators.metric_index import search_index, write_index
from watchlake.operators.routing import check_questions
from watchlake.operators.routing import route_questions as route
from watchlake.operators.sampling import dense_positions, sample_per_user
from watchlake.operators.search import search_ranked
from watchlake.plans import templates
from watchlake.plans.answers import answer_batch as answers
from watchlake.plans.current import CurrentTables, record_counts
from watchlake.plans.current_sample import CurrentSample
from watchlake.plans.ingest import FAILED, REPORTS, ingest, read_records
from watchlake.session import cut_lineage, shared_dir, spread, stored
from watchlake.sources.arrivals import normalise_arrivals
from watchlake.sources.disk import remove_folder
from watchlake.sources.embedding_store import hash_store
from watchlake.sources.raw_files import key_below, user_of_processed_key, user_of_raw_key
from watchlake.sources.retention import delete_expired, expired_files, list_files
from watchlake.sources.tables import (
    as_result_strings,
    read_history,
    read_result_csv,
    read_vectors,
    read_whole_users,
    write_history,
    write_result_csv,
    write_vectors,
)
from watchlake.sources.tables import data_status as status_of
from watchlake.sources.uploads import validate_uploads
from watchlake.streaming import arrival_stream, question_stream
from watchlake.workload import mapping

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# The user of the single-user queries.
USER = "7"


def _query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# --- Cleaning -----------------------------------------------------------------------------


@_query
def parse_history(spark: SparkSession, folder: str) -> DataFrame:
    return mapping.history(spark, folder).select(
        "user_id", "title", "video_id", "channel_name", "channel_id", "watched_at"
    )


@_query
def record_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return (
        mapping.parsed(spark, folder)
        .groupBy("outcome")
        .agg(F.count(F.lit(1)).alias("record_count"))
    )


@_query
def ad_filter_counts(spark: SparkSession, folder: str) -> DataFrame:
    stats = stats_of(mapping.parsed(spark, folder))
    return stats.select("user_id", "input_rows", "ads_excluded", "valid_rows")


@_query
def ingest_stats(spark: SparkSession, folder: str) -> DataFrame:
    return stats_of(mapping.parsed(spark, folder))


@_query
def title_extract(spark: SparkSession, folder: str) -> DataFrame:
    rows = mapping.raw_fields(spark, folder)
    return rows.select("src_pos", video_title(F.col("title")).alias("title"))


@_query
def video_id_extract(spark: SparkSession, folder: str) -> DataFrame:
    rows = mapping.raw_fields(spark, folder)
    return rows.select("src_pos", video_id(F.col("titleUrl")).alias("video_id"))


@_query
def channel_id_extract(spark: SparkSession, folder: str) -> DataFrame:
    rows = mapping.raw_fields(spark, folder)
    url = F.try_element_at("subtitles", F.lit(1))["url"]
    return rows.select("src_pos", channel_id(url).alias("channel_id"))


@_query
def page_video_id_extract(spark: SparkSession, folder: str) -> DataFrame:
    rows = mapping.table(spark, folder, "pages")
    return rows.select("page_id", video_id(F.col("url")).alias("video_id"))


@_query
def timestamp_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Every event time in one of five text forms, two of which are not accepted."""
    n = F.col("event_id")
    text = (
        F.when(n % 5 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
        .when(n % 5 == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss'+09:00'"))
        .when(n % 5 == 2, F.date_format("ts", "yyyy-MM-dd"))
        .when(n % 5 == 3, F.date_format("ts", "yyyy-MM"))
        .otherwise(F.date_format("ts", " yyyy-MM-dd'T'HH:mm"))
    )
    return mapping.table(spark, folder, "events").select(
        "event_id", parse_iso(text).alias("parsed_at")
    )


@_query
def timestamp_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Every event time with rarer ends: offsets with seconds and fractions, good and bad ones."""
    ends = [
        "'T'HH:mm:ss.SSSSSS'+05:30:15.000000'",
        "'T'HH:mm:ss'-00:30:00.500000'",
        "'T'HH",
        "'T'HH:mm:ss'+24:00'",
        "'T'HH:mm:ss'.12345'",
        "'T'HH:mm:ss'+09:00:00.000'",
        "'x'HH:mm'+09:00:30'",
        "'T'HH:mm:ss'+0900'",
    ]
    n = F.col("event_id") % len(ends)
    text = F.date_format("ts", "yyyy-MM-dd" + ends[0])
    for position, end in enumerate(ends[1:], 1):
        text = F.when(n == position, F.date_format("ts", "yyyy-MM-dd" + end)).otherwise(text)
    return mapping.table(spark, folder, "events").select(
        "event_id", parse_iso(text).alias("parsed_at")
    )


@_query
def json_literals(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with each control character, and with what looks like its escape, as JSON."""
    n = F.col("event_id")
    text = F.concat(F.lit("é"), F.char(n % 31 + 1), F.lit("\\u001B\\"), n.cast("string"))
    return mapping.table(spark, folder, "events").select(
        "event_id", context.json_string(text).alias("literal")
    )


def _titles_digest(batches):
    """Rows of each user and the MD5 of their titles joined by commas; users come one after the other."""
    user, n, digest = None, 0, None
    done = []
    for batch in batches:
        for key, title in zip(batch["user_id"].to_pylist(), batch["title"].to_pylist(), strict=True):
            if digest is None or key != user:
                if digest is not None:
                    done.append((user, n, digest.hexdigest()))
                user, n, digest, comma = key, 0, hashlib.md5(), b""
            n += 1
            if title is not None:
                digest.update(comma + title.encode())
                comma = b","
        if done:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*done, strict=True))), _TITLES)
            done = []
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (user, n, digest.hexdigest())], _TITLES)


_TITLES = ["user_id", "table_rows", "titles_md5"]


@_query
def ingest_files(spark: SparkSession, folder: str) -> DataFrame:
    """Two export files of every user, by the job that reads, cleans, writes and reports.

    The newer one is good, empty or cut off. What is returned is what became of each file, and
    of the table's rows a count and a digest.
    """
    kind = F.col("user_id").cast("int") % 3
    number = uuid.uuid4().hex
    root, out = (f"{shared_dir(spark).rstrip('/')}/{name}-{number}" for name in ("exports", "ingested"))
    records = cut_lineage(mapping.raw_json(spark, folder))
    newer = F.col("src_pos") % 2 == 1
    ending = F.when(kind == 1, "empty").when(kind == 2, "cut").otherwise("closed")
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    try:
        # one after the other, so that their times tell which is newer
        mapping.export_files(records.where(~newer).withColumn("ending", F.lit("closed")), root, "a.json")
        mapping.export_files(records.where(newer).withColumn("ending", ending), root, "b.json")
        result = ingest(spark, root, out, "run")
    finally:
        remove_folder(spark, root)
    rows = (
        read_history(spark, f"{out}/history", whole=True)
        .select("user_id", "title")
        .repartition("user_id")
        .sortWithinPartitions("user_id", "title")
        .mapInArrow(_titles_digest, "user_id string, table_rows long, titles_md5 string")
    )
    files = result.files.drop("modified").withColumn("file_path", key_below(F.col("file_path"), root))
    return files.join(rows, "user_id", "left")


@_query
def large_files(spark: SparkSession, folder: str) -> DataFrame:
    """One export file per tenant, three in all, read in pieces by many tasks; the rows cleaned.

    What counts as large is set to 1,000 bytes, so that no file is read whole.
    """
    root = _fresh_folder(spark, "large")
    records = cut_lineage(mapping.raw_json(spark, folder).select(mapping.tenant().alias("user_id"), "src_pos", "json"))
    mapping.export_files(records.withColumn("ending", F.lit("closed")), root, "all.json")
    return valid_rows(read_records(spark, root, variant_bytes=1_000)).select(
        "user_id", "src_pos", "title", "video_id", "channel_name", "channel_id", "watched_at"
    )


# --- Stored tables ------------------------------------------------------------------------


@_query
def history_table(spark: SparkSession, folder: str) -> DataFrame:
    """The cleaned table after a second write, which has every third user, with the later half of the month."""
    path = f"{_fresh_folder(spark, 'history')}/table"
    rows = cut_lineage(mapping.history(spark, folder))
    write_history(rows, path)
    again = (F.col("user_id").cast("long") % 3 == 0) & (F.dayofmonth("watched_at") > 15)
    write_history(rows.where(again), path)
    return read_history(spark, path, whole=True)


@_query
def vectors_of_users(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of every row, written and read back for some users as the search does.

    Asked for are customers of one market segment. Every tenth user has a file that can't be read and so no vectors.
    """
    path = f"{_fresh_folder(spark, 'vectors')}/table"
    # stored, as vectors take their rows in two steps
    write_vectors(build_vectors(stored(mapping.history(spark, folder)), HashEmbedder(64)), path, clustered=True)
    written = read_vectors(spark, path, ["user_id"]).distinct()
    at = F.concat(F.lit(f"{path}/user_id="), "user_id").alias("folder")
    mapping.break_files(spark, written.where(F.col("user_id").cast("long") % 10 == 7).select(at), "part-x.parquet")
    found = read_whole_users(spark, path, _waiting(spark, folder))
    signs = F.array_join(F.transform("embedding", lambda x: F.sign(x).cast("int").cast("string")), ",")
    return found.withColumns({"signs_md5": F.md5(signs), "largest": F.round(F.array_max("embedding").cast("double"), 5)}).drop("embedding")


@_query
def result_csv(spark: SparkSession, folder: str) -> DataFrame:
    """The recent history of all users as a result set, written as CSV and read back."""
    path = f"{_fresh_folder(spark, 'results')}/recent"
    result = templates.recent_history(mapping.history(spark, folder))
    write_result_csv(result, path)
    return read_result_csv(spark, path, result.columns)


# --- Kept current -------------------------------------------------------------------------


def _fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; it goes when the session ends."""
    folder = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


@_query
def embed_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """Three batches of views through the embedding store: what each sent to the model, and its vectors.

    Titles repeat within and between batches; every 50th is blank and every third row has one title.
    """
    n = F.col("src_pos")
    title = F.when(n % 50 == 0, " ").when(n % 3 == 0, "the same clip").otherwise(F.concat(F.lit("clip "), F.expr("src_pos div 2")))
    rows = cut_lineage(mapping.raw_fields(spark, folder).select("user_id", "src_pos", title.alias("text")))
    store = hash_store(f"{_fresh_folder(spark, 'embeddings')}/vectors", dim=64)
    batches = [n % 5 < 2, (n % 5 == 1) | (n % 5 == 2), n % 5 >= 2]
    parts = []
    for number, chosen in enumerate(batches):
        batch = rows.where(chosen)
        store.add(batch, "text", f"{number}")
        made = embed_texts(store.attach(batch, "text", "stored"), "text", HashEmbedder(64))
        counted = made.agg(
            F.lit(number).alias("batch"),
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(is_blank(F.col("text"))).alias("n_blank"),
            F.count_if(~F.col("stored").eqNullSafe(F.col("embedding"))).alias("n_different"),
        )
        # in one plan Spark takes scans of the growing store for equal, whenever it was listed
        parts.append(cut_lineage(counted))
    sent = store.known(spark).groupBy(F.col("batch").cast("int").alias("of")).agg(F.count(F.lit(1)).alias("texts_sent"))
    every = functools.reduce(DataFrame.unionByName, parts)
    sent_or_none = F.coalesce("texts_sent", F.lit(0).cast("long")).alias("texts_sent")
    return every.join(sent, F.col("batch") == F.col("of"), "left").select(*every.columns, sent_or_none)


def _uploads(spark: SparkSession, folder: str) -> list[DataFrame]:
    """Parsed records of three batches: of all users, of every second and of every third one."""
    parsed = stored(mapping.parsed(spark, folder))
    user = F.col("user_id").cast("long")
    chosen = [F.lit(True), user % 2 == 0, user % 3 == 0]
    return [
        parsed.where(fits & (F.col("src_pos") % 3 == number)).withColumn("file_path", F.lit(f"{number}.json"))
        for number, fits in enumerate(chosen)
    ]


@_query
def counts_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """Template counts after three batches of uploads that replace users, the last one run twice."""
    current = CurrentTables(f"{_fresh_folder(spark, 'current')}/state", every=2)
    for number, records in [*enumerate(_uploads(spark, folder)), (2, None)]:
        if records is not None:
            last = records
        rows = valid_rows(last)
        valid = rows.select("user_id", "file_path").distinct()
        files = record_counts(last).join(valid, ["user_id", "file_path"], "left_semi")
        files = stored(files.withColumn("modified", F.timestamp_seconds(F.lit(number))))
        current.replace(files, rows, number)
    stats = current.ingest_stats(spark)
    measures = ["input_rows", "ads_excluded", "bad_time", "quarantined", "valid_rows", "channels"]
    days = [F.datediff(F.col(name), F.lit("2024-01-01").cast("date")).cast("long").alias(name) for name in ("first_day", "last_day")]
    long = stats.select("user_id", *measures, *days).unpivot("user_id", [*measures, "first_day", "last_day"], "name", "n")
    channels = current.most_watched_channels(spark).select("user_id", F.concat(F.lit("channel "), "channel_name").alias("name"), F.col("watch_count").alias("n"))
    per_day = current.daily_watch_count(spark).select("user_id", F.col("watch_date").cast("string").alias("name"), F.col("count").alias("n"))
    totals = current.total_videos(spark).select("user_id", F.lit("total").alias("name"), F.col("total").alias("n"))
    return long.unionByName(channels).unionByName(per_day).unionByName(totals)


@_query
def arrival_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Two uploads of every user, found by their notifications in two runs of the stream.

    The first run has every notification twice and names files that aren't there. The second upload is
    good, empty or cut off by user; its run also has all notifications of the first again, as a third
    of the log always is of an unknown shape. Per user: rows, an order-free digest of their titles, vectors, bad files.
    """
    base = _fresh_folder(spark, "arrivals")
    root, out, log = f"{base}/in", f"{base}/out", f"{base}/log"
    kind = F.col("user_id").cast("long") % 3
    records = cut_lineage(mapping.raw_json(spark, folder))
    newer = F.col("src_pos") % 2 == 1
    ending = F.when(kind == 1, "empty").when(kind == 2, "cut").otherwise("closed")
    uploads = [records.where(~newer).withColumn("ending", F.lit("closed")), records.where(newer).withColumn("ending", ending)]
    store = hash_store(f"{out}/embeddings", dim=16)

    def body(name: str):
        key = F.concat(F.lit("raw/"), "user_id", F.lit(f"/{name}"))
        bus = F.format_string('{"source":"aws.s3","detail-type":"Object Created","detail":{"bucket":{"name":"b"},"object":{"key":"%s"}}}', key)
        listed = F.format_string('{"Records":[{"s3":{"bucket":{"name":"b"},"object":{"key":"%s"}}}]}', key)
        return F.when(F.col("user_id").cast("long") % 2 == 0, bus).otherwise(listed)

    for number, upload in enumerate(uploads):
        name = f"{'ab'[number]}.json"
        mapping.export_files(upload, root, name)
        users = upload.select("user_id").distinct()
        names = ["a.json", "a.json", "gone.json"] if number == 0 else ["a.json", "b.json", "b.json"]
        notes = [users.select(body(x).alias("body")) for x in names] + [users.select(F.lit('{"other": 1}').alias("body"))]
        functools.reduce(DataFrame.unionAll, notes).write.mode("append").json(log)
        run = arrival_stream.start(spark, log, root, out, f"{base}/checkpoint", store=store)
        run.awaitTermination()
    history = read_history(spark, f"{out}/history", whole=True)
    title = F.conv(F.substring(F.md5("title"), 1, 8), 16, 10).cast("long")
    rows = history.groupBy("user_id").agg(F.count(F.lit(1)).alias("views"), F.sum(title).alias("titles"))
    vectors = read_vectors(spark, f"{out}/vectors", ["user_id", "embed_failed"]).groupBy("user_id").agg(F.count_if(~F.col("embed_failed")).alias("vectors"))
    reports = spark.read.schema(REPORTS["files"]).parquet(f"{out}/reports/files")
    bad = reports.groupBy("user_id").agg(F.count_if(F.col("outcome") == FAILED).alias("failed_files"), F.count_distinct("file_path").alias("files"))
    return bad.join(rows, "user_id", "left").join(vectors, "user_id", "left")


@_query
def ingest_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Totals of all records, counted by the tasks that store them."""
    observation = Observation()
    parsed = observed_totals(mapping.parsed(spark, folder), observation)
    parsed.write.parquet(f"{_fresh_folder(spark, 'observed')}/parsed")
    schema = (
        "input_rows long, ads_excluded long, bad_time long, quarantined long, valid_rows long, "
        "first_day date, last_day date, failed_files long"
    )
    return spark.createDataFrame([Row(**observation.get)], schema)


@_query
def sample_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """The sample of `sample_large` after three batches of rows, the second one brought in twice."""
    rows = cut_lineage(_few_tenants(spark, folder).select("user_id", "src_pos"))
    sample = CurrentSample(f"{_fresh_folder(spark, 'sample')}/state", "user_id string, src_pos int", "src_pos", every=1)
    for batch, part in enumerate([0, 1, 1, 2]):
        sample.add(rows.where(F.col("src_pos") % 3 == part), batch)
    return sample.sample(spark)


@_query
def answer_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The answers of `answer_batch`, to questions that come in as a stream, a third of them twice."""
    base = _fresh_folder(spark, "questions")
    history, vectors, asked = f"{base}/history", f"{base}/vectors", f"{base}/asked"
    rows = mapping.history(spark, folder)
    write_history(rows, history)
    ready = read_history(spark, history, whole=True).join(_waiting(spark, folder), "user_id", "left_anti")
    write_vectors(build_vectors(ready, HashEmbedder(64)), vectors, clustered=True)
    questions = cut_lineage(mapping.questions(spark, folder))
    turn = F.pmod(F.xxhash64("question_id"), F.lit(3))
    for chosen in (turn < 2, turn > 0):
        questions.where(chosen).coalesce(1).write.mode("append").json(asked)
        run = question_stream.start(
            spark, asked, history, vectors, f"{base}/answers", f"{base}/checkpoint", HashEmbedder(64)
        )
        run.awaitTermination()
    answers = question_stream.read_answers(spark, f"{base}/answers")
    return answers.select("question_id", "user_id", "route", "source", "plan", "data_count")


@_query
def retention_deleted(spark: SparkSession, folder: str) -> DataFrame:
    """One export per user, as old as the user's last event; expired ones are deleted, but for those written anew."""
    root = _fresh_folder(spark, "kept")
    records = cut_lineage(mapping.raw_json(spark, folder))
    mapping.export_files(records.withColumn("ending", F.lit("closed")), root, "a.json")
    last = mapping.table(spark, folder, "events").groupBy(F.col("user_id").cast("string").alias("user_id")).agg(
        F.max(F.col("ts").cast("timestamp")).alias("modified")
    )
    listed = last.select(
        F.concat(F.lit(f"{root}/raw/"), "user_id", F.lit("/a.json")).alias("file_path"), "modified"
    )
    mapping.set_times(listed.where(~F.col("file_path").endswith("7/a.json")))
    report = delete_expired(listed, "2024-01-31 00:00:00", f"{root}/report")
    # in the folder only what was not deleted is left
    left = list_files(spark, f"{root}/raw").select(key_below(F.col("file_path"), root).alias("key"), F.lit(True).alias("left"))
    found = listed.select(key_below(F.col("file_path"), root).alias("key")).join(left, "key", "left")
    report = report.select(key_below(F.col("file_path"), root).alias("of"), "outcome")
    return found.join(report, F.col("key") == F.col("of"), "left").select(
        "key", F.coalesce("outcome", F.lit("kept")).alias("outcome"), F.coalesce("left", F.lit(False)).alias("there")
    )


# --- Templates ----------------------------------------------------------------------------


@_query
def most_watched_channels(spark: SparkSession, folder: str) -> DataFrame:
    return templates.most_watched_channels(mapping.history(spark, folder), USER)


@_query
def total_videos(spark: SparkSession, folder: str) -> DataFrame:
    return templates.total_videos(mapping.history(spark, folder), USER)


@_query
def recent_history(spark: SparkSession, folder: str) -> DataFrame:
    return templates.recent_history(mapping.history(spark, folder), USER)


@_query
def daily_watch_count(spark: SparkSession, folder: str) -> DataFrame:
    return templates.daily_watch_count(mapping.history(spark, folder), USER)


@_query
def most_watched_channels_all_users(spark: SparkSession, folder: str) -> DataFrame:
    return templates.most_watched_channels(mapping.history(spark, folder))


@_query
def total_videos_all_users(spark: SparkSession, folder: str) -> DataFrame:
    """Every customer counts as a user, so most have a total of 0."""
    customers = mapping.table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("user_id")
    )
    return templates.total_videos(mapping.history(spark, folder), users=customers)


@_query
def recent_history_all_users(spark: SparkSession, folder: str) -> DataFrame:
    return templates.recent_history(mapping.history(spark, folder))


@_query
def daily_watch_count_all_users(spark: SparkSession, folder: str) -> DataFrame:
    return templates.daily_watch_count(mapping.history(spark, folder))


@_query
def result_as_strings(spark: SparkSession, folder: str) -> DataFrame:
    return as_result_strings(templates.recent_history(mapping.history(spark, folder)))


# --- Vectors ------------------------------------------------------------------------------


@_query
def embedding_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Text to embed and metadata of every cleaned row."""
    return mapping.history(spark, folder).select(
        "src_pos",
        embedding_text(F.col("title"), F.col("channel_name")).alias("text"),
        timestamp_text(F.col("watched_at")).alias("watched_at_text"),
    )


@_query
def truncate_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as the embedder gets them, and which of them are blank."""
    text = truncate_text(F.col("text"))
    return spread(mapping.table(spark, folder, "documents").select("doc_id", "text")).select(
        "doc_id",
        F.md5(text).alias("cut_md5"),
        F.length(text).cast("bigint").alias("cut_chars"),
        is_blank(F.col("text")).alias("blank"),
    )


@_query
def hash_embed(spark: SparkSession, folder: str) -> DataFrame:
    """Features and default embedding of every row, the latter by native array functions."""
    text = embedding_text(F.col("title"), F.col("channel_name"))
    rows = mapping.history(spark, folder).select(
        "src_pos",
        feature_codes(text, fixed.EMBEDDING_DIM).alias("codes"),
        hash_embedding(text).alias("embedding"),
    )
    largest = F.array_max("embedding")
    return rows.select(
        "src_pos",
        F.array_join(F.transform("codes", lambda code: code.cast("string")), " ").alias("codes"),
        F.size("embedding").alias("dimension"),
        F.size(F.array_remove("embedding", F.lit(0.0).cast("float"))).alias("set_buckets"),
        F.round(largest.cast("double"), 5).alias("largest"),
        F.round(F.array_min("embedding").cast("double"), 5).alias("smallest"),
        F.when(largest > 0, F.array_position("embedding", largest))
        .otherwise(F.lit(0).cast("bigint"))
        .alias("first_largest"),
    )


@_query
def sample_exact(spark: SparkSession, folder: str) -> DataFrame:
    """Twenty rows of every user."""
    rows = mapping.history(spark, folder).select("user_id", "src_pos")
    return sample_per_user(rows, "src_pos", limit=20)


def _few_tenants(spark: SparkSession, folder: str) -> DataFrame:
    """Cleaned rows of three tenants, the first with most of them."""
    n = F.col("src_pos") % 10
    tenant = F.when(n < 8, "large").when(n == 8, "middle").otherwise("small")
    return mapping.history(spark, folder).withColumn("user_id", tenant)


@_query
def sample_large(spark: SparkSession, folder: str) -> DataFrame:
    """The sample at its production size."""
    rows = _few_tenants(spark, folder).select("user_id", "src_pos")
    return sample_per_user(rows, "src_pos")


@_query
def recent_history_cut(spark: SparkSession, folder: str) -> DataFrame:
    """The newest hundred rows of tenants with more."""
    return templates.recent_history(_few_tenants(spark, folder))


@_query
def dense_vector_positions(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of each tenant numbered without gaps, in small parts."""
    rows = _few_tenants(spark, folder).select("user_id", "src_pos")
    return dense_positions(rows, "src_pos", part_rows=50)


@_query
def embedding_failures(spark: SparkSession, folder: str) -> DataFrame:
    """Every text by a model that fails for some; these and blank ones get the zero vector."""

    def load():
        def model(texts: list[str]) -> list[list[float]]:
            if any("Post" in text for text in texts):
                raise ValueError("not taken")
            return [[float(len(text)), 1.0] for text in texts]

        return model

    n = F.col("src_pos")
    rows = mapping.history(spark, folder).select(
        "src_pos", F.when(n % 5 == 0, " ").otherwise(F.col("title")).alias("title")
    )
    done = embed_texts(rows, "title", ModelEmbedder(load, dim=2, batch_size=16))
    return done.select(
        "src_pos",
        "embed_failed",
        F.get("embedding", F.lit(0)).cast("double").alias("first"),
        F.get("embedding", F.lit(1)).cast("double").alias("second"),
    )


@_query
def cosine_to_anchor(spark: SparkSession, folder: str) -> DataFrame:
    """Similarity of every vector to the vector with the lowest id of its tenant."""
    vectors = mapping.tenant_vectors(spark, folder)
    anchors = vectors.groupBy("user_id").agg(F.min_by("embedding", "idx").alias("anchor"))
    return vectors.join(anchors, "user_id").select(
        F.col("idx").alias("vec_id"),
        F.round(cosine_similarity(F.col("embedding"), F.col("anchor")), 4).alias("score"),
    )


@_query
def cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty vectors of the whole table nearest to vector 0."""
    vectors = mapping.tenant_vectors(spark, folder).withColumn("user_id", F.lit("all"))
    question = vectors.where(F.col("idx") == 0).select(
        F.col("idx").alias("question_id"), "user_id", "embedding"
    )
    hits = search_ranked(vectors, question, k=fixed.ANSWER_SEARCH_K)
    return hits.select(
        F.col("rank").cast("bigint").alias("rank"),
        F.col("idx").alias("vec_id"),
        F.round("score", 4).alias("score"),
    )


@_query
def cosine_topk_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector as a question to the vectors of its tenant."""
    vectors = mapping.tenant_vectors(spark, folder)
    asked = vectors.withColumnRenamed("idx", "question_id")
    hits = search_ranked(vectors, asked, k=fixed.ANSWER_SEARCH_K)
    return hits.select(
        "question_id",
        F.col("rank").cast("bigint").alias("rank"),
        F.col("idx").alias("vec_id"),
        F.round("score", 4).alias("score"),
    )


@_query
def cosine_topk_cells(spark: SparkSession, folder: str) -> DataFrame:
    """The same search by the way for many questions, in small blocks."""
    vectors = mapping.tenant_vectors(spark, folder)
    asked = vectors.withColumnRenamed("idx", "question_id")
    hits = search_ranked(
        vectors,
        asked,
        k=fixed.ANSWER_SEARCH_K,
        broadcast_limit=0,
        vectors_per_block=32,
        questions_per_block=16,
    )
    return hits.select(
        "question_id",
        F.col("rank").cast("bigint").alias("rank"),
        F.col("idx").alias("vec_id"),
        F.round("score", 4).alias("score"),
    )


@_query
def cosine_topk_index(spark: SparkSession, folder: str) -> DataFrame:
    """The same search by the metric index, written and read back."""
    path = f"{_fresh_folder(spark, 'index')}/vectors"
    vectors = mapping.tenant_vectors(spark, folder)
    write_index(vectors, path, block_rows=64)
    asked = vectors.withColumnRenamed("idx", "question_id")
    hits = search_index(spark, path, asked, k=fixed.ANSWER_SEARCH_K).hits
    return hits.select(
        "question_id",
        F.col("rank").cast("bigint").alias("rank"),
        F.col("idx").alias("vec_id"),
        F.round("score", 4).alias("score"),
    )


@_query
def vector_doc_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of all tenants written as JSON document files, some hundred rows each, and read back."""
    place = Window.partitionBy("user_id").orderBy("idx")
    rows = mapping.tenant_vectors(spark, folder).select(
        "user_id",
        (F.row_number().over(place) - 1).cast("int").alias("idx"),
        "embedding",
        F.concat(F.lit("text "), F.col("idx").cast("string")).alias("text"),
        F.concat(F.lit("title "), F.col("idx").cast("string")).alias("title"),
        F.lit(None).cast("string").alias("channel_name"),
        F.lit("").alias("video_id"),
        F.timestamp_seconds(F.col("idx")).alias("watched_at"),
    )
    path = f"{shared_dir(spark).rstrip('/')}/documents-{uuid.uuid4().hex}"
    write_documents(vector_documents(rows, dim=64, rows_per_document=100), path)
    back = read_documents(read_document_files(spark, path))
    values = F.transform("embedding", lambda x: F.round(x.cast("double") * 100_000).cast("bigint"))
    return back.select(
        "user_id",
        "idx",
        "text",
        "title",
        "channel_name",
        "video_id",
        "watched_at",
        F.size("embedding").alias("dimension"),
        F.md5(F.array_join(values.cast("array<string>"), ",")).alias("values_md5"),
    )


# --- Questions ----------------------------------------------------------------------------


@_query
def question_check(spark: SparkSession, folder: str) -> DataFrame:
    """All turns as questions; those of the system role are blanked by white space."""
    turns = mapping.table(spark, folder, "conversations").select(
        "conv_id",
        "turn",
        F.when(F.col("role") == "system", "　\t\n")
        .otherwise(F.concat(F.lit(" 　"), F.col("text"), F.lit("\n")))
        .alias("question"),
    )
    checked = check_questions(turns)
    return checked.select("conv_id", "turn", F.md5("question").alias("question_md5"), "error")


@_query
def route_questions(spark: SparkSession, folder: str) -> DataFrame:
    return route(mapping.questions(spark, folder)).select(
        "question_id", "user_id", "route", "source"
    )


@_query
def route_keyword_table(spark: SparkSession, folder: str) -> DataFrame:
    """Questions routed by a table of some thousand keywords: words of `benchmark`, beginnings of those of answers."""

    def words(text: DataFrame) -> DataFrame:
        lowered = F.lower(F.coalesce("text", F.lit("")))
        return text.select(F.explode(F.regexp_extract_all(lowered, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("word"))

    answers = mapping.table(spark, folder, "conversations").where("role = 'assistant'")
    whole = words(mapping.table(spark, folder, "benchmark")).where(F.length("word") > 3)
    parts = words(answers).select(F.substring("word", 1, 6).alias("word")).where(F.length("word") > 4)
    keywords = whole.union(parts).distinct().select(
        F.col("word").alias("keyword"),
        F.substring(F.md5("word"), 1, 6).alias("route"),
        F.substring(F.md5("word"), 7, 1).alias("turn"),
    )
    asked = mapping.questions(spark, folder).select("question_id", "question")
    return route_by_table(asked, cut_lineage(keywords), "question_id", "question").drop("question")


@_query
def route_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Whole documents as questions, which hit keywords of every route."""
    asked = spread(
        mapping.table(spark, folder, "documents").select("doc_id", F.col("text").alias("question"))
    )
    return route(asked).select("doc_id", "route", "source")


def _waiting(spark: SparkSession, folder: str) -> DataFrame:
    """Users that are customers of one market segment have no vectors yet: the fallback."""
    return (
        mapping.table(spark, folder, "customer")
        .where(F.col("c_mktsegment") == "MACHINERY")
        .select(F.col("c_custkey").cast("string").alias("user_id"))
    )


def _batch(spark: SparkSession, folder: str) -> DataFrame:
    asked = mapping.questions(spark, folder)
    rows = stored(mapping.history(spark, folder, of=asked.select("user_id").distinct()))
    vectors = cut_lineage(build_vectors(rows.join(_waiting(spark, folder), "user_id", "left_anti")))
    return answers(asked, rows, vectors)


@_query
def answer_batch(spark: SparkSession, folder: str) -> DataFrame:
    return _batch(spark, folder).select(
        "question_id", "user_id", "route", "source", "plan", "data_count"
    )


@_query
def answer_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Context, prompt and envelope of all answers."""
    batch = _batch(spark, folder)
    envelope = context.answer_envelope(F.col("context"), F.col("data_count"), F.col("source"))
    return batch.select("question_id", "context", "prompt", envelope.alias("envelope"))


@_query
def template_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Context and prompt of all questions that the query templates answer."""
    batch = _batch(spark, folder).where(F.col("plan") != "vector")
    return batch.select(
        "question_id",
        "plan",
        "data_count",
        "context",
        F.md5("prompt").alias("prompt_md5"),
    )


@_query
def search_context(spark: SparkSession, folder: str) -> DataFrame:
    """Context text of the hits of every vector's search in its tenant."""
    vectors = mapping.tenant_vectors(spark, folder)
    asked = vectors.withColumnRenamed("idx", "question_id")
    hits = search_ranked(vectors, asked, k=5).select(
        "question_id",
        "rank",
        F.concat(F.lit("title "), F.col("idx").cast("string")).alias("title"),
        F.when(F.col("idx") % 7 != 0, F.concat(F.lit("Channel "), F.col("user_id"))).alias(
            "channel_name"
        ),
        F.timestamp_seconds(F.col("idx") * 86400).alias("watched_at"),
    )
    return context.search_context(hits)


@_query
def vector_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Prompt and envelope of a search for every vector in its tenant, and of one more that finds nothing."""
    found = search_context(spark, folder)
    asked = mapping.tenant_vectors(spark, folder).select(F.col("idx").alias("question_id"))
    asked = asked.union(spark.range(1).select(F.lit(-1).cast("long")))
    rows = asked.join(found, "question_id", "left").withColumn("data_count", F.coalesce("data_count", F.lit(0)))
    question = F.concat(F.lit('"{context}" \\ '), F.col("question_id").cast("string"))
    prompt = context.vector_prompt(question, F.col("context"))
    answer = F.coalesce("context", F.lit(fixed.NO_HITS))
    envelope = context.answer_envelope(answer, F.col("data_count"), F.lit(fixed.SOURCE_VECTOR))
    return rows.select("question_id", F.md5(prompt).alias("prompt_md5"), envelope.alias("envelope"))


@_query
def prompt_data_block(spark: SparkSession, folder: str) -> DataFrame:
    """Data block of every user's recent history."""
    rows = as_result_strings(
        templates.recent_history(mapping.history(spark, folder))
    ).withColumn("rank", F.col("rank").cast("int"))
    columns = ["title", "channel_name", "watched_at"]
    lines = rows.select("user_id", "rank", context.json_object(columns).alias("line"))
    return context.data_blocks(lines, ["user_id"])


@_query
def data_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Summary of the top channels of every customer, most of whom have no data."""
    rows = templates.most_watched_channels(mapping.history(spark, folder))
    customers = mapping.table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("user_id")
    )
    return context.data_summary(rows, ["user_id"], ["channel_name", "watch_count"], customers)


@_query
def message_array(spark: SparkSession, folder: str) -> DataFrame:
    """Message list of every conversation with a new message at its end."""
    lists = context.message_lists(mapping.table(spark, folder, "conversations"))
    extended = context.append_message(F.col("messages"), F.lit("続けて"))
    return lists.select(
        "conv_id",
        F.size(extended).cast("bigint").alias("message_count"),
        F.array_join(F.transform(extended, lambda m: m["role"]), ",").alias("roles"),
        F.md5(F.array_join(F.transform(extended, lambda m: m["content"]), "\n")).alias(
            "contents_md5"
        ),
    )


@_query
def query_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return mapping.table(spark, folder, "documents").select(
        "doc_id", query_fingerprint(F.col("text")).alias("fingerprint")
    )


# --- Arrivals, uploads, status, retention -------------------------------------------------


@_query
def arrival_normalise(spark: SparkSession, folder: str) -> DataFrame:
    """Events as arrival notifications of both shapes, and some of neither."""
    n = F.col("event_id")
    key = F.concat_ws("/", F.lit("raw"), F.col("user_id"), F.concat(n, F.lit(".json")))
    s3 = '{"bucket":{"name":"b"},"object":{"key":"%s"}}'
    bus = F.format_string(
        '{"source":"aws.s3","detail-type":"Object Created","detail":' + s3 + "}", key
    )
    listed = F.format_string('{"Records":[{"s3":' + s3 + '},{"s3":' + s3 + "}]}", key, key)
    other = F.format_string('{"source":"other","detail-type":"x","detail":' + s3 + "}", key)
    body = F.when(n % 3 == 0, bus).when(n % 3 == 1, listed).otherwise(other)
    events = mapping.table(spark, folder, "events").select("event_id", body.alias("body"))
    return normalise_arrivals(events)


@_query
def path_filters(spark: SparkSession, folder: str) -> DataFrame:
    """User of raw and processed keys in good and bad forms."""
    n = F.col("event_id")
    user = F.col("user_id").cast("string")
    name = n.cast("string")
    raw = (
        F.when(n % 6 == 0, raw_key(user, F.concat(name, F.lit(".json"))))
        .when(n % 6 == 1, F.concat(F.lit("raw/"), user, F.lit("/deep/"), name, F.lit(".json")))
        .when(n % 6 == 2, F.concat(F.lit("raw/"), name, F.lit(".json")))
        .when(n % 6 == 3, F.concat(F.lit("raw//"), name, F.lit(".json")))
        .when(n % 6 == 4, F.concat(F.lit("raw/"), user, F.lit("/"), name, F.lit(".JSON")))
        .otherwise(F.concat(F.lit("other/"), user, F.lit("/"), name, F.lit(".json")))
    )
    processed = (
        F.when(n % 3 == 0, processed_key(user))
        .when(n % 3 == 1, F.concat(F.lit("processed/"), name, F.lit(".parquet")))
        .otherwise(vectors_key(user))
    )
    return mapping.table(spark, folder, "events").select(
        "event_id",
        user_of_raw_key(raw).alias("raw_user"),
        user_of_processed_key(processed).alias("processed_user"),
    )


@_query
def upload_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Every record as a small upload, good or broken in one of several ways."""
    n = F.col("src_pos")
    json = F.col("json")
    value = (
        F.when(n % 8 == 1, F.concat(F.lit("["), json))
        .when(n % 8 == 2, json)
        .when(n % 8 == 3, "[]")
        .when(n % 8 == 4, '[{"title":null,"time":null}]')
        .when(n % 8 == 5, F.concat(F.lit('[{"title":"x"},'), json, F.lit("]")))
        .when(n % 8 == 6, F.concat(F.lit("["), json, F.lit("] x")))
        .otherwise(F.concat(F.lit(" ["), json, F.lit(",5]\n")))
    )
    name = F.concat(n.cast("string"), F.when(n % 5 == 0, ".csv").otherwise(".json"))
    files = mapping.raw_json(spark, folder).select(
        "src_pos", name.alias("name"), value.alias("value")
    )
    return validate_uploads(files).select("src_pos", "valid", "reason")


@_query
def data_status(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as users; vectors are stored for the tenants."""
    customers = mapping.table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("user_id")
    )
    return status_of(customers, mapping.tenant_vectors(spark, folder))


@_query
def retention_expired(spark: SparkSession, folder: str) -> DataFrame:
    """Events as stored files; those two days older than the given moment."""
    files = mapping.table(spark, folder, "events").select(
        raw_key(F.col("user_id").cast("string"), F.concat("event_id", F.lit(".json"))).alias(
            "file_path"
        ),
        F.col("ts").cast("timestamp").alias("modified"),
    )
    return expired_files(files, as_of="2024-01-20 12:00:00")

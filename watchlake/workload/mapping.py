"""Benchmark tables as inputs of the library.

`events` becomes raw export records by fixed expressions; the same rules are stated as SQL
text for DuckDB in `oracles.py`.
"""

from __future__ import annotations

import os
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import partial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchlake.functions import fixed
from watchlake.operators.clean import parse_records, valid_rows
from watchlake.session import cut_lineage, dealt, prepare_session, spread_rows
from watchlake.sources.disk import on_disk, path_on_disk
from watchlake.sources.user_files import folder_name


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    prepare_session(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def raw_fields(spark: SparkSession, folder: str, of: DataFrame | None = None) -> DataFrame:
    """The fields of one export record per event; with `of` of its users (user_id) only."""
    n = F.col("event_id")
    number = n.cast("string")
    video = F.substring(F.md5(number), 1, 11)
    channel = F.concat(F.lit("Channel "), (n % 17).cast("string"))
    kind = F.col("event_type")
    title = (
        F.when(
            kind.isin("view", "click"), F.concat(F.lit("動画 "), number, F.lit(" を視聴しました"))
        )
        .when(kind == "purchase", F.concat(F.lit("clip "), number, F.lit("　を視聴しました")))
        .when(kind == "signup", F.concat(F.lit("Post "), number))
        .otherwise("YouTube のトップページで広告を視聴しました")
    )
    title_url = (
        F.when(n % 4 == 0, F.concat(F.lit("https://www.youtube.com/watch?v="), video))
        .when(n % 4 == 1, F.concat(F.lit("https://youtu.be/"), video))
        .when(n % 4 == 2, F.concat(F.lit("https://www.youtube.com/watch?t=5&v="), video))
    )
    channel_url = F.concat(
        F.lit("https://www.youtube.com/channel/UC"), F.substring(F.md5(channel), 1, 10)
    )
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type", "ts")
    if of is not None:
        # before rows are dealt, so that tasks get equal shares of what is left
        asked = of.select(F.col("user_id").alias("_user"))
        events = events.join(asked, events["user_id"].cast("string") == asked["_user"], "left_semi")
    return spread_rows(events, "event_id").select(
        n.cast("int").alias("src_pos"),
        F.col("user_id").cast("string").alias("user_id"),
        title.alias("title"),
        title_url.alias("titleUrl"),
        F.when(
            n % 11 != 0,
            F.array(
                F.struct(F.when(n % 13 != 0, channel).alias("name"), channel_url.alias("url"))
            ),
        ).alias("subtitles"),
        F.when(n % 97 == 0, "bad")
        .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        .alias("time"),
        F.when(kind == "error", F.array(F.struct(F.lit(fixed.AD_DETAIL_NAME).alias("name")))).alias(
            "details"
        ),
    )


def raw_json(spark: SparkSession, folder: str, of: DataFrame | None = None) -> DataFrame:
    """(user_id, src_pos, json): records as JSON text, NULL fields left out."""
    record = F.struct("title", "titleUrl", "subtitles", "time", "details")
    return raw_fields(spark, folder, of).select("user_id", "src_pos", F.to_json(record).alias("json"))


def export_files(records: DataFrame, root: str, name: str) -> None:
    """Write `{root}/raw/{user_id}/{name}`, one export of all records (user_id, src_pos, json, ending).

    A record is a line. `ending` is the same for all records of a user: "closed", "cut" (no closing bracket)
    or "empty" (an array of no elements). Rows are dealt over tasks by ranges of user and position, so a file
    of any size is written by many tasks, each from its own place on; the places are told by the
    sizes of the pieces of users in several tasks, which are at most two per task. Tasks open the files by
    themselves, where disks are shared; other file systems take them from Spark's writer.
    """
    spark = records.sparkSession
    # never null: else the writer would sort anew, by the user alone
    records = records.withColumn("user_id", F.coalesce("user_id", F.lit("")))
    if not on_disk(spark, root):
        _export_by_writer(records, root, name)
        return
    tasks = max(spark.sparkContext.defaultParallelism, -(-records.count() // EXPORT_ROWS))
    placed = cut_lineage(
        records.select("user_id", "src_pos", "json", "ending")
        .repartitionByRange(tasks, "user_id", "src_pos")
        .sortWithinPartitions("user_id", "src_pos")
        .withColumn("task", F.spark_partition_id())
    )
    of_user = Window.partitionBy("user_id").orderBy("task")
    earlier = F.sum("bytes").over(of_user.rowsBetween(Window.unboundedPreceding, -1))
    pieces = (
        # a comma or bracket and the end of line behind each record, the opening bracket before the first
        placed.groupBy("user_id", "task")
        .agg(F.sum(F.octet_length("json") + 2).alias("bytes"))
        .select("user_id", "task", (earlier + 1).alias("start"), F.lead("task").over(of_user).isNull().alias("last"))
        .where(F.col("start").isNotNull() | ~F.col("last"))
    )
    places = {(row["task"], row["user_id"]): (row["start"] or 0, row["last"]) for row in pieces.collect()}
    write = partial(_write_exports, path_on_disk(root), name, places)
    placed.mapInArrow(write, "files long").write.format("noop").mode("overwrite").save()


# Records that one task sorts and writes.
EXPORT_ROWS = 100_000


def _write_exports(root: str, name: str, places: dict, batches):
    """Write the records of one task, ordered by user and position; `places` has the users with more in other tasks.

    A task run again writes the same bytes to the same places.
    """
    user = file = None
    files = 0

    def close() -> None:
        if ending != "empty":
            file.write(b",\n" if not last else b"]\n" if ending == "closed" else b"\n")
        if last:
            file.truncate()
        file.close()

    for batch in batches:
        users, texts, endings = (batch[column] for column in ("user_id", "json", "ending"))
        runs = pc.run_end_encode(users)
        begin = 0
        for key, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
            if file is not None and key == user:
                file.write(b",\n" if ending != "empty" else b"")
            else:
                if file is not None:
                    close()
                user, ending = key, endings[begin].as_py()
                start, last = places.get((batch["task"][begin].as_py(), user), (0, True))
                if ending == "empty":
                    start, last = 0, start == 0
                folder = f"{root}/raw/{folder_name(user)}"
                os.makedirs(folder, exist_ok=True)
                file = os.fdopen(os.open(f"{folder}/{name}", os.O_WRONLY | os.O_CREAT, 0o644), "wb")
                file.seek(start)
                files += 1
                if start == 0:
                    file.write(b"[]\n" if ending == "empty" else b"[")
            if ending != "empty":
                file.write(",\n".join(texts.slice(begin, end - begin).to_pylist()).encode())
            begin = end
    if file is not None:
        close()
    yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})


def _export_by_writer(records: DataFrame, root: str, name: str) -> None:
    """The same by Spark's writer: a task writes a file as a stream.

    Spark gives a file its folder but not its name, so each is renamed at the end.
    """
    spark = records.sparkSession
    of_user = Window.partitionBy("user_id").orderBy("src_pos")
    first = F.row_number().over(of_user) == 1
    last = F.lead(F.lit(1)).over(of_user).isNull()
    empty = F.col("ending") == "empty"
    line = F.when(empty, "[]").otherwise(
        F.concat(
            F.when(F.col("first"), "[").otherwise(""),
            "json",
            F.when(~F.col("last"), ",").when(F.col("ending") == "closed", "]").otherwise(""),
        )
    )
    lines = (
        dealt(records, "user_id")
        .select("*", first.alias("first"), last.alias("last"))
        .where(~empty | F.col("first"))
        .select("user_id", line.alias("value"))
    )
    folder = f"{root}/unnamed-{uuid.uuid4().hex}"
    lines.write.partitionBy("user_id").text(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def rename(at) -> None:
        user = at.getParent().getName().removeprefix("user_id=")
        target = path(f"{root}/raw/{user}/{name}")
        files.mkdirs(target.getParent())
        if not files.rename(at, target):
            raise OSError(f"{at} could not be renamed to {target}")

    with ThreadPoolExecutor(16) as pool:
        written = files.globStatus(path(f"{folder}/user_id=*/part-*"))
        list(pool.map(lambda status: rename(status.getPath()), written))
    files.delete(path(folder), True)


def break_files(spark: SparkSession, folders: DataFrame, name: str) -> None:
    """Put a file that is not what its name says into each of these folders (column `folder`)."""
    folders = cut_lineage(dealt(folders.select("folder"), "folder"))
    here = on_disk(spark, F.col("folder"))
    folders.where(here).mapInArrow(partial(_break_folders, name), "files long").write.format("noop").mode("overwrite").save()
    path, settings = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()

    def write(row) -> None:
        target = path(f"{row['folder']}/{name}")
        with_bytes = target.getFileSystem(settings).create(target)
        with_bytes.writeBytes("broken")
        with_bytes.close()

    with ThreadPoolExecutor(16) as pool:
        list(pool.map(write, folders.where(~here).toLocalIterator()))


def _break_folders(name: str, batches):
    for batch in batches:
        for folder in batch["folder"].to_pylist():
            with open(f"{path_on_disk(folder)}/{name}", "wb") as file:
                file.write(b"broken")
        yield pa.RecordBatch.from_pydict({"files": pa.array([batch.num_rows], pa.int64())})


def set_times(files: DataFrame) -> None:
    """Give files (file_path, modified) their times, as if they had been written then."""
    spark = files.sparkSession
    rows = cut_lineage(dealt(files.select("file_path", F.unix_millis("modified").alias("at")), "file_path"))
    here = on_disk(spark, F.col("file_path"))
    rows.where(here).mapInArrow(_set_times, "files long").write.format("noop").mode("overwrite").save()
    path, settings = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()

    def set_time(row) -> None:
        target = path(row["file_path"])
        target.getFileSystem(settings).setTimes(target, row["at"], -1)

    with ThreadPoolExecutor(16) as pool:
        list(pool.map(set_time, rows.where(~here).toLocalIterator()))


def _set_times(batches):
    for batch in batches:
        for name, at in zip(batch["file_path"].to_pylist(), batch["at"].to_pylist(), strict=True):
            path = path_on_disk(name)
            os.utime(path, ns=(os.stat(path).st_atime_ns, at * 1_000_000))
        yield pa.RecordBatch.from_pydict({"files": pa.array([batch.num_rows], pa.int64())})


def parsed(spark: SparkSession, folder: str, of: DataFrame | None = None) -> DataFrame:
    """All records, or those of the users in `of`, through the JSON parser and the record rules."""
    records = raw_json(spark, folder, of).select(
        "user_id", "src_pos", F.try_parse_json("json").alias("rec")
    )
    return parse_records(records)


def history(spark: SparkSession, folder: str, of: DataFrame | None = None) -> DataFrame:
    """Cleaned rows: user_id, src_pos and the five columns."""
    return valid_rows(parsed(spark, folder, of))


def tenant() -> Column:
    """One of three tenants by the number of an event; the first has most of them."""
    last = F.col("src_pos") % 10
    return F.when(last < 8, "large").when(last == 8, "middle").otherwise("small")


def users(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(F.col("user_id").cast("string").alias("user_id"))


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """The user turns of all conversations; the conversation number is the asking user."""
    return (
        table(spark, folder, "conversations")
        .where(F.col("role") == "user")
        .select(
            (F.col("conv_id") * 100_000 + F.col("turn")).alias("question_id"),
            F.col("conv_id").cast("string").alias("user_id"),
            F.col("text").alias("question"),
        )
    )


def tenant_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as vector rows; the label is the tenant, vec_id the position."""
    return table(spark, folder, "embeddings").select(
        F.col("label").cast("string").alias("user_id"),
        F.col("vec_id").alias("idx"),
        "embedding",
    )

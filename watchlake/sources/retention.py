"""Retention: which stored files are older than the allowed age."""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor
from contextlib import suppress
from datetime import datetime, timezone
from functools import partial
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchlake.functions import fixed
from watchlake.session import cut_lineage, dealt
from watchlake.sources.disk import on_disk, path_on_disk


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, modified) of every file below `path`; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .select(F.col("path").alias("file_path"), F.col("modificationTime").alias("modified"))
    )


def expired_files(
    files: DataFrame, as_of: datetime | str, days: int = fixed.RETENTION_DAYS
) -> DataFrame:
    """Files whose last change lies more than `days` before `as_of`."""
    return files.where(F.col("modified") < _cutoff(as_of, days))


def kept_files(
    files: DataFrame, as_of: datetime | str, days: int = fixed.RETENTION_DAYS
) -> DataFrame:
    return files.where(F.col("modified") >= _cutoff(as_of, days))


def _cutoff(as_of: datetime | str, days: int):
    return F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))


# What became of a listed file.
DELETED = "deleted"
CHANGED = "changed"  # written anew since it was listed
GONE = "gone"

REPORT_SCHEMA = "file_path string, outcome string"


def _find(batches):
    for batch in batches:
        found = [os.path.exists(path_on_disk(name)) for name in batch["file_path"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["file_path"], pa.array(found, pa.bool_())], ["file_path", "found"])


def _remove(limit: int, batches):
    """Remove files last written before `limit` (in milliseconds), and what Hadoop's client keeps of them beside."""

    def remove(path: str, found: bool) -> str:
        try:
            if os.stat(path).st_mtime_ns // 1_000_000 >= limit or os.path.isdir(path):
                return CHANGED
            os.remove(path)
        except (FileNotFoundError, NotADirectoryError):
            return DELETED if found else GONE
        folder, name = os.path.split(path)
        with suppress(FileNotFoundError):
            os.remove(f"{folder}/.{name}.crc")
        return DELETED

    for batch in batches:
        names = batch["file_path"]
        paths = map(path_on_disk, names.to_pylist())
        outcomes = list(map(remove, paths, batch["found"].to_pylist()))
        yield pa.RecordBatch.from_arrays([names, pa.array(outcomes, pa.string())], ["file_path", "outcome"])


def delete_expired(
    files: DataFrame,
    as_of: datetime | str,
    report: str,
    days: int = fixed.RETENTION_DAYS,
    chunk: int = 10_000,
    threads: int = 16,
) -> DataFrame:
    """Delete the expired ones of `files` (file_path, modified); returns what became of each.

    A file's time is asked for again right before, and one that has been written anew stays. Files on disk are
    removed by tasks; which were there is stored first, so that a task run again reports them as deleted
    and not as gone. Those of other file systems are removed by the driver, a chunk of names at a time.
    The report is written to the folder `report`, which must be new. Safe to repeat: what is gone is reported as gone.
    """
    spark = files.sparkSession
    moment = spark.range(1).select(_cutoff(as_of, days).alias("at")).first()["at"]
    limit = int(moment.replace(tzinfo=moment.tzinfo or timezone.utc).timestamp() * 1000)
    hadoop, settings = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()

    def remove(name: str) -> tuple[str, str]:
        path = hadoop(name)
        system = path.getFileSystem(settings)
        if not system.exists(path):
            return name, GONE
        if system.getFileStatus(path).getModificationTime() >= limit:
            return name, CHANGED
        return name, DELETED if system.delete(path, False) else GONE

    expired = cut_lineage(dealt(expired_files(files, as_of, days).select("file_path"), "file_path"))
    here = on_disk(spark, F.col("file_path"))
    found = cut_lineage(expired.where(here).mapInArrow(_find, "file_path string, found boolean"))
    found.mapInArrow(partial(_remove, limit), REPORT_SCHEMA).write.parquet(report)
    names = (row["file_path"] for row in expired.where(~here).toLocalIterator())
    with ThreadPoolExecutor(threads) as pool:
        while some := list(islice(names, chunk)):
            done = list(pool.map(remove, some))
            spark.createDataFrame(done, REPORT_SCHEMA).write.mode("append").parquet(report)
    return spark.read.schema(REPORT_SCHEMA).parquet(report)

"""Raw export files: one JSON array per file, the user is part of the path."""

from __future__ import annotations

import os
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchlake.functions.binding import let
from watchlake.session import few_listing_tasks, stored
from watchlake.sources.disk import on_disk, path_on_disk

# VARIANT values are limited in size; larger files are read in pieces (large_files.py).
VARIANT_TEXT_BYTES = 64 * 1024 * 1024
# Longest list of paths or users that is broadcast; at some hundred bytes each it stays below 100 MB.
BROADCAST_PATHS = 200_000

BAD_UTF8 = "bad_utf8"
BAD_JSON = "bad_json"
NOT_AN_ARRAY = "not_an_array"
# One element of a file is larger than a VARIANT can be.
TOO_LARGE = "too_large"
NOT_AN_OBJECT = "not_an_object"

# Appended behind the file text: it is the second value only if the file is one whole value.
END_MARK = "\u241c end of file"


def user_of_raw_key(key: Column) -> Column:
    """User of `raw/{user}/.../{name}.json`; NULL for any other key."""
    parts = F.split(key, "/")
    user = F.get(parts, F.lit(1))
    valid = (
        key.endswith(".json")
        & (F.size(parts) >= 3)
        & (F.get(parts, F.lit(0)) == "raw")
        & (user != "")
    )
    return F.when(valid, user)


def user_of_processed_key(key: Column) -> Column:
    """User of `processed/{user}/.../{name}.parquet`; NULL for any other key."""
    parts = F.split(key, "/")
    valid = key.startswith("processed/") & key.endswith(".parquet") & (F.size(parts) >= 3)
    return F.when(valid, F.get(parts, F.lit(1)))


def key_below(path: Column, root: str) -> Column:
    """Object key of a file path: what follows the storage root (an absolute path), decoded."""
    bare = root.split("://")[-1].removeprefix("file:").rstrip("/") + "/"

    def below(decoded: Column) -> Column:
        at = F.locate(bare, decoded)
        return F.when(at > 0, F.substring(decoded, at + len(bare), F.length(decoded)))

    return let(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), below)


def with_user(files: DataFrame, root: str) -> DataFrame:
    """Add file_path, modified, file_size and user_id; files of no user are skipped."""
    return (
        files.select(
            "*",
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_modification_time").alias("modified"),
            F.col("_metadata.file_size").alias("file_size"),
        )
        .withColumn("user_id", let(key_below(F.col("file_path"), root), user_of_raw_key))
        .where(F.col("user_id").isNotNull())
    )


def _load(spark: SparkSession, reader, root: str, paths: list[str] | None) -> DataFrame:
    """All files below `{root}/raw`, or only those in `paths`."""
    reader = reader.option("recursiveFileLookup", True)
    with few_listing_tasks(spark):
        if paths is None:
            return reader.load(f"{root.rstrip('/')}/raw")
        # Names are not patterns.
        return reader.load([re.sub(r"([\[\]{}*?\\])", r"\\\1", path) for path in paths])


def scan_raw_files(spark: SparkSession, root: str, paths: list[str] | None = None) -> DataFrame:
    """Export files `{root}/raw/{user_id}/...json`, one row per file with its whole text.

    Files are listed once, here. Steps that do not use `value` do not open them.
    """
    files = _load(spark, spark.read.format("binaryFile"), root, paths)
    return with_user(files.select("path", F.col("content").cast("string").alias("value")), root)


def list_raw_files(spark: SparkSession, root: str, paths: list[str] | None = None) -> DataFrame:
    """The files of `scan_raw_files` without their texts, which `with_text` adds.

    On shared disks tasks list them, where Spark would take all their names through the driver in each step.
    """
    if not on_disk(spark, root):
        return scan_raw_files(spark, root, paths)
    if paths is None:
        top = path_on_disk(f"{root.rstrip('/')}/raw")
        with os.scandir(top) as entries:
            paths = [entry.path for entry in entries if not _is_hidden(entry.name)]
    names = pa.table({"path": pa.array(map(path_on_disk, paths), pa.string())})
    cores = spark.sparkContext.defaultParallelism
    listed = spark.createDataFrame(names).repartition(max(cores, -(-len(paths) // PATHS_PER_TASK)), "path")
    files = listed.mapInArrow(_list_files, "path string, file_path string, millis long, file_size long")
    return stored(
        files.select("path", "file_path", F.timestamp_millis("millis").alias("modified"), "file_size")
        .withColumn("user_id", let(key_below(F.col("file_path"), root), user_of_raw_key))
        .where(F.col("user_id").isNotNull())
    )


# Names that one task looks up, and files that it reads.
PATHS_PER_TASK = 2_000


def with_text(files: DataFrame, n_files: int | None = None) -> DataFrame:
    """Listed files with their whole text `value`; those that were scanned by Spark have it."""
    if "value" in files.columns:
        return files
    spark = files.sparkSession
    n_files = files.count() if n_files is None else n_files
    tasks = max(spark.sparkContext.defaultParallelism, -(-n_files // PATHS_PER_TASK))
    schema = T.StructType([*files.schema, T.StructField("_bytes", T.BinaryType())])
    read = files.repartition(tasks, "path").mapInArrow(_read_texts, schema)
    # bytes that are no UTF-8 stay what they are
    return read.withColumn("value", F.col("_bytes").cast("string")).drop("_bytes")


def _is_hidden(name: str) -> bool:
    """Names that Spark's readers skip."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _uri(path: str) -> str:
    """The name that Spark's readers give a file."""

    def quoted(found: re.Match) -> str:
        c = found[0]
        kept = c > "\x7f" and unicodedata.category(c) not in ("Zs", "Zl", "Zp", "Cc")
        return c if kept else "".join(f"%{byte:02X}" for byte in c.encode())

    return "file:" + re.sub(r"[^A-Za-z0-9_\-!.~'()*:@&=+$,;/]", quoted, path)


def _list_files(batches):
    """Files of these names, and those in folders of these names."""
    for batch in batches:
        found: list[tuple[str, str, int, int]] = []

        def add(path: str) -> None:
            try:
                status = os.stat(path)
            except FileNotFoundError:
                return
            # Spark's readers skip empty files
            if status.st_size and not _is_hidden(os.path.basename(path)):
                found.append((path, _uri(path), status.st_mtime_ns // 1_000_000, status.st_size))

        for path in batch["path"].to_pylist():
            if not os.path.isdir(path):
                add(path)
                continue
            for folder, folders, files in os.walk(path, followlinks=True):
                folders[:] = [name for name in folders if not _is_hidden(name)]
                for name in files:
                    add(f"{folder}/{name}")
        columns = list(zip(*found, strict=True)) if found else [()] * 4
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(column, kind) for column, kind in zip(columns, kinds, strict=True)],
            ["path", "file_path", "millis", "file_size"],
        )


# Bytes of texts that a reading task hands on at once, beyond those of one file.
_TEXT_BYTES = 16 * 1024 * 1024


def _read_texts(batches):
    for batch in batches:
        texts: list[bytes] = []
        begin = size = 0

        def taken(end: int) -> pa.RecordBatch:
            part = batch.slice(begin, end - begin)
            return pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], [*part.schema.names, "_bytes"])

        for number, path in enumerate(batch["path"].to_pylist()):
            with open(path, "rb") as file:
                texts.append(file.read())
            size += len(texts[-1])
            if size > _TEXT_BYTES:
                yield taken(number + 1)
                texts, begin, size = [], number + 1, 0
        if texts:
            yield taken(batch.num_rows)


def scan_pieces(spark: SparkSession, root: str, paths: list[str] | None = None) -> DataFrame:
    """The same files cut behind every closing brace, so that one file has many splits.

    `split` is the start of the piece's split in the file.
    """
    reader = spark.read.format("text").option("lineSep", "}")
    files = _load(spark, reader, root, paths)
    return with_user(files.withColumn("split", F.col("_metadata.file_block_start")), root)


def parse_file_text(files: DataFrame) -> DataFrame:
    """Add `doc` (VARIANT array or NULL) and `file_error` for files of VARIANT size.

    The parser stops after the first value. With a marker appended behind the text, an
    unclosed file or one with trailing text does not give exactly [array, marker]. What begins
    with anything but a bracket is no array, whether it is JSON or not; `explode_large` tells
    the two apart in the same way.
    """
    first = F.substring(F.btrim("value", F.lit(" \n\r\t")), 1, 1)
    whole = F.try_parse_json(F.concat(F.lit("["), F.col("value"), F.lit(f',"{END_MARK}"]')))
    return (
        files.withColumn("_whole", whole)
        .withColumn("_first", F.try_variant_get("_whole", "$[0]", "variant"))
        .withColumn(
            "file_error",
            F.when(~F.is_valid_utf8("value"), BAD_UTF8)
            .when((first != "[") & (first != ""), NOT_AN_ARRAY)
            .when(
                ~F.coalesce(
                    F.try_variant_get("_whole", "$[1]", "string").eqNullSafe(END_MARK)
                    & F.try_variant_get("_whole", "$[2]", "variant").isNull()
                    & F.schema_of_variant("_first").startswith("ARRAY"),
                    F.lit(False),
                ),
                BAD_JSON,
            ),
        )
        .withColumn("doc", F.when(F.col("file_error").isNull(), F.col("_first")))
        .drop("_whole", "_first")
    )


def explode_small(files: DataFrame) -> DataFrame:
    """One row per array element: user_id, file_path, modified, src_pos, rec (VARIANT), file_error.

    An unreadable file gives one row with its `file_error` and neither position nor record,
    so files are read and parsed once for both.
    """
    parsed = parse_file_text(files).select("user_id", "file_path", "modified", "doc", "file_error")
    elements = files.sparkSession.tvf.variant_explode_outer(F.col("doc").outer())
    return (
        parsed.lateralJoin(elements.alias("e"), how="left")
        .select(
            "user_id",
            "file_path",
            "modified",
            F.col("e.pos").alias("src_pos"),
            F.col("e.value").alias("rec"),
            "file_error",
            F.lit(False).alias("too_large"),
        )
        # An empty array is no error and has no elements.
        .where(F.col("src_pos").isNotNull() | F.col("file_error").isNotNull())
    )

"""Per-user vector documents (JSON): export and import."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchlake.functions import fixed
from watchlake.functions.timestamps import timestamp_text

_DOCUMENT = (
    "struct<user_id:string,count:int,dimension:int,first:int,vectors:array<array<float>>,"
    "texts:array<string>,metadata:array<struct<title:string,channel_name:string,"
    "video_id:string,watched_at:string>>>"
)


def vector_documents(
    vectors: DataFrame,
    dim: int = fixed.EMBEDDING_DIM,
    rows_per_document: int = fixed.MAX_SAMPLE_ROWS,
) -> DataFrame:
    """(user_id, part, document): header plus three arrays in the order of idx.

    A user within the sample limit has one document. A larger one has several, numbered by
    `part`, because idx is cut into ranges; so no group exceeds rows_per_document rows. `first`
    is the idx of a document's first row; idx counts without gaps.
    """
    metadata = F.struct(
        "title",
        "channel_name",
        "video_id",
        timestamp_text(F.col("watched_at")).alias("watched_at"),
    )
    item = F.struct("idx", F.col("embedding"), "text", metadata.alias("meta"))
    return (
        vectors.withColumn("part", F.floor(F.col("idx") / rows_per_document).cast("int"))
        .groupBy("user_id", "part")
        .agg(F.array_sort(F.collect_list(item)).alias("items"))
        .select(
            "user_id",
            "part",
            F.to_json(
                F.struct(
                    "user_id",
                    F.size("items").alias("count"),
                    F.lit(dim).alias("dimension"),
                    F.try_element_at("items.idx", F.lit(1)).alias("first"),
                    F.col("items.embedding").alias("vectors"),
                    F.col("items.text").alias("texts"),
                    F.col("items.meta").alias("metadata"),
                ),
                {"ignoreNullFields": "false"},
            ).alias("document"),
        )
    )


def write_documents(documents: DataFrame, path: str) -> None:
    """One JSON document per line, one folder per user; users not in `documents` stay."""
    (
        documents.select("user_id", "document")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("user_id")
        .text(path)
    )


def read_document_files(spark: SparkSession, path: str) -> DataFrame:
    """(document) of all files below `path`, one JSON document per line."""
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    return lines.select(F.col("value").alias("document"))


def read_documents(documents: DataFrame) -> DataFrame:
    """Vector rows of documents: the three arrays are zipped by position.

    Documents without `first` are a user's only one and start at 0.
    """
    parsed = documents.select(F.from_json("document", _DOCUMENT).alias("d"))
    parsed = parsed.withColumn("_first", F.coalesce("d.first", F.lit(0)))
    items = F.arrays_zip(
        F.col("d.vectors").alias("embedding"),
        F.col("d.texts").alias("text"),
        F.col("d.metadata").alias("meta"),
    )
    return parsed.select(
        F.col("d.user_id").alias("user_id"), "_first", F.posexplode(items).alias("_pos", "item")
    ).select(
        "user_id",
        (F.col("_first") + F.col("_pos")).alias("idx"),
        F.col("item.text").alias("text"),
        F.col("item.embedding").alias("embedding"),
        F.col("item.meta.title").alias("title"),
        F.col("item.meta.channel_name").alias("channel_name"),
        F.col("item.meta.video_id").alias("video_id"),
        F.to_timestamp("item.meta.watched_at").alias("watched_at"),
    )

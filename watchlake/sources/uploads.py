"""Checks made before an upload is accepted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchlake.sources.raw_files import parse_file_text

NOT_JSON_NAME = "not_json_name"
EMPTY_ARRAY = "empty_array"
MISSING_KEYS = "missing_keys"


def read_upload_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, value) of all files below `path`, to be validated."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
    return files.select(F.col("_metadata.file_name").alias("name"), "value")


def validate_uploads(files: DataFrame, name: str = "name") -> DataFrame:
    """Add `valid` and `reason` to (name, value) files.

    The name must end in .json, the text must be a JSON array, and its first element must
    have the keys title and time. Only keys are checked: their values may be null.
    """
    parsed = parse_file_text(files)
    first = F.try_variant_get("doc", "$[0]", "variant")
    reason = (
        F.when(~F.col(name).endswith(".json"), NOT_JSON_NAME)
        .when(F.col("file_error").isNotNull(), F.col("file_error"))
        .when(first.isNull(), EMPTY_ARRAY)
        .when(
            F.try_variant_get("doc", "$[0].title", "variant").isNull()
            | F.try_variant_get("doc", "$[0].time", "variant").isNull(),
            MISSING_KEYS,
        )
    )
    checked = parsed.withColumn("reason", reason).drop("doc", "file_error")
    return checked.withColumn("valid", F.col("reason").isNull())

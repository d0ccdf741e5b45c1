"""Top rows per key, safe when one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Up to this limit Spark cuts every group inside the map tasks, before the shuffle
# (spark.sql.optimizer.windowGroupLimitThreshold).
MAP_SIDE_LIMIT = 1000
# Intermediate groups per key for larger limits.
SALTS = 256


def top_per_key(
    df: DataFrame, keys: list[str], order: list[Column], limit: int, rank: str = "rank"
) -> DataFrame:
    """The first `limit` rows of every key in the given total order, numbered from 1.

    Small limits: the row_number filter becomes a partial and a final group limit, so a task
    sends at most `limit` rows per key. Large limits: rows are first ranked within (key, map
    task number modulo SALTS); each such group keeps `limit` rows, which still contain the
    overall first `limit`. The last step then sees at most SALTS * limit rows of any key.
    """
    if limit > MAP_SIDE_LIMIT:
        salted = df.withColumn("_salt", F.spark_partition_id() % SALTS)
        inner = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            salted.withColumn("_inner", F.row_number().over(inner))
            .where(F.col("_inner") <= limit)
            .drop("_inner", "_salt")
        )
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= limit)

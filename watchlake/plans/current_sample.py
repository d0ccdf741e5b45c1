"""The exact sample of each user kept current as rows arrive, without reading earlier rows.

A row's place in the sample depends on its position alone, so the smallest of two sets of rows are among the
smallest of each: the state holds one row more per user than the sample, and a batch brings its own smallest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchlake.functions import fixed
from watchlake.operators.ranking import top_per_key
from watchlake.operators.sampling import sample_order, sample_per_user
from watchlake.sources.merged_state import MergedState


class CurrentSample:
    """State below `path` for rows (user_id, `position`, and the other columns of the DDL `schema`)."""

    def __init__(
        self,
        path: str,
        schema: str,
        position: str,
        limit: int = fixed.MAX_SAMPLE_ROWS,
        seed: int = fixed.SAMPLE_SEED,
        every: int = 10,
    ):
        self.position, self.limit, self.seed = position, limit, seed

        def smallest(rows: DataFrame) -> DataFrame:
            names = rows.columns
            # a row may stand in several batches
            digest = rows.dropDuplicates(["user_id", position]).withColumn("_digest", sample_order(F.col(position), seed))
            # one row more than asked for tells which users have too many
            top = top_per_key(digest, ["user_id"], [F.col("_digest"), F.col(position)], limit + 1, rank="_rank")
            return top.select(*names)

        self.state = MergedState(path, schema, ("user_id",), smallest, every)

    def add(self, rows: DataFrame, batch: int) -> None:
        """Take in the rows of a batch; run again it changes nothing."""
        self.state.add(self.state.merge(rows), batch)

    def sample(self, spark: SparkSession) -> DataFrame:
        """`sample_per_user` of all rows so far."""
        return sample_per_user(self.state.read(spark), self.position, self.limit, self.seed)

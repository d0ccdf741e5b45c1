"""Helpers shared by the operators: stored intermediate tables, word patterns, clash-free names."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from watchlake.session import shared_dir

#: A word is a run of anything but blank, tab, newline, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared folder of the cluster; it goes when the session's JVM ends."""
    folder = f"{shared_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once as Parquet into the shared folder and go on from that copy.

    The copy cuts the lineage and outlives lost executors.
    """
    folder = run_folder(df.sparkSession, name)
    df.write.parquet(folder)
    copy = df.sparkSession.read.schema(df.schema).parquet(folder)
    copy.stored_at = folder
    return copy


def release(*copies: DataFrame) -> None:
    """Remove what `stored` wrote for these, once nothing that is still to be computed reads it."""
    for copy in copies:
        spark = copy.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(copy.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_digest(text: Column) -> Column:
    """Half of a text's SHA-256: with it a row is told from others of its key. Rows equal in both are equal."""
    return F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16)


def numbered(df: DataFrame, order: list[Column], number: str, part: str = "__part") -> DataFrame:
    """`df` with `number` from 0 in the order of `order`, which should tell rows apart, and `part`.

    Ranges of the order go to one task each; a row's number is the rows of the ranges before and its
    place in its own. `part` names the range; there are at most as many as shuffle partitions, so
    their starts are broadcast. Rows are stored once, sorted.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    table = stored(ranged.withColumn("__at", F.monotonically_increasing_id()), "order")
    table = table.withColumn(part, F.shiftright("__at", 33))
    sizes = table.groupBy(F.col(part).alias("__of")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__of", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    placed = table.join(F.broadcast(starts), F.col(part) == F.col("__of"))
    inside = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn(number, F.col("__start") + inside).drop("__at", "__of", "__n", "__start")


class Masked:
    """A table under column names of our own, so that no name in it can clash with one of ours.

    Columns called `replaced`, in any case, are left out at the end.
    """

    def __init__(self, df: DataFrame, replaced: tuple[str, ...] = ()):
        self.names = df.columns
        self.df = df.toDF(*(f"c{i}" for i in range(len(self.names))))
        self.kept = [i for i, name in enumerate(self.names) if name.lower() not in replaced]

    def at(self, name: str) -> str:
        """What the column `name` is called here."""
        return f"c{self.names.index(name)}"

    def columns(self) -> list[str]:
        return [f"c{i}" for i in self.kept]

    def fields(self, more: str) -> StructType:
        """The kept columns and further ones, as a schema."""
        own = [StructField(f"c{i}", self.df.schema[i].dataType) for i in self.kept]
        return StructType(own + StructType.fromDDL(more).fields)

    def back(self, df: DataFrame, *more: str | Column) -> DataFrame:
        """The kept columns under their own names, and `more`."""
        return df.select(*(F.col(f"c{i}").alias(self.names[i]) for i in self.kept), *more)


def column(name: str) -> Column:
    """The column called exactly `name`, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def document_table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand rows with long texts to Python in smaller batches, unless the session says how many."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))

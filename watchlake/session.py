"""Session settings the library relies on, and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings that change results, so every entry point pins them.
RESULT_SETTINGS = {
    # watched_at is an instant; days are UTC days.
    "spark.sql.session.timeZone": "UTC",
    # A JSON object that repeats a key keeps the last value instead of failing the file.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

# Rows of a table that one task opens, where rows are short and take much work.
ROWS_PER_TASK = 25_000


def prepare_session(spark: SparkSession) -> SparkSession:
    """Pin the settings that results depend on; safe to call repeatedly."""
    for key, value in RESULT_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(
    app: str = "watchlake", master: str | None = None, shuffle_partitions: int | None = None
) -> SparkSession:
    """Create a session for local use; on a cluster the submitter's settings win."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master).config("spark.driver.memory", "12g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in RESULT_SETTINGS.items():
        builder = builder.config(key, value)
    return prepare_session(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by the cluster.

    Only where the cluster names none (local tests) a temporary folder is set.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder and not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    if folder or context.getCheckpointDir():
        return folder or context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    folder = tempfile.mkdtemp(prefix="watchlake-")
    context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Store `df` in the shared folder and go on from the stored rows.

    For results that several later steps read. The copy outlives lost executors.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Store `df` as a table in the shared folder, until the session ends, and go on from that.

    Against `cut_lineage` a later step reads only the columns it needs, and Spark knows the size;
    partitions and their order are not kept.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


@contextmanager
def kept(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that stores tables as `stored` does, but only until the block ends."""
    folder = f"{shared_dir(spark).rstrip('/')}/kept-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.deleteOnExit(path)

    def keep(df: DataFrame) -> DataFrame:
        at = f"{folder}/{uuid.uuid4().hex}"
        df.write.parquet(at)
        return spark.read.schema(df.schema).parquet(at)

    try:
        yield keep
    finally:
        files.delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """Use idle cores for a scan that has fewer splits than the session has cores.

    A large scan has more splits than cores and is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def spread_rows(df: DataFrame, *keys) -> DataFrame:
    """Rows of a table over tasks of about `ROWS_PER_TASK` rows, by keys that tell rows apart.

    For short rows that take much work each: the bytes of a file, by which a scan is split, don't tell that,
    and a file of few row groups has few splits with rows. The count reads footers only.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // ROWS_PER_TASK)), *keys)


def dealt(df: DataFrame, *keys) -> DataFrame:
    """Rows of equal keys together, over as many tasks as the session shuffles to.

    For rows that are written to a folder per key: what that takes is told by the number of folders, and
    AQE, which merges small partitions, looks at bytes.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
# What the setting is if nobody has set it.
_LISTING_DEFAULT = "10000"


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """While a table of very many folders is opened, list them by some tasks a core.

    Spark starts a task per folder, up to 10,000, which takes longer than to list one. A number that the session
    states stays as it is.
    """
    before = spark.conf.get(_LISTING, None)
    if before not in (None, _LISTING_DEFAULT):
        yield
        return
    spark.conf.set(_LISTING, str(max(32, 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_LISTING)
        else:
            spark.conf.set(_LISTING, before)


def is_small(df: DataFrame, max_rows: int) -> bool:
    """True if `df` has at most `max_rows` rows; reads no more than one row beyond."""
    return df.limit(max_rows + 1).count() <= max_rows

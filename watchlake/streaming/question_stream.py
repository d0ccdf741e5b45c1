"""Questions as they come in -> answer contexts, each question answered once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from watchlake.operators.embedding import Embedder
from watchlake.plans.answers import answer_batch
from watchlake.session import cut_lineage, kept, prepare_session
from watchlake.sources.tables import path_exists, read_history, read_whole_users

QUESTION_SCHEMA = "question_id long, user_id string, question string"
ANSWER_SCHEMA = (
    "question_id long, user_id string, question string, route string, source string, plan string, "
    "data_count long, context string, prompt string, system_prompt string, batch long"
)


def question_stream(spark: SparkSession, folder: str, files_per_batch: int = 1_000) -> DataFrame:
    """Stream of the questions in a folder of JSON lines."""
    return (
        spark.readStream.schema(QUESTION_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(folder)
    )


def answer_questions(
    questions: DataFrame, batch_id: int, history: str, vectors: str, out: str, embedder: Embedder | None = None, **options
) -> None:
    """Answer the questions of a batch from the tables as they are now, and write them to `out`.

    A question that stands in the batch repeatedly is taken once, that of the smallest text; one that an
    earlier batch has answered is left out. A batch that is run again replaces its own answers only.
    """
    spark = prepare_session(questions.sparkSession)
    first = F.min(F.struct("user_id", "question")).alias("one")
    new = questions.groupBy("question_id").agg(first).select("question_id", "one.*")
    new = cut_lineage(new)
    if path_exists(spark, out):
        # one column of earlier answers is read; those met again are no more than the batch has questions
        earlier = read_answers(spark, out).where(F.col("batch") != batch_id).select("question_id")
        met = earlier.join(new.select("question_id"), "question_id", "left_semi")
        new = cut_lineage(new.join(met, "question_id", "left_anti"))
    asking = new.select("user_id").distinct()
    # templates and search take several steps each: files of these users are opened once, in the first
    with kept(spark) as keep:
        rows = keep(read_history(spark, history, users=asking))
        stored = keep(read_whole_users(spark, vectors, asking))
        answers = answer_batch(new, rows, stored, embedder, **options)
        (
            answers.withColumn("batch", F.lit(batch_id).cast("long"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch")
            .parquet(out)
        )


def read_answers(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(ANSWER_SCHEMA).parquet(out)


def start(
    spark: SparkSession,
    folder: str,
    history: str,
    vectors: str,
    out: str,
    checkpoint: str,
    embedder: Embedder | None = None,
    files_per_batch: int = 1_000,
    trigger: dict | None = None,
    **options,
) -> StreamingQuery:
    """Start the query; by default it answers all new questions and stops."""
    prepare_session(spark)
    return (
        question_stream(spark, folder, files_per_batch)
        .writeStream.foreachBatch(
            lambda questions, batch_id: answer_questions(questions, batch_id, history, vectors, out, embedder, **options)
        )
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )

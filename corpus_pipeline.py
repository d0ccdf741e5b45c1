"""From raw documents to token ids: clean, drop near duplicates, cut repeats, mix, encode.

Each stage takes all that the one before it kept. All but the last return the columns of documents;
n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchlake.llm import mixing, neardup, pieces, quality, repeats
from watchlake.llm.common import document_table, stored
from watchlake.llm.queries import MODEL


def _with_text(docs: DataFrame, text) -> DataFrame:
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("text", text).withColumn("n_chars", F.length("text").cast(kind))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that failed."""
    judged = quality.line_first(docs).where("quality.kept")
    return _with_text(judged, F.col("quality.text")).drop("quality")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return neardup.keep_one(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that stand anywhere twice."""
    cut = repeats.remove_repeats(docs).drop("removal")
    return _with_text(cut, F.col("text"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids."""
    coded = pieces.encode(docs, MODEL, keep=["doc_id", "lang", "source"])
    return coded.select(
        "doc_id", "lang", "source", "encoding.n_tokens", "encoding.ids", "encoding.ids_sha256", "encoding.round_trip"
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("suffix_dedup", suffix_dedup),
    ("mixing", mix),
    ("sentencepiece", token_ids),
]

#: SQL can't express the last stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each from the stored result of the one before."""
    docs = document_table(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The registered queries of the operators: each applies one to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchlake.llm import (
    chat,
    fingerprints,
    licences,
    merkle,
    mixing,
    neardup,
    pieces,
    quality,
    repeats,
    resampling,
    sharding,
    topk,
    warc,
)
from watchlake.llm.common import document_table, numbered, run_folder, stored


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = run_folder(spark, "warc")
    warc.write_archive(document_table(spark, sf_dir, "pages"), path)
    return warc.page_rows(warc.read_archive(spark, path))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = document_table(spark, sf_dir, "embeddings")
    return topk.top_products(table, every=50, vector="embedding")


SHARDS = [f"shard-{i:03d}" for i in range(256)]


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(document_table(spark, sf_dir), "doc_id", SHARDS).select(
        "doc_id", "slot", "shard"
    )


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = "</s>[INST] ok [/INST]"
    rows = document_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(plain).alias("text"),
    )
    turns = rows.unionByName(extra).withColumn("parts", chat.text_part(F.col("text")))
    df = chat.format_chats(turns).withColumn("read", chat.parse(F.col("formatted")))
    said = F.transform("read", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n")))
    learnt = F.array_join(F.transform(F.filter("read", lambda t: t.in_loss), lambda t: t.text), "")
    return df.select(
        "conv_id",
        F.size("read").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(said, "").cast("binary"), 256).alias("turns_sha256"),
        F.length(learnt).cast("bigint").alias("loss_chars"),
        F.sha2(learnt.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        F.size("attachments").cast("bigint").alias("n_attachments"),
    )


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = neardup.near_duplicates(document_table(spark, sf_dir), shingle=4)
    return marks.select("doc_id", "n_shingles", "component_id", "kept")


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan_licences(document_table(spark, sf_dir), keep=["doc_id"])
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    return found.select("doc_id", *(F.col(f"licences.{name}").alias(name) for name in names))


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What `op6_license_scans` says of the base phrases, which SQL can say too."""
    return op6_license_scans(spark, sf_dir).drop("labels", "score")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.line_first(document_table(spark, sf_dir)).select(
        "doc_id",
        "quality.n_words",
        "quality.word_chars",
        "quality.n_symbols",
        "quality.n_dup_lines",
        "quality.n_repeat_words",
        "quality.base_failed",
        "quality.kept",
        "quality.n_lines_removed",
        "quality.chars_removed",
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.systematic_mix(document_table(spark, sf_dir)).select(
        "doc_id",
        F.col("mix.size").alias("size"),
        "mix.source_size",
        "mix.target",
        (F.col("mix.copies") * F.col("mix.size")).alias("taken"),
    )


#: The vocabulary of the registered query and the pipeline; only the driver reads the file.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode(document_table(spark, sf_dir), MODEL, keep=["doc_id"])
    return coded.select(
        "doc_id", "encoding.n_tokens", "encoding.ids_sha256", "encoding.round_trip"
    )


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = repeats.remove_repeats(document_table(spark, sf_dir))
    return docs.select(
        "doc_id", "removal.n_bytes", "removal.n_removed", "removal.n_spans", "removal.kept_sha256"
    )


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(
        document_table(spark, sf_dir), document_table(spark, sf_dir, "benchmark"), keep=["doc_id"]
    )
    names = ["n_features", "weight", "score", "rank"]
    return drawn.select("doc_id", *(F.col(f"resampling.{name}").alias(name) for name in names))


def next_documents(docs: DataFrame) -> DataFrame:
    """(row, next, taken) for rows (row, doc_id, n_chars): the next row by descending doc_id, null last,
    after the last the first, and a third of the row's length."""
    placed = numbered(docs, [F.desc_nulls_last("doc_id"), F.col("row")], "at")
    every = placed.count()
    own = placed.select("row", F.expr("n_chars div 3").cast("int").alias("taken"), F.pmod(F.col("at") + 1, F.lit(max(every, 1))).alias("then"))
    return own.join(placed.select(F.col("row").alias("next"), "at"), F.col("then") == F.col("at")).select("row", "next", "taken")


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a row's file and place in it tell rows apart in every scan
    row = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    docs = document_table(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), row.alias("row"))
    links = stored(next_documents(docs.select("row", "doc_id", F.length("text").cast("bigint").alias("n_chars"))), "next")
    # codes are made from samples at the end, so that joins needn't carry both
    own = fingerprints.fingerprint(docs, keep=["doc_id", "row"])
    own = stored(own.select("doc_id", "row", F.col("fingerprint.samples").alias("own")), "fingerprints")
    given = docs.join(links, docs["row"] == links["next"]).select(
        links["row"].alias("to"), F.substring("text", F.lit(1), F.col("taken")).alias("begin"), "taken"
    )
    left = F.substring("text", F.lit(1), F.length("text") - F.col("taken"))
    edited = docs.join(given, F.col("row") == F.col("to")).select(
        "row", F.length("text").cast("bigint").alias("n_chars"), F.concat(left, F.col("begin")).alias("text")
    )
    edited = edited.select("*", F.sha2(F.col("text").cast("binary"), 256).alias("edited_sha256"))
    changed = fingerprints.fingerprint(edited).select(
        F.col("row").alias("of"), "n_chars", "edited_sha256", F.col("fingerprint.samples").alias("edited")
    )
    after = own.select(F.col("row").alias("other"), F.col("own").alias("after"))
    return (
        own.join(changed, F.col("row") == F.col("of"))
        .join(links.select(F.col("row").alias("one"), "next"), F.col("row") == F.col("one"))
        .join(after, F.col("next") == F.col("other"))
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            fingerprints.code_of(F.col("own")).alias("fingerprint"),
            fingerprints.code_of(F.col("edited")).alias("edited_fingerprint"),
            fingerprints.likeness(F.col("own"), F.col("edited")).alias("near_edited"),
            fingerprints.likeness(F.col("own"), F.col("after")).alias("near_next"),
        )
    )


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = document_table(spark, sf_dir)
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = F.translate("text", fingerprints.UPPER, fingerprints.LOWER)
    claimed = merkle.leaf_digest(*(F.when(hit, lowered).otherwise(F.col(f)) if f == "text" else F.col(f) for f in fields))
    found = merkle.manifest(docs.withColumn("claimed", claimed), fields, keep=["doc_id", "claimed"])
    folded = found.select("doc_id", "merkle", merkle.fold(F.col("claimed"), F.col("merkle.path")).alias("folded_root"))
    return folded.select(
        "doc_id",
        "merkle.leaf",
        "merkle.subroot",
        "merkle.root",
        merkle.proof_digest(F.col("merkle.path")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("merkle.root")).alias("verified"),
    )


QUERIES = {
    "op1_warc": op1_warc,
    "op2_topk": op2_topk,
    "op3_sharding": op3_sharding,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_minhash": op5_minhash,
    "op6_license_scans": op6_license_scans,
    "license_base": license_base,
    "op7_quality_rules": op7_quality_rules,
    "op8_mixing": op8_mixing,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_resampling": op11_resampling,
    "op12_fingerprints": op12_fingerprints,
    "op13_merkle": op13_merkle,
}

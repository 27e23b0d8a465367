"""The corpus operators as registered queries, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm import chat, chat_repair, licences, line_dedup, neighbours, quality, toxicity
from tickerloom.llm.alignment import aligned_documents
from tickerloom.llm.decontaminate import benchmark_matches
from tickerloom.llm.near_dedup import near_duplicates
from tickerloom.llm.packing import packed_documents
from tickerloom.llm.paragraph_dedup import repeated_paragraphs
from tickerloom.llm.suffix_dedup import repeated_bytes

#: Labels are learnt from these rows only; ``d`` is the document's id.
TOXIC_FOLD = "crc32(CAST(d AS string)) % 5 <> 0"
QUALITY_FOLD = "crc32(CAST(d AS string)) % 4 <> 2"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _judged(scores: DataFrame, held_out: str, least: float) -> DataFrame:
    return scores.select("doc_id", F.expr(held_out).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licences(_table(spark, sf_dir, "documents"))


def op2_toxic_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), TOXIC_FOLD)
    return _judged(toxicity.score(docs, model), "crc32(CAST(doc_id AS string)) % 5 = 0", 0.5)


def op3_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(_table(spark, sf_dir, "documents"), RANKS)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), QUALITY_FOLD)
    return _judged(scores, "crc32(CAST(doc_id AS string)) % 4 = 2", 0.7)


def op6_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_paragraphs(_table(spark, sf_dir, "documents")).drop("class")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_segments(_table(spark, sf_dir, "conversations"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(_table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), words=2, percent=80)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.repair_digest(chat_repair.damaged(_table(spark, sf_dir, "conversations")))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digest(_table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned_documents(_table(spark, sf_dir, "documents"), RANKS, PIECES)


QUERIES = {f.__name__: f for f in (
    op1_license_scan, op2_toxic_passages, op3_multiprobe_neighbours, op4_best_fit_packing, op5_quality_classifier, op6_paragraph_dedup,
    op7_chat_formatting, op8_benchmark_decontamination, op9_suffix_array_dedup, op10_minhash_near_dedup,
    op11_conversation_repair, op12_line_dedup, op13_token_alignment,
)}
ORACLES = {"op1_license_scan": licences.licences_sql(), "op7_chat_formatting": chat.CHAT_SQL, "op12_line_dedup": line_dedup.LINES_SQL}

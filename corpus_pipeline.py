"""A training corpus from raw documents: clean, deduplicate, decontaminate, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickerloom.llm import toxicity
from tickerloom.llm.decontaminate import decontaminated
from tickerloom.llm.near_dedup import one_of_each
from tickerloom.llm.packing import packed_documents
from tickerloom.llm.paragraph_dedup import without_repeats
from tickerloom.llm.queries import RANKS, TOXIC_FOLD
from tickerloom.scratch import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under a toxicity score of 0.5, by a model of the labelled ones among them."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), TOXIC_FOLD)
    return toxicity.without_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word-shingle similarity 0.8."""
    return one_of_each(docs)


def cut_repeated_paragraphs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Paragraphs that stand in an earlier document or place go, the rest of the text stays."""
    return without_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenised pieces with their place in sequences of 1024 tokens."""
    return packed_documents(docs, RANKS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("paragraph_dedup", cut_repeated_paragraphs),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]
#: The stages cannot be said in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result stored and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

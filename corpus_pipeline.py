"""The corpus pipeline: STAGES applied in order to documents, each one's rows written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparktide.llm import minhash, mixing, packing, substring
from sparktide.llm import toxicity as tox
from sparktide.llm.common import Scratch


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go. The classifier is trained on labels and the documents they name."""
    return tox.drop_toxic(docs, tox.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return minhash.drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that occurred before are cut; documents without a word left go."""
    return substring.drop_repeated_passages(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to target weights; a document then occurs as often as it is to be read."""
    return mixing.mix_sources(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, or copy of one, is given its place in bins: bin_id, doc_id, piece, start_token, n_tokens."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mixing", mix), ("packing", pack)]

#: The trained classifier, signatures and local search can't be said in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for sf_dir's documents."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES:
        out = scratch.save(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        docs = before = out
    return docs

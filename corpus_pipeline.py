"""From raw documents to packed training sequences, in five stages.

Toxic documents go, then exact copies, then near copies; the rest is weighted to target shares by repeats and packed into windows. Each
stage gets what the one before kept, as a table of documents, and returns the same columns; only the last one returns pieces.
Empty tables pass through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from wayline.llm.common import scratch
from wayline.llm.queries import END_ID, TOKENIZER, WEIGHTS, domain_labels
from wayline.plans.registry import Query


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below its limit."""
    labels = _labels(spark, sf_dir).select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(docs, labels)
    return toxicity.score(docs, model, added="__toxicity").where(F.col("__toxicity") < toxicity.LIMIT).drop("__toxicity")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of texts that are equal but for white space."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of documents linked by a Jaccard similarity of at least 0.8 of their five-word shingles."""
    return ngram_join.drop_near_duplicates(docs, width=5, share=80)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, and those of domains scarce next to their weight as often as the target weights ask for."""
    return mixing.mixed_rows(docs, domain_labels(_labels(spark, sf_dir)), WEIGHTS, least=1.0)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in the sequences."""
    pieces = packing.pack(docs, public_tokenizers.path(TOKENIZER), end_id=END_ID)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("mixing", mix_domains),
    ("packing", pack_windows),
]

#: Classifiers and tokenizers have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch(stage(spark, docs, sf_dir), name)
    return docs


PIPELINE = Query(run, ORACLE_SQL)

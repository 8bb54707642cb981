"""From raw documents to training sequences: toxicity, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame; all but the last return the columns of
``documents``. Rows with null or blank texts pass the filters; the packing stage gives each its end id.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestat.llm import jaccard, packing, recompress, token_counts, toxicity

#: Words of a repeated passage that the dedup stage removes.
PASSAGE = 50


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, trained on those of them with labels, does not reject."""
    chain = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), toxicity.CATEGORIES)
    return toxicity.without(docs, chain, "toxic")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingle similarities of 0.8 or more."""
    return jaccard.near_copies_removed(docs, 5, 4, 5)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words or more that stand earlier in the corpus."""
    return recompress.without_repeats(docs, PASSAGE)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two lengths up to 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2, 4096)


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", drop_near_copies), ("substring_dedup", drop_passages), ("packing", pack)]

#: Tokenizers, classifiers and exact near-copy components are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = token_counts.shared_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: each stage takes (spark, docs, sf_dir), and all but the last return the columns of documents.

run() writes each stage's rows as Parquet in the shared folder and reads them back as the next one's input, so
a lost executor costs no earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dupweave.llm import decontaminate, mixing, ngram_join, quality, sharding
from dupweave.llm.common import remove_folder, shared_folder, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the ordinal classifier rejects."""
    return quality.keep_good(docs, quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate class."""
    return ngram_join.keep_one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents into which a benchmark item leaks."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources come to their target weights."""
    return mixing.emit_copies(docs)


def sharding_by_table(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add each document's slot and shard."""
    return sharding.assign_shards(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mixing_to_weights),
    ("sharding", sharding_by_table),
]

#: The first two stages (a fitted model, near-duplicate classes) have no SQL form; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Of the stages' rows only what the next stage reads is kept; the last one's input stays."""
    folder = shared_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{number}")
            docs = spark.read.parquet(f"{folder}/{number}")
            remove_folder(spark, f"{folder}/{number - 1}")
    return docs

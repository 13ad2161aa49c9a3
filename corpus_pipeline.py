"""Corpus pipeline: five stages over documents, each one operator of logquarry.llm.

A stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the columns of
documents; the last returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.llm import decontam, linededup, neardup, packing, quality
from logquarry.llm.common import documents, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: SQL can express neither the fitted classifier nor fingerprints, alignments and token ids.
ORACLE_SQL = None


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, fitted on this input's labelled rows, predicts as label 0 go."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).where("predicted = 1").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of two and more lines go from the texts; n_chars follows the text."""
    return linededup.dedup(docs, linededup.PASSAGES).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by five-word shingles of similarity 0.8 one document stays: that of the smallest id.

    Fingerprints of 128 bits are compared by bit planes inside buckets; links are confirmed exactly.
    """
    return neardup.keep_first(docs).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), max_length=4096, end_id=2)


STAGES = [("quality", quality_filter), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs

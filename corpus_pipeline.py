"""The corpus pipeline: quality filter, exact and near deduplication, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns the rows that it keeps
with the columns of ``documents``; the last one returns the packed pieces. ``run`` writes each stage's result as Parquet
below the shared folder and rereads it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.llm import decontaminate, exact_dedup, packing, quality, simhash
from massloom.llm.common import read, without_ids, written
from massloom.llm.queries import BYTE_BPE, BYTE_RANKS, GOOD


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labelled rows outside the held-out fold, scores below GOOD go.

    Null texts are scored as empty ones; rows that repeat are each scored; an empty table gives no rows.
    """
    model = quality.train(docs, read(spark, sf_dir, "labels").filter(~quality.held_out()))
    return quality.keep(docs, model, GOOD)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal up to white space, the row with the smallest id stays."""
    return exact_dedup.keep_first(docs)


KEY = "__document"


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a key that is never null, sorts as doc_id does (nulls last) and tells rows with the same id and other texts apart."""
    return docs.withColumn(KEY, F.struct(F.col("doc_id").isNull().alias("void"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("said")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts whose five-word shingles have a Jaccard similarity of 0.8 or more, the document with the smallest id stays (null ids last; of the same id, one text)."""
    keyed = _keyed(docs)
    found = simhash.near_copies(keyed, id_col=KEY)
    return without_ids(keyed, found.filter(~F.col(KEY).eqNullSafe(F.col("component_id"))), KEY).drop(KEY)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; others with the same or no id stay."""
    keyed = _keyed(docs)
    found = decontaminate.contamination(keyed, read(spark, sf_dir, "benchmark"), id_col=KEY)
    return without_ids(keyed, found.filter("n_hit > 0"), KEY).drop(KEY)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in windows of 2048. Null and empty texts are the end id alone; null ids stay; rows that repeat are each packed; an empty table gives no rows."""
    return packing.pack(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.path(BYTE_RANKS))


STAGES = [("quality", quality_filter), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("decontaminate", benchmark_leaks), ("packing", packed)]

#: Trained models and tokenizers are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

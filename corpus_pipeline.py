"""A cleaning pipeline over `documents`: each stage works on what the stage before it kept.

Stages take and give tables with the columns of `documents`; the last gives the packed pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from parapet.llm import exact, jaccard, packing, quality, secrets
from parapet.llm._shared import read_table, shared_dir
from parapet.sources.shared import discard, passing


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines are removed; documents that fail, or lose too much text, go."""
    return quality.clean(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.drop_copies(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind."""
    return secrets.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.production(docs)


STAGES = [("quality rules", quality_rules), ("exact dedup", exact_dedup), ("n-gram Jaccard join", ngram_jaccard), ("secret scan", secret_scan), ("packing", pack)]

#: Tokenising can't be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with passing(spark):  # a stage's own tables go when its result is written
            made = stage(spark, docs, sf_dir)
            path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex[:12]}"
            made.write.option("compression", "zstd").parquet(path)
        if last is not None:
            discard(last)
        docs = spark.read.schema(made.schema).parquet(path)
        docs.stored_at, last = path, docs
    return STAGES[-1][1](spark, docs, sf_dir)

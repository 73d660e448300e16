"""Corpus pipeline: quality classifier, near-duplicate removal, decontamination, mixing, sharding.

Every stage is written as Parquet in the shared folder and read back as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilspark.llm.decontamination import decontaminate
from veilspark.llm.jaccard_join import JaccardRule, keep_one_of_each
from veilspark.llm.mixing import mixed_documents
from veilspark.llm.quality_rules import fit_quality, keep_good
from veilspark.llm.queries import learn_condition, shard_rows, table
from veilspark.llm.runtime import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.3 go."""
    return keep_good(docs, fit_quality(docs, table(spark, sf_dir, "labels"), learn=learn_condition()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays, that of the smallest id. Linked: 0.8 of five-word shingles
    shared; op7 has a rule of its own."""
    return keep_one_of_each(docs, rule=JaccardRule(k=5, percent=80))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents by source towards target weights: some go, some are repeated."""
    return mixed_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each document: its shard and slot."""
    return shard_rows(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources", source_mix),
    ("sharding", shards),
]

#: SQL can't express the classifier's fit or label propagation; the pipeline is tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage{k + 1}")
    return docs

"""Corpus pipeline: documents to a mixed, sharded training set.

Every stage takes (spark, docs, sf_dir) and returns the rows it keeps, with
the columns they came with; the last adds the shard.  ``run`` writes each
stage's result as Parquet in the cluster's shared folder and gives the next
stage what it reads back, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from velas.llm import decontaminate, jaccard_join, mixing, sharding, toxicity
from velas.llm.common import read_table, store
from velas.llm.queries import SHARDS


#: Near copies: word shingles and percent of them that two documents share (not those of operator 10's query).
NEAR_SHINGLE = 5
NEAR_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go; its model is learned
    from the labelled documents outside the held-out fold."""
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), ~toxicity.held_out())
    return toxicity.reject_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join stays."""
    return jaccard_join.keep_one(docs, size=NEAR_SHINGLE, percent=NEAR_PERCENT)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every copy of a document that the mix takes is a row."""
    return mixing.draw(docs)


def place_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with their slot and shard."""
    return sharding.place(docs, SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", place_shards),
]

#: SQL cannot express the fitted toxicity score; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

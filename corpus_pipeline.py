"""Corpus pipeline: quality, near duplicates, benchmark contamination, mixing, sharding.

Each stage works on all that the one before kept, and its decisions take effect: rejected documents go, one
document of each near-duplicate group stays, contaminated documents go, documents are repeated or left out
as their source's target asks. All stages but the last return the columns of documents; the last adds shard
and slot. An empty table passes through every stage; null texts are documents without words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgrid.llm.common import table, written
from quillgrid.llm.decontamination import clean_documents
from quillgrid.llm.mixing import mix
from quillgrid.llm.quality import accepted_documents
from quillgrid.llm.sharding import bounded_load_shards
from quillgrid.llm.simhash import one_of_each_group

SHARDS = 24


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier, fitted on their labelled ones, accepts."""
    return accepted_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of close fingerprints."""
    return one_of_each_group(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item stands."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as systematic sampling takes them for their source's target."""
    return mix(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the shard and the slot that the bounded ring gives them."""
    return bounded_load_shards(docs, "doc_id", SHARDS, spread="text")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: The fitted classifier and the fingerprints cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents; each result is written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

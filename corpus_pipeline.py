"""A training corpus from documents: language ID, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. Its result is
written as Parquet and read back as the next one's docs. No stage is expressible in SQL as a whole
(a trained network, fingerprints linked by distance, random draws), so tests hold run() against a
brute-force version.

Defined cases, all stages: an empty table gives no rows; other columns, also of clashing names, are
carried along (a column slot or shard is replaced by the last stage). language_id: null texts and texts
without a letter go; without a labelled row to learn from all rows go. near_dedup: a row is known by
doc_id and text; null ids come last; repeated rows leave one. decontaminate: null texts contain nothing;
an empty benchmark removes nothing. mix: null sources are a source of their own, the last; ties of
random keys are ordered by doc_id. shard: equal rows are interchangeable.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from spanweave.llm import decontamination, language, mixing, sharding, simhash
from spanweave.llm.shared import documents, ensure_checkpoint_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network knows; the network learns from these documents."""
    return language.recognised(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

    Candidates meet under op10's components of fingerprints and under MinHash bands, as fingerprints of
    similar documents can lie too far apart for Golay keys.
    """
    return simhash.one_of_each_group(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, so that each source's words come near its target; some twice."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in random order, with shard and slot."""
    return sharding.shard_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through all stages."""
    ensure_checkpoint_dir(spark)
    place = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
    return docs

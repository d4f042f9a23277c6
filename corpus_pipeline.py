"""From raw documents to the sharded files of a training run.

Five stages, each on the whole of what the one before it kept: documents that the quality classifier
rejects go, one document of each near-duplicate group stays, documents that hold passages of the
benchmark go, sources are mixed to their target weights, and what is left is put into shards.  Every
stage is written to the shared folder and read again, so a lost executor repeats at most one stage.

A null or empty text is scored by the classifier like any other; if it stays it is no duplicate and holds
no passage, and the mix, which counts words, takes nothing of it.  An empty table stays empty; extra columns
are carried along, but ``shard`` and ``slot`` are set by the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from revlume.llm.op1_source_mix import mixed_documents
from revlume.llm.op2_suffix_decontamination import decontaminate
from revlume.llm.op3_attention_quality import accepted, train
from revlume.llm.op7_lsh_forest import one_of_each
from revlume.llm.op8_hilbert_shards import sharded_documents
from revlume.session import staged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels of ``docs``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return accepted(docs, train(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminate(docs, benchmark)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights takes them."""
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and their slot in it."""
    return sharded_documents(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: The classifier and the signatures are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards of ``documents`` after all stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

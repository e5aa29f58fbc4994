"""A training-corpus pipeline: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage takes what its predecessor wrote, acts on all of it and returns the
columns of ``documents``; the last returns the packed pieces. What a stage wrote is
removed when its successor has been written.

Defined cases
* null text: no words; the quality rules reject it. Stages by themselves keep such rows, but for packing, where it is a piece of just the end id.
* null id: its lines remove nothing and stay, it is nobody's near copy; packed like others.
* rows of one id: one document to near-dedup, which keeps one of them.
* empty and very long texts, ties, clashing column names: see the operators; rows ride in one struct.
* an empty table: every stage returns an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sitewise.durable import delete_folder
from sitewise.llm.common import documents, shared_folder
from sitewise.llm.decontamination import remove_contamination
from sitewise.llm.line_dedup import drop_similar_lines
from sitewise.llm.minhash import drop_near_duplicates
from sitewise.llm.packing import default_tokenizer, pack_documents
from sitewise.llm.quality_rules import quality_rules

#: Near duplicates of the corpus: five-word shingles, a similarity of 0.8.
SHINGLE, SIMILAR = 5, 80


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, and the frequent lines of a host from the others."""
    return quality_rules(docs, keep_columns=True)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line matches go, and documents left without a word."""
    return drop_similar_lines(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return drop_near_duplicates(docs, shingle=SHINGLE, similar=SIMILAR)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark go."""
    return remove_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their token ids and places in the sequences."""
    return pack_documents(docs, tokenizer=default_tokenizer(), with_ids=True)


STAGES = [
    ("quality rules", by_quality),
    ("line dedup", without_repeated_lines),
    ("near dedup", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: The order of arrival sets the packing, and near copies are found by hashing: SQL can't say it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        made.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(made.schema).parquet(f"{folder}/{k}")
        if k:
            delete_folder(spark, f"{folder}/{k - 1}")
    return docs

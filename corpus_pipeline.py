"""A corpus pipeline: from raw documents to token ids.

Each stage takes all that the one before kept, written as Parquet and read again:
documents that the quality classifier rejects go; of each group of near duplicates
(five-word shingles, similarity 0.8 or more) the one with the least id stays;
documents that hold benchmark passages by the contamination rule go; personal
numbers, addresses and secrets become pseudonyms; the texts are encoded, and the
text column of the result is what the ids decode to.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillgrade.llm import bpe, decontaminate, knn_quality, near_dedup, pii
from quillgrade.llm.common import materialise, table
from quillgrade.llm.registry import PII_KEY


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return knn_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(docs, PII_KEY)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_table(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", dedup),
    ("benchmark decontamination", decontaminated),
    ("PII", pseudonyms),
    ("BPE encoding and decoding", tokens),
]

#: SQL has no nearest-neighbour vote, Feistel permutation or merge rounds; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}

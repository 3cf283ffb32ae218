"""A corpus from raw documents to tokens.

What is poor goes, lines that many documents share go, near copies go, sources are mixed to their weights, and
texts are encoded. Each stage takes (spark, docs, sf_dir), works on all that the one before it has kept, and
returns the columns of documents; the last one returns digests of the tokens. An empty table passes through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import bpe, linededup, mixing, neardup, quality
from plumbline.llm.common import forget, written
from plumbline.llm.queries import VOCABULARY


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from labels of documents that aren't held out."""
    return quality.keep_good(docs, quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; no document does."""
    return linededup.drop_lines(docs, linededup.LineIndex.build(docs, least=10))


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a similarity of 0.8 or more, the least doc_id stays."""
    return neardup.keep_one(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated until sources have their target weights."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of every document kept, as digests, and what they decode to."""
    return bpe.digest_documents(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", drop_poor),
    ("line_dedup", drop_shared_lines),
    ("minhash_near_dedup", keep_one_of_copies),
    ("source_mixing", mix_sources),
    ("bpe_encoding", encode),
]

#: None: hashed features, MinHash and merges have no counterpart in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is written before the next one reads it, and goes after."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus operators as queries over whole tables: (session, folder of the tables) to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import audit, bpe, divergence, linededup, mixing, neardup, quality, repeats, resampling, secrets, sharding, simhash, vectorjoin
from plumbline.llm.oracles import ORACLES

#: The vocabulary of the BPE query; a file that the tokenizers' package brings.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.learn(docs, _table(spark, sf_dir, "labels")))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), width=4, percent=80)


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents")).drop("content")


def op4_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.quality_rules(_table(spark, sf_dir, "documents")).drop("char_distance", "word_distance")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.with_near_docs(simhash.fingerprint_documents(_table(spark, sf_dir, "documents")))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return linededup.drop_lines(docs, linededup.LineIndex.build(docs), digest=True)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), keep=["doc_id"]).select("row.doc_id", "size", "source_size", "target", "taken")


def op11_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorjoin.near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.98)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_minhash": op2_minhash,
        "op3_repeats": op3_repeats,
        "op4_divergence": op4_divergence,
        "op5_sharding": op5_sharding,
        "op6_simhash": op6_simhash,
        "op7_bpe": op7_bpe,
        "op8_line_dedup": op8_line_dedup,
        "op9_secret_scan": op9_secret_scan,
        "op10_mixing": op10_mixing,
        "op11_grid_join": op11_grid_join,
        "op12_filter_audit": op12_filter_audit,
        "op13_resampling": op13_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

"""The driver's tables as the records that the operators take, in Spark; the same as common table expressions is in
oracles.py. Every table is taken whole."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators import retrieve


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Lines that a task sorts at a time, by counts of a table.
PART = 100_000


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """A table's rows dealt out by a key of few rows, in as many parts as the table has PART rows, so that no task's part grows with the table.

    Where the cluster has more cores than that, Spark's own number of parts does. Windows, groups and joins by the key that follow keep the parts.
    """
    context, parts = rows.sparkSession.sparkContext, -(-rows.count() // PART)
    if parts <= context.defaultParallelism:
        return rows
    return rows.repartition(max(parts, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key)


def line_hits(spark: SparkSession, d: str) -> DataFrame:
    """Orders as samples, their lines as hits by price, parts as documents, two flags as sources."""
    order = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_partkey", "l_suppkey", "l_linenumber")
    return dealt(table(spark, d, "lineitem"), "l_orderkey").select(
        F.col("l_orderkey").alias("sample_id"), F.concat_ws("-", "l_partkey", "l_suppkey").alias("chunk_id"), F.col("l_partkey").alias("doc_id"), F.lit(1).cast("long").alias("dataset_id"),
        (F.row_number().over(order) - 1).alias("rank"), F.col("l_extendedprice").alias("score"), F.array_sort(F.array_distinct(F.array("l_returnflag", "l_linestatus"))).alias("sources"), F.col("l_quantity").alias("quantity"),
    )


def line_golden(spark: SparkSession, d: str, graded: bool = False) -> DataFrame:
    """Parts of which an order has 40 or more are expected; graded: a grade for each ten, by the most of a part."""
    lines = dealt(table(spark, d, "lineitem"), "l_orderkey").where("l_quantity >= 40").groupBy("l_orderkey", "l_partkey").agg(F.max("l_quantity").alias("q"))
    grade = F.struct(F.col("l_partkey").cast("string").alias("key"), (F.floor(F.col("q") / 10) - 3).cast("int").alias("value"))
    grades = F.map_from_entries(F.array_sort(F.collect_list(grade))) if graded else F.lit(None).cast("map<string,int>")
    return lines.groupBy(F.col("l_orderkey").alias("sample_id")).agg(F.array_sort(F.collect_list("l_partkey")).alias("expected_doc_ids"), grades.alias("relevance_grades")).withColumn("expected_chunk_ids", F.array().cast("array<string>"))


def vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(queries, corpus): every row whose id is divisible by 100, against all rows."""
    rows = table(spark, d, "embeddings")
    corpus = rows.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")
    return rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("sample_id"), F.col("embedding").alias("vector"), "label"), corpus


def dimensions(df: DataFrame, key: str) -> DataFrame:
    """(key, index, weight): the dimensions over 0.1. Sparse scores are products of these, not of whole vectors."""
    return df.select(key, F.posexplode("vector").alias("index", "weight")).where("weight > 0.1").withColumn("weight", F.col("weight").cast("double"))


def vector_golden(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of the query's label are expected, itself left out."""
    queries, corpus = vectors(spark, d)
    same = queries.join(corpus.select("chunk_id", "label"), "label").where("sample_id <> chunk_id")
    return same.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.col("chunk_id").cast("string"))).alias("expected_chunk_ids")).withColumn("expected_doc_ids", F.lit(None).cast("array<bigint>"))


def dense_hits(spark: SparkSession, d: str, top_k: int = 50) -> DataFrame:
    return retrieve.dense(*vectors(spark, d), top_k)


def sparse_hits(spark: SparkSession, d: str, top_k: int = 50) -> DataFrame:
    queries, corpus = vectors(spark, d)
    large = F.filter(F.transform("vector", lambda w, i: F.struct(i.alias("index"), w.cast("double").alias("weight"))), lambda x: x["weight"] > 0.1)
    rows = corpus.select("chunk_id", large.alias("v")).select("chunk_id", F.col("v.index").alias("indices"), F.col("v.weight").alias("values"))
    return retrieve.sparse(dimensions(queries, "sample_id"), rows, top_k)


def route_hits(spark: SparkSession, d: str) -> DataFrame:
    """Both routes, scores to nine places so that both engines see the same ones."""
    both = retrieve.merge_routes(dense_hits(spark, d), sparse_hits(spark, d))
    return both.select("sample_id", "source", "route_rank", F.format_string("%05d", "chunk_id").alias("chunk_id"), F.col("chunk_id").alias("doc_id"), F.lit(1).cast("long").alias("dataset_id"), F.round("score", 9).alias("score"))


def route_golden(spark: SparkSession, d: str) -> DataFrame:
    golden = vector_golden(spark, d)
    queries = vectors(spark, d)[0].select("sample_id")
    padded = F.transform("expected_chunk_ids", lambda c: F.format_string("%05d", c.cast("long")))
    none = F.array().cast("array<string>")
    return queries.join(golden, "sample_id", "left").select("sample_id", F.coalesce(padded, none).alias("expected_chunk_ids"), "expected_doc_ids")


def diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Events as samples: an error is a failed source, props.k what was ranked, value the time."""
    failed = F.when(F.col("event_type") == "error", F.array("event_type")).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "events").select(F.col("event_id").alias("sample_id"), "ts", F.col("event_type").alias("type"), F.col("value").alias("elapsed_ms"), failed.alias("failed_sources"), F.get_json_object("props", "$.k").cast("int").alias("n_ranked"))


#: Bytes of rows that are sent to every task at a time.
SENT = 8 << 20


def blocks(rows: DataFrame, column: str) -> list[DataFrame]:
    """rows in blocks of about SENT bytes of a text column."""
    many = 1 + (rows.agg(F.sum(F.octet_length(column))).first()[0] or 0) // SENT
    return [rows.where(F.pmod(F.xxhash64(*rows.columns), F.lit(many)) == i) for i in range(many)]


def shared_folder(spark: SparkSession) -> str:
    """Where a query may write: the folder that spark.checkpoint.dir names; on one machine, where it is unset, one of its own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")

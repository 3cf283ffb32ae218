"""Readers of golden sets, collections, manifests, judgments and chunks, and writers of the line formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.golden import validated
from plumbline.sources import schemas


def _unique(df: DataFrame, key: str, what: str) -> DataFrame:
    """df, failing where a key occurs twice."""
    twice = df.groupBy(key).count().where("count > 1").select(F.col(key).alias("twice"))
    fault = F.when(F.col("twice").isNotNull(), F.raise_error(F.concat(F.lit(f"{what} occurs twice: "), F.col(key).cast("string"))).cast(dict(df.dtypes)[key]))
    return df.join(twice, F.col(key) == F.col("twice"), "left").withColumn(key, F.coalesce(fault, F.col(key))).drop("twice")


def golden(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """Golden samples, a JSON object a line; optional fields are null or empty lists."""
    rows = spark.read.schema(schemas.GOLDEN).json(path, mode="FAILFAST")
    empty = {"expected_chunk_ids": "array<string>", "dataset_ids": "array<bigint>"}
    rows = rows.withColumns({c: F.coalesce(c, F.array().cast(kind)) for c, kind in empty.items()})
    return validated(rows) if check else rows


def write_golden(samples: DataFrame, path: str) -> None:
    """A JSON object a line, as golden() reads it."""
    samples.select(*[c.split()[0] for c in schemas.GOLDEN.split(", ") if c.split()[0] in samples.columns]).write.mode("overwrite").json(path)


def json_lines(samples: DataFrame) -> DataFrame:
    return samples.select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("value"))


def from_json_lines(lines: DataFrame, schema: str = schemas.GOLDEN) -> DataFrame:
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MANIFEST).json(path, mode="FAILFAST")


def _tsv(spark: SparkSession, path: str, least: int, what: str) -> DataFrame:
    """(parts) of every line that isn't blank; a line of too few columns fails."""
    lines = spark.read.text(path).where(F.btrim("value") != "").select(F.split("value", "\t").alias("parts"), "value")
    fault = F.when(F.size("parts") < least, F.raise_error(F.concat(F.lit(f"bad line of {what}: "), "value")).cast("array<string>"))
    return lines.select(F.coalesce(fault, F.col("parts")).alias("parts"))


def collection(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, text) of lines of id, tab and text; further tabs belong to the text. An id twice fails."""
    rows = _tsv(spark, path, 2, "collection").select(F.col("parts")[0].alias("source_id"), F.array_join(F.slice("parts", 2, F.size("parts")), "\t").alias("text"))
    return _unique(rows, "source_id", "passage")


def queries(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, 2, "queries").select(F.col("parts")[0].alias("qid"), F.col("parts")[1].alias("query"))


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """(qid, pid, grade) of four columns: query, unused, passage, grade."""
    parts = F.col("parts")
    return _tsv(spark, path, 4, "qrels").select(parts[0].alias("qid"), parts[2].alias("pid"), parts[3].cast("int").alias("grade"))


def json_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(qid, pid, grade 1) of one JSON object: query to a list of passages."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return whole.select(F.explode("m").alias("qid", "pids")).select("qid", F.explode("pids").alias("pid"), F.lit(1).alias("grade"))


def chunks(df: DataFrame, dataset_ids: list[int] | None = None, least_chars: int = 0) -> DataFrame:
    """Chunks of datasets, long enough once stripped, by id."""
    kept = df if dataset_ids is None else df.where(F.col("dataset_id").isin(dataset_ids))
    return kept.where(F.length(F.btrim(F.coalesce("content", F.lit("")))) >= least_chars).orderBy("chunk_id")


def chunk_status(corpus: DataFrame, asked: DataFrame) -> DataFrame:
    """(chunk_id, status) of those asked for that exist."""
    return asked.select("chunk_id").distinct().join(corpus.select("chunk_id"), "chunk_id", "left_semi").withColumn("status", F.lit("ACTIVE"))


def rendered_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, fmt, content) of files whose names tell their format."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).alias("fmt"), "content")

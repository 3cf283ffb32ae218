"""Sparse vectors and index tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import finite


def clean_weights(weights: DataFrame, top_k: int = 256, least: float = 0.0, key: str = "chunk_id", strict: bool = True) -> DataFrame:
    """(key, index, weight): of (key, index, weight) the greatest weight of each index, above 0 and from least on,
    and of those the top_k greatest, equal ones by index; top_k 0 keeps all.

    strict: a negative index or a weight that isn't finite fails the query. Keys left without any have no rows.
    """
    index, weight = F.col("index").cast("long"), F.col("weight").cast("double")
    if strict:
        fault = F.when((index < 0) | index.isNull(), "index must be a number from 0 on").when(weight.isNull() | ~finite(weight), "weight must be finite")
        weight = F.when(fault.isNotNull(), F.raise_error(fault).cast("double")).otherwise(weight)
    kept = weights.select(key, index.alias("index"), weight.alias("weight")).where((F.col("weight") > 0) & (F.col("weight") >= least)).groupBy(key, "index").agg(F.max("weight").alias("weight"))
    if top_k <= 0:
        return kept
    order = Window.partitionBy(key).orderBy(F.desc("weight"), "index")
    return kept.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= top_k).drop("nth")


def packed(weights: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, indices, values) with indices ascending."""
    own = weights.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("index", "weight"))).alias("v"))
    return own.select(key, F.col("v.index").alias("indices"), F.col("v.weight").alias("values"))


def index_tables(passages: DataFrame, bm25: bool = True) -> dict[str, DataFrame]:
    """The three index tables of passages (chunk_id, user_id, dataset_id, doc_id, vector, indices, values, bm25_indices, bm25_values).

    Every row needs a vector with dimensions; sparse rows are those that have dimensions.
    """
    payload = ["chunk_id", "user_id", F.col("dataset_id").alias("set_id"), "doc_id"]
    size = F.size("vector")
    fault = F.when(F.coalesce(size, F.lit(0)) < 1, "a vector has no dimensions")
    checked = F.when(fault.isNotNull(), F.raise_error(fault).cast(dict(passages.dtypes)["vector"])).otherwise(F.col("vector"))
    out = {"dense": passages.select(*payload, checked.alias("vector")), "sparse": passages.where(F.size("indices") > 0).select(*payload, "indices", "values")}
    if bm25:
        out["bm25"] = passages.where(F.size("bm25_indices") > 0).select(*payload, F.col("bm25_indices").alias("indices"), F.col("bm25_values").alias("values"))
    return out


def without_points(index: DataFrame, chunk_ids: DataFrame) -> DataFrame:
    return index.join(chunk_ids.select("chunk_id").distinct(), "chunk_id", "left_anti")


def dot(a: Column, b: Column) -> Column:
    """Inner product of two vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def scaled(vector: Column) -> Column:
    """A vector of length 1; one of zeros stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(vector, lambda x: x.cast("double") / norm)).otherwise(vector.cast("array<double>"))

"""Retrieval routes over DataFrames: dense and sparse similarity, BM25; each yields route hits.

Queries are a bounded set (a golden set), the corpus may be of any size: the query side is what is sent to the
executors, under a checked size and in blocks beyond it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.functions.text import search_tokens, tokens
from plumbline.operators import scoring

#: Bytes of queries that are sent at a time, and of what tasks hold of them; scores of a step; bytes of a query's hit so far.
SENT_VECTORS, STEP, HELD = 64 << 20, 1 << 20, 16
#: Fixed values of the BM25 encoder: term saturation, length weight, fixed mean lengths of coarse and fine tokens, and
#: the weight of coarse ones.
K1, B, COARSE_LENGTH, FINE_LENGTH, COARSE_BOOST = 1.2, 0.75, 200.0, 220.0, 2.0


def top(scored: DataFrame, top_k: int, source: str, threshold: float | None = None) -> DataFrame:
    """Route hits of (sample_id, chunk_id, score): the first top_k by score, equal ones by id.

    The limit is on the row number itself, so that each task keeps top_k of a sample before the shuffle.
    """
    kept = scored if threshold is None else scored.where(F.col("score") >= threshold)
    order = Window.partitionBy("sample_id").orderBy(F.desc(F.round("score", 9)), F.asc("chunk_id"))
    first = kept.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= top_k)
    return first.select("sample_id", F.lit(source).alias("source"), (F.col("nth") - 1).alias("route_rank"), "chunk_id", "score")


def _nearest(corpus: DataFrame, ids: pa.Array, vectors: np.ndarray, top_k: int, schema) -> DataFrame:
    """(sample_id, chunk_id, score): the best top_k of every task for these queries; a task holds no more than them."""
    sent = corpus.sparkSession.sparkContext.broadcast((ids, vectors))
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = sent.value
        best, found = np.zeros((len(q), 0)), None
        for batch in batches:
            for at in range(0, batch.num_rows, max(1, STEP // len(q))):
                part = batch.slice(at, max(1, STEP // len(q)))
                names = part.column(0).to_pylist()
                names = np.array(names, dtype=str if isinstance(names[0], str) else None)
                scores = np.concatenate([best, q @ part.column(1).flatten().to_numpy().reshape(len(names), -1).T], axis=1)
                every = np.broadcast_to(names, (len(q), len(names)))
                every = every if found is None else np.concatenate([found, every], axis=1)
                order = np.lexsort((every, -np.round(scores, 9)), axis=1)[:, :top_k]
                best, found = np.take_along_axis(scores, order, 1), np.take_along_axis(every, order, 1)
        if found is not None:
            columns = [own.take(pa.array(np.repeat(np.arange(len(q)), best.shape[1]))), pa.array(found.ravel().tolist(), kinds[1]), pa.array(best.ravel(), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["sample_id", "chunk_id", "score"])

    return corpus.mapInArrow(run, schema)


def dense(queries: DataFrame, corpus: DataFrame, top_k: int = 10, threshold: float | None = None) -> DataFrame:
    """Inner product of every query (sample_id, vector) with every corpus row (chunk_id, vector): an exact search.

    The queries are sent to the corpus, SENT_VECTORS bytes at a time, and multiplied with it batch by batch; of each
    query a task hands on top_k rows. Rows without a vector are left out.
    """
    asked = queries.select("sample_id", F.col("vector").cast("array<double>").alias("vector")).where("vector is not null")
    held = corpus.select("chunk_id", F.col("vector").cast("array<double>").alias("vector")).where("vector is not null")
    size = asked.agg(F.max(8 * F.size("vector"))).first()[0] or 0
    schema, out = hits_schema(queries, corpus), []
    for own in blocks(asked, size + HELD * top_k):
        vectors = np.concatenate([c.flatten().to_numpy() for c in own.column(1).chunks]).reshape(own.num_rows, -1)
        out.append(_nearest(held, pa.concat_arrays(own.column(0).chunks), vectors, top_k, schema))
    return top(all_hits(out, queries.sparkSession, schema), top_k, "dense", threshold)


def blocks(asked: DataFrame, size: int) -> Iterator[pa.Table]:
    """Rows of sample_id and others, all rows of a sample at once: at most about SENT_VECTORS bytes at a time."""
    blocks = 1 + asked.count() * size // SENT_VECTORS
    for block in range(blocks):
        own = asked.where(F.col("sample_id").isNotNull() & (F.pmod(F.xxhash64("sample_id"), F.lit(blocks)) == block)).toArrow().combine_chunks()
        if own.num_rows:
            yield own


def all_hits(parts: list[DataFrame], spark: SparkSession, schema) -> DataFrame:
    out = spark.createDataFrame([], schema) if not parts else parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def hits_schema(queries: DataFrame, corpus: DataFrame) -> T.StructType:
    return T.StructType([queries.schema["sample_id"], corpus.schema["chunk_id"], T.StructField("score", T.DoubleType())])


def numbered(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """(distinct values, which of them each row has)."""
    coded = pa.concat_arrays(column.chunks).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def packed_rows(corpus: DataFrame) -> DataFrame:
    """(chunk_id, indices, values) of the same, or of (chunk_id, index, weight), which costs a shuffle."""
    if "index" not in corpus.columns:
        return corpus.select("chunk_id", F.col("indices").cast("array<bigint>").alias("indices"), F.col("values").cast("array<double>").alias("values"))
    both = F.collect_list(F.struct(F.col("index").cast("long").alias("index"), F.col("weight").cast("double").alias("weight"))).alias("v")
    return corpus.where("weight is not null").groupBy("chunk_id").agg(both).select("chunk_id", F.col("v.index").alias("indices"), F.col("v.weight").alias("values"))


def sparse(queries: DataFrame, corpus: DataFrame, top_k: int = 10, threshold: float | None = None) -> DataFrame:
    """Inner product over shared dimensions of (sample_id, index, weight) and (chunk_id, indices, values).

    A row of the corpus is scored where it lies; of each query a task hands on top_k rows. Of an index that a row or
    a query has several times, weights are added up; null weights are left out, and so are rows that share no
    index with a query.
    """
    schema, held, found = hits_schema(queries, corpus), packed_rows(corpus), []
    asked = queries.select("sample_id", F.col("index").cast("long").alias("index"), F.col("weight").cast("double").alias("weight")).where("weight is not null and index is not null")
    for own in blocks(asked, 24):
        known, dim = np.unique(own.column(1).to_numpy(), return_inverse=True)
        ids, query = numbered(own.column(0))
        lists = scoring.Lists(ids, *scoring.entries(query, dim, own.column(2).to_numpy(), len(known)), len(known))

        def read(batch: pa.RecordBatch, known: np.ndarray = known) -> scoring.Rows:
            at = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(1).offsets.to_numpy()))
            index, weight = batch.column(1).flatten().to_numpy(zero_copy_only=False), batch.column(2).flatten().to_numpy(zero_copy_only=False)
            place = np.minimum(np.searchsorted(known, index), len(known) - 1)
            of = (known[place] == index) & ~np.isnan(weight)
            return scoring.Rows(batch.column(0).to_pylist(), *scoring.entries(at[of], place[of], weight[of], len(known)))

        found.append(scoring.best_rows(held.where("chunk_id is not null and size(indices) > 0"), lists, read, top_k, schema))
    return top(all_hits(found, queries.sparkSession, schema), top_k, "sparse", threshold)


@dataclass(frozen=True)
class Field:
    """A reading of a text as tokens; a mean length of None is the corpus's own; its matches weigh boost."""

    tokens: Callable[[Column], Column]
    mean_length: float | None = None
    boost: float = 1.0


#: Words and characters, and these with the pairs of neighbouring characters.
COARSE_AND_FINE = (Field(tokens, COARSE_LENGTH, COARSE_BOOST), Field(search_tokens, FINE_LENGTH))


def _token_lists(batch: pa.RecordBatch, field: int, wanted: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, token, times) of the wanted tokens in a column of token arrays."""
    column = batch.column(field)
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    token = pc.fill_null(pc.index_in(column.flatten(), value_set=wanted), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(batch.num_rows), lengths)
    both, times = np.unique(row[token >= 0] * len(wanted) + token[token >= 0], return_counts=True)
    return both // len(wanted), both % len(wanted), times


def _counts(said: DataFrame, wanted: pa.Array, fields: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(texts and words of each field, texts that hold each wanted token by the last field), summed over the tasks.

    A task hands on a row for each of the wanted tokens at most.
    """
    sent = said.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, held = np.zeros((fields, 2), np.int64), np.zeros(len(sent.value), np.int64)
        for batch in batches:
            for f in range(fields):
                lengths = pc.list_value_length(batch.column(f + 1))
                sums[f] += (len(lengths) - lengths.null_count, pc.sum(lengths).as_py() or 0)
            held += np.bincount(_token_lists(batch, fields, sent.value)[1], minlength=len(sent.value))
        some = np.flatnonzero(held)
        token = np.concatenate([-1 - np.arange(2 * fields), some])
        yield pa.RecordBatch.from_arrays([pa.array(token, pa.int64()), pa.array(np.concatenate([sums.ravel(), held[some]]), pa.int64())], ["token", "n"])

    got = said.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
    token, n = (got.column(i).to_numpy() for i in (0, 1))
    sums, df = np.zeros(2 * fields, np.int64), np.zeros(len(wanted), np.int64)
    sums[-1 - token[token < 0]] = n[token < 0]
    df[token[token >= 0]] = n[token >= 0]
    return sums.reshape(fields, 2)[:, 0], sums.reshape(fields, 2)[:, 1], df


def idf(docs: float, df: np.ndarray) -> np.ndarray:
    return np.log(1 + (docs - df + 0.5) / (df + 0.5))


def saturated(tf: np.ndarray, length: np.ndarray, mean: float, k1: float, b: float) -> np.ndarray:
    """What tf times of a token weigh in a text of a length."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))


def bm25(queries: DataFrame, corpus: DataFrame, top_k: int = 10, tokens=search_tokens, k1: float = K1, b: float = B, mean_length: float | None = None, fields: Sequence[Field] | None = None) -> DataFrame:
    """BM25 of (sample_id, text) against (chunk_id, text); a query without a common token finds nothing.

    mean_length None takes the corpus's own mean. idf is ln(1 + (n - df + 0.5) / (df + 0.5)); a token counts once
    in a query. fields read a text in several ways: a query is read as the first, documents are counted by the last,
    and a token's weights in all fields are added. Texts are read twice, for counts of the queries' tokens,
    which are bounded by the queries, and to be scored where they lie; of each query a task hands on top_k. A corpus that
    is asked again and again is kept as postings (index.PassageIndex).
    """
    fields = fields or (Field(tokens, mean_length),)
    schema, found = hits_schema(queries, corpus), []
    said = corpus.where("chunk_id is not null").select("chunk_id", *[f.tokens(F.col("text")).alias(f"t{i}") for i, f in enumerate(fields)])
    asked = queries.select("sample_id", F.explode(F.array_distinct(fields[0].tokens(F.col("text")))).alias("token"))
    for own in blocks(asked, 64):
        (wanted, token), (ids, query) = numbered(own.column(1)), numbered(own.column(0))
        docs, words, df = _counts(said, wanted, len(fields))
        if not df.any():
            continue
        means = [words[i] / docs[i] if f.mean_length is None else f.mean_length for i, f in enumerate(fields)]
        query, token, _ = scoring.entries(query, token, np.ones(len(query)), len(wanted))
        lists = scoring.Lists(ids, query, token, np.where(df > 0, idf(docs[-1], df), 0.0)[token], len(wanted))
        sent, boosts = said.sparkSession.sparkContext.broadcast(wanted), [f.boost for f in fields]

        def read(batch: pa.RecordBatch, sent=sent, means=means, boosts=boosts) -> scoring.Rows:
            rows, dims, weights = [], [], []
            for i, (mean, boost) in enumerate(zip(means, boosts, strict=True), 1):
                row, dim, tf = _token_lists(batch, i, sent.value)
                length = pc.fill_null(pc.list_value_length(batch.column(i)), 0).to_numpy(zero_copy_only=False)[row]
                rows.append(row)
                dims.append(dim)
                weights.append(boost * saturated(tf, length, mean, k1, b))
            return scoring.Rows(batch.column(0).to_pylist(), *scoring.entries(*map(np.concatenate, (rows, dims, weights)), len(sent.value)))

        found.append(scoring.best_rows(said, lists, read, top_k, schema))
    return top(all_hits(found, queries.sparkSession, schema), top_k, "bm25")


def merge_routes(*routes: DataFrame) -> DataFrame:
    """The routes of a pipeline as one table; at least one is needed."""
    if not routes:
        raise ValueError("a pipeline needs a route")
    out = routes[0]
    for route in routes[1:]:
        out = out.unionByName(route)
    return out

"""An index of passages: chunk rows, dense and sparse vectors and BM25 postings, which change together or not at all."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import content_hash
from plumbline.functions.text import search_tokens
from plumbline.operators import retrieve, scoring, vectors
from plumbline.sources.versions import BUCKET, Change, Tables, buckets_of

CHUNKS, DENSE, SPARSE, BM25, LENGTHS = "chunks", "dense", "sparse", "bm25", "lengths"
#: Folders that postings are dealt into by token, and vectors by chunk.
TOKEN_BUCKETS, CHUNK_BUCKETS = 64, 16
#: Texts whose tokens are counted at a time.
ROWS = 256


def postings(texts: DataFrame, tokens=search_tokens) -> DataFrame:
    """(token, chunk_id, tf, length) of (chunk_id, content), a text a row: its tokens are counted where it lies, without a shuffle."""
    said = texts.select("chunk_id", tokens(F.col("content")).alias("t")).where("size(t) > 0")
    schema = T.StructType([T.StructField("token", T.StringType()), said.schema["chunk_id"], T.StructField("tf", T.LongType()), T.StructField("length", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                words, lengths = part.column(1).flatten().dictionary_encode(), pc.list_value_length(part.column(1)).to_numpy(zero_copy_only=False)
                n = len(words.dictionary)
                both, tf = np.unique(np.repeat(np.arange(part.num_rows), lengths) * n + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
                row = pa.array(both // n)
                yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(both % n)), part.column(0).take(row), pa.array(tf, pa.int64()), pa.array(lengths.astype(np.int64)).take(row)], ["token", "chunk_id", "tf", "length"])

    return said.mapInArrow(run, schema)


def _once(passages: DataFrame) -> DataFrame:
    """passages with one row of each chunk_id, the same one in every plan: only ids, and the rows of ids that are there twice, are shuffled."""
    twice = passages.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("chunk_id")
    if twice.isEmpty():
        return passages
    null = passages.where("chunk_id is null")
    again = passages.join(twice, "chunk_id", "left_semi").unionByName(null)
    one = again.groupBy("chunk_id").agg(F.min_by(F.struct(*passages.columns), F.xxhash64(*passages.columns)).alias("p")).select("p.*")
    return passages.where("chunk_id is not null").join(twice, "chunk_id", "left_anti").unionByName(one)


class PassageIndex:
    """Readers see whole versions: the one manifest of the root names all tables' files."""

    def __init__(self, spark: SparkSession, root: str, tokens=search_tokens, bm25: bool = True):
        self.spark, self.tables, self.tokens, self.with_bm25 = spark, Tables(spark, root), tokens, bm25

    def index(self, passages: DataFrame, expected: int | None = None) -> int:
        """Puts passages (chunk_id, user_id, dataset_id, doc_id, content, vector, indices, values) in place of those of their chunk_id.

        A vector without dimensions fails, and so does a count of chunks, vectors or, where it is told, of expected
        passages that doesn't agree; then, and after a crash at any time, the index is as it was. No passages, no new
        version. The version that holds them.
        """
        # Of equal ids the same passage goes into all tables.
        passages = _once(passages)
        if passages.isEmpty():
            return self.tables.manifest()["version"]
        parts = vectors.index_tables(passages, bm25=False)
        chunks = passages.select(
            "chunk_id", "user_id", "dataset_id", "doc_id", "content", content_hash(F.col("content")).alias("content_hash"), F.length("content").alias("char_len"),
            F.lit(True).alias("dense_indexed"), F.coalesce(F.size("indices") > 0, F.lit(False)).alias("sparse_indexed"), F.lit(self.with_bm25).alias("bm25_indexed"),
        )
        change, ids = self.tables.change(), passages.select("chunk_id")
        self._forget(change, ids, (SPARSE, BM25, LENGTHS))
        # Ids are there once, so no table's rows are shuffled to find out, and the keys are told, not sought among the rows.
        put = lambda name, rows, *laid: change.upsert(name, rows, "chunk_id", *laid, several=True, keys=ids)
        put(CHUNKS, chunks)
        put(DENSE, parts["dense"], "chunk_id", CHUNK_BUCKETS)
        put(SPARSE, parts["sparse"], "chunk_id", CHUNK_BUCKETS)
        if self.with_bm25:
            put(BM25, postings(passages.select("chunk_id", "content"), self.tokens), "token", TOKEN_BUCKETS)
            put(LENGTHS, passages.where("content is not null").select("chunk_id", F.size(self.tokens(F.col("content"))).cast("long").alias("length")))
        return change.commit(lambda c: self._agree(c, expected))

    @staticmethod
    def _forget(change: Change, chunk_ids: DataFrame, tables: tuple[str, ...]) -> None:
        """Rows that a passage had and may have no more."""
        for name in tables:
            change.delete(name, chunk_ids)

    def _agree(self, change: Change, expected: int | None) -> None:
        """What this change has written, table by table, must be of as many passages."""
        written = {name: self.tables.written_rows(change, name) for name in (CHUNKS, DENSE, SPARSE)}
        chunks = written[CHUNKS].count()
        sparse = written[CHUNKS].where("sparse_indexed").count()
        counts = {"passages": (chunks if expected is None else expected, chunks), "dense": (chunks, written[DENSE].count()), "sparse": (sparse, written[SPARSE].count() if written[SPARSE] is not None else 0)}
        for name, (want, got) in counts.items():
            if want != got:
                raise ValueError(f"{name}: {got} rows instead of {want}")

    def delete(self, chunk_ids: DataFrame) -> int:
        """Removes chunks (chunk_id) from all tables; none of them there, or none told, is no change."""
        change = self.tables.change()
        if chunk_ids.isEmpty() or not change.tables:
            return change.version
        for name in list(change.tables):
            change.delete(name, chunk_ids.select("chunk_id"))
        return change.commit()

    def delete_dataset(self, dataset_id: int) -> int:
        chunks = self.tables.read(CHUNKS)
        return self.tables.manifest()["version"] if chunks is None else self.delete(chunks.where(F.col("dataset_id") == dataset_id).select("chunk_id"))

    def compact(self) -> int:
        """Merges the changes of all tables, a table a version."""
        for name in self.tables.manifest()["tables"]:
            self.tables.compact(name)
        return self.tables.manifest()["version"]

    def dense(self, queries: DataFrame, top_k: int = 10, threshold: float | None = None) -> DataFrame:
        return retrieve.dense(queries, self.tables.read(DENSE), top_k, threshold)

    def sparse(self, queries: DataFrame, top_k: int = 10, threshold: float | None = None) -> DataFrame:
        return retrieve.sparse(queries, self.tables.read(SPARSE), top_k, threshold)

    def bm25(self, queries: DataFrame, top_k: int = 10, k1: float = retrieve.K1, b: float = retrieve.B, mean_length: float | None = None) -> DataFrame:
        """What retrieve.bm25 finds, from the postings of the queries' tokens: no other bucket is read, no text is.

        Postings of other tokens go before changes are merged. Those left meet by chunk, and a chunk is scored where they
        meet: they are shuffled once, and a chunk's are kept as a row beside the index until the next vacuum, for counts and scores.
        """
        schema = retrieve.hits_schema(queries, self.tables.read(CHUNKS))
        asked = queries.select("sample_id", F.explode(F.array_distinct(self.tokens(F.col("text")))).alias("token"))
        n, words = self.tables.read(LENGTHS).agg(F.count(F.lit(1)), F.sum("length")).first()
        found = []
        for own in retrieve.blocks(asked, 64):
            (wanted, token), (ids, query) = retrieve.numbered(own.column(1)), retrieve.numbered(own.column(0))
            known = self.spark.createDataFrame(pa.table({"token": wanted, "dim": pa.array(np.arange(len(wanted)), pa.int32())}))
            asked_for = lambda rows, known=known: rows.join(F.broadcast(known), "token").select("chunk_id", "dim", F.col("tf").cast("int").alias("tf"), F.col("length").cast("int").alias("length"), *[c for c in rows.columns if c == BUCKET])  # noqa: E731 - as many rows as a block of queries
            held = self.tables.read(BM25, buckets=buckets_of(known, "token", TOKEN_BUCKETS), of=asked_for)
            rows = held.groupBy("chunk_id").agg(F.first("length").alias("length"), F.collect_list(F.struct("dim", "tf")).alias("v")).select("chunk_id", "length", F.col("v.dim").alias("dims"), F.col("v.tf").alias("tfs"))
            rows = self.tables.kept(rows)
            df = np.zeros(len(wanted), np.int64)
            for r in rows.select(F.explode("dims").alias("dim")).groupBy("dim").count().collect():
                df[r["dim"]] = r["count"]
            if not df.any():
                continue
            query, token, _ = scoring.entries(query, token, np.ones(len(query)), len(wanted))
            lists = scoring.Lists(ids, query, token, np.where(df > 0, retrieve.idf(n, df), 0.0)[token], len(wanted))

            def read(batch: pa.RecordBatch, mean=words / n if mean_length is None else mean_length, dims=len(wanted)) -> scoring.Rows:
                at = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(2).offsets.to_numpy()))
                weight = retrieve.saturated(batch.column(3).flatten().to_numpy(), batch.column(1).to_numpy()[at], mean, k1, b)
                return scoring.Rows(batch.column(0).to_pylist(), *scoring.entries(at, batch.column(2).flatten().to_numpy(), weight, dims))

            found.append(scoring.best_rows(rows, lists, read, top_k, schema))
        return retrieve.top(retrieve.all_hits(found, self.spark, schema), top_k, "bm25")

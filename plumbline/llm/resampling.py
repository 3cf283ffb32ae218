"""Importance resampling towards a target: documents are drawn by how much their words look like the target's.

Each corpus becomes inverted postings: blocks of documents, whose (bucket, document, count) are sorted by bucket and
cut into ranges of buckets. Ranges are shuffled, a block at a time, and meet the gains of their buckets, which
are computed where both corpora's counts of a bucket meet. Each range gives its documents what it contributes, and
documents sum that up. A document's score is its mean gain with Gumbel noise from a hash of its id, so the
highest scores are a draw without replacement that every run repeats.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import text_bytes, with_columns, written

#: Buckets of features, words of a feature at most, the seed, percent drawn of documents with so many words.
BUCKETS, LONGEST, SEED, PERCENT, LEAST_WORDS = 10_000, 1, 2024, 10, 20
#: A block ends with so many documents or postings; a bucket's postings are dealt out by block. Ranges that buckets are dealt into.
BLOCK, POSTINGS, RANGES = 4096, 1 << 19, 32
#: Bytes after which a row group of blocks ends: a task holds a few blocks, however many it writes or reads.
GROUP = 2 << 20
#: Word bytes are digits, letters, and all bytes of characters beyond ASCII; others part words. A-Z become a-z.
_KEPT = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def features(text: bytes, longest: int = LONGEST) -> tuple[int, Counter]:
    """(number of words, feature counts) of a UTF-8 text: all runs of 1 to longest words, joined by a space."""
    words = text.translate(_KEPT).split()
    found = Counter(words)
    for n in range(2, longest + 1):
        found.update(b" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
    return len(words), found


_POSTINGS = "block long, ids array<long>, words array<long>, features array<long>, parts array<struct<range:int,buckets:array<int>,docs:array<int>,counts:array<int>>>"
_PART = pa.struct([("range", pa.int32()), ("buckets", pa.list_(pa.int32())), ("docs", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])
_BLOCK = pa.schema([("block", pa.int64()), *[(c, pa.list_(pa.int64())) for c in ("ids", "words", "features")], ("parts", pa.list_(_PART))])


class _Block:
    """Documents of a task until they make up a block."""

    def __init__(self, number: int, ranges: int):
        self.number, self.ranges, self.size = number, ranges, 0
        self.ids, self.words, self.features, self.held = [], [], [], []

    def add(self, doc: int | None, words: int, counts: dict[int, int]) -> None:
        own = np.empty((3, len(counts)), np.int32)
        own[0], own[1], own[2] = list(counts), len(self.ids), list(counts.values())
        self.held.append(own)
        self.ids.append(doc)
        self.words.append(words)
        self.features.append(sum(counts.values()))
        self.size += len(counts)

    def batch(self) -> pa.RecordBatch:
        buckets, docs, counts = np.concatenate(self.held, axis=1)
        order = np.lexsort((docs, buckets, buckets % self.ranges))
        buckets, docs, counts = buckets[order], docs[order], counts[order]
        cuts = np.searchsorted(buckets % self.ranges, np.arange(self.ranges + 1))
        parts = [{"range": r, "buckets": buckets[i:j], "docs": docs[i:j], "counts": counts[i:j]} for r, (i, j) in enumerate(pairwise(cuts.tolist())) if i < j]
        return pa.RecordBatch.from_pylist([{"block": self.number, "ids": self.ids, "words": self.words, "features": self.features, "parts": parts}], _BLOCK)


def document_postings(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """A table of blocks of the rows of docs: their ids, numbers of words and features, and postings by range of buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(TaskContext.get().partitionId() << 32, RANGES)
        for ids, texts in with_columns(batches):
            for doc, text in zip(ids, texts, strict=True):
                n, found = features(text, longest)
                own: dict[int, int] = {}
                for f, k in found.items():
                    b = zlib.crc32(f) % buckets
                    own[b] = own.get(b, 0) + k
                block.add(doc, n, own)
                if len(block.ids) >= BLOCK or block.size >= POSTINGS:
                    yield block.batch()
                    block = _Block(block.number + 1, RANGES)
        if block.ids:
            yield block.batch()

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()).mapInArrow(run, _POSTINGS), "postings", GROUP)


def _listed(postings: DataFrame) -> DataFrame:
    return postings.select("block", F.inline("parts"))


def _sums(postings: DataFrame, name: str) -> DataFrame:
    return _listed(postings).select(F.inline(F.arrays_zip("buckets", "counts")).alias("bucket", "n")).groupBy("bucket").agg(F.sum("n").alias(name))


def bucket_gains(raw: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of every bucket that raw has: 1000 times the log of how much likelier the target's features fall there, floored."""
    size = F.sum(F.aggregate("features", F.lit(0).cast("long"), lambda s, x: s + x))
    s_all, t_all = (corpus.agg(size).first()[0] or 0 for corpus in (raw, target))
    met = _sums(raw, "s").join(_sums(target, "t"), "bucket", "left")
    one = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double") + 1
    gain = F.floor(1000 * F.log(one("t") * F.lit(float(s_all + buckets)) / (one("s") * F.lit(float(t_all + buckets)))))
    return met.select("bucket", gain.alias("gain"))


def document_weights(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight) of the documents of raw: the floored mean gain of their features, 0 for none."""
    # Of a range, the gain of each of its buckets, at bucket div RANGES; once for each block that it meets.
    places = F.map_from_entries(F.collect_list(F.struct(F.expr(f"bucket div {RANGES}"), "gain")))
    ranges = bucket_gains(raw, target, buckets).groupBy(F.pmod("bucket", F.lit(RANGES)).cast("int").alias("range")).agg(places.alias("m"))
    ranges = ranges.select("range", F.transform(F.sequence(F.lit(0), F.lit(buckets // RANGES)), lambda i: F.element_at("m", i.cast("long"))).alias("gains"))
    ranges = written(ranges, "gains")
    gains = raw.select("block", F.explode("parts.range").alias("range")).join(F.broadcast(ranges), "range")  # RANGES rows
    met = _listed(raw).join(gains.hint("shuffle_hash"), ["block", "range"])
    given = met.select("block", "gains", F.inline(F.arrays_zip("buckets", "docs", "counts")).alias("bucket", "at", "n"))
    given = given.groupBy("block", "at").agg(F.sum(F.get("gains", F.expr(f"cast(bucket div {RANGES} as int)")) * F.col("n")).alias("gains"))
    own = raw.select("block", F.posexplode(F.arrays_zip("ids", "words", "features"))).select("block", F.col("pos").alias("at"), F.col("col.ids").alias("doc_id"), F.col("col.words").alias("n_words"), F.col("col.features").alias("n_features"))
    floored = F.expr("(gains - pmod(gains, n_features)) div n_features")
    weight = F.when(F.col("n_features") > 0, floored).otherwise(0).cast("long")
    return own.join(given, ["block", "at"], "left").select((F.col("block") * BLOCK + F.col("at")).alias("row"), "doc_id", "n_words", "n_features", weight.alias("weight"))


def noise(seed: int) -> Column:
    """Gumbel noise in thousandths, from the document's id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(scores: DataFrame, drawn: int) -> DataFrame:
    """(row, rank) of the drawn highest scores, ties to the smaller doc_id, without a window over all rows.

    Rows are sorted in ranges; a row's rank is its place within its range and the number of rows of the ranges
    before, of which the driver holds one number each.
    """
    spark = scores.sparkSession
    placed = scores.orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "row").select("row", F.monotonically_increasing_id().alias("at"))
    placed = written(placed.select("row", F.shiftright("at", 33).alias("range"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("place")), "ranges")
    before, starts = 0, []
    for r in placed.groupBy("range").count().orderBy("range").collect():
        starts.append((r["range"], before))
        before += r["count"]
    starts = spark.createDataFrame(starts, "range long, start long")
    return placed.join(F.broadcast(starts), "range").select("row", (F.col("start") + F.col("place") + 1).alias("rank")).where(F.col("rank") <= drawn)


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs; rank is null for what isn't drawn.

    Of the rows with at least least_words words, percent of a hundred are drawn, rounded down. Null and empty texts
    have no features, weight 0, and a score. Repeated rows are rows of their own; rows that share a doc_id share its
    noise, and rows without doc_id that of "null". Of target (text, whatever other columns) only the
    bucket counts matter; an empty target or an empty table is fine.
    """
    raw = document_postings(docs, buckets, longest)
    wanted = document_postings(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), buckets, longest)
    scores = written(document_weights(raw, wanted, buckets).withColumn("score", F.col("weight") + noise(seed)), "scores")
    able = scores.where(F.col("n_words") >= least_words)
    drawn = ranked(able.select("row", "doc_id", "score"), percent * able.count() // 100)
    return scores.join(drawn, "row", "left").select("doc_id", "n_features", "weight", "score", "rank")


def draw(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The rows of docs that are drawn, with their columns. Rows that share a drawn doc_id stay together."""
    kept = resample(docs, target, **how).where("rank is not null and doc_id is not null").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi")

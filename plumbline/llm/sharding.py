"""Sharding as a uniform shuffle with exact sizes, by DataFrame operations only.

Rows are dealt into blocks; a hypergeometric communication matrix says how many rows of each block go to each
shard, with exact sums both ways. Within a block rows are permuted and cut by the matrix's row; within a shard
they are permuted again. Given the seed, a row's place depends on the rows' ids and texts only.
"""

from __future__ import annotations

import json
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import hypergeometric

#: Rows of a block on average, as long as there are no more than BLOCKS blocks. Beyond BLOCK_ROWS * BLOCKS rows blocks
#: grow, each a window that sorts rows of 30 bytes; 10^10 documents are 2.4 million rows a block.
BLOCK_ROWS, BLOCKS = 2048, 4096


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 17) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row; the law is rows.

    Shards' counts are at most one apart, slots are gapless from 0. size is the text's UTF-8 bytes plus 1 and a
    null text is an empty one. Repeated rows and rows without doc_id are rows like others. grown_shard is null,
    since the law isn't key. Only ids, sizes and checksums are shuffled; the matrix has at most BLOCKS rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long"), (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    total = docs.count()
    blocks = min(BLOCKS, 1 + total // BLOCK_ROWS)
    hashed = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), "doc_id", "text_crc32", "size")
    rows = rows.withColumn("block", F.pmod(hashed("block"), F.lit(blocks)).cast("int"))
    counted = {r["block"]: r["count"] for r in rows.groupBy("block").count().collect()}  # a number for each block
    sizes = [total // shards + (i < total % shards) for i in range(shards)]
    drawn = hypergeometric.matrix(random.Random(seed), [counted.get(b, 0) for b in range(blocks)], sizes)
    ends = [[sum(row[: j + 1]) for j in range(shards)] for row in drawn]
    spark = docs.sparkSession
    table = spark.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps(ends)), "array<array<bigint>>")).alias("block", "ends"))
    order = ["doc_id", "text_crc32", "size"]
    local = Window.partitionBy("block").orderBy(hashed("local"), *order)
    dealt = (
        rows.withColumn("rank", F.row_number().over(local))
        .join(F.broadcast(table), "block")
        .withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("rank"))))
        .withColumn("final", hashed("final"))
        .select(*order, "shard", "final")
    )
    # A shard's final order is by the last hash; stretches of it are numbered on their own, after those before.
    stretches = max(1, total // shards // max(BLOCK_ROWS, total // (1 << 20)))
    dealt = dealt.withColumn("stretch", F.floor((F.shiftrightunsigned("final", 33) * stretches) / float(1 << 31)).cast("int"))
    counts = dealt.groupBy("shard", "stretch").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("shard", "stretch").orderBy(F.shiftrightunsigned("final", 33), "final", *order)
    return dealt.join(offsets, ["shard", "stretch"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("offset") + F.row_number().over(own) - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )

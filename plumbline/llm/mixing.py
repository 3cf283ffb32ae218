"""Mixing sources to target weights by DataFrame operations only.

Each source's documents are dealt into blocks by hash, whole documents each. A source's blocks are put in a random
order anew for every round that its target needs, and its exact quota is what the first of them hold. A
multivariate-hypergeometric tree splits the sources' numbers of blocks among output shards by halving; each shard
draws the next blocks of every source's order, as many as the tree gives it, and shuffles their documents. What no
shard draws isn't taken.
"""

from __future__ import annotations

import json
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import hypergeometric
from plumbline.llm.common import SPACES, WORD_BREAK, written

#: Weights of the sources in order, repeating; the most that a source is read.
WEIGHTS, MOST = (1, 2, 3), 3
#: Rows of a block and blocks of a stretch of their order, on average; output shards.
BLOCK_ROWS, STRETCH, SHARDS = 32, 2048, 16


def word_count(column: str = "text"):
    """The number of words of a text; a null text has none."""
    bare = F.btrim(F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit(SPACES))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, WORD_BREAK))).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target, quota) of (source, source_size).

    Weights share all words; targets stop at MOST times the source's size, and what is over is shared again by
    weight until none is above. That ends where target = least(cap, level * weight): the sources that reach
    their cap first are those of least cap per weight, so one pass in that order finds the level. quota is the
    target rounded to whole words.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in WEIGHTS]), (F.pmod(rank - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    weighed = sizes.withColumn("weight", weight).withColumn("cap", MOST * F.col("source_size"))
    by_cap = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weights = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levels = weighed.withColumn("level", left / weights)
    # The first source in that order that stays under its cap sets the level for itself and all after it.
    stays = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    level = F.first(stays, ignorenulls=True).over(by_cap.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    target = F.coalesce(F.least(F.col("cap").cast("double"), level * F.col("weight")), F.col("cap").cast("double"))
    return levels.withColumn("target", target).select("source", "source_size", "target", F.floor(F.col("target") + 0.5).alias("quota"))


def _part(digest: str, parts: int) -> Column:
    """Which of so many equal ranges a digest in hex falls into."""
    return F.floor(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") * parts / float(1 << 32)).cast("long")


def _before(name: str, window) -> Column:
    return F.coalesce(F.sum(name).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _drawn_blocks(blocks: DataFrame, targets: DataFrame, shards: int, seed: int, many: int) -> DataFrame:
    """(stream, block, source_size, target, draws): of each block the rounds in which a shard draws it, and what of it.

    Blocks without words have no place in the orders. Orders are cut into stretches, so that no task sees a whole
    source; of a source, the driver gets one number, that of the blocks which its quota needs.
    """
    rounds = F.explode(F.array(*[F.lit(i).cast("long") for i in range(MOST)]))
    listed = blocks.join(targets, "stream").withColumn("round", rounds).withColumn("some", (F.col("words") > 0).cast("long"))
    listed = listed.withColumn("place", F.md5(F.concat_ws(":", F.lit(str(seed)), "round", "block").cast("binary")))
    listed = listed.withColumn("stretch", _part("place", 1 + many // STRETCH))
    sums = listed.groupBy("stream", "round", "stretch").agg(F.sum("words").alias("words"), F.sum("some").alias("some"))
    along = Window.partitionBy("stream").orderBy("round", "stretch")
    offsets = sums.select("stream", "round", "stretch", _before("words", along).alias("words_before"), _before("some", along).alias("some_before"))
    own = Window.partitionBy("stream", "round", "stretch").orderBy("place", "block")
    start, at = F.col("words_before") + _before("words", own), F.col("some_before") + _before("some", own)
    needed = F.greatest(F.lit(0), F.least(F.col("words"), F.col("quota") - start))
    placed = listed.join(offsets, ["stream", "round", "stretch"]).select("stream", "block", "source_size", "target", "round", needed.alias("words"), at.alias("at"))
    placed = written(placed, "mix-places")
    quotas = placed.where("words > 0").groupBy("stream").count().orderBy("stream").collect()  # a row for each source
    split = hypergeometric.tree(random.Random(seed), [r["count"] for r in quotas], shards)
    ends = [{"stream": r["stream"], "ends": [sum(split[j][i] for j in range(k + 1)) for k in range(shards)]} for i, r in enumerate(quotas)]
    tree = blocks.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(ends)), "array<struct<stream:string,ends:array<bigint>>>")))
    # The shard whose part of the order the block lies in; the number of shards if it is in none.
    shard = F.size(F.filter(F.coalesce("ends", F.array().cast("array<bigint>")), lambda e: e <= F.col("at")))
    dealt = placed.join(tree, "stream", "left").withColumn("shard", F.when(F.col("ends").isNull(), shards).otherwise(shard))
    draw = F.when((F.col("words") > 0) & (F.col("shard") < shards), F.struct("round", "words", "shard"))
    return dealt.groupBy("stream", "block", "source_size", "target").agg(F.sort_array(F.collect_list(draw)).alias("draws"))  # at most MOST


def mix(docs: DataFrame, shards: int = SHARDS, seed: int = 23, keep: list[str] | None = None) -> DataFrame:
    """(row, size, source_size, target, taken, copies) of every row; row has all columns of docs, or those to keep.

    copies is an array of (round, words, block, shard, place), one for each time that a shard draws the row; taken
    is their words. A source's taken words are its target rounded, so of the last block that it needs the last row
    may be read in part. A null text has no words and a null source is a source like others, last in order.
    Repeated rows are read on their own. An empty table gives an empty mix. The number of sources is what the
    driver must hold.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), F.col("source").cast("string")))
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(text.cast("binary")))
    rows = docs.select(F.struct(*(keep or docs.columns)).alias("row"), word_count().alias("size"), F.col("source").cast("string").alias("source"), key.alias("stream"), F.md5(name.cast("binary")).alias("order"))
    many = 1 + docs.count() // BLOCK_ROWS
    rows = rows.withColumn("block", _part("order", many))
    blocks = written(rows.groupBy("stream", "source", "block").agg(F.sum("size").alias("words")), "mix-blocks")
    targets = source_targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size")))
    targets = written(targets.withColumn("stream", F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), F.col("source")))).drop("source"), "mix-targets")
    drawn = _drawn_blocks(blocks.drop("source"), targets, shards, seed, many)
    placed = rows.join(drawn, ["stream", "block"]).withColumn("at", _before("size", Window.partitionBy("stream", "block").orderBy("order", "size")))

    def copy(draw):
        words = F.greatest(F.lit(0), F.least(F.col("size"), draw["words"] - F.col("at")))
        return F.struct(draw["round"].alias("round"), words.alias("words"), F.col("block").alias("block"), draw["shard"].alias("shard"), F.xxhash64(F.lit(seed), "order", draw["round"]).alias("place"))

    copies = F.filter(F.transform("draws", copy), lambda c: c["words"] > 0)
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda s, c: s + c["words"])
    return placed.withColumn("copies", copies).select("row", "size", "source_size", "target", taken.alias("taken"), "copies")


def mixed_documents(docs: DataFrame, shards: int = SHARDS, seed: int = 23) -> DataFrame:
    """The documents that the mix reads, as often as it does, with the columns of docs, in order of shard and place.

    Shards follow each other, each with the blocks drawn for it, shuffled; partitions are ranges of that order. Rows
    stay whole, also a source's last, of which the quota may need a part only. Rows of no words are read by no mix
    of words and cost it nothing: they stay, once, in a shard by hash.
    """
    mixed = mix(docs, shards, seed)
    place = F.xxhash64(F.lit(seed), F.coalesce(F.col("row.doc_id").cast("string"), F.lit("null")))
    wordless = F.array(F.struct(F.pmod(place, F.lit(shards)).cast("int").alias("shard"), place.alias("place")))
    places = F.when(F.col("size") == 0, wordless).otherwise(F.transform("copies", lambda c: F.struct(c["shard"].alias("shard"), c["place"].alias("place"))))
    return mixed.select("row", F.explode(places).alias("to")).orderBy("to.shard", "to.place").select("row.*")

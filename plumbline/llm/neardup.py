"""Near-duplicates: MinHash bands propose links, odd sketches sift them, full shingle sets confirm them.

Documents of equal shingle sets form a class first, and only classes are compared. A band's bucket ties each
member to its least and its greatest member. Where these links leave a bucket in several components, its members
are compared across them, so a link is lost only if no band has it. Such buckets are cut into blocks, and every two
blocks meet in a task: there odd sketches, which fold the MinHash samples into parity bits of which the differing ones
estimate high similarities closely, find the members that may have a partner. Only these bring their sets to a second
meeting, of which nothing comes out but links that join components, fewer than there are members.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import forget, text_bytes, with_columns, written
from plumbline.llm.components import connected_components

#: A pair of similarity 0.8 shares no band of 50 with probability 1e-4, one of 0.85 with 2e-7; one of 0.5 shares any
#: with probability 0.18.
BANDS, ROWS = 50, 8
SAMPLES = BANDS * ROWS
#: Bits of an odd sketch, and how many may differ. At similarity 0.8, 137 do on average, with a deviation of 15.
SKETCH_BITS, APART = 1024, 215
#: Ids of 8 bytes up to which they are broadcast.
SENT_IDS = 1 << 20
_RNG = np.random.default_rng(20)
_A = _RNG.integers(0, 1 << 31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
_PLACE = _RNG.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_MEMO = 50_000
_WORDS: dict[bytes, int] = {}
#: Shingles hashed at a time; rows of a block at least and at most, the number of a bucket's blocks in between, and
#: shingles of a block on average; rows of buckets of one block that a task takes together.
CHUNK, LEAST_ROWS, MOST_ROWS, BLOCKS, BLOCK_SHINGLES, TOGETHER = 256, 1 << 8, 1 << 13, 16, 1 << 21, 1 << 12


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(data: bytes, width: int) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles of so many words, A-Z in lower case.

    A text of fewer words has one shingle of all of them; a text without words has none.
    """
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_WORDS) > _MEMO:
        _WORDS.clear()
    for w in set(words).difference(_WORDS):
        _WORDS[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = min(width, len(h))
    mixed = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        mixed = _mixed(mixed * _P1 + h[i : len(h) - n + 1 + i])
    # A short text's shingle is no shingle of a longer one.
    return np.unique(mixed + _P2 * np.array([width - n], np.uint64))


def minhash(shingles: np.ndarray) -> np.ndarray:
    """The samples of a set that isn't empty, 32 bits each."""
    least = np.full(SAMPLES, np.iinfo(np.uint32).max, np.uint32)
    folded = (shingles >> np.uint64(32)).astype(np.uint32)
    hashed = np.empty((min(CHUNK, len(folded)), SAMPLES), np.uint32)
    for at in range(0, len(folded), CHUNK):
        some = folded[at : at + CHUNK, None]
        out = hashed[: len(some)]
        np.multiply(some, _A, out=out)
        np.add(out, _B, out=out)
        np.minimum(least, out.min(axis=0), out=least)
    return least


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """SKETCH_BITS parity bits as signed 64-bit words: each sample flips the bit that it hashes to."""
    bits = np.bincount((_mixed(samples.astype(np.uint64) + _PLACE) % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def estimate(apart: int) -> float:
    """The similarity that so many differing bits of two sketches point to."""
    share = min(2 * apart / SKETCH_BITS, 0.999)
    return max(0.0, 1 + SKETCH_BITS / (4 * SAMPLES) * np.log(1 - share))


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, a, b, bands, sketch) of every row: the set's size and 128-bit hash; empty sets have no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in with_columns(batches):
            rows = []
            for doc, text in zip(ids, texts, strict=True):
                own = shingle_set(text, width)
                whole = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), np.int64)
                if len(own):
                    samples = minhash(own).reshape(BANDS, ROWS)
                    bands = np.arange(BANDS, dtype=np.uint64)
                    for i in range(ROWS):
                        bands = _mixed(bands * _P1 + samples[:, i])
                    rows.append((doc, len(own), int(whole[0]), int(whole[1]), bands.view(np.int64), odd_sketch(samples.ravel())))
                else:
                    rows.append((doc, 0, int(whole[0]), int(whole[1]), [], []))
            types = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "n", "a", "b", "bands", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), text_bytes()).mapInArrow(run, "doc_id long, n long, a long, b long, bands array<long>, sketch array<long>")


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, shingles) of the documents with these ids, a table; up to SENT_IDS ids go to the texts, else texts to the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, texts in with_columns(batches):
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([shingle_set(t, width).view(np.int64) for t in texts], pa.list_(pa.int64()))], ["id", "shingles"])

    named = docs.select(F.col("doc_id").cast("long").alias("id"), text_bytes().alias("content"))
    few = ids.count() <= SENT_IDS
    return named.join(F.broadcast(ids) if few else ids, "id", "left_semi").mapInArrow(run, "id long, shingles array<long>")


def _differing(x: str, y: str):
    return sum((F.bit_count(F.get(x, i).bitwiseXOR(F.get(y, i))) for i in range(SKETCH_BITS // 64)), F.lit(0))


def _confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches are near and whose full sets are similar enough, as a table."""
    marks = classes.select("id", "sketch")
    near = (
        pairs.join(marks.select(F.col("id").alias("a"), F.col("sketch").alias("sa")), "a")
        .join(marks.select(F.col("id").alias("b"), F.col("sketch").alias("sb")), "b")
        .where(_differing("sa", "sb") <= APART).select("a", "b").distinct()
    )
    full = near.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("xa")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("xb")), "b")
    shared = full.select("a", "b", F.size("xa").alias("na"), F.size("xb").alias("nb"), F.size(F.array_intersect("xa", "xb")).alias("both"))
    return written(shared.where(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b").distinct(), "links")


class _Block:
    """Members of a bucket in a task: ids, components, sides, sizes and sketches of its rows, as arrays.

    Side 0 is compared with side 1; if there is none, with itself.
    """

    def __init__(self, rows: pd.DataFrame, percent: int):
        self.ids, self.root, side, self.sizes = (rows[c].to_numpy(np.int64) for c in ("id", "component", "side", "n"))
        self.sketch, self.percent = np.stack(rows["sketch"].to_list()).view(np.uint64), percent
        self.two = bool(side.any())
        self.left, self.right = (np.flatnonzero(side == k) for k in (0, 1)) if self.two else (np.arange(len(side)),) * 2

    def near(self, i: int) -> np.ndarray:
        """The rows that may be linked with row i by their sizes and sketches, and aren't in its component."""
        right = self.right if self.two else self.right[i + 1 :]
        right = right[self.root[right] != self.root[i]]
        n = self.sizes[right]
        right = right[100 * np.minimum(n, self.sizes[i]) >= self.percent * np.maximum(n, self.sizes[i])]
        return right[np.bitwise_count(self.sketch[right] ^ self.sketch[i]).sum(axis=1, dtype=np.int64) <= APART]

    def join(self, i: int, j: int) -> None:
        self.root[self.root == self.root[j]] = self.root[i]


def _buckets(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The rows of each bucket."""
    rows = rows.sort_values("key", kind="stable")
    key = rows["key"].to_numpy()
    cuts = np.append(np.flatnonzero(np.diff(key, prepend=~key[:1])), len(key))
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        yield rows.iloc[low:high]


def possible_members(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Of the buckets' rows (key, id, component, side, n, sketch, ..) those that have a possible partner."""
    out = [rows.iloc[:0]]
    for own in _buckets(rows):
        block, held = _Block(own, percent), np.zeros(len(own), bool)
        for i in block.left.tolist():
            near = block.near(i)
            held[near] = True
            held[i] |= len(near) > 0
        out.append(own[held])
    return pd.concat(out)


def block_links(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links (a, b) of the buckets' rows, which have their shingles, too; each joins what weren't joined before."""
    out: list[tuple[int, int]] = []
    for own in _buckets(rows):
        block, sets = _Block(own, percent), own["shingles"].to_list()
        found, column = np.unique(np.concatenate(sets), return_inverse=True)
        starts, present = np.cumsum([0, *map(len, sets)]), np.zeros(len(found), bool)
        columns = [column[a:b] for a, b in itertools.pairwise(starts)]
        for i in block.left.tolist():
            near = block.near(i)
            if not len(near):
                continue
            present[columns[i]] = True
            both = np.add.reduceat(present[np.concatenate([columns[j] for j in near])], np.append(0, np.cumsum(block.sizes[near])[:-1]), dtype=np.int64)
            present[columns[i]] = False
            for j in near[100 * both >= percent * (block.sizes[i] + block.sizes[near] - both)].tolist():
                if block.root[i] != block.root[j]:
                    block.join(i, j)
                    out.append((min(block.ids[i], block.ids[j]), max(block.ids[i], block.ids[j])))
    return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)


def _across(docs: DataFrame, members: DataFrame, component: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between components that share a bucket, of members (key, id) of the buckets, as a table."""
    placed = members.join(component, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    marks = [F.bit_xor(F.xxhash64("id", F.lit(i))).alias(f"mark{i}") for i in (0, 1)]
    open_ = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("rows"), *marks).where("x < y")
    # Buckets of the same members are compared once.
    open_ = written(open_.groupBy("rows", "mark0", "mark1").agg(F.min("key").alias("key")).select("key", "rows"), "open-buckets")
    whole = written(placed.join(open_, "key").join(classes.select("id", "n", "sketch"), "id"), "open-members")
    many = F.greatest(F.ceil(F.col("rows") / F.greatest(F.lit(LEAST_ROWS), F.least(F.lit(MOST_ROWS), F.col("rows") / BLOCKS))), F.ceil(F.sum("n") / BLOCK_SHINGLES))
    blocks = written(whole.groupBy("key", "rows").agg(many.cast("int").alias("blocks")).drop("rows"), "open-blocks")
    together = 1 + whole.count() // TOGETHER
    dealt = whole.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # Each block meets every other one of its bucket, and itself. Buckets of one block are dealt to tasks by hash.
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(
        F.when(F.col("blocks") > 1, F.col("key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(together))).alias("task"), F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"),
        "key", "id", "component", (F.col("block") > F.col("other")).cast("long").alias("side"), "n", "sketch",
    )
    schema = dealt.schema
    possible = written(dealt.groupBy("task", "x", "y").applyInPandas(lambda rows: possible_members(rows, percent), schema), "possible-members")
    sets = written(_sets(docs, written(possible.select("id").distinct(), "possible-ids"), width), "shingle-sets")
    links = written(possible.join(sets, "id").groupBy("task", "x", "y").applyInPandas(lambda rows: block_links(rows, percent), "a long, b long"), "links")
    for table in (open_, whole, blocks, possible, sets):
        forget(table)
    return links


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs.

    Links join documents whose shingle sets have a similarity of percent or more and share a band; component_id is the least
    doc_id reached by links, kept whether that is the document itself. Null and empty texts and texts without
    words have no shingles and no links, whatever others there are. Rows that share a doc_id are one document,
    linked if one of its texts is; rows without doc_id get no component and are kept.
    """
    own = written(sketches(docs, width), "sketches")
    classes = own.where((F.col("n") > 0) & F.col("doc_id").isNotNull()).groupBy("a", "b").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = written(classes, "classes")
    banded = classes.select("id", F.explode("bands").alias("key"))
    ends = banded.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high")
    ends = written(ends, "buckets")
    members = written(banded.join(ends.where("n > 2"), "key").select("key", "id", "low", "high"), "bucket-members")
    pair = lambda x, y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    stars = members.select(F.explode(F.array(pair("id", "low"), pair("id", "high"))).alias("p")).select("p.*")
    first = written(ends.select(F.col("low").alias("a"), F.col("high").alias("b")).unionByName(stars).where("a < b").distinct(), "pairs")
    ids = written(first.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "paired-ids")
    sets = written(_sets(docs, ids, width), "shingle-sets")
    links = _confirmed(first, classes, sets, percent)
    # A document of several texts is in several classes, which it links.
    held = own.where((F.col("n") > 0) & F.col("doc_id").isNotNull()).select("doc_id", "a", "b")
    several = held.distinct().groupBy("doc_id").count().where("count > 1").select("doc_id")
    own_links = held.join(several, "doc_id").join(classes.select("a", "b", "id"), ["a", "b"]).select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    component = connected_components(links.unionByName(own_links))
    more = _across(docs, members.select("key", "id"), component, classes, width, percent)
    if not more.isEmpty():
        component = connected_components(component.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
    for table in (ends, members, first, ids, sets):
        forget(table)
    named = written(classes.select("a", "b", "id").join(component, "id", "left").select("a", "b", F.coalesce("component", "id").alias("component")), "class-components")
    found = own.select("doc_id", "n", "a", "b").join(named, ["a", "b"], "left")
    linked = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), linked.alias("component_id"), F.coalesce(linked == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay: of each group of near-duplicates the document of least doc_id, once.

    Rows without doc_id stay. All columns are kept.
    """
    found = near_duplicates(docs, width, percent)
    kept = found.where("kept and doc_id is not null").select(F.col("doc_id").alias("id")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"))
    once = rows.where("id is not null").join(kept, "id", "left_semi").dropDuplicates(["id"]).select("row.*")
    return once.unionByName(docs.where(F.col("doc_id").isNull()))

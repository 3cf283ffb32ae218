"""SimHash fingerprints: weighted term hashes vote on signed bits; permuted block tables find near fingerprints.

Terms are pairs of neighbouring words (a lone word is a term by itself), weighted by how often they occur.
A bit is 1 if the weight of the terms whose hash has a 1 there exceeds half of all. The share of bits in which
two fingerprints differ estimates the angle between the texts' term vectors, so likeness is its cosine.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import join_uneven, written

BITS = 256
#: Odd multipliers, one for each 64 bits of a fingerprint.
LANES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
_STEP, _S1, _S2 = np.uint64(0x100000001B3), np.uint64(31), np.uint64(29)
_WORDS: dict[bytes, int] = {}
#: Words whose hashes a worker keeps before it starts anew.
MEMO = 200_000
#: Terms whose bits are unpacked at a time.
CHUNK = 4096
#: Tables of near_counts, each with another 1 of so many blocks in front; the radius of near documents; fingerprints of a front that are compared in
#: a task; members of small fronts that share a task.
TABLES, RADIUS, BLOCK, TOGETHER = 8, 7, 2048, 1 << 16
#: Bytes of texts of a range, as long as there are no more than so many ranges.
RANGE_BYTES, MOST_RANGES = 64 << 20, 1 << 13


def fingerprint(text: str) -> bytes:
    """The fingerprint of a whole text; without words all bits are 0."""
    words = text.encode().split()
    if not words:
        return bytes(BITS // 8)
    if len(_WORDS) > MEMO:
        _WORDS.clear()
    for w in set(words).difference(_WORDS):
        _WORDS[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    terms = h[:-1] * _STEP + h[1:] if len(h) > 1 else h
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(terms), CHUNK):
        lanes = terms[at : at + CHUNK, None] * LANES
        lanes ^= lanes >> _S1
        lanes *= LANES[::-1]
        lanes ^= lanes >> _S2
        votes += np.unpackbits(lanes.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * votes > len(terms)).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """The cosine that the differing bits point to, 0 at least; 1 for equal fingerprints."""
    apart = (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()
    return max(0.0, math.cos(math.pi * apart / BITS)) if apart else 1.0


def edited(text: str, following: str) -> str:
    """The text with its last third of code points replaced by the first as many (or all) of the next text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _range_of(column, bounds: list[int]):
    """How many bounds are at most the value, found in about twice the root of their number of steps."""
    wide = max(1, math.isqrt(len(bounds)))
    rows = [bounds[i : i + wide] for i in range(0, len(bounds), wide)]
    if not rows:
        return F.lit(0)
    under = lambda values: F.size(F.filter(values, lambda b: b <= column))
    # Two literals, however many bounds there are.
    table, heads = F.from_json(F.lit(json.dumps(rows)), "array<array<bigint>>"), F.from_json(F.lit(json.dumps([r[0] for r in rows])), "array<bigint>")
    row = under(heads)
    return F.when(row == 0, 0).otherwise((row - 1) * wide + under(F.get(table, row - 1)))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how near the edited and the next text are.

    The next document is that of the next smaller doc_id, after the last the first; a null doc_id comes last,
    rows of equal doc_id are in the order of their texts. A null text is an empty one; equal texts have equal
    fingerprints; two empty texts are alike. A single document is its own next one.

    Ranges of doc_id are dealt out, one shuffle of the texts; each range also gets the one document that
    follows its last, so that each is read as a stream with one row held. Ranges are as many as the texts' bytes ask
    for, MOST_RANGES at most; the driver gets two numbers of each.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = source.select(F.sum(F.length(F.col("text").cast("binary")))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_RANGES, size // RANGE_BYTES))
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    # Quantiles are few, and where they fall decides the balance only.
    bounds = sorted({int(q) for q in source.select(F.col("doc_id")).na.drop().approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts)}) if parts > 1 else []
    dealt = source.withColumn("part", _range_of(key, bounds))
    first = {r["part"]: r["first"] for r in dealt.groupBy("part").agg(F.max(key).alias("first")).collect()}  # a row for each range
    used = sorted(first)
    # At i = 0, used[i - 1] is the highest range: the first of all documents follows the last.
    guests = [{"doc": first[used[i - 1]], "to": p} for i, p in enumerate(used)]
    asked = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(guests)), "array<struct<doc:bigint,to:int>>")))
    # Of rows that share the id, the one of least text comes first.
    visiting = source.join(F.broadcast(asked), key == F.col("doc")).groupBy(F.col("to").alias("part")).agg(F.max("doc_id").alias("doc_id"), F.min("text").alias("text"))
    rows = dealt.select("part", F.lit(False).alias("guest"), "doc_id", "text").unionByName(visiting.withColumn("guest", F.lit(True)))
    streams = rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "guest", F.desc_nulls_last("doc_id"), "text")
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = None, []
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for part, guest, doc, text in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    mark = fingerprint(text)
                    if held and held[0] == part and not held[1]:
                        was, shown = held[3], edited(held[3], text)
                        other = fingerprint(shown)
                        out.append((held[2], len(was), hashlib.sha256(shown.encode()).hexdigest(), held[4].hex(), other.hex(), likeness(held[4], other), likeness(held[4], mark)))
                    held = (part, guest, doc, text, mark)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                    out = []

    return streams.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def block_tables(radius: int, spare: int = 1, bits: int = BITS) -> list[tuple[tuple[int, int], ...]]:
    """The permuted tables for a radius: each brings so many blocks to the front that equal ones can be looked up.

    radius + spare blocks are cut; fingerprints within the radius agree in at least spare of them, so every such
    pair meets in a table that has those in front.
    """
    cuts = [round(i * bits / (radius + spare)) for i in range(radius + spare + 1)]
    return list(itertools.combinations(list(itertools.pairwise(cuts)), spare))


def within_radius(queries: DataFrame, index: DataFrame, radius: int, spare: int = 1) -> DataFrame:
    """(query_id, doc_id, distance): every fingerprint of the index within the Hamming radius of a query's.

    Both sides are (doc_id, fingerprint) with fingerprints in hex; rows with a null in either match nothing.
    Each side is put into every permuted table once; rows that agree in a table's front are compared in full.
    Equal fingerprints are compared once: copies join after the search.
    """
    tables = block_tables(radius, spare)

    def fronts(fingerprints: DataFrame, name: str) -> DataFrame:
        bits = F.col(name)
        keys = [F.concat(F.lit(f"{t}:"), *[_bits(bits, lo, hi) for lo, hi in table]) for t, table in enumerate(tables)]
        return fingerprints.withColumn("front", F.explode(F.array(*keys)))

    a = queries.select(F.col("fingerprint").alias("fq")).na.drop().distinct()
    b = index.select(F.col("fingerprint").alias("fi")).na.drop().distinct()
    met = fronts(a, "fq").join(fronts(b, "fi"), "front").select("fq", "fi").where(_distance("fq", "fi") <= radius).distinct()
    return (
        queries.select(F.col("doc_id").alias("query_id"), F.col("fingerprint").alias("fq"))
        .join(met, "fq")
        .join(index.select("doc_id", F.col("fingerprint").alias("fi")), "fi")
        .select("query_id", "doc_id", _distance("fq", "fi").alias("distance"))
    )


def count_near(rows: pd.DataFrame, radius: int) -> pd.DataFrame:
    """(id, near) of rows (front, t, side, id, n, fingerprint): how many rows of other fingerprints lie within the radius of each.

    Rows of a front are compared in full, those of side 0 with those of side 1 or, if there are none, with one another.
    A pair counts in the first of the tables that it meets in.
    """
    ids, near = rows["id"].to_numpy(np.int64), np.zeros(len(rows), np.int64)
    order = np.argsort(rows["front"].to_numpy(), kind="stable")
    front = rows["front"].to_numpy()[order]
    words = np.frombuffer(bytes.fromhex("".join(rows["fingerprint"])), np.uint32).reshape(-1, TABLES)
    n, side, table = (rows[c].to_numpy(np.int64) for c in ("n", "side", "t"))
    for own in np.split(order, np.flatnonzero(np.diff(front)) + 1):
        left, right = own[side[own] == 0], own[side[own] == 1]
        alone = not len(right)
        right = left if alone else right
        for at in range(0, len(left), 128):
            some = left[at : at + 128]
            apart = words[some][:, None, :] ^ words[right][None, :, :]
            met = np.bitwise_count(apart).sum(axis=2, dtype=np.int64) <= radius
            t = table[own[0]]
            met &= (apart[:, :, t] == 0) & (apart[:, :, :t] != 0).all(axis=2)
            if alone:
                met &= some[:, None] != right[None, :]
            near[some] += met @ n[right]
            if not alone:
                near[right] += n[some] @ met
    held = near > 0
    return pd.DataFrame({"id": ids[held], "near": near[held]})


def near_counts(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fingerprint, n, near): of every distinct fingerprint its number of rows, and of rows of others within the Hamming radius.

    Fingerprints within the radius agree in one of TABLES blocks at least; each table brings another block to the front, and those
    that share a front are compared in full. A front of many is cut into blocks that meet in pairs, a task each, and
    only counts come out. A front's hash stands for it; what it mixes up is told apart by the bits.
    """
    if not 0 <= radius < TABLES:
        raise ValueError(f"the radius must be under {TABLES}")
    classes = fingerprints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).withColumn("id", F.monotonically_increasing_id())
    classes = written(classes, "fingerprint-classes")
    keys = F.array(*[F.xxhash64(F.lit(t), F.substring("fingerprint", t * BITS // 4 // TABLES + 1, BITS // 4 // TABLES)) for t in range(TABLES)])
    fronts = classes.select("id", F.posexplode(keys).alias("t", "front"))
    open_ = written(fronts.groupBy("front").agg(F.count(F.lit(1)).alias("many")).where("many > 1"), "fronts")
    members = written(fronts.join(open_, "front").join(classes, "id").withColumn("blocks", F.ceil(F.col("many") / BLOCK).cast("int")), "front-members")
    together = 1 + members.count() // TOGETHER
    dealt = members.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(
        F.when(F.col("blocks") > 1, F.col("front")).otherwise(F.pmod(F.xxhash64("front"), F.lit(together))).alias("task"), F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"),
        "front", "t", (F.col("block") > F.col("other")).cast("int").alias("side"), "id", "n", "fingerprint",
    )
    near = dealt.groupBy("task", "x", "y").applyInPandas(lambda rows: count_near(rows, radius), "id long, near long").groupBy("id").agg(F.sum("near").alias("near"))
    return written(classes.join(near, "id", "left").select("fingerprint", "n", F.coalesce("near", F.lit(0)).alias("near")), "near-counts")


def with_near_docs(found: DataFrame, radius: int = RADIUS) -> DataFrame:
    """found, rows with a fingerprint, with near_docs: how many other rows' fingerprints lie within the radius, equal ones included."""
    table = written(found, "fingerprints")
    counts = near_counts(table.select("fingerprint"), radius)
    counts = counts.select("fingerprint", "n", (F.col("n") - 1 + F.col("near")).alias("near_docs"))
    return join_uneven(table, counts, ["fingerprint"], "n", table.count(), "doc_id")


def _bits(column, low: int, high: int):
    """The hex digits that hold the bits, with the bits outside masked away at either end."""
    first, last = low // 4, (high - 1) // 4 + 1
    digits = F.substring(column, first + 1, last - first)
    mask = "".join(f"{sum(8 >> (i % 4) for i in range(4 * d, 4 * d + 4) if low <= i < high):x}" for d in range(first, last))
    inside = 0 if mask[0] == "f" else 1
    outside = len(mask) - (0 if mask[-1] == "f" or len(mask) == inside else 1)
    masked = lambda at: F.conv(F.conv(F.substring(digits, at + 1, 1), 16, 10).cast("int").bitwiseAND(int(mask[at], 16)).cast("string"), 10, 16)
    parts = [masked(0)] * inside + [F.substring(digits, inside + 1, outside - inside)] + ([masked(len(mask) - 1)] if outside < len(mask) else [])
    return F.concat(*parts, F.lit(","))


def _distance(a: str, b: str):
    """How many bits differ, 32 at a time."""
    word = lambda c, i: F.conv(F.substring(c, 8 * i + 1, 8), 16, 10).cast("long")
    return sum((F.bit_count(word(a, i).bitwiseXOR(word(b, i))) for i in range(BITS // 32)), F.lit(0))

"""Line dedup: exact reference counts of line keys, sharded, each shard with a cuckoo filter of its frequent keys.

A key's count is the number of documents that hold it. Documents may be added and removed at any time; counts
are added or taken off, and keys that cross the threshold enter or leave their shard's filter. So what adding a
document did is undone exactly by removing it. When lines are dropped, the filter answers for nearly all of
them, and the exact keys beside it settle the rest: no line goes by a false positive. Of more frequent keys than
can be sent to the executors, the most frequent ones are sent, and lines of the others are joined to them once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import SPACES, written

_BLANK = SPACES.encode()
#: Bytes of filters and keys that are sent to the executors at most, and those of a key in both.
SENT, KEY_BYTES = 32 << 20, 24
#: Frequent keys that a shard holds on average.
SHARD_KEYS = 1 << 15
_SLOTS, _KICKS = 4, 500
_MIX = np.uint64(0x9E3779B97F4A7C15)


class CuckooFilter:
    """A set of 64-bit hashes: 16-bit marks in one of two buckets of four. Members are never denied."""

    def __init__(self, capacity: int = 16, table: np.ndarray | None = None):
        if table is None:
            buckets = 1 << max(1, int(np.ceil(np.log2(max(1, capacity) / (0.8 * _SLOTS)))))
            table = np.zeros((buckets, _SLOTS), np.uint16)
        self.table = table

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(marks, first buckets, second buckets); either bucket follows from the other and the mark."""
        mask = np.uint64(len(self.table) - 1)
        marks = (hashes >> np.uint64(48)).astype(np.uint16) | np.uint16(1)
        first = (hashes & mask).astype(np.int64)
        return marks, first, first ^ self._step(marks)

    def _step(self, marks: np.ndarray) -> np.ndarray:
        return ((marks.astype(np.uint64) * _MIX >> np.uint64(20)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        marks, first, second = self._places(hashes)
        return ((self.table[first] == marks[:, None]) | (self.table[second] == marks[:, None])).any(axis=1)

    def insert(self, value: int) -> bool:
        """False if no place was found; the filter is then to be made anew with more buckets."""
        marks, first, second = self._places(np.array([value], np.uint64))
        mark, at, other = marks[0], int(first[0]), int(second[0])
        for _ in range(_KICKS):
            for place in (at, other):
                free = np.flatnonzero(self.table[place] == 0)
                if len(free):
                    self.table[place, free[0]] = mark
                    return True
            slot = int(mark) % _SLOTS
            mark, self.table[other, slot] = self.table[other, slot], mark
            at = other
            other = at ^ int(self._step(np.array([mark]))[0])
        return False

    def delete(self, value: int) -> bool:
        """Removes one copy of a member; False if it isn't there."""
        marks, first, second = self._places(np.array([value], np.uint64))
        for place in (int(first[0]), int(second[0])):
            held = np.flatnonzero(self.table[place] == marks[0])
            if len(held):
                self.table[place, held[0]] = 0
                return True
        return False

    @classmethod
    def of(cls, hashes: np.ndarray) -> CuckooFilter:
        size = max(16, len(hashes))
        while True:
            made = cls(size)
            if all(made.insert(int(h)) for h in hashes):
                return made
            size *= 2


def line_keys(data: bytes) -> tuple[list[bytes], np.ndarray]:
    """The lines of a text, and the 128-bit hashes of their keys, zero for an empty key."""
    lines = data.split(b"\n")
    digests = [xxhash.xxh3_128_digest(k) if (k := line.strip(_BLANK).lower()) else bytes(16) for line in lines]
    return lines, np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)


def _packed(keys: np.ndarray) -> np.ndarray:
    """Keys as one field each, so that they sort and compare as a whole."""
    return np.ascontiguousarray(keys).view([("a", np.uint64), ("b", np.uint64)]).ravel()


def _document() -> F.Column:
    """What tells documents apart: doc_id; rows without one are one document."""
    return F.coalesce(F.concat(F.lit("0"), F.col("doc_id").cast("string")), F.lit("1"))


def _own_keys(batch: pa.RecordBatch, column: int, rows: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(place, distinct keys of each text) of so many rows at a time; empty keys are left out."""
    for at in range(0, batch.num_rows, rows):
        own = [np.unique(_packed(line_keys(t or b"")[1])) for t in batch.column(column).slice(at, rows).to_pylist()]
        yield at, [k[(k["a"] != 0) | (k["b"] != 0)] for k in own]


def reference_counts(docs: DataFrame) -> DataFrame:
    """(a, b, n): of each key (by its 128-bit hash) the number of documents that hold it, counted once in each.

    Rows that share a doc_id are one document, and so are rows without one. A null or empty text has one empty
    line; empty keys aren't counted. Rows are counted first; where documents have several rows, which their ids
    alone tell, what was counted more than once is taken off.
    """

    def by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, own in _own_keys(batch, 0, 1024):
                keys, counts = np.unique(np.concatenate(own), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys[c].view(np.int64)) for c in "ab"] + [pa.array(counts.astype(np.int64))], ["a", "b", "n"])

    def by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, own in _own_keys(batch, 1, 256):
                keys = np.concatenate(own)
                doc = batch.column(0).take(pa.array(np.repeat(np.arange(at, at + len(own)), [len(k) for k in own])))
                yield pa.RecordBatch.from_arrays([doc, *[pa.array(keys[c].view(np.int64)) for c in "ab"]], ["doc", "a", "b"])

    text = F.col("text").cast("string").cast("binary")
    counts = docs.select(text).mapInArrow(by_row, "a long, b long, n long")
    several = written(docs.select(_document().alias("doc")).groupBy("doc").count().where("count > 1").select("doc"), "several-rows")
    if not several.isEmpty():
        held = docs.select(_document().alias("doc"), text.alias("content")).join(several, "doc", "left_semi").mapInArrow(by_document, "doc string, a long, b long")
        over = held.groupBy("doc", "a", "b").count().where("count > 1").select("a", "b", (1 - F.col("count")).alias("n"))
        counts = counts.unionByName(over)
    return counts.groupBy("a", "b").agg(F.sum("n").alias("n"))


class LineIndex:
    """counts: (a, b, n) of all keys. filters: (shard, filter, keys) of the keys in at least least documents."""

    def __init__(self, counts: DataFrame, filters: DataFrame, least: int, shards: int):
        self.counts, self.filters, self.least, self.shards = counts, filters, least, shards

    @staticmethod
    def _shard(shards: int):
        return F.pmod(F.col("a"), F.lit(shards)).cast("int")

    @classmethod
    def _filters(cls, frequent: DataFrame, shards: int) -> DataFrame:
        """A filter for each shard of these keys, made where the shard's keys meet."""
        changed = frequent.select(cls._shard(shards).alias("shard"), "a", "b", F.lit(True).alias("enters"))
        return written(changed.groupBy("shard").applyInPandas(lambda rows: _shard_row(None, rows), "shard int, filter binary, keys binary"), "line-filters")

    @classmethod
    def build(cls, docs: DataFrame, least: int = 10) -> LineIndex:
        """Counts all keys, then makes each shard's filter; both are tables in the shared folder."""
        counts = written(reference_counts(docs), "line-counts")
        frequent = counts.where(F.col("n") >= least)
        shards = 1 + frequent.count() // SHARD_KEYS
        return cls(counts, cls._filters(frequent, shards), least, shards)

    def _changed(self, delta: DataFrame) -> LineIndex:
        """With counts added (or taken off); keys that cross the threshold enter or leave their filter.

        When shards hold twice as many keys as they should on average, there are new ones, of the size they should be.
        """
        was = self.counts.withColumnRenamed("n", "was")
        both = was.join(delta, ["a", "b"], "full_outer").select("a", "b", F.coalesce("was", F.lit(0)).alias("was"), (F.coalesce("was", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n"))
        both = written(both, "line-counts")
        counts, frequent = both.where(F.col("n") > 0).select("a", "b", "n"), both.where(F.col("n") >= self.least)
        needed = 1 + frequent.count() // SHARD_KEYS
        if needed > 2 * self.shards:
            return LineIndex(counts, self._filters(frequent, needed), self.least, needed)
        crossing = both.where((F.col("was") >= self.least) != (F.col("n") >= self.least))
        changes = crossing.select(self._shard(self.shards).alias("shard"), "a", "b", (F.col("n") >= self.least).alias("enters"))
        filters = (
            self.filters.groupBy("shard").cogroup(changes.groupBy("shard"))
            .applyInPandas(lambda old, rows: _shard_row(old.iloc[0] if len(old) else None, rows), "shard int, filter binary, keys binary")
        )
        return LineIndex(counts, written(filters, "line-filters"), self.least, self.shards)

    def insert(self, docs: DataFrame) -> LineIndex:
        """Adds documents that aren't in it, each with all its rows."""
        return self._changed(reference_counts(docs))

    def delete(self, docs: DataFrame) -> LineIndex:
        """Takes off documents that were added before, each with all its rows."""
        return self._changed(reference_counts(docs).withColumn("n", -F.col("n")))

    def sent(self) -> tuple[_Dropper, DataFrame | None]:
        """What answers for the most frequent keys, SENT bytes at most, and (a, b) of the other frequent ones, if any."""
        size = self.filters.agg(F.sum(F.length("filter") + F.length("keys"))).first()[0] or 0
        if size <= SENT:
            return _Dropper(self.filters.collect(), self.shards), None
        frequent = self.counts.where(F.col("n") >= self.least)
        powers = frequent.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).count().orderBy(F.desc("power")).collect()  # 64 rows at most
        bound, keys = 64, 0
        for power, count in powers:
            if (keys + count) * KEY_BYTES > SENT:
                break
            bound, keys = power, keys + count
        often, shards = F.floor(F.log2("n")) >= bound, 1 + keys // SHARD_KEYS
        return _Dropper(self._filters(frequent.where(often), shards).collect(), shards), frequent.where(~often).select("a", "b")


def _shard_row(old: pd.Series | None, rows: pd.DataFrame) -> pd.DataFrame:
    """A shard's filter and sorted keys after some keys have entered and others have left."""
    keys = np.frombuffer(old["keys"], np.uint64).reshape(-1, 2) if old is not None else np.zeros((0, 2), np.uint64)
    shard = int(old["shard"]) if old is not None else int(rows["shard"].iloc[0])
    changed = rows[["a", "b"]].to_numpy(np.int64).view(np.uint64).reshape(-1, 2)
    enters = rows["enters"].to_numpy(bool)
    kept = np.setdiff1d(np.union1d(_packed(keys), _packed(changed[enters])), _packed(changed[~enters]))
    if old is None:
        made = CuckooFilter.of(kept["a"])
    else:
        made = CuckooFilter(table=np.frombuffer(old["filter"], np.uint16).reshape(-1, _SLOTS).copy())
        removed = all([made.delete(int(a)) for a in changed[~enters][:, 0]])
        if not removed or not all(made.insert(int(a)) for a in changed[enters][:, 0]):
            made = CuckooFilter.of(kept["a"])
    return pd.DataFrame({"shard": [shard], "filter": [made.table.tobytes()], "keys": [kept.tobytes()]})


class _Dropper:
    """Answers for the keys of these shards."""

    def __init__(self, rows: list, shards: int):
        self.shards = shards
        self.parts = {r["shard"]: (CuckooFilter(table=np.frombuffer(r["filter"], np.uint16).reshape(-1, _SLOTS)), np.frombuffer(r["keys"], [("a", np.uint64), ("b", np.uint64)])) for r in rows}

    def hits(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), bool)
        at = np.mod(keys[:, 0].view(np.int64), self.shards)
        for shard, (passed, exact) in self.parts.items():
            own = np.flatnonzero(at == shard)
            own = own[passed.contains(keys[own, 0])] if len(own) else own
            if len(own) and len(exact):
                found = _packed(keys[own])
                place = np.minimum(np.searchsorted(exact, found), len(exact) - 1)
                out[own] = exact[place] == found
        return out


def drop_lines(docs: DataFrame, index: LineIndex, digest: bool = False) -> DataFrame:
    """The documents without their frequent lines.

    With digest: (doc_id, n_lines, n_dropped, kept_sha256). Else all columns, with the new text and, where there
    is such a column, its new n_chars. A null or empty text is one empty line, and stays as it is. Rows are
    independent: repeated rows give repeated rows.
    """
    if digest:
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names, schema = docs.columns, docs.schema
    dropper, others = index.sent()
    sent = docs.sparkSession.sparkContext.broadcast(dropper)
    if others is not None:
        docs = _with_places(docs, sent, others)
    return docs.mapInArrow(_dropping(sent, names, digest, others is not None), "doc_id long, n_lines long, n_dropped long, kept_sha256 string" if digest else schema)


def _with_places(docs: DataFrame, sent, others: DataFrame) -> DataFrame:
    """docs and, last, an array of the lines whose keys are among others: lines are joined to keys, their places to rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keys = [line_keys(t or b"")[1] for t in part.column(2).to_pylist()]
                row, place = np.repeat(np.arange(len(keys)), [len(k) for k in keys]), np.concatenate([np.arange(len(k)) for k in keys])
                keys = np.concatenate(keys)
                open_ = keys.any(axis=1) & ~sent.value.hits(keys)
                columns = [part.column(c).take(pa.array(row[open_])) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(place[open_].astype(np.int32)), *[pa.array(keys[open_, c].view(np.int64)) for c in (0, 1)]], ["doc", "digest", "place", "a", "b"])

    text = F.col("text").cast("string")
    lines = docs.select(_document(), F.xxhash64(text), text.cast("binary")).mapInArrow(run, "doc string, digest long, place int, a long, b long")
    places = lines.join(others, ["a", "b"]).groupBy("doc", "digest").agg(F.collect_set("place").alias("places"))  # of one text's lines
    rows = docs.select(F.struct("*").alias("row"), _document().alias("doc"), F.xxhash64(text).alias("digest")).join(places, ["doc", "digest"], "left")
    return rows.select("row.*", F.col("places").alias("_".join([*docs.columns, "places"])))


def _dropping(sent, names: list[str], digest: bool, placed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [None if t is None else t.encode() for t in part.column(names.index("text")).to_pylist()]
                split = [line_keys(t or b"") for t in texts]
                hits = sent.value.hits(np.concatenate([k for _, k in split])) if split else np.zeros(0, bool)
                kept, gone, first = [], [], 0
                for (lines, _), text, places in zip(split, texts, part.column(len(names)).to_pylist() if placed else [None] * len(texts), strict=True):
                    own = hits[first : first + len(lines)]
                    first += len(lines)
                    own[places or []] = True
                    gone.append(int(own.sum()))
                    kept.append(text if not gone[-1] else b"\n".join([x for x, dropped in zip(lines, own.tolist(), strict=True) if not dropped]))
                columns = dict(zip(names, part.columns, strict=False))
                if digest:
                    counts = [pa.array([len(x) for x, _ in split], pa.int64()), pa.array(gone, pa.int64())]
                    shas = pa.array([hashlib.sha256(k or b"").hexdigest() for k in kept], pa.string())
                    yield pa.RecordBatch.from_arrays([columns["doc_id"], *counts, shas], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])
                    continue
                if "n_chars" in columns and any(gone):
                    was = columns["n_chars"].to_pylist()
                    columns["n_chars"] = pa.array([len(k.decode()) if g else w for k, g, w in zip(kept, gone, was, strict=True)], columns["n_chars"].type)
                columns["text"] = pa.array([None if k is None else k.decode() for k in kept], columns["text"].type)
                yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    return run

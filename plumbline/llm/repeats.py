"""Removal of repeated byte strings by prefix-free parsing, over the whole corpus and exactly.

A rolling hash of KEY bytes that leaves 0 when divided by EVERY triggers a phrase border. A string of LENGTH bytes
belongs to the first trigger in it, or, where none fires, to its KEY bytes of least hash. So equal strings have equal
triggers at the same distance; of a trigger, a phrase suffix lies before it, and the parse's suffix from the trigger on
after it. A phrase here is all strings of one trigger; phrases overlap by LENGTH - 1 bytes, each string starts in one.

1. Triggers found once are dropped: no string with such a trigger has a copy.
2. Of the parse, a phrase that occurs earlier as a whole is covered as a whole. The others make up the dictionary.
3. Of phrases that share a trigger, the dictionary's are ranked by their bytes read back from the trigger, and the
   parse's suffixes by their bytes from the trigger on, cut at LENGTH, each with the length that neighbours share. The
   two orders combined give the order of all strings: those that start s bytes before the trigger are equal if
   neighbours in the first order share s bytes, and in the second LENGTH - s. A string that isn't the earliest of
   its equals is covered.

So rows are phrases, never bytes, but for triggers of very many phrases. Rows travel as packed arrays. Membership in a set of
triggers or phrases is sent as Bloom filters of bounded size; what they let through too much is settled exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import forget, text_bytes, with_columns, written

LENGTH, KEY, EVERY = 100, 32, 32
REACH = LENGTH - KEY + 1  # places of a trigger in a string
#: Bytes hashed at a time, and the longest stretch of one text; a longer text is cut, with LENGTH - 1 bytes shared.
BUFFER, STRETCH = 1 << 19, 1 << 20
#: Items that a task packs before it sends them; phrases with their bytes are packed fewer at a time.
PACK, PACK_BYTES = 1 << 20, 1 << 16
#: Distinct phrases of a trigger above which its strings are dealt out one by one, as hashes of 128 bits.
HOT = 4096
#: Bytes that a Bloom filter may take; above, the filter lets more through than it need.
BLOOM = 32 << 20
#: Bytes of texts of a part, as long as there are no more than PARTS parts; phrases that are ranked at a time.
PART_BYTES, PARTS, RANKED = 32 << 20, 1 << 16, 1 << 15
#: Where a row without doc_id stands: after all others.
LAST = (1 << 63) - 1
#: A document: its id, and a hash of its text, since ids may be missing or shared.
DOC = np.dtype([("id", np.int64), ("text", np.uint64)])
_B1, _B2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_POS = np.uint64(21)


def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    n = STRETCH + BUFFER + 1
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, np.uint64(b))
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


_TABLES: list[tuple[np.ndarray, np.ndarray]] = []


def _tables() -> list[tuple[np.ndarray, np.ndarray]]:
    if not _TABLES:
        _TABLES.extend([_powers(_B1), _powers(_B2)])
    return _TABLES


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Parse:
    """The phrases of a buffer of texts: arrays with one entry for each, in order.

    trigger: hash of the trigger; whole: hash of the phrase, of another kind; of, start, end: where it is; doc: the id
    alone; before: bytes of the phrase before its trigger.
    """

    def __init__(self, data: np.ndarray, docs: np.ndarray, bases: np.ndarray, sizes: np.ndarray, wholes: bool = True):
        """Texts one after the other in data; of each the doc, the place in its document and the size."""
        self.data = data
        ends = np.cumsum(sizes)
        (up, down), (up2, down2) = _tables()
        n = len(data)
        summed = np.zeros(n + 1, np.uint64)
        np.cumsum(data * down[:n], out=summed[1:])
        grams = _mixed((summed[KEY:] - summed[:-KEY]) * up[: n - KEY + 1])
        place = np.arange(len(grams), dtype=np.uint64)
        least, width = (grams >> _POS << _POS) | place, 1
        while 2 * width <= REACH:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if REACH > width:
            least = np.minimum(least[: len(least) - (REACH - width)], least[REACH - width :])
        text = np.repeat(np.arange(len(sizes)), sizes)[: len(least)]
        starts = np.flatnonzero(np.arange(len(least)) + LENGTH <= ends[text])  # strings inside one text
        fired = np.where(grams & np.uint64(EVERY - 1), np.int64(1 << 40), place.astype(np.int64))
        at = np.minimum.accumulate(fired[::-1])[::-1][starts]
        at = np.where(at < starts + REACH, at, (least[starts] & np.uint64((1 << 21) - 1)).astype(np.int64))
        of = text[starts]
        first = np.ones(len(starts), bool)
        first[1:] = (at[1:] != at[:-1]) | (of[1:] != of[:-1])
        runs = np.flatnonzero(first)
        self.low = starts[runs]
        self.high = starts[np.append(runs[1:], len(starts)) - 1] + LENGTH if len(runs) else self.low
        trigger_at, of = at[runs], of[runs]
        self.before = trigger_at - self.low
        # Triggers' hashes are multiples or small numbers; mixed again, they are dealt evenly.
        self.trigger = _mixed(grams[trigger_at] + np.uint64(1))
        offset = bases[of] - (ends - sizes)[of]
        self.of, self.start, self.end = docs[of], self.low + offset, self.high + offset
        self.doc = self.of["id"]
        if wholes:
            np.cumsum(data * down2[:n], out=summed[1:])
            shape = (self.high - self.low).astype(np.uint64) << np.uint64(32) | self.before.astype(np.uint64)
            self.whole = _mixed((summed[self.high] - summed[self.low]) * up2[self.low] + _mixed(shape))


def parses(batches: Iterator[pa.RecordBatch], wholes: bool = True) -> Iterator[Parse]:
    """Parses of (doc_id, content) batches, some texts at a time; texts under LENGTH bytes have no phrases."""
    held: list[tuple[tuple[int, int], int, bytes]] = []
    size = 0

    def parse() -> Parse:
        data = np.frombuffer(b"".join(x for _, _, x in held), np.uint8)
        return Parse(data, np.array([d for d, _, _ in held], DOC), np.array([b for _, b, _ in held], np.int64), np.array([len(x) for _, _, x in held], np.int64), wholes)

    for ids, texts in with_columns(batches):
        for doc_id, text in zip(ids, texts, strict=True):
            doc = (doc_id, xxhash.xxh64_intdigest(text, 42))  # as Spark's xxhash64 has it
            for base in range(0, max(1, len(text) - LENGTH + 1), STRETCH - LENGTH + 1):
                part = text[base : base + STRETCH]
                if len(part) < LENGTH:
                    continue
                held.append((doc, base, part))
                size += len(part)
                if size >= BUFFER:
                    yield parse()
                    held, size = [], 0
    if held:
        yield parse()


class Bloom:
    """A filter of 64-bit hashes, in parts by their top bits; each part is made where its hashes are."""

    def __init__(self, parts: dict[int, np.ndarray], bits: int):
        self.bits, self.parts = bits, parts

    @staticmethod
    def made(hashes: np.ndarray, most: int) -> bytes:
        """A part of at most so many bytes."""
        size = 64
        while size < 2 * len(hashes) and 2 * size <= most:
            size *= 2
        table = np.zeros(size, np.uint8)
        for i in range(3):
            bit = Bloom._bit(hashes, i, size)
            np.bitwise_or.at(table, bit >> 3, (1 << (bit & 7)).astype(np.uint8))
        return table.tobytes()

    @staticmethod
    def _bit(hashes: np.ndarray, i: int, size: int) -> np.ndarray:
        return (_mixed(hashes + np.uint64(i * 0x1234567)) & np.uint64(8 * size - 1)).astype(np.int64)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), bool)
        order = np.argsort(hashes)
        tops = (hashes[order] >> np.uint64(64 - self.bits)).astype(np.int64)
        cuts = np.append(np.flatnonzero(np.diff(tops, prepend=-1)), len(tops))
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            table = self.parts.get(int(tops[low]))
            if table is not None:
                own = order[low:high]
                found = np.ones(len(own), bool)
                for i in range(3):
                    bit = self._bit(hashes[own], i, len(table))
                    found &= (table[bit >> 3] >> (bit & 7) & 1).astype(bool)
                out[own] = found
        return out


def _dealt(key: np.ndarray, bits: int, columns: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """(part, packed columns) by the top bits of the key."""
    tops = (key >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(tops, kind="stable")
    columns, tops = [c[order] for c in columns], tops[order]
    cuts = np.append(np.flatnonzero(np.diff(tops, prepend=-1)), len(tops))
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(tops[low]), _packed([c[low:high] for c in columns])


def _packed(columns: list[np.ndarray]) -> bytes:
    return np.int64(len(columns[0])).tobytes() + b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def _unpacked(blobs: Iterator[bytes], types: list) -> list[np.ndarray]:
    out: list[list[np.ndarray]] = [[] for _ in types]
    for blob in blobs:
        n, at = int(np.frombuffer(blob, np.int64, 1)[0]), 8
        for held, kind in zip(out, types, strict=True):
            held.append(np.frombuffer(blob, kind, n, at))
            at += held[-1].nbytes
    return [np.concatenate(h) if h else np.zeros(0, k) for h, k in zip(out, types, strict=True)]


def _rows(pairs: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in pairs], pa.int32()), pa.array([b for _, b in pairs], pa.binary())], ["part", "packed"])


def _scan(docs: DataFrame, collected: Callable, wholes: bool) -> DataFrame:
    """(part, packed) of what collected makes of the parses of a task, some millions of items at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for parse in parses(batches, wholes):
            columns = collected(parse)
            held.append(columns)
            size += len(columns[0])
            if size >= collected.pack:
                yield from map(_rows, _sliced(collected.send([np.concatenate(c) for c in zip(*held, strict=True)])))
                held, size = [], 0
        if size:
            yield from map(_rows, _sliced(collected.send([np.concatenate(c) for c in zip(*held, strict=True)])))

    return docs.mapInArrow(run, "part int, packed binary")


def _sliced(pairs: Iterator[tuple[int, bytes]]) -> Iterator[list[tuple[int, bytes]]]:
    """Pairs in lists of bounded size."""
    held, size = [], 0
    for pair in pairs:
        held.append(pair)
        size += len(pair[1])
        if size > 4 << 20:
            yield held
            held, size = [], 0
    if held:
        yield held


class _Triggers:
    """All triggers; each at most twice from a task."""

    pack = PACK

    def __init__(self, bits: int):
        self.bits = bits

    def __call__(self, parse: Parse) -> list[np.ndarray]:
        return [parse.trigger]

    def send(self, columns: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
        found, counts = np.unique(columns[0], return_counts=True)
        found = np.repeat(found, np.minimum(counts, 2))
        return _dealt(found, self.bits, [found])


_PHRASE = [np.uint64, np.uint64, DOC, np.int32, np.int32]
#: Marks the packed rows of phrases that their own task has found covered.
_COVERED = np.uint64(0)


class _Phrases:
    """Phrases of triggers that were found more than once: trigger, whole, doc, start, end.

    Of equal ones in a task the first is sent for all; the others are covered, and are sent as such (whole 0).
    """

    pack = PACK

    def __init__(self, bits: int, bloom):
        self.bits, self.bloom = bits, bloom

    def __call__(self, parse: Parse) -> list[np.ndarray]:
        kept = self.bloom.value.holds(parse.trigger)
        return [parse.trigger[kept], parse.whole[kept] | np.uint64(1), parse.of[kept], parse.start[kept].astype(np.int32), parse.end[kept].astype(np.int32)]

    def send(self, columns: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
        columns, later = _first_and_later(columns)
        columns[1][later] = _COVERED
        # Copies of a hot phrase are dealt out by where they are.
        key = np.where(later, _mixed(columns[2]["id"].view(np.uint64) ^ columns[2]["text"]), _mixed(columns[0] ^ columns[1] * np.uint64(_B1)))
        return _dealt(key, self.bits, columns)


def _first_and_later(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Phrases sorted so that equal ones are neighbours, and which of them come later than the first of their kind."""
    order = np.lexsort((columns[3], columns[2]["text"], columns[2]["id"], columns[1], columns[0]))
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    # A row that is there twice is no copy of itself.
    later = (columns[2] != columns[2][head]) | (columns[3] != columns[3][head])
    return columns, later


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values are in a sorted table."""
    at = np.searchsorted(table, values)
    found = at < len(table)
    found[found] = table[at[found]] == values[found]
    return found


def _place_key(doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    return _mixed(_mixed(_mixed(doc["id"].view(np.uint64)) ^ doc["text"]) + start.astype(np.uint64))


class _Suffixes:
    """Bytes of the chosen phrases, by trigger; of hot triggers the strings themselves, by their hash.

    Which triggers are hot is known exactly, so all phrases of a trigger go the same way; what filters let through
    too much is only looked into in vain. Parts of hashes are numbered after those of phrases.
    """

    pack = PACK_BYTES

    def __init__(self, bits: int, chosen, of_hot, hot):
        """Filters of the phrases of other triggers and of hot ones, and the hot triggers, sorted."""
        self.bits, self.chosen, self.of_hot, self.hot = bits, chosen, of_hot, hot

    def __call__(self, parse: Parse) -> list[np.ndarray]:
        key = _place_key(parse.of, parse.start)
        hot = _among(parse.trigger, self.hot.value)
        kept = np.flatnonzero(np.where(hot, self.of_hot.value.holds(key), self.chosen.value.holds(key)))
        width = parse.high[kept] - parse.low[kept]
        cells = np.zeros((len(kept), LENGTH + REACH - 1), np.uint8)
        for i, (low, n) in enumerate(zip(parse.low[kept].tolist(), width.tolist(), strict=True)):
            cells[i, :n] = parse.data[low : low + n]
        return [parse.trigger[kept], parse.of[kept], parse.start[kept].astype(np.int32), width.astype(np.int32), parse.before[kept].astype(np.int32), hot[kept], cells]

    def send(self, columns: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
        hot, cells = columns[5:]
        plain = [c[~hot] for c in [*columns[:5], cells]]
        yield from _dealt(plain[0], self.bits, plain)
        own = np.flatnonzero(hot)
        for at in range(0, len(own), 4096):
            rows = own[at : at + 4096]
            row, shift = _strings_of(columns[3][rows])
            own_cells = cells[rows]
            digests = b"".join(xxhash.xxh3_128_digest(own_cells[i, j : j + LENGTH].tobytes()) for i, j in zip(row.tolist(), shift.tolist(), strict=True))
            a, b = np.frombuffer(digests, np.uint64).reshape(-1, 2).T
            start = (columns[2][rows][row] + shift).astype(np.int32)
            for part, packed in _dealt(a, self.bits, [a, b, columns[1][rows][row], start, start + np.int32(LENGTH)]):
                yield part + (1 << self.bits), packed


def _strings_of(width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, shift) of every string of LENGTH bytes in rows of these widths."""
    counts = width.astype(np.int64) - LENGTH + 1
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def _ranked(group: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each row, bytes shared with the row before) in the order of groups, and in a group of cells' bytes."""
    named = np.empty((len(cells), cells.shape[1] + 4), np.uint8)
    named[:, :4] = group.astype(">u4").view(np.uint8).reshape(-1, 4)
    named[:, 4:] = cells
    order = np.argsort(named.view(f"S{named.shape[1]}").ravel(), kind="stable")
    cells, group = cells[order], group[order]
    shared = np.full(len(order), -1, np.int64)
    differ = cells[1:] != cells[:-1]
    shared[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), cells.shape[1])
    shared[1:][group[1:] != group[:-1]] = -1
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place, shared


def _equal_strings(columns: list[np.ndarray]) -> list[np.ndarray]:
    """(doc, start, end) that are covered, of phrases (trigger, doc, start, width, before, cells).

    Phrases of a trigger are ranked twice, by their bytes back from the trigger and by those from it on; a string's class is
    its classes in both orders.
    """
    trigger, doc, start, width, before, cells = columns
    order = np.lexsort((start + before, doc["text"], doc["id"], trigger))
    trigger, doc, start, width, before, cells = (c[order] for c in (trigger, doc, start, width, before, cells))
    cuts = np.append(np.flatnonzero(np.diff(trigger, prepend=~trigger[:1])), len(trigger))
    group = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    out: list[list[np.ndarray]] = [[], [], []]
    at = 0
    while at < len(cuts) - 1:
        last = at + 1
        while last < len(cuts) - 1 and cuts[last + 1] - cuts[at] <= RANKED:
            last += 1
        own = slice(cuts[at], cuts[last])
        at = last
        if own.stop - own.start < 2:
            continue
        d, trigger_at, b = doc[own], start[own].astype(np.int64) + before[own], before[own].astype(np.int64)
        # Bytes back from the trigger, and from it on; what a phrase hasn't is 0, and no string of it needs it.
        padded = np.pad(cells[own], ((0, 0), (REACH - 1, LENGTH)))
        row = np.arange(len(b))[:, None]
        middle = (b + REACH - 1)[:, None]
        back = padded[row, middle - 1 - np.arange(REACH - 1)]
        phrase, shared_back = _ranked(group[own], back)
        suffix, shared_on = _ranked(group[own], padded[row, middle + np.arange(LENGTH)])
        for s in range(REACH):
            there = np.flatnonzero((s <= b) & (s >= LENGTH + b - width[own]))
            if len(there) < 2:
                continue
            key = np.cumsum(shared_back < s)[phrase[there]] << 32 | np.cumsum(shared_on < LENGTH - s)[suffix[there]]
            _, first, of = np.unique(key, return_index=True, return_inverse=True)
            head = there[first][of]  # rows are in order of where they are
            gone = there[(d[there] != d[head]) | (trigger_at[there] != trigger_at[head])]
            for held, x in zip(out, (d[gone], trigger_at[gone] - s, trigger_at[gone] - s + LENGTH), strict=True):
                held.append(x)
        # One range for strings that meet, before more are found.
        for held, x in zip(out, _joined(*[np.concatenate(h) if h else np.zeros(0, k) for h, k in zip(out, (DOC, np.int64, np.int64), strict=True)]), strict=True):
            held[:] = [x]
    return [np.concatenate(h) if h else np.zeros(0, k) for h, k in zip(out, (DOC, np.int32, np.int32), strict=True)]


def _joined(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Ranges of equal documents that meet or overlap, as one."""
    if not len(doc):
        return [doc, start.astype(np.int32), end.astype(np.int32)]
    order = np.lexsort((start, doc["text"], doc["id"]))
    doc, start, end = doc[order], start[order], end[order]
    own = np.append(0, np.cumsum(doc[1:] != doc[:-1])).astype(np.int64) << 33
    reach = np.maximum.accumulate(own + end)
    new = np.ones(len(doc), bool)
    new[1:] = own[1:] + start[1:] > reach[:-1]
    heads = np.flatnonzero(new)
    return [doc[heads], start[heads].astype(np.int32), (reach[np.append(heads[1:], len(doc)) - 1] - own[heads]).astype(np.int32)]


def _named(doc: np.ndarray) -> dict[str, np.ndarray]:
    return {"doc": doc["id"], "text": doc["text"].view(np.int64)}


def _per_part(df: DataFrame, schema: str, fn: Callable) -> DataFrame:
    """Each part's packed rows as one group; their number grows with the texts' bytes."""
    return df.groupBy("part").applyInPandas(fn, schema)


def _bloom(df: DataFrame, bits: int, hashed: Callable) -> Bloom:
    """The filter of a part each, from (part, table); at most BLOOM bytes in all come to the driver."""
    rows = _per_part(df, "part int, filter binary", hashed).where("filter is not null").collect()
    return Bloom({r["part"]: np.frombuffer(r["filter"], np.uint8) for r in rows}, bits)


def covered_ranges(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc, text, start, end), text the hash of the text: ranges of bytes that strings of LENGTH bytes with an earlier copy cover; they may overlap."""
    spark = docs.sparkSession
    size = docs.select(F.sum(F.length(text_bytes()))).first()[0] or 0
    parts = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")), min(PARTS, size // PART_BYTES))
    bits = int(np.ceil(np.log2(parts)))
    most = max(64, BLOOM >> bits)
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), text_bytes().alias("content"))
    sent = spark.sparkContext.broadcast

    def repeated(rows: pd.DataFrame) -> pd.DataFrame:
        (found,) = _unpacked(rows["packed"], [np.uint64])
        found.sort()
        twice = np.unique(found[1:][found[1:] == found[:-1]])
        return pd.DataFrame({"part": rows["part"].iloc[:1], "filter": [Bloom.made(twice, most) if len(twice) else None]})

    triggers = sent(_bloom(_scan(source, _Triggers(bits), False), bits, repeated))

    def first_phrases(rows: pd.DataFrame) -> pd.DataFrame:
        columns = _unpacked(rows["packed"], _PHRASE)
        marked = columns[1] == _COVERED
        own, later = _first_and_later([c[~marked] for c in columns])
        gone = _joined(*[np.concatenate([c[marked], o[later]]) for c, o in zip(columns[2:], own[2:], strict=True)])
        kept = [o[~later] for o in own]
        return pd.DataFrame({
            "trigger": np.concatenate([kept[0].view(np.int64), np.zeros(len(gone[0]), np.int64)]), "covered": np.repeat([False, True], [len(kept[0]), len(gone[0])]),
            **_named(np.concatenate([kept[2], gone[0]])), "start": np.concatenate([kept[3], gone[1]]), "end": np.concatenate([kept[4], gone[2]]),
        })

    phrases = written(_per_part(_scan(source, _Phrases(bits, triggers), True), "trigger long, covered boolean, doc long, text long, start int, end int", first_phrases), "phrases")
    dictionary = phrases.where("not covered").select("trigger", "doc", "text", "start")
    several = written(dictionary.groupBy("trigger").count().where("count > 1"), "triggers")
    # Only phrases whose trigger has other phrases are looked into.
    chosen = written(dictionary.join(several, "trigger").select("doc", "text", "start", (F.col("count") > hot).alias("hot")), "chosen-phrases")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, text, start = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            docs = np.zeros(len(doc), DOC)
            docs["id"], docs["text"] = doc, text.view(np.uint64)
            key = _place_key(docs, start)
            if len(key):
                yield _rows(list(_dealt(key, bits, [key])))

    def members(rows: pd.DataFrame) -> pd.DataFrame:
        (found,) = _unpacked(rows["packed"], [np.uint64])
        return pd.DataFrame({"part": rows["part"].iloc[:1], "filter": [Bloom.made(found, most)]})

    filters = [sent(_bloom(chosen.where(F.col("hot") == which).select("doc", "text", "start").mapInArrow(keyed, "part int, packed binary"), bits, members)) for which in (False, True)]
    # Each has more than so many phrases, so these are few.
    hot_triggers = sent(np.sort(several.where(F.col("count") > hot).select("trigger").toArrow()["trigger"].to_numpy().astype(np.int64).view(np.uint64)))

    def suffixes(rows: pd.DataFrame) -> pd.DataFrame:
        if rows["part"].iloc[0] >> bits:
            own, later = _first_and_later(_unpacked(rows["packed"], _PHRASE))
            doc, start, end = _joined(*[c[later] for c in own[2:]])
            return pd.DataFrame({**_named(doc), "start": start, "end": end})
        types = [np.uint64, DOC, np.int32, np.int32, np.int32, np.dtype((np.uint8, (LENGTH + REACH - 1,)))]
        doc, start, end = _equal_strings(_unpacked(rows["packed"], types))
        return pd.DataFrame({**_named(doc), "start": start, "end": end})

    inner = written(_per_part(_scan(source, _Suffixes(bits, *filters, hot_triggers), True), "doc long, text long, start int, end int", suffixes), "covered-strings")
    for table in (several, chosen):
        forget(table)
    return phrases.where("covered").select("doc", "text", "start", "end").unionByName(inner)


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, content) of every row: its text as bytes without what is covered.

    A null text is an empty one; texts under LENGTH bytes lose nothing. Order is by doc_id, rows without one come
    last. Rows that share a doc_id are in order of a hash of their texts; those that share a text, too, are one
    document: neither is the other's earlier copy.
    """
    ranges = covered_ranges(docs, hot).select("doc", "text", F.shiftleft(F.col("start").cast("long"), 32).bitwiseOR(F.col("end").cast("long")).alias("range"))
    by_doc = ranges.groupBy("doc", "text").agg(F.collect_list("range").alias("ranges"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), text_bytes().alias("content"))
    both = rows.withColumn("text", F.xxhash64("content")).join(by_doc, ["doc", "text"], "left").select("doc_id", "content", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for doc, text, packed in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    place = np.array(packed or [], np.int64)
                    low, high = place >> 32, np.minimum(place & 0xFFFFFFFF, len(text))
                    _, low, high = _joined(np.zeros(len(place), DOC), low, high)
                    kept, so_far = [], 0
                    for a, b in zip(low.tolist(), high.tolist(), strict=True):
                        kept.append(text[so_far:a])
                        so_far = b
                    left = b"".join([*kept, text[so_far:]])
                    out.append((doc, len(text), len(text) - len(left), len(low), hashlib.sha256(left).hexdigest(), left))
                types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), types, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "content"])

    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, content binary")

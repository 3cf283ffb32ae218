"""Exact alignment of two lists of texts, each text in turn with the free one most like it, and inversions of places.

How alike two texts are is the ratio of their matching blocks, which is costly. Matching blocks are a common
subsequence, and that is made up of common characters, so few pairs need it: those whose lengths, counts of characters
and longest common subsequence allow a ratio that is enough and at least the best so far. Nothing is left out that
could have been chosen.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import by_rows, ratio

#: Characters are counted by their last bits; characters that share them only loosen the bound. Of so few texts each is looked at first.
CLASSES, FEW = 64, 64


def bit_masks(text: str) -> dict[str, int]:
    """The places of each character of a text, as bits."""
    masks: dict[str, int] = {}
    for at, c in enumerate(text):
        masks[c] = masks.get(c, 0) | 1 << at
    return masks


def common_length(masks: dict[str, int], full: int, other: str) -> int:
    """The length of the longest common subsequence, from the bits at which a text has each character."""
    row = full
    for c in other:
        both = row & masks.get(c, 0)
        row = ((row + both) | (row - both)) & full
    return (full ^ row).bit_count()


def _counts(texts: list[str]) -> np.ndarray:
    """Characters of each text by class, a row each."""
    out = np.zeros((len(texts), CLASSES), np.int32)
    for row, text in zip(out, texts, strict=True):
        row += np.bincount(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) & (CLASSES - 1), minlength=CLASSES).astype(np.int32)
    return out


class _Free:
    """The texts that are still free."""

    def __init__(self, texts: list[str], least: float):
        self.texts, self.least = texts, least
        self.free, self.lengths, self.counts = [True] * len(texts), None, None
        self.places: dict[str, list[int]] = {}
        for at, text in enumerate(texts):
            self.places.setdefault(text, []).append(at)

    def take(self, at: int) -> int:
        self.free[at] = False
        return at

    def same(self, text: str) -> int | None:
        """The last free text that equals one; nothing is more alike."""
        places = self.places.get(text, [])
        while places and not self.free[places[-1]]:
            places.pop()
        return places[-1] if places else None

    def _near(self, text: str) -> list[int]:
        """The places of free texts that have a length that will do and a character of this one."""
        n, own = len(text), set(text)
        return [i for i, (free, t) in enumerate(zip(self.free, self.texts, strict=True)) if free and 2.0 * min(len(t), n) >= self.least * (len(t) + n) and not own.isdisjoint(t)]

    def possible(self, text: str) -> list[tuple[int, float]]:
        """(place, bound) of the free texts that lengths and characters allow, the greatest bound first, later ones of equal ones first."""
        if self.least > 0 and len(self.texts) <= FEW and len(near := self._near(text)) <= FEW // 8:
            own, found = Counter(text), []
            for at in near:
                other = self.texts[at]
                bound = 2.0 * sum(min(n, other.count(c)) for c, n in own.items()) / (len(other) + len(text))
                if bound >= self.least:
                    found.append((at, bound))
            return sorted(found, key=lambda x: (-x[1], -x[0]))
        if self.counts is None:
            self.counts, self.lengths = _counts(self.texts), np.array([len(t) for t in self.texts], np.int64)
        n = len(text)
        at = np.flatnonzero(np.array(self.free, bool) & (2.0 * np.minimum(self.lengths, n) >= self.least * (self.lengths + n)))
        bounds = 2.0 * np.minimum(self.counts[at], _counts([text])[0]).sum(axis=1) / np.maximum(self.lengths[at] + n, 1)
        at, bounds = at[bounds >= self.least], bounds[bounds >= self.least]
        order = np.lexsort((-at, -bounds))
        return list(zip(at[order].tolist(), bounds[order].tolist(), strict=True))

    def best(self, text: str) -> int | None:
        best, found, possible = self.least, -1, self.possible(text)
        masks, full = bit_masks(text) if possible else {}, (1 << len(text)) - 1
        for at, bound in possible:
            if bound < best:
                break
            other = self.texts[at]
            if 2.0 * common_length(masks, full, other) / (len(text) + len(other)) < best:
                continue
            alike = ratio(text, other)
            if (alike, at) > (best, found) and alike >= self.least:
                best, found = alike, at
        return None if found < 0 else found


def greedy_pairs(ref: list[str], made: list[tuple[int, str]], least: float) -> list[tuple[int, int]]:
    """(place in ref, place told in made) of each text of ref and the free one most like it, if that is least or more; of equals the last."""
    free, out = _Free([t for _, t in made], least), []
    for i, text in enumerate(ref):
        at = free.same(text)
        if at is None and text:
            at = free.best(text)
        if at is not None:
            out.append((i, made[free.take(at)][0]))
    return out


def inversion_count(places: list[int]) -> int:
    """How many pairs of a list are in falling order, by a tree of counts over the values."""
    rank = {v: i + 1 for i, v in enumerate(sorted(set(places)))}
    counts, total = [0] * (len(rank) + 1), 0
    for seen, value in enumerate(places):
        at, upto = rank[value], 0
        while at:
            upto += counts[at]
            at &= at - 1
        total += seen - upto
        at = rank[value]
        while at < len(counts):
            counts[at] += 1
            at += at & -at
    return total


def aligned(ref: Column, made: Column, least: float) -> Column:
    """The pairs (i, j) of two arrays of texts, by i; a text of ref without a partner has none."""
    return by_rows(lambda a, b: [{"i": i, "j": j} for i, j in greedy_pairs(a, list(enumerate(b)), least)], "array<struct<i:int,j:int>>", ref, made)


def aligned_places(ref: Column, made: Column, least: float) -> Column:
    """The j of aligned(), in the order of i."""
    return by_rows(lambda a, b: [j for _, j in greedy_pairs(a, list(enumerate(b)), least)], "array<int>", ref, made)


def with_inversions(rows: DataFrame, places: str) -> DataFrame:
    """rows' other columns, n and inversions of the array places of distinct numbers from 0 on, one row for each of rows.

    Two numbers in falling order differ first in one bit, which the earlier one has: each number is listed once for
    each bit, and meets those that share all its higher bits. A row of n places makes n * log2(n) rows,
    summed by windows; nothing is listed by pairs.
    """
    others = [c for c in rows.columns if c != places]
    bits = F.coalesce(F.ceil(F.log2(F.array_max(places) + 1.0)).cast("int"), F.lit(0))
    keyed = rows.select(F.struct(*others, F.monotonically_increasing_id().alias("_row")).alias("_of"), places, F.sequence(F.lit(0), F.greatest(bits - 1, F.lit(0))).alias("_bits"))
    listed = keyed.select("_of", "_bits", F.posexplode_outer(places).alias("_at", "_place")).select("_of", "_at", "_place", F.explode("_bits").alias("_bit"))
    listed = listed.select("_of", "_at", "_place", "_bit", F.expr("shiftright(_place, _bit) & 1").alias("_one"), F.expr("shiftright(_place, _bit + 1)").alias("_above"))
    before = Window.partitionBy("_of", "_bit", "_above").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = listed.select("_of", "_bit", "_place", F.when(F.col("_one") == 0, F.sum("_one").over(before)).otherwise(0).alias("_ones"))
    sums = counted.groupBy("_of").agg(F.count_if((F.col("_bit") == 0) & F.col("_place").isNotNull()).alias("n"), F.sum("_ones").alias("inversions"))
    return sums.select(*[F.col("_of")[c].alias(c) for c in others], "n", "inversions")

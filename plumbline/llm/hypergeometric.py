"""Exact draws without replacement from counts, on the driver: the inputs are a few counts, never rows."""

from __future__ import annotations

import math
import random


def draw(rng: random.Random, good: int, bad: int, taken: int) -> int:
    """How many of taken balls are good: inverse transform that starts at the mode and steps outwards."""
    low, high = max(0, taken - bad), min(taken, good)
    if low == high:
        return low
    mode = min(high, max(low, (taken + 1) * (good + 1) // (good + bad + 2)))
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    p = math.exp(choose(good, mode) + choose(bad, taken - mode) - choose(good + bad, taken))
    u = rng.random() - p
    up = down = mode
    p_up = p_down = p
    while u > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (taken - up) / ((up + 1) * (bad - taken + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - taken + down) / ((good - down + 1) * (taken - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def draw_many(rng: random.Random, counts: list[int], taken: int) -> list[int]:
    """How many of taken balls have each colour."""
    left, out = sum(counts), []
    for n in counts:
        got = draw(rng, n, left - n, taken) if taken else 0
        out.append(got)
        left -= n
        taken -= got
    return out


def matrix(rng: random.Random, rows: list[int], columns: list[int]) -> list[list[int]]:
    """Counts with these sums of rows and of columns, as a uniform shuffle of the balls would give them."""
    left, out = list(columns), []
    for n in rows:
        got = draw_many(rng, left, n)
        out.append(got)
        left = [a - b for a, b in zip(left, got, strict=True)]
    return out


def tree(rng: random.Random, quotas: list[int], shards: int) -> list[list[int]]:
    """Splits quotas among shards by halving: [shard][source]; shards' totals are at most one apart."""
    total = sum(quotas)
    sizes = [total // shards + (i < total % shards) for i in range(shards)]

    def split(own: list[int], first: int, last: int) -> list[list[int]]:
        if last - first == 1:
            return [own]
        middle = (first + last) // 2
        left = draw_many(rng, own, sum(sizes[first:middle]))
        return split(left, first, middle) + split([a - b for a, b in zip(own, left, strict=True)], middle, last)

    return split(list(quotas), 0, shards)

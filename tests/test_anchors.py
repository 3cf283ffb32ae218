"""Fuzzy and nested anchors against the plain way, and calls of injected functions."""

import collections
import random
import time

import pytest
from pyspark.sql import functions as F

from plumbline.functions.text import ratio
from plumbline.operators import golden


def near_copies(rng, n):
    """(anchor, text) with a copy of the anchor that is changed here and there, most of them 0.75 to 0.95 alike."""
    letters = "abcdefghijklmnop数据"
    for _ in range(n):
        anchor = "".join(rng.choices(letters[: rng.choice([3, 18])], k=rng.choice([1, 2, 5, 12, 20, 40, 61])))
        copy = list(anchor)
        for _ in range(rng.randrange(1 + len(copy) // 4 + 1)):
            at = rng.randrange(len(copy) + 1)
            copy[at : at + rng.randrange(3)] = rng.choices(letters, k=rng.randrange(3))
        before, after = ("".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(2))
        yield anchor, before + "".join(copy) + (after if rng.random() < 0.6 else "")


def test_pruning_loses_no_fuzzy_match(spark):
    rng = random.Random(12)
    pairs = list(near_copies(rng, 1500))
    want = {p: max((ratio(p[0], p[1][i : i + len(p[0])]) for i in range(len(p[1]))), default=0.0) for p in pairs}
    df = spark.createDataFrame(pairs, "anchor string, content string")
    got = {(r["anchor"], r["content"]): r["m"] for r in df.select("anchor", "content", golden.may_be_alike(F.col("anchor"), F.col("content")).alias("m")).collect()}
    alike = [p for p in pairs if want[p] >= golden.FUZZY]
    assert len(alike) > 300 and sum(0.8 <= w <= 0.9 for w in want.values()) > 100
    assert all(got[p] for p in alike)  # recall 1
    others = [(a, t) for (a, _), (_, t) in zip(pairs, pairs[1:], strict=False) if len(set(a)) > 8]
    passed = spark.createDataFrame(others, "anchor string, content string").where(golden.may_be_alike(F.col("anchor"), F.col("content"))).count()
    assert passed < 0.1 * len(others)  # texts of other anchors aren't compared
    tiers = {(r["anchor"], r["content"]): r["tier"] for r in golden.match_tiers(df, compose=False).collect()}
    plain = lambda p: 0 if p[0] in p[1] else 2 if want[p] >= golden.FUZZY else 3
    assert {p: t for p, t in tiers.items()} == {p: plain(p) for p in pairs}


def test_nested_anchors_equal_all_pairs(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        text = "".join(rng.choices("ab", k=rng.choice([0, 1, 2, 3, 7, 8, 9, 40]) if i % 40 else 0)) + rng.choice(["", "x" * 70])
        rows.append((rng.choice([1, 2, None]), f"f{i:03}", text if i % 31 else None))
    rows += [(3, "g1", "x" * 90), (3, "g2", "x" * 70 + "y"), (3, "g3", "x" * 71)]
    kept = []
    for d, f, a in rows:
        nested = any(d is not None and d == e and f != g and a is not None and b is not None and b in a and (a != b or f > g) for e, g, b in rows)
        if not nested:
            kept.append((d, f, a))
    got = golden.distinct_facts(spark.createDataFrame(rows, "doc_id long, fact_id string, anchor string").withColumn("first", F.lit(1)))
    assert collections.Counter((r["doc_id"], r["fact_id"], r["anchor"]) for r in got.collect()) == collections.Counter(kept)


def test_a_document_of_many_facts_is_no_join_of_all_pairs(spark):
    facts = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("string").alias("fact_id"), F.concat(F.lit("the fact "), F.md5(F.col("id").cast("string").cast("binary"))).alias("anchor"))
    facts = facts.unionByName(facts.where("fact_id = '7'").select("doc_id", F.lit("outer").alias("fact_id"), F.concat(F.lit("so "), "anchor").alias("anchor")))
    began = time.time()
    left = golden.distinct_facts(facts)
    assert left.count() == 20_000 and left.where("fact_id = 'outer'").count() == 0
    assert time.time() - began < 150


def test_answers_are_put_in_order_and_faults_are_told(spark):
    assert golden.in_order([{"index": 1, "value": "b"}, {"index": 0, "value": "a"}]) == ["a", "b"] and golden.in_order(["x", "y"]) == ["x", "y"]
    with pytest.raises(ValueError, match="once"):
        golden.in_order([{"index": 1, "value": "b"}, {"index": 1, "value": "a"}])
    rows = spark.createDataFrame([("a",), ("b",), ("bad",)], "t string").coalesce(1)
    made = golden.applied(rows, lambda ts: [{"index": i, "value": t.upper()} for i, t in reversed(list(enumerate(ts)))], "t", "m", batch=3, backoff=0)
    assert {r["t"]: r["m"] for r in made.collect()} == {"a": "A", "b": "B", "bad": "BAD"}
    began = time.time()
    told = golden.applied(rows, lambda t: t.missing() if t == "bad" else t, "t", "m", backoff=60, reason="why").collect()  # a program's fault: not tried again
    assert {r["t"]: (r["m"], bool(r["why"])) for r in told} == {"a": ("a", False), "b": ("b", False), "bad": (None, True)} and time.time() - began < 50
    short = golden.applied(rows, lambda ts: ts[:1], "t", "m", batch=3, retries=2, backoff=0, reason="why").collect()
    assert {r["why"] for r in short} == {"1 answers to 3 values"}

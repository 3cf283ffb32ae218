"""Routes scored where rows lie, against all pairs: batches, tasks, blocks of queries, bounds, ties and nulls."""

import collections
import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.functions.text import search_tokens, token_bag, tokens
from plumbline.operators import retrieve, scoring


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def ranked(scores, top_k, least=None):
    """{(query, rank, name)} of {query: {name: score}}."""
    out = set()
    for q, own in scores.items():
        order = sorted(own, key=lambda c: (-round(own[c], 9), c))
        order = [c for c in order if least is None or own[c] >= least]
        out |= {(q, i, c) for i, c in enumerate(order[:top_k])}
    return out


@pytest.mark.parametrize(("sent", "step"), [(retrieve.SENT_VECTORS, scoring.STEP), (200, 21)])
def test_sparse_equals_all_pairs(spark, monkeypatch, sent, step):
    monkeypatch.setattr(retrieve, "SENT_VECTORS", sent)
    monkeypatch.setattr(scoring, "STEP", step)
    rng = random.Random(3)
    some = lambda n: [(rng.randrange(12), round(rng.choice([-1, 1, 1]) * rng.random(), 1)) for _ in range(rng.randrange(n))]
    asked, corpus = {f"q{i}": some(6) for i in range(9)}, {f"c{i:03}": some(8) for i in range(150)}
    scores = collections.defaultdict(dict)
    for q, a in asked.items():
        for c, b in corpus.items():
            met = [x * y for i, x in a for j, y in b if i == j]
            if met:
                scores[q][c] = sum(met)
    queries = spark.createDataFrame([(q, i, w) for q, own in asked.items() for i, w in own] + [("q0", None, 1.0), ("q0", 1, None)], "sample_id string, index int, weight double")
    packed = spark.createDataFrame([(c, [i for i, _ in own], [w for _, w in own]) for c, own in corpus.items()] + [("x", None, None), ("y", [], []), ("z", [3], [None]), (None, [3], [9.0])], "chunk_id string, indices array<int>, values array<double>")
    for rows in (packed.repartition(5), packed.where("chunk_id is not null").select("chunk_id", F.explode(F.arrays_zip("indices", "values")).alias("v")).select("chunk_id", F.col("v.indices").alias("index"), F.col("v.values").alias("weight"))):
        found = retrieve.sparse(queries, rows, 4, 0.1)
        assert {(r["sample_id"], r["route_rank"], r["chunk_id"]) for r in found.collect()} == ranked(scores, 4, 0.1)
    one = plan(retrieve.sparse(queries, packed, 4))
    assert one.count("Exchange") == 1 and "Join" not in one and "WindowGroupLimit" in one
    assert retrieve.sparse(queries.limit(0), packed).count() == 0 and retrieve.sparse(queries, packed.limit(0)).count() == 0


def test_rows_that_can_not_reach_the_last_place_are_passed_over():
    import pyarrow as pa

    lists = scoring.Lists(pa.array(["q"]), np.zeros(3, np.int64), np.arange(3), np.array([1.0, 2.0, 3.0]), 3)
    best = scoring.Best(lists, 2)
    rows = lambda names, weight: scoring.Rows(names, np.arange(len(names)), np.full(len(names), 2), np.array(weight))
    best.add(rows(["a", "b", "c"], [5.0, 4.0, 1.0]))
    assert best.passed == 0 and best.last[0] == 12.0
    best.add(rows(["d", "e", "f"], [1.0, 4.0, 3.0]))
    assert best.passed == 2 and best.names.tolist() == ["a", "b"]  # e ties with b and comes after it
    best.add(rows(["0"], [4.0]))
    assert best.names.tolist() == ["a", "0"]


def plain_bm25(asked, corpus, read, boosts, means, k1=1.2, b=0.75):
    held = {c: [r(t) for r in read] for c, t in corpus.items() if t is not None}
    n = len(held)
    out = collections.defaultdict(dict)
    for q, text in asked.items():
        for token in set(read[0](text or "")):
            df = sum(token in own[-1] for own in held.values())
            for c, own in held.items():
                part = 0.0
                for i, t in enumerate(own):
                    mean = means[i] or sum(len(x[i]) for x in held.values()) / n
                    tf = t.count(token)
                    part += boosts[i] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(t) / mean)) if tf else 0
                if part:
                    out[q][c] = out[q].get(c, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * part
    return out


@pytest.mark.parametrize("sent", [retrieve.SENT_VECTORS, 300])
def test_bm25_equals_all_pairs(spark, monkeypatch, sent):
    monkeypatch.setattr(retrieve, "SENT_VECTORS", sent)
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice(["red", "Blue", "检索", "数据检索", "x1", "of", "tree", "été"]) for _ in range(rng.randrange(n)))
    asked = {f"q{i}": text(5) for i in range(8)} | {"qx": "nothing like it", "qy": ""}
    corpus = {f"c{i:02}": text(25) for i in range(60)} | {"e": "", "n": None}
    frame = lambda rows, key: spark.createDataFrame(list(rows.items()) + [("none", None)] * (key == "sample_id"), f"{key} string, text string")
    native = {f: {r["text"]: r["t"] for r in frame(asked | {f"_{c}": t for c, t in corpus.items()}, "id").select("text", f(F.col("text")).alias("t")).collect()} for f in (tokens, search_tokens, token_bag)}
    as_plain = lambda f: lambda t: native[f][t]
    one = retrieve.bm25(frame(asked, "sample_id"), frame(corpus, "chunk_id").repartition(4), 5, token_bag)
    assert {(r["sample_id"], r["route_rank"], r["chunk_id"]) for r in one.collect()} == ranked(plain_bm25(asked, corpus, [as_plain(token_bag)], [1.0], [None]), 5)
    two = retrieve.bm25(frame(asked, "sample_id"), frame(corpus, "chunk_id"), 5, fields=retrieve.COARSE_AND_FINE)
    assert {(r["sample_id"], r["route_rank"], r["chunk_id"]) for r in two.collect()} == ranked(plain_bm25(asked, corpus, [as_plain(tokens), as_plain(search_tokens)], [2.0, 1.0], [200.0, 220.0]), 5)
    if sent > 300:
        unread = plan(retrieve.bm25(frame(asked, "sample_id"), frame(corpus, "chunk_id"), 5, token_bag))
        assert unread.count("Exchange") == 1 and "Join" not in unread


def test_a_step_of_scores_is_small():
    rng = np.random.default_rng(4)
    queries, dims = 1000, 32
    lists = scoring.Lists(pa.array(range(queries)), np.repeat(np.arange(queries), 4), rng.integers(0, dims, 4 * queries), rng.random(4 * queries), dims)
    n = scoring.STEP // queries
    rows = scoring.Rows(list(range(n)), np.repeat(np.arange(n), 4), np.tile(np.arange(4), n), rng.random(4 * n))
    best = scoring.Best(lists, 5)
    tracemalloc.start()
    best.add(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(best.query)
    assert peak < 64 << 20

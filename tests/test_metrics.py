"""Ranking metrics, overlap and registry, against values worked out by hand and a plain version."""

import math
import random

import pytest

from plumbline.operators import metrics

HITS = "sample_id string, chunk_id string, doc_id long, rank int, sources array<string>"
GOLDEN = "sample_id string, expected_chunk_ids array<string>, expected_doc_ids array<long>, relevance_grades map<string,int>"


def hits_of(spark, ranked, sources=None):
    rows = [(s, f"c{d}", d, i, (sources or {}).get((s, i), ["dense"])) for s, docs in ranked.items() for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, HITS)


def values(df):
    return {(r["sample_id"], r["metric"], r["k"]): r["value"] for r in df.collect()}


def test_hand_computed(spark):
    golden = spark.createDataFrame([("a", [], [1, 2, 3], None), ("b", ["c7"], [1], None), ("c", [], [], None), ("d", [], [5], None)], GOLDEN)
    got = values(metrics.sample_metrics(hits_of(spark, {"a": [1, 4, 2, 5, 3], "b": [1, 7], "c": [1]}), golden))
    assert [got["a", "recall", k] for k in (1, 3, 5)] == pytest.approx([1 / 3, 2 / 3, 1])
    assert got["a", "precision", 10] == pytest.approx(0.3) and got["a", "hit_rate", 1] == 1
    assert got["a", "map", None] == pytest.approx((1 + 2 / 3 + 3 / 5) / 3)
    assert got["b", "mrr", None] == 0.5  # chunks come before documents
    assert not any(s == "c" for s, _, _ in got)  # nothing expected, no rows
    assert got["d", "recall", 10] == 0 and got["d", "map", None] == 0  # nothing found


def test_graded(spark):
    golden = spark.createDataFrame([("a", [], [1, 2], {"1": 3, "2": 1, "9": 2}), ("only", [], [], {"c1": 2}), ("zero", [], [1], {"1": 0})], GOLDEN)
    got = values(metrics.sample_metrics(hits_of(spark, {"a": [2, 1, 3], "only": [1], "zero": [1]}), golden, (2,)))
    ideal = 3 + 2 / math.log2(3)
    assert got["a", "ndcg_graded", 2] == pytest.approx((1 + 3 / math.log2(3)) / ideal)
    assert got["only", "ndcg_graded", 2] == pytest.approx(1.0) and ("only", "recall", 2) not in got
    assert got["zero", "ndcg_graded", 2] == 0


def plain(ids, relevant, k):
    top = ids[:k]
    hits, total, first = 0, 0.0, 0.0
    for i, x in enumerate(ids, 1):
        if x in relevant:
            hits += 1
            total += hits / i
            first = first or 1 / i
    gain = sum(1 / math.log2(i + 1) for i, x in enumerate(top, 1) if x in relevant)
    return {"recall": len(set(top) & relevant) / len(relevant), "precision": len(set(top) & relevant) / k, "hit_rate": float(bool(set(top) & relevant)), "mrr": first, "map": total / min(len(relevant), len(ids)), "ndcg_binary": gain / sum(1 / math.log2(i + 1) for i in range(1, min(k, len(relevant)) + 1))}


def test_against_plain_version_with_repeated_ids(spark):
    rng = random.Random(0)
    ranked = {f"s{i}": [rng.randrange(12) for _ in range(rng.randint(1, 14))] for i in range(40)}
    expected = {s: {rng.randrange(12) for _ in range(rng.randint(1, 5))} for s in ranked}
    chunked = {s: i % 2 == 0 for i, s in enumerate(ranked)}
    golden = spark.createDataFrame([(s, [f"c{x}" for x in e] if chunked[s] else [], sorted(e), None) for s, e in expected.items()], GOLDEN)
    got = values(metrics.sample_metrics(hits_of(spark, ranked), golden, (3,)))
    for s, docs in ranked.items():
        ids = docs if chunked[s] else list(dict.fromkeys(docs))
        for name, value in plain(ids, expected[s], 3).items():
            assert got[s, name, None if name in ("mrr", "map") else 3] == pytest.approx(value), (s, name)


def test_overlap(spark):
    sources = {("a", 0): ["dense"], ("a", 1): ["sparse"], ("a", 2): ["dense", "sparse"], ("a", 3): ["sparse", "dense"], ("b", 0): [], ("c", 0): ["dense"]}
    got = values(metrics.source_overlap(hits_of(spark, {"a": [1, 2, 3, 4], "b": [1], "c": [1]}, sources)))
    assert got == {("a", "overlap_dense_only", None): 0.25, ("a", "overlap_sparse_only", None): 0.25, ("a", "overlap_all_sources", None): 0.5, ("c", "overlap_dense_only", None): 1.0}


def test_registry_is_idempotent(spark):
    metrics.register_defaults()
    before = metrics.metrics_for("retrieval")
    metrics.register("retrieval", "ranking", lambda h, g: h)
    assert metrics.metrics_for("retrieval") == before
    with pytest.raises(ValueError, match="no metrics"):
        metrics.compute(None, None, "rerank")


def test_pooling_only_adds(spark):
    golden = spark.createDataFrame([("a", [], [1], None)], GOLDEN)
    judged = spark.createDataFrame([("a", 2, True), ("a", 3, False), ("a", 99, True)], "sample_id string, doc_id long, relevant boolean")
    row = metrics.pooled_references(golden, judged, hits_of(spark, {"a": [2, 3]})).first()
    assert sorted(row["expected_doc_ids"]) == [1, 2]


def test_parts_of_lines_grow_in_number_with_the_table(spark, tmp_path, monkeypatch):
    from plumbline.plans import fixtures, queries

    lines = [(o, (o * 7 + n) % 50, n % 3, n, float(10 + (o * n) % 41), float((o + n) % 9), "AB"[n % 2], "F") for o in range(300) for n in range(1, 5)]
    kind = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(lines, kind).write.parquet(str(tmp_path / "lineitem.parquet"))
    query = lambda: queries.doc_dedup_ranks(spark, str(tmp_path))
    want = sorted(map(tuple, query().collect()))
    monkeypatch.setattr(fixtures, "PART", 50, raising=False)
    assert query().rdd.getNumPartitions() == 24 and sorted(map(tuple, query().collect())) == want
    assert queries._line_metric("recall")(spark, str(tmp_path)).rdd.getNumPartitions() == 24

"""Route filters, fusion and grids."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import fusion

ROUTES = "sample_id string, source string, route_rank int, chunk_id string, doc_id long, dataset_id long, score double"


def routes(spark, **by_source):
    rows = [("s", source, i, c, 1, 1, float(x)) for source, hits in by_source.items() for i, (c, x) in enumerate(hits)]
    return spark.createDataFrame(rows, ROUTES)


def order(df):
    return [(r["chunk_id"], round(r["score"], 9)) for r in df.orderBy("rank").collect()]


def test_threshold_comes_before_the_cut_and_order_is_trusted(spark):
    hits = routes(spark, dense=[("a", 0.1), ("b", 0.9), ("c", 0.5)])
    kept = fusion.filter_routes(hits, F.lit(2), F.lit(0.4))
    assert [(r["chunk_id"], r["kept_rank"]) for r in kept.orderBy("kept_rank").collect()] == [("b", 0), ("c", 1)]


def test_rrf_breaks_ties_by_first_seen(spark):
    kept = fusion.filter_routes(routes(spark, dense=[("z", 1), ("a", 0.9)], sparse=[("m", 1), ("a", 0.5)]), F.lit(9), F.lit(0.0))
    got = fusion.rrf(kept)
    assert order(got) == [("a", round(2 / 62, 9)), ("z", round(1 / 61, 9)), ("m", round(1 / 61, 9))]
    assert got.where("chunk_id = 'a'").first()["sources"] == ["dense", "sparse"]


def test_weighted_scores(spark):
    kept = fusion.filter_routes(routes(spark, dense=[("d1", 0.9), ("d2", 0.5), ("d3", 0.1)], sparse=[("s1", 3.0)]), F.lit(9), F.lit(0.0))
    got = order(fusion.weighted(kept, weights={"dense": 0.75, "sparse": 0.25}))
    assert got == [("d1", 0.75), ("d2", 0.375), ("s1", 0.25), ("d3", 0.0)]
    alone = fusion.filter_routes(routes(spark, dense=[("b", 0.5), ("a", 0.5)]), F.lit(9), F.lit(0.0))
    assert order(fusion.weighted(alone)) == [("a", 1.0), ("b", 1.0)]  # equal scores count 1, and one route has all the weight


@pytest.mark.parametrize(("hits", "weights", "message"), [({"sparse": [("a", -1.0)]}, None, "scores must be >= 0"), ({"dense": [("a", float("inf"))]}, None, "finite"), ({"other": [("a", 1.0)]}, None, "unsupported source"), ({"dense": [("a", 1.0)]}, {"sparse": 1.0}, "sum to 0")])
def test_guards(spark, hits, weights, message):
    kept = fusion.filter_routes(routes(spark, **hits), F.lit(9), F.lit(-9.0))
    with pytest.raises(Exception, match=message):
        fusion.weighted(kept, weights=weights).collect()


def test_unknown_strategy_and_number_lists(spark):
    with pytest.raises(ValueError, match="unsupported"):
        fusion.fuse(None, "best")
    assert fusion.parse_numbers("3, 1,3,,2", int) == [3, 1, 2]
    with pytest.raises(ValueError, match="no numbers"):
        fusion.parse_numbers(" ,")


def test_grid_counts_samples_without_references_as_zero(spark):
    hits = routes(spark, dense=[("a", 0.9), ("x", 0.2)], sparse=[("n", 0.1), ("a", 0.05)])
    golden = spark.createDataFrame([("s", ["a"], []), ("none", [], [])], "sample_id string, expected_chunk_ids array<string>, expected_doc_ids array<long>")
    configs = fusion.config_grid(spark, [1, 2], [1], [0.0], [0.0, 0.2])
    assert [tuple(r)[:3] for r in configs.select("dense_top_k", "sparse_threshold", "config_id").orderBy("config_id").collect()] == [(1, 0.0, 0), (1, 0.2, 1), (2, 0.0, 2), (2, 0.2, 3)]
    got = fusion.evaluate_grid(hits, golden, configs).collect()
    assert all(r["recall"] == 0.5 and r["n"] == 2 for r in got)
    best = fusion.best_configs(fusion.evaluate_grid(hits, golden, configs)).collect()
    assert (best[0]["dense_top_k"], best[0]["sparse_threshold"]) == (1, 0.2)


def test_response_order_and_attempts(spark):
    hits = [("c1", 1, 1, 0.5, {"dense": 0.5, "bm25": None}), ("c2", 2, 1, 0.9, {"dense": 0.9, "bm25": 1.0}), ("c3", 3, 1, 0.5, {"bm25": 0.1})]
    df = spark.createDataFrame([("s", hits)], "sample_id string, hits array<struct<chunk_id:string,doc_id:long,dataset_id:long,fused_score:double,scores:map<string,double>>>")
    assert [(r["chunk_id"], r["rank"], r["sources"]) for r in fusion.adapt_response(df).orderBy("rank").collect()] == [("c2", 0, ["bm25", "dense"]), ("c1", 1, ["dense"]), ("c3", 2, ["bm25"])]
    tries = spark.createDataFrame([("s", 1, ["dense"], 3), ("s", 2, [], 4), ("s", 3, [], 5), ("t", 1, ["x"], 1), ("t", 2, [], 0)], "sample_id string, attempt int, failed_sources array<string>, n_hits int")
    assert {r["sample_id"]: r["attempt"] for r in fusion.pick_attempts(tries).collect()} == {"s": 2, "t": 2}


@pytest.mark.parametrize("strategy", ["rrf", "weighted_score"])
def test_grid_equals_one_config_at_a_time(spark, strategy):
    """Over samples with hits of one route, of none, with scores out of order and without expected ids."""
    from plumbline.operators.metrics import sample_metrics

    rng = random.Random(5)
    rows = [(f"s{s}", source, rank, f"c{rng.randrange(12)}-{rank}", None, 1, round(rng.random(), 1)) for s in range(8) for source in ("dense", "sparse") for rank in range(rng.choice([0, 3, 9])) if not (s == 1 and source == "dense")]
    rows = [r[:3] + (f"c{(i * 7) % 15}",) + r[4:] for i, r in enumerate(rows)]
    rows = list({(r[0], r[1], r[3]): r for r in rows}.values())
    hits = spark.createDataFrame(rows, "sample_id string, source string, route_rank int, chunk_id string, doc_id long, dataset_id long, score double")
    golden = spark.createDataFrame([(f"s{s}", [f"c{(s * k) % 15}" for k in range(1, 4)] if s != 3 else [], None) for s in range(9)], "sample_id string, expected_chunk_ids array<string>, expected_doc_ids array<bigint>")
    configs = fusion.config_grid(spark, [2, 5, 9], [1, 4], [0.0, 0.3, 0.8], [0.0, 0.5])
    got = {r["config_id"]: r for r in fusion.evaluate_grid(hits, golden, configs, strategy=strategy, top_k=5).collect()}
    assert len(got) == 36
    for c in [configs.collect()[i] for i in (0, 7, 17, 35)]:
        k, t = (F.when(F.col("source") == "dense", c[f"dense_{x}"]).otherwise(c[f"sparse_{x}"]) for x in ("top_k", "threshold"))
        fused = fusion.fuse(fusion.filter_routes(hits, k, t), strategy, 5)
        per = sample_metrics(fused, golden, (5,))
        sums = {(r["metric"], r["k"]): r["total"] for r in per.groupBy("metric", "k").agg(F.sum("value").alias("total")).collect()}
        for name, key in (("recall", ("recall", 5)), ("hit_rate", ("hit_rate", 5)), ("map", ("map", None)), ("mrr", ("mrr", None))):
            assert got[c["config_id"]][name] == pytest.approx((sums.get(key) or 0) / 9), (c, name)


def test_grid_fuses_each_outcome_once(spark):
    """Many configs, few outcomes: hits are multiplied by neither configs nor settings that keep the same."""
    hits = spark.createDataFrame([("s", source, i, f"c{i}", None, 1, 1.0 - i / 100) for source in ("dense", "sparse") for i in range(20)], "sample_id string, source string, route_rank int, chunk_id string, doc_id long, dataset_id long, score double")
    golden = spark.createDataFrame([("s", ["c1"], None)], "sample_id string, expected_chunk_ids array<string>, expected_doc_ids array<bigint>")
    configs = fusion.config_grid(spark, [5, 20, 50, 100, 150], [5, 20, 30, 50], [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6], [0, 0.1, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7])
    assert configs.count() == 1260
    sets = fusion.kept_sets(hits, golden, fusion.grid_settings(configs)).collect()
    assert {(r["source"], len(r["hits"])) for r in sets} == {("dense", 5), ("dense", 20), ("sparse", 5), ("sparse", 20)}
    assert sum(len(r["settings"]) for r in sets) == 35 + 36
    results = fusion.evaluate_grid(hits, golden, configs)
    assert results.count() == 1260 and results.where("recall = 1 and mrr = 0.5").count() == 1260

"""Buckets, ledgers, run quality, diffs, trends, stores, vectors, rerank, streaming, reports, commands."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from plumbline.operators import aggregate, rerank, vectors
from plumbline.plans import catalogue, cli, report, run
from plumbline.plans.settings import Settings
from plumbline.sources.store import Store, merged
from plumbline.streaming import run_quality as streaming

VALUES = "sample_id string, metric string, k int, value double, type string, domain string"
TOTALS = "layer string, metric string, k int, value double, n long"


@pytest.fixture(scope="module")
def buckets(spark):
    rows = [("a", "recall", 10, 1.0, "keyword", "med"), ("b", "recall", 10, 0.5, "keyword", "law"), ("c", "recall", 10, 0.0, "longtail", "law"), ("a", "mrr", None, 1.0, "keyword", "med")]
    return aggregate.metric_buckets(spark.createDataFrame(rows, VALUES))


def test_buckets_and_ledger(spark, buckets):
    got = {(r["metric"], r["k"], r["type_bucket"], r["domain_bucket"]): (r["value"], r["n"]) for r in buckets.collect()}
    assert got["recall", 10, "__all__", "__all__"] == (0.5, 3) and got["recall", 10, "keyword", "__all__"] == (0.75, 2) and got["recall", 10, "__all__", "law"] == (0.25, 2) and got["mrr", None, "__all__", "__all__"] == (1.0, 1)
    ledger = aggregate.ledger(buckets, spark.createDataFrame([(60,)], "rrf_k int"), "r1", "d", "now")
    assert ledger.count() == buckets.count() and ledger.first()["rrf_k"] == 60
    known = aggregate.with_domain(spark.createDataFrame([("a", 1), ("b", 9)], "sample_id string, dataset_id long"), spark.createDataFrame([(1, "med")], "dataset_id long, domain string"))
    assert {r["sample_id"]: r["domain"] for r in known.collect()} == {"a": "med", "b": aggregate.UNCATALOGUED}


def test_run_quality(spark):
    rows = spark.createDataFrame([("a", ["dense", "sparse"], 0), ("b", [], 5), ("c", ["dense"], 3)], "sample_id string, failed_sources array<string>, n_ranked int")
    q = aggregate.run_quality(rows).first()
    assert (q["samples"], q["failed_samples"], q["zero_ranked"], q["clean"]) == (3, 2, 1, False)
    assert {r["source"]: r["n"] for r in aggregate.failed_source_counts(rows).collect()} == {"dense": 2, "sparse": 1}
    assert aggregate.run_quality(rows.where("sample_id = 'b'")).first()["clean"]


@pytest.mark.parametrize(("name", "old", "new", "n", "comparable", "bad"), [("recall", 0.80, 0.75, 50, True, True), ("recall", 0.80, 0.79, 50, True, False), ("ndcg_binary", 0.70, 0.67, 50, True, True), ("recall", 0.8, 0.5, 10, True, False), ("mrr", 0.8, 0.1, 50, True, False), ("recall", 0.8, 0.5, 50, False, False)])
def test_regressions(spark, name, old, new, n, comparable, bad):
    one = lambda v: spark.createDataFrame([("retrieval", name, None if name == "mrr" else 10, v, n)], TOTALS)
    row = aggregate.diff(one(new), one(old), comparable).first()
    assert row["is_regression"] == bad and row["delta"] == pytest.approx(new - old)


def test_comparability(spark):
    a, b = Settings(fusion_weights={"dense": 0.5, "sparse": 0.5}), Settings(fusion_weights={"sparse": 0.5, "dense": 0.5}, top_k=20)
    assert [r["dimension"] for r in aggregate.incomparable(a.snapshot(spark), b.snapshot(spark)).collect()] == ["top_k"]


def test_models_trend_noise(spark):
    roles = spark.createDataFrame([(0, "chat", "m"), (1, "judge", "x"), (2, "generator", "m"), (3, "other", "")], "ord int, role string, model string")
    assert [tuple(r) for r in aggregate.equal_models(roles).collect()] == [("chat", "generator", "m")]
    series = spark.createDataFrame([("recall", 1, 0.5, "a"), ("recall", 2, 0.7, "a"), ("recall", 3, 0.6, "b")], "metric string, ts int, value double, config string")
    got = aggregate.trend(series, config="config").orderBy("ts").collect()
    assert [r["delta"] and round(r["delta"], 6) for r in got] == [None, 0.2, -0.1] and [r["config_changed"] for r in got] == [False, False, True]
    runs = spark.createDataFrame([("recall", 10, 0.5), ("recall", 10, 0.7)], "metric string, k int, value double")
    assert aggregate.noise_floor(runs).first()["sigma"] == pytest.approx(0.1414213562)
    values = spark.createDataFrame([(str(i), "recall", 10, float(i % 2)) for i in range(200)], "sample_id string, metric string, k int, value double")
    low, high = aggregate.bootstrap(values).select("low", "high").first()
    assert 0.4 < low < 0.5 < high < 0.6 and aggregate.bootstrap(values).first()["low"] == low


def test_store(spark, tmp_path, buckets):
    store = Store(spark, str(tmp_path / "store"))
    assert store.load_baseline("r1") is None
    snapshot = Settings().snapshot(spark)
    for name in ("r1", "r2", "r1"):
        store.save_result(aggregate.ledger(buckets, spark.createDataFrame([(60,)], "rrf_k int"), name, "d", "t"), None, snapshot, name)
    assert store.load_baseline("r1").count() == buckets.count() and store.load_totals("r1").count() == 2
    chunks = lambda *rows: spark.createDataFrame(rows, "chunk_id string, content string")
    store.upsert(chunks(("a", "1"), ("b", "1")), "chunks", "chunk_id")
    assert {tuple(r) for r in store.upsert(chunks(("b", "2"), ("c", "2")), "chunks", "chunk_id").collect()} == {("a", "1"), ("b", "2"), ("c", "2")}
    assert merged(None, chunks(("a", "1"), ("a", "1")), "chunk_id").count() == 1


def test_sparse_vectors(spark):
    rows = [("a", 3, 0.5), ("a", 1, 0.5), ("a", 3, 0.9), ("a", 7, 0.0), ("a", 2, 0.1), ("b", 1, -1.0)]
    clean = vectors.packed(vectors.clean_weights(spark.createDataFrame(rows, "chunk_id string, index int, weight double"), 2, 0.05))
    assert [tuple(r) for r in clean.collect()] == [("a", [1, 3], [0.5, 0.9])]
    for bad in ((-1, 1.0), (1, float("nan")), (1, float("inf"))):
        with pytest.raises(Exception, match="must be"):
            vectors.clean_weights(spark.createDataFrame([("a", *bad)], "chunk_id string, index int, weight double")).collect()
    points = spark.createDataFrame([("a", 1, 1, 1, [1.0, 0.0], [1], [0.5], [], []), ("b", 1, 1, 1, [0.0, 2.0], [], [], [4], [1.0])], "chunk_id string, user_id long, dataset_id long, doc_id long, vector array<double>, indices array<int>, values array<double>, bm25_indices array<int>, bm25_values array<double>")
    assert {k: v.count() for k, v in vectors.index_tables(points).items()} == {"dense": 2, "sparse": 1, "bm25": 1}
    assert vectors.without_points(points, points.where("chunk_id = 'a'")).count() == 1
    assert points.select(vectors.scaled(F.col("vector")).alias("v")).collect()[1]["v"] == [0.0, 1.0]


def test_rerank(spark):
    hits = spark.createDataFrame([("a", o, f"c{d}", d, i) for o, docs in (("rrf", [2, 1]), ("rerank", [1, 2])) for i, d in enumerate(docs)], "sample_id string, ordering string, chunk_id string, doc_id long, rank int")
    golden = spark.createDataFrame([("a", [], [1])], "sample_id string, expected_chunk_ids array<string>, expected_doc_ids array<long>")
    got = {(r["metric"], r["k"]): r["delta"] for r in rerank.order_deltas(hits, golden, k_values=(1, 5), top_n=1).collect()}
    assert got == {("mrr", None): 0.5, ("ndcg_binary", 1): 1.0}
    kept = rerank.degraded(hits.where("ordering = 'rrf'"), spark.createDataFrame([("c1", "t"), ("c2", None)], "chunk_id string, content string"), 1)
    assert [(r["chunk_id"], r["rank"]) for r in kept.collect()] == [("c1", 0)]
    scores = spark.createDataFrame([("a", "context_recall", 1.0, True), ("b", "context_recall", 0.0, False), ("a", "faithfulness", 0.5, False)], "sample_id string, metric string, score double, has_golden_answer boolean")
    assert {r["metric"]: (r["value"], r["n"], r["skipped"]) for r in rerank.judged(scores).collect()} == {"context_recall": (1.0, 1, 1), "faithfulness": (0.5, 1, 0)}
    assert rerank.abstention(spark.createDataFrame([("x",), (" ",), (None,), ("y",)], "answer string")).first()[0] == 0.5
    assert rerank.applied_rate(spark.createDataFrame([(True,), (None,), (False,)], "rerank_applied boolean")).first()[0] == 0.5


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, id, 0, 0, 0) AS ts, CASE WHEN id % 3 = 0 THEN array('dense') ELSE array() END AS failed_sources, CAST(id % 4 AS INT) AS n_ranked FROM range(6)")
    rows = rows.withColumn("failed_sources", F.col("failed_sources").cast("array<string>"))
    rows.write.parquet(f"{tmp_path}/in/a")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in/*")
    query = streaming.start(stream, f"{tmp_path}/out", f"{tmp_path}/ck", "1 day", "1 hour")
    query.awaitTermination()
    key = lambda df: sorted(map(tuple, df.collect()))
    closed = streaming.windowed_quality(rows).where("start < (SELECT date_trunc('day', max(ts) - interval 1 hour) FROM {r})".replace("{r}", "stream_rows")) if rows.createOrReplaceTempView("stream_rows") is None else None
    assert key(spark.read.parquet(f"{tmp_path}/out")) == key(closed) and closed.count() == 4


def test_run_command(spark, tmp_path, capsys, monkeypatch):
    golden = [{"id": f"q{i}", "query": "x", "dataset_ids": [1], "expected_doc_ids": [i], "type": "keyword"} for i in range(40)]
    (tmp_path / "g.jsonl").write_text("\n".join(map(json.dumps, golden)))
    answer = lambda worse: [{"sample_id": f"q{i}", "hits": [{"chunk_id": f"c{d}", "doc_id": d, "dataset_id": 1, "fused_score": 1.0 - j / 10, "scores": {"dense": 0.5}} for j, d in enumerate([i + 100 * (worse and i % 4 == 0), i + 500])], "elapsed_ms": 5, "failed_sources": []} for i in range(40)]
    for name, worse in (("base", False), ("new", True)):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(map(json.dumps, answer(worse))))
    monkeypatch.setenv("EVAL_STORE_PATH", str(tmp_path / "store"))
    common = ["run", "--golden", str(tmp_path / "g.jsonl"), "--dataset", "d", "--ts", "t"]
    assert cli.main([*common, "--responses", str(tmp_path / "base.jsonl"), "--run-id", "base"], spark) == 0
    assert "recall@10 = 1.0000 (n=40)" in capsys.readouterr().out
    assert cli.main([*common, "--responses", str(tmp_path / "new.jsonl"), "--run-id", "new", "--baseline", "base"], spark) == 0
    told = json.loads((tmp_path / "store/reports/new.json").read_text())
    assert {d["metric"] for d in told["deltas"] if d["is_regression"]} == {"recall", "ndcg_binary"}
    page = (tmp_path / "store/reports/new.html").read_text()
    assert "Run quality" in page and "class=bad" in page and "Glossary" in page
    assert cli.main(["config"]) == 0 and '"rrf_k": 60' in capsys.readouterr().out


def test_tuning_and_cleaning_commands(spark, tmp_path):
    hits = spark.createDataFrame([("q", s, i, f"c{i}", i, 1, 1.0 - i / 10) for s in ("dense", "sparse") for i in range(4)], "sample_id string, source string, route_rank int, chunk_id string, doc_id long, dataset_id long, score double")
    samples = spark.createDataFrame([("q", ["c1"], [])], "sample_id string, expected_chunk_ids array<string>, expected_doc_ids array<long>")
    best = run.tune(spark, hits, samples, str(tmp_path / "tune"), "1,2", "1", "0", "0,0.5")
    assert best.first()["dense_top_k"] == 2 and "4 configs" in (tmp_path / "tune/report.md").read_text() and json.loads((tmp_path / "tune/best.json").read_text())["configs"] == 4
    pairs = spark.createDataFrame([("1", "md", None, "# a\n\nb", "# a\n\nb", True, None, 3)], "sample_id string, fmt string, pdf_backend string, ref string, produced string, ok boolean, repeats array<string>, clean_ms long")
    assert run.clean(spark, pairs, str(tmp_path / "clean"), "r").count() == 1 and "Cleaning r" in (tmp_path / "clean/r.html").read_text()


def test_settings():
    got = Settings.read({"EVAL_TOP_K": "5", "EVAL_ENABLED_SOURCES": '["dense", "bm25"]', "EVAL_BM25_MODE": "stub", "EVAL_FUSION_WEIGHTS": '{"dense": 1.0}'}, rrf_k=10)
    assert (got.top_k, got.routes, got.fusion_weights, got.rrf_k) == (5, ("dense",), {"dense": 1.0}, 10)
    for bad in ({"collection_name": "prod"}, {"fusion_strategy": "x"}, {"sparse_provider": "y"}):
        with pytest.raises(ValueError, match="must"):
            Settings(**bad)


def test_report_parts(spark, buckets):
    assert report.markdown_table(spark.createDataFrame([("a", 0.5, None)], "x string, y double, z int")) == "| x | y | z |\n|-|-|-|\n| a | 0.5000 | - |\n"
    assert "&lt;b&gt;" in report.table(spark.createDataFrame([("<b>",)], "x string"), "t")
    assert report.by_k(buckets.where("type_bucket = '__all__' and domain_bucket = '__all__'")).columns == ["metric", "10"]


def test_catalogue_is_whole():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert not [k for k, sql in catalogue.ORACLES.items() if not re.match(r"\s*(WITH|SELECT)", sql)]


def test_ranks_come_from_counts(spark):
    """No group's values are collected into an array; repeated, null and missing values count as nearest_rank has them."""
    rng = random.Random(4)
    values = {"a": [rng.choice([0.5, 1.0, 7.0, 2.0]) for _ in range(101)] + [None] * 9, "b": [float(i) for i in range(40)], "c": [None], "d": [3.0]}
    rows = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v double")
    counted = rows.groupBy("k", "v").agg(F.count("v").alias("n"))
    got = {r["k"]: tuple(r)[1:] for r in aggregate.counted_ranks(counted, ("k",), "v").groupBy("k").agg(*[aggregate.rank_of("v", p).alias(str(p)) for p in (0, 50, 95, 100)]).collect()}
    real = {k: sorted(v for v in vs if v is not None) for k, vs in values.items()}
    assert got == {k: tuple(vs[round(p / 100 * (len(vs) - 1))] if vs else 0.0 for p in (0, 50, 95, 100)) for k, vs in real.items()}


def test_percentiles_collect_no_group(spark, tmp_path):
    from plumbline.operators import markdown
    from plumbline.plans import queries

    spark.createDataFrame([(1, "x", 2.0, "{}")], "event_id long, event_type string, value double, props string").selectExpr("*", "timestamp'2024-01-01' AS ts").write.parquet(f"{tmp_path}/events.parquet")
    pairs = spark.createDataFrame([("s", "md", None, "# a", "# a", True, ["# a"], 5)], "sample_id string, fmt string, pdf_backend string, ref string, produced string, ok boolean, repeats array<string>, clean_ms long")
    for df in (queries.nearest_rank_percentiles(spark, str(tmp_path)), markdown.cleaning_buckets(markdown.score_pairs(pairs))):
        assert "collect_list" not in df._jdf.queryExecution().optimizedPlan().toString()

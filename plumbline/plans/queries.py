"""Each query of the library over the driver's tables, whole."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import columns, text
from plumbline.operators import aggregate, fusion, golden, index, metrics, rerank, retrieve, vectors
from plumbline.plans import fixtures as fx
from plumbline.streaming.run_quality import windowed_quality

GRID = ([5, 20], [5, 20], [0.0, 0.1, 0.2], [0.0, 0.05])


def _rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


def retrieval_headline(spark: SparkSession, d: str) -> DataFrame:
    hits = fx.dense_hits(spark, d, 10).select("sample_id", F.col("chunk_id").cast("string").alias("chunk_id"), F.lit(None).cast("long").alias("doc_id"), F.col("route_rank").alias("rank"))
    per = metrics.sample_metrics(hits, fx.vector_golden(spark, d))
    return _rounded(per.groupBy("metric", "k").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n")), "value")


def dense_topk(spark, d):
    return _rounded(fx.dense_hits(spark, d, 10).drop("source"), "score")


def sparse_dot_topk(spark, d):
    return _rounded(fx.sparse_hits(spark, d, 10).drop("source"), "score")


def bm25_topk(spark, d):
    asked = fx.table(spark, d, "benchmark").select(F.col("item_id").alias("sample_id"), "text")
    corpus = fx.table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return _rounded(retrieve.bm25(asked, corpus, 10, text.token_bag).drop("source"), "score")


def stored_bm25(spark, d):
    """The same over an index of the documents that has changed: every fifth text anew, some deleted, its changes merged."""
    docs = fx.table(spark, d, "documents")
    passage = lambda content: [F.col("doc_id").alias("chunk_id"), F.lit("u").alias("user_id"), F.lit(1).cast("long").alias("dataset_id"), F.col("doc_id").cast("string").alias("doc_id"), content.alias("content"), F.array(F.lit(1.0)).alias("vector"), F.array().cast("array<int>").alias("indices"), F.array().cast("array<double>").alias("values")]
    own = index.PassageIndex(spark, f"{fx.shared_folder(spark)}/index-{uuid.uuid4().hex}", text.token_bag)
    own.index(docs.select(*passage(F.col("text"))))
    own.index(docs.where("doc_id % 5 = 0").select(*passage(F.concat_ws(" ", "text", "source"))))
    own.delete(docs.where("doc_id % 7 = 3").select(F.col("doc_id").alias("chunk_id")))
    asked = fx.table(spark, d, "benchmark").select(F.col("item_id").alias("sample_id"), "text")
    return _rounded(own.bm25(asked, 10).drop("source"), "score")


def route_filter(spark, d):
    return fusion.filter_routes(fx.route_hits(spark, d), F.lit(10), F.lit(0.1)).select("sample_id", "source", "chunk_id", "kept_rank")


def _fused(spark, d, strategy):
    kept = fusion.filter_routes(fx.route_hits(spark, d), F.lit(20), F.lit(0.05))
    return _rounded(fusion.fuse(kept, strategy), "score").select("sample_id", "chunk_id", "rank", "score", F.array_join("sources", "+").alias("sources"))


def rrf_fusion(spark, d):
    return _fused(spark, d, "rrf")


def weighted_fusion(spark, d):
    return _fused(spark, d, "weighted_score")


def config_grid(spark, d):
    found = fusion.evaluate_grid(fx.route_hits(spark, d), fx.route_golden(spark, d), fusion.config_grid(spark, *GRID))
    return _rounded(found, "recall", "hit_rate", "map", "mrr").select("dense_top_k", "sparse_top_k", "dense_threshold", "sparse_threshold", "recall", "hit_rate", "map", "mrr", "n")


def grid_best(spark, d):
    return _rounded(fusion.best_configs(config_grid(spark, d), 5), "recall")


def _line_metric(name):
    def query(spark, d):
        per = metrics.sample_metrics(fx.line_hits(spark, d), fx.line_golden(spark, d, name == "ndcg_graded"))
        return _rounded(per.where(F.col("metric") == name).select("sample_id", "k", "value"), "value")

    query.__name__ = name
    return query


def doc_dedup_ranks(spark, d):
    hits = fx.line_hits(spark, d)
    ranked = metrics.ranked_ids(hits, hits.select("sample_id").distinct().withColumn("granularity", F.lit("doc")))
    return ranked.select("sample_id", F.col("ref").cast("long").alias("doc_id"), "pos")


def source_overlap(spark, d):
    return _rounded(metrics.source_overlap(fx.line_hits(spark, d)).select("sample_id", "metric", "value"), "value")


def _bucketed(spark, d):
    per = metrics.sample_metrics(fx.line_hits(spark, d), fx.line_golden(spark, d))
    orders, customers = fx.dealt(fx.table(spark, d, "orders"), "o_custkey"), fx.table(spark, d, "customer")
    kinds = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("sample_id"), F.col("o_orderpriority").alias("type"), F.col("c_nationkey").cast("long").alias("dataset_id"))
    domains = fx.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("dataset_id"), F.col("n_name").alias("domain"))
    return aggregate.metric_buckets(per.join(aggregate.with_domain(kinds, domains), "sample_id"))


def metric_grouping_sets(spark, d):
    return _rounded(_bucketed(spark, d).select("metric", "k", "type_bucket", "domain_bucket", "value", "n"), "value")


def ledger_rows(spark, d):
    snapshot = spark.range(1).select(F.lit("bge").alias("sparse_provider"), F.lit(10).alias("top_k"), F.array_join(F.array_sort(F.array(F.lit("sparse"), F.lit("dense"))), ",").alias("enabled_sources"), F.lit(60).alias("rrf_k"))
    return _rounded(aggregate.ledger(_bucketed(spark, d), snapshot, "run-1", "lines", "2024-01-01T00:00:00"), "value")


def k_pivot(spark, d):
    whole = _bucketed(spark, d).where("type_bucket = '__all__' and domain_bucket = '__all__' and k is not null")
    wide = whole.groupBy("metric").pivot("k", [1, 3, 5, 10]).agg(F.first("value"))
    return wide.select("metric", *[F.round(F.col(str(k)), 6).alias(f"k{k}") for k in (1, 3, 5, 10)])


def run_quality(spark, d):
    return aggregate.run_quality(fx.diagnostics(spark, d), ("type",))


def failed_source_counts(spark, d):
    return aggregate.failed_source_counts(fx.diagnostics(spark, d))


def latency_median(spark, d):
    return _rounded(aggregate.median_latency(fx.diagnostics(spark, d)), "median_ms")


def nearest_rank_percentiles(spark, d):
    return aggregate.nearest_ranks(fx.diagnostics(spark, d), "elapsed_ms", (50, 95), ("type",))


def _vector_totals(spark, d, strategy):
    kept = fusion.filter_routes(fx.route_hits(spark, d), F.lit(20), F.lit(0.05))
    per = metrics.sample_metrics(fusion.fuse(kept, strategy), fx.route_golden(spark, d))
    return per.groupBy("metric", "k").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n")).withColumn("layer", F.lit("retrieval"))


def baseline_diff(spark, d):
    found = aggregate.diff(_vector_totals(spark, d, "weighted_score"), _vector_totals(spark, d, "rrf"), criteria=aggregate.Criteria(least_n=1))
    return _rounded(found, "value", "baseline_value", "delta")


def comparability(spark, d):
    """What the snapshots of two languages' documents differ in: their numbers of documents and sources, their first and last source."""
    def snapshot(lang: str) -> DataFrame:
        own = fx.table(spark, d, "documents").where(F.col("lang") == lang)
        return own.agg(F.min("source").alias("sparse_vector_provider"), F.count(F.lit(1)).alias("top_k"), F.count_distinct("source").alias("rrf_k"), F.max("source").alias("fusion_strategy"))

    return aggregate.incomparable(snapshot("en"), snapshot("de")).select("dimension")


def first_relevant_rank(spark, d):
    found = metrics.first_relevant_ranks(fx.line_hits(spark, d), fx.line_golden(spark, d))
    return found.select("sample_id", "first_relevant_rank")


def trend_lag(spark, d):
    daily = fx.table(spark, d, "events").groupBy(F.date_trunc("day", "ts").alias("ts"), F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))
    found = aggregate.trend(daily)
    return _rounded(found.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "metric", "value", "previous", "delta"), "value", "previous", "delta", places=5)


def noise_floor(spark, d):
    runs = fx.table(spark, d, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("run")).agg(F.avg("value").alias("value"))
    return _rounded(aggregate.noise_floor(runs.withColumnRenamed("event_type", "metric"), ("metric",)), "sigma", "mean", places=5)


def bootstrap_interval(spark, d):
    per = metrics.sample_metrics(fx.line_hits(spark, d), fx.line_golden(spark, d), (10,))
    return _rounded(aggregate.bootstrap(per.where("metric in ('recall', 'mrr')"), ("metric",), 50), "low", "high")


def windowed_run_quality(spark, d):
    found = windowed_quality(fx.diagnostics(spark, d))
    return found.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "samples", "failed_samples", "zero_ranked")


def model_distinctness(spark, d):
    """Nations as roles, each with its region for a model; every fourth names none."""
    nations = fx.table(spark, d, "nation").join(fx.table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name"), "n_regionkey")
    return aggregate.equal_models(nations.select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("role"), F.when(F.col("n_nationkey") % 4 == 0, "").otherwise(F.col("r_name")).alias("model")))


def _document_golden(spark, d):
    """Every benchmark item expects the chunks of the documents with its number and the one after the last."""
    return fx.table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.array(F.concat(F.lit("c"), F.col("item_id")), F.concat(F.lit("c"), F.col("item_id") + 1000000)).alias("expected_chunk_ids"), F.array(F.col("item_id")).alias("expected_doc_ids"))


def precheck_anti(spark, d):
    corpus = fx.table(spark, d, "documents").select(F.concat(F.lit("c"), F.col("doc_id")).alias("chunk_id"))
    return golden.precheck(_document_golden(spark, d), corpus).select("id", F.array_join("missing", ",").alias("missing"), "doc_fallback_available")


def manifest_join(spark, d):
    manifest = fx.table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("source_id"), (F.col("doc_id") + 990000000).alias("doc_id"), F.when(F.col("quality") == 1, "success").otherwise("failed").alias("status"))
    collection = fx.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source_id"), "text")
    return golden.manifest_rows(manifest, collection).select("doc_id", "source_id", F.length("text").alias("chars"))


def golden_convert_graded(spark, d):
    """Sources as queries, labelled documents as judged passages: grade 1 + 2 quality - toxic."""
    labels = fx.table(spark, d, "labels")
    judged = labels.join(fx.table(spark, d, "documents").select("doc_id", "source"), "doc_id").select(F.col("source").alias("qid"), F.col("doc_id").cast("string").alias("pid"), (2 * F.col("quality") - F.col("toxic")).alias("grade"))
    queries = fx.table(spark, d, "documents").select(F.col("source").alias("qid"), F.col("source").alias("query")).distinct()
    manifest = labels.select(F.col("doc_id").cast("string").alias("source_id"), "doc_id", F.when(F.col("toxic") == 0, "success").otherwise("failed").alias("status"))
    found = golden.convert_judgments(judged, queries, manifest, "src", graded=True)
    grades = F.array_join(F.array_sort(F.transform(F.map_entries("relevance_grades"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))), ",")
    return found.select("id", F.array_join(F.transform("expected_doc_ids", lambda x: x.cast("string")), ",").alias("docs"), F.coalesce(grades, F.lit("")).alias("grades"), F.array_join("dropped_pids", ",").alias("dropped"), "converted", "partial_missing")


def chunk_ids_uuid5(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", columns.chunk_id(F.lit(1), F.col("doc_id"), F.lit(0)).alias("chunk_id"))


def content_hash(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", columns.content_hash(F.col("text")).alias("content_hash"))


def stratified_pick(spark, d):
    return golden.stratified_pick(fx.table(spark, d, "documents").select("doc_id", "source"), 100, 7, "source", "doc_id")


def group_adjacent(spark, d):
    """Short turns are taken out, which leaves gaps."""
    turns = fx.table(spark, d, "conversations").where("length(text) > 300").select("conv_id", "turn").distinct()
    return golden.group_adjacent(turns, 2, "conv_id", "turn").select("conv_id", "group_start", F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"))


def allot_types(spark, d):
    chunks = fx.table(spark, d, "documents").select("doc_id")
    return golden.allot_types(chunks, golden.quota(100), "doc_id")


def sparse_vector_clean(spark, d):
    weights = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.posexplode("embedding").alias("at", "w")).select("chunk_id", (F.col("at") % 40).alias("index"), F.round(F.col("w").cast("double"), 6).alias("weight"))
    return vectors.clean_weights(weights, 12, 0.05)


def anchor_locate(spark, d):
    """Benchmark items as anchors, sought in all documents exactly: documents share a word run with each item they hold.

    Candidates are documents that hold the item's first words in a row, found by a join on that run; each is then
    compared in full. Items of fewer words, whose run may not end with a word of theirs, are compared with all documents,
    as many at a time as may be sent.
    """
    first = lambda c: F.array_join(F.slice(F.split(c, r"[\x20\x09-\x0D]+"), 2, 4), " ")
    anchors = fx.table(spark, d, "benchmark").select(F.col("item_id").alias("fact_id"), F.col("text").alias("anchor"), first("text").alias("run"))
    # The fifth word has an end in the item only if a sixth follows.
    long = F.size(F.split("anchor", r"[\x20\x09-\x0D]+")) >= 6
    items, short = anchors.where(long), anchors.where(~long).select("fact_id", "anchor")
    docs = fx.table(spark, d, "documents").select("doc_id", "text")
    words = docs.select("doc_id", "text", F.split("text", r"[\x20\x09-\x0D]+").alias("w"))
    runs = words.select("doc_id", "text", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 3, F.lit(1))), lambda i: F.array_join(F.slice("w", i, 4), " ")))).alias("run"))
    met = runs.join(items, "run").select("fact_id", "doc_id", "anchor")
    held = reduce(DataFrame.unionByName, [docs.join(F.broadcast(own), F.contains("text", "anchor")).select("fact_id", "doc_id", "anchor") for own in fx.blocks(short, "anchor")])
    # A fact of an item in every document that may hold it, each document a chunk.
    facts = met.unionByName(held).distinct().withColumn("fact_id", F.concat_ws(":", "fact_id", "doc_id"))
    chunks = docs.select("doc_id", F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("content"))
    found = golden.locate(facts, chunks, fuzzy=False, compose=False).where("tier = 'exact'")
    return found.select(F.split("fact_id", ":")[0].cast("long").alias("fact_id"), F.explode(F.transform("chunk_ids", lambda c: c.cast("long"))).alias("doc_id"))


def gate_cascade(spark, d):
    docs = fx.table(spark, d, "documents").join(fx.table(spark, d, "labels"), "doc_id")
    signals = docs.select(
        "doc_id", (F.length("text") > 300).alias("has_text"), (F.col("quality") == 1).alias("answerable"), (F.col("lang") != "fr").alias("has_golden_answer"), (F.col("toxic") == 0).alias("consistent"),
        F.array(F.col("source")).alias("retrieved"), F.array(F.when(F.length("text") % 2 == 0, F.col("source")).otherwise("none")).alias("expected"),
    )
    return golden.gate(signals).select("doc_id", "decision", "failed_signal")


def spec_matrix(spark, d):
    """Specifications dealt out to documents in turn, in the order of their keys: documents and facts by format and backend."""
    specs = golden.spec_matrix(spark).withColumn("nth", F.row_number().over(Window.orderBy("key")) - 1)  # a fixed, small matrix
    docs = fx.table(spark, d, "documents").groupBy((F.col("doc_id") % specs.count()).alias("nth")).agg(F.count(F.lit(1)).alias("docs"))
    return docs.join(specs, "nth").groupBy("fmt", "pdf_backend").agg(F.sum("docs").alias("n"), F.sum(F.col("docs") * F.col("n_facts")).alias("facts"))


def rerank_delta(spark, d):
    """Lines by price as the first order, by quantity as the reranked one; applied where the order's number is even."""
    hits = fx.line_hits(spark, d)
    again = Window.partitionBy("sample_id").orderBy(F.desc("quantity"), "rank")
    both = hits.withColumn("ordering", F.lit("rrf")).unionByName(hits.withColumn("rank", F.row_number().over(again) - 1).withColumn("ordering", F.lit("rerank")))
    applied = hits.select("sample_id").distinct().withColumn("rerank_applied", F.col("sample_id") % 2 == 0)
    return _rounded(rerank.order_deltas(both, fx.line_golden(spark, d), applied), "before", "after", "delta", "delta_applied")


def pooled_recall(spark, d):
    hits = fx.line_hits(spark, d)
    judged = fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sample_id"), F.col("l_partkey").alias("doc_id"), (F.col("l_discount") > 0.07).alias("relevant"))
    wider = metrics.pooled_references(fx.line_golden(spark, d), judged, hits)
    per = metrics.sample_metrics(hits, wider, (10,)).where("metric = 'recall'")
    return _rounded(per.select("sample_id", "value"), "value")


def degraded_order(spark, d):
    hits = fx.line_hits(spark, d)
    contents = fx.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("chunk_id"), F.when(F.col("p_size") > 10, F.col("p_name")).alias("content"))
    return rerank.degraded(hits.withColumn("chunk_id", F.col("doc_id").cast("string")), contents, 3).select("sample_id", "chunk_id", "rank")


def abstention(spark, d):
    answers = fx.table(spark, d, "conversations").where("role = 'assistant'").select(F.when(F.length("text") % 5 > 0, F.col("text")).otherwise(" ").alias("answer"))
    return _rounded(rerank.abstention(answers), "abstention_rate")


QUERIES = {f.__name__: f for f in (
    retrieval_headline, dense_topk, sparse_dot_topk, bm25_topk, stored_bm25, route_filter, rrf_fusion, weighted_fusion, config_grid, grid_best, doc_dedup_ranks, source_overlap, metric_grouping_sets, ledger_rows, k_pivot,
    run_quality, failed_source_counts, latency_median, nearest_rank_percentiles, baseline_diff, comparability, first_relevant_rank, trend_lag, noise_floor, bootstrap_interval, windowed_run_quality, model_distinctness, precheck_anti,
    manifest_join, golden_convert_graded, chunk_ids_uuid5, content_hash, stratified_pick, group_adjacent, allot_types, sparse_vector_clean, anchor_locate, gate_cascade, spec_matrix, rerank_delta, pooled_recall, degraded_order, abstention,
)} | {f"{n}_at_k" if n in ("recall", "precision") else "hit_at_k" if n == "hit_rate" else n: _line_metric(n) for n in ("recall", "hit_rate", "precision", "mrr", "map", "ndcg_binary", "ndcg_graded")}

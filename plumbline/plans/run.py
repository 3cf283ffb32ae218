"""The commands as functions over files: evaluate a run, tune fusion, score cleaning, convert judgments."""

from __future__ import annotations

import dataclasses
import functools
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import first_json_object
from plumbline.operators import aggregate, fusion, golden, markdown, metrics, retrieve
from plumbline.plans import report
from plumbline.plans.settings import Settings
from plumbline.sources import readers
from plumbline.sources.store import Store


def stage_preconditions(samples: DataFrame, layer: str, judge: bool = False) -> None:
    """Generation and correctness need a judge; correctness needs a golden answer of every sample."""
    if layer in ("generation", "correctness") and not judge:
        raise ValueError(f"layer {layer!r} needs a judge")
    if layer == "correctness" and not samples.where("golden_answer is null").isEmpty():
        raise ValueError("layer 'correctness' needs a golden answer of every sample")


def evaluate(spark: SparkSession, settings: Settings, golden_path: str, responses: DataFrame, run_id: str, dataset: str, ts: str, baseline_run_id: str | None = None, corpus: DataFrame | None = None, datasets: DataFrame | None = None, layer: str = "retrieval", judge: bool = False) -> dict:
    """Golden samples and recall responses to metrics, a ledger, a report and a diff.

    responses are as in schemas.RESPONSE. With a corpus, samples whose chunks aren't in it stop the run, unless
    documents can stand in. With datasets, samples get their domain.
    """
    samples = readers.golden(spark, golden_path).withColumnRenamed("id", "sample_id")
    stage_preconditions(samples, layer, judge)
    if corpus is not None:
        lost = golden.precheck(samples.withColumnRenamed("sample_id", "id"), corpus).where("not doc_fallback_available")
        if not lost.isEmpty():
            raise ValueError(f"{lost.count()} samples expect chunks that the corpus doesn't have")
    hits = fusion.adapt_response(responses)
    values = metrics.compute(hits, samples)
    kinds = samples.select("sample_id", F.coalesce("type", F.lit("keyword")).alias("type"), F.get("dataset_ids", F.lit(0)).alias("dataset_id"))
    kinds = aggregate.with_domain(kinds, datasets) if datasets is not None else kinds.withColumn("domain", F.lit(aggregate.UNCATALOGUED))
    buckets = aggregate.metric_buckets(values.join(kinds, "sample_id"))
    buckets = buckets if datasets is not None else buckets.where(F.col("domain_bucket") == aggregate.ALL)
    ranked = hits.groupBy("sample_id").agg(F.count(F.lit(1)).cast("int").alias("n_ranked"))
    diagnostics = samples.select("sample_id").join(responses.select("sample_id", "elapsed_ms", "failed_sources"), "sample_id", "left").join(ranked, "sample_id", "left")
    diagnostics = diagnostics.select("sample_id", "elapsed_ms", F.coalesce("failed_sources", F.array().cast("array<string>")).alias("failed_sources"), F.coalesce("n_ranked", F.lit(0)).alias("n_ranked"))
    snapshot, store = settings.snapshot(spark), Store(spark, settings.store_path)
    store.save_snapshot(snapshot, run_id)
    store.save_result(aggregate.ledger(buckets, snapshot.drop("git_sha", "top_k").withColumn("top_k", F.lit(settings.top_k)), run_id, dataset, ts), values, snapshot, run_id)
    saved = store.load_baseline(run_id)
    whole, quality = store.load_totals(run_id), aggregate.run_quality(diagnostics)
    deltas = None
    if baseline_run_id and whole is not None:
        base = store.load_totals(baseline_run_id)
        if base is None:
            raise ValueError(f"no baseline {baseline_run_id!r}")
        same = aggregate.incomparable(snapshot, store.load_snapshot(baseline_run_id, snapshot.schema)).isEmpty()
        deltas = aggregate.diff(whole, base, same)
    html = report.retrieval_html(f"{dataset} {run_id}", saved, quality, aggregate.median_latency(diagnostics), deltas, aggregate.failed_source_counts(diagnostics))
    report.write_text(spark, html, f"{settings.store_path}/reports/{run_id}.html")
    report.write_text(spark, report.to_json(saved, deltas), f"{settings.store_path}/reports/{run_id}.json")
    return {"buckets": saved, "quality": quality, "deltas": deltas, "summary": report.summary(whole, quality)}


def assemble(settings: Settings, asked: dict[str, DataFrame], corpus: dict[str, DataFrame], top_k: int | None = None) -> DataFrame:
    """Route hits of the settings' routes, in their order, each with its own top_k and threshold.

    asked and corpus hold what a route needs by its name: texts for bm25, vectors for dense, weights for sparse. With
    top_k, every route gives so many and no threshold holds: the pool that a grid of settings is cut from.
    """
    fields = [retrieve.Field(f.tokens, length, boost) for f, length, boost in zip(retrieve.COARSE_AND_FINE, (settings.bm25_coarse_length, settings.bm25_fine_length), (settings.bm25_coarse_boost, 1.0), strict=True)]
    makers = {
        "bm25": lambda own, held, k, least: retrieve.top(retrieve.bm25(own, held, k, k1=settings.bm25_k1, b=settings.bm25_b, fields=fields), k, "bm25", least),
        "dense": lambda own, held, k, least: retrieve.dense(own, held, k, least), "sparse": lambda own, held, k, least: retrieve.sparse(own, held, k, least),
    }
    unknown = [name for name in settings.routes if name not in makers]
    if unknown:
        raise NotImplementedError(f"no such route: {', '.join(unknown)}")
    depth = lambda name: top_k or settings.route_top_ks.get(name, settings.top_k)
    least = lambda name: None if top_k else settings.route_score_thresholds.get(name, settings.score_threshold)
    return retrieve.merge_routes(*[makers[name](asked[name], corpus[name], depth(name), least(name)) for name in settings.routes])


def cache_routes(spark: SparkSession, settings: Settings, asked: dict[str, DataFrame], corpus: dict[str, DataFrame], top_k: int, out: str) -> tuple[DataFrame, DataFrame]:
    """(hits, failed): the pool of all routes, written once; every setting of a grid is evaluated over it.

    Routes are written apart. One that fails leaves the others as they are: its samples are told in failed
    (sample_id, failed_sources, reasons), which is written, too, and it has no hits.
    """
    reasons, paths = {}, []
    for name in settings.routes:
        path = f"{out}/hits-{name}"
        try:
            assemble(dataclasses.replace(settings, enabled_sources=(name,)), asked, corpus, top_k).write.mode("overwrite").parquet(path)
            paths.append(path)
        except NotImplementedError:
            raise
        except Exception as raised:  # noqa: BLE001 - a route's failure is a result: it is told, sample by sample
            reasons[name] = str(raised).splitlines()[0][:500]
    told = spark.createDataFrame(list(reasons.items()), "source string, reason string")
    samples = reduce(DataFrame.union, [asked[n].select("sample_id") for n in settings.routes]).distinct()
    # As many rows of told as routes.
    failed = samples.withColumn("source", F.explode(F.array(*map(F.lit, settings.routes)))).join(F.broadcast(told), "source")
    failed = failed.groupBy("sample_id").agg(F.array_sort(F.collect_list("source")).alias("failed_sources"), F.array_sort(F.collect_set("reason")).alias("reasons"))
    failed.write.mode("overwrite").parquet(f"{out}/failed")
    hits = spark.read.parquet(*paths) if paths else spark.createDataFrame([], "sample_id string, source string, route_rank int, chunk_id string, score double")
    return hits, spark.read.parquet(f"{out}/failed")


def tune(spark: SparkSession, route_hits: DataFrame, samples: DataFrame, out: str, dense_top_ks: str = "20,50,100,150", sparse_top_ks: str = "5,10,20,30,50", dense_thresholds: str = "0,0.1,0.2,0.3,0.4,0.5", sparse_thresholds: str = "0,0.1,0.2,0.25,0.3,0.4", strategy: str = "rrf", top_k: int = 10) -> DataFrame:
    """A grid over cached route hits, all configs in one plan, written with its report."""
    configs = fusion.config_grid(spark, fusion.parse_numbers(dense_top_ks, int), fusion.parse_numbers(sparse_top_ks, int), fusion.parse_numbers(dense_thresholds), fusion.parse_numbers(sparse_thresholds))
    results = fusion.evaluate_grid(route_hits, samples, configs, strategy=strategy, top_k=top_k)
    results.write.mode("overwrite").parquet(f"{out}/results.parquet")
    kept = spark.read.parquet(f"{out}/results.parquet")
    report.tuning_outputs(kept, out)
    return fusion.best_configs(kept)


def clean(spark: SparkSession, pairs: DataFrame, out: str, run_id: str) -> DataFrame:
    """Scores of cleaned documents: samples and buckets as files, and a report."""
    scored = markdown.score_pairs(pairs)
    scored.write.mode("overwrite").json(f"{out}/{run_id}-samples.jsonl")
    buckets = markdown.cleaning_buckets(spark.read.schema(scored.schema).json(f"{out}/{run_id}-samples.jsonl"))
    report.write_text(spark, report.cleaning_html(f"Cleaning {run_id}", buckets), f"{out}/{run_id}.html")
    return buckets


def convert(spark: SparkSession, collection: str, queries: str, qrels: str, manifest: str, name: str, out: str, graded: bool = False, settings: Settings | None = None, skip_ingest: bool = True) -> DataFrame:
    """Public judgments to golden samples; returns counts of what was converted and what wasn't.

    Unless skip_ingest, the passages are put into the store of the settings first.
    """
    if not skip_ingest:
        ingest(spark, settings or Settings.read(), collection, manifest)
    judged = readers.json_qrels(spark, qrels) if qrels.endswith(".json") else readers.qrels(spark, qrels)
    readers.collection(spark, collection).count()  # fails where an id occurs twice
    found = golden.convert_judgments(judged, readers.queries(spark, queries), readers.manifest(spark, manifest), name, graded)
    samples = found.where("converted").select("id", "query", F.lit(Settings().user_id).cast("long").alias("user_id"), F.array().cast("array<bigint>").alias("dataset_ids"), "expected_chunk_ids", "expected_doc_ids", "relevance_grades", F.lit(None).cast("string").alias("golden_answer"), F.lit("keyword").alias("type"), "note")
    readers.write_golden(samples, out)
    return found.agg(F.count_if("converted").alias("converted"), F.count_if(~F.col("converted")).alias("skipped_no_positive"), F.count_if("partial_missing").alias("skipped_partial_missing"))


def ingest(spark: SparkSession, settings: Settings, collection: str, manifest: str, limit: int | None = None) -> DataFrame:
    """Successful manifest rows with their texts, as chunks of the store."""
    from plumbline.functions import columns

    rows = golden.manifest_rows(readers.manifest(spark, manifest), readers.collection(spark, collection), limit)
    chunks = rows.select(columns.chunk_id(F.lit(1), F.col("doc_id"), F.lit(0)).alias("chunk_id"), F.lit(1).cast("long").alias("dataset_id"), "doc_id", F.col("text").alias("content"), columns.content_hash(F.col("text")).alias("content_hash"), F.lit(0).alias("ordinal"))
    return Store(spark, settings.store_path).upsert(chunks, "chunks", "chunk_id")


def generate(spark: SparkSession, settings: Settings, chunks: DataFrame, n: int, ask: Callable[[str], str], out: str, review: Callable[[str], str] | None = None, hard_out: str | None = None, seed: int = 0, **calls) -> dict:
    """A golden set from a corpus: chunks are picked, a model writes questions, a gate passes them, files are written.

    chunks: (chunk_id, dataset_id, doc_id, chunk_index, content). ask and review are functions of a prompt; without
    review nothing is gated. What an independent retriever misses is hard, and written to hard_out. Both are called
    once for each question: what they said is written before it is used.
    """
    base = f"{settings.store_path}/generated/{uuid.uuid4().hex}"
    chunks = chunks if "chunk_index" in chunks.columns else chunks.withColumnRenamed("ordinal", "chunk_index")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.parquet(f"{base}/{name}")

    prompt = lambda text, **of: functools.reduce(lambda t, item: F.replace(t, F.lit("{" + item[0] + "}"), F.coalesce(F.col(item[1]), F.lit(""))), of.items(), F.lit(text))
    groups = golden.question_groups(chunks, golden.quota(n), seed).withColumn("prompt", prompt(golden.ASK, type="type", passages="passages"))
    answers = kept(golden.applied(groups, ask, "prompt", "answer", **calls), "answers")
    made = golden.generated_samples(answers)
    written = made.where("dropped is null")
    decided = written.withColumn("decision", F.lit("passed"))
    if review is not None:
        asked = written.withColumn("prompt", prompt(golden.REVIEW, query="query", answer="golden_answer", passages="passages"))
        said = kept(golden.applied(asked, review, "prompt", "verdict", **calls), "reviews").withColumn("v", F.from_json(first_json_object("verdict"), "answerable boolean, consistent boolean"))
        found = retrieve.bm25(said.select("sample_id", F.col("query").alias("text")), chunks.select("chunk_id", F.col("content").alias("text")), golden.LOOP_TOP)
        retrieved = found.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("route_rank", "chunk_id")))["chunk_id"].alias("retrieved"))
        signals = said.join(retrieved, "sample_id", "left").select(
            *written.columns, (F.col("passages") != "").alias("has_text"), F.coalesce("v.answerable", F.lit(False)).alias("answerable"), (F.coalesce("golden_answer", F.lit("")) != "").alias("has_golden_answer"),
            F.col("v.consistent").alias("consistent"), F.coalesce("retrieved", F.array().cast("array<string>")).alias("retrieved"), F.col("used_chunk_ids").alias("expected"),
        )
        decided = golden.gate(signals)
    samples = decided.select(
        F.col("sample_id").alias("id"), "query", F.lit(settings.user_id).cast("long").alias("user_id"), F.array("dataset_id").alias("dataset_ids"), F.col("used_chunk_ids").alias("expected_chunk_ids"), F.lit(None).cast("array<bigint>").alias("expected_doc_ids"),
        F.lit(None).cast("map<string,int>").alias("relevance_grades"), "golden_answer", "type", F.lit(None).cast("string").alias("note"), "decision",
    )
    samples = kept(samples, "samples")
    readers.write_golden(samples.where("decision = 'passed'"), out)
    if hard_out:
        readers.write_golden(samples.where("decision = 'hard'"), hard_out)
    counts = {r["decision"]: r["count"] for r in samples.groupBy("decision").count().collect()}
    lost = {r["dropped"]: r["count"] for r in made.where("dropped is not null").groupBy("dropped").count().collect()}
    return {"asked": groups.count(), "passed": counts.get("passed", 0), "hard": counts.get("hard", 0), "gated_out": counts.get("dropped", 0), "not_generated": lost}


def ingest_and_locate(spark: SparkSession, settings: Settings, rendered: DataFrame, facts: DataFrame, parse: Callable, split: Callable[[str], list[str]], dataset_id: int = 1, **calls) -> tuple[DataFrame, DataFrame]:
    """Rendered documents (doc_id, content) parsed, cut into chunks, put into the store, and their facts located in these.

    Returns (doc_id, status), failed where nothing could be parsed, and (fact_id, chunk_ids, tier) of all facts.
    parse makes text of content, split chunks of text.
    """
    import json

    from plumbline.functions import columns

    parsed = golden.applied(rendered.select("doc_id", "content"), lambda content: json.dumps(split(parse(content))), "content", "pieces", **calls).select("doc_id", F.from_json("pieces", "array<string>").alias("pieces"))
    base = f"{settings.store_path}/parsed/{uuid.uuid4().hex}"
    parsed.write.parquet(base)
    parsed = spark.read.parquet(base)
    cut = parsed.select("doc_id", F.posexplode("pieces").alias("ordinal", "content"))
    key = columns.chunk_id(F.lit(dataset_id), F.col("doc_id"), F.col("ordinal"))
    chunks = cut.select(key.alias("chunk_id"), F.lit(dataset_id).cast("long").alias("dataset_id"), F.col("doc_id").cast("long").alias("doc_id"), "content", columns.content_hash(F.col("content")).alias("content_hash"), "ordinal")
    Store(spark, settings.store_path).upsert(chunks, "chunks", "chunk_id")
    status = parsed.select("doc_id", F.when(F.coalesce(F.size("pieces"), F.lit(0)) > 0, "success").otherwise("failed").alias("status"))
    return status, golden.locate(facts, chunks)

"""Whole flows: golden sets from a corpus, documents ingested and facts located, stores, commands, and plans."""

import contextlib
import io
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import aggregate, fusion, golden, retrieve, vectors
from plumbline.plans import cli, report, run
from plumbline.plans.settings import Settings
from plumbline.sources import providers, readers
from plumbline.sources.store import JsonStore, Store


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(f"c{d}-{i}", 1 + d % 2, d, i, f"topic{d} passage{i} tells of thing{d}x{i} and more") for d in range(12) for i in range(4)]
    return spark.createDataFrame(rows, "chunk_id string, dataset_id long, doc_id long, chunk_index int, content string")


def models():
    """A generator, for which some prompts have no answer, and a reviewer; closures, since workers don't know this file."""

    def ask(prompt):
        """Writes about the first passage."""
        first = prompt.split("[", 1)[1].split("]")
        if "c3-" in first[0]:
            return '{"answerable": false}'
        if "c5-" in first[0]:
            raise RuntimeError("no answer")
        word = next(w for w in first[1].split() if w.startswith("thing"))
        return json.dumps({"answerable": True, "query": f"what of {word if 'c7-' not in first[0] else 'nothing'}?", "answer": word, "used_chunk_ids": [first[0]]})

    def review(prompt):
        return json.dumps({"answerable": True, "consistent": "thing9" not in prompt.split("Answer:")[1].split("\n")[0]})

    return ask, review


def test_golden_set_from_a_corpus(spark, tmp_path, chunks):
    settings, (ask, review) = Settings(store_path=str(tmp_path / "store")), models()
    told = run.generate(spark, settings, chunks, 40, ask, str(tmp_path / "golden"), review, str(tmp_path / "hard"), seed=3, backoff=0)
    made, hard = readers.golden(spark, str(tmp_path / "golden")).collect(), readers.golden(spark, str(tmp_path / "hard")).collect()
    assert told["asked"] == 40 and len(made) == told["passed"] > 20 and len(hard) == told["hard"] > 0 and told["gated_out"] > 0
    assert told["asked"] == told["passed"] + told["hard"] + told["gated_out"] + sum(told["not_generated"].values()) and set(told["not_generated"]) == {"unanswerable", "unparsed"}
    kinds = {r["type"] for r in made}
    assert kinds == {"keyword", "paraphrase", "longtail", "cross_doc"} and all(r["expected_chunk_ids"] and r["user_id"] == settings.user_id for r in made)
    assert all("c7-" in r["expected_chunk_ids"][0] for r in hard)
    plain = run.generate(spark, settings, chunks, 10, ask, str(tmp_path / "ungated"), backoff=0)
    assert plain["hard"] == plain["gated_out"] == 0 and readers.golden(spark, str(tmp_path / "ungated")).count() == plain["passed"]


def test_golden_gen_command(spark, tmp_path, chunks, monkeypatch, capsys):
    monkeypatch.setenv("EVAL_STORE_PATH", str(tmp_path / "store"))
    chunks.write.parquet(str(tmp_path / "chunks"))
    arguments = ["golden-gen", "--chunks", str(tmp_path / "chunks"), "--n", "6", "--out", str(tmp_path / "out"), "--dataset-ids", "2"]
    assert cli.main(arguments, spark) == 2
    with pytest.raises(ValueError, match="no chat provider 'own'"):
        cli.main([*arguments, "--generator", "own"], spark)
    providers.register("chat", "own", lambda settings: lambda prompt: '{"query": "q", "answer": "a"}')
    assert cli.main([*arguments, "--generator", "own"], spark) == 0 and "'passed': 6" in capsys.readouterr().out
    assert {x for r in readers.golden(spark, str(tmp_path / "out")).collect() for x in r["dataset_ids"]} == {2}
    assert json.loads(providers.provider("sparse", "stub")("a b a"))["values"].count(2.0) == 1


def test_documents_are_ingested_and_facts_located(spark, tmp_path):
    rendered = spark.createDataFrame([(1, b"alpha fact one\n\nbeta fact two"), (2, b"\xff\xfe"), (3, b"gamma")], "doc_id long, content binary")
    facts = spark.createDataFrame([("f1", 1, "beta fact"), ("f2", 3, "delta"), ("f3", 2, "x")], "fact_id string, doc_id long, anchor string")
    settings = Settings(store_path=str(tmp_path))
    status, located = run.ingest_and_locate(spark, settings, rendered, facts, providers.provider("parser", "md"), lambda t: t.split("\n\n"), backoff=0, retries=1)
    assert {tuple(r) for r in status.collect()} == {(1, "success"), (2, "failed"), (3, "success")}
    assert {r["fact_id"]: (r["tier"], len(r["chunk_ids"])) for r in located.collect()} == {"f1": ("exact", 1), "f2": ("miss", 0), "f3": ("miss", 0)}
    assert Store(spark, str(tmp_path)).load("chunks").count() == 3


def test_calls_are_tried_again_and_batched(spark, tmp_path):
    def flaky(values):
        mark = tmp_path / f"seen-{values[0]}"
        if not mark.exists():
            mark.write_text("")
            raise TimeoutError
        return [v * 2 for v in values]

    rows = spark.createDataFrame([(f"t{i}",) for i in range(7)], "t string").coalesce(1)
    got = golden.applied(rows, flaky, "t", "made", batch=3, backoff=0).collect()
    assert {r["t"]: r["made"] for r in got} == {f"t{i}": f"t{i}t{i}" for i in range(7)} and len(os.listdir(tmp_path)) == 3
    short = golden.applied(rows, lambda values: values[:-1], "t", "made", batch=3, retries=2, backoff=0).collect()
    assert all(r["made"] is None for r in short)


def test_a_version_that_was_cut_off_is_not_read(spark, tmp_path):
    store, rows = Store(spark, str(tmp_path)), lambda *r: spark.createDataFrame(r, "chunk_id string, content string")
    assert store.load("chunks") is None
    store.upsert(rows(("a", "1")), "chunks", "chunk_id")
    store.tables.change().upsert("chunks", rows(("z", "9")), "chunk_id")  # never committed
    assert [tuple(r) for r in store.load("chunks").collect()] == [("a", "1")]
    for i in range(10):
        store.upsert(rows((f"n{i}", "2")), "chunks", "chunk_id")
    assert {r["chunk_id"] for r in store.load("chunks").collect()} == {"a", *(f"n{i}" for i in range(10))}
    assert len(store.tables.manifest()["tables"]["chunks"]["entries"]) < 8  # changes were merged on the way


def test_light_store_and_samples(spark, tmp_path):
    light = JsonStore(spark, str(tmp_path / "json"))
    buckets = spark.createDataFrame([("recall", 10, 0.5)], "metric string, k int, value double")
    light.save("r", Settings().snapshot(spark), buckets)
    assert light.load("r")["metrics"] == [{"metric": "recall", "k": 10, "value": 0.5}] and light.load("none") is None
    assert report.from_json(spark, report.to_json(buckets), "metric string, k int, value double").collect() == buckets.collect()
    store = Store(spark, str(tmp_path / "store"))
    values = spark.createDataFrame([("s", "recall", 10, 1.0)], "sample_id string, metric string, k int, value double")
    store.save_result(buckets.withColumn("run_id", F.lit("r")), values, Settings().snapshot(spark), "r")
    assert store.load_samples("r").collect() == values.collect() and store.load_samples("x") is None


def test_run_with_corpus_and_domains(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("EVAL_STORE_PATH", str(tmp_path / "store"))
    sample = {"id": "a", "query": "q", "user_id": 1, "dataset_ids": [7], "expected_chunk_ids": ["c1"], "type": "keyword"}
    (tmp_path / "golden.jsonl").write_text(json.dumps(sample) + "\n")
    hit = {"chunk_id": "c1", "doc_id": 1, "dataset_id": 7, "fused_score": 0.9, "scores": {"dense": 0.9}}
    (tmp_path / "responses.jsonl").write_text(json.dumps({"sample_id": "a", "hits": [hit], "elapsed_ms": 5, "per_source_counts": {"dense": 1}, "failed_sources": ["sparse"]}) + "\n")
    spark.createDataFrame([("c1",)], "chunk_id string").write.parquet(str(tmp_path / "corpus"))
    spark.createDataFrame([("other",)], "chunk_id string").write.parquet(str(tmp_path / "wrong"))
    spark.createDataFrame([(7, "medical")], "dataset_id long, domain string").write.parquet(str(tmp_path / "datasets"))
    arguments = ["run", "--golden", str(tmp_path / "golden.jsonl"), "--responses", str(tmp_path / "responses.jsonl"), "--run-id", "r", "--dataset", "d", "--ts", "t", "--datasets", str(tmp_path / "datasets")]
    assert cli.main([*arguments, "--corpus", str(tmp_path / "corpus")], spark) == 0 and "recall@1 = 1.0000" in capsys.readouterr().out
    saved = Store(spark, str(tmp_path / "store")).load_baseline("r")
    assert "medical" in {r["domain_bucket"] for r in saved.collect()}
    page = (tmp_path / "store" / "reports" / "r.html").read_text()
    assert "failed sources: sparse=1" in page and "dense only 100% · median latency 5 ms" in page and "not clean" in page
    with pytest.raises(ValueError, match="expect chunks"):
        cli.main([*arguments, "--corpus", str(tmp_path / "wrong")], spark)
    with pytest.raises(ValueError, match="needs a judge"):
        cli.main([*arguments, "--layer", "generation"], spark)


def test_routes_are_assembled_and_cached(spark, tmp_path):
    texts = lambda name, *said: spark.createDataFrame([(f"{name}{i}", x) for i, x in enumerate(said)], f"{'sample_id' if name == 'q' else 'chunk_id'} string, text string")
    vector = lambda name, *rows: spark.createDataFrame([(f"{name}{i}", list(map(float, r))) for i, r in enumerate(rows)], f"{'sample_id' if name == 'q' else 'chunk_id'} string, vector array<double>")
    weight = lambda name, *rows: spark.createDataFrame([(f"{name}{i}", k, w) for i, r in enumerate(rows) for k, w in r.items()], f"{'sample_id' if name == 'q' else 'chunk_id'} string, index int, weight double")
    asked = {"bm25": texts("q", "red apple"), "dense": vector("q", (1, 0)), "sparse": weight("q", {1: 1.0})}
    corpus = {"bm25": texts("c", "red apple pie", "red car", "blue"), "dense": vector("c", (1, 0), (0.5, 0), (0, 1)), "sparse": weight("c", {1: 0.2}, {1: 0.9}, {2: 1.0})}
    settings = Settings(route_top_ks={"dense": 2, "bm25": 1}, route_score_thresholds={"sparse": 0.5})
    told = lambda df: sorted((r["source"], r["route_rank"], r["chunk_id"]) for r in df.collect())
    assert told(run.assemble(settings, asked, corpus)) == [("bm25", 0, "c0"), ("dense", 0, "c0"), ("dense", 1, "c1"), ("sparse", 0, "c1")]
    pool, failed = run.cache_routes(spark, settings, asked, corpus, 3, str(tmp_path / "pool"))
    assert failed.count() == 0
    assert told(pool) == [("bm25", 0, "c0"), ("bm25", 1, "c1"), ("dense", 0, "c0"), ("dense", 1, "c1"), ("dense", 2, "c2"), ("sparse", 0, "c1"), ("sparse", 1, "c0")]
    broken = corpus | {"dense": corpus["dense"].withColumn("vector", F.when(F.col("chunk_id") == "c1", F.raise_error(F.lit("no vectors here")).cast("array<double>")).otherwise(F.col("vector")))}
    pool, failed = run.cache_routes(spark, settings, asked, broken, 3, str(tmp_path / "pool"))
    assert {r[0] for r in told(pool)} == {"bm25", "sparse"}  # the others are kept
    row = failed.collect()
    assert [(r["sample_id"], r["failed_sources"]) for r in row] == [("q0", ["dense"])] and row[0]["reasons"]
    assert aggregate.failed_source_counts(failed).collect()[0]["n"] == 1
    with pytest.raises(NotImplementedError, match="other"):
        run.assemble(Settings(enabled_sources=("dense", "other")), asked, corpus)


def test_limits_are_taken_before_the_shuffle(spark):
    scored = spark.createDataFrame([("s", "c", 1.0)], "sample_id string, chunk_id string, score double")
    hits = scored.withColumns({"source": F.lit("dense"), "route_rank": F.lit(0), "doc_id": F.lit(1).cast("long"), "dataset_id": F.lit(1).cast("long")})
    for df in (retrieve.top(scored, 3, "dense"), fusion.filter_routes(hits, F.lit(3), F.lit(0.1)), fusion.rrf(fusion.filter_routes(hits, F.lit(3), F.lit(0.1)), 2)):
        assert "WindowGroupLimit" in plan(df)
    assert "TakeOrderedAndProject" in plan(golden.allot_types(scored.withColumnRenamed("chunk_id", "key"), {"keyword": 2}, "key"))


@pytest.mark.parametrize("sent", [retrieve.SENT_VECTORS, 200])
def test_dense_finds_the_best_of_all(spark, monkeypatch, sent):
    """Over batches, tasks and blocks of queries; equal scores by id; no cartesian product."""
    monkeypatch.setattr(retrieve, "SENT_VECTORS", sent)
    monkeypatch.setattr(retrieve, "STEP", 40)
    rng = np.random.default_rng(4)
    corpus = np.round(rng.normal(size=(90, 4)), 1)
    asked = np.round(rng.normal(size=(7, 4)), 1)
    frame = lambda name, rows, kind: spark.createDataFrame([(f"{name}{i:02}", r.tolist()) for i, r in enumerate(rows)] + [(f"{name}x", None)], f"{kind} string, vector array<double>")
    found = retrieve.dense(frame("q", asked, "sample_id"), frame("c", corpus, "chunk_id").repartition(5), 6, 0.05)
    want = {(f"q{i:02}", rank, f"c{j:02}") for i, q in enumerate(asked) for rank, j in enumerate(sorted(range(90), key=lambda j: (-round(float(q @ corpus[j]), 9), j))[:6]) if q @ corpus[j] >= 0.05}
    assert {(r["sample_id"], r["route_rank"], r["chunk_id"]) for r in found.collect()} == want
    assert "Cartesian" not in plan(found) and "NestedLoop" not in plan(found)
    assert retrieve.dense(frame("q", asked[:0], "sample_id"), frame("c", corpus, "chunk_id")).count() == 0
    assert spark.range(1).select(vectors.dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0))).alias("x")).first()["x"] == 11.0


def test_passages_are_numbered_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(golden, "NUMBERED", 10)
    rows = spark.range(203).select(F.md5(F.col("id").cast("string").cast("binary")).alias("source_id"), "id").repartition(7)
    numbered = golden.number_passages(rows, 500)
    got = {r["source_id"]: r["doc_id"] for r in numbered.collect()}
    assert got == {s: 500 + i for i, s in enumerate(sorted(got))} and len(got) == 203
    assert golden.number_passages(rows.where("id < 0"), 0).count() == 0


def test_bm25_without_queries_or_texts(spark):
    texts = lambda name, *rows: spark.createDataFrame(rows, f"{name} string, text string")
    corpus = texts("chunk_id", ("c", "red apple"), ("d", None))
    assert retrieve.bm25(texts("sample_id"), corpus).count() == 0 and retrieve.bm25(texts("sample_id", ("q", "red")), texts("chunk_id")).count() == 0
    assert [r["chunk_id"] for r in retrieve.bm25(texts("sample_id", ("q", "red"), ("r", None)), corpus).collect()] == ["c"]

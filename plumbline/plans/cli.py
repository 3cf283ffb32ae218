"""Command line: python -m plumbline.plans.cli COMMAND ..."""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import SparkSession

from plumbline.operators import golden
from plumbline.plans import run
from plumbline.plans.settings import Settings
from plumbline.sources import providers, readers, schemas


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="plumbline", description="Evaluates retrieval and document cleaning on Spark.")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, *needed: str, **options) -> None:
        sub = commands.add_parser(name, help=about)
        for option in needed:
            sub.add_argument(f"--{option}", required=True)
        for option, default in options.items():
            flag = f"--{option.replace('_', '-')}"
            sub.add_argument(flag, action="store_true") if default is False else sub.add_argument(flag, default=default, type=type(default) if default is not None else str)

    command("run", "evaluate recall responses against a golden set", "golden", "responses", "run-id", "dataset", "ts", baseline=None, corpus=None, datasets=None, layer="retrieval")
    command("tune-recall", "evaluate a grid of fusion settings over cached route hits", "golden", "route-hits", "out", dense_top_ks="20,50,100,150", sparse_top_ks="5,10,20,30,50", dense_thresholds="0,0.1,0.2,0.3,0.4,0.5", sparse_thresholds="0,0.1,0.2,0.25,0.3,0.4", strategy="rrf", top_k=10)
    command("cleaning", "score cleaned documents against their references", "pairs", "out", "run-id")
    command("golden-opensource", "convert public judgments to golden samples", "collection", "queries", "qrels", "manifest", "name", "out", graded=False, ingest=False)
    command("golden-gen", "write a golden set from a corpus with a registered chat provider", "chunks", "n", "out", dataset_ids=None, generator="", reviewer=None, hard_out=None, seed=0, providers=None)
    command("ingest", "put a manifest's passages into the store", "collection", "manifest", limit=0)
    command("config", "show the settings")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args, settings = parser().parse_args(argv), Settings.read()
    if args.command == "config":
        print(settings.shown())
        return 0
    spark = spark or SparkSession.builder.appName("plumbline").getOrCreate()
    if args.command == "run":
        corpus, datasets = (spark.read.parquet(path) if path else None for path in (args.corpus, args.datasets))
        responses = spark.read.schema(schemas.RESPONSE).json(args.responses)
        print(run.evaluate(spark, settings, args.golden, responses, args.run_id, args.dataset, args.ts, args.baseline, corpus, datasets, args.layer)["summary"])
    elif args.command == "tune-recall":
        samples = readers.golden(spark, args.golden).withColumnRenamed("id", "sample_id")
        run.tune(spark, spark.read.parquet(args.route_hits), samples, args.out, args.dense_top_ks, args.sparse_top_ks, args.dense_thresholds, args.sparse_thresholds, args.strategy, args.top_k).show()
    elif args.command == "cleaning":
        run.clean(spark, spark.read.schema(schemas.PAIRS).json(args.pairs), args.out, args.run_id).show()
    elif args.command == "golden-opensource":
        run.convert(spark, args.collection, args.queries, args.qrels, args.manifest, args.name, args.out, args.graded, settings, not args.ingest).show()
    elif args.command == "golden-gen":
        if args.providers:
            importlib.import_module(args.providers)  # registers what it brings
        name = args.generator or settings.generator_model
        if not name:
            print("no generator: name a chat provider by --generator or EVAL_GENERATOR_MODEL", file=sys.stderr)
            return 2
        chunks = spark.read.parquet(args.chunks)
        if args.dataset_ids:
            chunks = golden.eligible_chunks(chunks, [int(x) for x in args.dataset_ids.split(",") if x.strip()])
        review = providers.provider("chat", args.reviewer, settings) if args.reviewer else None
        print(run.generate(spark, settings, chunks, int(args.n), providers.provider("chat", name, settings), args.out, review, args.hard_out, args.seed, retries=settings.judge_retries, longest=settings.judge_longest_wait))
    else:
        run.ingest(spark, settings, args.collection, args.manifest, args.limit).select("chunk_id").show()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

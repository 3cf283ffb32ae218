"""Rerank and generation metrics that need no model: they compare orders, or average a judge's scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.metrics import sample_metrics


def order_deltas(hits: DataFrame, golden: DataFrame, applied: DataFrame | None = None, k_values: Sequence[int] = (1, 3, 5, 10), top_n: int | None = None, before: str = "rrf", after: str = "rerank") -> DataFrame:
    """(metric, k, before, after, delta, n, delta_applied, n_applied): ndcg and mrr of two orders of the same candidates.

    hits carry ordering. k stops at top_n, what the reranker returns. applied: (sample_id, rerank_applied), of which
    the last two columns are the mean over samples where it was.
    """
    ks = [k for k in k_values if top_n is None or k <= top_n]
    both = None
    for name in (before, after):
        own = sample_metrics(hits.where(F.col("ordering") == name), golden, ks).where(F.startswith("metric", F.lit("ndcg")) | (F.col("metric") == "mrr")).select("sample_id", "metric", "k", "value", F.lit(name).alias("ordering"))
        both = own if both is None else both.unionByName(own)
    per = both.groupBy("sample_id", "metric", "k").agg(F.max(F.when(F.col("ordering") == before, F.col("value"))).alias("b"), F.max(F.when(F.col("ordering") == after, F.col("value"))).alias("a"))
    per = per.join(applied.select("sample_id", "rerank_applied"), "sample_id", "left") if applied is not None else per.withColumn("rerank_applied", F.lit(True))
    on = F.coalesce(F.col("rerank_applied"), F.lit(False))
    return per.groupBy("metric", "k").agg(
        F.avg("b").alias("before"), F.avg("a").alias("after"), F.avg(F.col("a") - F.col("b")).alias("delta"), F.count(F.lit(1)).alias("n"), F.avg(F.when(on, F.col("a") - F.col("b"))).alias("delta_applied"), F.count_if(on).alias("n_applied"),
    )


def applied_rate(diagnostics: DataFrame) -> DataFrame:
    """The share of samples that the reranker was applied to; unknown ones don't count."""
    return diagnostics.where("rerank_applied is not null").agg(F.avg(F.col("rerank_applied").cast("int")).alias("rerank_applied_rate"), F.count(F.lit(1)).alias("n"))


def degraded(hits: DataFrame, contents: DataFrame, top_n: int) -> DataFrame:
    """What is passed on when the reranker fails: hits whose content is there, in their order, the first top_n."""
    held = hits.join(contents.where(F.col("content").isNotNull()).select("chunk_id").distinct(), "chunk_id", "left_semi")
    first = held.withColumn("nth", F.row_number().over(Window.partitionBy("sample_id").orderBy("rank"))).where(F.col("nth") <= top_n)
    return first.withColumn("rank", F.col("nth") - 1).drop("nth")


def judged(scores: DataFrame, needs_answer: Sequence[str] = ("context_recall", "answer_correctness")) -> DataFrame:
    """(metric, value, n, skipped) of a judge's (sample_id, metric, score, has_golden_answer).

    Metrics that need a golden answer skip samples without one, and say how many.
    """
    skipped = F.col("metric").isin(*needs_answer) & ~F.coalesce(F.col("has_golden_answer"), F.lit(False))
    return scores.groupBy("metric").agg(F.avg(F.when(~skipped, F.col("score"))).alias("value"), F.count(F.when(~skipped, F.col("score"))).alias("n"), F.count_if(skipped).alias("skipped"))


def abstention(answers: DataFrame) -> DataFrame:
    """The share of answers that are empty; a null answer is one."""
    return answers.agg(F.avg((F.coalesce(F.btrim("answer"), F.lit("")) == "").cast("int")).alias("abstention_rate"), F.count(F.lit(1)).alias("n"))

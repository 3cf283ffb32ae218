"""Aggregates over samples and runs: buckets, run quality, ledgers, diffs to a baseline, trends, noise."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import round4

#: The bucket of all, the domain of samples in no catalogue, when a bucket is small in a report.
ALL, UNCATALOGUED, SMALL_BUCKET = "__all__", "未编目", 15
#: What must be equal for two runs to be compared.
COMPARED = ("sparse_vector_provider", "top_k", "enabled_sources", "rrf_k", "route_score_thresholds", "route_top_ks", "fusion_strategy", "fusion_weights")


def with_domain(samples: DataFrame, datasets: DataFrame) -> DataFrame:
    """samples with the domain of their dataset_id; what no dataset names is uncatalogued."""
    known = datasets.select("dataset_id", F.col("domain").alias("found"))
    return samples.join(known, "dataset_id", "left").withColumn("domain", F.coalesce("found", F.lit(UNCATALOGUED))).drop("found")


def metric_buckets(values: DataFrame, layer: str = "retrieval") -> DataFrame:
    """(layer, metric, k, type_bucket, domain_bucket, value, n): over all samples, by type and by domain.

    values: sample_id, metric, k, value, type, domain. One pass over grouping sets; n counts samples that have a value.
    """
    base = values.select("metric", "k", "type", "domain", "value")
    grouped = base.groupingSets([["metric", "k"], ["metric", "k", "type"], ["metric", "k", "domain"]], "metric", "k", "type", "domain").agg(
        F.avg("value").alias("value"), F.count("value").alias("n"), F.grouping("type").alias("gt"), F.grouping("domain").alias("gd")
    )
    bucket = lambda grouped_away, c: F.when(F.col(grouped_away) == 1, ALL).otherwise(F.col(c))
    return grouped.where("n > 0").select(F.lit(layer).alias("layer"), "metric", "k", bucket("gt", "type").alias("type_bucket"), bucket("gd", "domain").alias("domain_bucket"), "value", "n")


def run_quality(diagnostics: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(samples, failed_samples, zero_ranked, clean) of (.., failed_sources, n_ranked); clean: neither failed nor empty."""
    return diagnostics.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"), F.count_if(F.size("failed_sources") > 0).alias("failed_samples"), F.count_if(F.col("n_ranked") == 0).alias("zero_ranked"),
        (F.count_if((F.size("failed_sources") > 0) | (F.col("n_ranked") == 0)) == 0).alias("clean"),
    )


def failed_source_counts(diagnostics: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return diagnostics.select(*keys, F.explode("failed_sources").alias("source")).groupBy(*keys, "source").agg(F.count(F.lit(1)).alias("n"))


def counted_ranks(counted: DataFrame, keys: tuple[str, ...], value: str, n: str = "n") -> DataFrame:
    """counted (keys, value, n, ..) with upto and total: how many values of a group are no greater, and how many there are.

    n counts non-null values, so it is 0 beside a null. A group's distinct values are sorted, and on disk where they
    are many; no array holds them.
    """
    order = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counted.withColumns({"upto": F.sum(n).over(order), "total": F.sum(n).over(Window.partitionBy(*keys))})


def rank_of(value: str, percent: float) -> Column:
    """The value at the rounded index of the sorted values, half to even, of (value, upto, total); 0 where there is none."""
    at = F.bround(F.lit(percent / 100) * (F.col("total") - 1), 0)
    return F.coalesce(F.min(F.when(F.col("upto") > at, F.col(value))).cast("double"), F.lit(0).cast("double"))


def nearest_ranks(rows: DataFrame, value: str, percents: tuple[float, ...] = (50, 95), keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, p50, p95, ..) of a column, by counts of its distinct values."""
    counted = rows.groupBy(*keys, value).agg(F.count(value).alias("n"))
    return counted_ranks(counted, keys, value).groupBy(*keys).agg(*[rank_of(value, p).alias(f"p{p:g}") for p in percents])


def median_latency(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.where("elapsed_ms <> 0").agg(F.median("elapsed_ms").alias("median_ms"))


def mean4(value: Column) -> Column:
    return round4(F.avg(value))


def small(n: Column) -> Column:
    return n < SMALL_BUCKET


def ledger(buckets: DataFrame, snapshot: DataFrame, run_id: str, dataset: str, ts: str) -> DataFrame:
    """Metric buckets as ledger rows with the run's settings (a one-row snapshot) beside each."""
    scale = F.when(F.endswith("metric", F.lit("_graded")), "graded").otherwise("binary")
    return buckets.select(F.lit(run_id).alias("run_id"), F.lit(ts).alias("ts"), F.lit(dataset).alias("dataset"), "layer", "metric", "k", scale.alias("relevance_scale"), "type_bucket", "domain_bucket", "value", "n").join(F.broadcast(snapshot.limit(1)))


@dataclass(frozen=True)
class Criteria:
    """When a change is a regression: recall or ndcg falls by more than this, on so many samples at least."""

    recall_drop: float = 0.02
    ndcg_drop: float = 0.02
    least_n: int = 30


def incomparable(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(dimension, baseline, current) of two one-row snapshots, where they differ; maps and lists as sorted text."""
    def told(df: DataFrame, name: str) -> DataFrame:
        kinds = dict(df.dtypes)
        text = lambda c: F.to_json(F.array_sort(F.map_entries(c))) if kinds[c].startswith("map") else F.to_json(F.struct(c))
        return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), text(c).alias(name)) for c in COMPARED if c in kinds])).alias("x")).select("x.*")

    return told(baseline, "baseline").join(told(current, "current"), "dimension", "full_outer").where(~F.col("baseline").eqNullSafe(F.col("current")))


def diff(current: DataFrame, baseline: DataFrame, comparable: bool = True, criteria: Criteria = Criteria()) -> DataFrame:
    """Changes of (layer, metric, k, value, n) against a baseline, with whether each is a regression."""
    old = baseline.select(F.col("layer").alias("bl"), F.col("metric").alias("bm"), F.col("k").alias("bk"), F.col("value").alias("baseline_value"))
    both = current.join(old, (F.col("layer") == F.col("bl")) & (F.col("metric") == F.col("bm")) & F.col("k").eqNullSafe(F.col("bk")))
    delta = F.col("value") - F.col("baseline_value")
    falls = ((F.col("metric") == "recall") & (delta < -criteria.recall_drop)) | (F.startswith("metric", F.lit("ndcg")) & (delta < -criteria.ndcg_drop))
    return both.select("layer", "metric", "k", "value", "baseline_value", delta.alias("delta"), "n", (F.lit(comparable) & (F.col("n") >= criteria.least_n) & falls).alias("is_regression"))


def equal_models(roles: DataFrame) -> DataFrame:
    """(role_a, role_b, model): roles (ord, role, model) that share a model that is named."""
    a, b = (roles.select(*[F.col(c).alias(f"{c}_{s}") for c in ("ord", "role", "model")]) for s in "ab")
    return a.join(b, (F.col("model_a") == F.col("model_b")) & (F.col("ord_a") < F.col("ord_b"))).where("model_a <> ''").select("role_a", "role_b", F.col("model_a").alias("model"))


def trend(series: DataFrame, keys: tuple[str, ...] = ("metric",), config: str | None = None) -> DataFrame:
    """(keys, ts, value, previous, delta) of a metric over time, and where its config changed."""
    order = Window.partitionBy(*keys).orderBy("ts")
    out = series.withColumn("previous", F.lag("value").over(order)).withColumn("delta", F.col("value") - F.col("previous"))
    return out if config is None else out.withColumn("config_changed", ~F.col(config).eqNullSafe(F.lag(config).over(order)) & F.col("previous").isNotNull())


def noise_floor(runs: DataFrame, keys: tuple[str, ...] = ("metric", "k")) -> DataFrame:
    """The standard deviation of a metric over repeated runs of one configuration; null for a single run."""
    return runs.groupBy(*keys).agg(F.stddev_samp("value").alias("sigma"), F.avg("value").alias("mean"), F.count(F.lit(1)).alias("runs"))


def bootstrap(values: DataFrame, keys: tuple[str, ...] = ("metric", "k"), rounds: int = 200, seed: int = 11, level: float = 0.95) -> DataFrame:
    """(keys, low, high): percentile interval of the mean under resampling by Poisson weights drawn from hashes.

    Each value gets its weight in every round from a hash of sample and round, so reruns agree and rounds are one
    pre-aggregated pass; rows aren't sent rounds times, only sums are.
    """
    name = F.concat_ws(":", F.lit(str(seed)), F.col("sample_id").cast("string"), "round", *keys)
    u = (F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("long") + 0.5) / float(1 << 32)
    cuts, p, total = [], 0.36787944117144233, 0.0
    for i in range(6):
        total += p
        cuts.append(total)
        p /= i + 1
    weight = sum(((u > c).cast("int") for c in cuts), F.lit(0))
    drawn = values.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("weight", weight)
    means = drawn.groupBy(*keys, "round").agg((F.sum(F.col("value") * F.col("weight")) / F.nullif(F.sum("weight"), F.lit(0))).alias("mean"))
    tail = (1 - level) / 2
    return means.groupBy(*keys).agg(F.percentile("mean", tail).alias("low"), F.percentile("mean", 1 - tail).alias("high"))

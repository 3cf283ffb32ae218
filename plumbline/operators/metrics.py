"""Retrieval metrics per sample, all from one join and one aggregate.

hits: sample_id, chunk_id, doc_id, rank (0-based), and sources for the overlap. golden: sample_id,
expected_chunk_ids, expected_doc_ids, and optionally relevance_grades. Results are long:
(sample_id, metric, k, value, granularity); k is null for metrics over the whole list.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K_VALUES = (1, 3, 5, 10)
LAYER = "retrieval"


def with_grades(golden: DataFrame) -> DataFrame:
    return golden if "relevance_grades" in golden.columns else golden.withColumn("relevance_grades", F.lit(None).cast("map<string,int>"))


def references(golden: DataFrame) -> DataFrame:
    """(sample_id, granularity, ids): chunks if any are expected, else documents by their number as text."""
    chunks = F.coalesce("expected_chunk_ids", F.array().cast("array<string>"))
    docs = F.coalesce("expected_doc_ids", F.array().cast("array<bigint>"))
    by_doc = (F.size(chunks) == 0) & (F.size(docs) > 0)
    return golden.select(
        "sample_id", F.when(by_doc, "doc").otherwise("chunk").alias("granularity"),
        F.array_distinct(F.when(by_doc, F.transform(docs, lambda d: d.cast("string"))).otherwise(chunks)).alias("ids"),
    )


def ranked_ids(hits: DataFrame, granularity: DataFrame, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """(keys, granularity, ref, pos, fresh): what is ranked, from 1. Documents count where they come first
    and close ranks; chunks all count, and fresh marks an id's first place."""
    ref = F.when(F.col("granularity") == "doc", F.col("doc_id").cast("string")).otherwise(F.col("chunk_id"))
    placed = hits.join(granularity, "sample_id").withColumn("ref", ref)
    again = Window.partitionBy(*keys, "ref").orderBy("rank")
    placed = placed.withColumn("nth", F.row_number().over(again)).where((F.col("granularity") == "chunk") | (F.col("nth") == 1))
    return placed.select(*keys, "granularity", "ref", F.row_number().over(Window.partitionBy(*keys).orderBy("rank")).alias("pos"), (F.col("nth") == 1).alias("fresh"))


def _discounted(gains: Column, k: int) -> Column:
    """Sum of gains by descending value, each divided by the logarithm of its place."""
    return F.aggregate(F.transform(F.slice(gains, 1, k), lambda g, i: g / F.log2(i + 2.0)), F.lit(0.0), lambda s, x: s + x)


def sample_metrics(hits: DataFrame, golden: DataFrame, k_values: Sequence[int] = K_VALUES) -> DataFrame:
    """recall, hit_rate, precision, ndcg_binary or ndcg_graded at each k; mrr and map over the whole list.

    A sample without expected ids has no rows; one that has only grades has ndcg_graded alone, by chunk. A
    sample that retrieved nothing has zeros.
    """
    golden = with_grades(golden)
    refs = references(golden).join(golden.select("sample_id", "relevance_grades"), "sample_id")
    refs = refs.withColumn("graded", F.coalesce(F.size("relevance_grades") > 0, F.lit(False))).where((F.size("ids") > 0) | F.col("graded"))
    ranked = ranked_ids(hits, refs.select("sample_id", "granularity")).drop("granularity")
    joined = refs.join(ranked, "sample_id", "left")
    rel = F.coalesce(F.array_contains("ids", F.col("ref")), F.lit(False))
    grade = F.coalesce(F.when(F.col("graded"), F.element_at("relevance_grades", F.col("ref"))).otherwise(rel.cast("int")), F.lit(0)).cast("double")
    found = joined.withColumns({"rel": rel, "gain": F.when(F.col("ref").isNull(), 0.0).otherwise(grade)})
    so_far = Window.partitionBy("sample_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = found.withColumn("hits_so_far", F.sum(F.col("rel").cast("int")).over(so_far))
    within = lambda k: F.col("pos") <= k
    aggregates = [
        F.first("granularity").alias("granularity"), F.first("graded").alias("graded"), F.first(F.size("ids")).alias("n_rel"), F.count("pos").alias("n_ret"), F.min(F.when(F.col("rel"), F.col("pos"))).alias("first_rel"),
        F.sum(F.when(F.col("rel"), F.col("hits_so_far") / F.col("pos")).otherwise(0.0)).alias("precisions"),
        F.first(F.when(F.col("graded"), F.reverse(F.array_sort(F.transform(F.map_values("relevance_grades"), lambda g: g.cast("double"))))).otherwise(F.transform("ids", lambda _: F.lit(1.0)))).alias("ideal"),
    ]
    for k in k_values:
        aggregates += [
            F.sum((F.col("rel") & F.col("fresh") & within(k)).cast("int")).alias(f"found_{k}"),
            F.sum(F.when(within(k), F.col("gain") / F.log2(F.col("pos") + 1.0)).otherwise(0.0)).alias(f"dcg_{k}"),
        ]
    per = found.groupBy("sample_id").agg(*aggregates)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    named, has = [], F.col("n_rel") > 0
    row = lambda name, k, value, given: F.struct(name.alias("metric"), F.lit(k).cast("int").alias("k"), F.when(given, value).alias("value"))
    for k in k_values:
        got = zero(F.col(f"found_{k}").cast("double"))
        ideal = _discounted(F.col("ideal"), k)
        named += [
            row(F.lit("recall"), k, got / F.nullif(F.col("n_rel"), F.lit(0)), has), row(F.lit("hit_rate"), k, F.when(got > 0, 1.0).otherwise(0.0), has), row(F.lit("precision"), k, got / k, has),
            row(F.when(F.col("graded"), "ndcg_graded").otherwise("ndcg_binary"), k, zero(F.col(f"dcg_{k}") / F.nullif(ideal, F.lit(0.0))), F.lit(True)),
        ]
    least = F.least("n_rel", "n_ret")
    named += [row(F.lit("mrr"), None, zero(1 / F.col("first_rel").cast("double")), has), row(F.lit("map"), None, zero(F.col("precisions") / F.nullif(least, F.lit(0))), has)]
    return per.select("sample_id", F.explode(F.array(*named)).alias("m"), "granularity").select("sample_id", "m.metric", "m.k", "m.value", "granularity").where("value is not null")


def first_relevant_ranks(hits: DataFrame, golden: DataFrame) -> DataFrame:
    """(sample_id, granularity, first_relevant_rank) of samples with expected ids: the rank, from 1 on, of the first that is expected; null if none is."""
    refs = references(golden).where(F.size("ids") > 0)
    ranked = ranked_ids(hits, refs.select("sample_id", "granularity")).drop("granularity")
    found = refs.join(ranked, "sample_id", "left")
    return found.groupBy("sample_id").agg(F.first("granularity").alias("granularity"), F.min(F.when(F.array_contains("ids", F.col("ref")), F.col("pos"))).cast("int").alias("first_relevant_rank"))


def source_overlap(hits: DataFrame) -> DataFrame:
    """(sample_id, metric, k, value): of a sample's hits with sources, the share that only this source found, for
    each source seen in the sample, and the share that all of them found where there are several."""
    own = hits.where(F.size("sources") > 0).select("sample_id", F.array_sort(F.array_distinct("sources")).alias("sources"))
    per = own.groupBy("sample_id", "sources").agg(F.count(F.lit(1)).alias("n"))
    totals = per.groupBy("sample_id").agg(F.sum("n").alias("total"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("seen"), F.collect_list(F.struct("sources", "n")).alias("sets"))
    share = lambda wanted: F.aggregate(F.filter("sets", lambda s: s["sources"] == wanted), F.lit(0).cast("long"), lambda a, s: a + s["n"]) / F.col("total")
    only = F.transform("seen", lambda s: F.struct(F.concat(F.lit("overlap_"), s, F.lit("_only")).alias("metric"), share(F.array(s)).alias("value")))
    everywhere = F.when(F.size("seen") > 1, F.array(F.struct(F.lit("overlap_all_sources").alias("metric"), share(F.col("seen")).alias("value")))).otherwise(F.array().cast("array<struct<metric:string,value:double>>"))
    return totals.select("sample_id", F.explode(F.concat(only, everywhere)).alias("m")).select("sample_id", "m.metric", F.lit(None).cast("int").alias("k"), "m.value")


def pooled_references(golden: DataFrame, judged: DataFrame, hits: DataFrame, depth: int = 10) -> DataFrame:
    """golden with document references added that were retrieved in the first ranks and judged relevant; none go.

    judged: (sample_id, doc_id, relevant).
    """
    pool = hits.where(F.col("rank") < depth).select("sample_id", "doc_id").distinct().join(judged.where("relevant").select("sample_id", "doc_id").distinct(), ["sample_id", "doc_id"])
    added = pool.groupBy("sample_id").agg(F.collect_set("doc_id").alias("added"))
    both = F.array_union(F.coalesce("expected_doc_ids", F.array().cast("array<bigint>")), F.coalesce("added", F.array().cast("array<bigint>")))
    return golden.join(added, "sample_id", "left").withColumn("expected_doc_ids", both).drop("added")


Metric = Callable[[DataFrame, DataFrame], DataFrame]
_REGISTRY: dict[str, dict[str, Metric]] = {}


def register(layer: str, name: str, metric: Metric) -> None:
    """Adds a metric to a layer; the same name again changes nothing."""
    _REGISTRY.setdefault(layer, {}).setdefault(name, metric)


def metrics_for(layer: str) -> dict[str, Metric]:
    return dict(_REGISTRY.get(layer, {}))


def register_defaults() -> None:
    """The seven default metrics: six come from one plan, the overlap from another."""
    register(LAYER, "ranking", sample_metrics)
    register(LAYER, "source_overlap", lambda hits, golden: source_overlap(hits).withColumn("granularity", F.lit(None).cast("string")))


def compute(hits: DataFrame, golden: DataFrame, layer: str = LAYER) -> DataFrame:
    """All registered metrics of a layer, long."""
    register_defaults()
    out = None
    for metric in metrics_for(layer).values():
        rows = metric(hits, golden).select("sample_id", "metric", "k", "value", "granularity")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError(f"no metrics for layer {layer!r}")
    return out

"""Route filtering, score fusion and parameter grids as one plan.

route_hits: sample_id, source, route_rank (0-based, the order that the route returned), chunk_id, doc_id,
dataset_id, score. Every function also takes extra leading keys, so that a grid is the same plan with the settings
beside sample_id.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import finite

#: The order of routes, default weights, the constant of reciprocal ranks.
ROUTES = ("bm25", "dense", "sparse")
WEIGHTS = {"dense": 0.9, "sparse": 0.1}
RRF_K = 60


def parse_numbers(value: str, cast=float) -> list:
    """Numbers of a comma-separated list, each once, in order; an empty list is an error."""
    found = list(dict.fromkeys(cast(p) for p in map(str.strip, value.split(",")) if p))
    if not found:
        raise ValueError(f"no numbers in {value!r}")
    return found


def _place(source: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ROUTES)), source), F.lit(0)), F.lit(len(ROUTES) + 1))


def filter_routes(route_hits: DataFrame, top_k: Column, threshold: Column, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Hits that reach the threshold, then the first top_k of each route, in the route's order; adds kept_rank."""
    kept = route_hits.where(F.col("score") >= threshold)
    order = Window.partitionBy(*keys, "source").orderBy("route_rank")
    return kept.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= top_k).withColumn("kept_rank", F.col("nth") - 1).drop("nth")


def _ranked(fused: DataFrame, keys: Sequence[str], order: list[Column], top_k: int) -> DataFrame:
    first = fused.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("nth") <= top_k)
    return first.select(*keys, "chunk_id", "doc_id", "dataset_id", (F.col("nth") - 1).alias("rank"), "score", "sources")


def rrf(kept: DataFrame, top_k: int = 10, rrf_k: int = RRF_K, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Reciprocal-rank fusion; ties go to what was seen first, routes in order and then by rank."""
    place = F.struct(_place(F.col("source")).alias("route"), "kept_rank")
    # Summed in the order of routes, so that equal sums stay equal.
    parts = F.array_sort(F.collect_list(F.struct(_place(F.col("source")).alias("route"), (1.0 / (F.lit(rrf_k) + F.col("kept_rank") + 1)).alias("part"))))
    fused = kept.groupBy(*keys, "chunk_id").agg(
        F.aggregate(parts, F.lit(0.0), lambda s, p: s + p["part"]).alias("score"), F.array_sort(F.collect_set("source")).alias("sources"),
        F.min(place).alias("seen"), F.min_by(F.struct("doc_id", "dataset_id"), place).alias("from"),
    ).withColumns({"doc_id": F.col("from.doc_id"), "dataset_id": F.col("from.dataset_id")})
    return _ranked(fused, keys, [F.desc("score"), F.asc("seen")], top_k)


def weighted(kept: DataFrame, top_k: int = 10, weights: dict[str, float] | None = None, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Weighted sum of scores scaled to 0..1 within each route; weights are shared among routes with hits.

    bm25 and sparse scores are log1p first and mustn't be negative; scores must be finite, and the weights of the
    routes with hits must not sum to 0: the query fails otherwise. A route's only score, or equal ones, count 1.
    """
    weights = WEIGHTS if weights is None else weights
    damped = F.col("source").isin("bm25", "sparse")
    known = F.col("source").isin(*ROUTES)
    bad = F.when(~known, F.raise_error(F.concat(F.lit("unsupported source: "), F.col("source")))).when(~finite(F.col("score")), F.raise_error(F.lit("scores must be finite"))).when(damped & (F.col("score") < 0), F.raise_error(F.lit("scores must be >= 0")))
    value = F.when(bad.isNotNull(), F.lit(None)).when(damped, F.log1p("score")).otherwise(F.col("score"))
    weight = F.lit(0.0)
    for source, w in weights.items():
        weight = F.when(F.col("source") == source, F.lit(float(w))).otherwise(weight)
    route, sample = Window.partitionBy(*keys, "source"), Window.partitionBy(*keys)
    scaled = kept.withColumns({"v": value, "w": weight}).withColumns({"low": F.min("v").over(route), "high": F.max("v").over(route), "first": F.row_number().over(route.orderBy("kept_rank")) == 1})
    active = F.sum(F.when(F.col("first"), F.col("w")).otherwise(0.0)).over(sample)
    scaled = scaled.withColumn("active", active).withColumn("share", F.when(F.col("active") <= 0, F.raise_error(F.lit("weights of active sources sum to 0")).cast("double")).otherwise(F.col("w") / F.col("active")))
    part = F.when(F.col("high") == F.col("low"), 1.0).otherwise((F.col("v") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0))) * F.col("share")
    place = F.struct(_place(F.col("source")).alias("route"), "kept_rank")
    parts = F.array_sort(F.collect_list(F.struct(_place(F.col("source")).alias("route"), part.alias("part"))))
    fused = scaled.groupBy(*keys, "chunk_id").agg(
        F.aggregate(parts, F.lit(0.0), lambda s, p: s + p["part"]).alias("score"), F.array_sort(F.collect_set("source")).alias("sources"), F.min_by(F.struct("doc_id", "dataset_id"), place).alias("from"),
    ).withColumns({"doc_id": F.col("from.doc_id"), "dataset_id": F.col("from.dataset_id")})
    return _ranked(fused, keys, [F.desc("score"), F.asc("chunk_id")], top_k)


def fuse(kept: DataFrame, strategy: str = "rrf", top_k: int = 10, rrf_k: int = RRF_K, weights: dict[str, float] | None = None, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    if strategy == "rrf":
        return rrf(kept, top_k, rrf_k, keys)
    if strategy == "weighted_score":
        return weighted(kept, top_k, weights, keys)
    raise ValueError(f"unsupported fusion strategy {strategy!r}")


def source_counts(kept: DataFrame, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """per_source_counts: how many hits each route keeps."""
    per = kept.groupBy(*keys, "source").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return per.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("per_source_counts"))


def config_grid(spark: SparkSession, dense_top_ks: Iterable[int], sparse_top_ks: Iterable[int], dense_thresholds: Iterable[float], sparse_thresholds: Iterable[float]) -> DataFrame:
    """(config_id, dense_top_k, sparse_top_k, dense_threshold, sparse_threshold), in the order of nested loops."""
    every = product(map(int, dense_top_ks), map(int, sparse_top_ks), map(float, dense_thresholds), map(float, sparse_thresholds))
    return spark.createDataFrame([(i, *c) for i, c in enumerate(every)], "config_id int, dense_top_k int, sparse_top_k int, dense_threshold double, sparse_threshold double")


GRID_ROUTES = ("dense", "sparse")


def grid_settings(configs: DataFrame) -> dict[str, list[tuple[int, float]]]:
    """The distinct (top_k, threshold) of each route, in order; a setting's number is its place. The driver holds the configs once."""
    names = [f"{s}_{c}" for s in GRID_ROUTES for c in ("top_k", "threshold")]
    found = configs.select(*names).collect()
    return {s: sorted({(int(r[f"{s}_top_k"]), float(r[f"{s}_threshold"])) for r in found}) for s in GRID_ROUTES}


def kept_sets(route_hits: DataFrame, samples: DataFrame, settings: dict[str, list[tuple[int, float]]]) -> DataFrame:
    """(sample_id, source, settings, hits): what each route's settings keep of a sample's hits, each outcome once.

    A sample's hits of a route are one row; every distinct setting cuts it once. settings are the numbers of those with this
    outcome; a sample without hits has one outcome of none.
    """
    hit = F.struct("route_rank", "chunk_id", "doc_id", "dataset_id", F.col("score").cast("double").alias("score"))
    pool = route_hits.where(F.col("source").isin(*GRID_ROUTES)).groupBy("sample_id", "source").agg(F.array_sort(F.collect_list(hit)).alias("pool"))
    listed = [F.array(*[F.struct(F.lit(i).alias("number"), F.lit(k).alias("top_k"), F.lit(t).alias("threshold")) for i, (k, t) in enumerate(settings[s])]) for s in GRID_ROUTES]
    each = samples.select("sample_id").distinct().withColumn("source", F.explode(F.array(*map(F.lit, GRID_ROUTES))))
    asked = each.join(pool, ["sample_id", "source"], "left").select("sample_id", "source", "pool", F.explode(F.when(F.col("source") == GRID_ROUTES[0], listed[0]).otherwise(listed[1])).alias("setting"))
    kept = F.slice(F.filter("pool", lambda h: h["score"] >= F.col("setting.threshold")), F.lit(1), F.col("setting.top_k"))
    cut = asked.select("sample_id", "source", "setting.number", F.coalesce(kept, F.array().cast(dict(pool.dtypes)["pool"])).alias("hits")).withColumn("outcome", F.xxhash64(F.transform("hits", lambda h: h["route_rank"])))
    return cut.groupBy("sample_id", "source", "outcome").agg(F.array_sort(F.collect_list("number")).alias("settings"), F.first("hits").alias("hits")).drop("outcome")


def evaluate_grid(route_hits: DataFrame, golden: DataFrame, configs: DataFrame, failed: DataFrame | None = None, strategy: str = "rrf", top_k: int = 10, rrf_k: int = RRF_K, weights: dict[str, float] | None = None) -> DataFrame:
    """One row for each config: recall, hit rate at top_k, map and mrr over all samples of golden.

    Samples without expected ids count as 0. failed: (sample_id) of those with a failed route. Routes are cut once for
    each of their settings, and of a sample each pair of outcomes is fused and measured once, however many configs lead
    to it; configs meet the measures, not the hits.
    """
    from plumbline.operators.metrics import ranked_ids, references

    refs = references(golden).where(F.size("ids") > 0)
    # Of a sample, the settings that lead to an outcome tell it from others.
    outcome = F.struct(F.array_join(F.transform("settings", lambda n: n.cast("string")), ",").alias("of"), "hits")
    settings = grid_settings(configs)
    sets = kept_sets(route_hits, refs, settings).groupBy("sample_id").agg(*[F.collect_list(F.when(F.col("source") == s, outcome)).alias(s) for s in GRID_ROUTES])  # one outcome a setting at most
    both = sets.withColumn("d", F.explode("dense")).select("sample_id", "d", F.explode("sparse").alias("s"))
    keys = ("dense_of", "sparse_of", "sample_id")
    of = lambda side, source: F.transform(f"{side}.hits", lambda h, i: F.struct(F.lit(source).alias("source"), i.alias("kept_rank"), *[h[c].alias(c) for c in ("chunk_id", "doc_id", "dataset_id", "score")]))
    listed = both.select(F.col("d.of").alias("dense_of"), F.col("s.of").alias("sparse_of"), "sample_id", F.inline(F.concat(of("d", "dense"), of("s", "sparse"))))
    ranked = fuse(listed, strategy, top_k, rrf_k, weights, keys)
    placed = ranked_ids(ranked, refs.select("sample_id", "granularity"), keys).join(refs.select("sample_id", "ids"), "sample_id")
    rel = F.array_contains("ids", F.col("ref"))
    so_far = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("rel", rel).withColumn("so_far", F.sum(F.col("rel").cast("int")).over(so_far))
    per = placed.groupBy(*keys).agg(
        F.first(F.size("ids")).alias("n_rel"), F.count(F.lit(1)).alias("n_ret"), F.sum((F.col("rel") & F.col("fresh") & (F.col("pos") <= top_k)).cast("int")).alias("found"),
        F.min(F.when(F.col("rel"), F.col("pos"))).alias("first_rel"), F.sum(F.when(F.col("rel"), F.col("so_far") / F.col("pos")).otherwise(0.0)).alias("precisions"),
    )
    per = per.select(
        *keys, (F.col("found") / F.col("n_rel")).alias("recall"), (F.col("found") > 0).cast("double").alias("hit_rate"), (F.col("precisions") / F.least("n_rel", "n_ret")).alias("map"),
        F.coalesce(1 / F.col("first_rel").cast("double"), F.lit(0.0)).alias("mrr"),
    )
    # Measures are summed by the pair of lists of settings first: samples share few of them.
    names = ("recall", "hit_rate", "map", "mrr")
    summed = per.groupBy("dense_of", "sparse_of").agg(*[F.sum(c).alias(c) for c in names])
    summed = summed.withColumn("dense_number", F.explode(F.split("dense_of", ","))).withColumn("sparse_number", F.explode(F.split("sparse_of", ",")))
    sums = summed.groupBy("dense_number", "sparse_number").agg(*[F.sum(c).alias(c) for c in names])
    for source in GRID_ROUTES:
        numbers = [(str(i), k, t) for i, (k, t) in enumerate(settings[source])]
        sums = sums.join(F.broadcast(configs.sparkSession.createDataFrame(numbers, f"{source}_number string, {source}_top_k int, {source}_threshold double")), f"{source}_number")  # as few as settings
    n = golden.count()
    n_failed = failed.distinct().count() if failed is not None else 0
    share = lambda c: (F.coalesce(c, F.lit(0.0)) / F.lit(n) if n else F.lit(0.0)).alias(c)
    found = configs.join(sums, ["dense_top_k", "sparse_top_k", "dense_threshold", "sparse_threshold"], "left")
    return found.select(*configs.columns, *[share(c) for c in names], F.lit(top_k).alias("final_top_k"), F.lit(rrf_k).alias("rrf_k"), F.lit(n).alias("n"), F.lit(n_failed).alias("failed_source_samples"))


#: The order of configs, best first: metrics, then fewer candidates, then higher thresholds.
BEST_FIRST = [F.desc, F.desc, F.desc, F.desc, F.asc, F.asc, F.desc, F.desc]
BEST_BY = ("recall", "hit_rate", "mrr", "map", "sparse_top_k", "dense_top_k", "sparse_threshold", "dense_threshold")


def best_configs(results: DataFrame, limit: int = 20) -> DataFrame:
    """The first configs of the ranking; the report's length is the feature here."""
    return results.orderBy(*[way(c) for way, c in zip(BEST_FIRST, BEST_BY, strict=True)]).limit(limit)


def adapt_response(response: DataFrame) -> DataFrame:
    """Hits of recall responses (sample_id, hits array<struct<chunk_id,doc_id,dataset_id,fused_score,scores map>>).

    Sorted by score, in the order given where equal; a hit's sources are the routes that gave it a score.
    """
    hit = response.select("sample_id", F.posexplode("hits").alias("at", "h"))
    order = Window.partitionBy("sample_id").orderBy(F.desc("h.fused_score"), "at")
    sources = F.array_sort(F.map_keys(F.map_filter("h.scores", lambda k, v: v.isNotNull())))
    return hit.select("sample_id", "h.chunk_id", "h.doc_id", "h.dataset_id", (F.row_number().over(order) - 1).alias("rank"), F.col("h.fused_score").alias("score"), sources.alias("sources"))


def pick_attempts(attempts: DataFrame) -> DataFrame:
    """Of each sample's attempts (sample_id, attempt, failed_sources, n_hits, ..) the first clean one, else the last."""
    clean = (F.size("failed_sources") <= 0) & (F.col("n_hits") > 0)
    order = Window.partitionBy("sample_id").orderBy(F.desc(clean), F.when(clean, F.col("attempt")).otherwise(-F.col("attempt")))
    return attempts.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")

"""The queries in DuckDB's SQL, written from the definitions: no part is shared with the Spark plans."""

HITS = """h AS (SELECT l_orderkey AS sample_id, l_partkey AS doc_id, l_quantity AS quantity, list_sort(list_distinct([l_returnflag, l_linestatus])) AS sources, l_discount,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber) AS rn FROM lineitem)"""
REFS = """r AS (SELECT l_orderkey AS sample_id, l_partkey AS doc_id, CAST(floor(max(l_quantity) / 10) - 3 AS INT) AS grade FROM lineitem WHERE l_quantity >= 40 GROUP BY 1, 2)"""


def _ranked(hits: str = "h", refs: str = "r", key: str = "sample_id") -> str:
    """Common table expressions up to j: ranked documents with whether each is expected."""
    return f"""d AS (SELECT {key}, doc_id, min(rn) AS mr FROM {hits} GROUP BY ALL),
p AS (SELECT {key}, doc_id, row_number() OVER (PARTITION BY {key} ORDER BY mr) AS pos FROM d),
n AS (SELECT sample_id, count(*) AS n_rel FROM {refs} GROUP BY 1)"""


_J = f"""{HITS}, {REFS}, {_ranked()},
j AS (SELECT n.sample_id, n.n_rel, p.doc_id, p.pos, r.doc_id IS NOT NULL AS rel, coalesce(r.grade, 0) AS grade FROM n LEFT JOIN p USING (sample_id) LEFT JOIN r ON r.sample_id = p.sample_id AND r.doc_id = p.doc_id),
ks AS (SELECT unnest([1, 3, 5, 10])::INT AS k),
a AS (SELECT *, sum(rel::INT) OVER (PARTITION BY sample_id ORDER BY pos) AS so_far FROM j),
ideal AS (SELECT sample_id, grade, row_number() OVER (PARTITION BY sample_id ORDER BY grade DESC) AS i FROM r)"""

_ALL = f"""{_J},
per AS (
 SELECT sample_id, 'recall' AS metric, k, count(*) FILTER (rel AND pos <= k) / any_value(n_rel) AS value FROM j, ks GROUP BY sample_id, k
 UNION ALL SELECT sample_id, 'hit_rate', k, CASE WHEN count(*) FILTER (rel AND pos <= k) > 0 THEN 1.0::DOUBLE ELSE 0 END FROM j, ks GROUP BY sample_id, k
 UNION ALL SELECT sample_id, 'precision', k, count(*) FILTER (rel AND pos <= k) / k FROM j, ks GROUP BY sample_id, k
 UNION ALL SELECT sample_id, 'ndcg_binary', k, coalesce(sum(1 / log2(pos + 1)) FILTER (rel AND pos <= k), 0) / list_sum(list_transform(range(1, least(k, any_value(n_rel)) + 1), lambda i: 1 / log2(i + 1))) FROM j, ks GROUP BY sample_id, k
 UNION ALL SELECT sample_id, 'mrr', NULL, coalesce(1 / min(pos) FILTER (rel), 0) FROM j GROUP BY sample_id
 UNION ALL SELECT sample_id, 'map', NULL, coalesce(sum(so_far / pos) FILTER (rel), 0) / least(any_value(n_rel), count(pos)) FROM a GROUP BY sample_id)"""


def _line(metric: str) -> str:
    return f"WITH {_ALL} SELECT sample_id, k, round(value, 6) AS value FROM per WHERE metric = '{metric}'"


_BUCKETS = f"""{_ALL},
b AS (SELECT per.*, o_orderpriority AS type, n_name AS domain FROM per JOIN orders ON o_orderkey = sample_id JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
g AS (SELECT metric, k, CASE WHEN grouping(type) = 1 THEN '__all__' ELSE type END AS type_bucket, CASE WHEN grouping(domain) = 1 THEN '__all__' ELSE domain END AS domain_bucket, avg(value) AS value, count(*) AS n
 FROM b GROUP BY GROUPING SETS ((metric, k), (metric, k, type), (metric, k, domain)))"""

_VEC = """q AS (SELECT vec_id AS sample_id, embedding AS e, label FROM embeddings WHERE vec_id % 100 = 0),
ds AS (SELECT q.sample_id, c.vec_id AS chunk_id, list_sum(list_transform(list_zip(q.e, c.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) AS score FROM q, embeddings c),
dr AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY round(score, 9) DESC, chunk_id) - 1 AS route_rank FROM ds),
dims AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS w FROM embeddings),
sd AS (SELECT * FROM dims WHERE w > 0.1::FLOAT::DOUBLE OR w > 0.1),
ss AS (SELECT a.vec_id AS sample_id, b.vec_id AS chunk_id, sum(round(a.w * b.w, 12)::DECIMAL(28, 12))::DOUBLE AS score FROM sd a JOIN sd b USING (i) WHERE a.vec_id % 100 = 0 GROUP BY 1, 2),
sr AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY round(score, 9) DESC, chunk_id) - 1 AS route_rank FROM ss),
routes AS (SELECT sample_id, 'dense' AS source, 1 AS ord, route_rank, printf('%05d', chunk_id) AS chunk_id, round(score, 9) AS score FROM dr WHERE route_rank < 50
 UNION ALL SELECT sample_id, 'sparse', 2, route_rank, printf('%05d', chunk_id), round(score, 9) FROM sr WHERE route_rank < 50),
rel AS (SELECT q.sample_id, printf('%05d', c.vec_id) AS doc_id FROM q JOIN embeddings c ON c.label = q.label AND c.vec_id <> q.sample_id)"""


def _fusion(kept: str, keys: str, strategy: str, k: int = 10) -> str:
    """Expressions from kept (keys, source, ord, kr, chunk_id, score) to f (keys, chunk_id, score, sources, rank)."""
    if strategy == "rrf":
        fused = f"SELECT {keys}, chunk_id, list_sum(list(1.0::DOUBLE / (60 + kr + 1) ORDER BY ord)) AS score, string_agg(source, '+' ORDER BY source) AS sources, min([ord, kr]) AS seen FROM {kept} GROUP BY ALL"
        order = "score DESC, seen"
        before = ""
    else:
        before = f"""wv AS (SELECT *, CASE WHEN source = 'sparse' THEN ln(1 + score) ELSE score END AS v, CASE WHEN source = 'sparse' THEN 0.1::DOUBLE ELSE 0.9 END AS w FROM {kept}),
wn AS (SELECT *, min(v) OVER s AS lo, max(v) OVER s AS hi FROM wv WINDOW s AS (PARTITION BY {keys}, source)),
wa AS (SELECT {keys}, sum(w) AS active FROM (SELECT DISTINCT {keys}, source, w FROM wv) GROUP BY ALL),
wp AS (SELECT wn.*, CASE WHEN hi = lo THEN 1 ELSE (v - lo) / (hi - lo) END * (w / active) AS part FROM wn JOIN wa USING ({keys})),
"""
        fused = f"SELECT {keys}, chunk_id, list_sum(list(part ORDER BY ord)) AS score, string_agg(source, '+' ORDER BY source) AS sources FROM wp GROUP BY ALL"
        order = "score DESC, chunk_id"
    return f"{before}fs AS ({fused}), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) - 1 AS rank FROM fs) WHERE rank < {k})"


_KEPT = "kept AS (SELECT sample_id, source, ord, chunk_id, score, kr FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, source ORDER BY route_rank) - 1 AS kr FROM routes WHERE score >= 0.05) WHERE kr < 20)"


def _fused(strategy: str) -> str:
    return f"WITH {_VEC}, {_KEPT}, {_fusion('kept', 'sample_id', strategy)} SELECT sample_id, chunk_id, rank, round(score, 6) AS score, sources FROM f"


def _totals(strategy: str) -> str:
    """Mean metrics of a fused ranking as one statement."""
    return f"""WITH {_VEC}, {_KEPT}, {_fusion('kept', 'sample_id', strategy)},
n AS (SELECT sample_id, count(*) AS n_rel FROM rel GROUP BY 1),
j AS (SELECT n.sample_id, n_rel, f.rank + 1 AS pos, rel.doc_id IS NOT NULL AS rel FROM n LEFT JOIN f USING (sample_id) LEFT JOIN rel ON rel.sample_id = f.sample_id AND rel.doc_id = f.chunk_id),
ks AS (SELECT unnest([1, 3, 5, 10])::INT AS k), a AS (SELECT *, sum(rel::INT) OVER (PARTITION BY sample_id ORDER BY pos) AS so_far FROM j),
per AS (SELECT sample_id, 'recall' AS metric, k, count(*) FILTER (rel AND pos <= k) / any_value(n_rel) AS value FROM j, ks GROUP BY sample_id, k
 UNION ALL SELECT sample_id, 'hit_rate', k, (count(*) FILTER (rel AND pos <= k) > 0)::INT::DOUBLE FROM j, ks GROUP BY sample_id, k
 UNION ALL SELECT sample_id, 'precision', k, count(*) FILTER (rel AND pos <= k) / k FROM j, ks GROUP BY sample_id, k
 UNION ALL SELECT sample_id, 'ndcg_binary', k, coalesce(sum(1 / log2(pos + 1)) FILTER (rel AND pos <= k), 0) / list_sum(list_transform(range(1, least(k, any_value(n_rel)) + 1), lambda i: 1 / log2(i + 1))) FROM j, ks GROUP BY sample_id, k
 UNION ALL SELECT sample_id, 'mrr', NULL, coalesce(1 / min(pos) FILTER (rel), 0) FROM j GROUP BY sample_id
 UNION ALL SELECT sample_id, 'map', NULL, coalesce(sum(so_far / pos) FILTER (rel), 0) / least(any_value(n_rel), count(pos)) FROM a GROUP BY sample_id)
SELECT metric, k, avg(value) AS value, count(*) AS n FROM per GROUP BY ALL"""


_GRID = f"""WITH {_VEC},
cfg AS (SELECT dk AS dense_top_k, sk AS sparse_top_k, dt AS dense_threshold, st AS sparse_threshold FROM (SELECT unnest([5, 20])::INT AS dk), (SELECT unnest([5, 20])::INT AS sk), (SELECT unnest([0.0, 0.1, 0.2])::DOUBLE AS dt), (SELECT unnest([0.0, 0.05])::DOUBLE AS st)),
c AS (SELECT *, row_number() OVER (ORDER BY dense_top_k, sparse_top_k, dense_threshold, sparse_threshold) AS id FROM cfg),
kept AS (SELECT * FROM (SELECT c.id, routes.*, row_number() OVER (PARTITION BY c.id, sample_id, source ORDER BY route_rank) - 1 AS kr, CASE WHEN source = 'dense' THEN dense_top_k ELSE sparse_top_k END AS most FROM routes, c WHERE score >= CASE WHEN source = 'dense' THEN dense_threshold ELSE sparse_threshold END) WHERE kr < most),
{_fusion('kept', 'id, sample_id', 'rrf')},
n AS (SELECT sample_id, count(*) AS n_rel FROM rel GROUP BY 1),
j AS (SELECT f.id, f.sample_id, n_rel, rank + 1 AS pos, rel.doc_id IS NOT NULL AS rel FROM f JOIN n USING (sample_id) LEFT JOIN rel ON rel.sample_id = f.sample_id AND rel.doc_id = f.chunk_id),
a AS (SELECT *, sum(rel::INT) OVER (PARTITION BY id, sample_id ORDER BY pos) AS so_far FROM j),
per AS (SELECT id, sample_id, count(*) FILTER (rel AND pos <= 10) / any_value(n_rel) AS recall, (count(*) FILTER (rel AND pos <= 10) > 0)::INT::DOUBLE AS hit, coalesce(sum(so_far / pos) FILTER (rel), 0) / least(any_value(n_rel), count(*)) AS ap, coalesce(1 / min(pos) FILTER (rel), 0) AS rr FROM a GROUP BY 1, 2),
t AS (SELECT count(*) AS n FROM q), s AS (SELECT id, sum(recall) AS recall, sum(hit) AS hit, sum(ap) AS ap, sum(rr) AS rr FROM per GROUP BY 1),
res AS (SELECT dense_top_k, sparse_top_k, dense_threshold, sparse_threshold, round(coalesce(recall, 0) / t.n, 6) AS recall, round(coalesce(hit, 0) / t.n, 6) AS hit_rate, round(coalesce(ap, 0) / t.n, 6) AS map, round(coalesce(rr, 0) / t.n, 6) AS mrr, t.n AS n FROM c LEFT JOIN s USING (id), t)
SELECT * FROM res"""

_DIAG = "dg AS (SELECT event_id, ts, event_type AS type, value AS elapsed_ms, CASE WHEN event_type = 'error' THEN [event_type] ELSE [] END AS failed, CAST(props->>'$.k' AS INT) AS n_ranked FROM events)"
_TOK = r"list_concat(regexp_extract_all(lower(text), '[a-z0-9]+'), regexp_extract_all(lower(text), '[\x{4e00}-\x{9fff}]'))"
_DAYS = "strftime(date_trunc('day', ts), '%Y-%m-%d')"
_GOLDEN = "gd AS (SELECT item_id::VARCHAR AS id, item_id FROM benchmark)"
_UUID = "sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('tolink-eval:eval-1-' || doc_id::VARCHAR || '-0'))"


def _deltas(sets: str = "WHERE true") -> str:
    """ndcg and mrr of both orders of an order's lines."""
    return f"""WITH h0 AS (SELECT l_orderkey AS sample_id, l_partkey AS doc_id, l_quantity AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber) AS rn FROM lineitem),
h AS (SELECT 'b' AS o, sample_id, doc_id, rn FROM h0 UNION ALL SELECT 'a', sample_id, doc_id, row_number() OVER (PARTITION BY sample_id ORDER BY q DESC, rn) FROM h0),
{REFS}, d AS (SELECT o, sample_id, doc_id, min(rn) AS mr FROM h GROUP BY ALL), p AS (SELECT o, sample_id, doc_id, row_number() OVER (PARTITION BY o, sample_id ORDER BY mr) AS pos FROM d),
n AS (SELECT sample_id, count(*) AS n_rel FROM r GROUP BY 1),
j AS (SELECT p.o, n.sample_id, n_rel, pos, r.doc_id IS NOT NULL AS rel FROM n JOIN p USING (sample_id) LEFT JOIN r ON r.sample_id = p.sample_id AND r.doc_id = p.doc_id),
ks AS (SELECT unnest([1, 3, 5, 10])::INT AS k),
per AS (SELECT o, sample_id, 'ndcg_binary' AS metric, k, coalesce(sum(1 / log2(pos + 1)) FILTER (rel AND pos <= k), 0) / list_sum(list_transform(range(1, least(k, any_value(n_rel)) + 1), lambda i: 1 / log2(i + 1))) AS value FROM j, ks GROUP BY o, sample_id, k
 UNION ALL SELECT o, sample_id, 'mrr', NULL, coalesce(1 / min(pos) FILTER (rel), 0) FROM j GROUP BY o, sample_id),
w AS (SELECT sample_id, metric, k, max(value) FILTER (o = 'b') AS b, max(value) FILTER (o = 'a') AS a FROM per GROUP BY ALL)
SELECT metric, k, round(avg(b), 6) AS before, round(avg(a), 6) AS after, round(avg(a - b), 6) AS delta, count(*) AS n, round(avg(a - b) FILTER (sample_id % 2 = 0), 6) AS delta_applied, count(*) FILTER (sample_id % 2 = 0) AS n_applied FROM w GROUP BY metric, k"""


ORACLES = {
    "retrieval_headline": f"""WITH {_VEC}, f AS (SELECT sample_id, printf('%05d', chunk_id) AS chunk_id, route_rank AS rank FROM dr WHERE route_rank < 10)""" + _totals("rrf").split(_fusion("kept", "sample_id", "rrf"))[1].replace("avg(value) AS value", "round(avg(value), 6) AS value"),
    "dense_topk": f"WITH {_VEC} SELECT sample_id, route_rank, chunk_id, round(score, 6) AS score FROM dr WHERE route_rank < 10",
    "sparse_dot_topk": f"WITH {_VEC} SELECT sample_id, route_rank, chunk_id, round(score, 6) AS score FROM sr WHERE route_rank < 10",
    "bm25_topk": f"""WITH c AS (SELECT doc_id AS chunk_id, {_TOK} AS t FROM documents), s AS (SELECT count(*) AS docs, avg(len(t)) AS mean FROM c),
asked AS (SELECT item_id AS sample_id, unnest(list_distinct({_TOK})) AS token FROM benchmark), e AS (SELECT chunk_id, len(t) AS length, unnest(t) AS token FROM c),
tf AS (SELECT chunk_id, token, length, count(*) AS tf FROM e WHERE token IN (SELECT token FROM asked) GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
w AS (SELECT chunk_id, token, ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)) AS part FROM tf JOIN df USING (token), s),
sc AS (SELECT sample_id, chunk_id, sum(round(part, 12)::DECIMAL(28, 12))::DOUBLE AS score FROM w JOIN asked USING (token) GROUP BY 1, 2)
SELECT sample_id, route_rank, chunk_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY round(score, 9) DESC, chunk_id) - 1 AS route_rank FROM sc) WHERE route_rank < 10""",
    "stored_bm25": f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN concat_ws(' ', text, source) ELSE text END AS text FROM documents WHERE doc_id % 7 <> 3), c AS (SELECT doc_id AS chunk_id, {_TOK} AS t FROM d WHERE text IS NOT NULL), s AS (SELECT count(*) AS docs, avg(len(t)) AS mean FROM c),
asked AS (SELECT item_id AS sample_id, unnest(list_distinct({_TOK})) AS token FROM benchmark), e AS (SELECT chunk_id, len(t) AS length, unnest(t) AS token FROM c),
tf AS (SELECT chunk_id, token, length, count(*) AS tf FROM e WHERE token IN (SELECT token FROM asked) GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
w AS (SELECT chunk_id, token, ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)) AS part FROM tf JOIN df USING (token), s),
sc AS (SELECT sample_id, chunk_id, sum(round(part, 12)::DECIMAL(28, 12))::DOUBLE AS score FROM w JOIN asked USING (token) GROUP BY 1, 2)
SELECT sample_id, route_rank, chunk_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY round(score, 9) DESC, chunk_id) - 1 AS route_rank FROM sc) WHERE route_rank < 10""",
    "route_filter": f"WITH {_VEC} SELECT sample_id, source, chunk_id, kept_rank FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, source ORDER BY route_rank) - 1 AS kept_rank FROM routes WHERE score >= 0.1) WHERE kept_rank < 10",
    "rrf_fusion": _fused("rrf"),
    "weighted_fusion": _fused("weighted_score"),
    "config_grid": _GRID,
    "grid_best": f"{_GRID} ORDER BY recall DESC, hit_rate DESC, mrr DESC, map DESC, sparse_top_k, dense_top_k, sparse_threshold DESC, dense_threshold DESC LIMIT 5",
    **{name: _line(metric) for name, metric in (("recall_at_k", "recall"), ("hit_at_k", "hit_rate"), ("precision_at_k", "precision"), ("mrr", "mrr"), ("map", "map"), ("ndcg_binary", "ndcg_binary"))},
    "ndcg_graded": f"WITH {_J} SELECT sample_id, k, round(coalesce(x.dcg, 0) / y.idcg, 6) AS value FROM (SELECT sample_id, k, sum(grade / log2(pos + 1)) FILTER (pos <= k) AS dcg FROM j, ks GROUP BY 1, 2) x JOIN (SELECT sample_id, k, sum(grade / log2(i + 1)) FILTER (i <= k) AS idcg FROM ideal, ks GROUP BY 1, 2) y USING (sample_id, k)",
    "doc_dedup_ranks": f"WITH {HITS}, d AS (SELECT sample_id, doc_id, min(rn) AS mr FROM h GROUP BY 1, 2) SELECT sample_id, doc_id, row_number() OVER (PARTITION BY sample_id ORDER BY mr) AS pos FROM d",
    "source_overlap": f"""WITH {HITS}, t AS (SELECT sample_id, count(*) AS n FROM h GROUP BY 1), o AS (SELECT DISTINCT sample_id, unnest(sources) AS s FROM h), seen AS (SELECT sample_id, list_sort(list(s)) AS every FROM o GROUP BY 1)
SELECT sample_id, 'overlap_' || s || '_only' AS metric, round(count(*) FILTER (sources = [s]) / any_value(n), 6) AS value FROM o JOIN h USING (sample_id) JOIN t USING (sample_id) GROUP BY sample_id, s
UNION ALL SELECT sample_id, 'overlap_all_sources', round(count(*) FILTER (sources = every) / any_value(n), 6) FROM h JOIN seen USING (sample_id) JOIN t USING (sample_id) WHERE len(every) > 1 GROUP BY sample_id""",
    "metric_grouping_sets": f"WITH {_BUCKETS} SELECT metric, k, type_bucket, domain_bucket, round(value, 6) AS value, n FROM g",
    "ledger_rows": f"WITH {_BUCKETS} SELECT 'run-1' AS run_id, '2024-01-01T00:00:00' AS ts, 'lines' AS dataset, 'retrieval' AS layer, metric, k, CASE WHEN metric LIKE '%\\_graded' ESCAPE '\\' THEN 'graded' ELSE 'binary' END AS relevance_scale, type_bucket, domain_bucket, round(value, 6) AS value, n, 'bge' AS sparse_provider, 10 AS top_k, 'dense,sparse' AS enabled_sources, 60 AS rrf_k FROM g",
    "k_pivot": f"WITH {_BUCKETS} SELECT metric, round(max(value) FILTER (k = 1), 6) AS k1, round(max(value) FILTER (k = 3), 6) AS k3, round(max(value) FILTER (k = 5), 6) AS k5, round(max(value) FILTER (k = 10), 6) AS k10 FROM g WHERE type_bucket = '__all__' AND domain_bucket = '__all__' AND k IS NOT NULL GROUP BY metric",
    "run_quality": f"WITH {_DIAG} SELECT type, count(*) AS samples, count(*) FILTER (len(failed) > 0) AS failed_samples, count(*) FILTER (n_ranked = 0) AS zero_ranked, count(*) FILTER (len(failed) > 0 OR n_ranked = 0) = 0 AS clean FROM dg GROUP BY type",
    "failed_source_counts": f"WITH {_DIAG} SELECT source, count(*) AS n FROM (SELECT unnest(failed) AS source FROM dg) GROUP BY 1",
    "latency_median": f"WITH {_DIAG} SELECT round(median(elapsed_ms), 6) AS median_ms FROM dg WHERE elapsed_ms <> 0",
    "nearest_rank_percentiles": f"WITH {_DIAG}, s AS (SELECT type, list_sort(list(elapsed_ms)) AS v FROM dg GROUP BY 1) SELECT type, v[round_even(0.5 * (len(v) - 1), 0)::INT + 1] AS p50, v[round_even(0.95::DOUBLE * (len(v) - 1), 0)::INT + 1] AS p95 FROM s",
    "baseline_diff": f"SELECT 'retrieval' AS layer, c.metric, c.k, round(c.value, 6) AS value, round(b.value, 6) AS baseline_value, round(c.value - b.value, 6) AS delta, c.n, c.n >= 1 AND (c.metric = 'recall' OR c.metric LIKE 'ndcg%') AND c.value - b.value < -0.02 AS is_regression FROM ({_totals('weighted_score')}) c JOIN ({_totals('rrf')}) b ON c.metric = b.metric AND c.k IS NOT DISTINCT FROM b.k",
    "comparability": """WITH s AS (SELECT lang, min(source) AS a, count(*) AS b, count(DISTINCT source) AS c, max(source) AS e FROM documents WHERE lang IN ('en', 'de') GROUP BY 1), x AS (SELECT * FROM s WHERE lang = 'en'), y AS (SELECT * FROM s WHERE lang = 'de')
SELECT unnest(list_filter([CASE WHEN x.a IS DISTINCT FROM y.a THEN 'sparse_vector_provider' END, CASE WHEN x.b IS DISTINCT FROM y.b THEN 'top_k' END, CASE WHEN x.c IS DISTINCT FROM y.c THEN 'rrf_k' END, CASE WHEN x.e IS DISTINCT FROM y.e THEN 'fusion_strategy' END], lambda v: v IS NOT NULL)) AS dimension FROM x, y""",
    "first_relevant_rank": f"WITH {_J} SELECT sample_id, (min(pos) FILTER (rel))::INT AS first_relevant_rank FROM j GROUP BY 1",
    "trend_lag": f"WITH v AS (SELECT {_DAYS} AS day, event_type AS metric, avg(value) AS value FROM events GROUP BY ALL), l AS (SELECT *, lag(value) OVER (PARTITION BY metric ORDER BY day) AS previous FROM v) SELECT day, metric, round(value, 5) AS value, round(previous, 5) AS previous, round(value - previous, 5) AS delta FROM l",
    "noise_floor": "WITH v AS (SELECT date_trunc('day', ts) AS run, event_type AS metric, avg(value) AS value FROM events GROUP BY ALL) SELECT metric, round(stddev_samp(value), 5) AS sigma, round(avg(value), 5) AS mean, count(*) AS runs FROM v GROUP BY metric",
    "bootstrap_interval": f"""WITH {_ALL}, own AS (SELECT * FROM per WHERE metric IN ('recall', 'mrr') AND (k = 10 OR k IS NULL)), u AS (SELECT metric, value, r, (('0x' || substr(md5('11:' || sample_id || ':' || r || ':' || metric), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE AS u FROM own, range(1, 51) AS t(r)),
w AS (SELECT metric, r, value, (u > 0.36787944117144233::DOUBLE)::INT + (u > 0.73575888234288467::DOUBLE)::INT + (u > 0.91969860292860584::DOUBLE)::INT + (u > 0.98101184312384626::DOUBLE)::INT + (u > 0.99634015317265637::DOUBLE)::INT + (u > 0.99940581518241839::DOUBLE)::INT AS n FROM u),
means AS (SELECT metric, r, sum(value * n) / sum(n) AS mean FROM w GROUP BY 1, 2) SELECT metric, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM means GROUP BY 1""",
    "windowed_run_quality": f"WITH {_DIAG} SELECT {_DAYS} AS day, count(*) AS samples, count(*) FILTER (len(failed) > 0) AS failed_samples, count(*) FILTER (n_ranked = 0) AS zero_ranked FROM dg GROUP BY 1",
    "model_distinctness": """WITH r AS (SELECT n_nationkey AS ord, n_name AS role, CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE r_name END AS model FROM nation JOIN region ON r_regionkey = n_regionkey)
SELECT a.role AS role_a, b.role AS role_b, a.model FROM r a JOIN r b ON a.model = b.model AND a.ord < b.ord WHERE a.model <> ''""",
    "precheck_anti": f"WITH {_GOLDEN}, e AS (SELECT id, unnest(['c' || item_id, 'c' || (item_id + 1000000)]) AS c FROM gd) SELECT id, string_agg(c, ',' ORDER BY c) AS missing, true AS doc_fallback_available FROM e WHERE c NOT IN (SELECT 'c' || doc_id FROM documents) GROUP BY id",
    "manifest_join": "SELECT l.doc_id + 990000000 AS doc_id, l.doc_id::VARCHAR AS source_id, length(text) AS chars FROM labels l JOIN documents d USING (doc_id) WHERE quality = 1 AND text <> ''",
    "golden_convert_graded": """WITH j AS (SELECT source, doc_id, 2 * quality - toxic AS grade, toxic FROM labels JOIN documents USING (doc_id)), p AS (SELECT * FROM j WHERE grade > 0),
f AS (SELECT source, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (toxic = 0) AS docs, string_agg(doc_id::VARCHAR || ':' || grade, ',' ORDER BY doc_id::VARCHAR || ':' || grade) FILTER (toxic = 0) AS grades, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id::VARCHAR) FILTER (toxic <> 0) AS dropped FROM p GROUP BY 1)
SELECT 'src-' || s.source AS id, coalesce(docs, '') AS docs, coalesce(grades, '') AS grades, coalesce(dropped, '') AS dropped, docs IS NOT NULL AS converted, docs IS NOT NULL AND dropped IS NOT NULL AS partial_missing FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN f USING (source)""",
    "chunk_ids_uuid5": f"WITH x AS (SELECT doc_id, {_UUID} AS h FROM documents) SELECT doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab89ab89ab89ab', instr('0123456789abcdef', h[17:17]), 1) || h[18:20] || '-' || h[21:32] AS chunk_id FROM x",
    "content_hash": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
    "stratified_pick": "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('7:' || doc_id), doc_id) AS turn FROM documents) ORDER BY turn, source LIMIT 100",
    "group_adjacent": """WITH t AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE length(text) > 300), i AS (SELECT *, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM t), p AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, island ORDER BY turn) - 1) // 2 AS g FROM i)
SELECT conv_id, min(turn) AS group_start, string_agg(turn::VARCHAR, ',' ORDER BY turn) AS members FROM p GROUP BY conv_id, island, g HAVING count(*) = 2""",
    "allot_types": "SELECT doc_id, CASE WHEN n <= 35 THEN 'keyword' WHEN n <= 65 THEN 'paraphrase' ELSE 'longtail' END AS type FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM documents) WHERE n <= 85",
    "sparse_vector_clean": """WITH w AS (SELECT vec_id AS chunk_id, unnest(range(64)) % 40 AS index, round(unnest(embedding)::DOUBLE, 6) AS weight FROM embeddings), m AS (SELECT chunk_id, index, max(weight) AS weight FROM w WHERE weight >= 0.05 GROUP BY 1, 2)
SELECT chunk_id, index, weight FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY weight DESC, index) AS n FROM m) WHERE n <= 12""",
    "anchor_locate": "SELECT item_id AS fact_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)",
    "gate_cascade": """WITH s AS (SELECT doc_id, CASE WHEN length(text) <= 300 THEN 'missing_text' WHEN quality <> 1 THEN 'answerability' WHEN lang <> 'fr' AND toxic <> 0 THEN 'consistency' WHEN length(text) % 2 <> 0 THEN 'retrieval_loop' END AS failed_signal FROM documents JOIN labels USING (doc_id))
SELECT doc_id, CASE WHEN failed_signal IS NULL THEN 'passed' WHEN failed_signal = 'retrieval_loop' THEN 'hard' ELSE 'dropped' END AS decision, failed_signal FROM s""",
    "spec_matrix": """WITH m AS (SELECT f.fmt, f.b, l.n, concat_ws('-', concat_ws('x', f.fmt, f.b), s.s, l.l, c.c) AS key FROM (VALUES ('md', NULL), ('html', NULL), ('docx', NULL), ('pdf', 'mineru'), ('pdf', 'opendataloader'), ('pdf', 'naive')) f(fmt, b), (VALUES ('short', 3), ('medium', 6), ('long', 10)) l(l, n), (VALUES ('headings'), ('tables'), ('lists')) s(s), (VALUES ('concentrated'), ('scattered'), ('cross_section')) c(c)),
k AS (SELECT *, row_number() OVER (ORDER BY key) - 1 AS nth FROM m) SELECT fmt, b AS pdf_backend, count(*) AS n, sum(n)::BIGINT AS facts FROM documents JOIN k ON nth = doc_id % (SELECT count(*) FROM m) GROUP BY ALL""",
    "rerank_delta": _deltas(),
    "pooled_recall": f"""WITH {HITS}, r0 AS (SELECT DISTINCT l_orderkey AS sample_id, l_partkey AS doc_id FROM lineitem WHERE l_quantity >= 40), r AS (SELECT * FROM r0 UNION SELECT h.sample_id, h.doc_id FROM h JOIN lineitem l ON l.l_orderkey = h.sample_id AND l.l_partkey = h.doc_id WHERE h.rn <= 10 AND l.l_discount > 0.07 AND h.sample_id IN (SELECT sample_id FROM r0)),
{_ranked()} SELECT n.sample_id, round(count(r.doc_id) FILTER (pos <= 10) / any_value(n_rel), 6) AS value FROM n LEFT JOIN p USING (sample_id) LEFT JOIN r ON r.sample_id = p.sample_id AND r.doc_id = p.doc_id GROUP BY n.sample_id""",
    "degraded_order": f"WITH {HITS} SELECT sample_id, doc_id::VARCHAR AS chunk_id, rank FROM (SELECT sample_id, doc_id, row_number() OVER (PARTITION BY sample_id ORDER BY rn) - 1 AS rank FROM h WHERE doc_id IN (SELECT p_partkey FROM part WHERE p_size > 10 AND p_name IS NOT NULL)) WHERE rank < 3",
    "abstention": "SELECT round(avg((length(text) % 5 = 0)::INT), 6) AS abstention_rate, count(*) AS n FROM conversations WHERE role = 'assistant'",
}

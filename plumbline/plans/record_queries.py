"""Queries of what works on records: responses, attempts, golden sets, facts, stores, index tables, answers of models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import columns, text
from plumbline.operators import aggregate, fusion, golden, metrics, rerank, retrieve, vectors
from plumbline.plans import fixtures as fx
from plumbline.plans import report
from plumbline.sources import readers, schemas, store


def _line_number(spark: SparkSession, d: str) -> DataFrame:
    """Lines with their place by number, since numbers may repeat."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return fx.table(spark, d, "lineitem").withColumn("at", F.row_number().over(order))


def default_metrics(spark, d):
    """All registered metrics of the retrieval layer."""
    found = metrics.compute(fx.line_hits(spark, d), fx.line_golden(spark, d))
    return found.select("sample_id", "metric", "k", F.round("value", 6).alias("value"))


def response_hits(spark, d):
    """Orders as recall responses whose hits come in order of line, scored by one route or two."""
    scores = F.create_map(F.lit("dense"), F.when(F.col("l_returnflag") != "R", F.col("l_tax")), F.lit("sparse"), F.when(F.col("l_linestatus") == "O", F.col("l_discount")))
    hit = F.struct("at", F.col("l_partkey").cast("string").alias("chunk_id"), F.col("l_partkey").alias("doc_id"), F.lit(1).cast("long").alias("dataset_id"), F.col("l_discount").alias("fused_score"), scores.alias("scores"))
    responses = _line_number(spark, d).groupBy(F.col("l_orderkey").alias("sample_id")).agg(F.transform(F.array_sort(F.collect_list(hit), lambda a, b: a["at"] - b["at"]), lambda h: h.dropFields("at")).alias("hits"))
    return fusion.adapt_response(responses).select("sample_id", "chunk_id", "rank", "score", F.array_join("sources", "+").alias("sources"))


def chosen_attempts(spark, d):
    """Lines as attempts of an order: returned ones failed, those under five found nothing."""
    attempts = _line_number(spark, d).select(
        F.col("l_orderkey").alias("sample_id"), F.col("at").alias("attempt"), F.when(F.col("l_returnflag") == "R", F.array(F.lit("dense"))).otherwise(F.array().cast("array<string>")).alias("failed_sources"),
        F.when(F.col("l_quantity") >= 5, F.col("l_quantity")).otherwise(0).cast("int").alias("n_hits"),
    )
    return fusion.pick_attempts(attempts).select("sample_id", "attempt", F.size("failed_sources").alias("failed"), "n_hits")


def source_counts(spark, d):
    kept = fusion.filter_routes(fx.route_hits(spark, d), F.lit(20), F.lit(0.05))
    return fusion.source_counts(kept).select("sample_id", F.explode("per_source_counts").alias("source", "n"))


def bm25_fields(spark, d):
    """Coarse and fine tokens as two fields, coarse matches counting twice."""
    asked = fx.table(spark, d, "benchmark").select(F.col("item_id").alias("sample_id"), "text")
    turns = fx.table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), "text")
    return retrieve.bm25(asked, turns, 5, fields=retrieve.COARSE_AND_FINE).select("sample_id", "route_rank", "chunk_id", F.round("score", 6).alias("score"))


def numbered_passages(spark, d):
    """Documents numbered in the order of their ids as text."""
    passages = fx.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source_id"))
    return golden.number_passages(passages, 990000000).select("source_id", "doc_id", "status")


def eligible_chunks(spark, d):
    chunks = fx.table(spark, d, "documents").select("doc_id", F.pmod("doc_id", F.lit(7)).alias("dataset_id"), F.concat(F.lit("  "), F.substring("text", 1, 300), F.lit(" ")).alias("content"))
    return golden.eligible_chunks(chunks, [1, 3, 5], 200).select("doc_id", "dataset_id")


def generated_samples(spark, d):
    """Answers of a model: fenced, with text around them, unanswerable, without a question, or no JSON at all."""
    n = F.col("c_custkey").cast("string")
    answer = (
        F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit('```json\n{"answerable": true, "query": "q'), n, F.lit('", "answer": "a", "used_chunk_ids": ["c1", "other"]}\n```')))
        .when(F.col("c_custkey") % 5 == 1, F.concat(F.lit('Here: {"query": "q'), n, F.lit('", "answer": "b {", "used_chunk_ids": []} done')))
        .when(F.col("c_custkey") % 5 == 2, '{"answerable": false}').when(F.col("c_custkey") % 5 == 3, '{"query": "  ", "answer": "c"}').otherwise("no object here")
    )
    answers = fx.table(spark, d, "customer").select("c_custkey", F.array(F.lit("c1"), F.lit("c2")).alias("chunk_ids"), answer.alias("answer"))
    return golden.generated_samples(answers).select("c_custkey", "query", "golden_answer", F.array_join("used_chunk_ids", ",").alias("used"), "dropped")


def distinct_facts(spark, d):
    """Facts of an order whose anchors are runs of one letter: each longer one holds the shortest."""
    facts = _line_number(spark, d).select(F.col("l_orderkey").alias("doc_id"), F.col("at").alias("fact_id"), F.repeat(F.lit("x"), F.col("l_quantity").cast("int")).alias("anchor"))
    return golden.distinct_facts(facts).select("doc_id", "fact_id", F.length("anchor").alias("chars"))


def missing_anchors(spark, d):
    """The first words of every document, sought in the text without its first characters for one in three."""
    docs = fx.table(spark, d, "documents")
    facts = docs.select("doc_id", F.col("doc_id").alias("fact_id"), F.substring("text", 1, 20).alias("anchor"))
    return golden.missing_anchors(facts, docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.substring("text", 3, 1 << 30)).otherwise(F.col("text")).alias("text")))


def leaked_anchors(spark, d):
    """Benchmark items as anchors, and the middle of them, or of the next one, as queries."""
    items = fx.table(spark, d, "benchmark")
    following = items.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    query = F.when(F.col("item_id") % 2 == 0, F.substring("text", 20, 9)).otherwise(F.substring("other", 20, 30))
    pairs = items.join(following, "item_id").select("item_id", query.alias("query"), F.col("text").alias("anchor"))
    return golden.leaked_anchors(pairs, compose=False).select("item_id", "leaked")


def _anchored(spark, d) -> tuple[DataFrame, DataFrame]:
    """(facts, chunks): benchmark items as chunks of ten documents; anchors as they are, in capitals, or unlike all."""
    items = fx.table(spark, d, "benchmark").withColumn("doc_id", F.col("item_id") % 10)
    said = F.substring("text", 5, 30)
    anchor = F.when(F.col("item_id") % 3 == 0, said).when(F.col("item_id") % 3 == 1, F.concat(F.lit("* "), F.translate(said, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))).otherwise("0123456789" * 3)
    return items.select(F.concat(F.lit("f"), "item_id").alias("fact_id"), "doc_id", anchor.alias("anchor")), items.select("doc_id", F.concat(F.lit("c"), "item_id").alias("chunk_id"), F.col("text").alias("content"))


def located_facts(spark, d):
    return golden.locate(*_anchored(spark, d)).select("fact_id", F.array_join("chunk_ids", ",").alias("chunk_ids"), "tier")


def miss_rates(spark, d):
    facts, chunks = _anchored(spark, d)
    found = golden.miss_rates(golden.locate(facts, chunks).join(facts, "fact_id"), "doc_id")
    return found.withColumn("miss_rate", F.round("miss_rate", 6))


def relocated_samples(spark, d):
    """Samples of facts, with the chunks that hold them now; what is lost is told by an empty list."""
    facts, chunks = _anchored(spark, d)
    moved, lost = golden.relocate(facts.select(F.concat(F.lit("s-"), "fact_id").alias("id"), "fact_id"), facts, chunks)
    return moved.select("id", F.array_join("expected_chunk_ids", ",").alias("chunks")).unionByName(lost.select("id", F.lit("").alias("chunks")))


def golden_lines(spark, d):
    """Golden samples as JSON lines and back."""
    samples = fx.line_golden(spark, d, graded=True).select(
        F.concat(F.lit("s"), "sample_id").alias("id"), F.lit('a "query"\n').alias("query"), F.lit(1).cast("long").alias("user_id"), F.array(F.lit(1).cast("long")).alias("dataset_ids"), "expected_chunk_ids", "expected_doc_ids", "relevance_grades",
        F.lit(None).cast("string").alias("golden_answer"), F.lit("keyword").alias("type"), F.lit(None).cast("string").alias("note"),
    )
    back = readers.from_json_lines(readers.json_lines(samples), schemas.GOLDEN)
    return back.select("id", "query", F.array_join("expected_doc_ids", ",").alias("docs"), F.aggregate(F.map_values("relevance_grades"), F.lit(0), lambda s, x: s + x).alias("grades"), F.col("note").isNull().alias("no_note"))


def chunk_status(spark, d):
    corpus = fx.table(spark, d, "documents").select(F.concat(F.lit("c"), "doc_id").alias("chunk_id"))
    asked = fx.table(spark, d, "labels").select(F.concat(F.lit("c"), F.col("doc_id") * 2).alias("chunk_id"))
    return readers.chunk_status(corpus, asked)


def merged_rows(spark, d):
    """Nations by key, every third replaced and some added, columns added by the new ones."""
    old = fx.table(spark, d, "nation").select("n_nationkey", "n_name")
    new = old.where("n_nationkey % 3 = 0").select((F.col("n_nationkey") * 2).alias("n_nationkey"), F.lower("n_name").alias("n_name"), F.lit(True).alias("fresh"))
    return store.merged(old.withColumn("fresh", F.lit(False)), new, "n_nationkey")


def index_rows(spark, d):
    """Index tables of embeddings: all rows have a dense point, those with weights a sparse one."""
    rows = fx.table(spark, d, "embeddings")
    weights = vectors.packed(fx.dimensions(rows.where("vec_id % 4 <> 0").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector")), "chunk_id"))
    none = F.array()
    passages = rows.select(F.col("vec_id").alias("chunk_id"), F.lit(1).cast("long").alias("user_id"), F.lit(2).cast("long").alias("dataset_id"), F.col("label").alias("doc_id"), F.col("embedding").alias("vector")).join(weights, "chunk_id", "left")
    passages = passages.withColumns({"indices": F.coalesce("indices", none.cast("array<int>")), "values": F.coalesce("values", none.cast("array<double>")), "bm25_indices": none.cast("array<int>"), "bm25_values": none.cast("array<double>")})
    tables = vectors.index_tables(passages)
    told = lambda name, size: tables[name].select(F.lit(name).alias("index"), "chunk_id", "set_id", "doc_id", size.alias("dimensions"))
    return told("dense", F.size("vector")).unionByName(told("sparse", F.size("indices"))).unionByName(told("bm25", F.size("indices")))


def kept_points(spark, d):
    """What an index keeps when every third chunk's points are deleted."""
    index = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label")
    return vectors.without_points(index, index.where("chunk_id % 3 = 0").select("chunk_id"))


def scaled_vectors(spark, d):
    rows = fx.table(spark, d, "embeddings").select("vec_id", vectors.scaled(F.transform("embedding", lambda x: 3 * x)).alias("v"))
    return rows.select("vec_id", F.round(vectors.dot(F.col("v"), F.col("v")), 6).alias("norm"))


def user_buckets(spark, d):
    return fx.table(spark, d, "customer").select("c_custkey", columns.bucket(F.col("c_custkey")).alias("bucket"))


def judged_scores(spark, d):
    """Lines as a judge's scores of three metrics; some samples have no golden answer."""
    name = F.element_at(F.array(F.lit("faithfulness"), F.lit("context_recall"), F.lit("answer_correctness")), F.pmod(F.col("l_linenumber"), F.lit(3)) + 1)
    scores = fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sample_id"), name.alias("metric"), F.col("l_discount").alias("score"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag") == "A").alias("has_golden_answer"))
    return rerank.judged(scores).withColumn("value", F.round("value", 6))


def rerank_applied_rate(spark, d):
    diagnostics = fx.table(spark, d, "lineitem").select(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag") == "R").alias("rerank_applied"))
    found = rerank.applied_rate(diagnostics)
    return found.withColumn("rerank_applied_rate", F.round("rerank_applied_rate", 6))


def rerank_top_n(spark, d):
    """Deltas of a reranker that returns four, by quantity: no k beyond that."""
    hits = fx.line_hits(spark, d)
    again = Window.partitionBy("sample_id").orderBy(F.desc("quantity"), "rank")
    both = hits.withColumn("ordering", F.lit("rrf")).unionByName(hits.withColumn("rank", F.row_number().over(again) - 1).withColumn("ordering", F.lit("rerank")))
    return rerank.order_deltas(both, fx.line_golden(spark, d), top_n=4).select("metric", "k", F.round("delta", 6).alias("delta"), "n")


def rounded_means(spark, d):
    """Means to four places, and which groups are small for a report."""
    rows = fx.table(spark, d, "lineitem").groupBy("l_suppkey").agg(aggregate.mean4(F.col("l_quantity")).alias("mean"), F.count(F.lit(1)).alias("n"))
    return rows.select("l_suppkey", "mean", aggregate.small(F.col("n")).alias("small"))


def report_cells(spark, d):
    """Numbers as a report shows them: changes with their sign, flat ones as such, and what is missing."""
    change = (F.col("l_discount") - 0.05) * F.when(F.col("l_linenumber") == 1, 0.001).otherwise(1)
    return fx.table(spark, d, "lineitem").select(columns.signed_delta(change).alias("delta"), columns.fixed(F.when(F.col("l_returnflag") != "R", F.col("l_tax"))).alias("tax")).groupBy("delta", "tax").agg(F.count(F.lit(1)).alias("n"))


def headline_cards(spark, d):
    """The headline of a run: recall and ndcg at their greatest k, and mrr."""
    per = metrics.sample_metrics(fx.line_hits(spark, d), fx.line_golden(spark, d))
    totals = per.groupBy("metric", "k").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n"))
    return report.headline(totals).select("metric", "k", F.round("value", 6).alias("value"), "n")


def parsed_objects(spark, d):
    """The first JSON object of event properties with text around them, in fences, or cut off."""
    props = F.col("props")
    said = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("```json\n"), props, F.lit("\n```"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit("so: "), props, F.lit(" {")))
    said = said.when(F.col("event_id") % 4 == 2, F.expr("left(props, length(props) - 1)")).otherwise("none")
    found = fx.table(spark, d, "events").select("event_id", text.first_json_object(said).alias("o"))
    return found.select("event_id", F.get_json_object("o", "$.k").cast("int").alias("k"), F.col("o").isNull().alias("failed"))


QUERIES = {f.__name__: f for f in (
    default_metrics, response_hits, chosen_attempts, source_counts, bm25_fields, numbered_passages, eligible_chunks, generated_samples, distinct_facts, missing_anchors, leaked_anchors, located_facts, miss_rates, relocated_samples,
    golden_lines, chunk_status, merged_rows, index_rows, kept_points, scaled_vectors, user_buckets, judged_scores, rerank_applied_rate, rerank_top_n, rounded_means, report_cells, headline_cards, parsed_objects,
)}

_AT = "a AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS nth FROM lineitem)"
#: Fixed value: what normalising deletes.
_DELETED = r"[\s　，。、；：？！“”‘’（）【】《》〈〉,.;:?!\"''()\[\]{}<>—\-_*`#>|\x0b]+"
_TOKENS = r"list_concat(regexp_extract_all(lower(text), '[a-z0-9]+'), regexp_extract_all(lower(text), '[\x{4e00}-\x{9fff}]'))"


def _plain(value: str) -> str:
    return f"regexp_replace(lower({value}), '{_DELETED}', '', 'g')"


_FACTS = f"""f AS (SELECT item_id, item_id % 10 AS doc_id, substr(text, 5, 30) AS said, CASE item_id % 3 WHEN 0 THEN substr(text, 5, 30) WHEN 1 THEN '* ' || translate(substr(text, 5, 30), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE repeat('0123456789', 3) END AS anchor FROM benchmark),
m AS (SELECT f.item_id, f.doc_id, b.item_id AS c, CASE WHEN contains(b.text, anchor) THEN 0 WHEN contains({_plain('b.text')}, {_plain('anchor')}) THEN 1 END AS t FROM f JOIN benchmark b ON b.item_id % 10 = f.doc_id),
best AS (SELECT item_id, doc_id, min(t) AS t FROM m GROUP BY 1, 2), l AS (SELECT best.item_id, best.doc_id, best.t, string_agg('c' || c, ',' ORDER BY 'c' || c) FILTER (m.t = best.t) AS chunks FROM best JOIN m USING (item_id) GROUP BY 1, 2, 3)"""


def _oracles() -> dict[str, str]:
    from plumbline.plans.oracles import _ALL, _KEPT, _VEC, HITS, ORACLES

    overlap = ORACLES["source_overlap"].replace(f"WITH {HITS}, ", "").split("\nSELECT", 1)
    term = lambda tf, length, mean: f"{tf} * 2.2 / ({tf} + 1.2 * (0.25 + 0.75 * {length} / {mean}))"
    return {
        "default_metrics": f"WITH {_ALL}, {overlap[0]} SELECT sample_id, metric, k, round(value, 6) AS value FROM per UNION ALL SELECT sample_id, metric, NULL, value FROM (SELECT{overlap[1]})",
        "response_hits": f"WITH {_AT} SELECT l_orderkey AS sample_id, l_partkey::VARCHAR AS chunk_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, nth) - 1 AS rank, l_discount AS score, concat_ws('+', CASE WHEN l_returnflag <> 'R' THEN 'dense' END, CASE WHEN l_linestatus = 'O' THEN 'sparse' END) AS sources FROM a",
        "chosen_attempts": f"""WITH {_AT}, c AS (SELECT l_orderkey AS sample_id, nth AS attempt, (l_returnflag = 'R')::INT AS failed, CASE WHEN l_quantity >= 5 THEN l_quantity ELSE 0 END::INT AS n_hits FROM a),
w AS (SELECT sample_id, coalesce(min(attempt) FILTER (failed = 0 AND n_hits > 0), max(attempt)) AS attempt FROM c GROUP BY 1) SELECT c.* FROM c JOIN w USING (sample_id, attempt)""",
        "source_counts": f"WITH {_VEC}, {_KEPT} SELECT sample_id, source, count(*) AS n FROM kept GROUP BY 1, 2",
        "bm25_fields": f"""WITH c AS (SELECT conv_id * 1000 + turn AS chunk_id, {_TOKENS} AS t FROM conversations), s AS (SELECT count(*) AS docs FROM c), asked AS (SELECT item_id AS sample_id, unnest(list_distinct({_TOKENS})) AS token FROM benchmark),
e AS (SELECT chunk_id, len(t) AS length, unnest(t) AS token FROM c), tf AS (SELECT chunk_id, token, length, count(*) AS tf FROM e GROUP BY ALL), df AS (SELECT token, count(DISTINCT chunk_id) AS df FROM e GROUP BY 1),
w AS (SELECT chunk_id, token, ln(1 + (docs - df + 0.5) / (df + 0.5)) AS idf, 2 * {term('tf', 'length', '200')} AS coarse, {term('tf', 'length', '220')} AS fine FROM tf JOIN df USING (token), s),
sc AS (SELECT sample_id, chunk_id, sum(round(idf * coarse, 12)::DECIMAL(28, 12) + round(idf * fine, 12)::DECIMAL(28, 12))::DOUBLE AS score FROM w JOIN asked USING (token) GROUP BY 1, 2)
SELECT sample_id, route_rank, chunk_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY round(score, 9) DESC, chunk_id) - 1 AS route_rank FROM sc) WHERE route_rank < 5""",
        "numbered_passages": "SELECT doc_id::VARCHAR AS source_id, 990000000 + row_number() OVER (ORDER BY doc_id::VARCHAR) - 1 AS doc_id, 'success' AS status FROM documents",
        "eligible_chunks": "SELECT doc_id, doc_id % 7 AS dataset_id FROM documents WHERE doc_id % 7 IN (1, 3, 5) AND length(trim('  ' || coalesce(left(text, 300), '') || ' ')) >= 200",
        "generated_samples": """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'q' || c_custkey WHEN 1 THEN 'q' || c_custkey WHEN 3 THEN '  ' END AS query, CASE c_custkey % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'b {' WHEN 3 THEN 'c' END AS golden_answer,
 CASE WHEN c_custkey % 5 = 0 THEN 'c1' ELSE 'c1,c2' END AS used, CASE c_custkey % 5 WHEN 2 THEN 'unanswerable' WHEN 3 THEN 'invalid' WHEN 4 THEN 'unparsed' END AS dropped FROM customer""",
        "distinct_facts": f"WITH {_AT} SELECT l_orderkey AS doc_id, arg_min(nth, [l_quantity, nth]) AS fact_id, min(l_quantity)::INT AS chars FROM a GROUP BY 1",
        "missing_anchors": "SELECT doc_id, doc_id AS fact_id FROM documents WHERE NOT contains(CASE WHEN doc_id % 3 = 0 THEN substr(text, 3) ELSE text END, left(text, 20))",
        "leaked_anchors": f"""WITH p AS (SELECT a.item_id, {_plain("CASE WHEN a.item_id % 2 = 0 THEN substr(a.text, 20, 9) ELSE substr(b.text, 20, 30) END")} AS q, {_plain('a.text')} AS x FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1)
SELECT item_id, len(list_filter(range(1, length(q) - 4), lambda i: contains(x, substr(q, i, 6)))) > 0 AS leaked FROM p""",
        "located_facts": f"WITH {_FACTS} SELECT 'f' || item_id AS fact_id, coalesce(chunks, '') AS chunk_ids, CASE t WHEN 0 THEN 'exact' WHEN 1 THEN 'normalized' ELSE 'miss' END AS tier FROM l",
        "miss_rates": f"WITH {_FACTS} SELECT doc_id, count(*) AS facts, count(*) FILTER (t IS NULL) AS misses, round(count(*) FILTER (t IS NULL) / count(*), 6) AS miss_rate FROM l GROUP BY 1",
        "relocated_samples": f"WITH {_FACTS} SELECT 's-f' || item_id AS id, coalesce(chunks, '') AS chunks FROM l",
        "golden_lines": """WITH r AS (SELECT l_orderkey, l_partkey, floor(max(l_quantity) / 10)::INT - 3 AS grade FROM lineitem WHERE l_quantity >= 40 GROUP BY 1, 2)
SELECT 's' || l_orderkey AS id, 'a "query"' || chr(10) AS query, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey) AS docs, sum(grade)::INT AS grades, true AS no_note FROM r GROUP BY l_orderkey""",
        "chunk_status": "SELECT DISTINCT 'c' || l.doc_id * 2 AS chunk_id, 'ACTIVE' AS status FROM labels l JOIN documents d ON d.doc_id = l.doc_id * 2",
        "merged_rows": "SELECT n_nationkey * 2 AS n_nationkey, lower(n_name) AS n_name, true AS fresh FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT n_nationkey, n_name, false FROM nation WHERE n_nationkey NOT IN (SELECT n_nationkey * 2 FROM nation WHERE n_nationkey % 3 = 0)",
        "index_rows": """WITH w AS (SELECT vec_id, len(list_filter(embedding, lambda x: x::DOUBLE > 0.1)) AS n FROM embeddings) SELECT 'dense' AS index, vec_id AS chunk_id, 2::BIGINT AS set_id, label AS doc_id, len(embedding) AS dimensions FROM embeddings
UNION ALL SELECT 'sparse', vec_id, 2, label, n FROM embeddings JOIN w USING (vec_id) WHERE vec_id % 4 <> 0 AND n > 0""",
        "kept_points": "SELECT vec_id AS chunk_id, label FROM embeddings WHERE vec_id % 3 <> 0",
        "scaled_vectors": "SELECT vec_id, CASE WHEN list_sum(list_transform(embedding, lambda x: x * x)) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm FROM embeddings",
        "user_buckets": """SELECT c_custkey, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c_custkey::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
 lambda acc, b: list_reduce(list_prepend(xor(acc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))), 4294967295::BIGINT) % 16 AS bucket FROM customer""",
        "judged_scores": """WITH s AS (SELECT ['faithfulness', 'context_recall', 'answer_correctness'][l_linenumber % 3 + 1] AS metric, l_discount AS score, l_returnflag = 'A' AS has FROM lineitem), t AS (SELECT *, metric <> 'faithfulness' AND NOT has AS skip FROM s)
SELECT metric, round(avg(score) FILTER (NOT skip), 6) AS value, count(*) FILTER (NOT skip) AS n, count(*) FILTER (skip) AS skipped FROM t GROUP BY 1""",
        "rerank_applied_rate": "SELECT round(avg((l_returnflag = 'R')::INT), 6) AS rerank_applied_rate, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N'",
        "rerank_top_n": f"WITH x AS ({ORACLES['rerank_delta']}) SELECT metric, k, delta, n FROM x WHERE coalesce(k, 0) <= 4",
        "rounded_means": "SELECT l_suppkey, round_even(avg(l_quantity), 4)::DOUBLE AS mean, count(*) < 15 AS small FROM lineitem GROUP BY 1",
        "report_cells": """WITH c AS (SELECT (l_discount - 0.05::DOUBLE) * CASE WHEN l_linenumber = 1 THEN 0.001::DOUBLE ELSE 1 END AS c, CASE WHEN l_returnflag <> 'R' THEN l_tax END AS t FROM lineitem)
SELECT CASE WHEN abs(c) < 0.0005 THEN '±0.000' ELSE printf('%+.3f', c) END AS delta, CASE WHEN t IS NULL THEN '-' ELSE printf('%.3f', t) END AS tax, count(*) AS n FROM c GROUP BY 1, 2""",
        "headline_cards": f"WITH {_ALL}, t AS (SELECT metric, k, round(avg(value), 6) AS value, count(*) AS n FROM per GROUP BY 1, 2) SELECT * FROM t WHERE (metric IN ('recall', 'ndcg_binary') AND k = 10) OR metric = 'mrr'",
        "parsed_objects": "SELECT event_id, CASE WHEN event_id % 4 < 2 THEN (props->>'$.k')::INT END AS k, event_id % 4 >= 2 AS failed FROM events",
    }


ORACLES = _oracles()

"""Queries of the cleaning scores over Markdown that is made of orders and their lines, whose scores plain SQL can count.

A line of an order is a block of its own letter, so that two blocks are alike only if they are the same line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import alignment, text
from plumbline.operators import markdown
from plumbline.plans import fixtures as fx


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """(sample_id, lines): an order's lines in order of price, each with its letter, flag, quantity and part."""
    flags = fx.dealt(fx.table(spark, d, "lineitem"), "l_orderkey")
    order = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_partkey", "l_suppkey", "l_linenumber")
    line = F.struct((F.row_number().over(order) - 1).alias("rank"), F.col("l_quantity").cast("int").alias("quantity"), F.col("l_returnflag").alias("flag"), F.col("l_partkey").alias("part"))
    # Grouped by the window's own column, before it is renamed: lines are shuffled once.
    ranked = flags.select("l_orderkey", line.alias("line")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    return ranked.select(F.col("l_orderkey").alias("sample_id"), "lines")


def _told(lines: str | Column, block: Callable[[Column], Column], end: str = "\n\n") -> Column:
    return F.concat(F.array_join(F.transform(lines, block), end), F.lit(end))


def _letters(line: Column) -> Column:
    return F.repeat(F.char(line["rank"] + 97), F.lit(12))


def _scored(spark, d, part: str, ref: Column, made: Column) -> DataFrame:
    found = markdown.part_scores(_lines(spark, d).select("sample_id", ref.alias("ref"), made.alias("produced")), part)
    return found.withColumn("sample_id", F.col("sample_id").cast("long"))


def heading_scores(spark, d):
    """Produced: without headings of 45 or more, returned lines a level deeper, a heading too many in every fifth order."""
    heading = lambda deeper: lambda x: F.concat(F.repeat(F.lit("#"), 1 + x["rank"] % 3 + (F.when(x["flag"] == "R", 1).otherwise(0) if deeper else 0)), F.lit(" "), _letters(x))
    extra = F.when(F.col("sample_id") % 5 == 0, "# zzzzzzzzzzzz\n").otherwise("")
    found = _scored(spark, d, "heading", _told("lines", heading(False)), F.concat(_told(F.filter("lines", lambda x: x["quantity"] < 45), heading(True)), extra))
    return found.withColumn("missed", F.array_join("missed", ","))


def table_scores(spark, d):
    """Tables of lines, returned ones with another quantity; produced as a table, as JSON or as an image."""
    names = ("line", "part", "quantity")
    cells = lambda x, other: (x["rank"].cast("string"), x["part"].cast("string"), F.when(F.lit(other) & (x["flag"] == "R"), "x").otherwise(x["quantity"].cast("string")))
    bars = lambda other: F.concat(F.lit("Lines\n\n| line | part | quantity |\n|---|:--|--:|\n"), _told("lines", lambda x: F.concat(F.lit("| "), F.concat_ws(" | ", *cells(x, other)), F.lit(" |")), "\n"))
    objects = F.concat(F.lit("Lines\n\n```json\n["), F.array_join(F.transform("lines", lambda x: F.to_json(F.struct(*[c.alias(n) for n, c in zip(names, cells(x, True), strict=True)]))), ", "), F.lit("]\n```\n"))
    kind = F.col("sample_id") % 4
    found = _scored(spark, d, "table", bars(False), F.when(kind < 2, bars(True)).when(kind == 2, objects).otherwise("Lines\n\n![t](t.png)\n"))
    return found.drop("image_completeness")


def image_scores(spark, d):
    """An image after every line; produced: other text where a line was returned, without the last image in even orders."""
    said = lambda other: lambda x: F.concat(F.when(F.lit(other) & (x["flag"] == "R"), "999999999999").otherwise(_letters(x)), F.lit("\n\n"), F.concat(F.lit("![img "), x["rank"].cast("string"), F.lit("](p.png)")))
    end = F.lit("zzzzzzzzzzzz\n")
    last = F.when(F.col("sample_id") % 2 == 0, F.concat(F.lit("![img "), F.size("lines") - 1, F.lit("](p.png)\n\n"))).otherwise("")
    made = F.replace(_told("lines", said(True)), last, F.lit(""))
    found = _scored(spark, d, "image", F.concat(_told("lines", said(False)), end), F.concat(F.when(last == "", _told("lines", said(True))).otherwise(made), end))
    return found.withColumn("misplaced", F.array_join("misplaced", ","))


def list_fidelity(spark, d):
    """Items two levels deep; produced: those under 30."""
    item = lambda x: F.concat(F.repeat(F.lit("  "), x["rank"] % 2), F.lit("- "), _letters(x))
    return _scored(spark, d, "list", _told("lines", item, "\n"), _told(F.filter("lines", lambda x: x["quantity"] < 30), item, "\n"))


def order_inversions(spark, d):
    """Lines of an order by price as paragraphs, produced in the order of their quantity."""
    by_quantity = F.array_sort(F.transform("lines", lambda x: F.struct(x["quantity"].alias("quantity"), x["rank"].alias("rank"))))
    return _scored(spark, d, "order", _told("lines", _letters), _told(by_quantity, _letters))


def aligned_blocks(spark, d):
    """Lines by price against the same lines by quantity, each two runs of letters: the ratio of two is in their runs, often near 0.6 or tied."""
    runs = lambda a, b: F.concat(F.repeat(F.lit("a"), a.cast("int")), F.repeat(F.lit("b"), b.cast("int")))
    by_quantity = F.array_sort(F.transform("lines", lambda x: F.struct((x["quantity"] % 10).alias("last"), x["rank"].alias("rank"), x["quantity"].alias("quantity"))))
    ref, made = F.transform("lines", lambda x: runs(x["quantity"], x["rank"] * 4 + 1)), F.transform(by_quantity, lambda x: runs(x["quantity"] % 20 + 5, x["quantity"] % 7 * 3 + 1))
    pairs = _lines(spark, d).select("sample_id", F.explode(alignment.aligned(ref, made, markdown.SAME)).alias("p"))
    return pairs.select("sample_id", "p.i", "p.j")


def token_multiset_scores(spark, d):
    """Documents, each as one paragraph, against the next of their source: tokens kept, and tokens added."""
    flat = F.concat(F.lit("x "), F.regexp_replace(F.coalesce("text", F.lit("")), r"[\s\x0b\x1c-\x1f\x85  ]+", " "))
    docs = fx.table(spark, d, "documents")
    after = F.lead("doc_id").over(Window.partitionBy("source").orderBy("doc_id"))
    pairs = docs.select("doc_id", after.alias("next_id")).where("next_id is not null")
    texts = docs.select("doc_id", flat.alias("said"))
    both = pairs.join(texts.withColumnRenamed("said", "ref"), "doc_id").join(texts.select(F.col("doc_id").alias("next_id"), F.col("said").alias("produced")), "next_id")
    found = markdown.part_scores(both.withColumnRenamed("doc_id", "sample_id"), "text")
    return found.select(F.col("sample_id").cast("long").alias("doc_id"), "completeness", "noise")


def stability_pairs(spark, d):
    """Turns of a conversation, cut to two characters, as repeated runs."""
    turns = fx.table(spark, d, "conversations").groupBy(F.col("conv_id").alias("sample_id")).agg(F.collect_list(F.substring("text", 1, 2)).alias("repeats"))
    return markdown.stability_scores(turns).select(F.col("sample_id").cast("long").alias("conv_id"), "stability")


def pair_scores(spark, d):
    """All scores of a document: a heading and a list item for every line; produced: without headings of 45 or more."""
    head, item = lambda x: F.concat(F.lit("# "), _letters(x)), lambda x: F.concat(F.lit("- "), _letters(x), F.repeat(F.lit("z"), F.lit(24)))
    items = _told("lines", item, "\n")
    ref, made = F.concat(_told("lines", head), items), F.concat(_told(F.filter("lines", lambda x: x["quantity"] < 45), head), items)
    pairs = _lines(spark, d).select("sample_id", F.lit("md").alias("fmt"), F.lit(None).cast("string").alias("pdf_backend"), ref.alias("ref"), made.alias("produced"), F.lit(True).alias("ok"), F.array(made, F.lit(None), ref).alias("repeats"), F.size("lines").cast("long").alias("clean_ms"))
    found = markdown.score_pairs(pairs)
    return found.select(F.col("sample_id").cast("long").alias("sample_id"), "ok", "clean_ms", "completeness", "noise", F.col("heading.recall").alias("heading_recall"), F.col("image.recall").alias("image_recall"), F.col("table.n_md").alias("n_md"), "list_fidelity", "order_fidelity", "stability")


def parsed_kinds(spark, d):
    """Blocks of every kind, those that a mark makes something else among them, by kind."""
    head = "# Head ##\n####### seven\nnext line\n\n#nothing\n> one\n> two\n```JSON\n# no\n- no\n```\n"
    row = lambda x: F.concat(F.lit("| "), x["rank"].cast("string"), F.lit(" | "), x["quantity"].cast("string"), F.lit(" |"))
    item = lambda x: F.concat(F.lit("1) "), _letters(x))
    said = F.concat(F.lit(head + "| a | b |\n|---|---|\n"), _told("lines", row, "\n"), F.lit("\n![i](p.png)\n"), _told("lines", item, "\n"), F.lit("- \n-x\n12. y\n"))
    blocks = markdown.blocks_of(_lines(spark, d).select("sample_id", said.alias("text"))).select("sample_id", F.explode("blocks").alias("b"))
    return blocks.groupBy("sample_id", F.col("b.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("b.rows") + F.size("b.items")).alias("parts"), F.sum(F.length("b.text")).alias("chars"))


def similarity_repeats(spark, d):
    """Runs of one letter: the longest matching block is the shorter run."""
    lines = fx.line_hits(spark, d)
    a, b = F.repeat(F.lit("x"), F.col("rank")), F.repeat(F.lit("x"), F.col("quantity").cast("int"))
    return lines.select("sample_id", "rank", a.alias("a"), b.alias("b")).select("sample_id", "rank", F.round(text.similarity("a", "b"), 6).alias("ratio"))


def composed_tokens(spark, d):
    """Full-width letters and digits are tokens once composed, and punctuation and spaces go when normalised."""
    plain, wide = "abcdefghijklmnopqrstuvwxyz0123456789", "".join(chr(ord(c) + 0xFEE0) for c in "abcdefghijklmnopqrstuvwxyz0123456789")
    names = fx.table(spark, d, "part").select("p_partkey", F.translate(F.lower("p_name"), plain, wide).alias("name"))
    return names.select("p_partkey", F.array_join(text.tokens(F.col("name"), compose=True), " ").alias("tokens"), text.normalise(F.concat(F.lit("（"), F.col("name"), F.lit("） -_"))).alias("normalised"))


def cleaning_bucket_rows(spark, d):
    """Lines as scored documents: means, latency percentiles and the share of image tables by format and backend, long."""
    lines = fx.table(spark, d, "lineitem")
    some = F.when(F.col("l_linenumber") != 3, F.col("l_discount"))
    one = F.struct(F.col("l_tax").alias("recall"), F.col("l_discount").alias("false_rate"), F.col("l_tax").alias("level_abs"), some.alias("level_rel"), F.array().cast("array<string>").alias("missed"))
    table = F.struct(F.lit(1).alias("n_md"), (F.col("l_returnflag") == "R").cast("int").alias("n_image"), F.lit(0).alias("n_json"), some.alias("md_cell_f1"), F.lit(None).cast("double").alias("json_corr_f1"), F.col("l_tax").alias("image_position_ok"), F.lit(None).cast("double").alias("image_completeness"))
    image = F.struct(F.col("l_tax").alias("recall"), F.col("l_discount").alias("false_rate"), some.alias("context_ok"), F.array().cast("array<string>").alias("misplaced"))
    scored = lines.select(
        F.col("l_returnflag").alias("format"), F.when(F.col("l_linestatus") == "O", F.col("l_linestatus")).alias("pdf_backend"), F.col("l_quantity").cast("long").alias("clean_ms"), F.col("l_discount").alias("completeness"), F.col("l_tax").alias("noise"),
        one.alias("heading"), table.alias("table"), image.alias("image"), F.col("l_discount").alias("list_fidelity"), F.col("l_tax").alias("order_fidelity"), some.alias("stability"),
    )
    return markdown.bucket_rows(markdown.cleaning_buckets(scored)).select("format", "pdf_backend", "n", "metric", "value")


def reference_texts(spark, d):
    """Customers as Markdown with front matter, badges or no heading: what is left of those that are long enough."""
    body = F.concat(F.when(F.col("c_custkey") % 4 == 0, "No heading").otherwise("# Heading"), F.lit("\n\n"), F.repeat(F.col("c_name"), (F.col("c_custkey") % 30).cast("int")))
    front = F.when(F.col("c_custkey") % 2 == 0, "---\ntitle: x\n---\n").otherwise("")
    badge = F.when(F.col("c_custkey") % 3 == 0, "[![b](https://img.shields.io/a)](https://x.y)\n").otherwise("")
    docs = fx.table(spark, d, "customer").select("c_custkey", F.concat(front, badge, body).alias("text"))
    return markdown.reference_markdown(docs).select("c_custkey", F.length("text").alias("chars"))


def rendered_refs(spark, d):
    files = fx.table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, "pdf").otherwise("html").alias("fmt"))
    return markdown.rendered_refs(files, ["mineru", "naive"])


QUERIES = {f.__name__: f for f in (
    heading_scores, table_scores, image_scores, list_fidelity, order_inversions, aligned_blocks, token_multiset_scores, stability_pairs, pair_scores, parsed_kinds, similarity_repeats, composed_tokens, cleaning_bucket_rows, reference_texts, rendered_refs,
)}

_H = "h AS (SELECT l_orderkey AS sample_id, l_quantity::INT AS quantity, l_returnflag = 'R' AS r, l_partkey AS part, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber) - 1 AS rank FROM lineitem)"
_TOKENS = r"list_concat(regexp_extract_all(lower({0}), '[a-z0-9]+'), regexp_extract_all(lower({0}), '[\x{{4e00}}-\x{{9fff}}]'))"
_MEANS = {
    "text_completeness": "l_discount", "text_noise": "l_tax", "heading_recall": "l_tax", "heading_false_rate": "l_discount", "heading_level_consistency_abs": "l_tax", "heading_level_consistency_rel": "third", "table_md_cell_f1": "third",
    "table_image_position_ok": "l_tax", "image_recall": "l_tax", "image_false_rate": "l_discount", "image_context_position_ok": "third", "list_fidelity": "l_discount", "order_fidelity": "l_tax", "stability": "third",
}
_MEAN_ROWS = " ".join(f"UNION ALL SELECT format, pdf_backend, count(*), '{name}', round_even(avg({column}), 4)::DOUBLE FROM l GROUP BY 1, 2" for name, column in _MEANS.items())

#: Scores are rounded by their exact binary value, as printf does.
ORACLES = {
    "heading_scores": f"""WITH {_H}, k AS (SELECT sample_id, count(*) AS n, count(*) FILTER (quantity < 45) AS kept, count(*) FILTER (quantity < 45 AND r) AS deeper, string_agg(repeat(chr(97 + rank::INT), 12), ',' ORDER BY rank) FILTER (quantity >= 45) AS missed, (sample_id % 5 = 0)::INT AS extra FROM h GROUP BY 1)
SELECT sample_id, printf('%.4f', (kept / n)::DOUBLE)::DOUBLE AS recall, CASE WHEN kept + extra = 0 THEN 0 ELSE printf('%.4f', (extra / (kept + extra))::DOUBLE)::DOUBLE END::DOUBLE AS false_rate, CASE WHEN kept = 0 THEN 0 ELSE printf('%.4f', ((kept - deeper) / kept)::DOUBLE)::DOUBLE END::DOUBLE AS level_abs,
 CASE WHEN kept = 0 THEN 0 ELSE printf('%.4f', (greatest(deeper, kept - deeper) / kept)::DOUBLE)::DOUBLE END::DOUBLE AS level_rel, coalesce(missed, '') AS missed FROM k""",
    "table_scores": f"""WITH {_H}, k AS (SELECT sample_id, sample_id % 4 AS kind, printf('%.4f', ((3 + 3 * count(*) - count(*) FILTER (r)) / (3 + 3 * count(*)))::DOUBLE)::DOUBLE AS f1 FROM h GROUP BY 1)
SELECT sample_id, (kind < 2)::INT AS n_md, (kind = 3)::INT AS n_image, (kind = 2)::INT AS n_json, CASE WHEN kind < 2 THEN f1 END AS md_cell_f1, CASE WHEN kind = 2 THEN f1 END AS json_corr_f1, CASE WHEN kind = 3 THEN 1.0::DOUBLE END AS image_position_ok FROM k""",
    "image_scores": f"""WITH {_H}, x AS (SELECT *, r OR coalesce(lead(r) OVER (PARTITION BY sample_id ORDER BY rank), false) AS lost, count(*) OVER (PARTITION BY sample_id) - (sample_id % 2 = 0)::INT AS made FROM h),
k AS (SELECT sample_id, count(*) AS n, any_value(made) AS made, count(*) FILTER (lost AND rank < made) AS lost, string_agg('img' || rank, ',' ORDER BY rank) FILTER (lost AND rank < made) AS misplaced FROM x GROUP BY 1)
SELECT sample_id, printf('%.4f', (made / n)::DOUBLE)::DOUBLE AS recall, 0.0::DOUBLE AS false_rate, CASE WHEN made = 0 THEN 0 ELSE printf('%.4f', ((made - lost) / made)::DOUBLE)::DOUBLE END::DOUBLE AS context_ok, coalesce(misplaced, '') AS misplaced FROM k""",
    "list_fidelity": f"""WITH {_H}, k AS (SELECT sample_id, count(*) AS n, count(*) FILTER (quantity < 30) AS m, max(rank % 2) AS deep, coalesce(max(rank % 2) FILTER (quantity < 30), 0) AS made FROM h GROUP BY 1)
SELECT sample_id, printf('%.4f', ((m / n + CASE WHEN greatest(deep, made) = 0 THEN 1.0::DOUBLE ELSE least(deep, made) / greatest(deep, made) END) / 2)::DOUBLE)::DOUBLE AS list_fidelity FROM k""",
    "order_inversions": f"""WITH {_H}, m AS (SELECT sample_id, rank, row_number() OVER (PARTITION BY sample_id ORDER BY quantity, rank) AS made FROM h), i AS (SELECT a.sample_id, count(*) AS inv FROM m a JOIN m b ON a.sample_id = b.sample_id AND a.rank < b.rank AND a.made > b.made GROUP BY 1), n AS (SELECT sample_id, count(*) AS n FROM m GROUP BY 1)
SELECT sample_id, CASE WHEN n < 2 THEN 1.0::DOUBLE ELSE printf('%.4f', (1 - coalesce(inv, 0) / (n * (n - 1) / 2))::DOUBLE)::DOUBLE END AS order_fidelity FROM n LEFT JOIN i USING (sample_id)""",
    "aligned_blocks": f"""WITH RECURSIVE {_H}, m AS (SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY quantity % 10, rank) - 1 AS j, quantity % 20 + 5 AS r, quantity % 7 * 3 + 1 AS s FROM h),
d AS (SELECT sample_id, list({{'p': quantity, 'q': rank * 4 + 1}} ORDER BY rank) AS refs FROM h GROUP BY 1), e AS (SELECT sample_id, list({{'j': j, 'r': r, 's': s}} ORDER BY j) AS mades FROM m GROUP BY 1),
step AS (SELECT sample_id, 0 AS i, NULL::BIGINT AS j, []::BIGINT[] AS used FROM d UNION ALL
 SELECT sample_id, i + 1, best.j, CASE WHEN best IS NULL THEN used ELSE list_append(used, best.j) END FROM (SELECT step.sample_id, step.i, used, list_max(list_transform(list_filter(mades, lambda x: NOT list_contains(used, x.j)
  AND 2.0::DOUBLE * (least(x.r, refs[i + 1].p) + least(x.s, refs[i + 1].q)) / (x.r + x.s + refs[i + 1].p + refs[i + 1].q) >= 0.6::DOUBLE), lambda x: {{'alike': 2.0::DOUBLE * (least(x.r, refs[i + 1].p) + least(x.s, refs[i + 1].q)) / (x.r + x.s + refs[i + 1].p + refs[i + 1].q), 'j': x.j}})) AS best
 FROM step JOIN d USING (sample_id) JOIN e USING (sample_id) WHERE i < len(refs)))
SELECT sample_id, (i - 1)::INT AS i, j::INT AS j FROM step WHERE j IS NOT NULL""",
    "token_multiset_scores": f"""WITH p AS (SELECT doc_id, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS nx FROM documents), c AS (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({_TOKENS.format("'x ' || coalesce(text, '')")}) AS token FROM documents) GROUP BY ALL),
a AS (SELECT p.doc_id, token, n AS r FROM p JOIN c ON c.doc_id = p.doc_id WHERE nx IS NOT NULL), b AS (SELECT p.doc_id, token, n AS p FROM p JOIN c ON c.doc_id = p.nx),
s AS (SELECT doc_id, sum(coalesce(r, 0)) AS nr, sum(coalesce(p, 0)) AS np, sum(least(coalesce(r, 0), coalesce(p, 0))) AS kept, sum(greatest(coalesce(p, 0) - coalesce(r, 0), 0)) AS extra FROM a FULL JOIN b USING (doc_id, token) GROUP BY doc_id)
SELECT doc_id, printf('%.4f', ((kept / nr)::DOUBLE)::DOUBLE)::DOUBLE AS completeness, printf('%.4f', ((extra / np)::DOUBLE)::DOUBLE)::DOUBLE AS noise FROM s""",
    "stability_pairs": r"""WITH v AS (SELECT conv_id, regexp_replace(lower(left(text, 2)), '[\s　，。、；：？！“”‘’（）【】《》〈〉,.;:?!"''()\[\]{}<>—\-_*`#>|\x0b]+', '', 'g') AS v FROM conversations), c AS (SELECT conv_id, v, count(*) AS c FROM v GROUP BY ALL)
SELECT conv_id, CASE WHEN sum(c) < 2 THEN 1.0::DOUBLE ELSE printf('%.4f', ((sum(c * (c - 1)) / (sum(c) * (sum(c) - 1)))::DOUBLE)::DOUBLE)::DOUBLE END AS stability FROM c GROUP BY conv_id""",
    "pair_scores": f"""WITH {_H}, k AS (SELECT sample_id, count(*) AS n, count(*) FILTER (quantity < 45) AS kept FROM h GROUP BY 1)
SELECT sample_id, true AS ok, n AS clean_ms, printf('%.4f', ((kept + n) / (2 * n))::DOUBLE)::DOUBLE AS completeness, 0.0::DOUBLE AS noise, printf('%.4f', (kept / n)::DOUBLE)::DOUBLE AS heading_recall, 1.0::DOUBLE AS image_recall, 0 AS n_md, 1.0::DOUBLE AS list_fidelity, 1.0::DOUBLE AS order_fidelity, (kept = n)::INT::DOUBLE AS stability FROM k""",
    "parsed_kinds": f"""WITH {_H}, k AS (SELECT sample_id, count(*) AS n FROM h GROUP BY 1)
SELECT sample_id, unnest(['heading', 'paragraph', 'blockquote', 'code', 'table', 'image', 'list']) AS kind, unnest([1, 3, 2, 1, 1, 1, 2]) AS n, unnest([0, 0, 0, 0, n + 1, 0, n + 2]) AS parts, unnest([7, 33, 6, 9, 9, 11, 13 * n + 1]) AS chars FROM k""",
    "similarity_repeats": f"WITH {_H} SELECT sample_id, rank, CASE WHEN rank + quantity = 0 THEN 1.0::DOUBLE ELSE round(2.0::DOUBLE * least(rank, quantity) / (rank + quantity), 6) END AS ratio FROM h",
    "composed_tokens": "SELECT p_partkey, array_to_string(regexp_extract_all(lower(p_name), '[a-z0-9]+'), ' ') AS tokens, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS normalised FROM part",
    "cleaning_bucket_rows": f"""WITH l AS (SELECT *, l_returnflag AS format, CASE WHEN l_linestatus = 'O' THEN 'O' END AS pdf_backend, CASE WHEN l_linenumber <> 3 THEN l_discount END AS third FROM lineitem), v AS (SELECT format, pdf_backend, list_sort(list(l_quantity::BIGINT)) AS v FROM l GROUP BY 1, 2)
SELECT format, pdf_backend, len(v) AS n, 'clean_ms_p50' AS metric, v[round_even(0.5::DOUBLE * (len(v) - 1), 0)::INT + 1]::DOUBLE AS value FROM v UNION ALL SELECT format, pdf_backend, len(v), 'clean_ms_p95', v[round_even(0.95::DOUBLE * (len(v) - 1), 0)::INT + 1]::DOUBLE FROM v
UNION ALL SELECT format, pdf_backend, count(*), 'table_mode_image_ratio', round_even((format = 'R')::INT / (1 + (format = 'R')::INT), 4)::DOUBLE FROM l GROUP BY 1, 2 {_MEAN_ROWS}""",
    "reference_texts": "WITH t AS (SELECT c_custkey, rtrim('# Heading' || chr(10) || chr(10) || repeat(c_name, (c_custkey % 30)::INT), chr(10)) AS t FROM customer WHERE c_custkey % 4 <> 0) SELECT c_custkey, length(t) AS chars FROM t WHERE length(t) >= 200",
    "rendered_refs": "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'pdf' ELSE 'html' END AS fmt, unnest(CASE WHEN p_size % 2 = 0 THEN ['mineru', 'naive'] ELSE [NULL] END) AS pdf_backend FROM part",
}

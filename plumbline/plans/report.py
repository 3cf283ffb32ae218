"""Reports of aggregated frames, which are small: HTML, Markdown, JSON and CSV."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import fixed, signed_delta
from plumbline.operators.aggregate import ALL, SMALL_BUCKET
from plumbline.operators.fusion import best_configs

#: What each metric tells, for the glossary.
GLOSSARY = {
    "recall": "share of the expected ids among the first k", "hit_rate": "whether one of them is among the first k", "precision": "share of the first k that is expected", "mrr": "inverse rank of the first expected id",
    "map": "mean precision at the expected ids", "ndcg_binary": "discounted gain with gains of 1", "ndcg_graded": "discounted gain with graded gains",
}
STYLE = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse;margin:1em 0}td,th{border:1px solid #ccc;padding:4px 8px;text-align:left}.bad{color:#b00}.small{color:#888}"


def headline(totals: DataFrame) -> DataFrame:
    """recall and ndcg_binary at their greatest k, and mrr."""
    top = totals.where(F.col("metric").isin("recall", "ndcg_binary", "mrr")).groupBy("metric").agg(F.max_by(F.struct("k", "value", "n"), F.coalesce("k", F.lit(-1))).alias("x"))
    return top.select("metric", "x.*").orderBy("metric")


def by_k(totals: DataFrame, deltas: DataFrame | None = None) -> DataFrame:
    """Metrics as rows and k as columns; with deltas, the change at the greatest k and whether it is a regression."""
    wide = totals.where("k is not null").groupBy("metric").pivot("k").agg(F.first("value"))
    if deltas is not None:
        last = deltas.where("k is not null").groupBy("metric").agg(F.max_by("delta", "k").alias("delta"), F.bool_or("is_regression").alias("is_regression"))
        wide = wide.join(last, "metric", "left")
    return wide.orderBy("metric")


def overlap_note(totals: DataFrame, latency: DataFrame | None) -> str:
    """Which share of the hits one route alone found, and all did, and the median latency, as one line."""
    parts = [f"{'all routes' if r['metric'] == 'overlap_all_sources' else r['metric'][8:-5] + ' only'} {100 * r['value']:.0f}%" for r in totals.where(F.startswith("metric", F.lit("overlap_"))).orderBy("metric").collect()]
    median = latency.first()[0] if latency is not None else None
    parts += [f"median latency {median:.0f} ms"] if median is not None else []
    return f"<h2>Overlap and latency</h2><p>{html.escape(' · '.join(parts))}</p>" if parts else ""


def quality_section(quality: DataFrame, failures: DataFrame | None) -> str:
    """Whether a run is clean, and which routes failed how often."""
    clean = quality.first()["clean"]
    told = ", ".join(f"{r['source']}={r['n']}" for r in failures.orderBy("source").collect()) if failures is not None else ""
    note = "clean run: fit as a baseline" if clean else "not clean: routes failed or found nothing, so the values may not hold as a baseline"
    return table(quality, "Run quality") + f"<p>{note}; failed sources: {html.escape(told) or 'none'}</p>"


def table(df: DataFrame, caption: str, mark: str | None = None) -> str:
    """A frame of a few rows as an HTML table; numbers of three places, rows with mark true stand out."""
    kinds = dict(df.dtypes)
    shown = [c for c in df.columns if c != mark]
    told = df.select(*[(signed_delta(F.col(c)) if c == "delta" else fixed(F.col(c)) if kinds[c] == "double" else F.coalesce(F.col(c).cast("string"), F.lit("-"))).alias(c) for c in shown], *([mark] if mark else []))
    rows = "".join(f"<tr{' class=bad' if mark and r[mark] else ''}>" + "".join(f"<td>{html.escape(str(r[c]))}</td>" for c in shown) + "</tr>" for r in told.collect())
    return f"<h2>{html.escape(caption)}</h2><table><tr>{''.join(f'<th>{html.escape(c)}</th>' for c in shown)}</tr>{rows}</table>"


def page(title: str, sections: list[str]) -> str:
    return f"<!DOCTYPE html>\n<html><head><meta charset=\"utf-8\"><title>{html.escape(title)}</title><style>{STYLE}</style></head><body><h1>{html.escape(title)}</h1>{''.join(sections)}</body></html>\n"


def retrieval_html(title: str, buckets: DataFrame, quality: DataFrame, latency: DataFrame | None = None, deltas: DataFrame | None = None, failures: DataFrame | None = None) -> str:
    """Headline, metrics by k with their change, overlap and latency, run quality, types, domains, changes and the glossary."""
    whole = buckets.where((F.col("type_bucket") == ALL) & (F.col("domain_bucket") == ALL))
    note = F.when(F.col("n") < SMALL_BUCKET, "small").otherwise("")
    one = lambda c, other: buckets.where((F.col(c) != ALL) & (F.col(other) == ALL)).select(F.col(c), "metric", "k", "value", "n", note.alias("note")).orderBy(c, "metric", "k")
    sections = [table(headline(whole), "Headline"), table(by_k(whole, deltas), "By k", "is_regression" if deltas is not None else None), table(whole.where("k is null").select("metric", "value", "n").orderBy("metric"), "Whole list and overlap")]
    sections += [overlap_note(whole, latency), quality_section(quality, failures), table(one("type_bucket", "domain_bucket"), "By type"), table(one("domain_bucket", "type_bucket"), "By domain")]
    sections += [table(deltas, "Against the baseline", "is_regression")] if deltas is not None else []
    present = {r["metric"] for r in whole.select("metric").distinct().collect()}
    sections.append("<h2>Glossary</h2><dl>" + "".join(f"<dt>{k}</dt><dd>{v}</dd>" for k, v in GLOSSARY.items() if k in present) + "</dl>")
    return page(title, sections)


def cleaning_html(title: str, buckets: DataFrame) -> str:
    """First the first PDF bucket, or the first; then all buckets, a group of metrics at a time."""
    first = buckets.orderBy(F.desc(F.col("format") == "pdf"), "format", F.coalesce("pdf_backend", F.lit(""))).limit(1)
    group = lambda start: [c for c in buckets.columns if c.startswith(start)]
    keys = ["format", "pdf_backend", "n"]
    return page(title, [table(first, "Headline"), *[table(buckets.select(*keys, *group(g)), g.rstrip("_").capitalize()) for g in ("text_", "heading_", "table_", "image_", "clean_ms_")], table(buckets.select(*keys, "list_fidelity", "order_fidelity", "stability"), "Structure")])


def to_json(buckets: DataFrame, deltas: DataFrame | None = None) -> str:
    rows = lambda df: [json.loads(x) for x in df.toJSON().collect()]
    return json.dumps({"metrics": rows(buckets), "deltas": rows(deltas) if deltas is not None else []}, ensure_ascii=False, sort_keys=True)


def from_json(spark, text: str, schema: str) -> DataFrame:
    """The metrics of to_json() as rows again."""
    lines = [(json.dumps(row, ensure_ascii=False),) for row in json.loads(text)["metrics"]]
    return spark.createDataFrame(lines, "value string").select(F.from_json("value", schema).alias("r")).select("r.*")


def summary(totals: DataFrame, quality: DataFrame) -> str:
    """A run in a few lines of text."""
    q = quality.first()
    lines = [f"{r['metric']}{'' if r['k'] is None else '@%d' % r['k']} = {r['value']:.4f} (n={r['n']})" for r in totals.orderBy("metric", F.coalesce("k", F.lit(-1))).collect()]
    return "\n".join([*lines, f"samples={q['samples']} failed={q['failed_samples']} empty={q['zero_ranked']} clean={str(q['clean']).lower()}"])


def markdown_table(df: DataFrame) -> str:
    rows = ["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    return "\n".join(rows + ["| " + " | ".join("-" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in df.collect()]) + "\n"


def tuning_outputs(results: DataFrame, path: str, title: str = "Tuning") -> dict[str, str]:
    """All results as CSV and the best as JSON, Markdown and HTML, under path; the texts are returned too."""
    spark, best = results.sparkSession, best_configs(results)
    results.write.mode("overwrite").option("header", True).csv(f"{path}/results.csv")
    rows = [json.loads(x) for x in best.toJSON().collect()]
    n = results.count()
    texts = {"best.json": json.dumps({"configs": n, "best": rows[0] if rows else None, "top": rows}), "report.md": f"# {title}\n\n{n} configs\n\n" + markdown_table(best), "report.html": page(title, [f"<p>{n} configs</p>", table(best, "Best")])}
    for name, text in texts.items():
        write_text(spark, text, f"{path}/{name}")
    return texts


def write_text(spark, text: str, path: str) -> None:
    """A text as one file, on any file system that Spark knows."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()

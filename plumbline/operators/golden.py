"""Golden sets: checks, conversion from public judgments, sampling, the quality gate, and locating facts by anchors."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.alignment import bit_masks, common_length
from plumbline.functions.text import ngrams, normalise, ratio

#: Question types, their shares of a set, in order.
MIX = {"keyword": 0.35, "paraphrase": 0.30, "longtail": 0.20, "cross_doc": 0.15}
#: Tiers of an anchor's match, best first.
TIERS = ("exact", "normalized", "fuzzy", "miss")
#: Choices of this library where the original states no number: the similarity of a fuzzy match, the characters of
#: a leak, the depth of the retrieval loop.
FUZZY, LEAK, LOOP_TOP = 0.85, 6, 5
#: Facts of a document by its length.
FACTS = {"short": 3, "medium": 6, "long": 10}


def validated(golden: DataFrame) -> DataFrame:
    """golden, failing where a sample has neither chunks nor documents expected, or an id occurs twice."""
    none = (F.coalesce(F.size("expected_chunk_ids"), F.lit(0)) < 1) & (F.coalesce(F.size("expected_doc_ids"), F.lit(0)) < 1)
    twice = golden.groupBy("id").count().where("count > 1").select(F.col("id").alias("twice"))
    checked = golden.join(twice, F.col("id") == F.col("twice"), "left")
    fault = F.when(none, F.concat(F.lit("no expected chunks or documents: "), "id")).when(F.col("twice").isNotNull(), F.concat(F.lit("id occurs twice: "), "id"))
    return checked.withColumn("id", F.when(fault.isNotNull(), F.raise_error(fault).cast("string")).otherwise(F.col("id"))).drop("twice")


def precheck(golden: DataFrame, corpus: DataFrame) -> DataFrame:
    """(id, missing, doc_fallback_available) of samples of which expected chunks aren't in the corpus."""
    asked = golden.select("id", "expected_doc_ids", F.explode(F.array_distinct("expected_chunk_ids")).alias("chunk_id"))
    lost = asked.join(corpus.select("chunk_id").distinct(), "chunk_id", "left_anti")
    return lost.groupBy("id").agg(F.array_sort(F.collect_list("chunk_id")).alias("missing"), F.first(F.coalesce(F.size("expected_doc_ids") > 0, F.lit(False))).alias("doc_fallback_available"))


def manifest_rows(manifest: DataFrame, collection: DataFrame, limit: int | None = None) -> DataFrame:
    """(doc_id, source_id, text) of what is to be ingested: successful rows whose text is there and isn't empty.

    limit is the caller's, counted after the join; 0 or None is no limit.
    """
    rows = manifest.where(F.col("status") == "success").join(collection.select("source_id", "text"), "source_id").where(F.col("text") != "").select("doc_id", "source_id", "text")
    return rows.orderBy("doc_id").limit(limit) if limit else rows


#: Values that a task numbers on average, and values drawn to cut the others into ranges; they decide the balance only.
NUMBERED, CUTS = 1 << 16, 1 << 14


def number_passages(passages: DataFrame, base: int, order: str = "source_id") -> DataFrame:
    """Passages with doc_id = base + ordinal, and the manifest's status.

    The order is cut into ranges at values drawn by hash; ranges are counted and numbered on their own.
    """
    ranges = 1 + passages.count() // NUMBERED
    drawn = sorted(r[0] for r in passages.select(order).where(F.col(order).isNotNull()).orderBy(F.xxhash64(order)).limit(min(CUTS, 16 * ranges)).collect()) if ranges > 1 else []
    cuts = sorted({drawn[i * len(drawn) // ranges] for i in range(1, ranges)}) if drawn else []
    part = F.lit(0)
    if cuts:
        kind = passages.schema[order].dataType
        part = F.when(F.col(order).isNull(), F.lit(0)).otherwise(F.size(F.filter(F.array(*[F.lit(c).cast(kind) for c in cuts]), lambda c: c <= F.col(order))))
    ranged = passages.withColumn("part", part)
    counts = ranged.groupBy("part").count()  # a row for each range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return ranged.join(F.broadcast(offsets), "part").withColumn("doc_id", place + F.col("offset") + F.lit(base)).withColumn("status", F.lit("success")).drop("part", "offset")


def convert_judgments(judged: DataFrame, queries: DataFrame, manifest: DataFrame, name: str, graded: bool = False) -> DataFrame:
    """Golden samples of (qid, pid, grade) and (qid, query): id, query, expected_doc_ids, relevance_grades, note,
    dropped_pids, converted, partial_missing.

    Only grades above 0 are positive; only ingested passages count. A query left without any isn't converted.
    """
    positive = judged.where("grade > 0").select("qid", "pid", "grade").dropDuplicates(["qid", "pid"])
    held = manifest.where(F.col("status") == "success").select(F.col("source_id").alias("pid"), "doc_id")
    found = positive.join(held, "pid", "left").groupBy("qid").agg(
        F.array_sort(F.array_distinct(F.collect_list("doc_id"))).alias("expected_doc_ids"), F.array_sort(F.collect_list(F.when(F.col("doc_id").isNull(), F.col("pid")))).alias("dropped_pids"),
        F.array_sort(F.collect_set(F.when(F.col("doc_id").isNotNull(), F.struct(F.col("doc_id").cast("string").alias("key"), "grade")))).alias("grades"),
    )
    none = F.array().cast("array<string>")
    out = queries.join(found, "qid", "left").withColumns({"expected_doc_ids": F.coalesce("expected_doc_ids", F.array().cast("array<bigint>")), "dropped_pids": F.coalesce("dropped_pids", none)})
    converted = F.size("expected_doc_ids") > 0
    partial = converted & (F.size("dropped_pids") > 0)
    grades = F.when(converted, F.map_from_entries("grades")) if graded else F.lit(None).cast("map<string,int>")
    return out.select(
        F.concat(F.lit(f"{name}-"), F.col("qid").cast("string")).alias("id"), "query", none.alias("expected_chunk_ids"), "expected_doc_ids", grades.alias("relevance_grades"),
        F.when(partial, F.concat(F.lit("missing: "), F.array_join("dropped_pids", ","))).alias("note"), "dropped_pids", converted.alias("converted"), partial.alias("partial_missing"),
    )


def quota(n: int, mix: dict[str, float] = MIX) -> dict[str, int]:
    """Whole numbers by share that sum to n; what rounding down leaves goes to the largest share."""
    out = {name: int(n * share) for name, share in mix.items()}
    out[max(mix, key=mix.get)] += n - sum(out.values())
    return out


def stratified_pick(chunks: DataFrame, n: int, seed: int = 0, bucket: str = "dataset_id", key: str = "chunk_id") -> DataFrame:
    """n chunks in turn from every bucket, each bucket in an order by hash; small buckets run out and others go on."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    turn = chunks.withColumn("turn", F.row_number().over(Window.partitionBy(bucket).orderBy(order, key)))
    return turn.where(F.col("turn") <= n).orderBy("turn", bucket).limit(n).drop("turn")


def group_adjacent(chunks: DataFrame, size: int, doc: str = "doc_id", index: str = "chunk_index") -> DataFrame:
    """(doc, group_start, members): disjoint groups of size successive chunks; a gap ends a group, rests are left out."""
    order = Window.partitionBy(doc).orderBy(index)
    islands = chunks.withColumn("island", F.col(index) - F.row_number().over(order))
    place = F.row_number().over(Window.partitionBy(doc, "island").orderBy(index)) - 1
    grouped = islands.withColumn("group", F.floor(place / size)).groupBy(doc, "island", "group").agg(F.min(index).alias("group_start"), F.array_sort(F.collect_list(index)).alias("members"))
    return grouped.where(F.size("members") == size).select(doc, "group_start", "members")


def eligible_chunks(chunks: DataFrame, dataset_ids: list[int], least_chars: int = 0) -> DataFrame:
    return chunks.where(F.col("dataset_id").isin(dataset_ids) & (F.length(F.btrim(F.coalesce("content", F.lit("")))) >= least_chars))


def allot_types(chunks: DataFrame, quotas: dict[str, int], key: str = "chunk_id") -> DataFrame:
    """chunks with the question type that each is to serve, types one after the other in the order of MIX.

    Only the first chunks, as many as there are questions, are numbered.
    """
    place, kind, so_far = F.row_number().over(Window.orderBy(key)), F.lit(None).cast("string"), 0
    ends = []
    for name in (t for t in MIX if t != "cross_doc"):
        so_far += quotas.get(name, 0)
        ends.append((name, so_far))
    for name, end in reversed(ends):
        kind = F.when(F.col("place") <= end, name).otherwise(kind)
    return chunks.orderBy(key).limit(so_far).withColumn("place", place).withColumn("type", kind).drop("place")


def generated_samples(answers: DataFrame) -> DataFrame:
    """What a model wrote (sample_id, chunk_ids, answer json) as samples or the reason why not.

    Columns added: query, golden_answer, used_chunk_ids, dropped (unanswerable, unparsed, invalid or null). Ids
    that weren't given are ignored; if none is left, all chunks count as used.
    """
    from plumbline.functions.text import first_json_object

    seen = answers.withColumn("o", F.from_json(first_json_object("answer"), "answerable boolean, query string, answer string, used_chunk_ids array<string>"))
    used = F.array_intersect(F.coalesce("o.used_chunk_ids", F.array().cast("array<string>")), "chunk_ids")
    why = F.when(F.col("o").isNull(), "unparsed").when(~F.coalesce(F.col("o.answerable"), F.lit(True)), "unanswerable").when(F.coalesce(F.btrim("o.query"), F.lit("")) == "", "invalid")
    return seen.select(*answers.columns, F.col("o.query").alias("query"), F.col("o.answer").alias("golden_answer"), F.when(F.size(used) > 0, used).otherwise(F.col("chunk_ids")).alias("used_chunk_ids"), why.alias("dropped"))


def gate(signals: DataFrame) -> DataFrame:
    """signals with decision (passed, dropped, hard) and failed_signal.

    Signals: has_text, answerable, has_golden_answer, consistent, and retrieved and expected ids. A sample whose text
    is missing, that can't be answered or whose answer is inconsistent is dropped, in this order; one that an
    independent retriever misses is hard. Consistency isn't asked where there is no golden answer.
    """
    looped = F.arrays_overlap(F.slice("retrieved", 1, LOOP_TOP), "expected")
    failed = (
        F.when(~F.col("has_text"), "missing_text").when(~F.col("answerable"), "answerability")
        .when(F.col("has_golden_answer") & ~F.coalesce(F.col("consistent"), F.lit(False)), "consistency").when(~F.coalesce(looped, F.lit(False)), "retrieval_loop")
    )
    return signals.withColumn("failed_signal", failed).withColumn("decision", F.when(F.col("failed_signal").isNull(), "passed").when(F.col("failed_signal") == "retrieval_loop", "hard").otherwise("dropped"))


def gate_rates(decided: DataFrame) -> DataFrame:
    return decided.agg(F.count(F.lit(1)).alias("n"), *[F.bround(F.try_divide(F.count_if(F.col("decision") == d), F.count(F.lit(1))), 4).alias(f"{d}_rate") for d in ("passed", "hard", "dropped")])


def most_alike(a: str, t: str, least: float = 0.0, enough: float = 1.0) -> float:
    """The greatest ratio of a and a part of t of its length, at every offset; parts at the end of t may be shorter.

    What is under least is told as 0, and of several from enough on any may be told. Matching blocks make up a
    common subsequence, and that is made up of common characters, so offsets where these are too few are skipped.
    """
    if not a or not t:
        return 0.0
    n = len(a)
    spare = Counter(a)
    shared, bounds = 0, []
    # From the last offset on, a character comes in on the left, and one goes out on the right of a whole window.
    for i in range(len(t) - 1, -1, -1):
        shared += spare[t[i]] > 0
        spare[t[i]] -= 1
        if i + n < len(t):
            shared -= spare[t[i + n]] >= 0
            spare[t[i + n]] += 1
        bound = 2.0 * shared / (n + min(n, len(t) - i))
        if bound >= least:
            bounds.append((bound, i))
    masks, closer = bit_masks(a), []
    for _, i in bounds:
        window = t[i : i + n]
        bound = 2.0 * common_length(masks, (1 << n) - 1, window) / (n + len(window))
        if bound >= least:
            closer.append((bound, i))
    best = 0.0
    for bound, i in sorted(closer, reverse=True):
        if bound <= best or best >= enough:
            break
        best = max(best, ratio(a, t[i : i + n]))
    return best if best >= least else 0.0


@F.pandas_udf(T.DoubleType())
def best_window(anchor: pd.Series, text: pd.Series) -> pd.Series:
    """How alike an anchor is to the part of a text of its length that is most like it, both normalised."""
    return pd.Series([most_alike(a or "", t or "") for a, t in zip(anchor, text, strict=True)], dtype="float64")


@F.pandas_udf(T.BooleanType())
def has_window(anchor: pd.Series, text: pd.Series) -> pd.Series:
    """Whether best_window is FUZZY or more; far fewer parts are compared than it takes to find the best."""
    return pd.Series([most_alike(a or "", t or "", FUZZY, FUZZY) >= FUZZY for a, t in zip(anchor, text, strict=True)], dtype="bool")


def shared_pairs_needed(n: Column, least: float = FUZZY) -> Column:
    """How many of the n - 1 pairs of neighbouring characters of an anchor a text must have, for any part of it to be least alike.

    Of an anchor of n characters and a part of m <= n, matching blocks have M >= least / 2 * (n + m) characters, so m >= least / (2 - least) * n.
    n + m - 2 * M characters are in no block, and between two blocks there is one at least, so that there are at most
    (1 - least) * (n + m) + 1 blocks; all pairs within blocks are shared, which are M less the number of blocks.
    """
    return F.ceil((3 * least - 2) * n / (2 - least) - 1 - 1e-9)


def may_be_alike(anchor: Column, text: Column, least: float = FUZZY) -> Column:
    """Whether a text shares as many pairs of characters with an anchor as a part that is least alike would; never false for one that is."""
    n = F.length(anchor)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(anchor, i, 2))
    return F.size(F.filter(pairs, lambda p: F.contains(text, p))) >= shared_pairs_needed(n, least)


def match_tiers(pairs: DataFrame, fuzzy: bool = True, compose: bool = True) -> DataFrame:
    """pairs of (anchor, content) with tier 0 to 3: exact, normalized, fuzzy, miss.

    Only what misses and shares enough pairs of characters to be FUZZY alike is compared fuzzily.
    """
    a, c = normalise(F.col("anchor"), compose), normalise(F.col("content"), compose)
    near = pairs.withColumns({"na": a, "nc": c})
    tier = F.when(F.contains("content", "anchor"), 0).when((F.col("na") != "") & F.contains("nc", "na"), 1)
    if fuzzy:
        near = near.withColumn("tier", tier)
        possible = F.coalesce(may_be_alike(F.col("na"), F.col("nc")), F.lit(False))
        open_ = near.where("tier is null").withColumn("possible", possible)
        compared = open_.where("possible").withColumn("tier", F.when(has_window("na", "nc"), 2).otherwise(3))
        found = reduce(DataFrame.unionByName, (near.where("tier is not null"), compared.drop("possible"), open_.where("not possible").drop("possible").withColumn("tier", F.lit(3))))
    else:
        found = near.withColumn("tier", F.coalesce(tier, F.lit(3)))
    return found.drop("na", "nc")


def locate(facts: DataFrame, chunks: DataFrame, fuzzy: bool = True, compose: bool = True) -> DataFrame:
    """(fact_id, chunk_ids, tier): all chunks at a fact's best tier; facts carry doc_id and are sought in its chunks."""
    pairs = facts.select("fact_id", "doc_id", "anchor").join(chunks.select("doc_id", "chunk_id", "content"), "doc_id")
    best = match_tiers(pairs, fuzzy, compose).where("tier < 3").groupBy("fact_id", "tier").agg(F.array_sort(F.collect_list("chunk_id")).alias("chunk_ids")).groupBy("fact_id").agg(F.min_by(F.struct("tier", "chunk_ids"), "tier").alias("b"))
    named = F.element_at(F.array(*map(F.lit, TIERS)), F.coalesce(F.col("b.tier"), F.lit(3)) + 1)
    return facts.select("fact_id").join(best, "fact_id", "left").select("fact_id", F.coalesce("b.chunk_ids", F.array().cast("array<string>")).alias("chunk_ids"), named.alias("tier"))


def miss_rates(located: DataFrame, bucket: str) -> DataFrame:
    return located.groupBy(bucket).agg(F.count(F.lit(1)).alias("facts"), F.count_if(F.col("tier") == "miss").alias("misses"), F.try_divide(F.count_if(F.col("tier") == "miss"), F.count(F.lit(1))).alias("miss_rate"))


#: Lengths of the runs by which anchors that lie within others are found: powers of two up to this.
LONGEST_RUN = 64


#: Facts of a document that are compared one with another; those of larger ones meet by runs.
FEW_FACTS = 64


def distinct_facts(facts: DataFrame) -> DataFrame:
    """facts (doc_id, fact_id, anchor, ..) without those whose anchor holds another fact's of the same document; of equal anchors the least fact_id stays.

    Facts of a document that has at most FEW_FACTS are compared where they lie. Of the others, an anchor that holds another
    one holds its first characters, as many as a power of two allows. Anchors list their runs of those lengths, and meet
    by document and run: rows grow with the characters, not with pairs of facts.
    """
    told = facts.where("anchor is not null and doc_id is not null")
    rest = facts.where("anchor is null or doc_id is null")
    many = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    few = told.withColumn("_many", many).where(F.col("_many") <= FEW_FACTS).drop("_many").groupBy("doc_id").agg(F.collect_list(F.struct(*facts.columns)).alias("_of"))
    same = lambda x: F.array_min(F.transform(F.filter("_of", lambda y: y["anchor"] == x["anchor"]), lambda y: y["fact_id"]))
    holds = lambda x: F.exists("_of", lambda y: (y["anchor"] != x["anchor"]) & F.contains(x["anchor"], y["anchor"]))
    alone = few.select(F.inline(F.filter("_of", lambda x: (x["fact_id"] == same(x)) & ~holds(x))))
    if told.groupBy("doc_id").count().where(F.col("count") > FEW_FACTS).isEmpty():
        return alone.unionByName(rest)
    crowded = told.withColumn("_many", many).where(F.col("_many") > FEW_FACTS).drop("_many")
    return alone.unionByName(_distinct_by_runs(crowded)).unionByName(rest)


def _distinct_by_runs(facts: DataFrame) -> DataFrame:
    whole = facts.where("anchor is not null").groupBy("doc_id", "anchor").agg(F.min("fact_id").alias("first"))
    n = F.length("anchor")
    sizes = F.array(F.lit(0), *[F.lit(1 << i) for i in range(LONGEST_RUN.bit_length())])
    run = lambda size: F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.substring("anchor", i, size))
    runs = F.array_distinct(F.flatten(F.transform(F.filter(sizes, lambda s: s <= n), run)))
    outer = whole.select("doc_id", "anchor", F.explode(runs).alias("run"))
    key = F.substring(F.col("anchor"), F.lit(1), F.array_max(F.filter(sizes, lambda s: s <= n)))
    inner = whole.select("doc_id", F.col("anchor").alias("inner"), key.alias("run"))
    holding = outer.join(inner, ["doc_id", "run"]).where((F.col("anchor") != F.col("inner")) & F.contains("anchor", "inner")).select("doc_id", "anchor").distinct()
    stay = whole.join(holding, ["doc_id", "anchor"], "left_anti").select("doc_id", "anchor", F.col("first").alias("fact_id"))
    # A fact_id that a document has twice stays as often as it is there.
    return facts.join(stay, ["doc_id", "fact_id", "anchor"], "left_semi")


def missing_anchors(facts: DataFrame, composed: DataFrame) -> DataFrame:
    """(doc_id, fact_id) of facts whose anchor the composed text doesn't hold."""
    return facts.join(composed.select("doc_id", "text"), "doc_id").where(~F.contains("text", "anchor")).select("doc_id", "fact_id")


def leaked_anchors(pairs: DataFrame, n: int = LEAK, compose: bool = True) -> DataFrame:
    """pairs of (query, anchor) with leaked: whether the query tells n characters in a row of its anchor, both normalised."""
    near = pairs.withColumns({"nq": normalise(F.col("query"), compose), "na": normalise(F.col("anchor"), compose)})
    return near.withColumn("leaked", F.coalesce(F.arrays_overlap(ngrams(F.col("nq"), n), ngrams(F.col("na"), n)), F.lit(False))).drop("nq", "na")


def relocate(samples: DataFrame, facts: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Samples (id, fact_id, ..) with chunk ids found anew, and (id) of those whose anchor is gone."""
    found = locate(facts, chunks).where("tier <> 'miss'").select("fact_id", F.col("chunk_ids").alias("new_ids"))
    moved = samples.join(found, "fact_id").withColumn("expected_chunk_ids", F.col("new_ids")).drop("new_ids")
    return moved, samples.join(found, "fact_id", "left_anti").select("id")


def spec_matrix(spark: SparkSession) -> DataFrame:
    """Specifications of synthetic documents: format, backend (of PDF only), structure, length, distribution, key, n_facts."""
    side = lambda name, values: spark.range(1).select(F.explode(F.array(*map(F.lit, values))).alias(name))
    every = side("fmt", ("md", "html", "docx", "pdf")).crossJoin(side("structure", ("headings", "tables", "lists"))).crossJoin(side("length", tuple(FACTS))).crossJoin(side("fact_distribution", ("concentrated", "scattered", "cross_section")))
    every = every.withColumn("pdf_backend", F.explode(F.when(F.col("fmt") == "pdf", F.array(*map(F.lit, ("mineru", "opendataloader", "naive")))).otherwise(F.array(F.lit(None).cast("string")))))
    facts = F.element_at(F.create_map(*[x for k, v in FACTS.items() for x in (F.lit(k), F.lit(v))]), F.col("length"))
    return every.select("*", F.concat_ws("-", F.concat_ws("x", "fmt", "pdf_backend"), "structure", "length", "fact_distribution").alias("key"), facts.alias("n_facts"))


def render(fmt: str, markdown: str, title: str = "") -> tuple[bytes, str]:
    """A document in a format that needs no outside program."""
    import html as escaping

    from plumbline.operators.markdown import parse_blocks

    if fmt == "md":
        return markdown.encode(), ".md"
    if fmt != "html":
        raise ValueError(f"unsupported format {fmt!r}: md and html are rendered here, others need an outside program")
    said, tell = [], escaping.escape
    for b in parse_blocks(markdown):
        rows = "".join("<tr>" + "".join(f"<td>{tell(c)}</td>" for c in row) + "</tr>" for row in b.rows)
        said.append({
            "heading": f"<h{b.level}>{tell(b.text)}</h{b.level}>", "image": f'<img alt="{tell(b.alt)}" src="{tell(b.path)}">', "table": f"<table>{rows}</table>", "code": f"<pre>{tell(b.text)}</pre>",
            "list": "<ul>" + "".join(f"<li>{tell(x)}</li>" for _, x in b.items) + "</ul>", "blockquote": f"<blockquote>{tell(b.text)}</blockquote>",
        }.get(b.kind, f"<p>{tell(b.text)}</p>"))
    return f"<!DOCTYPE html>\n<html><head><meta charset=\"utf-8\"><title>{tell(title)}</title></head>\n<body>\n{chr(10).join(said)}\n</body></html>\n".encode(), ".html"


#: Faults of a program: calling again can't mend them.
FINAL = (TypeError, AttributeError, NameError, ImportError, NotImplementedError)


def in_order(made: list) -> list:
    """Answers of a batch; those that tell their index are put in its order, and must tell each index once."""
    if not made or not all(isinstance(x, dict) and "index" in x for x in made):
        return made
    by_index = sorted(made, key=lambda x: x["index"])
    if [x["index"] for x in by_index] != list(range(len(made))):
        raise ValueError("answers don't tell each index once")
    return [x["value"] for x in by_index]


def applied(rows: DataFrame, function: Callable, column: str, to: str, batch: int = 1, retries: int = 3, backoff: float = 3.0, longest: float = 30.0, reason: str | None = None) -> DataFrame:
    """rows with what an injected function (a model, an encoder, a parser) makes of a column, as text.

    With batch over 1 the function takes a list of values and returns as many, in their order or as dicts of index and
    value. A call that raises, or returns too few, is tried again after backoff seconds, twice as many each time and
    longest at most; after retries calls, or at once if the program is at fault, it gives null. reason names a column
    that tells the last call's fault, null where there is none.
    """
    names = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField(to, T.StringType()), *([T.StructField(reason, T.StringType())] if reason else [])])

    def called(values: list) -> list[tuple]:
        fault = None
        for attempt in range(retries):
            try:
                made = in_order(list(function(values))) if batch > 1 else [function(values[0])]
                if len(made) == len(values):
                    return [(x, None) for x in made]
                fault = f"{len(made)} answers to {len(values)} values"
            except Exception as raised:  # noqa: BLE001 - a failed call is tried again, then told as null with its reason
                fault = f"{type(raised).__name__}: {raised}"
                if isinstance(raised, FINAL):
                    break
            if attempt + 1 < retries:
                time.sleep(min(longest, backoff * 2**attempt))
        return [(None, fault)] * len(values)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values = frame[column].tolist()
            made = [x for at in range(0, len(values), batch) for x in called(values[at : at + batch])]
            yield frame[names].assign(**{to: [x for x, _ in made]} | ({reason: [f for _, f in made]} if reason else {}))

    return rows.mapInPandas(run, schema)


#: What a generator and a reviewer are asked, and how they are to answer.
ASK = "Write one question of the type {type} that these passages answer, and the answer, as JSON with answerable, query, answer and used_chunk_ids.\n{passages}"
REVIEW = "Do the passages answer the question, and does the answer agree with them? Reply as JSON with answerable and consistent.\nQuestion: {query}\nAnswer: {answer}\n{passages}"


def question_groups(chunks: DataFrame, quotas: dict[str, int], seed: int = 0) -> DataFrame:
    """(sample_id, type, dataset_id, chunk_ids, passages): what each question is to be written about.

    Chunks are picked in turn from every dataset; questions across passages get successive pairs of a document.
    """
    single = sum(n for t, n in quotas.items() if t != "cross_doc")
    told = lambda: F.array_join(F.transform("members", lambda m: F.concat(F.lit("["), m["chunk_id"], F.lit("] "), m["content"])), "\n")
    member = F.struct("chunk_index", "chunk_id", "content")
    picked = allot_types(stratified_pick(chunks, single, seed), quotas).select("type", "dataset_id", F.array(member).alias("members"))
    pairs = group_adjacent(chunks.select("doc_id", "chunk_index").distinct(), 2)
    whole = pairs.withColumn("chunk_index", F.explode("members")).drop("members").join(chunks, ["doc_id", "chunk_index"]).groupBy("doc_id", "group_start").agg(F.min("dataset_id").alias("dataset_id"), F.array_sort(F.collect_list(member)).alias("members"))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), "doc_id", "group_start").cast("binary"))
    across = whole.orderBy(order, "doc_id", "group_start").limit(quotas.get("cross_doc", 0)).select(F.lit("cross_doc").alias("type"), "dataset_id", "members")
    both = picked.unionByName(across)
    named = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "type", F.array_join("members.chunk_id", ",")).cast("binary")), 1, 12)
    return both.select(F.concat(F.lit("gen-"), named).alias("sample_id"), "type", "dataset_id", F.col("members.chunk_id").alias("chunk_ids"), told().alias("passages"))

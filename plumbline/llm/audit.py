"""What filters remove, in every order that they can be applied in.

Orders share their beginnings, whatever order these are in: what is left after {A, C} is the same for A then C and
C then A. States are visited depth first; the documents that survive a state are persisted while the states below
it are made from them, and each state is made and counted once. Every edge from a state to the next is counted on
the surviving documents themselves.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import SPACES, WORD_BREAK, join_uneven, written

#: The limits of the five filters.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 2, "[#$%&*|]"
FILTERS = "ABCDE"


def text_failures() -> dict[str, Column]:
    """What fails the filters that look at one text: few words, few distinct words, many capitals, a symbol."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bare = F.btrim(text, F.lit(SPACES))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WORD_BREAK))
    n = F.size(words)
    return {
        "A": n < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * n,
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > MOST_CAPITALS * F.length(text),
        "D": text.rlike(SYMBOLS),
    }


def document_flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A, B, C, D, E, good, toxic) of every row of docs, as a table.

    E is a text that a smaller doc_id has, too. part is the source, empty where it is null; a null text is an empty
    one. A row without doc_id has no smaller one, no label, and is no one's smaller one. Of several labels of a
    document each counts. Texts are compared by their SHA-256.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    part = F.coalesce(F.col("source").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.alias("part"), *[c.alias(k) for k, c in text_failures().items()], F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    own = written(own, "audit-texts")
    groups = own.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    found = join_uneven(own, written(groups, "audit-copies"), ["digest"], "copies", own.count(), "doc_id")
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    flagged = found.join(marks, "doc_id", "left").withColumn("E", F.col("doc_id") > F.col("first"))
    return written(flagged.select("part", *[F.coalesce(c, F.lit(False)).alias(c) for c in (*FILTERS, "good", "toxic")]), "audit-flags")


def _leaving(survivors: DataFrame, state: tuple[str, ...], left: list[str]) -> DataFrame:
    """(part, state, filter, kept, removed, good_lost, toxic_lost, only) of the edges from a state, counted on its survivors."""
    count = lambda c: F.count_if(c)
    edges = []
    for f in left:
        fails, others = F.col(f), [F.col(x) for x in left if x != f]
        alone = fails
        for x in others:
            alone = alone & ~x
        edges.append(F.struct(
            F.lit("".join(state)).alias("state"), F.lit(f).alias("filter"), count(~fails).alias("kept"), count(fails).alias("removed"),
            count(fails & F.col("good")).alias("good_lost"), count(fails & F.col("toxic")).alias("toxic_lost"), count(alone).alias("only"),
        ))
    return survivors.groupBy("part").agg(F.array(*edges).alias("edges")).select("part", F.inline("edges"))


def counted_edges(flags: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The counts of every edge of the trie of orders, with each state made once; 2 ** len(filters) - 1 small jobs."""
    tables: list[str] = []
    seen: set[frozenset[str]] = set()

    def visit(survivors: DataFrame, state: frozenset[str]) -> None:
        seen.add(state)
        left = [f for f in filters if f not in state]
        survivors.persist(StorageLevel.MEMORY_AND_DISK)
        tables.append(written(_leaving(survivors, tuple(sorted(state)), left), "audit-edges").written_to)
        for f in left:
            below = state | {f}
            if len(below) < len(filters) and below not in seen:
                visit(survivors.where(~F.col(f)), below)
        survivors.unpersist()

    visit(flags, frozenset())
    return flags.sparkSession.read.parquet(*tables)


def interactions(flags: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of flagged rows.

    A row for each part, order of the filters and step in it, zeros included; no part, no rows. redundant counts
    rows that fail the step's filter and went before; unique_fails those that fail no other filter; shapley is what
    the filter removes in all orders together.
    """
    edges = counted_edges(flags, filters)
    n = len(filters)
    # An order of the filters passes through a state and then a filter as often as both sides can be arranged.
    orders = F.element_at(F.array(*[F.lit(factorial(i) * factorial(n - 1 - i)) for i in range(n)]), F.length("state") + 1)
    whole = edges.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("state") == "", F.col("removed"))).alias("fails"), F.sum(F.when(F.col("state") == "", F.col("only"))).alias("unique_fails"), F.sum(orders * F.col("removed")).alias("shapley")
    )
    steps = [("".join(p), i + 1, "".join(sorted(p[:i])), p[i]) for p in permutations(filters) for i in range(n)]
    steps = flags.sparkSession.createDataFrame(steps, "filter_order string, step int, state string, filter string")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    found = whole.join(F.broadcast(steps), "filter").join(edges.drop("only"), ["part", "state", "filter"], "left")
    return found.select(
        "part", "filter_order", "step", zero("kept"), zero("removed"), (F.col("fails") - F.coalesce("removed", F.lit(0))).alias("redundant"), "unique_fails", zero("good_lost"), zero("toxic_lost"), "shapley"
    )


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """interactions() of the five document filters."""
    return interactions(document_flags(docs, labels))

"""The grid join, the filter audit and the resampling against brute force: nulls, empty and long texts, ties, repeated
rows, rows without ids, clashing columns, and empty tables."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from plumbline.llm import audit, common, resampling, simhash, vectorjoin

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EXTRA = ("row", "part", "score", "rank", "key", "k1", "k2", "n", "d", "id", "kept", "digest", "first", "copies", "good", "A", "E", "slice", "bucket", "gain", "raw", "node", "_sent", "_spread")


def with_extra(df):
    return df.withColumns({c: F.lit(c) for c in EXTRA if c not in df.columns})


# 11: grid join

INF, NAN = float("inf"), float("nan")


def vector_rows(d=24, seed=5):
    """Groups of near vectors around centres, chains of them, copies, and vectors that link with nothing."""
    rng = np.random.default_rng(seed)
    rows = []

    def add(v, label):
        rows.append([len(rows), None if v is None else [None if x is None else float(x) for x in v], label])

    for _ in range(40):
        centre = rng.normal(size=d)
        for _ in range(rng.integers(1, 9)):
            add(np.float32((centre + rng.normal(size=d) * rng.choice([0.01, 0.05, 0.1, 0.13])) * rng.choice([1e-3, 1, 50])), int(rng.integers(0, 3)))
    start = rng.normal(size=d)
    for i in range(30):  # a chain: neighbours are linked, ends aren't
        start = start / np.linalg.norm(start) + rng.normal(size=d) * 0.03
        add(np.float32(start), 7)
    for i in range(60):
        add(np.float32(rows[3][1]), rows[3][2])
    for v in (None, [], [0.0] * d, [NAN] + [1.0] * (d - 1), [INF] + [1.0] * (d - 1), [None] + [1.0] * (d - 1), [-0.0] + [1.0] * (d - 1), [0.0] + [1.0] * (d - 1), [1e30] * d, [1e-30] * d, [1.0], [5.0], [1.0, 0.0]):
        add(v, 1)
    add(rows[3][1], None)
    add(rows[3][1], None)
    return rows


def vector_links(rows, threshold):
    able = {}
    for k, (_, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            able[k] = np.array(v, np.float32).astype(float)
    links = collections.defaultdict(set)
    for a, b in itertools.combinations(able, 2):
        x, y = able[a], able[b]
        if rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
            links[a].add(b)
            links[b].add(a)
    return links


def vector_wanted(rows, threshold):
    links, out = vector_links(rows, threshold), []
    for k, (vec, *_) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        ids = [rows[i][0] for i in seen if rows[i][0] is not None]
        least = min(ids, default=None)
        out.append((vec, len(links[k]), least, least is not None and least == vec))
    return collections.Counter(out)


def vectors(spark, rows):
    return with_extra(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))


@pytest.mark.parametrize(("threshold", "block", "leaf", "fan"), [(0.98, 1024, 128, 16), (0.98, 16, 4, 2), (0.9, 32, 8, 3), (1.0, 1024, 128, 16)])
def test_vectors_equal_brute_force(spark, monkeypatch, threshold, block, leaf, fan):
    for name, value in (("BLOCK", block), ("LEAF", leaf), ("FAN", fan), ("RANGE", 64)):
        monkeypatch.setattr(vectorjoin, name, value)
    rows = vector_rows()
    found = collections.Counter(map(tuple, vectorjoin.near_vectors(vectors(spark, rows).repartition(3), threshold).collect()))
    if threshold == 1:  # links of equal vectors are certain, others are a matter of the last bit
        assert found[(3, 60, 3, True)] == 1 and found.total() == len(rows)
    else:
        assert found == vector_wanted(rows, threshold)


def test_vectors_without_ids_and_with_shared_ones(spark):
    rows = vector_rows()
    for k in (2, 5, 3, 40):
        rows[k][0] = None
    rows[50][0] = rows[51][0] = rows[90][0]
    rows += rows[:20]
    assert collections.Counter(map(tuple, vectorjoin.near_vectors(vectors(spark, rows)).collect())) == vector_wanted(rows, 0.98)


def test_vectors_of_doubles_and_none(spark):
    rows = [(1, [1e200, 1.0], 0), (2, [1e200, 2.0], 0), (3, [1e-200, 0.0], 0), (4, [0.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, vectorjoin.near_vectors(df).collect())) == [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True)]
    assert vectorjoin.near_vectors(df.limit(0)).collect() == []
    assert sorted(map(tuple, vectorjoin.near_vectors(df.withColumn("label", F.lit(None).cast("int"))).collect())) == [(i, 0, i, True) for i in (1, 2, 3, 4)]
    with pytest.raises(ValueError, match="threshold"):
        vectorjoin.near_vectors(df, 0.0)


def test_far_intervals_are_not_joined(spark, monkeypatch):
    """The tree leaves out most pairs of blocks, and no vector's row comes out for each of its links."""
    for name, value in (("BLOCK", 64), ("FAN", 4), ("RANGE", 512)):
        monkeypatch.setattr(vectorjoin, name, value)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(200, 16))
    rows = [(i, np.float32(centres[i % 200] + rng.normal(size=16) * 0.01).tolist(), 0) for i in range(4000)]
    held = []
    monkeypatch.setattr(vectorjoin, "block_pairs", lambda *a, real=vectorjoin.block_pairs: held.append(real(*a)) or held[-1])
    out = vectorjoin.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert out.where("n_links = 19").count() == 4000
    blocks = 4000 / 64
    assert held[0].count() < 0.6 * blocks * blocks / 2


# 12: filter audit


def audit_rows():
    rng = random.Random(4)
    rows = []
    for i in range(150):
        words = [rng.choice(["the", "The", "LOUD", "x", "é", "日本", "of", "and"]) + str(rng.randrange(rng.choice([2, 400]))) for _ in range(rng.choice([0, 1, 50, 199, 200, 260]))]
        text = rng.choice([" ", "\n", "\t\x0b "]).join(words) + rng.choice(["", "", " #", "&", "*"])
        rows.append((i, text if i % 6 else rows[-1][1] if rows else text, rng.choice(["s1", "s2", "", None])))
    rows += [(200, None, None), (201, "", "s1"), (202, None, "s9"), (203, "Ab " * 50_000, "s2"), (5, rows[5][1], "s1"), (5, "other", "s2"), (None, rows[7][1], "s1"), (None, None, None)]
    return rows


def audit_wanted(rows, labels):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    marks = collections.defaultdict(set)
    for i, q, x in labels:
        marks[i] |= {"good"} if q == 1 else set()
        marks[i] |= {"toxic"} if x == 1 else set()
    flagged = []
    for i, t, s in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": bool(set("#$%&*|") & set(t)), "E": i is not None and t in least and i > least[t]}
        flagged.append((s or "", {k for k, v in fails.items() if v}, marks[i] if i is not None else set()))
    out, sums = {}, collections.Counter()
    for part in {p for p, *_ in flagged}:
        for order in itertools.permutations("ABCDE"):
            left = [x for x in flagged if x[0] == part]
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                sums[part, f] += len(gone)
                own = [x for x in flagged if x[0] == part]
                out[part, "".join(order), step] = (len(left), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == {f} for x in own), sum("good" in x[2] for x in gone), sum("toxic" in x[2] for x in gone))
    return {k: (*v, sums[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(common, "LARGE", 20)  # some groups of equal texts are large, some aren't
    rows = audit_rows()
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 150, 2)] + [(3, 1, None), (3, 0, 1), (None, 1, 1)]
    docs = with_extra(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    found = audit.audit_documents(docs.repartition(3), with_extra(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COUNTS) for r in found}
    assert len(found) == len(got)
    assert got == audit_wanted(rows, labels)


def test_audit_makes_each_state_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(audit, "_leaving", lambda survivors, state, left, real=audit._leaving: made.append(state) or real(survivors, state, left))
    docs = spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit_documents(docs, labels).count() == 600
    assert len(made) == len(set(made)) == 31
    assert audit.audit_documents(docs.limit(0), labels).collect() == []


# 13: resampling


def draw_rows():
    rng = random.Random(9)
    words = ["the", "Of", "été", "naïve", "x1", "日本", "queue"] + [f"w{i}" for i in range(60)]
    rows = [(i, rng.choice([" ", "-", "_", "\n"]).join(rng.choice(words) for _ in range(rng.choice([0, 3, 19, 20, 21, 80])))) for i in range(200)]
    return [*rows, (300, None), (301, ""), (302, "-- !"), (303, "y " * 40_000), (None, rows[5][1]), (None, None), (7, rows[7][1]), (7, rows[9][1])]


def draw_wanted(rows, target, longest=1, percent=10, least=20):
    def found(text):
        low = (text or "").translate({i: i + 32 for i in range(65, 91)})
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s = collections.Counter(bucket(f) for _, t in rows for f in found(t)[1])
    t = collections.Counter(bucket(f) for _, x in target for f in found(x)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000)))) for b in s}
    out = []
    for i, text in rows:
        words, own = found(text)
        weight = sum(gain[bucket(f)] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return collections.Counter(tuple(r[:5]) for r in out)


@pytest.mark.parametrize(("longest", "percent"), [(1, 10), (2, 75)])
def test_draw_equals_brute_force(spark, monkeypatch, longest, percent):
    for name, value in (("BLOCK", 16), ("POSTINGS", 100), ("RANGES", 3)):
        monkeypatch.setattr(resampling, name, value)
    rows, target = draw_rows(), [(0, "the queue of W1 w2 w3"), (1, None), (2, "été " * 50)]
    docs = with_extra(spark.createDataFrame(rows, "doc_id long, text string")).repartition(5)
    found = resampling.resample(docs, with_extra(spark.createDataFrame(target, "item_id long, text string")), longest=longest, percent=percent)
    assert collections.Counter(map(tuple, found.collect())) == draw_wanted(rows, target, longest, percent)


def test_a_task_holds_few_blocks_of_postings(spark, monkeypatch):
    for name, value in (("BLOCK", 16), ("GROUP", 4096)):
        monkeypatch.setattr(resampling, name, value, raising=False)
    rows = [(i, " ".join(f"w{i * 31 + j}" for j in range(60))) for i in range(160)]
    found = resampling.document_postings(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    groups = [part.row_group(g).num_rows for f in found.inputFiles() for part in [pq.ParquetFile(f.removeprefix("file://")).metadata] for g in range(part.num_row_groups)]
    assert sum(groups) == 10
    assert max(groups) <= 2


def test_draw_of_empty_tables(spark):
    rows = draw_rows()
    docs, none = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert collections.Counter(map(tuple, resampling.resample(docs, none).collect())) == draw_wanted(rows, [])
    assert resampling.resample(docs.limit(0), none).collect() == []
    drawn = resampling.draw(with_extra(docs), none, percent=50)
    assert set(drawn.columns) == set(with_extra(docs).columns)
    assert {r["doc_id"] for r in drawn.collect()} == {k[0] for k in draw_wanted(rows, [], percent=50) if k[4] and k[0] is not None}


def test_uneven_join_keeps_every_row(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)] + [(None, "hot"), (None, None)], "id long, key string")
    groups = spark.createDataFrame([("hot", 200, "h"), ("k3", 1, "three"), ("none", 5, "n")], "key string, n long, said string")
    for total in (300, 10**9):
        found = common.join_uneven(rows, groups, ["key"], "n", total, "id")
        want = collections.Counter((i, k, {"hot": "h", "k3": "three"}.get(k)) for i, k in map(tuple, rows.collect()))
        assert collections.Counter(map(tuple, found.select("id", "key", "said").collect())) == want


# 6: near fingerprints by block tables


@pytest.mark.parametrize(("block", "together", "radius"), [(2048, 1 << 16, 7), (16, 40, 7), (8, 1, 3), (2048, 100, 0)])
def test_near_documents_equal_all_pairs(spark, monkeypatch, block, together, radius):
    """Copies, groups of near fingerprints, fronts of many, words that meet in several tables, and rows without ids."""
    for name, value in (("BLOCK", block), ("TOGETHER", together)):
        monkeypatch.setattr(simhash, name, value)
    monkeypatch.setattr(common, "LARGE", 20)
    rng = random.Random(2)
    marks = []
    for _ in range(12):
        base = rng.getrandbits(256)
        for _ in range(rng.choice([1, 4, 30])):
            mark = base
            for _ in range(rng.randrange(11)):
                mark ^= 1 << rng.randrange(rng.choice([32, 256]))
            marks.append(mark)
    marks += [0] * 40 + [1, 3, 7 << 250, (1 << 256) - 1] + rng.choices(marks, k=20)
    rows = [(i if i % 9 else None, f"{m:064x}") for i, m in enumerate(marks)]
    got = simhash.with_near_docs(spark.createDataFrame(rows, "doc_id long, fingerprint string").repartition(3), radius).collect()
    want = collections.Counter((d, f, sum((a ^ m).bit_count() <= radius for a in marks) - 1) for (d, f), m in zip(rows, marks, strict=True))
    assert collections.Counter((r["doc_id"], r["fingerprint"], r["near_docs"]) for r in got) == want
    assert simhash.with_near_docs(spark.createDataFrame([], "doc_id long, fingerprint string")).count() == 0
    with pytest.raises(ValueError, match="radius"):
        simhash.near_counts(spark.createDataFrame(rows, "doc_id long, fingerprint string"), 8)

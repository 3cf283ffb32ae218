"""Each corpus operator against a brute-force version, on texts that are null, empty, long, repeated or tied, with
further columns whose names clash with the operators' own, and on empty tables."""

import base64
import collections
import hashlib
import os
import random
import re
import sys
import time
import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from plumbline.llm import bpe, common, divergence, hypergeometric, linededup, mixing, neardup, quality, repeats, secrets, sharding, simhash
from plumbline.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EXTRA = ("score", "kept", "part", "row", "size", "key", "a", "b", "n", "order", "id", "content", "words", "shard", "target", "stream")
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def low(text):
    return text.translate({i: i + 32 for i in range(65, 91)})


def make_rows():
    rng = random.Random(8)
    words = ["the", "of", "Und", "queue", "été", "naïve,", "x", "12", "#tag", "don't", "日本", "a|b", "$5", "<p>"]
    sentence = lambda n: " ".join(rng.choice(words) + (rng.choice("abcdefg") * rng.randint(0, 3)) for _ in range(n))
    base = [sentence(n) for n in (3, 8, 30, 60, 90, 140)]
    shared = "A line that many documents share, long enough to matter to every rule there is. " * 2
    rows = []
    for i in range(140):
        text = rng.choice(base)
        if i % 3 == 0:
            parts = text.split(" ")
            parts[rng.randrange(len(parts))] = "changed"
            text = " ".join(parts)
        if i % 4 == 0:
            text += "\n" + shared + "\n\n  Some LINE \n" + sentence(rng.randint(1, 40))
        if i % 5 == 0:
            text = sentence(rng.randint(1, 200)) + ' password = "abcdefgh1234" AKIAABCDEFGHIJKLMN ' + "deadbeef" * 5 + "\n"
        rows.append((i, text, ("en", "de", None, "xx")[i % 4], ("s1", "s2", "ß", None)[i % 4 if i % 7 else 0]))
    rows += [(500, None, None, None), (501, "", "en", "s1"), (502, "   \n\t ", "en", "s1"), (503, "one", "en", "s3"), (504, "y " * 30000, "en", "s2"), (505, "é" * 5000 + "\n" * 300, "fr", "s2"), (506, "x\x00y " * 60, "en", "s2")]
    return rows


ROWS = make_rows()
TEXTS = {i: t or "" for i, t, _, _ in ROWS}


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({name: F.lit(name) for name in EXTRA})


@pytest.fixture(scope="module")
def docs(spark):
    df = frame(spark, ROWS).repartition(3).persist()
    df.count()
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def by_id(df):
    rows = df.collect()
    assert len(rows) == len(ROWS)
    return {r["doc_id"]: r for r in rows}


# 1: factorisation machine


def labelled(spark):
    good = [(i, " ".join(f"word{(i * j) % 17} of the day," for j in range(1, 30)) + ".", 1) for i in range(300)]
    bad = [(1000 + i, "BUY NOW!! " * 20 + "$$$ ### " * (i % 9 + 1), 0) for i in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, q, 0) for i, _, q in good + bad], "doc_id long, quality int, toxic int")


def test_classifier_tells_held_out_documents(spark):
    docs, labels = labelled(spark)
    model = quality.learn(docs, labels)
    scored = quality.score_documents(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in scored)
    assert np.mean([r["predicted"] == r["quality"] for r in scored]) >= 0.95
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in quality.score_documents(docs, model).where("predicted = 1").collect()}


def test_sum_of_squares_equals_all_pairs():
    rng = np.random.default_rng(1)
    model = quality.FactorisationMachine(0.3, rng.normal(size=50), rng.normal(size=(50, 4)), np.zeros((0, 0)))
    ids, x = rng.choice(50, 12, replace=False), rng.normal(size=12)
    pairs = sum(model.factors[ids[i]] @ model.factors[ids[j]] * x[i] * x[j] for i in range(12) for j in range(i))
    assert model.margin(ids, x) == pytest.approx(0.3 + model.linear[ids] @ x + pairs)


def plain_description(data):
    """Word weights by bucket and the statistics, each by its definition."""
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", data) if w]
    n, size = max(1, len(words)), max(1, len(data))
    weights = collections.Counter()
    for w in set(words):
        bucket = zlib.crc32(w.strip(b".,;:!?\"'()").lower()) % quality.BUCKETS
        weights[(bucket, w)] = (words.count(w) / n) ** 0.5
    count = lambda of: sum(b in of for b in data) / size
    upper, lower, digit, space, mark, point = map(count, (bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b" \t\n\x0b\x0c\r", b"#*$%&|<>", b".,;:!?"))
    lines = [x for x in data.split(b"\n") if x.strip()]
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    return weights, [
        np.log(1 + len(data)), np.log(1 + len(words)), len(data) * (1 - space) / n, upper, digit, mark, point, 1 - upper - lower - digit - space - mark - point, len(set(words)) / n,
        max((words.count(w) for w in set(words)), default=0) / n, 1 - len(set(lines)) / max(1, len(lines)), 1 - len(set(triples)) / len(triples) if triples else 0.0, np.log(1 + size / max(1, len(lines))), data.count(b"!!") / n,
    ]


def test_scores_are_those_of_all_pairs(spark):
    """Scores of the DataFrame against statistics and interactions written out."""
    rng = random.Random(21)
    words = ["the", "The,", "a", "B1", "x!!", "#", "été", "12", "(end)."]
    texts = ["", " \n", "one"] + [" ".join(rng.choices(words, k=rng.randint(1, 40))) + rng.choice(["", "\n", "\nline\nline"]) for _ in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, None), (3, texts[9]), (3, texts[9])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int("the" in t.lower()), 0) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int")
    model = quality.learn(docs, labels)
    assert np.abs(model.factors).max() > 0.1

    def score(text):
        weights, statistics = plain_description(text.encode())
        x = [(bucket, w) for (bucket, _), w in weights.items()]
        x += [(quality.BUCKETS + i * quality.BINS + sum(e <= v for e in model.edges[i]), len(statistics) ** -0.5) for i, v in enumerate(statistics)]
        pairs = sum(float(model.factors[i] @ model.factors[j]) * a * b for at, (i, a) in enumerate(x) for j, b in x[:at])
        return 1 / (1 + np.exp(-(model.bias + sum(model.linear[i] * a for i, a in x) + pairs)))

    rows = quality.score_documents(docs, model).collect()
    want = sorted([(i, score(t)) for i, t in enumerate(texts)] + [(-1, score("")), (3, score(texts[9])), (3, score(texts[9]))])
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["score"]) for r in rows)
    assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([x for _, x in got], [x for _, x in want], atol=1e-5)


def test_classifier_edges(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.learn(docs, none)
    assert {r["score"] for r in quality.score_documents(docs, model).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(None, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    rows = by_id(quality.score_documents(docs, quality.learn(docs, one)))
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows.values())
    assert quality.score_documents(empty, model).count() == 0
    assert quality.keep_good(empty, quality.learn(empty, none)).columns == empty.columns


# 2: near-duplicates


def brute_components(rows, width):
    def shingles(t):
        w = WORD.findall(low(t))
        return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()

    sets = {i: shingles(t or "") for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                a, b = root(x), root(y)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(docs, width):
    rows = by_id(neardup.near_duplicates(docs, width))
    want = brute_components([(i, t) for i, t, _, _ in ROWS], width)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in rows.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in rows.items())


def test_near_duplicates_chain_is_followed_through_a_hot_bucket(spark):
    """Texts that drift word by word: neighbours are near, the ends aren't; all are one component."""
    words = [f"w{i}" for i in range(120)]
    rows = []
    for step in range(60):
        rows.append((step, " ".join(words)))
        words[(step * 7) % 120] = f"new{step}"
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert got == {i: c for i, (_, c) in brute_components(rows, 4).items()}


def test_bands_find_pairs_of_the_threshold():
    """Of pairs at 0.8 exactly, at least 0.99 share a band, and their sketches are near; of pairs at 0.5 few do."""
    rng, bands = np.random.default_rng(5), lambda m: m.reshape(neardup.BANDS, neardup.ROWS)
    met = {}
    for similar, n, both in ((0.8, 900, 800), (0.5, 900, 600)):
        found = 0
        for _ in range(400):
            pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            x, y = (bands(neardup.minhash(p)) for p in (pool[:n], np.concatenate([pool[:both], pool[n : 2 * n - both]])))
            apart = int(np.bitwise_count((neardup.odd_sketch(x.ravel()) ^ neardup.odd_sketch(y.ravel())).view(np.uint64)).sum())
            found += bool((x == y).all(axis=1).any()) and apart <= neardup.APART
        met[similar] = found / 400
    assert met[0.8] >= 0.99 and met[0.5] <= 0.25


@pytest.mark.parametrize(("least", "together"), [(4, 8), (1 << 8, 1 << 12)])
def test_members_of_open_buckets_meet(monkeypatch, least, together, spark):
    """Groups that overlap in one hot bucket: every link between components is found, over blocks, too."""
    monkeypatch.setattr(neardup, "LEAST_ROWS", least)
    monkeypatch.setattr(neardup, "MOST_ROWS", 4 * least)
    monkeypatch.setattr(neardup, "TOGETHER", together)
    rng = random.Random(12)
    base = [f"b{i}" for i in range(70)]
    rows = []
    for group in range(12):
        own = base + [f"g{group}x{i}" for i in range(18)]
        for i in range(6):
            rows.append((len(rows), " ".join(own + [f"{rng.choice('abc')}{i % 3}"])))
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    want = {i: c for i, (_, c) in brute_components(rows, 4).items()}
    assert got == want and 12 <= len(set(want.values())) < len(rows)
    # All in one bucket, of a component each.
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    own = neardup.sketches(docs, 4).select(F.col("doc_id").alias("id"), "n", "sketch").persist()
    links = neardup._across(docs, own.select(F.lit(1).cast("long").alias("key"), "id"), own.select("id", F.col("id").alias("component")).limit(40), own, 4, 80)
    component = {r["id"]: r["component"] for r in connected_components(links).collect()}
    assert {i: component.get(i, i) for i in want} == want


def test_near_duplicates_edges(spark, empty, docs):
    assert neardup.near_duplicates(empty).count() == 0
    text = "a b c d e f g h"
    rows = spark.createDataFrame([(None, text), (None, text), (7, text), (7, text), (3, text), (9, "z z"), (9, text)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"] if r["component_id"] is not None else -1, r["kept"]) for r in neardup.near_duplicates(rows).collect())
    assert got == [(-1, -1, True), (-1, -1, True), (3, 3, True), (7, 3, False), (7, 3, False), (9, 3, False), (9, 3, False)]
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in brute_components([(i, t) for i, t, _, _ in ROWS], 5).items() if i == c}


def test_odd_sketch_estimates_similarity():
    rng = np.random.default_rng(3)
    errors = []
    for similar in (0.75, 0.8, 0.9, 0.97):
        for _ in range(20):
            n = 1000
            both = int(2 * n * similar / (1 + similar))
            pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            a, b = pool[:n], np.concatenate([pool[:both], pool[n : 2 * n - both]])
            apart = sum(int(x ^ y).bit_count() for x, y in zip(*(neardup.odd_sketch(neardup.minhash(s)).view(np.uint64) for s in (a, b)), strict=True))
            errors.append(neardup.estimate(apart) - similar)
            assert apart <= neardup.APART
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, 5000)]
    up = {x: x for pair in links for x in pair}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up if x in got} and all(x in got for a, b in links if a != b for x in (a, b))


# 3: repeats


def brute_repeats(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        data = (t or "").encode()
        covered = np.zeros(len(data), bool)
        for at in range(len(data) - 99):
            if data[at : at + 100] in seen:
                covered[at : at + 100] = True
            seen.add(data[at : at + 100])
        kept = np.frombuffer(data, np.uint8)[~covered].tobytes()
        out[i] = (len(data), int(covered.sum()), int((np.diff(covered.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept)
    return out


@pytest.mark.parametrize("hot", [repeats.HOT, 1])
def test_repeats(docs, hot):
    got = by_id(repeats.remove_repeats(docs, hot))
    want = brute_repeats([(i, t) for i, t, _, _ in ROWS])
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["content"])) for i, r in got.items()} == want


def test_repeats_edges(spark, empty):
    assert repeats.remove_repeats(empty).count() == 0
    text = "".join(random.Random(1).choices("abcdefghijklmnop", k=150))
    rows = [(2, text), (1, text), (None, text), (4, text[:99]), (5, text[:100])]
    got = {r["doc_id"]: r["n_removed"] for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 150, None: 150, 4: 0, 5: 100}
    twice = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    assert [r["n_removed"] for r in repeats.remove_repeats(twice).collect()] == [0, 0]


@pytest.mark.parametrize("hot", [repeats.HOT, 1])
def test_repeats_of_rows_that_share_an_id(spark, hot):
    """Each row loses what it repeats, and nothing that another row of its id repeats."""
    rng = random.Random(17)
    noise = lambda n: "".join(rng.choices("abcdefghijklmnop", k=n))
    once, both = noise(150), noise(120)
    texts = [(1, once + noise(80)), (None, once + noise(200)), (None, noise(400)), (None, noise(150)), (7, noise(200) + both), (7, noise(200) + both), (9, once), (9, noise(160))]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"]) for r in repeats.remove_repeats(rows, hot).collect())
    assert got == [(-1, 150, 0), (-1, 350, 150), (-1, 400, 0), (1, 230, 0), (7, 320, 0), (7, 320, 120), (9, 150, 150), (9, 160, 0)]


def test_repeats_with_a_full_filter(spark, monkeypatch):
    """Triggers above and below hot, where the filter of hot phrases lets much through."""
    monkeypatch.setattr(repeats, "BLOOM", 1)
    rng = random.Random(31)
    noise = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    frequent = [noise(90) for _ in range(12)]
    texts = ["".join(noise(90) + x for x in frequent) for _ in range(1200)]
    for _ in range(150):
        shared = noise(130)
        texts += [noise(80) + shared + noise(80) for _ in range(2)]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r["kept_sha256"] for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 200).collect()}
    assert got == {i: r[3] for i, r in brute_repeats(rows).items()}


def test_phrases_hold_each_string_once(monkeypatch):
    """Also where a long text is cut into stretches."""
    monkeypatch.setattr(repeats, "STRETCH", 700)
    monkeypatch.setattr(repeats, "BUFFER", 500)
    rng = random.Random(5)
    texts = [bytes(rng.choice(b"abc ") for _ in range(n)) for n in (50, 100, 101, 650, 3000)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.binary())], ["d", "t"])
    starts = collections.Counter((int(d), s) for parse in repeats.parses(iter([batch])) for d, low, high in zip(parse.doc, parse.start, parse.end, strict=True) for s in range(low, high - 99))
    assert starts == collections.Counter({(i, s): 1 for i, t in enumerate(texts) for s in range(len(t) - 99)})


# 4: quality rules


def test_quality_rules(docs, empty):
    got = by_id(divergence.quality_rules(docs))
    for i, text in TEXTS.items():
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        windows = [tuple(words[j : j + 8]) for j in range(len(words) - 7)]
        often = collections.Counter(windows)
        repeated = {k for j, w in enumerate(windows) if often[w] > 1 for k in range(j, j + 8)}
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)), i
        assert r["base_failed"] == (len(words) < 20 or 100 * len(repeated) > 30 * len(words))
        assert not (r["base_failed"] and r["kept"])
    assert divergence.quality_rules(empty).count() == 0


def test_distances_are_jensen_shannon(spark):
    plain = " ".join(["the cat of a house and the dog, to be in that"] + [f"word{i} the" for i in range(60)])
    odd = "### $$$ %%% " * 40 + " ".join(f"Z{i}!!" for i in range(60))
    rows = [(i, plain + f" tail{i}", "en") for i in range(30)] + [(99, odd, "en")]
    got = {r["doc_id"]: r for r in divergence.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i]["kept"] for i in range(30)) and not got[99]["kept"]
    stats = {r["doc_id"]: np.array(r["chars"], float) for r in divergence.statistics(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    p, q = stats[99] / stats[99].sum(), sum(stats.values()) / sum(stats.values()).sum()
    m = (p + q) / 2
    kl = lambda x: sum(a * np.log2(a / b) for a, b in zip(x, m, strict=True) if a)
    assert got[99]["char_distance"] == pytest.approx(np.sqrt((kl(p) + kl(q)) / 2))


# 5: sharding


def test_shards_are_exact(docs, empty):
    rows = by_id(sharding.shard_documents(docs))
    slots = collections.defaultdict(list)
    for i, r in rows.items():
        data = TEXTS[i].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "rows", None)
        slots[r["shard"]].append(r["slot"])
    assert len(slots) == 16 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sorted(map(tuple, sharding.shard_documents(docs).collect())) == sorted(map(tuple, rows.values()))
    assert sharding.shard_documents(empty).count() == 0


def test_shards_by_brute_force(spark, monkeypatch):
    """Blocks, local permutation, exchange by the matrix and second permutation, one by one; ids repeat or are missing."""
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 20)
    rows = [(None if i % 7 == 0 else i % 50, f"text {i % 60}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    own = docs.select("doc_id", (F.length("text") + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
    hashed = [F.xxhash64(F.lit(17), F.lit(salt), "doc_id", "text_crc32", "size").alias(salt) for salt in ("block", "local", "final")]
    given = [r.asDict() for r in own.select("*", *hashed).collect()]
    blocks = 1 + 300 // 20
    place = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"])
    held = [sorted((r for r in given if r["block"] % blocks == b), key=lambda r: (r["local"], place(r))) for b in range(blocks)]
    drawn = hypergeometric.matrix(random.Random(17), [len(h) for h in held], [300 // 16 + (i < 300 % 16) for i in range(16)])
    shards = collections.defaultdict(list)
    for h, counts in zip(held, drawn, strict=True):
        for shard, n in enumerate(counts):
            shards[shard] += h[:n]
            h = h[n:]
    want = []
    for shard, members in shards.items():
        order = sorted(members, key=lambda r: ((r["final"] % (1 << 64)) >> 33, r["final"], place(r)))
        want += [(str(r["doc_id"]), r["size"], r["text_crc32"], shard, slot) for slot, r in enumerate(order)]
    got = [(str(r["doc_id"]), r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in sharding.shard_documents(docs).collect()]
    assert sorted(got) == sorted(want)


def test_shards_over_several_blocks_and_stretches(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 10)
    rows = sharding.shard_documents(spark.range(1003).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))).collect()
    places = collections.defaultdict(list)
    for r in rows:
        places[r["shard"]].append(r["slot"])
    assert sorted(map(len, places.values())) == [62] * 5 + [63] * 11 and all(sorted(s) == list(range(len(s))) for s in places.values())


def test_draws_follow_the_hypergeometric_law():
    rng = random.Random(1)
    drawn = collections.Counter(hypergeometric.draw(rng, 6, 9, 5) for _ in range(20000))
    from math import comb

    assert all(abs(drawn[k] / 20000 - comb(6, k) * comb(9, 5 - k) / comb(15, 5)) < 0.015 for k in range(6))
    assert hypergeometric.draw(rng, 10**12, 10**12, 10**9) == pytest.approx(5e8, rel=1e-3)
    table = hypergeometric.matrix(rng, [3, 0, 7, 10], [5, 5, 5, 5])
    assert [sum(r) for r in table] == [3, 0, 7, 10] and [sum(c) for c in zip(*table, strict=True)] == [5, 5, 5, 5]
    split = hypergeometric.tree(rng, [10, 0, 25], 8)
    assert [sum(c) for c in zip(*split, strict=True)] == [10, 0, 25] and max(map(sum, split)) - min(map(sum, split)) <= 1


# 6: SimHash


def test_fingerprints(docs, empty):
    got = by_id(simhash.fingerprint_documents(docs))
    order = sorted(TEXTS, reverse=True)
    marks = {}
    for at, i in enumerate(order):
        text, following = TEXTS[i], TEXTS[order[(at + 1) % len(order)]]
        k = len(text) // 3
        new = text[: len(text) - k] + following[:k]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert r["fingerprint"] == simhash.fingerprint(text).hex() and r["edited_fingerprint"] == simhash.fingerprint(new).hex()
        assert r["near_next"] == pytest.approx(simhash.likeness(simhash.fingerprint(text), simhash.fingerprint(following)))
        assert marks.setdefault(text, r["fingerprint"]) == r["fingerprint"] and 0 <= r["near_edited"] <= 1
    assert simhash.fingerprint_documents(empty).count() == 0


def test_fingerprints_of_one_document_and_of_none(spark):
    rows = simhash.fingerprint_documents(spark.createDataFrame([(None, "a b c d e f")], "doc_id long, text string")).collect()
    assert len(rows) == 1 and rows[0]["near_next"] == 1.0


@pytest.mark.parametrize(("radius", "spare"), [(3, 1), (9, 1), (4, 2)])
def test_search_finds_all_within_the_radius(spark, radius, spare):
    rng = random.Random(6)
    base = [rng.getrandbits(256) for _ in range(6)]
    marks = [(i, b"".join([(rng.choice(base) ^ sum(1 << rng.randrange(256) for _ in range(rng.randint(0, 6)))).to_bytes(33)[-32:]]).hex()) for i in range(120)]
    table = spark.createDataFrame(marks + [(200, None)], "doc_id long, fingerprint string")
    got = {(r["query_id"], r["doc_id"], r["distance"]) for r in simhash.within_radius(table.where("doc_id % 5 = 0"), table, radius, spare).collect()}
    apart = lambda x, y: (int(x, 16) ^ int(y, 16)).bit_count()
    assert got == {(i, j, apart(x, y)) for i, x in marks if i % 5 == 0 for j, y in marks if apart(x, y) <= radius}


# 7: byte-level BPE


@pytest.fixture(scope="module")
def reference_encoding():
    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tokens(docs, empty, reference_encoding):
    got = by_id(bpe.digest_documents(docs, VOCABULARY, public_tokenizers.PATTERN))
    for i, text in TEXTS.items():
        ids = reference_encoding.encode_ordinary(text)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    back = bpe.decode_documents(bpe.encode_documents(docs, VOCABULARY, public_tokenizers.PATTERN), VOCABULARY, public_tokenizers.PATTERN)
    assert {r["doc_id"]: bytes(r["content"]).decode() for r in back.collect()} == TEXTS
    assert bpe.digest_documents(empty, VOCABULARY, public_tokenizers.PATTERN).count() == 0


def test_pieces_are_encoded_exactly(reference_encoding):
    with open(VOCABULARY, "rb") as f:
        encoder = bpe.encoder(f.read(), public_tokenizers.PATTERN)
    rng = random.Random(4)
    tokens = list(encoder.ranks)
    for _ in range(4000):
        piece = rng.choice([lambda: b"".join(rng.choices(tokens, k=rng.randint(1, 5))), lambda: bytes(rng.choices(b"aabn e-=", k=rng.randint(1, 25))), lambda: rng.randbytes(rng.randint(1, 15))])()
        assert encoder.encode_piece(piece) == reference_encoding._encode_single_piece(piece)
    for c in map(chr, range(0x260)):
        for text in (c, f"a{c}{c}b1{c}1 {c} x", f" {c}'s{c}"):
            assert encoder.encode(text)[0] == reference_encoding.encode_ordinary(text)
    with pytest.raises(ValueError, match="without a token"):
        bpe.BytePairEncoder({b"a": 0}, public_tokenizers.PATTERN)


def test_a_kept_piece_is_a_short_text():
    with open(VOCABULARY, "rb") as f:
        encoder = bpe.BytePairEncoder(bpe.read_ranks(f.read()), public_tokenizers.PATTERN)
    weight = lambda v: sys.getsizeof(v) + (sum(map(weight, v)) if isinstance(v, tuple) else 0)
    ids, said = encoder.encode(" ".join(f"x{i}qzv" for i in range(3000)))
    assert said == ",".join(map(str, ids)) and encoder.encode("") == ([], "")
    assert 3000 < len(encoder._pieces) < 4000 and sum(map(weight, encoder._pieces.values())) < 100 * len(encoder._pieces)


# 8: line dedup


def test_lines(docs, empty):
    key = lambda line: low(line.strip(" \t\n\x0b\x0c\r"))
    counts = collections.Counter(k for t in TEXTS.values() for k in {key(x) for x in t.split("\n")})
    got = by_id(linededup.drop_lines(docs, linededup.LineIndex.build(docs), digest=True))
    dropped = 0
    for i, text in TEXTS.items():
        lines = text.split("\n")
        kept = [x for x in lines if not key(x) or counts[key(x)] < 10]
        dropped += len(lines) - len(kept)
        assert (got[i]["n_lines"], got[i]["n_dropped"], got[i]["kept_sha256"]) == (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    assert dropped > 50
    whole = linededup.drop_lines(docs, linededup.LineIndex.build(docs))
    assert whole.columns == docs.columns and all(r["text"] is None or r["n_chars"] == len(r["text"]) for r in whole.collect())
    assert linededup.drop_lines(empty, linededup.LineIndex.build(empty), digest=True).count() == 0


@pytest.mark.parametrize("sent", [0, 200])
def test_lines_of_more_keys_than_can_be_sent(docs, monkeypatch, sent):
    """None of the frequent keys is sent, or the most frequent ones; the others' lines are joined."""
    rows = docs.unionByName(docs.limit(40)).unionByName(docs.limit(20).withColumn("doc_id", F.lit(None).cast("long")))
    told = lambda index: sorted(map(str, linededup.drop_lines(rows, index, digest=True).collect()))
    texts = lambda index: sorted(map(str, linededup.drop_lines(rows, index).select("doc_id", "text", "n_chars").collect()))
    want, index = told(linededup.LineIndex.build(rows, 2)), linededup.LineIndex.build(rows, 2)
    whole = texts(index)
    monkeypatch.setattr(linededup, "SHARD_KEYS", 3)
    split = linededup.LineIndex.build(rows, 2)
    assert split.shards > 2 and told(split) == want
    monkeypatch.setattr(linededup, "SENT", sent)
    dropper, others = split.sent()
    assert bool(dropper.parts) == (sent > 0) and others.count() > 10
    assert told(split) == want and texts(split) == whole


def test_lines_of_rows_that_share_an_id(spark):
    """Rows of one document count once, and so do rows without an id."""
    rows = [(1, f"shared\nten rows {i % 3}") for i in range(10)] + [(2, "shared"), (2, "shared\nboth"), (None, "SHARED "), (None, "shared"), (3, "both"), (4, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda line: low(line.strip(" \t\n\x0b\x0c\r"))
    for least in (2, 3, 4):
        held = collections.Counter(k for _, k in {(i, key(x)) for i, t in rows for x in (t or "").split("\n")} if k)
        kept = [[x for x in (t or "").split("\n") if held[key(x)] < least] for _, t in rows]
        want = sorted((str(i), len((t or "").split("\n")) - len(k), hashlib.sha256("\n".join(k).encode()).hexdigest()) for (i, t), k in zip(rows, kept, strict=True))
        got = linededup.drop_lines(docs, linededup.LineIndex.build(docs, least), digest=True).collect()
        assert sorted((str(r["doc_id"]), r["n_dropped"], r["kept_sha256"]) for r in got) == want


def test_index_takes_more_shards_as_it_grows(spark, monkeypatch):
    monkeypatch.setattr(linededup, "SHARD_KEYS", 4)
    df = lambda first, last: spark.createDataFrame([(i, "\n".join(f"line {j}" for j in range(i // 2 * 2, i // 2 * 2 + 4))) for i in range(first, last)], "doc_id long, text string")
    index = linededup.LineIndex.build(df(0, 10), 2)
    grown, whole = index.insert(df(10, 80)), linededup.LineIndex.build(df(0, 80), 2)
    keys = lambda x: sorted(k for r in x.filters.collect() for k in np.frombuffer(r["keys"], np.uint64).reshape(-1, 2).tolist())
    assert grown.shards > 2 * index.shards and grown.filters.count() > index.filters.count() and keys(grown) == keys(whole)
    assert keys(grown.delete(df(10, 80))) == keys(index)


def test_index_is_reversible(spark):
    rows = [(i, f"shared\nown {i}\n" + ("rare" if i < 3 else "often")) for i in range(30)]
    df = lambda part: spark.createDataFrame(part, "doc_id long, text string")
    state = lambda index: (sorted(map(tuple, index.counts.collect())), sorted(r["keys"] for r in index.filters.collect() if r["keys"]))
    small = linededup.LineIndex.build(df(rows[:9]), 5)
    grown = small.insert(df(rows[9:]))
    whole = linededup.LineIndex.build(df(rows), 5)
    assert state(grown) == state(whole)
    assert state(grown.delete(df(rows[9:]))) == state(small)


def test_cuckoo_filter():
    rng = np.random.default_rng(9)
    keys = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    made = linededup.CuckooFilter.of(keys)
    assert made.contains(keys).all()
    assert made.contains(rng.integers(0, 1 << 63, 20000, dtype=np.uint64)).mean() < 0.002
    assert all(made.delete(int(k)) for k in keys[:2500])
    assert made.contains(keys[2500:]).all() and made.contains(keys[:2500]).mean() < 0.01


# 9: secrets


def brute_spans(text):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found + [(m.start(), 3 + i, m.end()) for i, rule in enumerate(secrets.MORE) for m in re.finditer(rule.pattern, text) if len(m[0]) >= rule.least])


@pytest.fixture(scope="module")
def scanner():
    return secrets.SecretScanner()


def test_spans_are_those_of_the_expressions(scanner):
    rng = random.Random(3)
    parts = ["password", "PassWd", "secret", "token", "api_key", "apikey", ":", "=", '"', "'", " ", "  ", "abcdefgh", "A", "AKIA", "AKIAABCDEFGH1234", "0123456789abcdef", "deadbeef" * 4, "é", "ſ", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "ghp_" + "a1" * 18, "xoxb-1234567890", "eyJhbGciOiJIUzI1.eyJzdWIiOiIxMjM0.abcdefghijkl", "AIza" + "x" * 35, "/", "\n", "tok", "\x00", "eyJ", ".", "eyJa.eyJb", "AIza", "xoxb-"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert secrets.in_code_points(text.encode(), scanner.spans(text.encode())) == brute_spans(text), text


def test_secrets(docs, empty):
    got = by_id(secrets.scan_documents(docs))
    kinds = [r.kind for r in secrets.BASE + secrets.MORE]
    for i, text in TEXTS.items():
        spans = brute_spans(text)
        told = [(r, f"{kinds[r]}:{s}:{e}") for s, r, e in spans]
        row = got[i]
        assert [row["n_assign"], row["n_access"], row["n_hex"]] == [sum(r == k for r, _ in told) for k in range(3)]
        assert row["base_sha256"] == hashlib.sha256(",".join(x for r, x in told if r < 3).encode()).hexdigest() and row["spans"] == ",".join(x for _, x in told)
    assert sum(r["n_assign"] for r in got.values()) > 10
    assert secrets.scan_documents(empty).count() == 0


def test_overlapping_matches_take_linear_time(scanner):
    """Matches that would start inside the one before them; every further byte ends such a match."""

    def took(n):
        data = b"eyJa.eyJb.eyJc.eyJ" + b"x" * n
        began = time.process_time()
        assert scanner.spans(data) == []
        return time.process_time() - began

    took(1000)
    assert min(took(200_000) for _ in range(3)) <= 2.5 * min(took(100_000) for _ in range(3))
    data = b"eyJa.eyJb." + b"z" * 50 + b".eyJ" + b"x" * 1_000_000 + b" eyJaaaaaaaaaaaaa.eyJbbbbbbbbbbbbb.zzzzzzzzzzzz"
    assert scanner.spans(data) == [(m.start(), 6, m.end()) for m in re.finditer(secrets.MORE[3].pattern.encode(), data) if len(m[0]) >= 40]
    for text in ("AKIA" * 30000, "password=" * 30000, "token:a" * 30000, "-----BEGIN " * 20000, "deadbeef" * 30000, "eyJa." * 30000):
        assert scanner.spans(text.encode()) == brute_spans(text)


def test_automaton_is_minimal():
    assert secrets.Automaton((secrets.Rule("x", "(a|b)*abb"),), floating=False).size == 5  # four states and the dead one
    with pytest.raises(ValueError, match="unexpected"):
        secrets.Automaton((secrets.Rule("x", "a)b"),), floating=False)


# all: the shared folder, and tables in it


def test_a_cluster_needs_a_shared_folder(spark):
    none = SimpleNamespace(get=lambda *given: None)
    cluster = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: none), conf=none)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(cluster)
    table = common.written(spark.range(3).withColumnRenamed("id", "x"), "some")
    assert table.count() == 3 and os.path.isdir(table.written_to)
    common.forget(table)
    assert not os.path.exists(table.written_to)


# all: rows that repeat, that share an id, or that have none


def test_rows_are_told_one_by_one(spark, reference_encoding, scanner):
    """Tokens, secrets, rules and fingerprints of rows with and without ids: as many rows as there are, each by its text."""
    texts = ["token: abcdefgh12 " + "a b c d e f g h " * 5, None, "", "one", "naïve été " * 30]
    rows = [(1, texts[0]), (1, texts[0]), (1, texts[4]), (None, texts[0]), (None, texts[0]), (None, texts[1]), (None, None), (2, texts[2]), (3, texts[3]), (0, texts[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    told = lambda df, *columns: sorted(str(tuple(r[c] for c in ("doc_id", *columns))) for r in df.collect())
    ids = lambda t: reference_encoding.encode_ordinary(t or "")
    want = sorted(str((i, len(ids(t)), sha(",".join(map(str, ids(t)))), sha(t or ""))) for i, t in rows)
    assert told(bpe.digest_documents(docs, VOCABULARY, public_tokenizers.PATTERN), "n_tokens", "ids_sha256", "decoded_sha256") == want
    kinds = [r.kind for r in secrets.BASE + secrets.MORE]
    spans = lambda t: ",".join(f"{kinds[r]}:{s}:{e}" for s, r, e in brute_spans(t or ""))
    assert told(secrets.scan_documents(docs), "spans") == sorted(str((i, spans(t))) for i, t in rows)
    words = lambda t: len(WORD.findall(t or ""))
    assert told(divergence.quality_rules(docs), "n_words", "word_chars") == sorted(str((i, words(t), sum(map(len, WORD.findall(t or ""))))) for i, t in rows)
    # Descending ids, none last, equal ones by text.
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for at, (i, t) in enumerate(order):
        k = len(t) // 3
        want.append(str((i, len(t), sha(t[: len(t) - k] + order[(at + 1) % len(order)][1][:k]), simhash.fingerprint(t).hex())))
    assert told(simhash.fingerprint_documents(docs), "n_chars", "edited_sha256", "fingerprint") == sorted(want)


# 10: mixing


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=str.encode) + ([None] if None in sizes else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    capped = {}
    while True:
        free = [s for s in order if s not in capped]
        left = sum(sizes.values()) - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3 * sizes[s] for s in over}


def test_mix(docs, empty):
    rows = by_id(mixing.mix(docs).select("row.doc_id", "row.source", "size", "source_size", "target", "taken"))
    sizes = collections.Counter()
    for i, _, _, source in ROWS:
        sizes[source] += len(WORD.findall(TEXTS[i]))
    targets, taken = brute_targets(sizes), collections.Counter()
    for i, r in rows.items():
        n = len(WORD.findall(TEXTS[i]))
        assert (r["size"], r["source_size"]) == (n, sizes[r["source"]]) and r["target"] == pytest.approx(targets[r["source"]]) and 0 <= r["taken"] <= 3 * n
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - targets[s]) <= 0.51 for s in targets)
    assert sum(t >= 3 * sizes[s] for s, t in targets.items()) >= 1
    again = mixing.mix(docs).select("row.doc_id", "taken").collect()
    assert {r["doc_id"]: r["taken"] for r in again} == {i: r["taken"] for i, r in rows.items()}
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).columns == empty.columns


def test_mix_draws_what_the_tree_gives(docs, monkeypatch):
    """Shards draw disjoint blocks, as many of each source as the tree says; without a tree nothing is taken."""
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 2)
    monkeypatch.setattr(mixing, "STRETCH", 4)
    split, tree = [], hypergeometric.tree
    monkeypatch.setattr(hypergeometric, "tree", lambda *given: split.append(tree(*given)) or split[-1])
    copies = mixing.mix(docs, shards=4).select("row.source", F.explode("copies").alias("c")).select("source", "c.*").collect()
    shards, drawn = collections.defaultdict(set), collections.defaultdict(set)
    for r in copies:
        shards[(r["source"], r["round"], r["block"])].add(r["shard"])
        drawn[(r["shard"], r["source"])].add((r["round"], r["block"]))
    assert all(len(s) == 1 for s in shards.values())
    order = sorted({r["source"] for r in copies if r["source"] is not None}) + [None]
    assert [[len(drawn[(j, s)]) for s in order] for j in range(4)] == split[0] and sum(map(sum, split[0])) > 40
    monkeypatch.setattr(hypergeometric, "tree", lambda rng, quotas, n: [[0] * len(quotas)] * n)
    assert mixing.mix(docs, shards=4).agg(F.sum("taken")).first()[0] == 0
    monkeypatch.setattr(hypergeometric, "tree", lambda rng, quotas, n: [[q // 2 if j == 0 else 0 for q in quotas] for j in range(n)])
    half = mixing.mix(docs, shards=4).select(F.sum("taken"), F.sum("size")).first()
    assert 0 < half[0] < half[1]


def test_mix_by_brute_force(docs, monkeypatch):
    """Repeated rows and rows without doc_id, too."""
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 4)
    rows = docs.unionByName(docs.limit(30)).unionByName(docs.limit(20).withColumn("doc_id", F.lit(None).cast("long")))
    given = [(r["doc_id"], r["text"] or "", r["source"]) for r in rows.collect()]
    digest = lambda x: hashlib.md5(x.encode()).hexdigest()
    sizes, blocks = collections.Counter(), collections.defaultdict(list)
    for doc, text, source in given:
        n = len(WORD.findall(text))
        sizes[source] += n
        order = digest(f"23:{'null' if doc is None else doc}:{digest(text)}")
        blocks[(source, int(int(order[:8], 16) * (1 + len(given) // 4) / 2**32))].append((order, n, doc))
    want = []
    for source, target in brute_targets(sizes).items():
        left, taken = int(target + 0.5), collections.defaultdict(int)
        for lap in range(3):
            for _, block in sorted((digest(f"23:{lap}:{b}"), b) for s, b in blocks if s == source):
                for i, (_, n, _) in enumerate(sorted(blocks[(source, block)], key=lambda x: x[:2])):
                    got = min(n, left)
                    taken[(block, i)] += got
                    left -= got
        assert left == 0
        want += [(str(doc), n, taken[(b, i)]) for s, b in blocks if s == source for i, (_, n, doc) in enumerate(sorted(blocks[(s, b)], key=lambda x: x[:2]))]
    got = [(str(r["doc_id"]), r["size"], r["taken"]) for r in mixing.mix(rows).select("row.doc_id", "size", "taken").collect()]
    assert sorted(got) == sorted(want)


def test_mixed_documents_lie_by_shard_and_place(docs, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 4)
    rows = mixing.mix(docs, shards=4).select("row.doc_id", F.explode("copies").alias("c")).select("doc_id", "c.shard", "c.place").collect()
    want = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["shard"], r["place"]))]
    mixed = mixing.mixed_documents(docs, shards=4)
    assert mixed.columns == docs.columns
    got = [r["doc_id"] for r in mixed.collect()]
    empty = [i for i, t in TEXTS.items() if not WORD.search(t)]
    assert [i for i in got if i not in empty] == want and sorted(map(str, (i for i in got if i in empty))) == sorted(map(str, empty))
    assert set(collections.Counter(got).values()) <= {1, 2, 3}

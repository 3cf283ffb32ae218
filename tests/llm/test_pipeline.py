"""The pipeline's stages over a small set of tables, each on what the one before it has kept."""

import base64
import collections
import hashlib
import random

import corpus_pipeline
import public_tokenizers
import pytest
import test_corpus_operators as brute
import tiktoken

import __spark_entry__
from plumbline.llm import mixing, neardup, quality


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(11)  # each document has words of its own
    good = [(i, "\n".join(["Shared header line of all pages", f"Document {i} tells " + " ".join(f"the word{rng.randrange(97)} of it," for _ in range(60)) + "."]), "en", f"s{i % 3}", 0) for i in range(120)]
    copies = [(300 + i, good[i][1] + " end", "en", "s1", 0) for i in range(10)]
    bad = [(1000 + i, "BUY NOW!! " * 30 + "$$$ ### " * (i % 9 + 1), "en", "s2", 0) for i in range(60)]
    docs = spark.createDataFrame(good + copies + bad + [(5000, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, *_ in good] + [(i, 0, 0) for i, *_ in bad], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root


def held_to_brute_force(spark, tables, given, seen):
    """What each stage keeps of its own input, by plain versions of the operators."""
    ids = lambda rows: collections.Counter(r["doc_id"] for r in rows)
    docs = spark.createDataFrame(given["quality_classifier"], "doc_id long, text string, lang string, source string, n_chars long")
    model = quality.learn(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    assert ids(seen["quality_classifier"]) == ids(r for r in given["quality_classifier"] if model.score((r["text"] or "").encode()) >= 0.3)

    key = lambda line: brute.low(line.strip(" \t\n\x0b\x0c\r"))
    held = collections.Counter(k for r in given["line_dedup"] for k in {key(x) for x in (r["text"] or "").split("\n")} if k)
    kept = lambda t: t if t is None else "\n".join(x for x in t.split("\n") if held[key(x)] < 10)
    assert {r["doc_id"]: r["text"] for r in seen["line_dedup"]} == {r["doc_id"]: kept(r["text"]) for r in given["line_dedup"]}

    components = brute.brute_components([(r["doc_id"], r["text"]) for r in given["minhash_near_dedup"]], 5)
    assert ids(seen["minhash_near_dedup"]) == ids(r for r in given["minhash_near_dedup"] if components[r["doc_id"]][1] == r["doc_id"])

    copies, rows = collections.Counter(), given["source_mixing"]
    sizes = collections.Counter()
    digest = lambda x: hashlib.md5(x.encode()).hexdigest()
    blocks = collections.defaultdict(list)
    for r in rows:
        n = len(brute.WORD.findall(r["text"] or ""))
        sizes[r["source"]] += n
        copies[r["doc_id"]] += n == 0
        order = digest(f"23:{r['doc_id']}:{digest(r['text'] or '')}")
        blocks[(r["source"], int(int(order[:8], 16) * (1 + len(rows) // mixing.BLOCK_ROWS) / 2**32))].append((order, n, r["doc_id"]))
    for source, target in brute.brute_targets(sizes).items():
        left = int(target + 0.5)
        for lap in range(3):
            for _, block in sorted((digest(f"23:{lap}:{b}"), b) for s, b in blocks if s == source):
                for _, n, doc in sorted(blocks[(source, block)]):
                    copies[doc] += min(n, left) > 0
                    left -= min(n, left)
    assert ids(seen["source_mixing"]) == +copies


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "line_dedup", "minhash_near_dedup", "source_mixing", "bpe_encoding"]
    seen, given = {}, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        given[name] = docs.collect()
        out = stage(spark, docs, tables)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        seen[name] = docs.collect()
    held_to_brute_force(spark, tables, given, seen)
    ids = {name: {r["doc_id"] for r in rows} for name, rows in seen.items()}
    assert set(range(120)) <= ids["quality_classifier"] and not ids["quality_classifier"] & set(range(1000, 1060))
    assert ids["line_dedup"] == ids["quality_classifier"] and all("Shared header" not in (r["text"] or "") for r in seen["line_dedup"])
    assert not ids["minhash_near_dedup"] & set(range(300, 310)) and set(range(120)) <= ids["minhash_near_dedup"]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, tables)
    with open(brute.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = collections.Counter((r["doc_id"], len(encoding.encode_ordinary(r["text"] or "")), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in docs.collect())
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in last.collect()) == want


def test_run_and_entries(spark, tables):
    assert corpus_pipeline.run(spark, tables).count() > 0
    names = __spark_entry__.queries()
    assert "pipeline" in names and [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_do_not_need_more_than_documents(spark):
    docs = spark.createDataFrame([(1, "a b c", "x")], "doc_id long, text string, source string")
    assert mixing.mixed_documents(neardup.keep_one(docs)).columns == docs.columns

"""Tables that change by key, and the index of passages: whole versions, crashes, bytes that grow with the change."""

import os
import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions.text import search_tokens
from plumbline.operators import index, retrieve
from plumbline.sources.store import Store
from plumbline.sources.versions import Change, ChangedMeanwhile, Tables


def rows(spark, *own):
    return spark.createDataFrame(own, "id string, v int")


def held(df):
    return sorted(map(tuple, df.collect()))


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


@pytest.mark.parametrize("buckets", [0, 4])
def test_changes_are_merged_on_reading(spark, tmp_path, buckets):
    rng, want = random.Random(buckets), {}
    t = Tables(spark, str(tmp_path))
    assert t.read("t") is None and t.manifest()["version"] == 0
    for step in range(9):
        change = t.change()
        own = {f"k{rng.randrange(30)}": rng.randrange(100) for _ in range(rng.choice([0, 4, 12]))}
        gone = {f"k{rng.randrange(30)}" for _ in range(rng.choice([0, 3]))} - set(own)
        change.upsert("t", rows(spark, *own.items()), "id", "id" if buckets else None, buckets)
        change.delete("t", rows(spark, *[(g, 0) for g in gone]).select("id"))
        version = change.commit()
        if step or own:
            want = {k: v for k, v in want.items() if k not in gone} | own
        if step == 5:
            t.compact("t")
        if t.read("t") is not None:
            assert held(t.read("t")) == sorted(want.items())
        assert version >= step + 1
    t.compact("t")
    assert held(t.read("t")) == sorted(want.items()) and len(t.manifest()["tables"]["t"]["entries"]) <= 2
    old = t.read("t", t.versions()[-2])
    assert held(old) == sorted(want.items())
    t.vacuum(1)
    assert held(t.read("t")) == sorted(want.items()) and len(t.versions()) == 1


def test_a_change_counts_when_it_is_whole(spark, tmp_path):
    t = Tables(spark, str(tmp_path))
    t.change().upsert("a", rows(spark, ("x", 1)), "id").upsert("b", rows(spark, ("y", 1)), "id").commit()
    cut_off = t.change().upsert("a", rows(spark, ("x", 2)), "id")  # a crash before the manifest
    assert held(t.read("a")) == [("x", 1)]

    def no(change):
        raise ValueError("counts don't agree")

    with pytest.raises(ValueError, match="agree"):
        t.change().upsert("b", rows(spark, ("y", 9)), "id").commit(no)
    assert held(t.read("b")) == [("y", 1)]
    t.change().delete("b", rows(spark, ("y", 0)).select("id")).commit()
    with pytest.raises(ChangedMeanwhile):
        cut_off.commit()
    assert held(t.read("a")) == [("x", 1)] and held(t.read("b")) == [] and held(t.read("b", 1)) == [("y", 1)]
    assert t.vacuum()  # what was cut off goes
    assert held(t.read("a")) == [("x", 1)]
    with pytest.raises(ValueError, match="key"):
        t.change().upsert("a", rows(spark, ("x", 2)), "v")


def test_what_is_written_grows_with_the_change(spark, tmp_path):
    t = Tables(spark, str(tmp_path))
    many = spark.range(60_000).select(F.col("id").cast("string").alias("id"), F.pmod(F.xxhash64("id"), F.lit(10**6)).cast("int").alias("v"))
    t.change().upsert("t", many, "id", "id", 16).commit()
    base = size(tmp_path)
    t.change().upsert("t", rows(spark, ("5", 1), ("7", 1)), "id").commit()
    assert size(tmp_path) - base < base / 20
    entries = t.manifest()["tables"]["t"]["entries"]
    t.compact("t")
    after = t.manifest()["tables"]["t"]["entries"]
    assert after[0]["rows"] == entries[0]["rows"] and len(after[0]["without"]) <= 2  # other buckets aren't rewritten
    assert t.read("t").count() == 60_000 and held(t.read("t").where("id in ('5', '7')")) == [("5", 1), ("7", 1)]


def test_a_bucket_of_one_value_is_several_files(spark, tmp_path):
    t, names = Tables(spark, str(tmp_path)), ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize")
    for name, value in zip(names, ("32k", "1k"), strict=True):
        spark.conf.set(name, value)
    try:
        one = spark.range(60_000).repartition(6).select(F.lit("the").alias("token"), F.col("id").cast("string").alias("id"))
        t.change().upsert("t", one, "id", "token", 8).commit()
    finally:
        for name in names:
            spark.conf.unset(name)
    files = [f for d, _, names in os.walk(tmp_path / "data") for f in names if f.endswith(".parquet") and "bucket_=" in d]
    assert len(files) > 1 and t.read("t").count() == 60_000


def test_store_upserts_by_key(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.load("chunks") is None
    store.upsert(rows(spark, ("a", 1), ("b", 1)), "chunks", "id")
    assert held(store.upsert(rows(spark, ("b", 2), ("c", 2)), "chunks", "id")) == [("a", 1), ("b", 2), ("c", 2)]


def passages(spark, texts, dataset=1):
    made = [(c, "u", dataset, c[0], t, [float(len(t)), 1.0], [len(t) % 5] if len(t) % 3 else [], [1.0] if len(t) % 3 else []) for c, t in texts.items()]
    return spark.createDataFrame(made, "chunk_id string, user_id string, dataset_id long, doc_id string, content string, vector array<double>, indices array<int>, values array<double>")


def test_index_of_passages(spark, tmp_path):
    rng = random.Random(8)
    text = lambda: " ".join(rng.choice(["red", "blue", "tree", "检索", "数据检索", "x1"]) for _ in range(rng.randrange(1, 20)))
    texts = {f"{d}{i}": text() for d in "ab" for i in range(25)}
    own = index.PassageIndex(spark, str(tmp_path / "i"))
    assert own.index(passages(spark, texts).limit(0)) == 0 and own.delete(passages(spark, texts).select("chunk_id")) == 0
    assert own.index(passages(spark, texts), 50) == 1
    queries = spark.createDataFrame([("q1", "red tree"), ("q2", "数据检索 nothing"), ("q3", "none"), ("q4", None)], "sample_id string, text string")

    def same():
        corpus = spark.createDataFrame(list(texts.items()), "chunk_id string, text string")
        key = lambda df: sorted((r["sample_id"], r["route_rank"], r["chunk_id"], round(r["score"], 9)) for r in df.collect())
        assert key(own.bm25(queries, 7)) == key(retrieve.bm25(queries, corpus, 7, search_tokens)) != []
        assert own.tables.read(index.DENSE).count() == own.tables.read(index.CHUNKS).count() == len(texts)
        assert {r["chunk_id"] for r in own.tables.read(index.SPARSE).collect()} == {c for c, t in texts.items() if len(t) % 3}

    same()
    changed = {c: text() for c in list(texts)[:9]} | {"c1": "red red red"}
    texts |= changed
    own.index(passages(spark, changed))
    same()
    own.delete(spark.createDataFrame([("a3",), ("nowhere",)], "chunk_id string"))
    del texts["a3"]
    same()
    version = own.compact()
    same()
    for bad, fault in ((passages(spark, {"z": "red"}).withColumn("vector", F.array().cast("array<double>")), "dimensions"), (passages(spark, {"z": "red"}), "passages: 1 rows instead of 2")):
        with pytest.raises(Exception, match=fault):
            own.index(bad, 2)
        assert own.tables.manifest()["version"] == version
    same()
    own.index(passages(spark, {"y1": "blue"}, 2))
    own.delete_dataset(2)
    same()
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "sample_id string, vector array<double>")
    assert own.dense(asked, 1).first()["score"] == max(map(len, texts.values()))
    assert own.sparse(spark.createDataFrame([("q", 2, 1.0)], "sample_id string, index int, weight double"), 99).count() == sum(len(t) % 3 > 0 and len(t) % 5 == 2 for t in texts.values())


def test_an_index_shuffles_no_texts_and_its_postings_once(spark, tmp_path, monkeypatch):
    own, written, read = index.PassageIndex(spark, str(tmp_path / "i")), {}, []
    put, kept, made = Change._write, Tables.kept, lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(Change, "_write", lambda self, name, table, rows, keys=True: (written.update({name: made(rows)} if rows is not None else {}), put(self, name, table, rows, keys))[1])
    monkeypatch.setattr(Tables, "kept", lambda self, rows: (read.append(made(rows)), kept(self, rows))[1], raising=False)
    own.index(passages(spark, {"a1": "red red tree", "b1": "blue", "c1": ""}))
    assert set(written) == {index.CHUNKS, index.DENSE, index.SPARSE, index.BM25, index.LENGTHS}
    assert not [name for name, plan in written.items() if "Aggregate" in plan or "Join" in plan]
    assert held(own.tables.read(index.BM25).select("token", "chunk_id", "tf", "length")) == [("blue", "b1", 1, 1), ("red", "a1", 2, 3), ("tree", "a1", 1, 3)]
    own.index(passages(spark, {"a1": "tree"}))
    found = own.bm25(spark.createDataFrame([("q", "red tree")], "sample_id string, text string"))
    # Other tokens go before changes are merged.
    assert len(read) == 1 and read[0].index("LeftOuter") < read[0].index("Inner")
    assert [r["chunk_id"] for r in found.collect()] == ["a1"]


def test_of_passages_with_one_id_the_same_goes_everywhere(spark, tmp_path):
    own = index.PassageIndex(spark, str(tmp_path / "i"))
    twice = passages(spark, {"a1": "red red"}).unionByName(passages(spark, {"a1": "blue tree x1"})).unionByName(passages(spark, {"b1": "tree"}))
    own.index(twice, 2)
    said = {r["chunk_id"]: r["content"] for r in own.tables.read(index.CHUNKS).collect()}
    assert set(said) == {"a1", "b1"} and said["a1"] in ("red red", "blue tree x1")
    assert held(own.tables.read(index.BM25).where("chunk_id = 'a1'").select("token")) == sorted((t,) for t in set(said["a1"].split()))
    assert own.tables.read(index.DENSE).where("chunk_id = 'a1'").first()["vector"][0] == len(said["a1"])

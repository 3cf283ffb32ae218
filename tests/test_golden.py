"""Golden sets: readers, conversion, sampling, gate, anchors."""

import json
import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.operators import golden
from plumbline.sources import readers


def write(path, content):
    path.write_text(content, encoding="utf-8")
    return str(path)


def test_golden_lines_round_trip_and_checks(spark, tmp_path):
    rows = [{"id": "q1", "query": "x", "user_id": 1, "dataset_ids": [1], "expected_chunk_ids": ["c1"], "type": "keyword"}, {"id": "q2", "query": "y", "expected_doc_ids": [5], "relevance_grades": {"5": 3}}]
    path = write(tmp_path / "g.jsonl", "\n".join(map(json.dumps, rows)))
    got = readers.golden(spark, path)
    readers.write_golden(got, str(tmp_path / "out"))
    key = lambda df: sorted(df.toJSON().collect())
    assert key(readers.golden(spark, str(tmp_path / "out"))) == key(got) == key(readers.from_json_lines(readers.json_lines(got)))
    with pytest.raises(Exception, match="no expected chunks"):
        readers.golden(spark, write(tmp_path / "n.jsonl", '{"id": "q"}')).collect()
    with pytest.raises(Exception, match="id occurs twice"):
        readers.golden(spark, write(tmp_path / "t.jsonl", "\n".join([json.dumps(rows[0])] * 2))).collect()


def test_collections_and_judgments(spark, tmp_path):
    assert [tuple(r) for r in readers.collection(spark, write(tmp_path / "c.tsv", "p1\ta b\n\np2\tc\td\n")).orderBy("source_id").collect()] == [("p1", "a b"), ("p2", "c\td")]
    with pytest.raises(Exception, match="occurs twice"):
        readers.collection(spark, write(tmp_path / "d.tsv", "p1\ta\np1\tb\n")).collect()
    assert [tuple(r) for r in readers.qrels(spark, write(tmp_path / "q.tsv", "q1\t0\tp1\t3\nq1\t0\tp2\t0\n")).orderBy("pid").collect()] == [("q1", "p1", 3), ("q1", "p2", 0)]
    with pytest.raises(Exception, match="bad line"):
        readers.qrels(spark, write(tmp_path / "b.tsv", "q1\tp1\n")).collect()
    assert {tuple(r) for r in readers.json_qrels(spark, write(tmp_path / "j.json", '{"q1": ["p1", "p2"]}')).collect()} == {("q1", "p1", 1), ("q1", "p2", 1)}
    assert readers.manifest(spark, write(tmp_path / "m.jsonl", '{"source_id": "p1", "doc_id": 7, "status": "success"}')).first()["doc_id"] == 7


def test_conversion(spark):
    judged = spark.createDataFrame([("q1", "p1", 3), ("q1", "p2", 0), ("q2", "p9", 1), ("q3", "p1", 1), ("q3", "p3", 1)], "qid string, pid string, grade int")
    queries = spark.createDataFrame([("q1", "a"), ("q2", "b"), ("q3", "c")], "qid string, query string")
    manifest = spark.createDataFrame([("p1", 10, "success"), ("p2", 12, "success"), ("p3", -1, "failed")], "source_id string, doc_id long, status string")
    got = {r["id"]: r for r in golden.convert_judgments(judged, queries, manifest, "t2", graded=True).collect()}
    assert got["t2-q1"]["relevance_grades"] == {"10": 3} and got["t2-q1"]["expected_doc_ids"] == [10]
    assert not got["t2-q2"]["converted"] and got["t2-q2"]["dropped_pids"] == ["p9"]
    assert got["t2-q3"]["partial_missing"] and got["t2-q3"]["note"] == "missing: p3"


def test_precheck_and_ingest(spark):
    rows = spark.createDataFrame([("q1", ["c1", "c2"], [10]), ("q2", ["c1"], [])], "id string, expected_chunk_ids array<string>, expected_doc_ids array<long>")
    assert [tuple(r) for r in golden.precheck(rows, spark.createDataFrame([("c1",)], "chunk_id string")).collect()] == [("q1", ["c2"], True)]
    manifest = spark.createDataFrame([("p2", 2, "success"), ("p1", 1, "success"), ("p3", 3, "failed"), ("p4", 4, "success"), ("p5", 5, "success")], "source_id string, doc_id long, status string")
    collection = spark.createDataFrame([("p1", "a"), ("p2", "b"), ("p3", "c"), ("p4", "")], "source_id string, text string")
    assert [r["doc_id"] for r in golden.manifest_rows(manifest, collection).orderBy("doc_id").collect()] == [1, 2]
    assert [r["doc_id"] for r in golden.manifest_rows(manifest, collection, 1).collect()] == [1]
    assert [r["doc_id"] for r in golden.number_passages(collection, 900).orderBy("source_id").collect()] == [900, 901, 902, 903]


def test_sampling(spark):
    assert sum(golden.quota(50).values()) == 50 and golden.quota(50)["keyword"] > golden.quota(50)["cross_doc"]
    assert sum(golden.quota(7).values()) == 7
    chunks = spark.createDataFrame([(f"a{i}", 1) for i in range(10)] + [(f"b{i}", 2) for i in range(10)] + [("c0", 3)], "chunk_id string, dataset_id long")
    picked = golden.stratified_pick(chunks, 7, 1)
    counts = {r["dataset_id"]: r["count"] for r in picked.groupBy("dataset_id").count().collect()}
    assert counts == {1: 3, 2: 3, 3: 1} and picked.collect() == golden.stratified_pick(chunks, 7, 1).collect()
    islands = spark.createDataFrame([(1, i) for i in (0, 1, 3, 4, 5)], "doc_id long, chunk_index int")
    assert sorted(r["members"] for r in golden.group_adjacent(islands, 2).collect()) == [[0, 1], [3, 4]]
    few = golden.eligible_chunks(spark.createDataFrame([("s", 5, " abc "), ("ok", 5, "x" * 60), ("o", 6, "x" * 60)], "chunk_id string, dataset_id long, content string"), [5], 50)
    assert [r["chunk_id"] for r in few.collect()] == ["ok"]


def test_gate(spark):
    base = (True, True, True, True, ["c1"], ["c1"])
    rows = [("pass", *base), ("none", False, *base[1:]), ("no", True, False, *base[2:]), ("bad", True, True, True, False, *base[4:]), ("free", True, True, False, None, *base[4:]), ("hard", *base[:4], ["c8"], ["c1"])]
    got = {r["id"]: (r["decision"], r["failed_signal"]) for r in golden.gate(spark.createDataFrame(rows, "id string, has_text boolean, answerable boolean, has_golden_answer boolean, consistent boolean, retrieved array<string>, expected array<string>")).collect()}
    assert got == {"pass": ("passed", None), "none": ("dropped", "missing_text"), "no": ("dropped", "answerability"), "bad": ("dropped", "consistency"), "free": ("passed", None), "hard": ("hard", "retrieval_loop")}


def test_anchors(spark):
    anchor = "编号 ZX-204A 的组件额定值为 37 单位"
    contents = {"exact": f"前 {anchor} 后", "normalized": "编号ＺＸ-204A的组件额定值为３７  单位。", "fuzzy": "前文。编号 ZX204A 的组件额值为 37 单位。后文", "miss": "无关内容"}
    pairs = spark.createDataFrame([(anchor, c, k) for k, c in contents.items()], "anchor string, content string, want string")
    assert all(golden.TIERS[r["tier"]] == r["want"] for r in golden.match_tiers(pairs).collect())
    facts = spark.createDataFrame([("f1", 1, anchor), ("f2", 1, "绝不出现 QQQ-000")], "fact_id string, doc_id long, anchor string")
    chunks = spark.createDataFrame([(1, "c1", f"上 {anchor}"), (1, "c2", f"{anchor} 下"), (1, "c3", contents["fuzzy"])], "doc_id long, chunk_id string, content string")
    located = golden.locate(facts, chunks)
    assert {r["fact_id"]: (r["chunk_ids"], r["tier"]) for r in located.collect()} == {"f1": (["c1", "c2"], "exact"), "f2": ([], "miss")}
    assert golden.miss_rates(located.withColumn("bucket", F.lit("md")), "bucket").first()["miss_rate"] == 0.5
    leak = spark.createDataFrame([("ZX-204A 的额定值是多少", anchor), ("该组件超载时应如何处理", anchor)], "query string, anchor string")
    assert [r["leaked"] for r in golden.leaked_anchors(leak).collect()] == [True, False]
    samples = spark.createDataFrame([("s1", "f1", ["old"]), ("s2", "f2", ["old"])], "id string, fact_id string, expected_chunk_ids array<string>")
    moved, lost = golden.relocate(samples, facts, chunks)
    assert moved.first()["expected_chunk_ids"] == ["c1", "c2"] and [r["id"] for r in lost.collect()] == ["s2"]
    nested = spark.createDataFrame([("f1", 1, "ab 10"), ("f2", 1, "ab 10 units"), ("f3", 2, "ab 10 units")], "fact_id string, doc_id long, anchor string")
    assert {r["fact_id"] for r in golden.distinct_facts(nested).collect()} == {"f1", "f3"}


def test_near_copy_between_decoys_is_found(spark):
    """Decoys lie on the offsets that a quarter of the anchor's length gives, and the copy between them."""
    anchor = "abcdefghijklmnopqrstuvwxyz0123456789ABCD"
    decoy = anchor[:17] + "#######" + anchor[24:]
    copy = anchor[:10] + "##" + anchor[12:30] + "##" + anchor[32:]
    content = decoy + "=" * 45 + copy + "=" * 35 + decoy
    found = spark.createDataFrame([(anchor, content)], "anchor string, content string")
    assert found.select(golden.best_window("anchor", "content").alias("x")).first()["x"] == pytest.approx(0.9)
    facts, chunks = spark.createDataFrame([("f", 1, anchor)], "fact_id string, doc_id long, anchor string"), spark.createDataFrame([(1, "c", content.replace("=", "一").replace("#", "二"))], "doc_id long, chunk_id string, content string")
    assert golden.locate(facts, chunks, compose=False).first()["tier"] == "fuzzy"


def test_best_part_is_that_of_all_offsets():
    rng = random.Random(3)
    for _ in range(300):
        a, t = ("".join(rng.choices("abcd "[: rng.randint(1, 5)], k=rng.randint(0, n))) for n in (14, 40))
        if rng.random() < 0.5:
            at = rng.randint(0, len(t))
            t = t[:at] + a[: len(a) // 2] + "x" + a[len(a) // 2 :] + t[at:]
        want = max((text.ratio(a, t[i : i + len(a)]) for i in range(len(t))), default=0.0) if a else 0.0
        assert golden.most_alike(a, t) == want
        assert (golden.most_alike(a, t, golden.FUZZY, golden.FUZZY) >= golden.FUZZY) == (want >= golden.FUZZY)


def test_specs_render_and_models(spark):
    matrix = golden.spec_matrix(spark)
    assert matrix.where("key = 'pdfxmineru-headings-long-scattered'").first()["n_facts"] == 10
    assert {r["fmt"] for r in matrix.select("fmt").distinct().collect()} == {"md", "html", "docx", "pdf"}
    content, suffix = golden.render("html", "# A & b\n\ntext", "t")
    assert suffix == ".html" and content.decode().startswith("<!DOCTYPE html>") and "<h1>A &amp; b</h1>" in content.decode()
    with pytest.raises(ValueError, match="unsupported"):
        golden.render("rtf", "x")
    answers = spark.createDataFrame([("a", ["c1", "c2"], '```json\n{"answerable": true, "query": "q", "answer": "x", "used_chunk_ids": ["c2", "c9"]}\n```'), ("b", ["c1"], '{"answerable": false}'), ("c", ["c1"], "no json"), ("d", ["c1"], '{"query": "q", "used_chunk_ids": ["c9"]}')], "sample_id string, chunk_ids array<string>, answer string")
    got = {r["sample_id"]: (r["dropped"], r["used_chunk_ids"]) for r in golden.generated_samples(answers).collect()}
    assert got == {"a": (None, ["c2"]), "b": ("unanswerable", ["c1"]), "c": ("unparsed", ["c1"]), "d": (None, ["c1"])}
    told = golden.applied(spark.createDataFrame([("x",), ("fail",)], "t string"), lambda t: t.upper() if t != "fail" else 1 / 0, "t", "made", backoff=0).collect()
    assert {r["t"]: r["made"] for r in told} == {"x": "X", "fail": None}


def test_search_tokens(spark):
    row = spark.createDataFrame([("BM25 检索。向量 文ABC检",)], "t string").select(text.search_tokens(F.col("t")).alias("x")).first()["x"]
    assert "bm25" in row and "检索" in row and "向量" in row and "索向" not in row and "文检" not in row


def test_few_facts_are_compared_where_they_lie(spark, monkeypatch):
    rows = [(1, 5, "abc", "u"), (1, 4, "abc", "v"), (1, 4, "abc", "w"), (1, 6, "xabcx", "u"), (1, None, "q", "u"), (1, 7, None, "u"), (None, 8, "abc", "u"), (2, 1, "", "u"), (2, 2, "z", "u"), (3, 1, "xabcx", "u")]
    rows += [(9, i, "y" * (1 + i // 2), "u") for i in range(8)]
    facts = spark.createDataFrame(rows, "doc_id long, fact_id long, anchor string, other string")
    wanted = sorted([(1, 4, "abc", "v"), (1, 4, "abc", "w"), (1, 7, None, "u"), (None, 8, "abc", "u"), (2, 1, "", "u"), (3, 1, "xabcx", "u"), (9, 0, "y", "u")], key=str)
    for few in (64, 6, 0):
        monkeypatch.setattr(golden, "FEW_FACTS", few, raising=False)
        found = golden.distinct_facts(facts)
        assert sorted(map(tuple, found.collect()), key=str) == wanted
        if few == 64:
            assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()

"""Benchmark items in documents, also items too short for a run of words."""

from plumbline.plans import queries


def test_short_and_long_items_are_found(spark, tmp_path):
    texts = ["one two three four five six seven", "zero one two three four fives six", "four", " two\tthree  four five six seven eight nine", ""]
    items = ["four", "two three", "one two three four five", "two three four five six", "e two three four five six s", "three  four five six seven eight", "five six seven eight", "absent", " two\tthree"]
    spark.createDataFrame(list(enumerate(texts)) + [(90, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)) + [(90, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(map(tuple, queries.anchor_locate(spark, str(tmp_path)).collect()))
    assert got == sorted((i, j) for i, a in enumerate(items) for j, t in enumerate(texts) if a in t)

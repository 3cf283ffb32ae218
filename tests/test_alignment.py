"""Alignment against the plain way, which compares every pair, and inversions against all pairs."""

import random
import time
from difflib import SequenceMatcher
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from plumbline.functions import alignment, columns, text
from plumbline.operators import markdown as md


def plain_pairs(ref, made, least):
    free, out = list(enumerate(made)), []
    for i, a in enumerate(ref):
        scored = [(text.ratio(a, b), at) for at, (_, b) in enumerate(free)]
        best = max((s for s in scored if s[0] >= least), default=None)
        if best:
            out.append((i, free.pop(best[1])[0]))
    return out


def texts(rng, n):
    """Near copies, exact ones, runs, texts of popular letters only, long ones, other scripts and surrogates."""
    base = ["the quick brown fox", "the quick brown dog jumps", "a", "", "ab" * 120, "abc" * 90 + "x", "数据表检索", "数据检索表", "lines of a table 17", "lines of a table 71", "é" * 5 + "😀😀b", "\ud800x"]
    out = []
    for _ in range(n):
        t = rng.choice(base)
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(t) + 1)
            t = t[:at] + rng.choice("abx 检") + t[at + rng.randrange(2) :]
        out.append(t)
    return out


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("least", [0.6, 0.85])
def test_pairs_equal_the_plain_way(seed, least):
    rng = random.Random(seed)
    ref, made = texts(rng, 25), texts(rng, 30)
    assert alignment.greedy_pairs(ref, list(enumerate(made)), least) == plain_pairs(ref, made, least)


def test_long_texts_of_popular_letters():
    """The ratio starts from no letter of these; only what both begin with is told."""
    assert text.ratio("ab" * 120, "ab" * 120) == 1 and text.ratio("x" + "ab" * 120, "ab" * 120) < 0.1
    assert alignment.greedy_pairs(["ab" * 120, "x" + "ab" * 120], [(0, "ab" * 120), (1, "ab" * 120)], 0.6) == [(0, 1)]


def test_ties_go_to_the_last():
    assert alignment.greedy_pairs(["abcd", "abcd"], [(4, "abcx"), (7, "abcy"), (9, "zzzz")], 0.6) == [(0, 7), (1, 4)]


def test_many_blocks_are_aligned_in_bounded_time():
    rng = random.Random(2)
    words = [f"{rng.randrange(10**6):x}" for _ in range(3000)]
    ref = [" ".join(rng.choice(words) for _ in range(rng.randrange(3, 30))) for _ in range(2000)]
    made = [t if rng.random() < 0.5 else t.replace("a", "", 2) + "!" for t in ref]
    rng.shuffle(made)
    began = time.time()
    pairs = alignment.greedy_pairs(ref, list(enumerate(made)), 0.6)
    assert len(pairs) == 2000 and time.time() - began < 120


def test_inversions_of_many_places():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 17, 64):
        places = rng.sample(range(2 * n), n)
        assert alignment.inversion_count(places) == sum(a > b for a, b in combinations(places, 2))
    n = 50_000
    assert alignment.inversion_count(list(range(n, 0, -1))) == n * (n - 1) // 2


def test_inversions_by_windows(spark):
    rng = random.Random(7)
    rows = [(i, rng.sample(range(2 * n), n)) for i, n in enumerate([0, 1, 2, 3, 8, 33, 100])] + [(3, [2, 1, 0]), (None, [1, 0]), (9, None)]
    got = alignment.with_inversions(spark.createDataFrame(rows, "k int, places array<int>"), "places").collect()
    want = sorted((repr(k), len(p or []), sum(a > b for a, b in combinations(p or [], 2))) for k, p in rows)
    assert sorted((repr(r["k"]), r["n"], r["inversions"] or 0) for r in got) == want
    n = 50_000
    big = spark.range(1).select(F.reverse(F.sequence(F.lit(0), F.lit(n - 1))).alias("places"))
    assert alignment.with_inversions(big, "places").first()["inversions"] == n * (n - 1) // 2


def test_exact_rounding(spark):
    rng = random.Random(3)
    values = [k / 20000 for k in range(1, 20000, 2)] + [rng.random() for _ in range(3000)] + [p / q for q in range(1, 60) for p in range(q + 1)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", columns.exact4(F.col("v")).alias("r")).collect()
    assert [(r["v"], r["r"]) for r in got if r["r"] != round(r["v"], 4)] == []


def random_markdown(rng):
    made = []
    for _ in range(rng.randrange(12)):
        t = rng.choice(texts(rng, 3)).replace("\ud800", "") or "x"
        made.append(rng.choice([f"# {t}", f"## {t}", t, f"- {t}\n  - one\n    - two", f"> {t}", f"![{t[:5]}](p.png)", f"| a | {t} |\n|---|---|\n| 1 | ＢＭ25 |", f"```\n{t}\n```"]))
    return "\n\n".join(made)


def test_plans_over_blocks_equal_the_scores_of_one_pair(spark):
    """Repeated rows, shared and null ids and null texts included."""
    rng = random.Random(11)
    rows = [(str(i), random_markdown(rng), random_markdown(rng)) for i in range(40)]
    rows += [(str(i), r, r.replace("quick", "slow") + "\n\nmore 数据") for i, (_, r, _) in enumerate(rows)] + [("1", None, "# x"), ("2", "# x", None), (None, None, None), (None, "a b", "b a")]
    rows += rows[:3]
    df = spark.createDataFrame(rows, "sample_id string, ref string, produced string").repartition(3)
    said = lambda *v: tuple(repr(x) for x in v)
    for part, names in (("text", ("completeness", "noise")), ("list", ("list_fidelity",)), ("order", ("order_fidelity",))):
        got = sorted(said(*r) for r in md.part_scores(df, part).select("sample_id", *names).collect())
        want = []
        for key, ref, made in rows:
            scores = md.score(ref or "", made or "")
            want.append(said(key, *[scores[n] for n in names]))
        assert got == sorted(want), part
        plan = md.part_scores(df, part)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") <= (2 if part == "order" else 1) and "MapInArrow" not in plan
    runs = spark.createDataFrame([("a", ["a b", "A, b!", "c"]), ("b", None), ("c", []), ("d", ["x", None]), ("a", ["x"] * 5), (None, ["", " ", "y"])], "sample_id string, repeats array<string>")
    assert sorted(said(*r) for r in md.stability_scores(runs).collect()) == sorted(said(*r) for r in [("a", 0.3333), ("b", 1.0), ("c", 1.0), ("d", 1.0), ("a", 1.0), (None, 0.3333)])


def test_far_texts_are_not_counted(monkeypatch):
    def counted(*_):
        raise AssertionError("characters of texts that can't be alike were counted")

    monkeypatch.setattr(alignment, "_counts", counted)
    assert alignment.greedy_pairs(["aaaa", "bbbb", "abcd"], [(0, "zzzz"), (1, "aaaa" * 9), (2, "dbcd"), (3, "abcx")], 0.6) == [(2, 3)]


def test_equal_and_disjoint_texts_need_no_blocks(monkeypatch):
    def compared(*_):
        raise AssertionError("matching blocks were sought")

    monkeypatch.setattr(text, "SequenceMatcher", compared)
    assert (text.ratio("x" * 300, "x" * 300), text.ratio("ab", "cd"), text.ratio("", "a"), text.ratio("", "")) == (1.0, 0.0, 0.0, 1.0)


def test_ratio_is_that_of_matching_blocks():
    rng = random.Random(3)
    for size in (1, 8, 60, 150, 260):
        for letters in ("ab", "abcdefgh", "abc \u4e00\u00e9xyz" * 3):
            a, b = ("".join(rng.choice(letters) for _ in range(rng.randint(0, size))) for _ in "ab")
            for x, y in ((a, b), (a, a), (a + b, b + a)):
                assert text.ratio(x, y) == (SequenceMatcher(None, x, y).ratio() if x or y else 1.0)

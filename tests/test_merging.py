"""Mergeable summaries: their bounds, whatever the number of tasks, and the exact answer drawn from them."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandex.operators import merging


def texts_and_counts(n, longest):
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdefgh é", weights=[30, 20, 10, 8, 5, 3, 2, 1, 9, 1], k=rng.randint(0, 400))) for _ in range(n)]
    c = Counter(t[i : i + m] for t in texts for m in range(1, longest + 1) for i in range(len(t) - m + 1))
    return texts, c


@pytest.mark.parametrize("parts", [1, 8, 64])
def test_bounds_and_recall(spark, parts):
    texts, true = texts_and_counts(80, 5)
    c = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts, "doc_id")
    got = merging.summary(c, 5, 400).collect()
    error = got[0]["error"]
    assert 0 < error <= sum(true.values()) / 401 and len(got) <= 400
    for r in got:
        assert r["count"] <= true[r["substr"]] <= r["count"] + error
        assert texts[r["doc_id"]].startswith(r["substr"], r["pos"])
    want = {s for s, _ in true.most_common(20)}
    assert want <= {r["substr"] for r in got}  # all are above the error
    assert min(true[s] for s in want) > error


def test_top_is_exact(spark):
    texts, true = texts_and_counts(40, 4)
    c = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    order = sorted(((s, n) for s, n in true.items() if n >= 2), key=lambda x: (-x[1], len(x[0]), x[0].encode()))[:60]
    first = {s: next((d, t.find(s)) for d, t in enumerate(texts) if s in t) for s, _ in order}
    want = [(i + 1, s, len(s), n, *first[s]) for i, (s, n) in enumerate(order)]
    for tracked in (10, 5000):  # of 10 the bound can't hold, so that more are tracked
        assert sorted(map(tuple, merging.top(c, 60, 4, tracked).collect())) == want


def test_awkward(spark):
    kinds = "doc_id long, text string, n long, part string"
    empty = spark.createDataFrame([], kinds)
    assert merging.summary(empty, 3, 5).count() == 0 and merging.top(empty, 3, 3).count() == 0
    c = spark.createDataFrame([(None, "aaa", 1, "x"), (7, None, 1, "x"), (8, "", 1, "x"), (9, "aaa", 1, "x"), (9, "aaa", 1, "x")], kinds)
    assert {(r["substr"], r["count"], r["error"]) for r in merging.summary(c, 2, 50).collect()} == {("a", 9, 0), ("aa", 6, 0)}
    long = spark.range(1).select(F.col("id").alias("doc_id"), F.expr("repeat('ab', 50000)").alias("text"))
    assert {(r["substr"], r["count"]) for r in merging.summary(long, 2, 50).collect()} == {("a", 50000), ("b", 50000), ("ab", 50000), ("ba", 49999)}


def test_some_lengths_and_prefixes(spark):
    texts, true = texts_and_counts(60, 5)
    c = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4, "doc_id")
    begins = sorted((s for s in true if len(s) == 3), key=lambda s: (-true[s], s))[:5]
    want = {s: n for s, n in true.items() if len(s) > 3 and s[:3] in begins}
    for tracked in (30, 5000):
        got = {r["substr"]: r for r in merging.summary(c, 5, tracked, shortest=4, prefixes=begins).collect()}
        assert len(got) == min(tracked, len(want)) or (tracked == 30 and 0 < len(got) <= 30)
        assert all(r["count"] <= want[s] <= r["count"] + r["error"] and texts[r["doc_id"]].startswith(s, r["pos"]) for s, r in got.items())

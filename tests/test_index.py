"""The suffix index against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandex.operators import index, lineage, topk
from strandex.sources import files


def _texts(rng, n, letters="ab", most=70):
    return ["".join(rng.choices(letters, k=rng.randrange(most))) for _ in range(n)]


def _suffixes(texts):
    return sorted((t[i:], d, i) for d, t in enumerate(texts) for i in range(len(t or "")))


def _common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("texts,head", [(["mississippi", "", "banana", None, "a" * 28, *["abcabcabc"] * 3, "naïve😀é naïve", "é"], 2), (_texts(random.Random(2), 5, "abc") * 2, 4)])
def test_order_and_common_prefixes(spark, texts, head):
    corpus = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    order = index.suffix_order(corpus, head=head)
    got = sorted((r["rank"], r["doc_id"], r["pos"], r["lcp"]) for r in index.common_prefixes(order).collect())
    want = _suffixes([t or "" for t in texts])
    texts_ = [t or "" for t in texts]
    assert [r for r, *_ in got] == list(range(len(want)))
    assert [texts_[d][p:] for _, d, p, _ in got] == [s for s, _, _ in want]
    assert sorted((d, p) for _, d, p, _ in got) == sorted((d, p) for _, d, p in want)
    assert [n for *_, n in got] == [_common(a[0], b[0]) for a, b in zip([("",), *want], want)]
    own = index.suffix_order(corpus, per_text=True, head=head)
    ranks = sorted((r["doc_id"], r["rank"], r["pos"]) for r in index.text_ranks(own).collect())
    assert ranks == [(d, k, p) for d, t in enumerate(texts_) for k, (_, p) in enumerate(sorted((t[i:], i) for i in range(len(t))))]


@pytest.mark.parametrize("seed", range(2))
def test_nodes_equal_counted_ones(spark, seed):
    rng = random.Random(seed)
    texts = _texts(rng, 4, "ab" if seed % 2 else "abc", 40) + ["abab" * rng.randrange(1, 5)] * (1 + seed % 2)
    corpus = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(map(tuple, index.nodes(corpus, index.suffix_order(corpus, head=4)).collect()))
    want = sorted((r["label"], r["freq"], r["pd"], r["d"]) for r in topk.top_nodes(corpus, 10**6, 60).collect())
    assert got == want


@pytest.mark.parametrize("parts", [1, 7])
def test_intervals_over_ranges(spark, parts):
    rng = random.Random(parts)
    for values in ([0] + [rng.randrange(4) for _ in range(60)], list(range(30)), [0, *range(29, 0, -1)], [0] + [2] * 20 + [1] + [2] * 20):
        v = [-1, *values[1:], -1]
        want = set()
        for i in range(1, len(values)):
            if v[i] > 0:
                low = max(j for j in range(i) if v[j] < v[i])
                high = min(j for j in range(i + 1, len(v)) if v[j] < v[i])
                want.add((low, high - 1, v[i], max(v[low], v[high], 0)))
        rows = spark.createDataFrame(list(enumerate(values)), "rank long, lcp long")
        assert set(map(tuple, index.intervals(rows, parts).collect())) == want


def test_intervals_of_nothing(spark):
    assert index.intervals(spark.createDataFrame([], "rank long, lcp long")).count() == 0


def test_nearest_smaller():
    rng = np.random.default_rng(0)
    for _ in range(100):
        v = rng.integers(0, 4, rng.integers(1, 20))
        left, right = index._smaller(v)
        assert left.tolist() == [max((j for j in range(i) if v[j] < v[i]), default=-1) for i in range(len(v))]
        assert right.tolist() == [min((j for j in range(i + 1, len(v)) if v[j] < v[i]), default=len(v)) for i in range(len(v))]


def test_search(spark, tmp_path):
    rng = random.Random(9)
    texts = _texts(rng, 10, "abé", 80) + ["abab" * 12, "", None, "abab" * 12]
    corpus = spark.createDataFrame([(d, t, 1) for d, t in enumerate(texts)], "doc_id long, text string, rank int")
    path = str(tmp_path / "ix")
    index.build(corpus, path, head=4, part_rows=50)
    assert spark.read.parquet(f"{path}/parts").count() > 5
    order = [s for s, _, _ in _suffixes([t or "" for t in texts])]
    asked = sorted({t[i : i + n] for t in texts if t for i in range(0, len(t), 7) for n in (1, 3, 4, 5, 9, 20)}) + ["zz", "aa" * 20, "", None, "Z", "abab" * 12, "abab" * 13, "é" * 9]
    found = index.search(spark, path, spark.createDataFrame(list(enumerate(asked)), "query_id long, pattern string"))
    got = {r["query_id"]: r for r in found.collect()}
    for i, p in enumerate(asked):
        if p:
            n = sum(s.startswith(p) for s in order)
            assert got[i]["occurrences"] == n, p
            if n:
                assert got[i]["low"] == sum(s < p for s in order), p
        else:
            assert (got[i]["low"], got[i]["occurrences"]) == (None, 0)
    at = {(r["query_id"], r["doc_id"], r["pos"]) for r in index.places(spark, path, found).collect()}
    assert at == {(i, d, j) for i, p in enumerate(asked) if p for d, t in enumerate(texts) if t for j in range(len(t)) if t.startswith(p, j)}


def test_search_reads_few_parts(spark, sf, tmp_path):
    """Parts that hold no end of a pattern's ranks may be missing altogether."""
    b = spark.read.parquet(f"{sf}/benchmark.parquet").withColumnRenamed("item_id", "doc_id")
    path = str(tmp_path / "ix")
    index.build(b, path, part_rows=500)
    asked = spark.createDataFrame([(0, "the "), (1, "ion of")], "query_id long, pattern string")
    want = sorted(map(tuple, index.search(spark, path, asked).collect()))
    import shutil

    parts = {r["part"]: r for r in spark.read.parquet(f"{path}/parts").collect()}
    ends = {e for r in want for e in (r[2] - 1, r[2], r[3], r[3] + 1)}
    kept = 0
    for part, r in parts.items():
        if any(r["first"] <= e < r["first"] + r["size"] for e in ends):
            kept += 1
        else:
            shutil.rmtree(f"{path}/suffixes/part={part}")
    assert kept <= 8 < len(parts)
    assert sorted(map(tuple, index.search(spark, path, asked).collect())) == want


def test_order_of_spans(spark, tmp_path):
    rng = random.Random(4)
    text = "".join(rng.choices("ab cd\n", k=5000)) + "a repeated passage of some length " * 40
    (tmp_path / "t").write_text(text)
    spans = files.read_spans(spark, str(tmp_path / "t"), span=512, overlap=64)
    order = index.suffix_order(spans, per_text=True)
    got = [r["pos"] for r in index.text_ranks(order).orderBy("rank").collect()]
    assert got == sorted(range(len(text)), key=lambda i: text[i:])


def test_index_of_nothing(spark, tmp_path):
    path = str(tmp_path / "ix")
    index.build(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), path)
    got = index.search(spark, path, spark.createDataFrame([(1, "a")], "query_id long, pattern string")).collect()
    assert [(r["query_id"], r["occurrences"]) for r in got] == [(1, 0)]


def test_forget(spark):
    import os

    t = lineage.written(spark.range(3).withColumn("x", F.lit(1)), "t")
    path = t._strandex_path.removeprefix("file:")
    assert os.path.exists(path)
    lineage.forget(t, spark.range(1))
    assert not os.path.exists(path)


def test_commands(spark, tmp_path):
    from strandex import cli

    (tmp_path / "t").write_text("banana\n")
    (tmp_path / "p").write_text("ana\nx\nn\n")
    assert cli.run(spark, ["index", str(tmp_path / "t"), str(tmp_path / "ix")]).agg({"size": "sum"}).first()[0] == 6
    got = cli.run(spark, ["search", str(tmp_path / "ix"), str(tmp_path / "p")]).orderBy("query_id").collect()
    assert [(r["pattern"], r["occurrences"]) for r in got] == [("ana", 2), ("x", 0), ("n", 2)]
    got = {r["table"]: (r["files"], r["bytes"]) for r in cli.run(spark, ["sizes", str(tmp_path / "ix")]).collect()}
    stored = {t: [f.stat().st_size for f in (tmp_path / "ix" / t).rglob("part-*.parquet")] for t in ("suffixes", "parts")}
    assert got == {t: (len(b), sum(b)) for t, b in stored.items()}
    at = cli.run(spark, ["search", str(tmp_path / "ix"), str(tmp_path / "p"), "--places"]).collect()
    assert sorted((r["pattern"], r["pos"]) for r in at) == [("ana", 1), ("ana", 3), ("n", 2), ("n", 4)]


def test_nodes_deeper_than_a_bound_of_24(spark):
    t = "the quick brown fox jumps over a lazy dog"
    c = spark.createDataFrame([(0, t + "1"), (1, t + "2")], "doc_id long, text string")
    got = {(r["label"], r["freq"], r["d"]) for r in index.nodes(c, index.suffix_order(c)).collect()}
    assert (t, 2, len(t)) in got

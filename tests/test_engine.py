"""Golden fixtures and properties of the engine; brute force is written from the definitions."""

import random
from collections import Counter, OrderedDict

import pytest
from pyspark.sql import functions as F

from strandex.functions import fingerprint
from strandex.operators import cache, extensions, grams, metrics, prefix, sketch, suffixes, topk, utility, windows
from strandex.plans import catalog
from strandex.sources import files
from strandex.streaming.caches import stream_replay, windowed_patterns


def corpus(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def weighted(spark, text, weights):
    return corpus(spark, text).withColumn("weights", F.array(*map(F.lit, map(float, weights))))


def asked(spark, *patterns):
    return spark.createDataFrame(list(enumerate(patterns)), "query_id long, pattern string")


def brute_counts(texts, longest=99):
    c = Counter()
    for t in texts:
        for i in range(len(t)):
            for n in range(1, min(longest, len(t) - i) + 1):
                c[t[i : i + n]] += 1
    return c


def utilities(df):
    return {r["pattern"]: (r["occurrences"], r["utility"]) for r in df.collect()}


def test_banana(spark):
    b = weighted(spark, "banana", [1, 3, 4, 3, 4, 1])
    got = utilities(utility.answers(b, asked(spark, "ba", "a", "ana", "n", "an", "banana", "x", "nab"), weights="weights"))
    assert got == {"ba": (1, 4), "a": (3, 7), "ana": (2, 18), "n": (2, 8), "an": (2, 14), "banana": (1, 16), "x": (0, 0), "nab": (0, 0)}


def test_mississippi(spark):
    m = weighted(spark, "mississippi", range(1, 12))
    assert {p: u for p, (_, u) in utilities(utility.answers(m, asked(spark, "issi", "s", "i"), weights="weights")).items()} == {"issi": 40, "s": 20, "i": 26}
    rows = topk.top_nodes(m, 5, 12)
    assert {(r["label"], r["freq"], r["pd"], r["d"]) for r in rows.collect()} == {("i", 4, 0, 1), ("s", 4, 0, 1), ("p", 2, 0, 1), ("si", 2, 1, 2), ("ssi", 2, 1, 3)}
    s = topk.summary(rows).first()
    assert (s["tau"], s["longest_len"], s["n_substrings"]) == (2, 3, 6)
    assert {(r["substr"], r["est_freq"]) for r in topk.sampled(m, 5, 12, 2).collect()} == {("i", 4), ("s", 4)}


@pytest.mark.parametrize(("k", "want"), [(1, {"a"}), (2, {"a", "na"}), (3, {"a", "na"}), (4, {"a", "na", "ana"}), (9, {"a", "na", "ana"})])
def test_banana_nodes(spark, k, want):
    assert {r["label"] for r in topk.top_nodes(corpus(spark, "banana"), k, 6).collect()} == want


def test_sampled_banana(spark):
    b = corpus(spark, "banana")
    merged = {r["substr"]: r["f"] for r in topk.rounds(b, 3, 6, 2).groupBy("substr").agg(F.sum("freq").alias("f")).collect()}
    assert merged == {"a": 3, "n": 2, "na": 2, "an": 2, "ana": 2}
    for f in (topk.sampled, topk.sampled_pruned):
        assert sorted(r["est_freq"] for r in f(b, 3, 6, 2).collect()) == [2, 2, 3]


def test_edges(spark):
    assert topk.top_nodes(corpus(spark, "abc"), 5, 3).count() == 0
    assert {(r["label"], r["freq"], r["pd"], r["d"]) for r in topk.top_nodes(corpus(spark, "aaaa"), 9, 9).collect()} == {("a", 4, 0, 1), ("aa", 3, 1, 2), ("aaa", 2, 2, 3)}
    two = corpus(spark, "ab", "ba", "", None)
    assert utilities(utility.answers(two, asked(spark, "bb", "aab", "ab", "", "abababab")))["bb"] == (0, 0)
    assert {r["substr"] for r in grams.grams(corpus(spark, "a😀é"), [1]).collect()} == {"a", "😀", "é"}
    assert grams.grams(corpus(spark, ""), [1, 2]).count() == 0
    with pytest.raises(Exception, match="number of weights"):
        files.with_weights(corpus(spark, "abc"), spark.createDataFrame([(0, [1.0])], "doc_id long, weights array<double>")).collect()


def test_topk_properties(spark):
    rng = random.Random(5)
    for sigma in (1, 2, 3):
        texts = ["".join(rng.choice("abc"[:sigma]) for _ in range(rng.randint(1, 30))) for _ in range(3)]
        texts.append("x" * 300 + "ab" * 200)  # crosses blocks
        c = corpus(spark, *texts)
        true = brute_counts(texts, 5)
        assert {r["substr"]: r["freq"] for r in grams.counts(grams.grams(c, [1, 2, 3, 4, 5])).collect()} == true
        want = sorted(((s, n) for s, n in true.items() if n >= 2), key=lambda x: (-x[1], len(x[0]), x[0]))[:12]
        assert [(r["substr"], r["freq"]) for r in topk.exact(c, 12, 5).orderBy("rank").collect()] == want
        assert [(r["substr"], r["freq"]) for r in topk.levelwise(c, 12, 5).orderBy("rank").collect()] == want
        nodes = {r["substr"] for r in topk.expanded(topk.top_nodes(c, 12, 5)).collect()}
        assert all(s[:-1] in nodes for s in nodes if len(s) > 1)
        for r in topk.sampled(c, 12, 5, 3).collect():
            assert r["est_freq"] <= r["freq"] == true[r["substr"]]


def test_levelwise_goes_on_without_a_bound(spark):
    text = "abcdefghijklmnop" * 2
    got = topk.levelwise(corpus(spark, text), 1000).collect()
    assert max(r["len"] for r in got) == 16 and len(got) == 136


def test_nodes_and_sketches_go_on_without_a_bound(spark):
    c = corpus(spark, *["abcdefg", "abcdefg", "xabcdefgy"] * 4)
    got = {(r["label"], r["freq"], r["pd"], r["d"]) for r in topk.top_nodes(c, 28).collect()}
    assert got == {("abcdefg"[i:], 12, 0, 7 - i) for i in range(7)}
    for got in (sketch.heavy_keeper(c, 28, None), sketch.approximate(c, 28)):
        assert "abcdefg" in {r["substr"] for r in got.collect()}


def test_prefix_sums(spark):
    w = [1, 3, 4, 3, 4, 1]
    rows = spark.createDataFrame([(0, i, x) for i, x in enumerate(w)] + [(1, 0, 5)], "doc_id long, pos long, w long")
    for span in (1, 2, 4, 4096):
        sums = prefix.prefix_sums(rows, span)
        assert [r["ps"] for r in sums.where("doc_id = 0").orderBy("pos").collect()] == [1, 4, 8, 11, 15, 16]
    found = spark.createDataFrame([(0, 1, 3), (0, 3, 3), (0, 0, 2), (1, 0, 1)], "doc_id long, pos long, len int")
    assert sorted(r["utility"] for r in prefix.occurrence_utility(sums, found).collect()) == [4, 5, 8, 10]


@pytest.mark.parametrize("bucket, longest", [(1, 1), (1, 4), (4, 2), (7, 9), (256, 3)])
def test_sums_in_buckets(spark, monkeypatch, bucket, longest):
    monkeypatch.setattr(prefix, "BUCKET", bucket)
    rng = random.Random(bucket + longest)
    w = {d: [rng.randrange(9) for _ in range(n)] for d, n in enumerate((1, 4, 8, 9, 40))}
    rows = spark.createDataFrame([(d, i, x) for d, ws in w.items() for i, x in enumerate(ws)], "doc_id long, pos long, w long")
    found = [(d, i, n) for d, ws in w.items() for i in range(len(ws)) for n in range(1, longest + 1)]
    df = spark.createDataFrame(found, "doc_id long, pos long, len int")
    got = {(r["doc_id"], r["pos"], r["len"]): r["utility"] for r in prefix.bucket_utility(prefix.sum_buckets(prefix.prefix_sums(rows, 4), longest), df, longest).collect()}
    assert got == {(d, i, n): sum(w[d][i : i + n]) if i + n <= len(w[d]) else None for d, i, n in found}


def test_looked_up_weights(spark):
    """Equal to weights carried along; missing and null weights count 0; texts may be null or empty."""
    rng = random.Random(11)
    texts = ["".join(rng.choice("abé") for _ in range(n)) for n in (1, 30, 700)]
    rows = [(d, t, [float(rng.randrange(9)) for _ in t]) for d, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, (7, None, None), (8, "", [])], "doc_id long, text string, weights array<double>")
    patterns = asked(spark, "a", "ab", "é", "zz", texts[1][3:20], texts[2][:300], "a", None, "")
    want = utilities(utility.answers(df, patterns, weights="weights"))
    assert utilities(utility.answers(df, patterns, weights="weights", distinct_ids=True)) == want
    assert want["zz"] == (0, 0) and want[texts[2][:300]][0] == 1
    short = spark.createDataFrame([(0, "aaa", [2.0, None])], "doc_id long, text string, weights array<double>")
    assert utilities(utility.weighted_utility(short, asked(spark, "a", "aa"), "weights")) == {"a": (3, 2.0), "aa": (2, 2.0)}


def test_table_answers_agree(spark):
    c = corpus(spark, "banana", "bandana", "ananas")
    table = topk.expanded(topk.top_nodes(c, 4, 4)).withColumnRenamed("substr", "pattern")
    known = utility.pattern_utility(c, table.select("pattern")).withColumnRenamed("pattern", "substr")
    q = asked(spark, "an", "a", "das", "zz", "an")
    got = utility.table_answers(c, q, known)
    assert {r["source"] for r in got.collect()} == {"table", "index"}
    assert got.select("query_id", "utility").exceptAll(utility.answers(c, q).select("query_id", "utility")).count() == 0 and got.count() == 5


def lru(seq, k):
    kept, hits = OrderedDict(), []
    for p in seq:
        hits.append(p in kept)
        kept.pop(p, None)
        kept[p] = 1
        if len(kept) > k:
            kept.popitem(last=False)
    return hits


def test_lru_is_its_simulation(spark):
    rng = random.Random(9)
    seqs = {s: [rng.choice("abcdefg") for _ in range(60)] for s in range(6)} | {9: list("xyxzyx")}
    stream = spark.createDataFrame([(s, i, p) for s, q in seqs.items() for i, p in enumerate(q)], "stream_id long, seq long, pattern string")
    for k in (1, 2, 4):
        for got in (cache.lru_hits(stream, k), cache.replay(stream, "lru", k)):
            by = {(r["stream_id"], r["seq"]): r["hit"] for r in got.collect()}
            assert by == {(s, i): h for s, q in seqs.items() for i, h in enumerate(lru(q, k))}
    assert lru("xyxzyx", 2) == [False, False, True, False, False, False]
    long = [f"w{int(rng.paretovariate(0.6)) % 500}" for _ in range(3000)]
    stream = spark.createDataFrame([(7, 3 * i, p) for i, p in enumerate(long)], "stream_id long, seq long, pattern string")
    for k in (0, 3, 40, 1000):
        got = [r["hit"] for r in cache.lru_hits(stream, k).orderBy("seq").collect()]
        assert got == lru(long, k)


def test_frequency_caches(spark):
    stream = spark.createDataFrame([(0, i, p) for i, p in enumerate("aaabbcbbcccc")], "stream_id long, seq long, pattern string")
    got = {r["seq"]: (r["hit"], r["evicted"]) for r in cache.replay(stream, "lfu", 2).collect()}
    assert got[0] == (False, None) and got[1] == (True, None)
    assert [e for _, e in got.values() if e] == ["a"]  # c is admitted as its count reaches a's 3 + 1
    assert cache.replay(stream, "sketch", 2).count() == 12


def lfu_model(stream, k):
    """Hits and evictions by the rules, on a plain list of [count, key], searched from end to end."""
    asked, table, out = Counter(), [], []
    for key in stream:
        asked[key] += 1
        at = next((i for i, x in enumerate(table) if x[1] == key), None)
        hit, gone = at is not None, None
        if at is None:
            if len(table) < k:
                table.insert(0, [asked[key] - 1, key])
                at = 0
            elif asked[key] == table[0][0] + 1:
                gone, table[0][1], at = table[0][1], key, 0
        if at is not None:
            end = max(i for i, x in enumerate(table) if x[0] == table[at][0])
            table[at], table[end] = table[end], table[at]
            table[end][0] += 1
        out.append((hit, gone))
    return out


def test_exact_frequency_cache_is_its_model(spark):
    rng = random.Random(31)
    seqs = {s: rng.choices("abcdefghij"[: rng.randint(2, 10)], k=80) for s in range(200)}
    for k in (1, 2, 3, 5):
        for q in seqs.values():
            own = cache.POLICIES["lfu"](k)
            assert [own.use(x) for x in q] == lfu_model(q, k)
    seqs[None] = seqs[0]
    stream = spark.createDataFrame([(s, i, p) for s, q in seqs.items() for i, p in enumerate(q)], "stream_id long, seq long, pattern string")
    got = {(r["stream_id"], r["seq"]): (r["hit"], r["evicted"]) for r in cache.replay(stream, "lfu", 3).collect()}
    assert got == {(s, i): x for s, q in seqs.items() for i, x in enumerate(lfu_model(q, 3))}
    for hits in (cache.replay(stream, "lru", 3), cache.lru_hits(stream, 3)):
        assert {(r["stream_id"], r["seq"]): r["hit"] for r in hits.collect()} == {(s, i): h for s, q in seqs.items() for i, h in enumerate(lru(q, 3))}


def test_heavy_keeper_in_tasks_without_texts(spark):
    c = spark.range(0, 8, 1, 8).where("id = 3").select(F.col("id").alias("doc_id"), F.lit("abab").alias("text"))
    assert {(r["substr"], r["est_freq"]) for r in sketch.heavy_keeper(c, 20, 2).collect()} == {("a", 2), ("b", 2), ("ab", 2), ("ba", 1)}


def test_walk_does_not_depend_on_batches(spark):
    c = corpus(spark, *["the cat and the hat " * 3] * 50).coalesce(1)
    rows = lambda: sorted(map(tuple, sketch.heavy_keeper(c, 12, 5).collect()))
    want = rows()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert rows() == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # all is exact while neither cells nor places are short
    few = sketch.walk(["abab"], 50)
    assert few == {"a": 2, "ab": 2, "aba": 1, "abab": 1, "b": 2, "ba": 1, "bab": 1}


def test_walk_counts_equal_substrings_at_once(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice("etaoin shrdlu") for _ in range(1000)) for _ in range(100)]
    asked, digests = [], cache._digests
    monkeypatch.setattr(cache, "_digests", lambda key: asked.append(key) or digests(key))
    kept = sketch.walk(texts, 50)
    assert len(asked) < 40_000  # of 100,000 symbols, each counted with some longer substrings
    assert all(kept[c] == sum(t.count(c) for t in texts) for c in "etaoin shrdlu")


def test_sums_have_what_is_second_rate_in_each_task(spark):
    c = spark.range(0, 2, 1, 2).select(F.col("id").alias("doc_id"), F.expr("repeat('a', 10) || repeat(if(id = 0, 'b', 'd'), 9) || repeat('c', 8)").alias("text"))
    assert [(r["substr"], r["est_freq"]) for r in sketch.heavy_keeper(c, 2, 1).collect()] == [("a", 20), ("c", 16)]


@pytest.mark.parametrize("first, piece, ahead, longest", [(1, 3, 1, None), (5, 7, 2, None), (256, 1 << 18, 3, None), (4, 50, 1, 6)])
def test_walk_in_pieces_is_exact_while_nothing_is_short(monkeypatch, first, piece, ahead, longest):
    for name, n in (("FIRST", first), ("PIECE", piece), ("AHEAD", ahead)):
        monkeypatch.setattr(sketch, name, n)
    rng = random.Random(first)
    texts = ["".join(rng.choice(["a", "b", "\0", "𝄞", "é"]) for _ in range(n)) for n in (1, 30, 0, 2, 25, 25, 1)]
    want = Counter(t[i : i + n] for t in texts for i in range(len(t)) for n in range(1, min(len(t) - i, longest or 99) + 1))
    assert sketch.walk(texts, 5000, longest) == want


def test_uses_in_a_row_equal_single_ones():
    rng = random.Random(1)
    for _ in range(300):
        width, k = rng.choice([1, 2, 5, 40]), rng.randint(0, 6)
        rows, single = (cache.TopQueries(k, cache.Keeper(width)) for _ in range(2))
        for top in (rows, single):
            top.counter.random = lambda: 0.0  # a cell of another key always loses one
        for _ in range(40):
            key, times = rng.choice("abcdefghijkl"), rng.choice([1, 1, 2, 3, 7, 30])
            at = 0 if key in single.kept else times + 1
            for i in range(times):
                single.offer(key)
                if at > times and key in single.kept:
                    at = i + 1
            assert rows.offer_times(key, times) == at
            assert rows.kept.items() == single.kept.items() and rows.kept.last == single.kept.last and rows.counter.cells == single.counter.cells


def test_cells_lose_as_often_when_draws_are_made_at_once():
    lost = []
    for seed in range(3000):
        rows, single = cache.Keeper(1, seed), cache.Keeper(1, seed + 3000)
        for keeper in (rows, single):
            keeper.cells = [[[20, 7]], [[20, 7]]]
        rows.add_times("x", 30)
        for _ in range(30):
            single.add("x")
        lost.append((rows.cells[0][0][0], single.cells[0][0][0]))
    own, other = (sum(x) / len(lost) for x in zip(*lost, strict=True))
    assert abs(own - other) < 0.6, (own, other)


def test_streaming_caches_equal_batch(spark, tmp_path):
    rows = [(s, i, random.Random(s * 100 + i).choice("abcd")) for s in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "stream_id long, seq long, pattern string")
    for part, where in enumerate(("seq < 20", "seq >= 20")):
        df.where(where).coalesce(1).write.parquet(str(tmp_path / f"in/p{part}"))
    for policy in ("lru", "lfu"):
        src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        q = stream_replay(src, policy, 2).writeStream.format("memory").queryName(f"caches_{policy}").option("checkpointLocation", str(tmp_path / policy)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = {(r["stream_id"], r["seq"]): r["hit"] for r in spark.table(f"caches_{policy}").collect()}
        assert got == {(r["stream_id"], r["seq"]): r["hit"] for r in cache.replay(df, policy, 2).collect()}


def test_windowed_patterns(spark):
    ev = spark.createDataFrame([("2024-01-01 00:10:00", "abab"), ("2024-01-01 01:10:00", "ab")], "ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    got = {(r["window"]["start"].hour, r["substr"]): r["freq"] for r in windowed_patterns(ev, "event_type", length=2).collect()}
    assert got == {(0, "ab"): 2, (0, "ba"): 1, (1, "ab"): 1}


def test_fingerprints(spark):
    texts = ["", "a", "banana", "naïve 😀", "x" * 500]
    got = corpus(spark, *texts).select("doc_id", fingerprint.fingerprint(F.col("text")).alias("f"), fingerprint.power(F.length("text")).alias("p")).orderBy("doc_id").collect()
    for t, r in zip(texts, got, strict=True):
        h = 0
        for ch in t:
            h = (h * fingerprint.BASE + ord(ch)) % fingerprint.PRIME
        assert (r["f"], r["p"]) == (h, pow(fingerprint.BASE, len(t), fingerprint.PRIME))
    fingerprint.register(spark)
    assert spark.sql("SELECT kr_suffix(kr_fingerprint('banana'), kr_fingerprint('ban'), kr_fingerprint('x')) IS NOT NULL, kr_fingerprint('banana')").first()[1] == got[2]["f"]


def test_suffixes(spark):
    t = "banana"
    order = sorted(range(6), key=lambda i: t[i:])
    c = corpus(spark, t, "aaaa", "")
    sa = suffixes.suffix_array(c)
    assert [r["pos"] for r in sa.where("doc_id = 0").orderBy("rank").collect()] == order
    assert [r["lcp"] for r in suffixes.lcp_array(c, sa, 8).where("doc_id = 0").orderBy("rank").collect()] == [0, 1, 3, 0, 0, 2]


def test_suffixes_of_any_id(spark, tmp_path):
    rows = [(1, "banana"), (1_000_000_001, "banana"), (None, "banana"), (None, "aab")]
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = catalog.suffix_array(spark, str(tmp_path)).collect()
    want = [(i, k, pos) for i, t in rows for k, pos in enumerate(sorted(range(len(t)), key=lambda j: t[j:]))]
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)


def test_whole_common_prefixes(spark, tmp_path):
    part = "a passage of more than thirty-two symbols\0 with a NUL"
    rows = [(1, part + "|" + part), (None, "a" * 50), (None, "banana"), (7, "")]
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = []
    for i, t in rows:
        starts = sorted(range(len(t)), key=lambda j: t[j:])
        for k, at in enumerate(starts):
            a, b = t[at:], t[starts[k - 1] :] if k else ""
            want.append((i, k, at, next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))))
    got = [tuple(r) for r in catalog.lcp_array(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and max(r[3] for r in got) == len(part)


def test_files(spark, tmp_path):
    (tmp_path / "t").write_text("ban\rana\n")
    (tmp_path / "w").write_text("1 3 4 3\n4 1 x 9")
    (tmp_path / "p").write_text("ba\na\n\nana\n")
    assert files.read_text(spark, str(tmp_path / "t")).first()["text"] == "ban\rana"
    assert files.read_bytes(spark, str(tmp_path / "t")).first()["text"] == "ban\rana"
    assert files.read_weights(spark, str(tmp_path / "w")).first()["weights"] == [1, 3, 4, 3, 4, 1]
    assert [r["pattern"] for r in files.read_patterns(spark, str(tmp_path / "p")).orderBy("query_id").collect()] == ["ba", "a"]
    assert files.read_patterns(spark, str(tmp_path / "p"), to_first_empty=False).count() == 3
    (tmp_path / "q").write_text("ba\nna")
    assert files.read_patterns(spark, str(tmp_path / "q"), drop_unended=True).count() == 1
    files.write_topk(topk.exact(corpus(spark, "banana"), 2, 2), str(tmp_path / "out"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["a", "n"]
    files.write_frequencies(grams.counts(grams.grams(corpus(spark, "aa"), [1])), str(tmp_path / "freq"))
    assert spark.read.text(str(tmp_path / "freq")).first()["value"] == "a 2"


def test_command_line(spark, tmp_path):
    from strandex import cli

    (tmp_path / "t").write_text("banana\n")
    (tmp_path / "w").write_text("1 3 4 3 4 1\n")
    (tmp_path / "p").write_text("ba\na\nana\nn\nan\n")
    t, w, p = (str(tmp_path / x) for x in "twp")
    want = [4, 7, 18, 8, 14]
    for argv in (["utility", t, w, p], ["utility", t, w, p, "3"], ["utility", t, w, p, "3", "2"], ["replay", t, w, "2", p]):
        assert [r["utility"] for r in cli.run(spark, argv).orderBy("query_id").collect()] == want
    assert cli.run(spark, ["utility", t, "random", "random:5:1:3", "2"]).count() == 5
    assert cli.run(spark, ["topk", t, "3"]).count() == 3
    assert cli.run(spark, ["sample", t, "3", "2", "--pruned"]).count() == 3


def test_sketches(spark):
    c = corpus(spark, *["the cat and the hat " * 20] * 8)
    true = {r["substr"] for r in topk.exact(c, 20, 3).collect()}
    for got in (sketch.heavy_keeper(c, 20, 3), sketch.approximate(c, 20, 3)):
        assert len({r["substr"] for r in got.collect()} & true) >= 14


@pytest.mark.parametrize("sep", ["\n", " ", "the"])
def test_spans_of_a_long_text(spark, tmp_path, sep):
    rng = random.Random(5)
    text = "".join(rng.choice(["the ", "cat ", "é", "\n", "\r\n", "  ", "𝄞", "ab"]) for _ in range(3000))
    for i, (end, want) in enumerate([("", text), ("\n", text), ("\n\n", text + "\n"), ("the", text + "the"), (" ", text + " ")]):
        path = str(tmp_path / f"t{i}")
        with open(path, "w", encoding="utf-8", newline="") as f:
            f.write(text + ("x" if not end else "") + end)
        want = text + "x" if not end else want
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        try:
            spans = sorted(files.read_spans(spark, path, 500, 9, sep).collect())
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert [(s["span_start"], s["span_own"], s["text"]) for s in spans] == [(a, min(500, len(want) - a), want[a : a + 509]) for a in range(0, len(want), 500)]
    rows = grams.span_grams(spark.createDataFrame(spans), [2, 9])
    got = Counter({r["substr"]: r["freq"] for r in grams.counts(rows).collect()})
    assert got == Counter(want[i : i + n] for n in (2, 9) for i in range(len(want) - n + 1))
    (tmp_path / "none").write_text("")
    assert files.read_spans(spark, str(tmp_path / "none"), 500, 9, sep).count() == 0


def test_extensions_by_brute_force(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abé") for _ in range(n)) for n in (1, 7, 60)] + ["a" * 40, ""]
    pairs = [(d, i, j) for d, t in enumerate(texts) for i in range(0, len(t) + 1, 3) for j in range(0, len(t) + 1, 5)]
    got = {(r["doc_id"], r["i"], r["j"]): r["lce"] for r in extensions.extensions(corpus(spark, *texts), spark.createDataFrame(pairs, "doc_id long, i long, j long")).collect()}
    same = lambda a, b: next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert got == {(d, i, j): same(texts[d][i:], texts[d][j:]) for d, i, j in pairs}
    values = [rng.randrange(9) for _ in range(50)]
    rows = spark.createDataFrame([(0, i, v) for i, v in enumerate(values)] + [(None, 0, 1)], "doc_id long, rank long, lcp long")
    asked = [(0, a, b) for a in range(0, 52, 3) for b in range(a - 2, 54, 4)]
    got = {(r["low"], r["high"]): r["least"] for r in extensions.range_minima(rows, spark.createDataFrame(asked, "doc_id long, low long, high long")).collect()}
    assert got == {(a, b): min(values[a : b + 1]) if a <= b < 50 else None for _, a, b in asked}
    assert extensions.range_minima(rows, spark.createDataFrame([], "doc_id long, low long, high long")).count() == 0


@pytest.mark.parametrize("head", [1, 4, 32])
def test_extensions_by_fingerprints(spark, head):
    rng = random.Random(head)
    unit = "".join(rng.choice("abé") for _ in range(50))
    texts = ["".join(rng.choice("abé") for _ in range(40)), "a" * 150, unit * 3 + "x" + unit, "", None]
    pairs = [(d, i, j, "x") for d, t in enumerate(texts) if t for i in range(0, len(t) + 2, 7) for j in range(0, len(t) + 2, 10)]
    odd = [(0, None, 1, "x"), (None, 0, 0, "x"), (9, 0, 0, "x"), (3, 0, 0, "x"), (1, 0, 1, "y"), (1, 0, 1, "y")]
    df = spark.createDataFrame(pairs + odd, "doc_id long, i long, j long, head string")
    got = Counter(map(tuple, extensions.fingerprint_extensions(corpus(spark, *texts), df, head=head).collect()))
    same = lambda a, b: next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    want = Counter((d, i, j, x, same(texts[d][i:], texts[d][j:])) for d, i, j, x in pairs)
    want.update([(0, None, 1, "x", None), (1, 0, 1, "y", 149), (1, 0, 1, "y", 149)])
    assert got == want
    none = spark.createDataFrame([], df.schema)
    assert extensions.fingerprint_extensions(corpus(spark, *texts), none, head=head).count() == 0


def test_extensions_of_spans(spark, tmp_path):
    rng = random.Random(5)
    unit = "".join(rng.choice("ab ") for _ in range(700))
    text = unit + "q" + unit + "r" + unit[:300]
    (tmp_path / "t").write_text(text)
    spans = files.read_spans(spark, str(tmp_path / "t"), 400, 40, " ")
    doc = spans.first()["doc_id"]
    pairs = [(0, 701), (1, 702), (350, 1051), (0, 1402), (701, 1402), (5, 5), (699, 1400)]
    df = spark.createDataFrame([(doc, i, j) for i, j in pairs], "doc_id string, i long, j long" if isinstance(doc, str) else "doc_id long, i long, j long")
    got = {(r["i"], r["j"]): r["lce"] for r in extensions.fingerprint_extensions(spans, df).collect()}
    assert got == {(0, 701): 700, (1, 702): 699, (350, 1051): 350, (0, 1402): 300, (701, 1402): 300, (5, 5): len(text) - 5, (699, 1400): 1}


def test_levels_beyond_what_is_carried(spark):
    """Repeats of 90 symbols are found past the symbols that positions carry, and what levels write is deleted."""
    from pathlib import Path

    from strandex.operators import lineage

    rng = random.Random(3)
    repeat = "".join(rng.choice("abcdefgh") for _ in range(90))
    texts = ["x" + repeat, "y" + repeat, "z" + repeat + "é", "", None]
    want = [(s, n) for s, n in sorted(brute_counts([t or "" for t in texts], 91).items(), key=lambda x: (-x[1], len(x[0]), x[0].encode())) if n >= 2]
    at = Path(lineage.folder(spark).removeprefix("file:"))
    before = set(at.iterdir()) if at.exists() else set()
    got = [(r["substr"], r["freq"]) for r in topk.levelwise(corpus(spark, *texts), len(want) + 5).orderBy("rank").collect()]
    assert got == want
    assert set(at.iterdir()) == before
    assert topk.levelwise(corpus(spark, "", None), 5).count() == 0
    k = len(want)
    assert {(r["label"], r["freq"]) for r in topk.top_nodes(corpus(spark, *texts), k).collect() if r["d"] == 90} == {(repeat, 3)}


def test_cache_contents(spark):
    rng = random.Random(7)
    rows = [(s, i, rng.choice("abcdefgh")) for s in (0, 1, None) for i in range(60)]
    stream = spark.createDataFrame(rows, "stream_id long, seq long, pattern string")
    for policy in cache.POLICIES:
        got = cache.contents(stream, policy, 4).collect()
        for s in (0, 1, None):
            model = cache.POLICIES[policy](4)
            for row in rows:
                if row[0] == s:
                    model.use(row[2])
            own = [(r["pattern"], r["count"]) for r in sorted((r for r in got if r["stream_id"] == s), key=lambda r: r["place"])]
            assert own == ([(k, None) for k in model.kept] if policy == "lru" else model.kept.items())
    assert cache.contents(stream.limit(0), "lru", 4).count() == 0


def test_table_function_and_times(spark):
    fingerprint.register(spark)
    spark.createDataFrame([("aba",), ("",), (None,)], "t string").createOrReplaceTempView("few")
    got = spark.sql("SELECT s.* FROM few, LATERAL substrings(few.t, 2) AS s").collect()
    assert sorted(map(tuple, got)) == [(0, 1, "a"), (0, 2, "ab"), (1, 1, "b"), (1, 2, "ba"), (2, 1, "a")]
    out = metrics.timed(spark.range(1000))
    assert out["queries"] == 1000 and out["seconds"] > 0 and out["seconds_a_query"] == out["seconds"] / 1000


def test_windows_count_what_rows_did(spark, monkeypatch):
    """Windows counted within tasks against every occurrence as a row: texts cut in pieces, repeated and null ids, wide symbols."""
    monkeypatch.setattr(windows, "PIECE", 7)
    texts = ["abcabcab", "", None, "é漢😀é漢😀é", "a", "ab\0ab\0a", "abcabcab" * 3]
    c = spark.createDataFrame([(i, t, "x" if i == 3 else None) for i, t in zip([3, 1, 1, None, 3, 3, 0], texts, strict=True)], "doc_id long, text string, lang string")
    names = lambda df: sorted(map(repr, df.collect()))
    for last in (2, 3, 5):
        rows = grams.grams(c, list(range(1, last + 1)), ("lang",))
        want = grams.counts(rows, ("lang",), True).select("lang", "substr", "len", "freq", "first_doc", "first_pos")
        got = grams.counts(windows.substrings(windows.windows(c, last, ("lang",), first=True), 1, last), ("lang",), True)
        assert names(got.select(*want.columns)) == names(want)
    begins = ["abc", "cab"]
    want = grams.counts(grams.grams(c, [4, 5]).where(F.substring("substr", 1, 3).isin(begins)))
    got = grams.counts(windows.substrings(windows.windows(c, 5, prefixes=begins), 4, 5))
    assert names(got.select(*want.columns)) == names(want)


def test_levels_make_few_rows(spark):
    """Of 200,000 positions, a window for each distinct one reaches the shuffle's side and not a row for each length."""
    c = spark.range(100).select(F.col("id").alias("doc_id"), F.expr("repeat('ab', 1000)").alias("text"))
    assert topk._Levels(c, "text", "doc_id").rows(1, 3, None).count() < 2000

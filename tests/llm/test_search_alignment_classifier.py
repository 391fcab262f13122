"""Operators 11 to 13 against brute force, SQL and held-out labels; awkward rows of each."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandex.llm import alignment, classifier, search

DOCS = "doc_id long, text string, item_id long, rank string"  # extra columns with clashing names


# --- 11 --------------------------------------------------------------------------------------------------------------


def _best(docs, items, k=20):
    """(item_id, rank, doc_id, score) by the definition; null ids last."""
    own = lambda t: re.findall(search.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    terms = [(d, Counter(own(t))) for d, t in docs]
    some = [(d, c) for d, c in terms if c]
    n, total = len(some), sum(sum(c.values()) for _, c in some)
    df = Counter(t for _, c in some for t in c)
    out = []
    for item, text in items:
        asked, scored = own(text), []
        for d, c in some:
            m = 100 - 25 + (25 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in asked if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def _random_docs(rng, n):
    words = [f"w{i}" for i in range(60)] + ["É", "straße", "don't", "x_y", "日本", "A1"]
    return [(i * 7 - 50, " ".join(rng.choices(words, k=rng.choice((0, 1, 3, 40, 300))))) for i in range(n)]


@pytest.mark.parametrize("window", [8, 4096])
def test_search_against_brute_force(spark, window, monkeypatch):
    rng = random.Random(window)
    docs = _random_docs(rng, 300)
    docs += [(9000 + i, "w1 W1 w2") for i in range(60)]  # ties
    docs += [(None, "w1 w1 w2"), (5, None), (6, ""), (7, " ,;-")]
    items = [(1, "w1"), (2, "w1 w1 w2 W2"), (3, "nothing here"), (4, None), (5, ""), (6, "É straße x 日本"), (7, docs[9][1])]
    monkeypatch.setattr(search.postings, "__defaults__", ("text", "doc_id", window))
    frame = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], DOCS).repartition(3)
    got = search.search(frame, spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, doc_id int"))
    assert sorted(map(tuple, got.collect()), key=str) == _best(docs, items)


def test_search_in_blocks(spark):
    rng = random.Random(3)
    docs = _random_docs(rng, 120)
    items = [(i, " ".join(rng.choices([f"w{j}" for j in range(60)], k=5))) for i in range(12)]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items + items[:3], "item_id long, text string")
    got = search.search(*frames, block_terms=10)  # equal items are one
    assert sorted(map(tuple, got.collect()), key=str) == _best(docs, items)


def test_search_empty_tables(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert search.search(none, one).count() == 0
    assert search.search(spark.createDataFrame([(1, "a")], "doc_id long, text string"), one.limit(0)).count() == 0


def test_search_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "c"), (3, "c d")], "doc_id long, text string")
    got = search.search(docs, spark.createDataFrame([(1, "a")], "item_id long, text string")).collect()
    assert [(r["rank"], r["doc_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1), (2, 1)]


def test_terms_in_pieces(monkeypatch):
    monkeypatch.setattr(search, "PIECE", 5)
    text = "Some words, and Öther  ones-1 " * 9
    assert [t for part in search.terms(text.encode()) for t in part] == [t.encode() for t in re.findall(search.TERM, text.translate(str.maketrans(search.UPPER, search.LOWER)))]


def test_search_equals_sql(same_as_sql):
    same_as_sql(search.op11_lexical_search, search.ORACLE)


# --- 12 --------------------------------------------------------------------------------------------------------------


def _paths():
    import public_tokenizers as tokenizers

    return tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model")


def _aligned(docs):
    """Rows by the definition: both libraries on whole texts, all pairs of a text's tokens."""
    import sentencepiece
    from tokenizers import Tokenizer

    byte_path, piece_path = _paths()
    one, two = Tokenizer.from_file(byte_path), sentencepiece.SentencePieceProcessor(model_file=piece_path)
    one.encode_special_tokens = True
    of = alignment._byte_level()
    per_doc, counts = [], Counter()
    for d, t in docs:
        row = None
        if t:
            a = one.encode(" " + t, add_special_tokens=False)
            sa = [bytes(of[c] for c in x) for x in a.tokens]
            b = two.encode(t)
            sb = [bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [two.id_to_piece(i)]]
            if b"".join(sa) == b"".join(sb) == b" " + t.encode():
                ea, eb = np.cumsum([len(x) for x in sa]).tolist(), np.cumsum([len(x) for x in sb]).tolist()
                both, groups, low = sorted(set(ea) & set(eb)), [], 0
                for e in both:
                    groups.append(",".join(str(i) for i, x in zip(a.ids, ea) if low < x <= e) + "|" + ",".join(str(i) for i, x in zip(b, eb) if low < x <= e))
                    low = e
                links = [(i, j) for i, x, s in zip(a.ids, ea, sa) for j, y, z in zip(b, eb, sb) if x - len(s) < y and y - len(z) < x]
                row = (len(sa), len(sb), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())
                counts.update(set(links))
        per_doc.append((d, row))
    top = defaultdict(int)
    for (i, _), n in counts.items():
        top[i] = max(top[i], n)
    out = []
    for d, row in per_doc:
        if row is None:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
        else:
            a, b, g, links, sha = row
            out.append((d, a, b, g, len(links), sum(counts[x] == top[x[0]] for x in links), sum(counts[x] for x in links), sha))
    return sorted(out, key=str)


TEXTS = [
    None, "", " ", "a", "  two  blanks ", "tab\there", "line\nline\n\nline ", "▁ mark", "word ▁mark word", "<s> </s> <unk> <|endoftext|>", "don't we'll 'tis", "naïve café — 日本語 😀", "é   　x", "zero\x00byte", "x​y ​z",
    "antidisestablishmentarianism supercalifragilistic 1234567890 !!!???", "ﬁ ½ ™", "a" * 500, "ab " * 300, "\u0085next \x1cfs", "the the the The THE",
]


@pytest.mark.parametrize("part,pairs", [(1 << 15, 1 << 20), (16, 1 << 20), (16, 1)])
def test_alignment_against_brute_force(spark, sf, part, pairs, monkeypatch):
    rng = random.Random(part)
    some = [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").where("n_chars < 400").select("text").limit(12).collect()]
    texts = TEXTS + some + [" ".join(rng.choices(["alpha", "Beta,", "γάμμα", "de-lta\n", "x"], k=30)) for _ in range(6)]
    docs = list(enumerate(texts)) + [(None, "null id"), (3, "same id"), (3, "same id")]
    frame = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], DOCS).coalesce(1)
    monkeypatch.setattr(alignment, "PART", part)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = alignment.align(frame, *_paths(), pairs=pairs)
    if part < 100:  # workers have a PART of their own
        assert [len(alignment._parts(np.arange(1, 100), np.arange(3, 100, 3))) > 1] == [True]
    assert got.columns == columns
    assert sorted(map(tuple, got.collect()), key=str) == _aligned(docs)


def test_alignment_of_a_long_text(spark):
    text = " ".join(f"word{i % 97} Straße" for i in range(20_000))
    docs = [(1, text), (2, "word1 Straße")]
    got = {r["doc_id"]: tuple(r) for r in alignment.align(spark.createDataFrame(docs, "doc_id long, text string"), *_paths()).collect()}
    enc = alignment.encoders(*_paths())
    a, b = enc.both(text)  # as a whole
    ends = [np.cumsum(n[x]) for x, n in ((a, enc.a_len), (b, enc.b_len))]
    assert len(alignment._parts(*ends)) > 5
    groups = np.intersect1d(*ends)
    assert got[1][1:5] == (len(a), len(b), len(groups), len(a) + len(b) - len(groups))
    cut = lambda ids, e: ["," .join(map(str, ids[i:j])) for i, j in zip([0, *(np.searchsorted(e, groups[:-1], "right"))], np.searchsorted(e, groups, "right"))]
    whole = ";".join(f"{x}|{y}" for x, y in zip(cut(a, ends[0]), cut(b, ends[1])))
    assert got[1][7] == hashlib.sha256(whole.encode()).hexdigest()


def test_groups_and_links_are_made_in_arrays(spark):
    """No function of an array's elements is left to the JVM, and what a long text's parts have goes on from batch to batch."""
    text = " ".join(f"word{i % 89} Straße" for i in range(40_000))
    docs = [(1, "word1 Straße"), (2, text), (3, None), (4, "word2 Straße")]
    table = alignment.linked(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), *_paths())
    assert "lambda" not in table._jdf.queryExecution().toString()
    enc = alignment.encoders(*_paths())
    a, b = enc.both(text)
    assert len(a) > alignment.TOKENS
    rows = sorted(map(tuple, table.select("doc_id", "parts", "n_a", "n_b", F.size("links"), "digest").collect()))
    long_ = [r for r in rows if r[0] == 2]
    assert len(long_) == long_[0][1] > 5
    ends = [np.cumsum(n[x]) for x, n in ((a, enc.a_len), (b, enc.b_len))]
    assert [sum(r[i] for r in long_) for i in (2, 3, 4)] == [len(a), len(b), len(np.union1d(*ends))]
    shared = np.intersect1d(*ends)
    groups = [",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in zip(*(np.split(i, np.searchsorted(e, shared, "right")[:-1]) for i, e in zip((a, b), ends, strict=True)), strict=True)]
    assert [r[5] for r in long_ if r[5]] == [hashlib.sha256(";".join(groups).encode()).hexdigest()]
    assert [r for r in rows if r[0] == 3] == [(3, 1, 0, 0, 0, "")]


def test_words_encode_as_texts():
    enc = alignment.encoders(*_paths())
    rng = random.Random(1)
    parts = ["a", " ", "  ", "\n", "Wort", "'s", "12", "é", "▁", "\x00", "😀", "-", "_", "the"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randrange(1, 14)))
        a, b = enc.both(text)
        good = enc.joined(a, b) == b" " + text.encode()
        x, y = enc.encode(text)
        assert (x.tolist(), y.tolist()) == ((a.tolist(), b.tolist()) if good else ([], [])), text


def test_alignment_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), *_paths()).count() == 0


# --- 13 --------------------------------------------------------------------------------------------------------------


def test_classifier_on_held_out_labels(spark, sf):
    d = sf.replace("sf0.001", "sf0.1")
    got = classifier.op13_quality_classifier(spark, d)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    pdf = got.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id", "left").toPandas()
    assert len(pdf) == docs.count()
    assert ((pdf["score"] >= 0) & (pdf["score"] <= 1)).all() and ((pdf["score"] >= 0.7) == (pdf["predicted"] == 1)).all()
    assert (pdf["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in pdf["doc_id"]]).all()
    test = pdf[pdf["held_out"] & pdf["quality"].notna()]
    one, zero = test[test["quality"] == 1]["score"], test[test["quality"] == 0]["score"]
    auc = np.mean([(one > s).mean() + (one == s).mean() / 2 for s in zero])
    assert auc > 0.99 and (test["predicted"] == test["quality"]).mean() > 0.97


def test_labels_held_out_are_not_learned(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumn("quality", F.when(F.pmod(classifier.crc("doc_id"), F.lit(4)) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    learn = F.pmod(classifier.crc("doc_id"), F.lit(4)) != 2
    a, b = (dict((r["doc_id"], r["score"]) for r in classifier.classify(docs, t, learn).collect()) for t in (labels, other))
    assert a == pytest.approx(b)


def test_classifier_awkward_rows(spark):
    good, bad = "The words of one text, and more of them. They go on.", "A!! B!! C!! *** ### |"
    rows = [(i, (good if i % 2 else bad) + f" {i}", 1, "x") for i in range(200)] + [(None, good, 1, "x"), (500, None, 1, "x"), (501, "", 1, "x"), (502, "word " * 100_000, 1, "x"), (3, good, 1, "x"), (3, good, 1, "x")]
    labels = [(i, i % 2) for i in range(200)] + [(3, 0), (4, None), (None, 1)]
    learn = F.lit(True)
    got = classifier.classify(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int"), learn).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["predicted"] == r["doc_id"] % 2 for r in got if r["doc_id"] is not None and r["doc_id"] < 200]) > 0.97
    none = classifier.classify(spark.createDataFrame(rows, DOCS), spark.createDataFrame([], "doc_id long, quality int"), learn)
    assert {(r["score"], r["predicted"]) for r in none.collect()} == {(0.5, 0)}
    assert classifier.classify(spark.createDataFrame([], DOCS), spark.createDataFrame(labels, "doc_id long, quality int"), learn).count() == 0


def test_isotonic_is_the_best_monotone_fit():
    rng = np.random.default_rng(0)
    for _ in range(50):
        n = rng.integers(2, 9)
        y, w = rng.integers(0, 5, n).astype(float), rng.integers(1, 4, n).astype(float)
        x, v = classifier.isotonic(np.arange(n, dtype=float), w, y * w)
        assert (np.diff(v) > 0).all() and (np.diff(x) > 0).all()
        # Pools' means are the max-min means of the definition.
        best = [max(min(np.average(y[j : k + 1], weights=w[j : k + 1]) for k in range(i, n)) for j in range(i + 1)) for i in range(n)]
        assert sorted(set(np.round(best, 9))) == pytest.approx(sorted(set(np.round(v, 9))))


def test_normal_equations_and_kernel(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4))
    kernel = classifier.Kernel(x.mean(0), x.std(0), count=40, width=3.0)
    n, total = rng.integers(1, 4, 300), rng.integers(0, 2, 300)
    rows = spark.createDataFrame([(a.tolist(), int(b), int(c)) for a, b, c in zip(x, n, total)], "x array<double>, n long, total long").repartition(5)
    z = kernel(x)
    want = np.hstack([z.T @ (z * n[:, None]), (z.T @ total)[:, None]])
    assert np.allclose(classifier.normal_equations(rows, kernel), want)
    wide = classifier.Kernel(np.zeros(4), np.ones(4), count=20_000, width=3.0)
    a, b = x[:1], x[1:2]
    gauss = math.exp(-((a - b) ** 2).sum() / (2 * 9))
    assert abs(float((wide(a)[:, :-1] @ wide(b)[:, :-1].T)[0, 0]) - gauss) < 0.05

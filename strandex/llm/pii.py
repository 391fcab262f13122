"""Personal data: fixed patterns, and bootstrapped contextual extraction of identifiers that they miss.

Seeds are the base spans (email, ip, card, phone) and tokens that by their form can only be machine identifiers (long hexadecimal
strings with digits and letters, UUIDs). The words around them induce lexical patterns: the one, two or three words before, and the one or two
before with the word after. Other number-like tokens of the texts are instances, joined with patterns to a bipartite graph.
Spark scores it iteratively: a pattern by its precision, which is the score of what it extracts over how often its words
stand before something known or something that is no instance (smoothed against little support). An instance of which nothing
is known yet is neither right nor wrong, as long as a tenth of what a pattern extracts is known. An instance is scored by the noisy-or of the
patterns that extract it and are right more often than not. Instances so found support further patterns in the next round. Tokens that
patterns of high confidence extract are added as spans of kind `id`; base spans always stay.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .base import forget, written
from .jaccard import _mix, word_hashes

KINDS = ("email", "ip", "card", "phone")
#: Fixed values.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # a match begins with its run of digits; saying so keeps long runs linear
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

ROUNDS = 4
SUPPORT = 5  # distinct instances, seeds among them, that a pattern needs
SMOOTH = 2.0  # slots of score 0 that each pattern is given
LIKELY = 0.5  # precision from which a pattern speaks for its instances
CONFIDENT = 0.8
KNOWN = 0.1  # share of a pattern's occurrences that has to be known, seeds or found ones, for the pattern to be scored
BITS = 24  # of the bitmap of patterns' hashes, 2 MB whatever their number, by which the pass over all slots leaves out most others
FLUSH = 1_000_000  # slots whose patterns are counted at once in a task
BROADCAST = 100_000  # patterns (2 MB) up to which they are broadcast; beyond, they are shuffled

_STRONG = re.compile(r"(?=[0-9A-Fa-f]*[0-9])(?=[0-9A-Fa-f]*[A-Fa-f])[0-9A-Fa-f]{32,}|[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: A context: how many words before, whether the word after, and odd multipliers of the words' hashes.
CONTEXTS = tuple((n, after, [int(x) | 1 for x in np.random.default_rng(97 + 2 * n + after).integers(1, 2**63, 4)]) for n, after in ((1, 0), (2, 0), (3, 0), (1, 1), (2, 1)))
_MASK = (1 << 64) - 1
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_NUMBER = re.compile(r"[A-Za-z0-9]+(?:[_/.#:-]+[A-Za-z0-9]+)*")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += (2 * n - 9 * (n > 4)) if k % 2 else n
    return total % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def emails(text: str) -> list[tuple[int, int]]:
    """EMAIL's matches, looked for at each @ only: trying it at every letter of a long word takes the square of its length."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        start = at
        while start > free and not _NOT_LOCAL.match(text, start - 1):
            start -= 1
        if m and start < at:
            out.append((start, m.end()))
            free = m.end()
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, in the order of KINDS, then start; code points, end exclusive."""
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(_byte(x) for x in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub(r"[\x20-]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def slots(word: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The hashes of all patterns of all slots: whatever stands at a word of some texts, with the words around it in its text."""
    here = np.arange(len(word)) - np.repeat(at[:-1], np.diff(at))
    rest = np.repeat(at[1:], np.diff(at)) - np.arange(len(word)) - 1
    out = []
    with np.errstate(over="ignore"):
        for n, after, odd in CONTEXTS:
            i = np.flatnonzero((here >= n) & (rest >= after))
            h = np.full(len(i), odd[3], np.uint64)
            for d in range(n):
                h += word[i - 1 - d] * np.uint64(odd[d])
            if after:
                h ^= _mix(word[i + 1] + np.uint64(odd[3]))
            out.append(_mix(h))
    return np.concatenate(out)


def _around(word: np.ndarray, i: int, j: int) -> list[int]:
    """The patterns of a span over the words i to j, as slots() has them; only a single word has a word after it."""
    out = []
    with np.errstate(over="ignore"):
        for n, after, odd in CONTEXTS:
            if i >= n and (not after or i == j and j + 1 < len(word)):
                h = np.array([odd[3]], np.uint64)
                for d in range(n):
                    h += word[i - 1 - d] * np.uint64(odd[d])
                if after:
                    h ^= _mix(word[j + 1 : j + 2] + np.uint64(odd[3]))
                out.append(int(_mix(h).view(np.int64)[0]))
    return out


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Tokens of five characters and four digits or more that no base span touches."""
    if len(re.findall("[0-9]", text)) < 4:
        return []
    used: list[list[int]] = []  # disjoint, in order
    for a, b in sorted((a, b) for _, a, b in taken):
        if used and a < used[-1][1]:
            used[-1][1] = max(used[-1][1], b)
        else:
            used.append([a, b])
    ends = [b for _, b in used]
    out = []
    for n in _NUMBER.finditer(text):
        if n.end() - n.start() < 5 or len(re.findall("[0-9]", n[0])) < 4:
            continue
        k = bisect_right(ends, n.start())
        if k == len(used) or used[k][0] >= n.end():
            out.append(n.span())
    return out


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per document: its base spans, and what the graph needs of seeds and candidates. One pass over whole texts."""

    def run(batches):
        for pdf in batches:
            out: dict[str, list] = {c: [] for c in ("doc_id", *(f"n_{k}" for k in KINDS), "base", "base_sha256", "seeds", "cands")}
            for i, t in zip(pdf["i"], pdf["t"], strict=True):
                t = t or ""
                spans = base_spans(t) if re.search("[0-9@]", t) else []
                out["doc_id"].append(i)
                for k in KINDS:
                    out[f"n_{k}"].append(sum(s[0] == k for s in spans))
                out["base"].append(_joined(spans))
                out["base_sha256"].append(hashlib.sha256(out["base"][-1].encode()).hexdigest())
                found = candidates(t, spans)
                pats = {}
                if spans or found:
                    word, _ = word_hashes([t.encode("utf-8", "surrogatepass")])
                    starts = [m.start() for m in _WORD.finditer(t)]
                    pats = {(a, b): _around(word, bisect_right(starts, a) - 1, bisect_left(starts, b) - 1) for a, b in [s[1:] for s in spans] + found}
                out["seeds"].append([{"inst": t[a:b], "pats": p} for _, a, b in spans if (p := pats[a, b])])
                out["cands"].append([{"start": a, "end": b, "inst": t[a:b], "pats": p, "seed": float(_STRONG.fullmatch(t, a, b) is not None)} for a, b in found if (p := pats[a, b])])
            yield pd.DataFrame(out)

    kind = dict(docs.dtypes)[id]
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    schema = f"doc_id {kind}, {counts}, base string, base_sha256 string, seeds array<struct<inst:string,pats:array<long>>>, cands array<struct<start:long,end:long,inst:string,pats:array<long>,seed:double>>"
    return docs.select(F.col(id).alias("i"), F.col(text).alias("t")).mapInPandas(run, schema)


def background(docs: DataFrame, patterns: DataFrame, text: str = "text") -> DataFrame:
    """(pat, slots): how often each of `patterns` (pat, distinct) stands before anything at all, over all whole texts.

    What the driver gets and workers receive is a bitmap of 2^BITS bits, whatever the number of patterns.
    """
    spark = docs.sparkSession
    code = F.shiftrightunsigned("pat", 64 - BITS)
    rows = patterns.select(F.shiftright(code, 15).alias("bucket"), code.bitwiseAND(F.lit(32767).cast("long")).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    bits = np.zeros(1 << (BITS - 3), np.uint8)
    for r in rows:
        bits[r["bucket"] << 12 : (r["bucket"] + 1) << 12] = np.frombuffer(bytes(r["bits"]), np.uint8)
    known = spark.sparkContext.broadcast(bits)

    def count(batches):
        bits, held = known.value, []

        def flush():
            v, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pd.DataFrame({"pat": v.view(np.int64), "n": n.astype(np.int64)})

        for pdf in batches:
            texts, i = list(pdf["t"]), 0
            while i < len(texts):  # blocks of about a megabyte
                j, size = i, 0
                while j < len(texts) and (j == i or size < 1_000_000):
                    size += len(texts[j] or "")
                    j += 1
                h = slots(*word_hashes([(t or "").encode("utf-8", "surrogatepass") for t in texts[i:j]]))
                code = h >> np.uint64(64 - BITS)
                held.append(h[(bits[(code >> np.uint64(3)).astype(np.int64)] >> (code & np.uint64(7)).astype(np.uint8)) & 1 == 1])
                if sum(map(len, held)) > FLUSH:
                    yield flush()
                i = j
        if held:
            yield flush()

    seen = docs.select(F.col(text).alias("t")).mapInPandas(count, "pat long, n long")
    return seen.groupBy("pat").agg(F.sum("n").alias("slots")).join(patterns, "pat", "left_semi")


def scores(docs: DataFrame, found: DataFrame, text: str = "text", rounds: int = ROUNDS, support: int = SUPPORT) -> DataFrame:
    """(pat, score) of the patterns that can be right more often than not, after some rounds. Both sides are grouped sums over edges.

    An edge is a pattern and a distinct instance, with the number of its occurrences there. A pattern needs `support`
    distinct instances, so that a token repeated a million times is no support. Those that most often stand before
    something else, which stop words do, go before the first round.
    """
    seeds = found.select(F.explode("seeds").alias("s")).select(F.explode("s.pats").alias("pat"), F.col("s.inst").alias("inst"), F.lit(1.0).alias("seed"))
    cands = found.select(F.explode("cands").alias("s")).select(F.explode("s.pats").alias("pat"), F.col("s.inst").alias("inst"), F.col("s.seed").alias("seed"))
    edges = written(seeds.unionByName(cands).groupBy("pat", "inst").agg(F.max("seed").alias("seed"), F.count("*").alias("occ")), "edges")
    several = written(edges.groupBy("pat").agg(F.count("*").alias("n"), F.sum("occ").alias("occ")).where(F.col("n") >= support).select("pat", "occ"), "patterns")
    base = background(docs, several.select("pat"), text).join(several, "pat")
    base = written(base.where((F.col("slots") + SMOOTH) * LIKELY <= F.col("occ")).select("pat", "slots"), "patterns")
    small = base.limit(BROADCAST + 1).count() <= BROADCAST
    near = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    graph = written(edges.join(near(base), "pat"), "graph")
    inst = graph.groupBy("inst").agg(F.max("seed").alias("score"))
    old = []
    for k in range(rounds):
        pats = graph.join(inst, "inst").groupBy("pat", "slots").agg(F.sum(F.col("occ") * F.col("score")).alias("s"), F.sum(F.when(F.col("score") > 0, F.col("occ")).otherwise(0)).alias("k"), F.sum("occ").alias("o"))
        against = F.greatest(F.col("slots") - F.col("o"), F.lit(0)) + F.col("k") + SMOOTH
        pats = written(pats.select("pat", F.when(F.col("s") >= KNOWN * F.col("o"), F.round(F.col("s") / against, 9)).otherwise(0.0).alias("score")), "scores")
        if k < rounds - 1:
            # 1 - product of (1 - score) over an instance's patterns; a seed stays 1
            told = graph.join(near(pats.withColumnRenamed("score", "p")), "pat").withColumn("p", F.when(F.col("p") >= LIKELY, F.least("p", F.lit(0.999999))).otherwise(0.0))
            inst = told.groupBy("inst").agg(F.greatest(F.max("seed"), 1 - F.exp(F.sum(F.log(1 - F.col("p"))))).alias("score"))
            inst = written(inst, "scores")
            old += [pats, inst]
    forget(edges, several, base, graph, *old)
    return pats


def find(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_id, n_spans), one row for each row of `docs`.

    The first four counts are of base spans; n_spans is of all. Null and empty texts have none. Repeated rows are treated
    alike, and a null id stays null. A text of any length is read whole, in time in proportion to its length, in its
    task's memory. Other columns, whatever their names, are ignored. Without enough seeds there are no patterns and nothing
    is added; an empty table gives an empty one.
    """
    found = written(scan(docs, text, id).withColumn("row", F.monotonically_increasing_id()), "scan")
    pats = scores(docs, found, text)
    good = pats.where(F.col("score") >= CONFIDENT).select("pat")
    if good.limit(BROADCAST + 1).count() <= BROADCAST:
        good = F.broadcast(good)
    one = found.select("row", F.explode("cands").alias("c")).select("row", "c.start", "c.end", F.explode("c.pats").alias("pat"))
    hits = one.join(good, "pat", "left_semi").select("row", "start", "end").distinct()
    more = hits.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("m"))
    out = found.join(more, "row", "left")
    extra = F.transform(F.coalesce("m", F.array().cast("array<struct<start:long,end:long>>")), lambda x: F.concat(F.lit("id:"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string")))
    n_id = F.coalesce(F.size("m"), F.lit(0)).cast("long")
    out = out.select(
        "doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", F.array_join(F.concat(F.filter(F.array("base"), lambda b: b != ""), extra), ",").alias("spans"), n_id.alias("n_id"), (n_id + sum((F.col(f"n_{k}") for k in KINDS[1:]), F.col(f"n_{KINDS[0]}"))).alias("n_spans")
    )
    out = written(out, "found")
    forget(found, pats)
    return out


def op3_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in all `documents`. Awkward rows: see find."""
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Ranked lexical search by windows of documents.

Documents are numbered within a task, in the order of their doc_id; WINDOW numbers in a row are a window. A window's
postings are kept by term: for each term the slots of its documents and how often it stands in each. To score an item,
the postings of its terms are traversed window by window and their shares added up in an array of WINDOW integers that
stays in the processor's cache; a bitset of the slots touched tells which to harvest into the item's heap and which to
set back. No row is made for a pair of an item and a document.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .base import forget, written

WINDOW = 4096  # slots: 32 KB of scores
TOP = 20
#: Terms of items that the driver and a task hold at once; more items are searched in blocks of about as many.
BLOCK_TERMS = 200_000
PIECE = 1 << 20  # bytes of a text that are split at once

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms(data: bytes):
    """The terms of a UTF-8 text, in lists of about PIECE bytes each."""
    data = data.translate(_FOLD)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _inverted(docs: list[tuple]) -> dict:
    """One window: its documents (doc_id, n, {term: tf}) by slot, and their postings by term."""
    where: dict[int, list[tuple[int, int]]] = {}
    for slot, (_, _, tfs) in enumerate(docs):
        for t, tf in tfs.items():
            where.setdefault(t, []).append((slot, tf))
    order = sorted(where)
    flat = [p for t in order for p in where[t]]
    return {
        "doc_ids": [d for d, _, _ in docs],
        "lengths": [n for _, n, _ in docs],
        "terms": order,
        "dfs": [len(where[t]) for t in order],
        "slots": [s for s, _ in flat],
        "tfs": [tf for _, tf in flat],
    }


def postings(docs: DataFrame, vocabulary: dict[bytes, int], text: str = "text", id: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """Windows (doc_ids, lengths, terms, dfs, slots, tfs, n_docs, n_terms): the postings of the vocabulary's terms.

    `terms` are numbers of the vocabulary, `dfs` how many of `slots` and `tfs` belong to each. n_docs and n_terms count all documents with a
    term and all terms, also those that are in no posting. One pass over the texts, without a shuffle; a task holds the postings of one window and one batch.
    """
    kind = dict(docs.dtypes)[id]
    schema = f"doc_ids array<{kind}>, lengths array<long>, terms array<int>, dfs array<int>, slots array<int>, tfs array<int>, n_docs long, n_terms long"

    def run(batches):
        arrow = out_type = None
        held: list[tuple] = []
        n_docs = n_terms = 0

        def window_rows(some, counts):
            row = _inverted(some) | dict(zip(("n_docs", "n_terms"), counts, strict=True))
            return pa.RecordBatch.from_pylist([row], schema=out_type)

        for batch in batches:
            if arrow is None:
                arrow = batch.schema.field("i").type
                ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
                out_type = pa.schema([("doc_ids", pa.list_(arrow)), ("lengths", longs), ("terms", ints), ("dfs", ints), ("slots", ints), ("tfs", ints), ("n_docs", pa.int64()), ("n_terms", pa.int64())])
            for doc, data in zip(batch.column("i"), batch.column("t"), strict=True):
                found: Counter = Counter()
                n = 0
                for part in terms(data.as_py() or b""):
                    n += len(part)
                    found.update(map(vocabulary.get, part))
                found.pop(None, None)
                n_docs, n_terms = n_docs + (n > 0), n_terms + n
                if found:
                    held.append((doc.as_py(), n, found))
            while len(held) >= window:
                held.sort(key=lambda d: (d[0] is None, d[0] if d[0] is not None else 0))
                yield window_rows(held[:window], (n_docs, n_terms))
                held, n_docs, n_terms = held[window:], 0, 0
        if held or n_docs:
            held.sort(key=lambda d: (d[0] is None, d[0] if d[0] is not None else 0))
            yield window_rows(held, (n_docs, n_terms))

    return docs.select(F.col(id).alias("i"), F.col(text).cast("binary").alias("t")).mapInArrow(run, schema)


class Scorer:
    """Scores of items over windows, and the k best documents of each so far."""

    def __init__(self, items: list[list[tuple[int, int]]], weights: dict[int, int], n: int, total: int, k: int):
        self.items, self.weights, self.n, self.total, self.k = items, weights, n, total, k
        self.heaps: list[list[tuple]] = [[] for _ in items]
        self.scores = np.zeros(WINDOW, np.int64)

    def add(self, row: dict) -> None:
        ids, lengths = row["doc_ids"], row["lengths"]
        if len(ids) > len(self.scores):
            self.scores = np.zeros(len(ids), np.int64)
        m = np.array([75 + (25 * n * self.n) // self.total for n in lengths], np.int64)
        slots, tfs, dfs = (row[c].astype(np.int64) for c in ("slots", "tfs", "dfs"))
        w = np.repeat(np.array([self.weights.get(t, 0) for t in row["terms"]], np.int64), dfs)
        shares = w * ((1_000_000_000 * tfs) // (1000 * tfs + 12 * m[slots])) if len(slots) else slots
        ends = np.cumsum(dfs)
        here, width = {}, (len(ids) + 7) // 8
        for t, low, high in zip(row["terms"], ends - dfs, ends, strict=True):
            bits = np.zeros(width * 8, bool)
            bits[slots[low:high]] = True
            here[t] = (slots[low:high], shares[low:high], int.from_bytes(np.packbits(bits).tobytes(), "big"))
        for item, heap in zip(self.items, self.heaps, strict=True):
            touched = 0
            for t, times in item:
                if t in here:
                    at, share, bits = here[t]
                    self.scores[at] += share * times if times > 1 else share
                    touched |= bits
            if touched:
                at = np.flatnonzero(np.unpackbits(np.frombuffer(touched.to_bytes(width, "big"), np.uint8)))
                self._harvest(heap, at, self.scores[at], ids)
                self.scores[at] = 0

    def _harvest(self, heap: list[tuple], at: np.ndarray, score: np.ndarray, ids: list) -> None:
        least = max(1, heap[0][0]) if len(heap) == self.k else 1
        if len(score) > self.k:
            least = max(least, int(np.partition(score, -self.k)[-self.k]))
        good = score >= least  # of equal scores the smaller doc_id is better, so that all of them come in
        for slot, s in zip(at[good].tolist(), score[good].tolist(), strict=True):
            entry = (s, _Last(ids[slot]))
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif heap[0] < entry:
                heapq.heapreplace(heap, entry)


class _Last:
    """A doc_id in falling order, null the last of all."""

    __slots__ = ("id",)

    def __init__(self, id):
        self.id = id

    def __eq__(self, other):
        return self.id == other.id

    def __lt__(self, other):
        if other.id is None:
            return False
        return self.id is None or self.id > other.id


def _asked(items: DataFrame, text: str, id: str) -> DataFrame:
    """(item_id, th, term, times) of the distinct items."""
    rows = items.select(F.col(id).alias("item_id"), F.col(text).alias("t")).where("t IS NOT NULL").distinct()
    own = F.explode(F.regexp_extract_all(F.translate("t", UPPER, LOWER), F.lit(TERM), F.lit(0)))
    return rows.select("item_id", F.xxhash64("t").alias("th"), own.alias("term")).groupBy("item_id", "th", "term").agg(F.count("*").alias("times"))


def search(docs: DataFrame, items: DataFrame, k: int = TOP, block_terms: int = BLOCK_TERMS, text: str = "text", id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item with a score above 0, equal scores by ascending doc_id.

    Items come in blocks of about `block_terms` terms: their terms are what a task holds beside a window; all documents
    are searched for each block. Statistics are of all documents. Null and empty texts, of documents or items, have no terms: they
    count nowhere and find nothing. Each row of `docs` is a document, whatever its id: rows that share one are ranked
    each, in either order where scores are equal too, and null ids are the last of their score. Equal items (id and text) are one; items that
    share an id only are ranked each. Columns of both tables but id and text are ignored; empty tables give no rows.
    """
    spark = docs.sparkSession
    item_kind, doc_kind = dict(items.dtypes)[item_id], dict(docs.dtypes)[id]
    schema = f"item long, doc_id {doc_kind}, score long"
    asked = written(_asked(items, item_text, item_id), "asked")
    blocks = max(1, -(-asked.count() // block_terms))
    out = []
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item_id", "th"), F.lit(blocks)) == block) if blocks > 1 else asked
        numbers: dict[tuple, int] = {}
        vocabulary: dict[bytes, int] = {}
        queries: list[list[tuple[int, int]]] = []
        for r in own.toLocalIterator():  # about block_terms rows
            at = numbers.setdefault((r["item_id"], r["th"]), len(numbers))
            if at == len(queries):
                queries.append([])
            queries[at].append((vocabulary.setdefault(r["term"].encode(), len(vocabulary)), r["times"]))
        windows = written(postings(docs, vocabulary, text, id), "postings")
        n, total = windows.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
        each = windows.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy("x.terms").agg(F.sum("x.dfs").alias("df"))
        weights = {r["terms"]: weight(n, r["df"]) for r in each.toLocalIterator()}  # a row for each term asked for, at most

        def run(batches, queries=queries, weights=weights, n=n, total=total):
            scorer = Scorer(queries, weights, n, total, k)
            ids = None
            for batch in batches:
                ids = batch.schema.field("doc_ids").type.value_type
                for at in range(batch.num_rows):  # a batch may hold many windows
                    lists = ("doc_ids", "lengths", "terms")
                    row = {c: batch.column(c)[at].as_py() for c in lists}
                    scorer.add(row | {c: batch.column(c)[at].values.to_numpy() for c in ("slots", "tfs", "dfs")})
            if ids is not None:
                found = [(i, e[1].id, e[0]) for i, heap in enumerate(scorer.heaps) for e in heap]
                cols = [list(c) for c in zip(*found, strict=True)] or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], ids), pa.array(cols[2], pa.int64())], ["item", "doc_id", "score"])

        best = windows.select("doc_ids", "lengths", "terms", "dfs", "slots", "tfs").mapInArrow(run, schema)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        best = written(best, "best")
        forget(windows)
        names = spark.createDataFrame([(i, *key) for key, i in numbers.items()], f"item long, item_id {item_kind}, th long")
        out.append(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    forget(asked)
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def op11_lexical_search(spark, sf_dir: str) -> DataFrame:
    """The 20 best of all `documents` for each item of `benchmark`. Awkward rows: see search."""
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_SQL_TERMS = f"unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term"
ORACLE = f"""WITH t AS (SELECT doc_id, {_SQL_TERMS} FROM documents), n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
s AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM n),
u AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {_SQL_TERMS} FROM benchmark) GROUP BY item_id, term),
f AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM t WHERE term IN (SELECT term FROM u) GROUP BY doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, s GROUP BY term, docs),
m AS (SELECT doc_id, 100 - 25 + ((25 * n * docs) // total) AS m FROM n, s),
r AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM u JOIN f USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= 20"""

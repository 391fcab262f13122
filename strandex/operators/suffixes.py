"""Suffix order by prefix doubling, and longest common prefixes by Kasai's method."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from strandex.functions.symbols import symbols

from .lineage import forget, written


def suffix_array(corpus: DataFrame, text: str = "text", id: str = "doc_id", rounds: int = 40, end_last: bool = False) -> DataFrame:
    """(doc_id, rank, pos): the suffixes of each text in binary order, ranks from 0; a text's end sorts before any symbol, or after if `end_last`.

    Ranks by 2^i symbols are made of the pair of ranks at pos and pos + 2^i. Each round sorts within texts, until all
    ranks of a text differ. A row is a text of its own, whatever its id: null ids and repeated ones are kept apart.
    """
    rows = corpus.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("doc_id"), F.col(text).alias("_t"))
    cur = rows.select("row", "doc_id", F.posexplode(symbols(F.col("_t"))).alias("pos", "ch"))
    cur = cur.select("row", "doc_id", F.col("pos").cast("long").alias("pos"), F.dense_rank().over(Window.partitionBy("row").orderBy("ch")).cast("long").alias("r"))
    cur, step = written(cur, "ranks"), 1
    for _ in range(rounds):
        if not cur.groupBy("row").agg((F.count("*") > F.max("r")).alias("ties")).where("ties").limit(1).count():
            break
        both = cur.withColumn("r2", F.lead("r", step, (1 << 62) if end_last else 0).over(Window.partitionBy("row").orderBy("pos")))
        new = written(both.select("row", "doc_id", "pos", F.dense_rank().over(Window.partitionBy("row").orderBy("r", "r2")).cast("long").alias("r")), "ranks")
        forget(cur)
        cur, step = new, 2 * step
    return cur.select("doc_id", (F.col("r") - 1).alias("rank"), "pos")


def order(text: str) -> list[int]:
    """The starts of the suffixes of one text in binary order, by prefix doubling."""
    n, step = len(text), 1
    rank = list(map(ord, text))
    while True:
        pairs = [(rank[i], rank[i + step] if i + step < n else -1) for i in range(n)]
        of = {x: k for k, x in enumerate(sorted(set(pairs)))}
        rank = [of[x] for x in pairs]
        if len(of) == n:
            return sorted(range(n), key=rank.__getitem__)
        step *= 2


def kasai(text: str, order) -> list[int]:
    """The common prefix of each suffix, in `order`, with the one before it; 0 for the first. Linear in the text."""
    n = len(text)
    rank = [0] * n
    for k, at in enumerate(order):
        rank[at] = k
    out, h = [0] * n, 0
    for at in range(n):
        if not rank[at]:
            h = 0
            continue
        before = order[rank[at] - 1]
        while at + h < n and before + h < n and text[at + h] == text[before + h]:
            h += 1
        out[rank[at]] = h
        h = max(h - 1, 0)
    return out


def lcp_array(corpus: DataFrame, sa: DataFrame, longest: int | None = None, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, rank, pos, lcp): common prefix with the suffix before it, in full or up to `longest` if given; 0 for the first.

    The order of a text's suffixes meets its text in one row, as long as the text itself. Rows that share an id, null
    included, are ordered anew, as `sa` does not tell them apart.
    """

    def run(batches):
        for pdf in batches:
            for doc, t, known in zip(pdf["doc_id"], pdf["_t"], pdf["_o"], strict=True):
                at = [int(x) for x in known] if len(known) == len(t) else order(t)
                got = kasai(t, at)
                yield pd.DataFrame({"doc_id": pd.Series([None if pd.isna(doc) else int(doc) if whole else doc] * len(t), dtype="Int64" if whole else object), "rank": range(len(t)), "pos": at, "lcp": got if longest is None else [min(x, longest) for x in got]})

    kind = dict(corpus.dtypes)[id]
    whole = kind in ("bigint", "int", "smallint", "tinyint")
    orders = sa.groupBy(F.col("doc_id").alias("_id")).agg(F.array_sort(F.collect_list(F.struct("rank", "pos"))).alias("_o"))
    texts = corpus.where(F.length(text) > 0).select(F.col(id).alias("doc_id"), F.col(text).alias("_t"))
    both = texts.join(orders, F.col("doc_id").eqNullSafe(F.col("_id"))).select("doc_id", "_t", F.col("_o.pos").alias("_o"))
    return both.mapInPandas(run, f"doc_id {kind}, rank long, pos long, lcp long")

"""Frequent substrings by summaries that merge, with an error that is known.

A summary has `tracked` counts at most. When there are more, the first count beyond is taken off all of them, and those
that fall to nothing leave. Counts are therefore too low, by the sum of what was taken off at most: count <= frequency <=
count + error, and the error is at most the number of occurrences by tracked + 1. All this holds for the sum of two summaries
that is cut in the same way, so that it does not matter how many tasks there were or in which order theirs came together.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .grams import counts, grams
from .lineage import forget, spread, written
from .topk import LISTED, _best
from .utility import _small
from .windows import IN_KEY, decoded, distinct, listed, pieces, prefixes_of, runs, strings, substrings, windows

FAN = 8  # summaries that become one in a round


def _off(n: np.ndarray, tracked: int) -> int:
    """What is taken off each count so that `tracked` are left at most."""
    return int(-np.partition(-n, tracked)[tracked]) if len(n) > tracked else 0


def _merge(rows: DataFrame, tracked: int) -> DataFrame:
    """One summary for each `part`: a window over FAN * (tracked + 1) rows at most."""
    own = Window.partitionBy("part")
    total = rows.groupBy("part", "substr").agg(F.sum("n").alias("n"), F.min("at").alias("at"))
    place = F.row_number().over(Window.partitionBy("part", F.isnull("substr")).orderBy(F.desc("n"), "substr"))
    cut = total.withColumn("place", place)
    beyond = (F.col("place") == tracked + 1) & F.col("substr").isNotNull()
    cut = cut.withColumn("off", F.coalesce(F.max(F.when(beyond, F.col("n"))).over(own), F.lit(0)))
    n = F.when(F.col("substr").isNull(), F.col("n") + F.col("off")).otherwise(F.col("n") - F.col("off"))
    return cut.withColumn("n", n).where("n > 0 OR substr IS NULL").select("part", "substr", "n", "at")


def summary(corpus: DataFrame, longest: int, tracked: int, text: str = "text", id: str = "doc_id", shortest: int = 1, prefixes: list[str] | None = None) -> DataFrame:
    """(substr, count, error, doc_id, pos) of the substrings of `shortest` to `longest` symbols that are tracked at the end.

    `error` is the same in all rows. (doc_id, pos) is an occurrence, the first since its substring is tracked; it is null where the
    text has no id. Null and empty texts have no substrings, and an empty table gives no rows. `prefixes`, of the same length, a multiple
    of IN_KEY, restrict to what begins with one of them. A task holds `tracked` counts and the substrings of a piece of a
    million starts or so, however long a text is.
    """
    kind = dict(corpus.dtypes)[id]
    values, whole = listed(prefixes)

    def run(batches):
        cols = [np.zeros(0, np.int64) for _ in range(-(-longest // IN_KEY))]
        n, pos, docs, error = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object), 0
        for batch in batches:
            ids = np.array(batch.column("doc").to_pylist(), object)
            for p in pieces(decoded(batch), longest, values):
                order, at, own, times = distinct(p, whole)
                if not len(at):
                    continue
                found = list(prefixes_of(own, times, np.minimum.reduceat(order, at), shortest, longest))
                if not found:
                    continue
                first = np.concatenate([f for _, _, f in found])
                cols = [np.concatenate([c, *(f[j] for f, _, _ in found)]) for j, c in enumerate(cols)]
                n = np.concatenate([n, *(c for _, c, _ in found)])
                pos, docs = np.concatenate([pos, p.pos[first]]), np.concatenate([docs, ids[p.row[first]]])
                order, at = runs(cols)
                n, was = np.add.reduceat(n[order], at), np.minimum.reduceat(order, at)  # what was held before comes first
                off = _off(n, tracked)
                left = n > off
                n, error, was = n[left] - off, error + off, was[left]
                cols, pos, docs = [c[was] for c in cols], pos[was], docs[was]
        part = pa.array(np.full(len(n) + 1, TaskContext.get().partitionId(), np.int32))
        substr = pa.concat_arrays([pa.nulls(1, pa.string()), strings(cols)])
        ids = pa.array([None, *docs.tolist()], to_arrow_type(schema["doc"].dataType))
        yield pa.RecordBatch.from_arrays([part, substr, pa.array(np.append(error, n)), ids, pa.array([None, *pos.tolist()], pa.int64())], ["part", "substr", "n", "doc", "pos"])

    texts = spread(corpus.where(F.length(text) > 0).select(F.col(id).alias("doc"), F.col(text).cast("binary").alias("t")))
    schema = texts.schema
    rows = texts.mapInArrow(run, f"part int, substr string, n long, doc {kind}, pos long")
    rows = written(rows.select("part", "substr", "n", F.when(F.col("doc").isNotNull(), F.struct("doc", "pos")).alias("at")), "summaries")
    parts = (rows.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        merged = written(_merge(rows.withColumn("part", F.expr(f"part div {FAN}")), tracked), "summaries")
        forget(rows)
        rows, parts = merged, -(-parts // FAN)
    error = rows.where("substr IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("error"))
    found = rows.where("substr IS NOT NULL").join(F.broadcast(error))  # one row
    out = found.select("substr", F.col("n").alias("count"), "error", F.col("at.doc").alias("doc_id"), "at.pos")
    out._strandex_path = rows._strandex_path
    return out


def top(corpus: DataFrame, k: int, longest: int, tracked: int = 20_000, least: int = 2, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(rank, substr, len, freq, first_doc, first_pos): exactly the k most frequent, out of those that a summary can't rule out.

    Substrings that it lost occur `error` times at most. While that is not below the k-th best count, four times as many are
    tracked. Those whose count and error together reach the k-th best count are counted again.
    """
    while True:
        found = summary(corpus, longest, tracked, text, id)
        best = found.select("count", "error").orderBy(F.desc("count")).limit(k).collect()  # k numbers
        bar = max(best[-1]["count"] if len(best) == k else 0, least)
        if not best or best[0]["error"] < bar:
            break
        forget(found)
        tracked *= 4
    wanted = written(found.where(F.col("count") + F.col("error") >= bar).select("substr"), "wanted")
    forget(found)
    few = [r["substr"] for r in wanted.limit(LISTED + 1).collect()]
    if len(few) <= LISTED:
        found = []
        for level in range(1, longest + 1, IN_KEY):
            last = min(level + IN_KEY - 1, longest)
            begins = sorted({s[: level - 1] for s in few if level <= len(s) <= last})
            if begins:
                found.append(substrings(windows(corpus, last, (), text, id, True, begins if level > 1 else None), level, last))
        rows = reduce(DataFrame.unionByName, found) if found else grams(corpus, [1], text=text, id=id)
    else:
        lengths = [r[0] for r in wanted.select(F.length("substr")).distinct().collect()]  # `longest` numbers at most
        rows = grams(corpus, lengths, text=text, id=id)
    rows = rows.join(_small(wanted), "substr", "left_semi")
    return _best(counts(rows, first=True).where(F.col("freq") >= least), k).select("rank", "substr", "len", "freq", "first_doc", "first_pos")

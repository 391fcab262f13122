"""A suffix index over texts of any size: ranks, common prefixes, nodes, and search by binary search in stored parts.

Nothing here takes a text as a row or a task. A position is a row with its first HEAD symbols; suffixes are ranked by
those first, then by twice as many in each round, from the rank of what follows. Keys are ordered in ranges, and what
lies before a range is added from one row for each range. A position whose rank is its own leaves the rounds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .grams import blocks
from .lineage import forget, written

HEAD = 32
#: Rows of a stored part, about; a search reads one or two parts for each pattern.
PART_ROWS = 50_000
_LAST = (1 << 63) - 1


def heads(corpus: DataFrame, head: int = HEAD, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(row, doc_id, pos, head, ended): every position with the symbols from it on, and whether the text ends within them.

    `row` tells texts apart that share an id. `corpus` has texts as rows, or spans of long texts as files.read_spans gives them
    (span_start, span_own), which must overlap by `head` symbols or more; texts in spans are told apart by their id.
    """
    spans = "span_start" in corpus.columns
    own = corpus.withColumn("row", F.xxhash64(id) if spans else F.monotonically_increasing_id())
    keep = ("row", "span_start", "span_own") if spans else ("row",)
    b = blocks(own, head + 1, keep, text, id)
    at = b.select("*", F.explode(F.sequence(F.lit(1), F.col("own"))).alias("p")).withColumn("pos", F.col("start") + F.col("p") - 1)
    if spans:
        at = at.where(F.col("pos") < F.col("span_own")).withColumn("pos", F.col("pos") + F.col("span_start"))
    cut = at.select("row", "doc_id", "pos", F.expr(f"substring(block, p, {head + 1})").alias("h"))
    return cut.select("row", "doc_id", "pos", F.expr(f"substring(h, 1, {head})").alias("head"), (F.length("h") <= head).alias("ended"))


def _running(keys: DataFrame, order: list[str], parts: int) -> DataFrame:
    """`keys` (g, n, ...) with `before`, the sum of n over the rows of the same g that come first in `order`. No row repeats.

    Rows are sorted in ranges; a task adds up its range, and what earlier ranges hold of a range's first g is added from
    one row for each range.
    """
    names = keys.columns

    def run(batches):
        last, total = None, 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            g, n = batch.column("g").to_numpy(), batch.column("n").to_numpy()
            if len(g):
                ahead = np.cumsum(n) - n
                first = np.concatenate([[g[0] != last], g[1:] != g[:-1]])
                of = np.cumsum(first) - 1  # which run of one g a row is in; -1 goes on from the batch before
                starts = np.flatnonzero(first)
                before = np.where(of < 0, total + ahead, ahead - ahead[starts[np.maximum(of, 0)]] if len(starts) else ahead)
                last, total = g[-1], int(before[-1] + n[-1])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.int64()), pa.array(np.full(len(g), part, np.int32))], [*names, "before", "part"])

    schema = ", ".join(f"`{c}` {t}" for c, t in keys.dtypes) + ", before long, part int"
    out = written(keys.repartitionByRange(parts, "g", *order).sortWithinPartitions("g", *order).mapInArrow(run, schema), "running")
    edges = out.groupBy("part").agg(F.min("g").alias("first"), F.max(F.struct("g", (F.col("before") + F.col("n")).alias("total"))).alias("last")).orderBy("part").collect()
    carried, g, total = [], None, 0  # `parts` rows
    for e in edges:
        if e["first"] == g:
            carried.append((e["part"], g, total))
        total = e["last"]["total"] + (total if e["first"] == g and e["last"]["g"] == g else 0)
        g = e["last"]["g"]
    if not carried:
        return out
    more = out.sparkSession.createDataFrame(carried, "part int, g long, carried long")
    full = out.join(F.broadcast(more), ["part", "g"], "left").withColumn("before", F.col("before") + F.coalesce("carried", F.lit(0)))
    full = full.select(*names, "before", "part")
    full._strandex_path = out._strandex_path
    return full


@dataclass
class Order:
    """Ranks (row, doc_id, pos, rank), and for the symbols compared in each round the positions (row, pos, r) tied after it."""

    ranks: DataFrame
    levels: list[tuple[int, DataFrame]]
    heads: DataFrame
    head: int
    tables: list[DataFrame]

    def forget(self) -> None:
        forget(*self.tables)


def suffix_order(corpus: DataFrame, per_text: bool = False, head: int = HEAD, text: str = "text", id: str = "doc_id", rounds: int = 40, parts: int | None = None) -> Order:
    """The suffixes of all texts in one binary order, ranks from 0 without gaps; or of each text after the other, if `per_text`.

    A text's end sorts before any symbol; equal suffixes of several texts stand side by side. Empty and null texts have no suffixes.
    A round joins tied positions with the rank of what follows, by position, and counts distinct pairs of ranks, which are
    combined before the shuffle; rounds are as many as the longest repeat has doublings of `head`.
    """
    spark = corpus.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    start = written(heads(corpus, head, text, id), "heads")
    tie = F.when(F.col("ended"), F.col("row")).otherwise(F.lit(_LAST))  # what has ended is told apart by its text
    own = start.select("row", "pos", F.lit(0).cast("long").alias("g"), *([F.col("row").alias("t")] if per_text else []), "head", tie.alias("tie"))
    by = (["t"] if per_text else []) + ["head", "tie"]
    found = _running(own.groupBy("g", *by).agg(F.count("*").alias("n")), by, parts)
    now = written(own.drop("g").join(found.drop("g", "part"), by).select("row", "pos", F.col("before").alias("r"), "n"), "ranks")
    forget(found)
    step, tables, done, levels = head, [start, now], [now.where("n = 1")], []
    for _ in range(rounds):
        tied = now.where("n > 1")
        if tied.isEmpty():
            break
        levels.append((step, tied.select("row", "pos", "r")))
        known = done[0]
        for more in done[1:]:
            known = known.unionByName(more)
        follows = known.unionByName(tied).select("row", (F.col("pos") - step).alias("pos"), F.col("r").alias("r2"))
        both = written(tied.select("row", "pos", "r").join(follows, ["row", "pos"]), "pairs")
        found = _running(both.groupBy(F.col("r").alias("g"), "r2").agg(F.count("*").alias("n")), ["r2"], parts)
        now = written(both.join(found.select(F.col("g").alias("r"), "r2", "before", "n"), ["r", "r2"]).select("row", "pos", (F.col("r") + F.col("before")).alias("r"), "n"), "ranks")
        forget(both, found)
        tables.append(now)
        done.append(now.where("n = 1"))
        step *= 2
    else:
        raise RuntimeError("suffix_order: too few rounds")
    ranks = done[0]
    for more in done[1:]:
        ranks = ranks.unionByName(more)
    ids = start.select("row", "doc_id").distinct()
    ranks = written(ranks.select("row", "pos", F.col("r").alias("rank")).join(ids, "row").select("row", "doc_id", "pos", "rank"), "order")
    return Order(ranks, levels, start, head, [*tables, ranks])


def text_ranks(order: Order) -> DataFrame:
    """(doc_id, rank, pos) of a per-text order, ranks of each text from 0."""
    first = order.ranks.groupBy("row").agg(F.min("rank").alias("f"))
    return order.ranks.join(first, "row").select("doc_id", (F.col("rank") - F.col("f")).alias("rank"), "pos")


def alike(a: str, b: str, longest: int):
    """Length of the common prefix of two string columns of at most `longest` symbols; null counts as empty."""
    digits = F.array(*(F.lit(1 << i) for i in range(longest.bit_length() - 1, -1, -1)))
    room = F.least(F.length(a), F.length(b))
    part = lambda c, n, d: F.substring(F.col(c), n + 1, d)
    return F.coalesce(F.aggregate(digits, F.lit(0), lambda n, d: F.when((n + d <= room) & (part(a, n, d) == part(b, n, d)), n + d).otherwise(n)), F.lit(0))


def common_prefixes(order: Order, per_text: bool = False) -> DataFrame:
    """(row, doc_id, rank, pos, lcp): common prefix with the suffix before; 0 for the first (of its text, if `per_text`).

    Neighbours go down the rounds, the longest first: where both are tied at a round with one rank, they share its symbols
    and move on by as many. What then remains is within their heads. Each round is two joins with the positions tied in
    it, of which there are ever fewer; no row has more than a head of text.
    """
    a = order.ranks.select("row", "doc_id", "rank", "pos")
    b = order.ranks.select((F.col("rank") + 1).alias("rank"), F.col("row").alias("row2"), F.col("pos").alias("pos2"))
    pairs = a.join(b, "rank", "left").withColumn("lcp", F.lit(0).cast("long"))
    if per_text:
        pairs = pairs.withColumn("pos2", F.when(F.col("row") == F.col("row2"), F.col("pos2")))
    for step, tied in reversed(order.levels):
        one = tied.select(F.col("row").alias("_row"), F.col("pos").alias("_pos"), F.col("r").alias("_r"))
        two = tied.select(F.col("row").alias("_row2"), F.col("pos").alias("_pos2"), F.col("r").alias("_r2"))
        met = pairs.join(one, (F.col("row") == F.col("_row")) & (F.col("pos") + F.col("lcp") == F.col("_pos")), "left")
        met = met.join(two, (F.col("row2") == F.col("_row2")) & (F.col("pos2") + F.col("lcp") == F.col("_pos2")), "left")
        pairs = met.select(*a.columns, "row2", "pos2", (F.col("lcp") + F.when(F.col("_r") == F.col("_r2"), F.lit(step)).otherwise(0)).alias("lcp"))
    one = order.heads.select(F.col("row").alias("_row"), F.col("pos").alias("_pos"), F.col("head").alias("_h"))
    two = order.heads.select(F.col("row").alias("_row2"), F.col("pos").alias("_pos2"), F.col("head").alias("_h2"))
    met = pairs.join(one, (F.col("row") == F.col("_row")) & (F.col("pos") + F.col("lcp") == F.col("_pos")), "left")
    met = met.join(two, (F.col("row2") == F.col("_row2")) & (F.col("pos2") + F.col("lcp") == F.col("_pos2")), "left")
    return met.select(*a.columns, (F.col("lcp") + alike("_h", "_h2", order.head)).alias("lcp")).select("row", "doc_id", "rank", "pos", "lcp")


def _smaller(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the nearest smaller value's place to the left and to the right; -1 and the length where there is none."""
    left, right, stack = np.full(len(values), -1), np.full(len(values), len(values)), []
    for i, v in enumerate(values.tolist()):
        while stack and stack[-1][1] >= v:
            at, w = stack.pop()
            if w > v:
                right[at] = i
            else:  # an equal value ends the search, and is as good as this one
                right[at] = -2 - i
        left[i] = stack[-1][0] if stack else -1
        stack.append((i, v))
    for i in range(len(values) - 1, -1, -1):
        if right[i] < 0:
            right[i] = right[-2 - right[i]]
    return left, right


def intervals(lcps: DataFrame, parts: int | None = None) -> DataFrame:
    """(low, high, d, pd) from (rank, lcp): the maximal runs of ranks whose suffixes share d > 0 symbols, and their parents' depth.

    These are the nodes of the suffix tree that stand for two suffixes or more. Each range of ranks finds the nearest smaller values within
    itself by a stack; what it can't find is in the nearest range whose least value is smaller, among the few values of that range
    that are the least of its beginning or end. Ranks are without gaps, from 0; a first suffix has lcp 0.
    """
    spark = lcps.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = lcps.select("rank", F.when(F.col("rank") == 0, F.lit(-1)).otherwise(F.col("lcp")).cast("long").alias("v"))

    def run(batches):
        got = [(b.column("rank").to_numpy(), b.column("v").to_numpy()) for b in batches]
        if not got or not sum(len(r) for r, _ in got):
            return
        rank, v = (np.concatenate(x) for x in zip(*got, strict=True))
        left, right = _smaller(v)
        n = len(v)
        ahead, behind = np.minimum.accumulate(v), np.minimum.accumulate(v[::-1])[::-1]
        begins = np.concatenate([[True], v[1:] < ahead[:-1]])
        ends = np.concatenate([v[:-1] < behind[1:], [True]])
        at = lambda i: (np.where((i >= 0) & (i < n), rank[i % n], -1), np.where((i >= 0) & (i < n), v[i % n], -1))
        (l, lv), (r, rv) = at(left), at(right)
        part = np.full(n, TaskContext.get().partitionId(), np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (part, rank, v, l, lv, r, rv, begins, ends)], ["part", "rank", "v", "l", "lv", "r", "rv", "begins", "ends"])

    schema = "part int, rank long, v long, l long, lv long, r long, rv long, begins boolean, ends boolean"
    own = written(rows.repartitionByRange(parts, "rank").sortWithinPartitions("rank").mapInArrow(run, schema), "smaller")
    least = sorted((r["part"], r["m"], r["last"]) for r in own.groupBy("part").agg(F.min("v").alias("m"), F.max("rank").alias("last")).collect())  # `parts` rows
    total = max((x[2] for x in least), default=-1) + 1

    def target(side: str):
        """The range that holds what is missing on a side; -1 where nothing is smaller."""

        def find(part: pd.Series, v: pd.Series) -> pd.Series:
            out = []
            for p, x in zip(part, v, strict=True):
                there = [q for q, m, _ in least if (q < p if side == "l" else q > p) and m < x]
                out.append((max(there) if side == "l" else min(there)) if there else -1)
            return pd.Series(out, dtype="int32")

        return F.pandas_udf(find, "int")

    def missing(side: str) -> DataFrame:
        asked = own.where(f"v > 0 AND {side} = -1").groupBy("part", "v").agg(F.count("*").alias("n"))  # one answer for each value of a range
        asked = asked.select("part", "v", target(side)("part", "v").alias("to"))
        records = own.where("ends" if side == "l" else "begins").select(F.col("part").alias("to"), "rank", F.col("v").alias("value"))

        def answer(want: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
            have = have.sort_values("value")
            i = np.searchsorted(have["value"], want["v"]) - 1  # the largest value below is the nearest one
            ok = i >= 0
            return pd.DataFrame({"part": want["part"][ok], "v": want["v"][ok], "at": have["rank"].to_numpy()[i[ok]], "value": have["value"].to_numpy()[i[ok]]})

        return asked.groupBy("to").cogroup(records.groupBy("to")).applyInPandas(answer, "part int, v long, at long, value long")

    out = own.where("v > 0")
    for side in ("l", "r"):
        more = missing(side).select("part", "v", F.col("at").alias("_at"), F.col("value").alias("_value"))
        out = out.join(more, ["part", "v"], "left")
        here = F.col(side) >= 0
        none = F.lit(total if side == "r" else -1).cast("long")
        out = out.withColumn(f"{side}v", F.when(here, F.col(f"{side}v")).otherwise(F.coalesce("_value", F.lit(-1)))).withColumn(side, F.when(here, F.col(side)).otherwise(F.coalesce("_at", none))).drop("_at", "_value")
    found = out.groupBy(F.col("l").alias("low"), (F.col("r") - 1).alias("high")).agg(F.max("v").alias("d"), F.max(F.greatest(F.col("lv"), F.col("rv"), F.lit(0))).alias("pd"))
    return found.select("low", "high", "d", "pd")


def nodes(corpus: DataFrame, order: Order, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(label, freq, pd, d) of all suffix-tree nodes of two occurrences or more, of any depth. Ids of texts are distinct."""
    found = intervals(common_prefixes(order))
    first = found.join(order.ranks.select(F.col("rank").alias("low"), "doc_id", "pos"), "low")
    texts = corpus.select(F.col(id).alias("doc_id"), F.col(text).alias("_t"))
    label = F.substring(F.col("_t"), (F.col("pos") + 1).cast("int"), F.col("d").cast("int"))
    return first.join(texts, "doc_id").select(label.alias("label"), (F.col("high") - F.col("low") + 1).alias("freq"), F.col("pd").cast("int").alias("pd"), F.col("d").cast("int").alias("d"))


# --- stored index ------------------------------------------------------------------------------------------------


def build(corpus: DataFrame, path: str, head: int = HEAD, part_rows: int = PART_ROWS, text: str = "text", id: str = "doc_id") -> None:
    """Store the suffixes of all texts under `path`, to be searched any number of times.

    `suffixes` has parts of about `part_rows` ranks in a row: rank, doc_id, pos, the head, and the rank of what follows it (-1 at an end). `parts` has one row for
    each: its first rank, its size, and the first key. Ids, null and repeated ones too, are kept as they are.
    """
    order = suffix_order(corpus, head=head, text=text, id=id)
    after = order.ranks.select("row", (F.col("pos") - head).alias("pos"), F.col("rank").alias("next"))
    rows = order.ranks.join(order.heads.select("row", "pos", "head"), ["row", "pos"]).join(after, ["row", "pos"], "left")
    rows = rows.select("rank", "doc_id", "pos", "head", F.coalesce("next", F.lit(-1)).alias("next"), F.floor(F.col("rank") / part_rows).cast("int").alias("part"))
    tasks = max(1, min(int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-order.ranks.count() // part_rows)))
    rows.repartitionByRange(tasks, "part").sortWithinPartitions("rank").write.mode("overwrite").partitionBy("part").parquet(f"{path}/suffixes")
    stored = corpus.sparkSession.read.schema(rows.schema).parquet(f"{path}/suffixes")
    firsts = stored.groupBy("part").agg(F.min("rank").alias("first"), F.count("*").alias("size"), F.min_by(F.struct("head", "next"), "rank").alias("key"))
    firsts.select("part", "first", "size", "key.head", "key.next", F.lit(head).alias("symbols")).coalesce(1).write.mode("overwrite").parquet(f"{path}/parts")
    order.forget()


def _level(spark: SparkSession, path: str, splitters: list, asked: DataFrame) -> DataFrame:
    """(key, low, high) for asked (key, chunk, whole, low2, high2): ranks whose head begins with the chunk and, if it is `whole`, is followed by ranks low2 to high2."""
    keys = [(s["head"].encode(), s["next"]) for s in splitters]
    numbers = [s["part"] for s in splitters]
    bounds = {s["part"]: (s["first"], s["size"]) for s in splitters}

    def before(chunk: bytes, whole: bool, low2: int, high2: int, upper: bool):
        """Whether a suffix (head, next) lies before the lower or not beyond the upper end of what is asked."""
        if whole:
            edge = (chunk, high2 if upper else low2)
            return (lambda h, n: (h, n) <= edge) if upper else (lambda h, n: (h, n) < edge)
        return (lambda h, n: h[: len(chunk)] <= chunk) if upper else (lambda h, n: h < chunk)

    def place(test, size: int, at) -> int:
        """How many of `size` sorted suffixes pass a test that holds for the first ones only."""
        low, high = 0, size
        while low < high:
            mid = (low + high) // 2
            if test(*at(mid)):
                low = mid + 1
            else:
                high = mid
        return low

    def deal(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                for upper in (False, True):
                    n = place(before(r.chunk.encode(), r.whole, r.low2, r.high2, upper), len(keys), keys.__getitem__)
                    out.append((r.key, r.chunk, r.whole, r.low2, r.high2, upper, numbers[max(n - 1, 0)]))
            yield pd.DataFrame(out, columns=["key", "chunk", "whole", "low2", "high2", "upper", "part"])

    dealt = written(asked.mapInPandas(deal, "key long, chunk string, whole boolean, low2 long, high2 long, upper boolean, part int"), "dealt")
    wanted = [r["part"] for r in dealt.select("part").distinct().collect()]  # parts that any pattern needs; others aren't read
    stored = spark.read.schema("rank long, head string, next long, part int").parquet(f"{path}/suffixes").where(F.col("part").isin(wanted))

    def look(want: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        have = have.sort_values("rank")
        heads_, nexts = [h.encode() for h in have["head"]], have["next"].tolist()
        out = []
        for r in want.itertuples(index=False):
            n = place(before(r.chunk.encode(), r.whole, r.low2, r.high2, r.upper), len(heads_), lambda i: (heads_[i], nexts[i]))
            out.append((r.key, r.upper, bounds[r.part][0] + n))
        return pd.DataFrame(out, columns=["key", "upper", "at"])

    # Patterns are dealt to a part in groups, so that one part asked for by very many of them is no single task.
    salted = dealt.withColumn("salt", F.floor(F.col("key") / 10_000))
    wide = stored.join(salted.groupBy("part").agg(F.collect_set("salt").alias("salts")), "part").select("part", "rank", "head", "next", F.explode("salts").alias("salt"))
    found = salted.groupBy("part", "salt").cogroup(wide.select("part", "rank", "head", "next", "salt").groupBy("part", "salt")).applyInPandas(look, "key long, upper boolean, at long")
    return found.groupBy("key").agg(F.max(F.when(~F.col("upper"), F.col("at"))).alias("low"), (F.max(F.when(F.col("upper"), F.col("at"))) - 1).alias("high"))


def search(spark: SparkSession, path: str, patterns: DataFrame) -> DataFrame:
    """`patterns` (query_id, pattern) with low, high and occurrences = high - low + 1: the ranks of the suffixes that begin with each.

    Of the stored suffixes only the parts are read that hold an end of a pattern's ranks. A pattern of more symbols than a head is searched from its last
    piece to its first: what a piece is followed by is known as ranks. Patterns that do not occur get high = low - 1, low
    being where they would stand; empty and null ones get null ranks and 0.
    """
    splitters = spark.read.parquet(f"{path}/parts").orderBy("part").collect()  # a row for each part
    distinct = patterns.where(F.length("pattern") > 0).select("pattern").distinct()
    if not splitters:
        return patterns.select("query_id", "pattern", F.lit(0).cast("long").alias("low"), F.lit(-1).cast("long").alias("high"), F.lit(0).cast("long").alias("occurrences"))
    size = splitters[0]["symbols"]
    keyed = written(distinct.select(F.monotonically_increasing_id().alias("key"), "pattern", F.ceil(F.length("pattern") / size).cast("int").alias("pieces")), "patterns")
    most = keyed.agg(F.max("pieces")).first()[0] or 0
    found = None
    for back in range(most):  # the last piece first
        at = F.col("pieces") - 1 - back
        chunk = F.substring(F.col("pattern"), at * size + 1, F.lit(size))
        asked = keyed.where(at >= 0).select("key", chunk.alias("chunk"), at.alias("at"), "pieces")
        if found is None:
            asked = asked.select("key", "chunk", F.lit(False).alias("whole"), F.lit(0).cast("long").alias("low2"), F.lit(0).cast("long").alias("high2"))
        else:
            asked = asked.join(found, "key").select("key", "chunk", F.lit(True).alias("whole"), F.col("low").alias("low2"), F.col("high").alias("high2"))
        own = written(_level(spark, path, splitters, asked), "found")
        found = own if found is None else own.unionByName(found.join(own, "key", "left_anti"))
    if found is None:
        return patterns.select("query_id", "pattern", *(F.lit(None).cast("long").alias(c) for c in ("low", "high")), F.lit(0).cast("long").alias("occurrences"))
    known = keyed.join(found, "key").select("pattern", "low", "high")
    return patterns.select("query_id", "pattern").join(known, "pattern", "left").select("query_id", "pattern", "low", "high", F.coalesce(F.col("high") - F.col("low") + 1, F.lit(0)).alias("occurrences"))


def places(spark: SparkSession, path: str, found: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(query_id, pattern, doc_id, pos): the occurrences that search() found, from the parts that hold them."""
    some = found.where("occurrences > 0")
    first = spark.read.parquet(f"{path}/parts").select("part", "first", "size")
    within = some.join(F.broadcast(first), (F.col("low") < F.col("first") + F.col("size")) & (F.col("high") >= F.col("first")))  # a row for each part a pattern reaches into
    stored = spark.read.parquet(f"{path}/suffixes").select("part", "rank", "doc_id", "pos")
    return within.join(stored, "part").where("rank BETWEEN low AND high").select("query_id", "pattern", "doc_id", "pos")

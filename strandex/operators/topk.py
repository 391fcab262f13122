"""Top-K frequent substrings: exact, by suffix-tree node, level by level, and by sampling positions.

Ties: more frequent first, then shorter, then smaller in binary order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .grams import blocks, counts, grams, packable
from .lineage import forget, written
from .utility import _small
from .windows import substrings, windows

STEP = 3  # lengths that are counted in a pass
LISTED = 20_000  # prefixes that tasks are given as a list; more are joined
REACH = 32  # symbols that go on with a position from pass to pass; texts are cut again only for longer ones


def _best(rows: DataFrame, k: int, length: str = "len", label: str = "substr") -> DataFrame:
    """The first k rows in tie order, with their rank; what is ranked is k rows."""
    order = [F.desc("freq"), F.asc(length), F.asc(label)]
    return rows.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def exact(corpus: DataFrame, k: int, longest: int, least: int = 2, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(rank, substr, len, freq): exactly k substrings of up to `longest` symbols that occur `least` times or more, level by level."""
    return levelwise(corpus, k, longest, least, text, id)


class _Levels:
    """Substrings level by level, over positions that get fewer.

    The first two passes count windows within tasks; the second, those alone that begin with what is alive. The next writes the positions whose
    prefix is alive, with REACH symbols each; later passes read these and never the texts, until lengths go beyond what is carried, which
    is then twice as much. If more than LISTED prefixes are alive after the first pass, positions are written in the second.
    """

    def __init__(self, corpus: DataFrame, text: str, id: str, first: bool = False):
        self.corpus, self.text, self.id, self.first = corpus, text, id, first
        self.carried, self.width = None, 0

    def rows(self, level: int, last: int, alive: DataFrame | None) -> DataFrame:
        """Rows for counts(): substrings of `level` to `last` symbols, those alone whose first level - 1 symbols are in `alive` (prefix)."""
        if alive is None:
            return substrings(windows(self.corpus, last, (), self.text, self.id, self.first), level, last)
        if level == STEP + 1:
            few = [r["prefix"] for r in alive.limit(LISTED + 1).collect()]
            if len(few) <= LISTED:
                return substrings(windows(self.corpus, last, (), self.text, self.id, self.first, few), level, last)
        alive = _small(alive)
        if self.width < last:
            self.forget()
            self.width = max(REACH, 2 * last)
            b = blocks(self.corpus, self.width, text=self.text, id=self.id)
            at = b.select("doc_id", "start", "block", F.explode(F.sequence(F.lit(1), F.col("own"))).alias("p"))
            at = at.where(f"p + {level - 1} <= length(block)").withColumn("prefix", F.expr(f"substring(block, p, {level - 1})"))
            cut = at.join(alive, "prefix", "left_semi").select("doc_id", (F.col("start") + F.col("p") - 1).alias("pos"), F.expr(f"substring(block, p, {self.width})").alias("ahead"))
            now = self.carried = written(cut, "positions")
        else:
            now = self.carried.withColumn("prefix", F.expr(f"substring(ahead, 1, {level - 1})")).join(alive, "prefix", "left_semi")
        each = now.select("doc_id", "pos", "ahead", F.explode(F.sequence(F.lit(level), F.lit(last))).alias("len")).where("len <= length(ahead)")
        return each.select("doc_id", "pos", "len", F.expr("substring(ahead, 1, len)").alias("substr"))

    def forget(self) -> None:
        if self.carried is not None:
            forget(self.carried)


def nodes(found: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, label, freq, pd, d) from counts with first occurrences: substrings that share one set of occurrences are one node.

    Two substrings with the same first occurrence are prefixes of each other; with the same frequency as well they have
    the same occurrences. A node stands for its label's prefixes of pd + 1 to d symbols.
    """
    g = found.where("freq >= 2").groupBy(*by, "first_doc", "first_pos", "freq").agg(F.max("len").alias("d"), (F.min("len") - 1).alias("pd"), F.max_by("substr", "len").alias("label"))
    return g.select(*by, "label", "freq", "pd", "d")


def cut_nodes(node_rows: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The most frequent nodes until they stand for k substrings; the last may overshoot. A node stands for one or more."""
    order = [F.desc("freq"), F.asc("d"), F.asc("label")]
    if by:
        top = node_rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= k).drop("_n")
    else:
        top = node_rows.orderBy(*order).limit(k)
    w = Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)
    before = F.coalesce(F.sum(F.col("d") - F.col("pd")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return top.withColumn("_b", before).where(F.col("_b") < k).drop("_b")


def top_nodes(corpus: DataFrame, k: int, longest: int | None = None, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(label, freq, pd, d) of the node-mode top k, of any length; substrings longer than `longest`, if given, are not looked at.

    Nodes less frequent than the k-th best substring are never chosen. Without a bound, substrings at least as frequent
    as the k-th best so far are therefore followed level by level, as in levelwise(), until none is left.
    """
    if longest is None:
        return cut_nodes(nodes(_frequent(corpus, k, text, id)), k)
    return cut_nodes(nodes(counts(grams(corpus, list(range(1, longest + 1)), text=text, id=id), first=True, packed=packable(corpus, id))), k)


def _frequent(corpus: DataFrame, k: int, text: str, id: str) -> DataFrame:
    """(substr, len, freq, first_doc, first_pos) of all substrings, of any length, at least as frequent as the k-th best.

    The driver holds k frequencies; what a level finds is written, and what is left of all levels is written once more.
    """
    packed = packable(corpus, id)
    levels = _Levels(corpus, text, id, first=True)
    best: list[int] = []
    tables: list[DataFrame] = []
    alive = None
    level, bar = 1, 2
    while True:
        last = level + STEP - 1
        now = written(counts(levels.rows(level, last, alive), first=True, packed=packed).where(F.col("freq") >= bar), "nodes")
        tables.append(now)
        best = sorted(best + [r["freq"] for r in now.orderBy(F.desc("freq")).limit(k).select("freq").collect()], reverse=True)[:k]
        bar = best[-1] if len(best) == k else 2
        alive = now.where((F.col("freq") >= bar) & (F.col("len") == last)).select(F.col("substr").alias("prefix"))
        if alive.isEmpty():
            break
        level = last + 1
    found = tables[0]
    for more in tables[1:]:
        found = found.unionByName(more)
    out = written(found.where(F.col("freq") >= bar), "frequent")
    forget(*tables)
    levels.forget()
    return out


def expanded(node_rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, substr, len, freq) of the substrings that nodes stand for."""
    each = node_rows.select(*by, "label", "freq", F.explode(F.sequence(F.col("pd") + 1, F.col("d"))).alias("len"))
    return each.select(*by, F.expr("substring(label, 1, len)").alias("substr"), "len", "freq")


def summary(node_rows: DataFrame) -> DataFrame:
    """tau, the least frequency chosen, the longest length, and how many nodes and substrings."""
    return node_rows.agg(F.min("freq").alias("tau"), F.max("d").alias("longest_len"), F.count("*").alias("n_nodes"), F.coalesce(F.sum(F.col("d") - F.col("pd")), F.lit(0)).cast("long").alias("n_substrings"))


def levelwise(corpus: DataFrame, k: int, longest: int | None = None, least: int = 2, text: str = "text", id: str = "doc_id") -> DataFrame:
    """As exact(), without a bound on length unless `longest` is given.

    A substring is at most as frequent as its prefix. From one pass, of STEP lengths, to the next only positions go on whose prefix is
    at least as frequent as the k-th best so far, and the work ends when none is left. The driver holds the k best; the
    surviving prefixes, about as many, are joined by broadcast if their count allows it.
    """
    spark = corpus.sparkSession
    levels = _Levels(corpus, text, id)
    best: list[tuple[str, int, int]] = []
    alive = before = None
    level = 1
    while longest is None or level <= longest:
        last = level + STEP - 1 if longest is None else min(level + STEP - 1, longest)
        now = written(counts(levels.rows(level, last, alive)).where(F.col("freq") >= (bar if alive is not None else least)).select("substr", "len", "freq"), "level")
        if before is not None:
            forget(before)
        before = now
        top = now.orderBy(F.desc("freq"), F.asc("len"), F.asc("substr")).limit(k).collect()
        if not top:
            break
        best = sorted(best + [(r["substr"], r["len"], r["freq"]) for r in top], key=lambda r: (-r[2], r[1], r[0].encode()))[:k]
        bar = best[-1][2] if len(best) == k else least
        alive = now.where((F.col("freq") >= bar) & (F.col("len") == last)).select(F.col("substr").alias("prefix"))
        if alive.isEmpty():
            break
        level = last + 1
    if before is not None:
        forget(before)
    levels.forget()
    return spark.createDataFrame([(i + 1, *r) for i, r in enumerate(best)], "rank long, substr string, len int, freq long")


def rounds(corpus: DataFrame, k: int, longest: int, stride: int, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(r, substr, len, freq): the node-mode top k of the starts of each residue r of pos modulo `stride`, all in one job."""
    rows = grams(corpus, list(range(1, longest + 1)), text=text, id=id).withColumn("r", (F.col("pos") % stride).cast("int"))
    return expanded(cut_nodes(nodes(counts(rows, ("r",), True, packable(corpus, id)), ("r",)), k, ("r",)), ("r",))


def recount(corpus: DataFrame, found: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """`found` (substr, len, est_freq) with exact frequencies; a few rows, of the top k."""
    from .utility import matches

    n = matches(corpus, found.select(F.col("substr").alias("pattern")), text=text, id=id).groupBy(F.col("pattern").alias("substr")).agg(F.count("*").alias("freq"))
    return found.join(n, "substr", "left").select("substr", "len", "est_freq", F.coalesce("freq", F.lit(0)).alias("freq"))


def sampled(corpus: DataFrame, k: int, longest: int, stride: int, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(substr, len, est_freq, freq): the rounds' frequencies summed, the k best of them, recounted. Estimates never exceed counts."""
    merged = rounds(corpus, k, longest, stride, text, id).groupBy("substr", "len").agg(F.sum("freq").alias("freq"))
    top = _best(merged, k).select("substr", "len", F.col("freq").alias("est_freq"))
    return recount(corpus, written(top, "sampled"), text, id)


def sampled_pruned(corpus: DataFrame, k: int, longest: int, stride: int, text: str = "text", id: str = "doc_id") -> DataFrame:
    """As sampled(), cut to k after each round in turn, so that the result depends on the rounds' order. Each step has 2 k rows or so."""
    all_rounds = written(rounds(corpus, k, longest, stride, text, id), "rounds")
    kept = None
    for r in range(stride):
        own = all_rounds.where(F.col("r") == r).select("substr", "len", "freq")
        pool = own if kept is None else kept.unionByName(own).groupBy("substr", "len").agg(F.sum("freq").alias("freq"))
        last, kept = kept, written(_best(pool, k).select("substr", "len", "freq"), "kept")
        if last is not None:
            forget(last)
    forget(all_rounds)
    return recount(corpus, kept.withColumnRenamed("freq", "est_freq"), text, id)


def recall(truth: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(k, hits, recall) of found substrings against the true ones, by set intersection."""
    hits = truth.select("substr").intersect(found.select("substr"))
    return hits.agg(F.count("*").alias("hits")).crossJoin(truth.agg(F.count("*").alias("n"))).select(F.lit(k).cast("long").alias("k"), "hits", F.when(F.col("n") > 0, F.col("hits") / F.col("n")).alias("recall"))


def rollup(corpus: DataFrame, k: int, longest: int, by: tuple[str, str], text: str = "text", id: str = "doc_id") -> DataFrame:
    """Top k for each pair of `by`, each first column, each second, and overall; an absent column is null.

    Grams are counted for the pairs once; the grouping sets expand those counts, not the text.
    """
    c = counts(substrings(windows(corpus, longest, by, text, id), 1, longest), by)
    a, b = by
    none = lambda c_: F.lit(None).cast("string").alias(c_)
    level = c.select(F.explode(F.array(*(F.struct(F.lit(g).alias("g"), *(F.col(x).alias(x) if on else none(x) for x, on in zip(by, ons, strict=True))) for g, ons in enumerate(((True, True), (True, False), (False, True), (False, False)))))).alias("s"), "substr", "len", "freq")
    summed = level.select("s.*", "substr", "len", "freq").groupBy("g", a, b, "substr", "len").agg(F.sum("freq").alias("freq"))
    w = Window.partitionBy("g", a, b).orderBy(F.desc("freq"), F.asc("len"), F.asc("substr"))
    return summed.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("g", a, b, "rank", "substr", "len", "freq")

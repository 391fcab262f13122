"""Occurrences and utility of query patterns.

U(P) is the sum, over all occurrences of P in all texts, of the weights of the symbols it covers; 0 without occurrences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strandex.functions.symbols import gram_weight, symbols

from . import prefix
from .grams import grams
from .lineage import spread

#: Pattern lists up to this many distinct rows are broadcast; longer ones are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Lists up to this many distinct patterns are counted by scanning each text once for each of them.
DIRECT = 64


def _small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast, if a count shows that it may be."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def matches(corpus: DataFrame, patterns: DataFrame, keep: tuple[str, ...] = (), text: str = "text", id: str = "doc_id", weights: str | None = None) -> DataFrame:
    """(doc_id, keep, pos, pattern[, w]): every occurrence of every distinct pattern. Empty and null patterns match nowhere.

    Only the lengths that patterns have, and starts with a symbol that some pattern begins with, become rows.
    """
    distinct = patterns.where(F.length("pattern") > 0).select("pattern").distinct()
    shape = distinct.select(F.length("pattern").alias("n"), F.substring("pattern", 1, 1).alias("c"))
    lengths = [r["n"] for r in shape.select("n").distinct().collect()]
    if not lengths:
        return grams(corpus, [1], keep, text, id, weights, where=F.lit(False)).select("doc_id", *keep, "pos", F.col("substr").alias("pattern"), *(["w"] * bool(weights)))
    starts = [r["c"] for r in shape.select("c").distinct().limit(257).collect()]
    rows = grams(corpus, lengths, keep, text, id, weights, first=starts if len(starts) <= 256 else None)
    return rows.join(_small(distinct.withColumnRenamed("pattern", "substr")), "substr").select("doc_id", *keep, "pos", F.col("substr").alias("pattern"), *(["w"] * bool(weights)))


def _occurrences(text: Column, pattern: str) -> Column:
    """How often a pattern occurs in a text, overlaps included.

    A pattern no proper prefix of which is its suffix can't overlap itself, so that removing it counts it.
    """
    if any(pattern.startswith(pattern[-n:]) for n in range(1, len(pattern))):
        quoted = pattern.replace("\\E", "\\E\\\\E\\Q")
        return F.regexp_count(text, F.lit(f"(?=\\Q{quoted}\\E)"))
    left = F.length(F.replace(text, F.lit(pattern), F.lit("")))
    return ((F.length(text) - left) / len(pattern)).cast("long")


def _counted(corpus: DataFrame, patterns: list[str], by: tuple[str, ...], text: str) -> DataFrame:
    """(by, pattern, occurrences) for a short list: one pass, and one row for each group and task in the shuffle."""
    sums = [F.sum(_occurrences(F.col(text), p)).alias(f"_{i}") for i, p in enumerate(patterns)]
    wide = spread(corpus.select(*by, text)).groupBy(*by).agg(*sums)
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("pattern"), F.coalesce(f"_{i}", F.lit(0)).cast("long").alias("occurrences")) for i, p in enumerate(patterns))))
    return wide.select(*by, each.alias("x")).select(*by, "x.*").where("occurrences > 0")


def pattern_utility(corpus: DataFrame, patterns: DataFrame, by: tuple[str, ...] = (), text: str = "text", id: str = "doc_id", weights: str | None = None) -> DataFrame:
    """(by, pattern, occurrences, utility) of the patterns that occur. Without `weights` a symbol's weight depends on the symbol.

    Then an occurrence's utility is its pattern's, and counts are all that is shuffled.
    """
    if not weights:
        few = [r["pattern"] for r in patterns.where(F.length("pattern") > 0).select("pattern").distinct().limit(DIRECT + 1).collect()]
        if 0 < len(few) <= DIRECT:
            return _counted(corpus, sorted(few), by, text).withColumn("utility", F.col("occurrences") * gram_weight(F.col("pattern")))
    found = matches(corpus, patterns, by, text, id, weights)
    if weights:
        own = F.aggregate("w", F.lit(0).cast("double"), lambda a, x: a + x)
        return found.groupBy(*by, "pattern").agg(F.count("*").alias("occurrences"), F.sum(own).alias("utility"))
    n = found.groupBy(*by, "pattern").agg(F.count("*").alias("occurrences"))
    return n.withColumn("utility", F.col("occurrences") * gram_weight(F.col("pattern")))


def weighted_utility(corpus: DataFrame, patterns: DataFrame, weights: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(pattern, occurrences, utility) with weights by position, looked up in prefix sums; ids of texts are distinct.

    As pattern_utility() with `weights`, where each occurrence carries its weights, which serves repeated ids and few
    texts. Here occurrences are ids and positions, and meet the sums of their bucket. A missing or null weight counts 0.
    """
    longest = patterns.agg(F.max(F.length("pattern"))).first()[0] or 1
    each = F.transform(symbols(F.col(text)), lambda _, i: F.coalesce(F.get(F.col(weights), i), F.lit(0)).cast("double"))
    rows = corpus.select(F.col(id).alias("doc_id"), F.posexplode(each).alias("pos", "w")).withColumn("pos", F.col("pos").cast("long"))
    buckets = prefix.sum_buckets(prefix.prefix_sums(rows), longest)
    found = matches(corpus, patterns, text=text, id=id).withColumn("len", F.length("pattern"))
    own = prefix.bucket_utility(buckets, found, longest)
    return own.groupBy("pattern").agg(F.count("*").alias("occurrences"), F.sum("utility").alias("utility"))


def answers(corpus: DataFrame, patterns: DataFrame, text: str = "text", id: str = "doc_id", weights: str | None = None, distinct_ids: bool = False) -> DataFrame:
    """(query_id, pattern, occurrences, utility), one row for each row of `patterns`; 0 where a pattern does not occur.

    With `weights` and `distinct_ids`, which the caller vouches for, utilities are looked up in prefix sums.
    """
    found = weighted_utility(corpus, patterns, weights, text, id) if weights and distinct_ids else pattern_utility(corpus, patterns, (), text, id, weights)
    out = patterns.select("query_id", "pattern").join(found, "pattern", "left")
    return out.select("query_id", "pattern", F.coalesce("occurrences", F.lit(0)).alias("occurrences"), F.coalesce("utility", F.lit(0)).alias("utility"))


def table_answers(corpus: DataFrame, patterns: DataFrame, table: DataFrame, text: str = "text", id: str = "doc_id", weights: str | None = None) -> DataFrame:
    """(query_id, pattern, utility, source): from a table (substr, utility) of frequent substrings, else from the text.

    The misses alone are searched for. All utilities equal those of answers().
    """
    known = _small(table.select(F.col("substr").alias("pattern"), "utility"))
    hits = patterns.join(known, "pattern").select("query_id", "pattern", "utility", F.lit("table").alias("source"))
    missed = patterns.join(_small(known.select("pattern")), "pattern", "left_anti")
    rest = answers(corpus, missed, text, id, weights).select("query_id", "pattern", "utility", F.lit("index").alias("source"))
    return hits.unionByName(rest)

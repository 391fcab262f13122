"""Substrings of bounded length with their occurrences, cut out of blocks.

Taking a substring of a long UTF-8 text walks it from the start. A text is therefore cut into blocks of a few hundred
symbols first, with as much overlap as the longest substring needs; a block owns the starts in its own part only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strandex.functions.symbols import symbols

from .lineage import spread

BLOCK = 64  # starts in a block, or four times what the longest substring needs if that is more


def blocks(corpus: DataFrame, reach: int, keep: tuple[str, ...] = (), text: str = "text", id: str = "doc_id", weights: str | None = None) -> DataFrame:
    """(doc_id, keep, start, own, block[, w]): every text in pieces of `own` starts and reach - 1 more symbols."""
    texts = spread(corpus.where(F.length(text) > 0).select(F.col(id).alias("doc_id"), *keep, F.col(text).alias("_t"), *([F.col(weights).alias("_w")] if weights else [])))
    arr = texts.withColumn("_s", symbols(F.col("_t")))
    size = max(BLOCK, 4 * reach)
    cut = lambda a, s: F.slice(a, s + 1, F.lit(size + reach - 1))
    fields = lambda s: [s.cast("long").alias("start"), F.least(F.lit(size), F.size("_s") - s).alias("own"), F.array_join(cut("_s", s), "").alias("block")] + ([cut("_w", s).alias("w")] if weights else [])
    return arr.select("doc_id", *keep, F.explode(F.transform(F.sequence(F.lit(0), F.size("_s") - 1, F.lit(size)), lambda s: F.struct(*fields(s)))).alias("b")).select("doc_id", *keep, "b.*")


def grams(corpus: DataFrame, lengths: list[int], keep: tuple[str, ...] = (), text: str = "text", id: str = "doc_id", weights: str | None = None, first: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """(doc_id, keep, pos, len, substr[, w]): every occurrence of every substring of the given lengths; pos is 0-based.

    `first` restricts to substrings that begin with one of these symbols; `where` is a condition on pos. Both act before
    lengths multiply the rows. `w` has the weights of the occurrence's symbols.
    """
    b = blocks(corpus, max(lengths), keep, text, id, weights)
    at = b.select("*", F.explode(F.sequence(F.lit(1), F.col("own"))).alias("p")).withColumn("pos", F.col("start") + F.col("p") - 1)
    if first is not None:
        at = at.where(F.expr("substring(block, p, 1)").isin(first))
    if where is not None:
        at = at.where(where)
    each = at.withColumn("len", F.explode(F.array(*map(F.lit, sorted(set(lengths))))) if len(set(lengths)) > 1 else F.lit(lengths[0]))
    each = each.where("p + len - 1 <= length(block)")
    return each.select("doc_id", *keep, "pos", "len", F.expr("substring(block, p, len)").alias("substr"), *([F.expr("slice(w, p, len)").alias("w")] if weights else []))


def span_grams(spans: DataFrame, lengths: list[int]) -> DataFrame:
    """(doc_id, pos, len, substr) of a text that came in spans, as read_spans() gives them, each occurrence once.

    A span owns the starts before its end; its overlap must reach max(lengths) - 1 symbols further.
    """
    found = grams(spans, lengths, ("span_start", "span_own"), where=F.col("pos") < F.col("span_own"))
    return found.select("doc_id", (F.col("span_start") + F.col("pos")).alias("pos"), "len", "substr")


def packable(corpus: DataFrame, id: str = "doc_id") -> bool:
    """Whether ids and positions fit in one long. Parquet answers this from a single column."""
    low, high = corpus.agg(F.min(id), F.max(id)).first()
    return low is not None and isinstance(low, int) and low >= 0 and high < 1 << 31


def counts(rows: DataFrame, by: tuple[str, ...] = (), first: bool = False, packed: bool = False) -> DataFrame:
    """(by, substr, len, freq[, first_doc, first_pos]) of gram rows, each as often as `n` says if it has one. Partial sums are combined before the shuffle.

    The first occurrence is the least (doc_id, pos); as one long, if `packed`, it is aggregated by hash and not by sort.
    """
    place = F.shiftleft(F.col("doc_id").cast("long"), 32).bitwiseOR(F.col("pos")) if packed else F.struct("doc_id", "pos")
    out = rows.groupBy(*by, "substr", "len").agg((F.sum("n") if "n" in rows.columns else F.count("*")).alias("freq"), *([F.min(place).alias("first")] if first else []))
    doc, pos = ("shiftright(first, 32)", "first & 4294967295L") if packed else ("first.doc_id", "first.pos")
    return out.select(*by, "substr", "len", "freq", *([F.expr(doc).alias("first_doc"), F.expr(pos).alias("first_pos")] if first else []))

"""Common extensions of two positions, minima over ranges of ranks, and fingerprints of prefixes and any substring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandex.functions import fingerprint
from strandex.functions.symbols import symbols

from .index import HEAD, alike, heads
from .lineage import forget, written
from .prefix import prefix_sums


def extension(left: Column, i: Column, right: Column, j: Column) -> Column:
    """Length of the longest common prefix of left[i:] and right[j:], 0-based; 0 from an end on, null if anything is null.

    Exact, and by symbols, not by fingerprints: the length is put together from its binary digits, the largest first,
    each of which costs one comparison. With one text twice it extends two positions of a text; with a pattern and
    j = 0 it tells how much of the pattern stands at i.
    """
    room = F.least(F.length(left) - i, F.length(right) - j)
    digits = F.array(*(F.lit(1 << b).cast("long") for b in range(30, -1, -1)))
    part = lambda t, at, n: F.substring(t, (at + 1).cast("int"), n.cast("int"))
    grown = lambda n, d: F.when((n + d <= room) & (part(left, i + n, d) == part(right, j + n, d)), n + d).otherwise(n)
    return F.when(room.isNotNull(), F.aggregate(digits, F.lit(0).cast("long"), grown))


def extensions(corpus: DataFrame, pairs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """`pairs` (doc_id, i, j, ...) with `lce`, the common extension of two positions of a text. Pairs of unknown texts go."""
    t = corpus.select(F.col(id).alias("doc_id"), F.col(text).alias("_t"))
    return pairs.join(t, "doc_id").withColumn("lce", extension(F.col("_t"), F.col("i"), F.col("_t"), F.col("j"))).drop("_t")


def fingerprint_extensions(corpus: DataFrame, pairs: DataFrame, text: str = "text", id: str = "doc_id", head: int = HEAD) -> DataFrame:
    """As extensions(), without a text in a row: by the first `head` symbols of positions, then by fingerprints of prefixes.

    Pairs whose heads differ end there. Others gallop: at each level both go on by twice as many symbols if the fingerprints
    of those are equal, else by halves of what failed, and what is left of less than a head is compared by symbol. A level is two joins by
    position of the pairs that it concerns, of which there are ever fewer; a pair carries four numbers. Two different stretches of n symbols are
    taken for equal with a chance of about n / 2^61. `corpus` may be in spans that overlap by `head` symbols, as files.read_spans() gives them. Ids of texts
    are distinct. Pairs of unknown, null or empty texts go; null positions give null, those beyond a text 0.
    """
    asked = pairs.select("doc_id", "i", "j").where("i IS NOT NULL AND j IS NOT NULL").distinct()
    own = written(heads(corpus, head, text, id).select("doc_id", "pos", "head"), "heads")
    sums = written(prefix_fingerprints(corpus, text, id), "prefixes")
    keys = ["doc_id", "i", "j"]

    def at(rows: DataFrame, table: DataFrame, value: str, ahead: Column, names: tuple[str, str]) -> DataFrame:
        for side, name in zip("ij", names, strict=True):
            there = table.select("doc_id", F.col("pos").alias("_at"), F.col(value).alias(name))
            rows = rows.withColumn("_at", F.col(side) + ahead).join(there, ["doc_id", "_at"], "left").drop("_at")
        return rows

    def compared(rows: DataFrame, level: int) -> DataFrame:
        """`rows` (keys, n, fi, fj) with `same`, whether the next 2^level symbols are alike, and gone on if they are."""
        size = 1 << level
        factor = F.lit(pow(fingerprint.BASE, size, fingerprint.PRIME)).cast("long")
        both = at(rows, sums, "fp", F.col("n") + size - 1, ("gi", "gj"))
        same = F.coalesce(fingerprint.suffix(F.col("gi"), F.col("fi"), factor) == fingerprint.suffix(F.col("gj"), F.col("fj"), factor), F.lit(False))
        both = both.withColumn("same", same)
        return both.select(*keys, (F.col("n") + F.when(F.col("same"), size).otherwise(0)).alias("n"), F.when(F.col("same"), F.col("gi")).otherwise(F.col("fi")).alias("fi"), F.when(F.col("same"), F.col("gj")).otherwise(F.col("fj")).alias("fj"), "same")

    first = written(at(asked, own, "head", F.lit(0), ("_a", "_b")).select(*keys, alike("_a", "_b", head).cast("long").alias("n")), "alike")
    done, tables = first.where(F.col("n") < head), [first, own, sums]
    going = first.where(F.col("n") == head)
    if not going.isEmpty():
        bottom = level = head.bit_length() - 1
        going = at(going, sums, "fp", F.col("n") - 1, ("fi", "fj"))
        failed: list[DataFrame] = []  # by level, from the bottom on
        while True:
            now = written(compared(going, level), "gallop")
            tables.append(now)
            failed.append(now.where("NOT same").drop("same"))
            going = now.where("same").drop("same")
            if going.isEmpty():
                break
            level += 1
        back = failed.pop()  # failed at `level`, and what remains is shorter
        while level > bottom:
            level -= 1
            back = written(compared(back, level).drop("same"), "halving")
            tables.append(back)
            back = back.unionByName(failed.pop())
        rest = at(back, own, "head", F.col("n"), ("_a", "_b")).select(*keys, (F.col("n") + alike("_a", "_b", head)).alias("n"))
        done = done.unionByName(rest)
    known = own.select("doc_id").distinct()
    found = written(done.select(*keys, F.col("n").alias("lce")).join(known, "doc_id", "left_semi"), "extensions")
    out = pairs.join(written(known, "texts"), "doc_id", "left_semi").join(found, keys, "left").select(*pairs.columns, "lce")
    forget(*tables)
    return out


def pattern_prefixes(corpus: DataFrame, asked: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """`asked` (doc_id, pos, pattern, ...) with `lcp`, how many first symbols of the pattern stand in the text at pos."""
    t = corpus.select(F.col(id).alias("doc_id"), F.col(text).alias("_t"))
    return asked.join(t, "doc_id").withColumn("lcp", extension(F.col("_t"), F.col("pos"), F.col("pattern"), F.lit(0))).drop("_t")


def range_minima(rows: DataFrame, asked: DataFrame, value: str = "lcp") -> DataFrame:
    """`asked` (doc_id, low, high, ...) with `least`, the minimum of `value` over ranks low to high, both included.

    `rows` is (doc_id, rank, value), ranks from 0 without gaps. A range is covered by two, each a power of two long and
    maybe overlapping, so that two equi-joins answer it. Only levels that are asked for are made, each from the one
    below. Empty ranges give null, as do those beyond the ends.
    """
    width = F.col("high") - F.col("low") + 1
    level = F.when(width > 0, F.length(F.bin(width.cast("long"))) - 1)
    q = asked.withColumn("_level", level).withColumn("_second", F.expr("high - shiftleft(1L, _level) + 1"))
    top = q.agg(F.max("_level")).first()[0]
    w = Window.partitionBy("doc_id").orderBy("rank")
    table = rows.select("doc_id", "rank", F.col(value).alias("_m0"))
    for k in range(1, (top or 0) + 1):
        up = F.lead(f"_m{k - 1}", 1 << (k - 1)).over(w)
        table = table.withColumn(f"_m{k}", F.when(up.isNotNull(), F.least(f"_m{k - 1}", up)))
    levels = F.array(*(F.col(f"_m{k}") for k in range((top or 0) + 1)))
    long_ = table.select("doc_id", "rank", F.posexplode(levels).alias("_level", "_m")).where("_m IS NOT NULL")
    first = long_.select("doc_id", F.col("rank").alias("low"), "_level", F.col("_m").alias("_a"))
    second = long_.select("doc_id", F.col("rank").alias("_second"), "_level", F.col("_m").alias("_b"))
    out = q.join(first, ["doc_id", "low", "_level"], "left").join(second, ["doc_id", "_second", "_level"], "left")
    least = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.least("_a", "_b")).alias("least")
    return out.select(*asked.columns, least)


def prefix_fingerprints(corpus: DataFrame, text: str = "text", id: str = "doc_id", span: int = 4096) -> DataFrame:
    """(doc_id, pos, fp): the fingerprint of each text up to and including pos.

    Symbols are weighted by falling powers of the base, whose sums are prefix sums in two levels and need no pass from
    left to right; one factor then gives the fingerprint. Ids are taken to be distinct. `corpus` may be in spans (span_start, span_own).
    """
    spans = ["span_start", "span_own"] if "span_start" in corpus.columns else []
    rows = corpus.select(F.col(id).alias("doc_id"), *spans, F.posexplode(symbols(F.col(text))).alias("pos", "ch")).withColumn("pos", F.col("pos").cast("long"))
    if spans:
        rows = rows.where("pos < span_own").withColumn("pos", F.col("pos") + F.col("span_start"))
    inverse = pow(fingerprint.BASE, -1, fingerprint.PRIME)
    rows = rows.select("doc_id", "pos", fingerprint.times(F.ascii("ch").cast("long"), fingerprint.power(F.col("pos"), inverse)).cast("decimal(19,0)").alias("w"))
    sums = prefix_sums(rows, span)
    residue = F.pmod(F.col("ps").cast("decimal(38,0)"), F.lit(fingerprint.PRIME).cast("decimal(38,0)")).cast("long")
    return sums.select("doc_id", "pos", fingerprint.times(residue, fingerprint.power(F.col("pos"))).alias("fp"))


def substring_fingerprints(table: DataFrame, found: DataFrame) -> DataFrame:
    """`found` (doc_id, pos, len, ...) with `fp`, from a table of prefix_fingerprints(); those beyond a text's end go."""
    high = table.select("doc_id", F.col("pos").alias("_e"), F.col("fp").alias("_high"))
    low = table.select("doc_id", (F.col("pos") + 1).alias("pos"), F.col("fp").alias("_low"))
    out = found.withColumn("_e", F.col("pos") + F.col("len") - 1).join(high, ["doc_id", "_e"]).join(low, ["doc_id", "pos"], "left")
    own = fingerprint.suffix(F.col("_high"), F.coalesce("_low", F.lit(0).cast("long")), fingerprint.power(F.col("len")))
    return out.withColumn("fp", own).select(*found.columns, "fp")

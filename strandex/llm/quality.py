"""Rule bitmask ledger [native].

Every rule is evaluated once for each document. The ledger keeps its measurements and one failure bit for each rule;
a policy is a named, versioned mask over those bits, so that changing a policy, or asking what one rule costs, reads
the ledger and never the texts. Everything is computed inside a row with array functions: there is no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .base import words

SYMBOLS = "#*$%&|<>"
SPAN = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: Name of each rule and its test over the measurements, by bit. A bit is never given to another rule.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_spans", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("short_words", "10 * word_chars < 15 * n_words"),
    ("long_words", "word_chars > 14 * n_words"),
    ("repeated_lines", "n_lines >= 4 AND 2 * n_dup_lines > n_lines"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A version and the rules that reject under it."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_spans"))
STANDARD = Policy("standard-1", tuple(BIT))
LENIENT = Policy("lenient-1", ("few_words", "repeated_spans", "symbols"))


def _repeated(hashes: str) -> Column:
    """Words inside windows of SPAN words that the text holds twice or more, every occurrence counted.

    `hashes` are the 64-bit hashes of the windows. Two different windows of one text sharing a hash would be counted
    as equal; with the longest text here that is a chance of about 1e-11.
    """
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.try_element_at(s, k)["h"] == x["h"], F.lit(False))
        hit = F.filter(s, lambda x, k: (F.when(k > 0, same(x, k)).otherwise(False)) | same(x, k + 2))
        return F.array_sort(F.transform(hit, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, k: F.least(F.lit(SPAN), F.coalesce(F.try_element_at(p, k + 2) - x, F.lit(SPAN))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    let = lambda value, body: F.transform(F.array(value), body)[0]  # noqa: E731  evaluates value once
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(let(pairs, starts), covered)).cast("long")


def ledger(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per input row: `keep`, the measurements as longs, and `fail_bits`.

    Null and empty texts have no words and fail `few_words`. Repeated rows give repeated results, and a null id stays null. A
    text of any length is measured whole, in its task's memory. Other columns of `docs` are ignored, whatever their names;
    a kept one that is named like a measurement is returned with `_kept` after its name. An empty table gives an empty one.
    """
    clash = [c for c in keep if c.lower() in (*MEASURES, "fail_bits")]
    if clash:
        docs = docs.select("*", *(F.col(c).alias(f"{c}_kept") for c in clash))
        return ledger(docs, text, tuple(f"{c}_kept" if c in clash else c for c in keep))
    t = F.coalesce(F.col(text), F.lit(""))
    bare = t
    for s in SYMBOLS:
        bare = F.replace(bare, F.lit(s), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    one = docs.select(*keep, words(F.col(text)).alias("__sx_w"), (F.length(t) - F.length(bare)).cast("long").alias("__sx_s"), lines.alias("__sx_l"))
    at = lambda i, k: F.get("__sx_w", i + k)
    windows = F.when(F.size("__sx_w") >= SPAN, F.transform(F.sequence(F.lit(0), F.size("__sx_w") - SPAN), lambda i: F.xxhash64(*(at(i, k) for k in range(SPAN))))).otherwise(F.array().cast("array<bigint>"))
    two = one.select(*keep, "__sx_w", "__sx_s", "__sx_l", windows.alias("__sx_h"))
    # A generator of one row: filters on what it makes stay above it, and so never compute a measurement again.
    measured = F.struct(
        F.size("__sx_w").cast("long").alias("n_words"),
        F.length(F.array_join("__sx_w", "")).cast("long").alias("word_chars"),
        F.col("__sx_s").alias("n_symbols"),
        F.size("__sx_l").cast("long").alias("n_lines"),
        (F.size("__sx_l") - F.size(F.array_distinct("__sx_l"))).cast("long").alias("n_dup_lines"),
        _repeated("__sx_h").alias("n_repeat_words"),
    )
    three = two.select(*keep, F.inline(F.array(measured)))
    bits = F.lit(0).cast("long")
    for name, test in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(test), F.lit(BIT[name]).cast("long")).otherwise(F.lit(0).cast("long")))
    return three.withColumn("fail_bits", bits)


def failed(policy: Policy, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def judged(rows: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """The ledger with `base_failed`, `kept` and the version of the policy."""
    return rows.select("*", failed(BASE).alias("base_failed"), (~failed(BASE) & ~failed(policy)).alias("kept"), F.lit(policy.version).alias("policy"))


def ablations(rows: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """For each rule of the policy: documents that fail it, and those that only it rejects (dropping it keeps them).

    The ledger is folded to one count for each combination of bits first, which the map side combines; there are at
    most 2 ** len(RULES) of them.
    """
    combos = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    each = combos.select("bits", "n", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in policy.rules))).alias("r")).select("bits", "n", "r.*")
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
    )


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Measurements, failure bits and verdict of all `documents`. Awkward rows: see ledger."""
    rows = judged(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


ORACLE = r"""
WITH w AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, text, ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
  CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) ELSE [] END AS gs FROM w),
g AS (SELECT doc_id, unnest(gs) AS gram, unnest(range(len(gs))) AS pos FROM l),
r AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT pos + k) AS n_repeat_words FROM r, range(5) AS t(k) GROUP BY doc_id),
m AS (SELECT l.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM l LEFT JOIN c ON l.doc_id = c.doc_id),
b AS (SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
  + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 10 * word_chars < 15 * n_words THEN 8 ELSE 0 END
  + CASE WHEN word_chars > 14 * n_words THEN 16 ELSE 0 END + CASE WHEN n_lines >= 4 AND 2 * n_dup_lines > n_lines THEN 32 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""

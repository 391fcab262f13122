"""Rolling polynomial fingerprints modulo the prime 2^61 - 1, as column expressions and as SQL functions.

Products of two residues have up to 122 bits, which decimal(38, 0) holds exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, functions as F

PRIME = (1 << 61) - 1
BASE = 1_000_003
_WIDE = "decimal(38,0)"


def _mod(x: Column) -> Column:
    return F.pmod(x, F.lit(PRIME).cast(_WIDE)).cast("long")


def times(a: Column, b: Column) -> Column:
    return _mod((a.cast("decimal(19,0)") * b.cast("decimal(19,0)")).cast(_WIDE))


def power(exponent: Column, base: int = BASE) -> Column:
    """base ** exponent mod PRIME for exponents from 0 to 2^31 - 1, by squaring: a factor for each binary digit."""
    squares = F.array(*(F.lit(pow(base, 1 << bit, PRIME)).cast("long") for bit in range(31)))
    factors = F.filter(squares, lambda s, bit: F.call_function("getbit", exponent.cast("int"), bit) == 1)
    return F.aggregate(factors, F.lit(1).cast("long"), times)


def fingerprint(text: Column, base: int = BASE) -> Column:
    """Fingerprint of a string's code points; 0 for the empty string, null for null."""
    points = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    fold = F.aggregate(points, F.lit(0).cast("long"), lambda h, c: _mod(h.cast("decimal(19,0)") * F.lit(base).cast("decimal(19,0)") + c.cast("decimal(19,0)")))
    return F.when(text == "", F.lit(0).cast("long")).otherwise(fold)


def concat(left: Column, right: Column, right_power: Column) -> Column:
    """Fingerprint of two strings joined, from theirs and base ** length of the right one."""
    return _mod((left.cast("decimal(19,0)") * right_power.cast("decimal(19,0)") + right.cast("decimal(19,0)")).cast(_WIDE))


def suffix(whole: Column, prefix: Column, suffix_power: Column) -> Column:
    """Fingerprint of what follows a prefix, from the whole, the prefix and base ** length of the rest."""
    return _mod((whole.cast("decimal(19,0)") - prefix.cast("decimal(19,0)") * suffix_power.cast("decimal(19,0)")).cast(_WIDE))


def register(spark: SparkSession, base: int = BASE) -> None:
    """SQL: kr_fingerprint(text), kr_concat(left, right, power), kr_suffix(whole, prefix, power); table function substrings(text, longest)."""
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION kr_fingerprint(t STRING) RETURNS BIGINT RETURN CASE WHEN t = '' THEN 0L ELSE "
        f"aggregate(transform(split(t, ''), c -> CAST(ascii(c) AS BIGINT)), 0L, (h, c) -> CAST(pmod(CAST(h AS DECIMAL(19,0)) * CAST({base} AS DECIMAL(19,0)) + CAST(c AS DECIMAL(19,0)), CAST({PRIME} AS DECIMAL(38,0))) AS BIGINT)) END"
    )
    wide = lambda a, b: f"CAST({a} AS DECIMAL(19,0)) * CAST({b} AS DECIMAL(19,0))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION kr_concat(l BIGINT, r BIGINT, p BIGINT) RETURNS BIGINT RETURN CAST(pmod({wide('l', 'p')} + CAST(r AS DECIMAL(19,0)), CAST({PRIME} AS DECIMAL(38,0))) AS BIGINT)")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION kr_suffix(w BIGINT, f BIGINT, p BIGINT) RETURNS BIGINT RETURN CAST(pmod(CAST(w AS DECIMAL(19,0)) - {wide('f', 'p')}, CAST({PRIME} AS DECIMAL(38,0))) AS BIGINT)")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION substrings(t STRING, longest INT) RETURNS TABLE (pos INT, len INT, substr STRING) RETURN "
        "SELECT x.p, x.n, substring(t, x.p + 1, x.n) FROM (SELECT inline(flatten(transform(CASE WHEN length(t) > 0 THEN sequence(0, length(t) - 1) ELSE array() END, "
        "p -> transform(sequence(1, least(longest, length(t) - p)), n -> struct(p AS p, n AS n)))))) AS x"
    )

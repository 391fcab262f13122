"""Symbols and their weights. A symbol is a code point."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Seven weights from 0.70 to 1.00, here in hundredths so that sums are exact.
WEIGHTS = (70, 75, 80, 85, 90, 95, 100)


def symbols(text: Column) -> Column:
    """The symbols of a text as an array; none for a null or empty one."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, ""))


def symbol_weight(ch: Column) -> Column:
    """A weight that depends on the symbol only, in hundredths: (code point % 7 + 14) * 5."""
    return ((F.ascii(ch) % 7 + 14) * 5).cast("long")


def random_weight(doc: Column, pos: Column, seed: int = 12345) -> Column:
    """One of WEIGHTS, uniformly, by a hash of document and position that any SQL engine can compute."""
    mixed = (doc * 1103515 + pos * 40503 + F.lit(seed)) % 1000003
    return F.element_at(F.array(*map(F.lit, WEIGHTS)), (((mixed * mixed) % 1000003) % 7 + 1).cast("int")).cast("long")


def gram_weight(gram: Column) -> Column:
    """Sum of symbol_weight over a string."""
    return F.aggregate(symbols(gram), F.lit(0).cast("long"), lambda a, c: a + symbol_weight(c))

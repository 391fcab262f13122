"""Counts of distinct substrings, taken text by text in arrays before rows are made of them.

Every position as a row is what substrings cost most. Here a task packs three symbols in a 64-bit key, sorts the keys of a
million positions or so, and gives a row for each distinct window with its count; Spark adds these up. Shorter substrings are
prefixes of windows, and their counts are sums of the windows' counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .lineage import spread

PIECE = 1 << 20  # starts that are sorted at a time
IN_KEY = 3  # symbols in a key, of 21 bits each; a symbol is its code point and 1, and 0 stands beyond a text's end
_BITS, _SYMBOL = 21, (1 << 21) - 1
_KIND = "n long, pos long, substr string"


class Piece:
    """A million starts or so: `cols` with the keys of each start's window of `last` symbols, and the rows and positions of starts.

    With `prefixes`, sorted keys for each of the first columns, starts with another key there are left out.
    """

    def __init__(self, parts: list[tuple[int, int, int, str]], last: int, prefixes: list[np.ndarray] = ()):
        n = -(-last // IN_KEY)
        gap = n * IN_KEY
        row, off, own, texts = zip(*parts, strict=True)
        size = np.array([len(t) for t in texts], np.int64)
        own = np.array(own, np.int64)
        start = np.cumsum(size + gap) - size - gap
        codes = np.frombuffer(("\0" * gap).join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) + 1
        codes[((start + size)[:, None] + np.arange(gap)).ravel()] = 0
        keys = (codes[:-2] << 2 * _BITS) | (codes[1:-1] << _BITS) | codes[2:]
        of = np.repeat(np.arange(len(texts)), own)
        at = np.arange(len(of)) - np.repeat(np.cumsum(own) - own, own)
        for j, known in enumerate(prefixes):
            here = keys[start[of] + at + IN_KEY * j]
            found = known[np.minimum(np.searchsorted(known, here), len(known) - 1)] == here
            of, at = of[found], at[found]
        first = start[of] + at
        self.cols = cut([keys[first + IN_KEY * j] for j in range(n)], last)
        self.row, self.pos = np.array(row, np.int64)[of], np.array(off, np.int64)[of] + at


def pieces(texts: list[str | None], last: int, prefixes: list[np.ndarray] = (), rows: list[int] | None = None, size: int = PIECE):
    """Texts as Pieces; a text longer than a piece is in several, each start in one."""
    parts, n = [], 0
    for i in range(len(texts)) if rows is None else rows:
        t = texts[i] or ""
        for off in range(0, len(t), size):
            own = min(size, len(t) - off)
            parts.append((i, off, own, t[off : off + own + last - 1]))
            n += own
            if n >= size:
                yield Piece(parts, last, prefixes)
                parts, n = [], 0
    if parts:
        yield Piece(parts, last, prefixes)


def runs(cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts by `cols`, and where runs of equal ones begin in it."""
    order = np.argsort(cols[0]) if len(cols) == 1 else np.lexsort(cols[::-1])
    if not len(order):
        return order, np.zeros(0, np.int64)
    new = np.zeros(len(order) - 1, bool)
    for c in cols:
        c = c[order]
        new |= c[1:] != c[:-1]
    return order, np.concatenate([[0], np.flatnonzero(new) + 1])


def distinct(p: Piece, whole: set[tuple[int, ...]] | None = None):
    """The distinct windows of a piece: an order of its starts, where each window begins in it, the windows' keys and counts.

    `whole` has the first keys that windows may have; the piece looked at these one by one.
    """
    order, at = runs(p.cols)
    n = np.diff(np.append(at, len(order)))
    cols = [c[order[at]] for c in p.cols]
    if whole and len(at) and len(next(iter(whole))) > 1:
        ok = np.array([x in whole for x in zip(*(c.tolist() for c in cols[: len(next(iter(whole)))]), strict=True)], bool)
        held = np.repeat(ok, n)
        order, n, cols = order[held], n[ok], [c[ok] for c in cols]
        at = np.cumsum(n) - n
    return order, at, cols, n


def strings(cols: list[np.ndarray]) -> pa.Array:
    """The substrings that keys stand for, as an Arrow column."""
    codes = np.stack([(c >> s) & _SYMBOL for c in cols for s in (2 * _BITS, _BITS, 0)], 1)
    held = codes > 0
    flat = (codes[held] - 1).astype("<u4")
    wide = np.where(held, 1 + (codes > 0x80) + (codes > 0x800) + (codes > 0x10000), 0).sum(1)
    ends = np.concatenate([[0], np.cumsum(wide)]).astype(np.int32)
    data = flat.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "replace")
    return pa.StringArray.from_buffers(len(wide), pa.py_buffer(ends), pa.py_buffer(data))


def cut(cols: list[np.ndarray], n: int) -> list[np.ndarray]:
    """The keys of the first n symbols, as many columns as before."""
    kept = [min(max(n - IN_KEY * j, 0), IN_KEY) for j in range(len(cols))]
    return [c & ~((1 << _BITS * (IN_KEY - k)) - 1) for c, k in zip(cols, kept, strict=True)]


def packed(substrings: list[str], last: int) -> list[np.ndarray]:
    """The keys of strings of at most `last` symbols."""
    n = -(-last // IN_KEY)
    codes = np.zeros((len(substrings), n * IN_KEY), np.int64)
    for i, s in enumerate(substrings):
        codes[i, : len(s)] = [ord(c) + 1 for c in s]
    return [(codes[:, j] << 2 * _BITS) | (codes[:, j + 1] << _BITS) | codes[:, j + 2] for j in range(0, n * IN_KEY, IN_KEY)]


def listed(prefixes: list[str] | None) -> tuple[list[np.ndarray], set[tuple[int, ...]]]:
    """What Piece and distinct() take for prefixes, which are of equal length, a multiple of IN_KEY."""
    cols = packed(prefixes, len(prefixes[0])) if prefixes else []
    return [np.unique(c) for c in cols], set(zip(*(c.tolist() for c in cols), strict=True))


def decoded(batch: pa.RecordBatch, name: str = "t") -> list[str | None]:
    """Texts of a binary column; what isn't UTF-8 is replaced, as Spark does where it takes a string apart."""
    return [None if t is None else t.decode("utf-8", "replace") for t in batch.column(name).to_pylist()]


def windows(corpus: DataFrame, last: int, keep: tuple[str, ...] = (), text: str = "text", id: str = "doc_id", first: bool = False, prefixes: list[str] | None = None) -> DataFrame:
    """(keep, n[, doc_id, pos], substr): distinct windows of `last` symbols, or as many as there are before a text's end, and how many starts have them.

    A window may be in several rows, with a part of its starts in each. With `first`, (doc_id, pos) is the least of these. `prefixes`, strings of equal
    length, a multiple of IN_KEY, restrict to windows that begin with one of them.
    """
    ids = ("doc_id",) if first else ()
    values, whole = listed(prefixes)
    size = PIECE

    def run(batches):
        for batch in batches:
            texts = decoded(batch)
            groups = {None: None}
            if keep:
                groups = {}
                for i, x in enumerate(zip(*(batch.column(c).to_pylist() for c in keep), strict=True)):
                    groups.setdefault(x, []).append(i)
            if first:
                rank = pc.rank(batch.column("doc_id"), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
                row_of = np.zeros(int(rank.max(initial=0)) + 1, np.int64)
                row_of[rank] = np.arange(len(rank))
            for rows in groups.values():
                for p in pieces(texts, last, values, rows, size):
                    order, at, cols, n = distinct(p, whole)
                    if not len(at):
                        continue
                    out = [pa.array(n), pa.nulls(len(n), pa.int64()), strings(cols)]
                    if first:
                        place = np.minimum.reduceat(((rank[p.row] << 32) | p.pos)[order], at)
                        out = [batch.column("doc_id").take(pa.array(row_of[place >> 32])), out[0], pa.array(place & 0xFFFFFFFF), out[2]]
                    own = [batch.column(c).take(pa.array(np.full(len(n), rows[0]))) for c in keep]
                    yield pa.RecordBatch.from_arrays([*own, *out], [*keep, *ids, "n", "pos", "substr"])

    kinds = dict(corpus.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"doc_id {kinds[id]}" for _ in ids), _KIND])
    texts = spread(corpus.where(F.length(text) > 0).select(*keep, *([F.col(id).alias("doc_id")] if first else []), F.col(text).alias("t")))
    out = texts.withColumn("t", F.col("t").cast("binary")).mapInArrow(run, schema)
    return out if first else out.drop("pos")


def prefixes_of(cols: list[np.ndarray], n: np.ndarray, first: np.ndarray, level: int, last: int):
    """(keys, count, first) of the prefixes of `level` to `last` symbols of sorted distinct windows, length by length; `first` is the least of a prefix's."""
    for length in range(level, last + 1):
        j, k = divmod(length - 1, IN_KEY)
        long = (cols[j] >> _BITS * (IN_KEY - 1 - k)) & _SYMBOL > 0
        own = [c[long] for c in cut(cols, length)]
        if len(own[0]):
            new = np.zeros(len(own[0]) - 1, bool)
            for c in own:
                new |= c[1:] != c[:-1]
            at = np.concatenate([[0], np.flatnonzero(new) + 1])
            yield [c[at] for c in own], np.add.reduceat(n[long], at), np.minimum.reduceat(first[long], at)


def substrings(found: DataFrame, level: int, last: int) -> DataFrame:
    """The prefixes of `level` to `last` symbols of windows() of `last` symbols: rows for counts(), with `len`."""
    rest = [c for c in found.columns if c != "substr"]
    each = found.withColumn("len", F.explode(F.sequence(F.lit(level), F.lit(last)))).where("len <= length(substr)")
    return each.select(*rest, "len", F.expr("substring(substr, 1, len)").alias("substr"))

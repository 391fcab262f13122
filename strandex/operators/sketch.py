"""Approximate heavy hitters among all substrings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .cache import Keeper, TopQueries
from .lineage import forget, spread
from .merging import summary
from .topk import STEP
from .windows import decoded

FIRST, SHARE, PIECE = 256, 8, 1 << 18  # starts that are walked together: see _pieces()
AHEAD = 256  # symbols that a piece holds after its last start, at first
SPARE = 4  # substrings that a task tracks for each that is asked for


def _pieces(texts, always: int):
    """Lists of (text, first start, number of starts): FIRST starts, then a SHARE of those so far, PIECE at most; a long text is in several."""
    parts, n, seen, size = [], 0, 0, FIRST
    for text in texts:
        starts, off = len(text) - always + 1, 0
        while off < starts:
            own = min(size - n, starts - off)
            parts.append((text, off, own))
            n, off = n + own, off + own
            if n == size:
                yield parts
                parts, n, seen = [], 0, seen + n
                size = min(max(FIRST, seen // SHARE), PIECE)
    if parts:
        yield parts


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, the place of each key in these, and how often each is there."""
    size = int(keys.max()) + 1
    if size > 4 * len(keys) + 1000:
        return np.unique(keys, return_inverse=True, return_counts=True)
    n = np.bincount(keys)
    there = np.flatnonzero(n)
    place = np.zeros(size, np.int64)
    place[there] = np.arange(len(there))
    return there, place[keys], n[there]


def _symbols(parts, ahead: int) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Symbols of a piece by number, with `ahead` after the last start of each part and then 0; the symbols; where parts begin."""
    texts = [text[off : off + own + ahead] for text, off, own in parts]
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    codes = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) + 1
    codes[ends] = 0
    symbols, codes, _ = _distinct(codes)
    return codes, ["", *(chr(c - 1) for c in symbols[1:].tolist())], np.concatenate([[0], ends[:-1] + 1])


def _going_on(of: np.ndarray, times: np.ndarray, skip: np.ndarray) -> np.ndarray:
    """Which occurrences go on: of substring i, which is where `of` is i, all but the first skip[i]."""
    ok = (skip < times)[of]
    some = np.flatnonzero(((skip > 0) & (skip < times))[of])
    some = some[np.argsort(of[some], kind="stable")]
    own = of[some]
    ok[some] = np.arange(len(own)) - np.searchsorted(own, own) >= skip[own]
    return ok


def walk(texts, k: int, longest: int | None = None, seed: int = 1, always: int = 1) -> dict[str, int]:
    """Estimates of the k substrings that a decaying sketch of 256 k cells tracks, in one pass over the texts.

    At every start, lengths up to `always` are counted. If the last of them is tracked, longer ones follow: a tracked
    one is counted and the walk goes on; another ends it if it isn't admitted, and, if it is and the table is full, with
    probability 1 / floor(1.08 ** length), which is certain up to length 9. Lengths end at `longest`, if given.

    The starts of a piece go together, length by length, and equal substrings are counted in a row, by first occurrence. Each
    occurrence is counted, and goes on or ends, as above. Pieces begin small, so that what is frequent is tracked before much
    has passed, and do not depend on how the texts come in.
    """
    top = TopQueries(k, Keeper(min(256 * k, 1 << 20), seed))
    draw, offer, full = top.counter.random, top.offer_times, top.kept.full
    for parts in _pieces(texts, always):
        ahead, n, strings = AHEAD, 0, [""]
        codes, chars, begin = _symbols(parts, ahead)
        own = np.array([o for _, _, o in parts])
        at = np.repeat(begin - np.cumsum(own) + own, own) + np.arange(own.sum())
        of = np.zeros(len(at), np.int64)
        while n != longest:
            if n > ahead:
                ahead, part, was = 4 * ahead, np.searchsorted(begin, at, "right") - 1, begin
                codes, chars, begin = _symbols(parts, ahead)
                at = at + (begin - was)[part]
            symbol = codes[at + n]
            n += 1
            inside = symbol > 0
            at, of, symbol = at[inside], of[inside], symbol[inside]
            if not len(at):
                break
            keys, of, times = _distinct(of * len(chars) + symbol)
            found = [strings[x // len(chars)] + chars[x % len(chars)] for x in keys.tolist()]
            first = np.zeros(len(keys), np.int64)
            first[of[::-1]] = np.arange(len(of))[::-1]
            skip = [0] * len(keys)
            uses = times.tolist()
            for i in np.argsort(first).tolist():
                j = offer(found[i], uses[i])
                if n < always or j == 0:
                    continue
                stop = j > uses[i] or n > always and full() and draw() * int(Keeper.DECAY ** min(n, 400)) < 1
                skip[i] = min(j, uses[i]) if stop else j - 1
            skip = np.array(skip)
            ok, left = _going_on(of, times, skip), skip < times
            strings = [found[i] for i in np.flatnonzero(left).tolist()]
            at, of = at[ok], (np.cumsum(left) - 1)[of[ok]]
    return dict(top.kept.items())


def heavy_keeper(corpus: DataFrame, k: int, longest: int | None = 6, text: str = "text", seed: int = 1) -> DataFrame:
    """(rank, substr, len, est_freq): a sketch for each task's part of the texts, then the k largest sums of their estimates.

    What a task does not track is missing from its sum, and the k best of all are not the k best of each: a task tracks SPARE * k.
    """

    def run(batches):
        kept = walk((t for b in batches for t in decoded(b) if t), SPARE * k, longest, seed)
        yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())], ["substr", "est"])

    texts = spread(corpus.where(F.length(text) > 0).select(F.col(text).cast("binary").alias("t")))
    part = texts.mapInArrow(run, "substr string, est long")
    total = part.groupBy("substr").agg(F.sum("est").alias("est_freq")).withColumn("len", F.length("substr"))
    order = [F.desc("est_freq"), F.asc("len"), F.asc("substr")]
    return total.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long")).select("rank", "substr", "len", "est_freq")


def approximate(corpus: DataFrame, k: int, longest: int | None = None, tracked: int = 10_000, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(substr, len, est_freq) by mergeable summaries of `tracked` counts each; est_freq - error <= frequency <= est_freq, see merging.summary().

    A pass has STEP lengths. Substrings go on to the next whose prefix was returned with the k-th best estimate so far
    or more, and the work ends when none is left, or at `longest`. The driver holds the k best.
    """
    spark = corpus.sparkSession
    best: list[tuple[str, int, int]] = []
    alive: list[str] = []
    level = 1
    while longest is None or level <= longest:
        last = level + STEP - 1 if longest is None else min(level + STEP - 1, longest)
        found = summary(corpus, last, max(tracked, k), text, id, level, alive)
        top = found.orderBy(F.desc("count"), F.length("substr"), "substr").limit(k).collect()
        forget(found)
        rows = [(r["substr"], len(r["substr"]), r["count"] + r["error"]) for r in top]
        best = sorted(best + rows, key=lambda r: (-r[2], r[1], r[0].encode()))[:k]
        bar = best[-1][2] if len(best) == k else 2
        alive = [s for s, n, freq in rows if n == last and freq >= bar]
        if not alive:
            break
        level = last + 1
    return spark.createDataFrame(best, "substr string, len int, est_freq long")

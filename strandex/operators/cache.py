"""Query caches over ordered streams of patterns: what hits, what is evicted.

Utilities never depend on a cache. A stream is (stream_id, seq, pattern); streams are independent, which is where the
work divides.
"""

from __future__ import annotations

from collections import OrderedDict, defaultdict
from functools import lru_cache
from math import log, log1p

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .lineage import written

_NO_STREAM = -(1 << 63)  # stands for null where streams are joined
SCHEMA = "stream_id long, seq long, pattern string, hit boolean, evicted string"


def lru_hits(stream: DataFrame, capacity: int) -> DataFrame:
    """`stream` with `hit` for a least-recently-used cache: seen before, and fewer than `capacity` distinct others since.

    A use counts as distinct inside an interval if its pattern's next use is not inside. Intervals shorter than the
    capacity hit at once and are not looked into. The others are cut into blocks of 2, 4, 8, ... uses, at most two of a size;
    in each block one sort by next use counts for all intervals that hold it. A stream of n uses makes n * log(longest interval) rows,
    never pairs. Rows without a stream_id are a stream of their own.
    """
    stream = stream.select(F.coalesce("stream_id", F.lit(_NO_STREAM)).alias("stream_id"), "seq", "pattern")
    uses = stream.withColumn("i", F.row_number().over(Window.partitionBy("stream_id").orderBy("seq")).cast("long"))
    w = Window.partitionBy("stream_id", "pattern").orderBy("i")
    uses = written(uses.withColumn("prev", F.lag("i").over(w)).withColumn("next", F.coalesce(F.lead("i").over(w), F.lit(1 << 62))), "uses")
    longest = uses.agg(F.max(F.col("i") - F.col("prev"))).first()[0] or 0
    sizes = F.explode(F.sequence(F.lit(0), F.lit(max(longest - 1, 1).bit_length() - 1))).alias("b")
    points = uses.where(F.lit(longest > capacity)).select("stream_id", "i", F.col("next").alias("key"), sizes)
    points = points.select("stream_id", "b", F.expr("shiftright(i, b)").alias("block"), "key", F.lit(1).alias("point"), F.lit(None).cast("long").alias("i"))
    # The interval (prev, i) holds the blocks [lo, hi) of a size; of these the odd first and the even last are in no larger block.
    open_ = uses.where(F.col("i") - F.col("prev") > capacity).select("stream_id", "i", "prev", sizes)
    open_ = open_.select("stream_id", "i", "b", F.expr("shiftright(prev + shiftleft(1L, b), b)").alias("lo"), F.expr("shiftright(i, b)").alias("hi")).where("lo < hi")
    open_ = open_.withColumn("block", F.explode(F.expr("filter(array(if(lo % 2 = 1, lo, null), if(hi % 2 = 1, hi - 1, null)), x -> x IS NOT NULL)")))
    both = points.unionByName(open_.select("stream_id", "b", "block", F.col("i").alias("key"), F.lit(0).alias("point"), "i"))
    later = Window.partitionBy("stream_id", "b", "block").orderBy(F.desc("key"), F.desc("point")).rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("m", F.sum("point").over(later)).where("point = 0").groupBy("stream_id", "i").agg(F.sum("m").alias("distinct"))
    out = uses.join(inside, ["stream_id", "i"], "left")
    hit = F.col("prev").isNotNull() & ((F.col("i") - F.col("prev") <= capacity) | (F.coalesce("distinct", F.lit(0)) < capacity))
    return out.select(F.nullif("stream_id", F.lit(_NO_STREAM)).alias("stream_id"), "seq", "pattern", hit.alias("hit"))


class Lru:
    """A miss puts the pattern in front and, when full, the least recent out."""

    def __init__(self, capacity: int):
        self.capacity, self.kept = capacity, OrderedDict()

    def use(self, key: str) -> tuple[bool, str | None]:
        hit = key in self.kept
        out = None
        if hit:
            self.kept.move_to_end(key)
        elif self.capacity > 0:
            if len(self.kept) >= self.capacity:
                out = self.kept.popitem(last=False)[0]
            self.kept[key] = None
        return hit, out


class Counts:
    """Exact counts of all patterns ever asked for."""

    def __init__(self):
        self.n = defaultdict(int)

    def add(self, key: str) -> int:
        self.n[key] += 1
        return self.n[key]


@lru_cache(1 << 16)
def _digests(key: str) -> tuple[int, int, int]:
    return tuple(xxhash.xxh64_intdigest(key, seed) for seed in (99, 0, 1))


def _draws(seed: int):
    """What a seeded generator's random() gives, drawn in blocks."""
    rng = np.random.default_rng(seed)
    while True:
        yield from rng.random(1024).tolist()


class Keeper:
    """Counts with exponential decay in two rows of `width` cells, with a seeded generator."""

    DECAY = 1.08
    CHANCE = tuple(1 / int(1.08**n) for n in range(401))  # that a cell of this count loses one to another key
    STAY = tuple(log1p(-p) if p < 1 else 0.0 for p in CHANCE)  # logarithm of the chance that it loses none

    def __init__(self, width: int = 1024, seed: int = 1):
        self.random = _draws(seed).__next__
        self.width = width
        self.cells = [[[0, 0] for _ in range(width)] for _ in range(2)]

    def add(self, key: str) -> int:
        best = 0
        mark, one, two = _digests(key)
        for cell in (self.cells[0][one % self.width], self.cells[1][two % self.width]):
            n = cell[0]
            if n and cell[1] == mark:
                cell[0] = n = n + 1
                if n > best:
                    best = n
            elif self.random() < self.CHANCE[n if n < 400 else 400]:
                cell[0] = n - 1
                if n <= 1:
                    cell[:] = [1, mark]
                    best = best or 1
        return best

    def add_times(self, key: str, times: int) -> tuple[int, int]:
        """`times` add()s in a row: which is the first to give a count, times + 1 if none is, and what the last gives.

        From the first on, each gives one more than the one before. How many it takes until a cell loses one is drawn at once.
        """
        first, best = times + 1, 0
        mark, one, two = _digests(key)
        for cell in (self.cells[0][one % self.width], self.cells[1][two % self.width]):
            n, left = cell[0], times
            if n and cell[1] == mark:
                cell[0] = n + times
                first, best = 1, max(best, n + times)
                continue
            while True:
                stay = self.STAY[n if n < 400 else 400]
                left -= 1 + int(log(1 - self.random()) / stay) if stay else 1
                if left < 0:
                    cell[0] = n
                    break
                n -= 1
                if n <= 0:
                    cell[:] = [1 + left, mark]
                    first, best = min(first, times - left), max(best, 1 + left)
                    break
        return first, best


class Ranked:
    """Keys in ascending order of counts, at most `capacity`; the first is the next to go. Steps of one take constant time.

    Ties are kept by place: a key whose count grows changes places with the last one of its old count, and a new key
    takes the place before all others, or of the one that goes.
    """

    def __init__(self, capacity: int, keys: list[str] | None = None, counts: list[int] | None = None):
        self.capacity = capacity
        held = len(keys or ())
        self.low = capacity - held  # first place in use
        self.keys: list = [None] * self.low + list(keys or ())
        self.counts: list = [0] * self.low + list(counts or ())
        self.place = {x: i for i, x in enumerate(self.keys) if i >= self.low}
        self.last = {self.counts[i]: i for i in range(self.low, capacity)}  # of each count

    def __contains__(self, key: str) -> bool:
        return key in self.place

    def full(self) -> bool:
        return self.low == 0

    def least(self) -> int:
        return self.counts[self.low] if self.low < self.capacity else 0

    def count(self, key: str) -> int:
        return self.counts[self.place[key]]

    def grow(self, key: str, by: int = 1) -> None:
        """Add `by` to a key's count, as that many steps of one would."""
        p = self.place[key]
        c, want = self.counts[p], self.counts[p] + by
        while True:
            q = self.last[c]
            other = self.keys[q]
            self.keys[p], self.keys[q] = other, key
            self.place[other], self.place[key] = p, q
            up = min(want, self.counts[q + 1]) if q + 1 < self.capacity else want
            self.counts[q] = up
            if q > self.low and self.counts[q - 1] == c:
                self.last[c] = q - 1
            else:
                del self.last[c]
            self.last.setdefault(up, q)
            if up == want:
                return
            p, c = q, up

    def enter(self, key: str, count: int) -> str | None:
        """Take in a new key; what goes for it. When full, `count` is the least one and 1."""
        gone = None
        if self.low:
            self.low -= 1
            self.counts[self.low] = count - 1
            self.last.setdefault(count - 1, self.low)
        else:
            gone = self.keys[0]
            del self.place[gone]
        self.keys[self.low] = key
        self.place[key] = self.low
        self.grow(key)
        return gone

    def items(self) -> list[tuple[str, int]]:
        return list(zip(self.keys[self.low :], self.counts[self.low :], strict=True))


class TopQueries:
    """The `capacity` most frequent patterns by a counter. When full, one is admitted as its count is the least one and 1, for the least."""

    def __init__(self, capacity: int, counter):
        self.capacity, self.counter, self.kept = capacity, counter, Ranked(max(capacity, 0))

    def offer(self, key: str) -> tuple[bool, str | None]:
        """Count a use: whether the key is admitted or its kept count grows, and what goes for it."""
        n = self.counter.add(key)
        kept = self.kept
        if key in kept:
            if n > kept.count(key):
                kept.grow(key)
                return True, None
            return False, None
        if self.capacity > 0 and (not kept.full() or n == kept.least() + 1):
            return True, kept.enter(key, n)
        return False, None

    def offer_times(self, key: str, times: int) -> int:
        """`times` offers in a row: which of them admits the key; 0 if it was kept before, times + 1 if none does."""
        first, last = self.counter.add_times(key, times)
        kept, at = self.kept, 0
        if key not in kept:
            if kept.full():
                n = kept.least() + 1
                at = times - (last - n)
                if not first <= at <= times or self.capacity <= 0:
                    return times + 1
            else:
                at, n = 1, max(last - times + 1, 0)
            kept.enter(key, n)
        if last > kept.count(key):
            kept.grow(key, last - kept.count(key))
        return at

    def use(self, key: str) -> tuple[bool, str | None]:
        hit = key in self.kept
        return hit, self.offer(key)[1]


def _held(cache) -> list[tuple[str, int | None]]:
    """What a cache holds, the next to go first: (pattern, its kept count; none for Lru)."""
    return [(k, None) for k in cache.kept] if isinstance(cache, Lru) else cache.kept.items()


POLICIES = {"lru": Lru, "lfu": lambda k: TopQueries(k, Counts()), "sketch": lambda k: TopQueries(k, Keeper())}


def replay(stream: DataFrame, policy: str, capacity: int) -> DataFrame:
    """`stream` with `hit` and the pattern that was `evicted`, by simulation.

    A policy of this kind is sequential: streams run in parallel, the rows of one stream are sorted and pass one task
    in batches, with nothing held but the cache. Rows without a stream_id are a stream of their own.
    """

    def run(batches):
        cache, last = None, None
        for pdf in batches:
            got = []
            for s, p in zip(pdf["stream_id"], pdf["pattern"], strict=True):
                s = None if pd.isna(s) else s
                if cache is None or s != last:
                    cache, last = POLICIES[policy](capacity), s
                got.append(cache.use(p))
            yield pdf.assign(hit=[h for h, _ in got], evicted=pd.Series([e for _, e in got], dtype=object, index=pdf.index))

    ordered = stream.select("stream_id", "seq", "pattern").repartition("stream_id").sortWithinPartitions("stream_id", "seq")
    return ordered.mapInPandas(run, SCHEMA)


def contents(stream: DataFrame, policy: str, capacity: int) -> DataFrame:
    """(stream_id, place, pattern, count): what each stream's cache holds after its last row; place 0 is the next to go.

    Streams pass tasks as in replay(). `count` is null for "lru", which has none.
    """

    def run(batches):
        cache, last = None, None

        def state():
            held = _held(cache)
            counts = pd.Series([c for _, c in held], dtype="Int64")
            return pd.DataFrame({"stream_id": pd.Series([last] * len(held), dtype="Int64"), "place": range(len(held)), "pattern": [k for k, _ in held], "count": counts})

        for pdf in batches:
            for s, p in zip(pdf["stream_id"], pdf["pattern"], strict=True):
                s = None if pd.isna(s) else int(s)
                if cache is None or s != last:
                    if cache is not None:
                        yield state()
                    cache, last = POLICIES[policy](capacity), s
                cache.use(p)
        if cache is not None:
            yield state()

    ordered = stream.select("stream_id", "seq", "pattern").repartition("stream_id").sortWithinPartitions("stream_id", "seq")
    return ordered.mapInPandas(run, "stream_id long, place long, pattern string, count long")

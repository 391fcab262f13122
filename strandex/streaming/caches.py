"""Query caches as streaming state, and substring counts over event time."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandex.operators.cache import Counts, Lru, Ranked, TopQueries


def _load(policy: str, capacity: int, state: GroupState):
    held = json.loads(state.get[0]) if state.exists else None
    if policy == "lru":
        cache = Lru(capacity)
        for key in held or ():
            cache.kept[key] = None
        return cache
    cache = TopQueries(capacity, Counts())
    if held:
        cache.kept = Ranked(max(capacity, 0), held["keys"], held["counts"])
        cache.counter.n.update(held["n"])
    return cache


def _save(policy: str, cache) -> str:
    return json.dumps(list(cache.kept) if policy == "lru" else {"keys": [k for k, _ in cache.kept.items()], "counts": [n for _, n in cache.kept.items()], "n": dict(cache.counter.n)})


def stream_replay(stream: DataFrame, policy: str, capacity: int) -> DataFrame:
    """(stream_id, seq, pattern, hit, evicted) of a streaming (stream_id, seq, pattern), policy `lru` or `lfu`.

    A stream's cache is its state. Rows of one trigger are taken by seq; rows that come in a later trigger count later.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cache = _load(policy, capacity, state)
        rows = pd.concat(list(frames)).sort_values("seq")
        used = [cache.use(p) for p in rows["pattern"]]
        state.update((_save(policy, cache),))
        yield pd.DataFrame({"stream_id": key[0], "seq": rows["seq"], "pattern": rows["pattern"], "hit": [h for h, _ in used], "evicted": pd.Series([e for _, e in used], dtype=object, index=rows.index)})

    return stream.groupBy("stream_id").applyInPandasWithState(run, "stream_id long, seq long, pattern string, hit boolean, evicted string", "cache string", "append", GroupStateTimeout.NoTimeout)


def windowed_patterns(events: DataFrame, text: str, ts: str = "ts", length: int = 3, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, substr, freq): counts of the substrings of `length` symbols by event-time window, with a watermark.

    Texts of events are short; they are cut where they are.
    """
    grams = F.expr(f"transform(sequence(1, greatest(length({text}) - {length} + 1, 1)), i -> substring({text}, i, {length}))")
    rows = events.withWatermark(ts, late).select(ts, F.explode(grams).alias("substr")).where(F.length("substr") == length)
    return rows.groupBy(F.window(ts, window), "substr").agg(F.count("*").alias("freq"))

"""Command line: `python -m strandex.cli COMMAND TEXT ...`.

topk TEXT K [--mode exact|node|levelwise] [--longest L]     exact top-K
sample TEXT K STRIDE [--pruned]                             by sampled positions
sketch TEXT K                                               by a sketch; also written beside the text
utility TEXT WEIGHTS|random PATTERNS [K [STRIDE]]               utilities, with a table of the K most frequent substrings
utility TEXT WEIGHTS|random random:COUNT:MIN:MAX [K [STRIDE]]   the same for random patterns
replay TEXT WEIGHTS|random K PATTERNS --policy lru|lfu|sketch
index TEXT PATH                                             store the suffixes of one text of any size, read in spans
sizes PATH                                                  files and bytes of a stored index
search PATH PATTERNS [--places]                             ranks and counts of patterns, or where they are, from a stored index
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandex.operators import cache, index, metrics, sketch, topk, utility
from strandex.sources import files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandex", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    for name, rest in (("topk", ()), ("sample", ("stride",)), ("sketch", ())):
        c = sub.add_parser(name)
        c.add_argument("text")
        for n in ("k", *rest):
            c.add_argument(n, type=int)
        c.add_argument("--longest", type=int, default=12)
        if name == "topk":
            c.add_argument("--mode", choices=("exact", "node", "levelwise"), default="node")
        if name == "sample":
            c.add_argument("--pruned", action="store_true")
    c = sub.add_parser("utility")
    for n in ("text", "weights", "patterns"):
        c.add_argument(n)
    c.add_argument("k", type=int, nargs="?", default=0)
    c.add_argument("stride", type=int, nargs="?", default=0)
    c.add_argument("--longest", type=int, default=12)
    c = sub.add_parser("replay")
    c.add_argument("text")
    c.add_argument("weights")
    c.add_argument("k", type=int)
    c.add_argument("patterns")
    c.add_argument("--policy", choices=tuple(cache.POLICIES), default="lru")
    c = sub.add_parser("index")
    c.add_argument("text")
    c.add_argument("path")
    sub.add_parser("sizes").add_argument("path")
    c = sub.add_parser("search")
    c.add_argument("path")
    c.add_argument("patterns")
    c.add_argument("--places", action="store_true")
    return p


def run(spark: SparkSession, argv: list[str]) -> DataFrame:
    a = parser().parse_args(argv)
    if a.command == "index":
        index.build(files.read_spans(spark, a.text), a.path)
        return spark.read.parquet(f"{a.path}/parts")
    if a.command == "sizes":
        return metrics.sizes(spark, a.path)
    if a.command == "search":
        found = index.search(spark, a.path, files.read_patterns(spark, a.patterns))
        return index.places(spark, a.path, found) if a.places else found
    corpus = files.read_text(spark, a.text)
    if a.command == "topk":
        if a.mode == "node":
            return topk.expanded(topk.top_nodes(corpus, a.k, a.longest))
        return topk.levelwise(corpus, a.k) if a.mode == "levelwise" else topk.exact(corpus, a.k, a.longest)
    if a.command == "sample":
        return (topk.sampled_pruned if a.pruned else topk.sampled)(corpus, a.k, a.longest, a.stride)
    if a.command == "sketch":
        out = sketch.heavy_keeper(corpus, a.k, a.longest)
        files.write_topk(out, f"{a.text}_sh_top_K{a.k}")
        return out
    if a.weights == "random":
        w = files.weight_rows(corpus).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"] / 100.0).alias("weights"))
    else:
        w = files.read_weights(spark, a.weights)
    corpus = files.with_weights(corpus, w)
    if a.patterns.startswith("random:"):
        count, low, high = map(int, a.patterns.split(":")[1:])
        asked = files.random_patterns(corpus, count, low, high).select("query_id", "pattern")
    else:
        asked = files.read_patterns(spark, a.patterns)
    found = utility.answers(corpus, asked, weights="weights")
    if a.command == "replay":
        hits = cache.replay(asked.select(F.lit(0).cast("long").alias("stream_id"), F.col("query_id").alias("seq"), "pattern"), a.policy, a.k)
        return hits.select(F.col("seq").alias("query_id"), "hit", "evicted").join(found, "query_id")
    if not a.k:
        return found.withColumn("source", F.lit("index"))
    frequent = topk.sampled(corpus, a.k, a.longest, a.stride).select("substr") if a.stride else topk.expanded(topk.top_nodes(corpus, a.k, a.longest)).select("substr")
    table = utility.pattern_utility(corpus, frequent.withColumnRenamed("substr", "pattern"), weights="weights").withColumnRenamed("pattern", "substr")
    return utility.table_answers(corpus, asked, table, weights="weights")


def main(argv: list[str] | None = None) -> None:
    spark = SparkSession.builder.appName("strandex").getOrCreate()
    run(spark, argv).show(1000, truncate=False)


if __name__ == "__main__":
    main()

"""What a run of queries cost and where its answers came from."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F


def sources(answered: DataFrame, table: DataFrame) -> DataFrame:
    """One row for the answers of table_answers(): (table_rows, queries, hits, misses, hit_rate, avg_length)."""
    hit = F.col("source") == "table"
    asked = answered.select(hit.cast("int").alias("hit"), F.length("pattern").alias("n"), F.lit(0).alias("held"))
    held = table.select(F.lit(None).cast("int").alias("hit"), F.lit(None).cast("int").alias("n"), F.lit(1).alias("held"))
    counted = lambda c, name: F.count_if(c).alias(name)
    return asked.unionByName(held).agg(
        counted(F.col("held") == 1, "table_rows"), counted(F.col("held") == 0, "queries"), counted(F.col("hit") == 1, "hits"), counted(F.col("hit") == 0, "misses"), F.avg("hit").alias("hit_rate"), F.avg("n").alias("avg_length")
    )


def cache_use(replayed: DataFrame) -> DataFrame:
    """(stream_id, queries, hits, hit_rate) of rows with `hit`."""
    return replayed.groupBy("stream_id").agg(F.count("*").alias("queries"), F.count_if("hit").alias("hits"), F.avg(F.col("hit").cast("int")).alias("hit_rate"))


def timed(answered: DataFrame, write=None) -> dict:
    """Run a query and measure it: {"queries", "seconds", "seconds_a_query"}. One pass, nothing is collected.

    `write` is called with the rows and must use all of them; without it they are only computed.
    """
    seen = Observation("queries")
    rows = answered.observe(seen, F.count(F.lit(1)).alias("queries"))
    at = time.perf_counter()
    (write or (lambda df: df.write.format("noop").mode("overwrite").save()))(rows)
    took = time.perf_counter() - at
    n = seen.get["queries"]
    return {"queries": n, "seconds": took, "seconds_a_query": took / n if n else None}


def sizes(spark: SparkSession, path: str) -> DataFrame:
    """(table, files, bytes) of what is stored under `path`: a row for each folder in it, as index.build() writes them.

    Only the files' lengths are read. A path without files gives no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    root = path.split(":", 1)[-1].rstrip("/").lstrip("/") + "/"
    below = F.split(F.expr("substr(path, instr(path, root) + length(root))"), "/")
    own = files.withColumn("root", F.lit(root)).select(F.get(below, F.lit(0)).alias("table"), "length")
    return own.groupBy("table").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))

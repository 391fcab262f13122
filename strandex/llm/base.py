"""Pieces that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Java, Python and RE2 spelling of one word: a run of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Where that is unset, a temporary folder if all runs in this one process (tests), and the warehouse on a cluster.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        local = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
        found = tempfile.mkdtemp(prefix="strandex-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/strandex"
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir() or found
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet and read that."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._strandex_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing will read again."""
    for df in tables:
        path = getattr(df, "_strandex_path", None)
        if path:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def words(text: Column) -> Column:
    """The words of a text as an array; empty for null or blank texts."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP))


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph as (id, component): the smallest id that each id reaches.

    Alternating large-star and small-star contraction. Only ids that have an edge are returned. Every round is two
    grouped minima, which Spark combines before the shuffle, and joins back; nothing is gathered by component. forget() takes
    the result's table away.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = written(e, "edges")
    before = None
    for _ in range(rounds):
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = written(small.unionByName(low.withColumnRenamed("m", "v")).distinct(), "edges")
        forget(e)
        e = new
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components: no fixed point")
    roots = e.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    out = e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
    out._strandex_path = e._strandex_path
    return out

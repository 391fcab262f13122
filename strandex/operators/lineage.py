"""Cutting lineage, and spreading small inputs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Where that is unset it is a temporary one in local mode, and in the warehouse on a cluster.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        local = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="strandex-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/strandex")
        found = sc.getCheckpointDir()
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder, and read from there."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._strandex_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing will read again."""
    for df in tables:
        path = getattr(df, "_strandex_path", None)
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores if its scan has fewer parts than there are cores: each row is about to become thousands.

    The parts are known from the plan, without a job or a list of files. A large input has more of them, whatever the
    number of its files, and is left as its scan divides it; so is what comes out of a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution()
    if plan.executedPlan().getClass().getSimpleName() == "AdaptiveSparkPlanExec":  # asking it for parts would run its stages
        return df
    return df.repartition(2 * cores) if plan.toRdd().getNumPartitions() < cores else df

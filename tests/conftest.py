import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")  # for Python workers
os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def same_as_sql(spark, sf):
    """Holds a query's rows against SQL's on the same tables."""
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")

    def check(query, sql):
        a, b = query(spark, sf).toPandas(), con.sql(sql).df()
        assert sorted(a.columns) == sorted(b.columns)
        cols = sorted(a.columns)
        a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b))
        assert len(a) == len(b)
        for c in cols:
            assert a[c].astype(str).tolist() == b[c].astype(str).tolist(), c

    return check

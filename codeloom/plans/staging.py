"""Cutting lineage through the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where that is unset in a local run, as in tests."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder; what is there goes when the driver ends, on any file system that Spark writes."""
    root = f"{shared_dir(spark).rstrip('/')}/codeloom-{spark.sparkContext.applicationId}"
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    read = df.sparkSession.read.schema(df.schema).parquet(path)
    read.staged_at = path
    return read


#: Tables of so many narrow rows are sent to every executor instead of moving the other side of a join.
FEW = 20_000


def few(rows: DataFrame) -> DataFrame:
    """``rows``, marked to be broadcast if they are few; counts them, so give a written table."""
    return F.broadcast(rows) if rows.limit(FEW + 1).count() <= FEW else rows


#: A task of a large join has about so many rows.
DEALT = 500_000


def deal(*rows: DataFrame) -> Callable[..., DataFrame]:
    """Deals frames by a key, of one column or more, into as many tasks as all of ``rows`` fill, which are counted; as Spark does it where its own tasks suffice."""
    n = -(-sum(x.count() for x in rows) // DEALT)
    return (lambda df, *key: df.repartition(n, *key)) if n > rows[0].sparkSession.sparkContext.defaultParallelism else (lambda df, *key: df)


def released(*made: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for df in made:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

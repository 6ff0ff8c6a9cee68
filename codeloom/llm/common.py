"""Shared helpers: the cluster's shared folder, staged tables, attempt-safe files."""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is read from ``spark.checkpoint.dir``.  Only where that is unset in local runs
    (tests) a new temporary folder is made and set; on a cluster that is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


_ROOTS: set[str] = set()


def scratch(spark: SparkSession, name: str) -> str:
    """A new, unused path in the shared folder, below a folder of this process that goes when the driver's Python ends."""
    root = f"{shared_dir(spark).rstrip('/')}/codeloom/{spark.sparkContext.applicationId}-{os.getpid()}"
    if not _ROOTS:
        atexit.register(_clear, os.getpid())
    _ROOTS.add(root)
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    if _STAGE["open"]:
        _STAGE["now"].append(path)
    return path


def released(spark: SparkSession, *made: DataFrame | str) -> None:
    """Delete staged tables and scratch folders that nothing will read again."""
    for x in made:
        at = spark._jvm.org.apache.hadoop.fs.Path(x if isinstance(x, str) else x.staged_at)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def swept(spark: SparkSession) -> None:
    """Let shuffle files go that no plan needs any more; else they stay until the driver happens to collect its garbage."""
    spark.range(1).count()  # the scheduler holds its last job's until it has another
    gc.collect()  # as do plans that Python still holds
    spark._jvm.System.gc()


_STAGE: dict = {"open": False, "now": [], "past": []}


@contextlib.contextmanager
def stage(docs: DataFrame):
    """A step of a pipeline whose predecessor's result was written, as its ``docs`` show: what the predecessor staged is deleted.

    Where ``docs`` still reads what the predecessor staged, all of that stays.
    """
    spark, past = docs.sparkSession, _STAGE["past"]
    if past and not any(p.rsplit("/", 1)[-1] in f for f in docs.inputFiles() for p in past):
        released(spark, *past)
        swept(spark)
    _STAGE.update(open=True, now=[], past=[])
    try:
        yield
    finally:
        _STAGE.update(open=False, past=_STAGE["now"])


def _clear(owner: int) -> None:
    """Delete this process's scratch folders; a file system that pyarrow can't open keeps them."""
    for root in _ROOTS if os.getpid() == owner else ():
        try:
            files, at = pafs.FileSystem.from_uri(root)
            files.delete_dir(at)
        except (OSError, ValueError):
            pass


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts lineage: a lost executor costs a reread, not a recomputation, and
    values that depend on the task layout are fixed once written.
    """
    path = scratch(df.sparkSession, name)
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    read = df.sparkSession.read.schema(df.schema).parquet(path)
    read.staged_at = path
    return read


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    """A text column with null counted as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def write_once(path: str, data: bytes) -> None:
    """Write a file so that readers only ever see it whole.

    Retried or speculative attempts of a task write the same bytes under
    private names; the last rename wins.
    """
    files, at = pafs.FileSystem.from_uri(path)
    files.create_dir(os.path.dirname(at), recursive=True)
    tmp = f"{at}.{uuid.uuid4().hex}.tmp"
    with files.open_output_stream(tmp) as out:
        out.write(data)
    files.move(tmp, at)


class OnceFile:
    """Like :func:`write_once`, for files that are written piece by piece."""

    def __init__(self, path: str):
        self.files, self.at = pafs.FileSystem.from_uri(path)
        self.files.create_dir(os.path.dirname(self.at), recursive=True)
        self.tmp = f"{self.at}.{uuid.uuid4().hex}.tmp"
        self.out = self.files.open_output_stream(self.tmp, buffer_size=1 << 20)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def commit(self) -> None:
        self.out.close()
        self.files.move(self.tmp, self.at)


def open_input(path: str) -> pa.NativeFile:
    files, at = pafs.FileSystem.from_uri(path)
    return files.open_input_file(at)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that one piece has at most ``rows`` rows and about ``size`` bytes (one row at least)."""
    for batch in batches:
        n, at = batch.num_rows, 0
        if not n:
            continue
        per_row = max(1, batch.nbytes // n)
        step = max(1, min(rows, size // per_row))
        while at < n:
            yield batch.slice(at, step)
            at += step


def strings(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a Spark DDL string of flat types."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(n, kinds[k]) for n, k in (x.strip().split(" ", 1) for x in ddl.split(","))])


ROW = "__row"


def numbered(docs: DataFrame) -> DataFrame:
    """A written copy of ``docs`` whose last column ``ROW`` names each row, whatever its ids; a column of that name gets another."""
    free = next(x for i in range(len(docs.columns) + 1) if (x := f"{ROW}{i}") not in {c.lower() for c in docs.columns})
    renamed = docs.toDF(*[free if c.lower() == ROW else c for c in docs.columns])
    return staged(renamed.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def keep_rows(rows: DataFrame, kept: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of ``numbered`` whose number is in ``kept`` (column row), without the number and under their own ``columns``."""
    return rows.join(kept.select(F.col("row").alias(ROW)), ROW, "left_semi").drop(ROW).toDF(*columns)

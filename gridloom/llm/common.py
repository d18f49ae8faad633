"""Shared helpers: scratch tables in the cluster's shared folder, word splitting, gapless numbering."""

from __future__ import annotations

import atexit
import ctypes
import inspect
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOCAL: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a temporary folder only where that is unset and one machine runs all (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL:
        folder = tempfile.TemporaryDirectory(prefix="gridloom-")
        atexit.register(folder.cleanup)
        _LOCAL.append("file://" + folder.name)
    return _LOCAL[0]


class Scratch:
    """Written tables that cut lineage. ``table`` writes one, ``drop`` removes it once nothing reads it any more.

    Tables that stand behind a returned DataFrame stay until the session's shared folder is cleared.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{scratch_root(spark)}/gridloom/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def table(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}-{name}"
        before = self.spark.conf.get(_CLEANUP)
        self.spark.conf.set(_CLEANUP, "true")  # the shuffle files of a written table are of no more use
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """While it lasts, what runs gets its rows in Arrow batches that end after ``size`` bytes (64 MB, or 10,000 rows, unless set).

    A row is never cut. A task holds a batch in the JVM, in a buffer that grows by doubling, and once more in its worker.
    """
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(size))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


@cache
def _trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Returns what this process has freed to the system: workers live on between tasks, and beside others."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def lean(function: Callable) -> Callable:
    """``function`` (of one or two groups, or a generator over batches), which gives memory back when it has ended."""
    if inspect.isgeneratorfunction(function):

        def run(batches):
            yield from function(batches)
            give_back()

    elif function.__code__.co_argcount == 2:

        def run(left, right):
            out = function(left, right)
            give_back()
            return out

    else:

        def run(group):
            out = function(group)
            give_back()
            return out

    return run


def words_of(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text in UTF-8; bytes.split() cuts at exactly these six characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def cumcount(keys: np.ndarray, seen: dict[int, int]) -> np.ndarray:
    """For each key how often it came before, here and in earlier calls with the same ``seen``."""
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    starts = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(keys)])
    base = np.array([seen.get(int(k), 0) for k in sorted_keys[starts]], np.int64)
    for k, n in zip(sorted_keys[starts].tolist(), sizes.tolist(), strict=True):
        seen[k] = seen.get(k, 0) + n
    out = np.empty(len(keys), np.int64)
    out[order] = np.arange(len(keys)) - np.repeat(starts, sizes) + np.repeat(base, sizes)
    return out


def with_counts(df: DataFrame, key: str) -> DataFrame:
    """``df`` with ``part`` and ``local``: the task and the running number of ``key`` (never null) in that task.

    It must be written to a table before it is used: the numbers hold for the rows as they were written. Rows stay in
    Arrow, so that whole numbers beside nulls keep all their digits.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            local = cumcount(b.column(key).to_numpy(zero_copy_only=False).astype(np.int64), seen)
            yield appended(b, part=np.full(len(local), part, np.int32), local=local)

    schema = T.StructType([*df.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("local", T.LongType())])
    return df.mapInArrow(step, schema)


def appended(batch: pa.RecordBatch, **columns: np.ndarray) -> pa.RecordBatch:
    """The batch with further columns."""
    return pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, columns.values())], names=[*batch.schema.names, *columns])


def gapless(written: DataFrame, key: str, out: str) -> DataFrame:
    """Number the rows of each ``key`` from 0 without gaps and without gathering a key's rows in one task.

    ``written`` comes from ``with_counts`` and a scratch table. Only one row per task and key is ordered globally.
    """
    sums = written.groupBy("part", key).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("part", key, F.coalesce(before, F.lit(0)).alias("before"))
    return written.join(sums, ["part", key]).withColumn(out, F.col("before") + F.col("local")).drop("before", "local", "part")

"""Helpers that several operators share: stored intermediates and distributed ranks."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: the only separators between words.
WORD = r"[^\x20\x09-\x0D]+"


_scope: ContextVar[str] = ContextVar("scope", default="")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the session names none and all runs on one machine a temporary folder is made; on a cluster
    executors would not see it, so that there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if (jdir := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
            return jdir.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallyworks-"))
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found


def tables_dir(spark: SparkSession) -> str:
    """The folder of this application's stored tables; Hadoop's file system removes it when the driver ends."""
    folder = f"{shared_dir(spark).rstrip('/')}/tallyworks-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.mkdirs(path):
        fs.deleteOnExit(path)
    return f"{folder}/{inner}" if (inner := _scope.get()) else folder


@contextmanager
def scope(name: str) -> Iterator[None]:
    """Tables stored within go to a folder of this name, which release() removes."""
    before = _scope.set(name)
    try:
        yield
    finally:
        _scope.reset(before)


def collect_garbage(spark: SparkSession) -> None:
    """Remove the files of shuffles that neither Python nor the JVM refers to any longer: the driver's cleaner does, once it knows."""
    gc.collect()
    spark._jvm.System.gc()


def release(spark: SparkSession, *scopes: str) -> None:
    """Remove what these scopes have stored (all, if none is named), once no result that reads it is needed any more.

    Shuffle files of results that nobody holds any longer go too.
    """
    folder = tables_dir(spark)
    for name in scopes or ("",):
        _delete(spark, f"{folder}/{name}" if name else folder)
    collect_garbage(spark)


#: Stored tables: the application, a weak reference to what every DataFrame that reads one holds, and its folder.
_tables: list[tuple[str, Any, str]] = []


def exists(spark: SparkSession, file: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(file)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Remove the stored tables, and the shuffle files, that no DataFrame refers to any longer.

    A DataFrame, and whatever is derived from it, keeps the tables it reads (one that lives on as an RDD alone
    does not).
    """
    own = spark.sparkContext.applicationId
    _tables[:] = [t for t in _tables if t[0] == own]  # those of applications that have ended are gone with them
    waited = 0
    while _tables and waited < 3:  # the JVM learns a moment later what Python has let go
        collect_garbage(spark)
        gone = [t for t in _tables if t[1].get() is None]
        for _, _, folder in gone:
            _delete(spark, folder)
        _tables[:] = [t for t in _tables if t not in gone]
        waited = 0 if gone else waited + 1
        time.sleep(0.1)


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{tables_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    files = out._jdf.queryExecution().analyzed().relation().location()
    _tables.append((spark.sparkContext.applicationId, spark._jvm.java.lang.ref.WeakReference(files), path))
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_col(name: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def running(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Exact running totals of ``value`` within ``keys`` in ``order``, without gathering a key in one task.

    Adds ``{name}_before`` (sum of the earlier rows of the key, long) and ``{name}_total`` (sum of the key).
    Rows are range-sorted by (keys, order), so that a hot key spans many partitions; each partition sums
    its own rows, and the (key, partition) sums - at most partitions + keys of them - are added up in a
    second, small pass. df should be cheap to read twice (a stored table), because range partitioning
    samples it. Ties in order are broken arbitrarily, once: the sorted rows are stored.
    """
    spark = df.sparkSession
    n = partitions(spark)
    ordered = df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    schema = ordered.withColumn("_pid", F.lit(0)).withColumn("_local", F.lit(0).cast("long")).schema
    tagged = ordered.withColumn("_pid", F.spark_partition_id()).withColumn("_key", F.sha2(F.to_json(key, {"ignoreNullFields": "false"}), 256))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            k = b.column("_key").to_numpy(zero_copy_only=False)
            v = b.column(value).to_numpy(zero_copy_only=False).astype(np.int64)
            start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            cum = np.cumsum(v) - v
            base = np.repeat(cum[start], np.diff(np.r_[start, len(k)]))
            local = cum - base
            if k[0] == last:
                local[: start[1] if len(start) > 1 else len(k)] += carry
            last, carry = k[-1], int(local[-1] + v[-1])
            cols = [b.column(c) for c in b.schema.names if c != "_key"]
            names = [c for c in b.schema.names if c != "_key"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(local, pa.int64())], [*names, "_local"])

    kept = stored(tagged.mapInArrow(add, schema), f"running-{name}")
    same = [F.col(f"_k{i}").eqNullSafe(F.col(k)) for i, k in enumerate(keys)]
    sums = kept.groupBy("_pid", *keys).agg(F.sum(value).alias("_sum"))
    sums = stored(sums.select(F.col("_pid").alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_sum"), f"sums-{name}")
    from pyspark.sql import Window

    by = [f"_k{i}" for i in range(len(keys))] or [F.lit(0)]
    w = Window.partitionBy(*by)
    sums = sums.withColumn("_total", F.sum("_sum").over(w)).withColumn("_off", F.sum("_sum").over(w.orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_sum"))
    on = F.col("_pid") == F.col("_p")
    for c in same:
        on = on & c
    out = kept.join(sums, on)
    return out.select(*df.columns, (F.col("_local") + F.col("_off")).alias(f"{name}_before"), F.col("_total").alias(f"{name}_total"))


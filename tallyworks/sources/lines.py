"""Log files as lines in order."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from py4j.java_gateway import JavaObject
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LISTERS, _NO_PLACES = "spark.sql.sources.parallelPartitionDiscovery.parallelism", "spark.sql.sources.ignoreDataLocality"
# The folder partitionBy takes for no value, and what it escapes in the name of one.
_NONE = "__HIVE_DEFAULT_PARTITION__"
_ESCAPED = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")


def _store(spark: SparkSession, root: str) -> tuple[JavaObject, JavaObject, bool]:
    """The path of a root, its file system, and whether that is a folder which all share (``file:``)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return path, fs, fs.getUri().getScheme() == "file"


@contextmanager
def few_listers(spark: SparkSession, root: str | list[str]) -> Iterator[None]:
    """While a reader lists folders: a few tasks for each core, where Spark starts one for each folder, up to 10,000; and no places of blocks in shared folders, which have none."""
    before = {k: spark.conf.get(k) for k in (_LISTERS, _NO_PLACES)}
    spark.conf.set(_LISTERS, str(min(int(before[_LISTERS]), 3 * spark.sparkContext.defaultParallelism)))
    if all(_store(spark, r)[2] for r in ([root] if isinstance(root, str) else root)):
        spark.conf.set(_NO_PLACES, "true")
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def list_files(spark: SparkSession, root: str | list[str], name: str = "*.jsonl", since: str | None = None, most: int | None = None) -> DataFrame:
    """Files below root whose name fits: file, modified, size; the first ``most`` by path, or all. Contents are not read. Links are not followed."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).option("ignoreMissingFiles", True)
    if since:
        reader = reader.option("modifiedAfter", since)
    with few_listers(spark, root):
        found = reader.load(root)
    return found.select(F.col("path").alias("file"), F.col("modificationTime").alias("modified"), F.col("length").alias("size")).transform(lambda df: df if most is None else df.orderBy("file").limit(most))


def detect(spark: SparkSession, sources: dict[str, tuple[str, str]]) -> dict[str, int]:
    """How many files each source (label -> root, name) has; 0 for a root that is not there."""
    found = {}
    for label, (root, name) in sources.items():
        path, fs, _ = _store(spark, root)
        found[label] = list_files(spark, root, name).count() if fs.exists(path) else 0
    return found


def folders(spark: SparkSession, root: str) -> list[str]:
    """Folders right below a root. The driver keeps every file that a reader has listed: what is counted a folder at a time needs those of one folder."""
    path, fs, _ = _store(spark, root)
    return sorted(f.getPath().toString() for f in fs.listStatus(path) if f.isDirectory() and not f.getPath().getName().startswith("."))


def roots(default: str, override: str | None) -> list[str]:
    """Root folders of a source: the comma list of an override, if it names any."""
    named = [x.strip() for x in (override or "").split(",") if x.strip()]
    return named or [default]


def read_lines(spark: SparkSession, root: str | list[str], name: str = "*.jsonl", since: str | None = None, keywords: list[str] | None = None) -> DataFrame:
    """Lines of log files: file, modified, block, seq, line; (block, seq) orders the lines of a file.

    Files are split like any text, so that one of any size is read in parallel. With keywords only lines
    that hold one of them come back: a cheap test before any parsing.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name)
    if since:
        reader = reader.option("modifiedAfter", since)
    meta = F.col("_metadata")
    with few_listers(spark, root):
        found = reader.text(root)
    df = found.select(meta["file_path"].alias("file"), meta["file_modification_time"].alias("modified"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("seq"), F.col("value").alias("line"))
    return df.filter(has_any("line", keywords)) if keywords else df


def _folder_writer(root: str, names: list[str], job: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes sorted rows of folder names and a line, a file for each folder; it gets its name when it is whole, so that a task can be run again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{job}.txt"
        at, folder, out, made = None, "", None, 0
        waiting = f".{name}.{task.taskAttemptId()}"
        try:
            for batch in batches:
                *keys, line = (c.to_pylist() for c in batch.columns)
                for key, rows in groupby(zip(zip(*keys), line), itemgetter(0)):
                    if out is None or key != at:
                        if out:
                            out.close()
                            os.replace(f"{folder}/{waiting}", f"{folder}/{name}")
                        values = (_NONE if k is None else _ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", k) for k in key)
                        at, folder, made = key, "/".join([root, *map("=".join, zip(names, values))]), made + 1
                        os.makedirs(folder, exist_ok=True)
                        out = open(f"{folder}/{waiting}", "wb")
                    out.write(b"".join((r[1] or b"") + b"\n" for r in rows))
            if out:
                out.close()
                os.replace(f"{folder}/{waiting}", f"{folder}/{name}")
        finally:
            if out:
                out.close()
        yield pa.RecordBatch.from_pydict({"files": pa.array([made], pa.int64())})

    return run


def write_lines(df: DataFrame, root: str, folders: list[str], line: str = "line") -> None:
    """Lines as text files below root, in folders named by columns as ``partitionBy`` names them: a file of each task that has rows of a folder.

    In a shared folder (``file:``) tasks write the files themselves. Hadoop's local file system starts a process (chmod)
    for each file, its checksum and its folder, about 40 ms of a core for a file. Other stores are left to Spark's writer.
    """
    rows = df.select(*folders, F.col(line).alias("value"))
    path, fs, shared = _store(df.sparkSession, root)
    if not shared:
        return rows.write.mode("append").partitionBy(*folders).text(root)
    fs.mkdirs(path)
    names = [F.when(~F.col(c).cast("string").isin("", _NONE), F.col(c).cast("string")).alias(c) for c in folders]
    rows = rows.select(*names, F.col("value").cast("binary").alias("value")).sortWithinPartitions(*folders)
    rows.mapInArrow(_folder_writer(path.toUri().getPath(), folders, uuid.uuid4().hex), "files long").agg(F.sum("files")).collect()


def has_any(line: str, keywords: list[str]) -> Column:
    found = F.lit(False)
    for k in keywords:
        found = found | F.col(line).contains(k)
    return found


def malformed(lines: DataFrame) -> DataFrame:
    """Non-empty lines that are no JSON, counted for each file."""
    bad = (F.trim("line") != "") & F.try_parse_json("line").isNull()
    return lines.filter(bad).groupBy("file").agg(F.count("*").alias("malformed"))

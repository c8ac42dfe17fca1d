"""An index of a store's keys: which of its files may hold a key, told without opening them.

The index lies beside the store, as runs. A run has the keys of some store files with the file of each, cut
by the top bits of the key's hash into files of about KEYS_PER_FILE keys, and for each of these a Bloom filter
whose blocks follow the hash too: blocks of one cache line, of which a key sets six bits. A batch of keys is
dealt by hash, meets only the slices of filters of its part of the hash range (two bytes a key, against the
whole key column of the store), and opens only the files whose filter lets one of its keys through.

The store is the truth. What it holds is compared with what the runs cover before each use: files that came
since - of a run cut short between store and index, or of another writer - are indexed first, and keys of
files that are gone count no more. So nothing has to be written in one step with the store. Runs are merged
when they become many; a run counts from when its last part, ``meta``, is there.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys of an index file; keys of a filter's block of 64 bytes; runs from which some are merged.
KEYS_PER_FILE, KEYS_PER_BLOCK, MOST_RUNS = 1 << 20, 32, 12
#: Keys that one task writes: a large part is written by several, each a range of its hashes.
KEYS_PER_TASK = 1 << 17
BLOCK, PROBES = 64, 6
KEYS = "h long, key string, file string"
FILTERS = "part long, filter binary"
U = np.uint64


def folder(path: str) -> str:
    return f"{path.rstrip('/')}.keys"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def store_files(spark: SparkSession, path: str) -> DataFrame:
    """The data files of a store: path, file (as rows name it) and modified. Contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    return found.select("path", F.col("_metadata.file_path").alias("file"), F.col("modificationTime").alias("modified"))


def _hash(key: str) -> Column:
    return F.xxhash64(F.col(key).cast("string"))


def _top(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("long")


def _bits(h: np.ndarray) -> np.ndarray:
    """(keys, PROBES): the bits of a key in its block, which do not hang on the top bits of its hash."""
    with np.errstate(over="ignore"):
        x = (h ^ (h >> U(31))) * U(0x7FB5D329728EA185)
        x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
        x ^= x >> U(33)
    return (x[:, None] >> np.arange(0, 9 * PROBES, 9, dtype=U) & U(511)).astype(np.int64)


def _block(h: np.ndarray, bits: int, blocks: int) -> np.ndarray:
    """The block of each key among 2^blocks, by the bits of the hash below the first ``bits``."""
    return (h << U(bits) >> U(64 - blocks)).astype(np.int64) if blocks else np.zeros(len(h), np.int64)


def make_filter(h: np.ndarray, bits: int, blocks: int) -> bytes:
    out = np.zeros(8 * BLOCK << blocks, bool)
    out[(_block(h, bits, blocks)[:, None] * 8 * BLOCK + _bits(h)).ravel()] = True
    return np.packbits(out, bitorder="little").tobytes()


def may_hold(part: bytes, first: int, h: np.ndarray, bits: int, blocks: int) -> np.ndarray:
    """Whether a filter, of which ``part`` begins with block ``first``, lets keys through: no for sure, or perhaps."""
    at = (_block(h, bits, blocks) - first)[:, None] * 8 * BLOCK + _bits(h)
    data = np.frombuffer(part, np.uint8)
    return (data[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(1)


class Run:
    """A run that counts: its name, how it is cut, and how large it is."""

    def __init__(self, name: str, bits: int, blocks: int, n: int, replaces: list[str]):
        self.name, self.bits, self.blocks, self.n, self.replaces = name, bits, blocks, n, replaces


def runs(spark: SparkSession, path: str) -> list[Run]:
    fs, root = _path(spark, folder(path))
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    whole = [n for n in names if fs.exists(_path(spark, f"{root}/{n}/meta/_SUCCESS")[1])]
    if not whole:
        return []
    found = [Run(**r.asDict()) for r in spark.read.parquet(*[f"{root}/{n}/meta" for n in whole]).collect()]  # a row for each run
    merged = {name for r in found for name in r.replaces}
    return [r for r in found if r.name not in merged]


def _write(spark: SparkSession, path: str, keys: DataFrame, files: DataFrame, replaces: list[str], keys_per_file: int) -> Run:
    """A new run of keys (h, key, file) of files (file, modified)."""
    name = uuid.uuid4().hex
    root = f"{folder(path)}/{name}"
    keys = keys.persist()
    n = keys.count()
    bits = max(0, math.ceil(math.log2(max(1, n) / keys_per_file)))
    blocks = max(0, math.ceil(math.log2(max(1, n) / KEYS_PER_BLOCK / (1 << bits))))
    finer = bits + max(0, math.ceil(math.log2(max(1, n) / (1 << bits) / KEYS_PER_TASK)))
    parted = keys.withColumn("part", _top(F.col("h"), bits)).repartition(1 << finer, _top(F.col("h"), finer)).sortWithinPartitions("part", "h")
    parted.write.partitionBy("part").parquet(f"{root}/keys")

    def filters(t: pa.Table) -> pa.Table:
        return pa.table({"part": t.column("part").slice(0, 1), "filter": pa.array([make_filter(t.column("h").to_numpy().view(U), bits, blocks)], pa.binary())})

    if n:
        spark.read.parquet(f"{root}/keys").select(F.col("part").cast("long").alias("part"), "h").groupBy("part").applyInArrow(filters, FILTERS).write.parquet(f"{root}/filters")
    else:
        spark.createDataFrame([], FILTERS).write.parquet(f"{root}/filters")
    files.select("file", "modified").write.parquet(f"{root}/files")
    keys.unpersist()
    spark.createDataFrame([(name, bits, blocks, n, replaces)], "name string, bits int, blocks int, n long, replaces array<string>").coalesce(1).write.parquet(f"{root}/meta")
    return Run(name, bits, blocks, n, replaces)


def refresh(spark: SparkSession, path: str, key: str, files: DataFrame, keys_per_file: int = KEYS_PER_FILE, most_runs: int = MOST_RUNS) -> list[Run]:
    """The runs that cover the store; what they lack is read, of only the files that came since."""
    root, known = folder(path), runs(spark, path)
    new = files
    if known:
        covered = spark.read.parquet(*[f"{root}/{r.name}/files" for r in known])
        new = files.join(covered, ["file", "modified"], "left_anti")
    new = new.persist()
    paths = [r["path"] for r in new.select("path").collect()]  # a name for each file that came since
    if paths:
        keys = spark.read.option("basePath", path).parquet(*paths).select(_hash(key).alias("h"), F.col(key).cast("string").alias("key"), F.col("_metadata.file_path").alias("file"))
        known = [*known, _write(spark, path, keys.filter("key is not null"), new, [], keys_per_file)]
    new.unpersist()
    if len(known) > most_runs:
        # the smallest become one; what of them belongs to files that are gone is left out
        known.sort(key=lambda r: r.n)
        some, rest = known[: len(known) - most_runs // 2], known[len(known) - most_runs // 2 :]
        live = files.select("file", "modified")
        covered = spark.read.parquet(*[f"{root}/{r.name}/files" for r in some]).join(live, ["file", "modified"], "left_semi")
        keys = spark.read.schema(KEYS).option("recursiveFileLookup", True).parquet(*[f"{root}/{r.name}/keys" for r in some if r.n]) if any(r.n for r in some) else spark.createDataFrame([], KEYS)
        merged = _write(spark, path, keys.select("h", "key", "file").join(live.select("file"), "file", "left_semi").select("h", "key", "file"), covered, [r.name for r in some], keys_per_file)
        known = [*rest, merged]
        for r in some:
            fs, gone = _path(spark, f"{root}/{r.name}")
            fs.delete(gone, True)
    return known


def candidates(spark: SparkSession, path: str, keys: DataFrame, known: list[Run]) -> list[str]:
    """The index files that may hold one of the keys (column key), as folders."""
    root, filled = folder(path), [r for r in known if r.n]
    if not filled:
        return []
    # so many pieces of the hash range that neither a filter's slice nor the keys of a piece are large
    most = max(*(r.bits for r in filled), math.ceil(math.log2(max(1, keys.count()) / KEYS_PER_FILE)), 0)
    parts = []
    for r in filled:
        finer = most - r.bits
        f = spark.read.schema(FILTERS).parquet(f"{root}/{r.name}/filters").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((1 << finer) - 1).cast("long"))))
        first = F.shiftright(F.shiftleft("k", r.blocks), finer)
        f = f.select(F.lit(r.name).alias("run"), F.lit(r.bits).alias("bits"), F.lit(r.blocks).alias("blocks"), "part", F.shiftleft("part", finer).bitwiseOR(F.col("k")).alias("piece"), first.alias("first"), "filter")
        parts.append(f.select("run", "bits", "blocks", "part", "piece", "first", F.substring("filter", (F.col("first") * BLOCK + 1).cast("int"), F.lit(BLOCK * max(1, (1 << r.blocks) >> finer))).alias("filter")))
    filters = parts[0]
    for f in parts[1:]:
        filters = filters.union(f)
    asked = keys.select(_hash("key").alias("h")).withColumn("piece", _top(F.col("h"), most))

    def test(hashes: pa.Table, some: pa.Table) -> pa.Table:
        out = []
        if hashes.num_rows:
            h = hashes.column("h").to_numpy().view(U)
            out = [(r["run"], r["part"]) for r in some.to_pylist() if may_hold(r["filter"], r["first"], h, r["bits"], r["blocks"]).any()]
        return pa.table({"run": pa.array([x[0] for x in out], pa.string()), "part": pa.array([x[1] for x in out], pa.int64())})

    hit = asked.groupBy("piece").cogroup(filters.groupBy("piece")).applyInArrow(test, "run string, part long").distinct()
    return sorted(f"{root}/{r['run']}/keys/part={r['part']}" for r in hit.collect())  # at most a name for each index file


def where(keys: DataFrame, path: str, key: str, files: DataFrame | None = None, keys_per_file: int = KEYS_PER_FILE, most_runs: int = MOST_RUNS) -> DataFrame:
    """(key, file) of those keys (one column) that the store at path holds, by the index, which is brought up to date."""
    spark = keys.sparkSession
    files = (store_files(spark, path) if files is None else files).persist()
    try:
        known = refresh(spark, path, key, files, keys_per_file, most_runs)
        asked = keys.select(F.col(key).cast("string").alias("key")).filter("key is not null").distinct()
        folders = candidates(spark, path, asked, known)
        if not folders:
            return keys.select(key).limit(0).withColumn("file", F.lit(None).cast("string"))
        found = spark.read.schema(KEYS).parquet(*folders).join(asked, "key", "left_semi")
        found = found.join(files.select("file"), "file", "left_semi").select(F.col("key").cast(keys.schema[key].dataType).alias(key), "file")
        return found.distinct()
    finally:
        files.unpersist()

"""Incremental ingestion: tailed lines to stored events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import extract, store
from ..schema import conform
from ..sources.tail import SPLIT, JsonlTail

#: Tables of what files hand on from which one of all files is written.
COMPACT = 20
HANDED = "file string, model string, turns long, batch long"


def as_lines(tailed: DataFrame) -> DataFrame:
    """Rows of the tailing source in the shape of sources.lines; a line's place does not hang on the batches it came in."""
    return tailed.select("file", "modified", F.floor(F.col("offset") / SPLIT).alias("block"), F.col("offset").alias("seq"), "line")


class Handed:
    """What files hand on from batch to batch, as a table for each batch in a folder.

    A batch reads the tables of those before it and writes its own, so that one that runs again finds what it
    found the first time.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def batches(self) -> dict[str, list[int]]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        root = hadoop.Path(self.folder)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found: dict[str, list[int]] = {"part": [], "whole": []}
        for s in fs.listStatus(root) if fs.exists(root) else []:
            kind, _, n = s.getPath().getName().partition("-")
            if kind in found and fs.exists(hadoop.Path(f"{s.getPath().toString()}/_SUCCESS")):
                found[kind].append(int(n))
        return found

    def before(self, batch_id: int) -> DataFrame:
        """file, model, turns as of the batches before this one."""
        found = self.batches()
        first = max((n for n in found["whole"] if n < batch_id), default=-1)
        names = [f"whole-{first}"] * (first >= 0) + [f"part-{n}" for n in sorted(found["part"]) if first <= n < batch_id]
        if not names:
            return self.spark.createDataFrame([], HANDED).drop("batch")
        rows = self.spark.read.schema(HANDED).parquet(*[f"{self.folder}/{n}" for n in names])
        return rows.groupBy("file").agg(F.max_by(F.struct("model", "turns"), "batch").alias("x")).select("file", "x.*")

    def write(self, batch_id: int, after: DataFrame) -> None:
        after.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{self.folder}/part-{batch_id}")
        found = self.batches()
        first = max((n for n in found["whole"] if n < batch_id), default=-1)
        if len([n for n in found["part"] if n >= first]) > COMPACT:
            # of all files as this batch found them; it still reads the tables before, which go with the next one
            self.before(batch_id).withColumn("batch", F.lit(batch_id - 1).cast("long")).write.mode("overwrite").parquet(f"{self.folder}/whole-{batch_id}")
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        for kind in ("part", "whole"):
            for n in found[kind]:
                if n < first:
                    old = hadoop.Path(f"{self.folder}/{kind}-{n}")
                    old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)


def sink(path: str, to_events: Callable[[DataFrame], DataFrame], partition_by: tuple[str, ...] = ("origin", "local_date"), replace: bool = False) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: extract events and append those whose id is new, or with replace put them in the place of stored ones.

    A batch that runs again after a failure finds its ids stored and adds nothing, so that at-least-once
    delivery gives each event once. Late events are always taken.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        put(to_events(as_lines(batch)), path, partition_by, replace)

    return write


def put(events: DataFrame, path: str, partition_by: tuple[str, ...] = ("origin", "local_date"), replace: bool = False) -> dict[str, int]:
    """Store events; says how many were inserted (and replaced), and how many were there."""
    events = events.withColumn("ingested_at", F.current_timestamp())
    if "local_date" not in events.columns:
        events = events.withColumn("local_date", F.to_date("occurred_at"))
    if replace:
        return store.insert_or_replace(conform(events), path, "event_id", ["ingested_at", "total_tokens"], list(partition_by))
    return store.insert_new(conform(events), path, "event_id", ["occurred_at_raw", "source_fingerprint", "total_tokens"], list(partition_by))


def turn_sink(path: str, handed: Handed, **options) -> Callable[[DataFrame, int], None]:
    """The same for format B, whose lines need the model and the turns of those before them in their file.

    A file whose first byte comes (again) begins anew.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        lines = as_lines(batch).persist()
        try:
            begun = lines.filter("seq = 0").select("file").distinct()
            before = handed.before(batch_id).join(begun, "file", "left_anti").join(lines.select("file").distinct(), "file", "left_semi").persist()
            put(extract.turn_deltas(lines, before=before, **options), path)
            handed.write(batch_id, extract.turn_state(lines, before))
            before.unpersist()
        finally:
            lines.unpersist()

    return write


def ingest(spark: SparkSession, root: str, path: str, checkpoint: str, kind: str = "message_usage", glob: str = "*.jsonl", max_files: int | None = None, split: int = SPLIT, **options) -> StreamingQuery:
    """Take all bytes appended since the last run, then stop; meant to be run again on a schedule.

    All four formats can be tailed, and give the events of a whole read however their files are cut: lines
    of formats A and D stand for themselves; of B what a file hands on is kept beside the checkpoint; of C the
    last total that came replaces the one before.

    :param max_files: files of a run; the others come in the next ones, see :func:`catch_up`.
    """
    spark.dataSource.register(JsonlTail)
    reader = spark.readStream.format("jsonl_tail").option("glob", glob).option("state", f"{checkpoint.rstrip('/')}-tail").option("split", split)
    stream = (reader.option("maxFiles", max_files) if max_files else reader).load(root)
    if kind == "turn_deltas":
        write = turn_sink(path, Handed(spark, f"{checkpoint.rstrip('/')}-handed"), **options)
    else:
        write = sink(path, lambda lines: extract.extract(lines, kind, **options), replace=kind == "cumulative_final")
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def catch_up(spark: SparkSession, *args, **options) -> int:
    """Run :func:`ingest` until nothing is left to take; the number of batches that had lines."""
    batches = 0
    while True:
        query = ingest(spark, *args, **options)
        query.awaitTermination()
        if not any(p["numInputRows"] for p in query.recentProgress):
            return batches
        batches += 1


def reread(spark: SparkSession, root: str, path: str, kind: str, glob: str, since: str | None = None, replace: bool = False, partition_by: tuple[str, ...] = ("origin", "local_date"), **options) -> dict[str, int]:
    """Read changed files whole; ids make it idempotent.

    The store is partitioned as :func:`sink` writes it, so that both may fill one. With replace a newer event
    takes the place of a stored one of the same id (a file's final total); says how many did as ``replaced``.
    """
    from ..sources.lines import read_lines

    events = extract.extract(read_lines(spark, root, glob, since), kind, **options).withColumn("local_date", F.to_date("occurred_at"))
    return put(events, path, partition_by, replace)

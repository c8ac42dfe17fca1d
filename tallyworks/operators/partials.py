"""Totals that follow a store: partial sums of each of its files, added up when they are asked for.

The files of a store do not change: inserts add some, replacements and deletions put others in their place. So
the totals are those of the files that are there, and a refresh reads only files that came since. It takes
nothing back for rows that were replaced or deleted: their files are gone, and count no more. Nothing has to
be written in one step with the store, and files of any writer count.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .keyindex import _path, store_files

#: Runs of partial sums from which they become one.
MOST_RUNS = 12


class Totals:
    """Sums and row counts by keys over the rows of a store that fit a condition.

    :param folder: where the partial sums lie; one for each store, keys, sums and condition.
    """

    def __init__(self, spark: SparkSession, path: str, folder: str, keys: list[str], sums: list[str], where: Column | None = None):
        self.spark, self.path, self.folder, self.keys, self.sums = spark, path, folder.rstrip("/"), keys, sums
        self.where = F.lit(True) if where is None else where

    def runs(self) -> list[str]:
        fs, root = _path(self.spark, self.folder)
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(n for n in names if fs.exists(_path(self.spark, f"{self.folder}/{n}/files/_SUCCESS")[1]))

    def _write(self, rows: DataFrame, files: DataFrame) -> str:
        """A run, which counts once its files are told."""
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.folder}/{name}/rows")
        files.select("file", "modified").write.parquet(f"{self.folder}/{name}/files")
        return name

    def _covered(self, runs: list[str]) -> DataFrame:
        """file, modified and the run that speaks for it: one, if several do."""
        each = [self.spark.read.parquet(f"{self.folder}/{n}/files").withColumn("run", F.lit(n)) for n in runs]
        out = each[0]
        for x in each[1:]:
            out = out.union(x)
        return out.groupBy("file", "modified").agg(F.min("run").alias("run"))

    def _rows(self, runs: list[str]) -> DataFrame:
        each = [self.spark.read.parquet(f"{self.folder}/{n}/rows").withColumn("run", F.lit(n)) for n in runs]
        out = each[0]
        for x in each[1:]:
            out = out.union(x)
        return out

    def refresh(self) -> int:
        """Sum the files that came since the last refresh; how many they are."""
        files, runs = store_files(self.spark, self.path).persist(), self.runs()
        try:
            new = (files.join(self._covered(runs), ["file", "modified"], "left_anti") if runs else files).persist()
            paths = [r["path"] for r in new.select("path").collect()]  # a name for each file that came since
            if paths:
                rows = self.spark.read.option("basePath", self.path).parquet(*paths).filter(self.where)
                sums = [F.sum(c).alias(c) for c in self.sums]
                by_file = rows.groupBy(F.col("_metadata.file_path").alias("file"), *self.keys).agg(*sums, F.count("*").alias("rows"))
                runs = sorted([*runs, self._write(by_file, new)])
            new.unpersist()
            if len(runs) > MOST_RUNS:
                live = self._covered(runs).join(files.select("file", "modified"), ["file", "modified"], "left_semi")
                self._write(self._rows(runs).join(live.select("file", "run"), ["file", "run"]).drop("run"), live)
                for n in runs:
                    fs, gone = _path(self.spark, f"{self.folder}/{n}")
                    fs.delete(gone, True)
            return len(paths)
        finally:
            files.unpersist()

    def current(self) -> DataFrame:
        """The totals by keys as of now, with ``rows``, the number of rows."""
        self.refresh()
        runs = self.runs()
        if not runs:
            return self.spark.read.parquet(self.path).limit(0).groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in self.sums], F.count("*").alias("rows"))
        live = self._covered(runs).join(store_files(self.spark, self.path).select("file", "modified"), ["file", "modified"], "left_semi")
        rows = self._rows(runs).join(live.select("file", "run"), ["file", "run"])
        return rows.groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in [*self.sums, "rows"]])

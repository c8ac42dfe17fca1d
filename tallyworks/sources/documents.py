"""Whole JSON documents: snapshots, registries and histories that may be absent or broken, and what members have landed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_text, clean_texts
from ..functions.values import count_or_zero
from ..operators.store import exists, latest_of_each

DOCUMENTS = "file string, modified timestamp, document string"


def read_documents(spark: SparkSession, path: str, name: str = "*.json") -> DataFrame:
    """Files below path as whole documents: file, modified, document. No rows where there is no such place.

    document is null for a file that holds no JSON object or array: an absent and a broken document are alike
    to those who read on.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], DOCUMENTS)
    meta = F.col("_metadata")
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).text(path)
    whole = F.when(F.col("value").rlike(r"^\s*[\[{]") & F.try_parse_json("value").isNotNull(), F.col("value"))
    return files.select(meta["file_path"].alias("file"), meta["file_modification_time"].alias("modified"), whole.alias("document"))


def failed_sources(runs: DataFrame) -> DataFrame:
    """Warnings of aggregate sources (source, document, status, timed_out, limit_ms) that gave nothing: source, warning.

    Reasons are tried in order: stopped after its limit, ended with another status than 0, no JSON.
    """
    broken = F.coalesce(F.try_parse_json("document").isNull(), F.lit(True))
    why = (
        F.when(F.col("timed_out"), F.concat(F.lit(" timed out after "), F.col("limit_ms").cast("string"), F.lit("ms")))
        .when(F.col("status").isNull(), " failed")
        .when(F.col("status") != 0, F.concat(F.lit(" exited "), F.col("status").cast("string")))
        .when(broken, " did not return parseable JSON")
    )
    return runs.select("source", F.concat("source", why).alias("warning")).filter("warning is not null")


def texts(x: Column) -> Column:
    """A JSON array of texts as an array; empty for null and for what is none."""
    return F.coalesce(F.from_json(x, "array<string>"), F.array().cast("array<string>"))


def member_profiles(members: DataFrame, landed: DataFrame) -> DataFrame:
    """Each member (handle, ...) with the profile of their landed snapshot (handle, status, document).

    A failure stays with its row: state is unreachable, with the reason in error, for a member whose snapshot
    did not land, landed with another status than 200, or is no JSON object; other members are not touched.
    Of several landed for one handle the last by ``landed_at`` counts.
    """
    last = latest_of_each(landed, ["handle"], ["landed_at"]).select("handle", "status", "document", F.lit(True).alias("_landed"))
    j = members.join(last, "handle", "left")
    whole = F.json_object_keys("document").isNotNull()
    error = F.when(F.col("_landed").isNull(), "not fetched").when(F.col("status") != 200, F.concat(F.lit("HTTP "), F.col("status").cast("string"))).when(~F.coalesce(whole, F.lit(False)), "no JSON object")
    at = lambda p: F.when(error.isNull(), F.get_json_object("document", f"$.{p}"))
    number = lambda p: F.when(error.isNull(), count_or_zero(at(p).try_cast("double")))
    some = lambda p, n, m: clean_texts(texts(at(p)), n, m)
    return j.select(
        *members.columns,
        F.when(error.isNotNull(), "unreachable").otherwise("landed").alias("state"),
        error.alias("error"),
        clean_text(at("generatedAt"), 40).alias("generated_at"),
        number("profile.activity.activeDays").alias("active_days"),
        number("totals.totalTokens").alias("total_tokens"),
        some("profile.activity.toolsUsed", 8, 40).alias("tools"),
        some("profile.activity.modelsUsed", 24, 80).alias("models"),
        some("profile.identity.workCategories", 10, 40).alias("work_categories"),
        some("profile.identity.openTo", 10, 40).alias("open_to"),
    )


def replace_latest(df: DataFrame, path: str) -> None:
    """Make df the latest snapshot: written beside it first, and put in its place by renames."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fresh, old = hadoop.Path(f"{path.rstrip('/')}.next"), hadoop.Path(f"{path.rstrip('/')}.old")
    df.write.mode("overwrite").parquet(str(fresh))
    fs.delete(old, True)
    if fs.exists(hadoop.Path(path)):
        fs.rename(hadoop.Path(path), old)
    fs.rename(fresh, hadoop.Path(path))
    fs.delete(old, True)


def append_history(df: DataFrame, path: str, order: list[str]) -> int:
    """Append snapshots (a few at a time) to a history, with index counting on from the last; returns how many there are then."""
    from pyspark.sql import Window

    spark = df.sparkSession
    n = (spark.read.parquet(path).agg(F.max("index")).first()[0] + 1 if exists(spark, path) else 0) or 0
    # what one upload brings: numbered in one task
    fresh = df.withColumn("index", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) + F.lit(n - 1)).cast("long"))
    fresh.write.mode("append").parquet(path)
    return spark.read.parquet(path).count()


def history(spark: SparkSession, path: str, most: int = 500) -> DataFrame | None:
    """The stored snapshots by index, the first ``most``; None where none was ever stored."""
    return spark.read.parquet(path).orderBy("index").limit(most) if exists(spark, path) else None

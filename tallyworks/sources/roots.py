"""Scan roots that need not be scanned again: signatures of what lies below them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGNATURES = "root string, signature string"


def signatures(files: DataFrame, roots: DataFrame) -> DataFrame:
    """root, signature of each root: over the names, sizes and times of its files (root, file, modified, size), in any order.

    A root without files has the signature "0:0", so that a search that found nothing is remembered too.
    """
    h = F.xxhash64("file", "modified", "size").cast("decimal(38,0)")
    found = files.groupBy("root").agg(F.count("*").alias("n"), F.sum(h).alias("s"))
    signature = F.concat_ws(":", F.coalesce("n", F.lit(0)).cast("string"), F.coalesce("s", F.lit(0)).cast("string"))
    return roots.select("root").distinct().join(found, "root", "left").select("root", signature.alias("signature"))


def changes(now: DataFrame, before: DataFrame, force: bool = False) -> DataFrame:
    """root, signature and state: new, changed, unchanged, or gone; with force nothing counts as unchanged."""
    b = before.select("root", F.col("signature").alias("old"))
    same = F.lit(not force) & (F.col("signature") == F.col("old"))
    state = F.when(F.col("signature").isNull(), "gone").when(F.col("old").isNull(), "new").when(same, "unchanged").otherwise("changed")
    return now.join(b, "root", "full_outer").select("root", "signature", state.alias("state"))


def reused(results: DataFrame, states: DataFrame) -> DataFrame:
    """Of stored results (root, ...) those of unchanged roots: only the other roots are scanned."""
    return results.join(states.filter("state = 'unchanged'").select("root"), "root", "left_semi")

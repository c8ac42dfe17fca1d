"""Daily rows from several sources: duplicates are reconciled, never summed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def keep_max(rows: DataFrame, ord_: str = "ord", join_models: bool = True, most_models: int = 8) -> DataFrame:
    """One row for each (date, provider): that of the largest total, the first by ``ord_`` of equal ones.

    Models are joined over all rows of the key (within a source), or the kept row's own (across sources).
    """
    others = [c for c in rows.columns if c not in ("date", "provider", "models", ord_)]
    best = F.max_by(F.struct(*others, "models"), F.struct(F.col("total_tokens"), -F.col(ord_))).alias("best")
    g = rows.groupBy("date", "provider").agg(best, F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(ord_).alias("o"), "models"))), lambda x: x["models"]))).alias("all_models"), (F.count("*") - 1).alias("duplicates"))
    models = F.slice("all_models", 1, most_models) if join_models else F.col("best.models")
    return g.select("date", "provider", *[F.col(f"best.{c}").alias(c) for c in others], models.alias("models"), "duplicates")


def sum_duplicates(rows: DataFrame) -> DataFrame:
    """What an older collector did: duplicate rows of a day are added up. Kept only to show the difference."""
    return rows.groupBy("date", "provider").agg(F.sum(F.coalesce("reported_total", "total_tokens")).alias("total_tokens"))


def warnings(rows: DataFrame, most: int = 12) -> DataFrame:
    """Distinct warnings, in order, at most ``most``: duplicate days and totals that disagree with their parts."""
    key = F.concat_ws(":", F.col("date").cast("string"), "provider")
    dup = rows.groupBy("date", "provider").agg(F.count("*").alias("n"), F.min("ord").alias("ord")).filter("n > 1").select("ord", F.concat(F.lit("duplicate-daily-row:"), key).alias("warning"))
    off = rows.filter("reported_total is not null").select("ord", F.concat(F.lit("reported-total-mismatch:"), key, F.lit(":reported="), F.col("reported_total").cast("string"), F.lit(":derived="), F.col("total_tokens").cast("string")).alias("warning"))
    return dup.union(off).groupBy("warning").agg(F.min("ord").alias("ord")).orderBy("ord", "warning").limit(most)


def fill_absent(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """primary, and of secondary the rows of providers that primary has none of."""
    missing = secondary.join(primary.select("provider").distinct(), "provider", "left_anti")
    return primary.unionByName(missing, allowMissingColumns=True)


def with_models(daily: DataFrame, models: DataFrame, most: int = 8) -> DataFrame:
    """Each row with all models that point to its provider, whatever the day."""
    by = models.select(text.provider_of_model(F.col("model")).alias("provider"), "model").groupBy("provider").agg(F.slice(F.array_sort(F.collect_set("model")), 1, most).alias("models"))
    return daily.join(by, "provider", "left").withColumn("models", F.coalesce("models", F.array().cast("array<string>")))


def with_derived(rows: DataFrame) -> DataFrame:
    """cached, fresh and total tokens from their parts."""
    rows = rows.withColumns({"cached_tokens": F.col("cache_creation_tokens") + F.col("cache_read_tokens"), "fresh_tokens": F.col("input_tokens") + F.col("output_tokens")})
    return rows.withColumn("total_tokens", F.col("cached_tokens") + F.col("fresh_tokens"))


def overlay(base: DataFrame, over: DataFrame, key: str) -> DataFrame:
    """Rows of both by key; where both have one, that of ``over`` whole."""
    shared = [c for c in over.columns if c != key]
    a, b = base.select(key, F.struct(*shared).alias("_a")), over.select(key, F.struct(*shared).alias("_b"))
    return a.join(b, key, "full_outer").select(key, F.coalesce("_b", "_a").alias("_x")).select(key, "_x.*")


def in_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy("date", "provider")


def confidence_note(provider: Column) -> Column:
    """high or medium, by how a provider's rows are measured."""
    return F.when(provider.isin("claude", "grok", "kimi"), "high").otherwise("medium")


def source_of_truth(has_events: bool, has_aggregates: bool) -> str:
    return {(True, True): "mixed", (True, False): "event_store", (False, True): "aggregates"}.get((has_events, has_aggregates), "none")

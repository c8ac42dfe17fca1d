"""Totals of events by day, provider, model, session and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import COUNTS

UNNAMED = "(unattributed)"


def measured(events: DataFrame) -> DataFrame:
    """Events of local logs; imported ones never share a total with them."""
    return events.filter(F.col("origin") == "local_log") if "origin" in events.columns else events


def no_session(session: str = "session_pseudonym") -> Column:
    return F.nullif(F.col(session), F.lit("")).isNull()


def day_of(events: DataFrame) -> Column:
    """The local date, else the UTC date of the time."""
    utc = F.to_date("occurred_at")
    return F.coalesce("local_date", utc) if "local_date" in events.columns else utc


def sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in COUNTS]


def daily_totals(events: DataFrame) -> DataFrame:
    """Sums and number of events by day and provider."""
    return measured(events).groupBy(day_of(events).alias("date"), "provider").agg(*sums(), F.count("*").alias("events"))


def daily_utc(events: DataFrame) -> DataFrame:
    """The same by UTC day, with the models of each day and provider."""
    return events.groupBy(F.to_date("occurred_at").alias("date"), "provider").agg(*sums(), F.count("*").alias("events"), F.array_sort(F.collect_set("model")).alias("models"))


def models_used(events: DataFrame) -> DataFrame:
    return measured(events).filter("model is not null").select("model").distinct().orderBy("model")


def event_count(events: DataFrame, origin: str | None = None) -> DataFrame:
    return (events.filter(F.col("origin") == origin) if origin else events).agg(F.count("*").alias("events"))


def session_scalars(events: DataFrame) -> DataFrame:
    """Events in all, without a session, and distinct sessions."""
    return measured(events).agg(F.count("*").alias("events"), F.count_if(no_session()).alias("without_session"), F.countDistinct(F.nullif(F.col("session_pseudonym"), F.lit(""))).alias("sessions"))


def hierarchy(events: DataFrame) -> DataFrame:
    """By (provider, model) and, in the same pass, by provider (level 'provider'); unnamed models share one label.

    A provider's sessions are counted anew: a session may use several models.
    """
    e = measured(events).select("provider", F.coalesce(F.nullif(F.col("model"), F.lit("")), F.lit(UNNAMED)).alias("model"), "total_tokens", F.nullif(F.col("session_pseudonym"), F.lit("")).alias("session"))
    g = e.groupingSets([[F.col("provider"), F.col("model")], [F.col("provider")]], F.col("provider"), F.col("model"))
    return g.agg(F.when(F.grouping("model") == 0, "model").otherwise("provider").alias("level"), F.count("*").alias("events"), F.countDistinct("session").alias("sessions"), F.sum("total_tokens").alias("total_tokens")).select("level", "provider", "model", "events", "sessions", "total_tokens")


def top_models(levels: DataFrame, models: int = 24, providers: int = 8) -> DataFrame:
    """Of hierarchy(): the models with most events of the providers with most; providers' sums hold all models."""
    per = levels.filter("level = 'provider'").select("provider", F.col("events").alias("provider_events"), F.col("sessions").alias("provider_sessions"), F.col("total_tokens").alias("provider_tokens"))
    first = per.orderBy(F.desc("provider_events"), "provider").limit(providers)
    by = Window.partitionBy("provider").orderBy(F.desc("events"), "model")
    best = levels.filter("level = 'model'").withColumn("place", F.row_number().over(by)).filter(F.col("place") <= models)
    return best.join(F.broadcast(first), "provider").select("provider", "provider_events", "provider_sessions", "provider_tokens", "model", "place", "events", "sessions", "total_tokens")  # at most ``providers`` rows


def nested(top: DataFrame) -> DataFrame:
    """top_models() with a provider's models as one ordered array."""
    row = F.struct("place", "model", "events", "sessions", "total_tokens")
    return top.groupBy("provider", "provider_events", "provider_sessions", "provider_tokens").agg(F.array_sort(F.collect_list(row)).alias("models"))  # at most ``models`` each


def session_sizes(events: DataFrame) -> DataFrame:
    return measured(events).filter(~no_session()).groupBy("session_pseudonym").agg(F.count("*").alias("events"))


def size_statistics(sizes: DataFrame) -> DataFrame:
    """Sessions, median (the rounded mean of the middle two), 95th percentile by nearest rank, and the largest."""
    return sizes.agg(F.count("*").alias("sessions"), F.floor(F.percentile("events", 0.5) + 0.5).alias("median_events"), F.expr("percentile_disc(0.95) within group (order by events)").cast("long").alias("p95_events"), F.max("events").alias("largest"))


def imported_sources(events: DataFrame, most_models: int = 24) -> DataFrame:
    """Imported data by source, adapter, class and confidence; models by source alone; largest first."""
    e = events.filter("origin = 'imported'")
    models = e.filter("model is not null").groupBy("source_label").agg(F.slice(F.array_sort(F.collect_set("model")), 1, most_models).alias("models"))
    rows = e.groupBy("source_label", "adapter", "measurement_class", "confidence").agg(F.count("*").alias("events"), *sums(), F.min(day_of(e)).alias("first_date"), F.max(day_of(e)).alias("last_date"))
    return rows.join(models, "source_label", "left").orderBy(F.desc("total_tokens"), "source_label", "adapter")


def provider_summary(daily: DataFrame) -> DataFrame:
    """Sums by provider and, in the row with a null provider, over all; cost is null only if all are."""
    counts = [c for c in ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens") if c in daily.columns]
    out = daily.rollup("provider").agg(F.grouping("provider").alias("overall"), *[F.sum(c).alias(c) for c in counts], F.sum("estimated_cost_usd").alias("estimated_cost_usd"))
    out = out.withColumn("cached_tokens", F.col("cache_creation_tokens") + F.col("cache_read_tokens")).withColumn("fresh_tokens", F.col("input_tokens") + F.col("output_tokens"))
    return out.withColumn("total_tokens", F.col("cached_tokens") + F.col("fresh_tokens"))


def provider_models(daily: DataFrame, most: int = 10) -> DataFrame:
    return daily.select("provider", F.explode("models").alias("model")).groupBy("provider").agg(F.slice(F.array_sort(F.collect_set("model")), 1, most).alias("models"))


def daily_pivot(daily: DataFrame, providers: list[str]) -> DataFrame:
    """By date: totals, and one column for the tokens of each provider."""
    ones = [F.coalesce(F.sum(F.when(F.col("provider") == p, F.col("total_tokens"))), F.lit(0)).alias(p) for p in providers]
    return daily.filter("date is not null").groupBy("date").agg(*[F.sum(c).alias(c) for c in ("total_tokens", "fresh_tokens", "cached_tokens")], *ones)


def last_days(daily: DataFrame, n: int) -> DataFrame:
    """The n latest rows by date, oldest first."""
    return daily.orderBy(F.desc("date")).limit(n).orderBy("date")


def largest_day(daily: DataFrame) -> DataFrame:
    """Date and total of the largest day, the first of equal ones."""
    d = daily.groupBy("date").agg(F.sum("total_tokens").alias("total_tokens"))
    return d.agg(F.max_by(F.struct("date", "total_tokens"), F.struct(F.col("total_tokens"), -F.unix_date("date"))).alias("x")).select("x.*")


def relative_shares(daily: DataFrame) -> DataFrame:
    """Each row's total as a share of the largest (at least 1)."""
    most = daily.agg(F.greatest(F.max("total_tokens"), F.lit(1)).alias("most"))
    return daily.crossJoin(F.broadcast(most)).withColumn("share", F.col("total_tokens") / F.col("most")).drop("most")  # one row


def count_by(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias(name))


# File endings whose kind has another name, and those that are kinds themselves.
KINDS = {"md": "docs"} | {x: x for x in ("ts", "tsx", "js", "jsx", "py", "json", "css", "html", "sol", "rs", "go", "sql")}


def files_by_kind(files: DataFrame, kinds: dict[str, str] | None = None) -> DataFrame:
    """Number of files and latest change by kind of file; endings without a kind have null."""
    names = F.create_map(*[F.lit(x) for kv in (KINDS if kinds is None else kinds).items() for x in kv])
    ending = F.lower(F.regexp_extract("file", r"\.([A-Za-z0-9]+)$", 1))
    return files.groupBy(F.try_element_at(names, ending).alias("kind")).agg(F.count("*").alias("files"), F.max("modified").alias("latest"))


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key in order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def project_totals(projects: DataFrame) -> DataFrame:
    """Found projects, changed files, and files over all kinds (a map kind -> files)."""
    files = F.aggregate(F.map_values("kinds"), F.lit(0).cast("long"), lambda a, x: a + x)
    return projects.agg(F.count_if("found").alias("found"), F.sum("changed_files").alias("changed_files"), F.sum(files).alias("files"))

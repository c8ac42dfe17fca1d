"""Activity derived from daily rows and events: streaks, windows, gaps, grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values
from . import scan


def active_days(daily: DataFrame) -> DataFrame:
    """Distinct dates with usage, over all providers."""
    return daily.filter("total_tokens > 0").select("date").distinct()


def runs(days: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Runs of consecutive dates: keys, first, last, length."""
    keys = keys or []
    by = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("date")
    start = F.date_sub("date", F.row_number().over(by).cast("int"))
    return days.withColumn("_run", start).groupBy(*keys, "_run").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").cast("int").alias("length")).drop("_run")


def longest_streak(days: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return runs(days, keys).groupBy(*(keys or [])).agg(F.coalesce(F.max("length"), F.lit(0)).alias("longest_streak"))


def current_streak(days: DataFrame, reference: Column, keys: list[str] | None = None) -> DataFrame:
    """Length of the run that holds the last date; 0 if that is more than a day before the reference.

    A last date after the reference counts too (integrity checks flag it).
    """
    last = runs(days, keys).groupBy(*(keys or [])).agg(F.max("last").alias("last"), F.max_by("length", "last").alias("length"))
    return last.select(*(keys or []), F.when(F.datediff(reference, "last") <= 1, F.col("length")).otherwise(0).alias("current_streak"))


def within(date: Column, reference: Column, days: int) -> Column:
    """Whether a date is one of the ``days`` dates up to the reference."""
    return F.datediff(reference, date).between(0, days - 1)


def activity(daily: DataFrame, reference: str) -> DataFrame:
    """First and last active date, span, and active days in all and of the last 30 and 90."""
    ref, d = F.to_date(F.lit(reference)), active_days(daily)
    return d.agg(F.count("*").alias("active_days"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.coalesce(F.datediff(F.max("date"), F.min("date")) + 1, F.lit(0)).alias("span_days"), F.count_if(within(F.col("date"), ref, 30)).alias("last_30"), F.count_if(within(F.col("date"), ref, 90)).alias("last_90"))


def efficiency(daily: DataFrame) -> DataFrame:
    """Shares of cached, fresh and output tokens in per cent, and the mean of an active day."""
    s = daily.agg(*[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cached_tokens", "fresh_tokens", "total_tokens")], F.countDistinct(F.when(F.col("total_tokens") > 0, F.col("date"))).alias("days"))
    return s.select(values.share(F.col("cached_tokens"), F.col("total_tokens")).alias("cached_share"), values.share(F.col("fresh_tokens"), F.col("total_tokens")).alias("fresh_share"), values.share(F.col("output_tokens"), F.col("input_tokens") + F.col("output_tokens")).alias("output_share"), F.when(F.col("days") > 0, values.js_round(F.col("total_tokens") / F.col("days"))).alias("per_active_day"))


def gaps(events: DataFrame, most_seconds: int = 3600, most: int = scan.MOST) -> DataFrame:
    """Rounded seconds between neighbouring events of a session, from 0 to the limit.

    :param most: sessions of more events are read in parts, so that none is one task.
    """
    key = ["session_pseudonym"]
    e = events.filter("session_pseudonym <> ''").select(*key, "occurred_at")
    small, large = scan.by_size(e, key, most)
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    e = small.withColumn("before", F.lag("occurred_at").over(Window.partitionBy(*key).orderBy("occurred_at")))
    if large is not None:
        e = e.unionByName(scan.previous(scan.in_parts(large, key, ["occurred_at"]), key, "occurred_at", "before").select(e.columns))
    return e.filter("before is not null").select(*key, values.js_round((at("occurred_at") - at("before")) / 1e6).alias("gap")).filter(F.col("gap").between(0, most_seconds))


def gap_median(events: DataFrame) -> DataFrame:
    return gaps(events).agg(F.count("*").alias("gaps"), F.floor(F.percentile("gap", 0.5) + 0.5).alias("median_gap"))


def sample_sessions(events: DataFrame, sessions: int = 12, each: int = 400) -> DataFrame:
    """The first ``each`` events of the ``sessions`` largest sessions (equal sizes by name)."""
    largest = events.filter("session_pseudonym <> ''").groupBy("session_pseudonym").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "session_pseudonym").limit(sessions)
    by = Window.partitionBy("session_pseudonym").orderBy("occurred_at", "event_id")
    return events.join(F.broadcast(largest.select("session_pseudonym")), "session_pseudonym", "left_semi").withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= each).drop("_n")  # at most ``sessions`` rows


def heatmap(daily: DataFrame, reference: str, weeks: int = 26) -> DataFrame:
    """A grid of weeks that ends on the Saturday on or after the reference: date, tokens, level.

    Level -1 lies after the reference, 0 has no usage, 1 to 4 by the share of the largest day of all time.
    """
    ref = F.to_date(F.lit(reference))
    end = F.date_add(ref, 7 - F.dayofweek(ref))
    days = daily.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(end, weeks * 7 - 1), end)).alias("date"))
    totals = daily.groupBy("date").agg(F.sum("total_tokens").alias("tokens"))
    most = totals.agg(F.greatest(F.max("tokens"), F.lit(1)).alias("most"))
    g = days.join(totals, "date", "left").crossJoin(F.broadcast(most)).withColumn("tokens", F.coalesce("tokens", F.lit(0)))  # one row
    ratio = F.col("tokens") / F.coalesce("most", F.lit(1))
    level = F.when(F.col("date") > ref, -1).when(F.col("tokens") == 0, 0).when(ratio > 0.6, 4).when(ratio > 0.3, 3).when(ratio > 0.1, 2).otherwise(1)
    return g.select("date", "tokens", level.alias("level"))


def presence_strip(days: DataFrame, reference: str, length: int, width: int) -> DataFrame:
    """The last ``length`` days in min(length, width / 2) buckets: bucket, active."""
    cols = max(1, min(length, width // 2))
    ref = F.to_date(F.lit(reference))
    hit = days.filter(within(F.col("date"), ref, length)).select(F.floor((length - 1 - F.datediff(ref, "date")) * cols / length).cast("int").alias("bucket")).distinct().withColumn("active", F.lit(True))
    return days.sparkSession.range(cols).select(F.col("id").cast("int").alias("bucket")).join(hit, "bucket", "left").na.fill({"active": False})


def carry_forward(df: DataFrame, keys: list[str], order: list[str], column: str, most: int = scan.MOST) -> DataFrame:
    """The column with nulls replaced by the last value before them.

    :param most: keys of more rows are read in parts, so that none is one task.
    """
    small, large = scan.by_size(df, keys, most)
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = small.withColumn(column, F.last(column, ignorenulls=True).over(w))
    if large is None:
        return out
    rows = scan.last_known(scan.in_parts(large, keys, order), keys, column, "_filled")
    return out.unionByName(rows.select(*[F.col("_filled").alias(c) if c == column else F.col(f"`{c}`") for c in df.columns]))


def last_of_each(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: of running totals, the final one."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_x")).select(*keys, "_x.*")


# Windows after a change, in days.
WINDOWS = {"24h": 1, "7d": 7, "30d": 30, "90d": 90}


def durability(snapshots: DataFrame) -> DataFrame:
    """Line counts of projects and windows with their length in days and the share that remains, in per cent."""
    dims = snapshots.sparkSession.createDataFrame(list(WINDOWS.items()), "window string, days int")
    whole = [c for c in snapshots.columns if c not in ("project", "window")]
    remaining = F.when((F.col("introduced_lines") > 0) & (F.col("remaining_lines") >= 0), values.js_round(values.clamped(F.col("remaining_lines") / F.col("introduced_lines") * 100, 0, 100) * 10) / 10)
    s = snapshots.withColumn("remaining_share", remaining).withColumns({c: F.greatest(F.lit(0).cast("long"), F.floor(c)) for c in whole})
    return s.join(F.broadcast(dims), "window")  # four rows


def live_drift(totals: DataFrame, now: Column, rates: dict[str, float], shares: dict[str, float] | None = None) -> DataFrame:
    """Totals projected to ``now`` at rates in tokens a second, for rows marked simulated; others stay.

    totals: anchor (timestamp), simulated, fresh_tokens, cached_tokens, total_tokens, and provider if
    shares give a provider's part of the growth.
    """
    seconds = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros("anchor")) / 1e6)
    part = F.lit(1.0)
    if shares:
        part = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in shares.items() for x in kv]), F.col("provider")), F.lit(0.0))
    grown = lambda rate: F.floor(F.floor(seconds * rate) * part) if shares else F.floor(seconds * rate)
    fresh, cached = grown(rates["fresh"]), grown(rates["cached"])
    add = lambda c, x: F.col(c) + F.when(F.col("simulated"), x).otherwise(0)
    both = F.floor((F.floor(seconds * rates["fresh"]) + F.floor(seconds * rates["cached"])) * part) if shares else fresh + cached
    return totals.withColumns({"fresh_tokens": add("fresh_tokens", fresh), "cached_tokens": add("cached_tokens", cached), "total_tokens": add("total_tokens", both)})


def history_series(daily: DataFrame) -> DataFrame:
    """The compact series: date, provider, total, cached and fresh tokens, in order."""
    return daily.select("date", "provider", "total_tokens", "cached_tokens", "fresh_tokens").orderBy("date", "provider")


def snapshot_series(snapshots: DataFrame, most: int = 500) -> DataFrame:
    """Totals of stored snapshots by index, missing ones as 0 (a missing cost stays null)."""
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return snapshots.orderBy("index").limit(most).select("index", "generated_at", *map(zero, ("total_tokens", "cached_tokens", "fresh_tokens")), "estimated_cost_usd")

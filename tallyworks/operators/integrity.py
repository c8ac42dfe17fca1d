"""Checks on daily series: plain tells, not proof of anything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

MOST_PER_DAY = 50_000_000_000
MOST_BACKFILLED = 5


def duplicates(daily: DataFrame) -> DataFrame:
    """How many rows repeat the (date, provider) of another."""
    return daily.groupBy("date", "provider").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def backfilled(daily: DataFrame, previous: DataFrame) -> DataFrame:
    """Rows older than the last published date whose (date, provider) was not published then."""
    last = previous.agg(F.max("date").alias("last"))
    return daily.join(F.broadcast(last), F.col("date") < F.col("last")).drop("last").join(previous.select("date", "provider").distinct(), ["date", "provider"], "left_anti")  # one row


def report(daily: DataFrame, reference: str, previous: DataFrame | None = None) -> DataFrame:
    """name, status (ok or flag) and number of findings for each check."""
    ref = F.to_date(F.lit(reference))
    total = F.col("total_tokens").cast("double")
    one = daily.agg(F.count_if(F.col("date") > ref).alias("future"), F.count_if(total > MOST_PER_DAY).alias("volume"), F.count_if((total < 0) | F.isnan(total) | (total == float("inf"))).alias("malformed"))
    unknown = daily.select(F.explode("models").alias("model")).distinct().agg(F.count_if(~text.known_family(F.col("model"))).alias("families"))
    wide = one.crossJoin(duplicates(daily)).crossJoin(unknown)  # one row each
    names = {"No future-dated activity": "future", "Plausible daily volume": "volume", "Well-formed totals": "malformed", "No duplicate day-rows": "duplicates", "Recognized model families": "families"}
    limits = dict.fromkeys(names, 0)
    if previous is not None:
        wide = wide.crossJoin(backfilled(daily, previous).agg(F.count("*").alias("backfilled")))
        names["No large retroactive backfill"] = "backfilled"
        limits["No large retroactive backfill"] = MOST_BACKFILLED
    rows = F.array(*[F.struct(F.lit(i + 1).alias("ord"), F.lit(k).alias("name"), F.col(c).cast("long").alias("findings"), F.lit(limits[k]).alias("limit")) for i, (k, c) in enumerate(names.items())])
    r = wide.select(F.inline(rows))
    return r.select("ord", "name", "findings", F.when(F.col("findings") > F.col("limit"), "flag").otherwise("ok").alias("status"))


def flags(checks: DataFrame) -> DataFrame:
    return checks.agg(F.count_if(F.col("status") == "flag").alias("flags"))


def first_failure(rules: list[tuple[str, Column]], ok: str = "OK") -> Column:
    """The code of the first rule whose condition holds: rules are tried in order."""
    out = None
    for code, failed in rules:
        failed = F.coalesce(failed, F.lit(False))
        out = F.when(failed, code) if out is None else out.when(failed, code)
    return F.lit(ok) if out is None else out.otherwise(ok)

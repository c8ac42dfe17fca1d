"""The canonical usage event, its enumerations, and schema versions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names that stored events use.
ORIGINS = ("local_log", "imported")
MEASUREMENT_CLASSES = ("provider_reported", "application_reported", "locally_derived", "user_submitted", "estimated", "unknown")
CONFIDENCES = ("high", "medium", "low")
EVENT_VERSION = "1.0.0"
COUNTS = ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "total_tokens")

EVENT = T.StructType(
    [T.StructField("event_id", T.StringType(), False), T.StructField("event_schema_version", T.StringType()), T.StructField("occurred_at", T.TimestampType()), T.StructField("occurred_at_raw", T.StringType()), T.StructField("ingested_at", T.TimestampType()), T.StructField("provider", T.StringType(), False), T.StructField("model", T.StringType())]
    + [T.StructField(c, T.LongType()) for c in COUNTS]
    + [T.StructField(c, T.StringType()) for c in ("measurement_class", "confidence", "session_pseudonym", "source_fingerprint", "adapter", "adapter_version")]
    + [T.StructField("local_date", T.DateType()), T.StructField("origin", T.StringType(), False), T.StructField("source_label", T.StringType())]
)

DAILY = T.StructType(
    [T.StructField("date", T.DateType()), T.StructField("provider", T.StringType()), T.StructField("models", T.ArrayType(T.StringType()))]
    + [T.StructField(c, T.LongType()) for c in ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "cached_tokens", "fresh_tokens", "total_tokens")]
    + [T.StructField("estimated_cost_usd", T.DoubleType())]
)


def conform(df: DataFrame, schema: T.StructType = EVENT) -> DataFrame:
    """df with exactly the schema's columns, in order: missing ones null, others dropped, values cast."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def invalid(df: DataFrame) -> DataFrame:
    """Events whose enumerated columns hold other values; for checks before a write."""
    ok = F.col("origin").isin(*ORIGINS) & (F.col("measurement_class").isNull() | F.col("measurement_class").isin(*MEASUREMENT_CLASSES)) & (F.col("confidence").isNull() | F.col("confidence").isin(*CONFIDENCES))
    return df.filter(~F.coalesce(ok, F.lit(False)))


def _with_local_date(df: DataFrame) -> DataFrame:
    return df.withColumn("local_date", F.lit(None).cast("date"))


def _with_origin(df: DataFrame) -> DataFrame:
    return df.withColumn("origin", F.lit("local_log")).withColumn("source_label", F.lit(None).cast("string"))


#: (version, up, columns that down removes), oldest first: each version is one pure change of the table.
MIGRATIONS: list[tuple[int, Callable[[DataFrame], DataFrame], tuple[str, ...]]] = [
    (2, _with_local_date, ("local_date",)),
    (3, _with_origin, ("origin", "source_label")),
]


def migrate(df: DataFrame, have: int, want: int = MIGRATIONS[-1][0]) -> DataFrame:
    """Take a stored table from one schema version to another, up or down."""
    for version, up, _ in MIGRATIONS:
        if have < version <= want:
            df = up(df)
    for version, _, added in reversed(MIGRATIONS):
        if want < version <= have:
            df = df.drop(*added)
    return df

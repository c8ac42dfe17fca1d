"""The usage events and what the queries derive from the test tables, as DataFrames and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge, rollup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows over all cores by a key, before work that takes long for a row: a table may come as one file of one part."""
    return df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism, key)


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical events made of the events table, each by a fixed rule; a twentieth counts as imported."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    e = e.select(
        F.substring(F.sha2(F.concat("event_type", F.lit("|msg:"), F.col("event_id").cast("string"), F.lit("|req:")), 256), 1, 32).alias("event_id"),
        F.col("ts").alias("occurred_at"),
        F.col("event_type").alias("provider"),
        F.when(F.col("k") % 10 == 0, None).otherwise(F.concat(F.lit("claude-"), (F.col("k") % 5).cast("string"))).alias("model"),
        F.concat(F.lit("s"), F.col("user_id").cast("string"), F.lit("-"), F.to_date("ts").cast("string")).alias("session_pseudonym"),
        F.round(F.col("value") * 100).cast("long").alias("input_tokens"),
        F.col("k").alias("output_tokens"),
        (F.col("k") % 7).alias("cache_creation_tokens"),
        F.round(F.col("value") * 1000).cast("long").alias("cache_read_tokens"),
        F.to_date("ts").alias("local_date"),
        F.when(F.col("k") % 20 == 0, "imported").otherwise("local_log").alias("origin"),
        F.when(F.col("k") % 20 == 0, F.concat(F.lit("file-"), (F.col("user_id") % 3).cast("string"))).alias("source_label"),
        "user_id",
        "k",
    )
    return e.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens") + F.col("cache_creation_tokens") + F.col("cache_read_tokens"))


USAGE_SQL = """u AS (SELECT *, input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens AS total_tokens FROM (
  SELECT substr(sha256(concat(event_type, '|msg:', CAST(event_id AS VARCHAR), '|req:')), 1, 32) AS event_id,
    ts AS occurred_at, event_type AS provider,
    CASE WHEN k % 10 = 0 THEN NULL ELSE concat('claude-', CAST(k % 5 AS VARCHAR)) END AS model,
    concat('s', CAST(user_id AS VARCHAR), '-', CAST(CAST(ts AS DATE) AS VARCHAR)) AS session_pseudonym,
    CAST(round(value * 100) AS BIGINT) AS input_tokens, k AS output_tokens, k % 7 AS cache_creation_tokens,
    CAST(round(value * 1000) AS BIGINT) AS cache_read_tokens, CAST(ts AS DATE) AS local_date,
    CASE WHEN k % 20 = 0 THEN 'imported' ELSE 'local_log' END AS origin,
    CASE WHEN k % 20 = 0 THEN concat('file-', CAST(user_id % 3 AS VARCHAR)) END AS source_label, user_id, k
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)))"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured daily rows with derived sums, models and cost (null for one provider)."""
    d = rollup.daily_totals(usage(spark, sf_dir))
    d = merge.with_derived(d)
    models = rollup.measured(usage(spark, sf_dir)).groupBy("provider").agg(F.array_sort(F.collect_set("model")).alias("models"))
    return d.join(models, "provider", "left").withColumn("estimated_cost_usd", F.when(F.col("provider") != "view", F.floor(F.col("total_tokens") / 10) / 100))


DAILY_SQL = (
    USAGE_SQL
    + """, m AS (SELECT provider, list_sort(list(DISTINCT model) FILTER (model IS NOT NULL)) AS models FROM u WHERE origin = 'local_log' GROUP BY provider),
d AS (SELECT t.*, input_tokens + output_tokens AS fresh_tokens, cache_creation_tokens + cache_read_tokens AS cached_tokens, m.models,
  CASE WHEN t.provider <> 'view' THEN floor(total_tokens / 10) / 100 END AS estimated_cost_usd FROM (
  SELECT local_date AS date, provider, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
    CAST(sum(cache_creation_tokens) AS BIGINT) AS cache_creation_tokens, CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens,
    CAST(sum(total_tokens) AS BIGINT) AS total_tokens, count(*) AS events
  FROM u WHERE origin = 'local_log' GROUP BY 1, 2) t LEFT JOIN m USING (provider))"""
)


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as members of a directory."""
    c = table(spark, sf_dir, "customer")
    sig = F.when(F.col("c_custkey") % 4 == 0, "historical").when(F.col("c_custkey") % 4 == 1, "valid").when(F.col("c_custkey") % 4 == 2, "invalid").otherwise("unsigned")
    return c.select(
        F.lower(F.regexp_replace("c_name", "#", "-")).alias("handle"), F.col("c_name").alias("display_name"), F.col("c_mktsegment").alias("headline"),
        F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string"))).alias("location"),
        F.array(F.lower("c_mktsegment")).alias("work_categories"), F.array(F.concat(F.lit("tool"), (F.col("c_custkey") % 7).cast("string")), F.concat(F.lit("tool"), (F.col("c_custkey") % 3).cast("string"))).alias("tools"),
        F.array(F.concat(F.lit("proof"), F.col("c_custkey").cast("string"))).alias("proofs"), sig.alias("signature"),
        F.when(F.col("c_custkey") % 5 == 0, F.array(F.lit("contract"))).otherwise(F.array().cast("array<string>")).alias("open_to"),
        F.array().cast("array<string>").alias("engagement_types"), (F.col("c_custkey") % 90).alias("active_days"), "c_custkey",
    )


MEMBERS_SQL = """mem AS (SELECT lower(regexp_replace(c_name, '#', '-', 'g')) AS handle, c_name AS display_name, c_mktsegment AS headline,
  CASE WHEN c_nationkey % 2 = 0 THEN concat('Nation ', CAST(c_nationkey AS VARCHAR)) END AS location, [lower(c_mktsegment)] AS work_categories,
  [concat('tool', CAST(c_custkey % 7 AS VARCHAR)), concat('tool', CAST(c_custkey % 3 AS VARCHAR))] AS tools, [concat('proof', CAST(c_custkey AS VARCHAR))] AS proofs,
  CASE c_custkey % 4 WHEN 0 THEN 'historical' WHEN 1 THEN 'valid' WHEN 2 THEN 'invalid' ELSE 'unsigned' END AS signature,
  c_custkey % 5 = 0 AS is_open, c_custkey % 90 AS active_days, c_custkey FROM customer)"""

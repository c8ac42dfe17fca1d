"""Windows over keys of any size: rows of one key in many partitions, of which each hands on what the next ones need.

Rows are sorted by range over (key, order), so that a large key spans many partitions, and written once to the
shared folder with the number of their part: a *segment* is what a part has of a key. Windows then run within
segments; what a segment hands on - its last value, how many rows it has - is one row, and of these a key has
at most one for each part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch

PART, PLACE = "_part", "_place"
#: Rows of a key that one task may sort and read.
MOST = 5_000_000


def by_size(df: DataFrame, keys: list[str], most: int = MOST) -> tuple[DataFrame, DataFrame | None]:
    """(rows of keys that one task can read, rows of the others or None if there are none).

    Of the others there are fewer than one key for each ``most`` rows of the table. A table that is read from
    fewer bytes than ``most`` is not counted.
    """
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < most:
        return df, None
    large = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > most).drop("_n")
    named = large.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).persist()
    try:
        if named.isEmpty():
            return df, None
        spark = df.sparkSession
        named = spark.createDataFrame(named.collect(), named.schema)
    finally:
        named.unpersist()
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(F.broadcast(named), on, "left_anti"), df.join(F.broadcast(named), on, "left_semi")


def in_parts(df: DataFrame, keys: list[str], order: list[str | Column], parts: int | None = None) -> DataFrame:
    """df written in the order of (keys, order), with the number of the part (_part) and the row's place in it (_place).

    Rows that are equal in keys and order come one after another, in an order that is chosen once.
    """
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch(spark, "parts")
    tie = F.rand(7)  # equal rows may be many: they are parted too
    ordered = df.withColumn("_tie", tie).repartitionByRange(n, *keys, *order, "_tie").sortWithinPartitions(*keys, *order, "_tie")
    ordered.drop("_tie").withColumns({PART: F.spark_partition_id(), PLACE: F.monotonically_increasing_id()}).write.parquet(path)
    return spark.read.parquet(path)


def _within(keys: list[str]):
    return Window.partitionBy(PART, *keys).orderBy(PLACE)


def _join(rows: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """rows with what is said of their segments; keys may be null."""
    named = segments.select(F.col(PART).alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in segments.columns if c not in (PART, *keys)])
    on = F.col(PART) == F.col("_p")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(named, on, "left").drop("_p", *[f"_k{i}" for i in range(len(keys))])


def _earlier(keys: list[str]):
    return Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)


def previous(rows: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """rows of :func:`in_parts` with the column's value in the row before of the same key (null in its first row)."""
    segments = rows.groupBy(PART, *keys).agg(F.max_by(F.struct(column), PLACE).alias("_x"))
    handed = segments.select(PART, *keys, F.last("_x").over(_earlier(keys)).alias("_handed"))
    first = F.row_number().over(_within(keys)) == 1
    own = rows.withColumns({"_first": first, "_lag": F.lag(column).over(_within(keys))})
    return _join(own, handed, keys).withColumn(name, F.when(F.col("_first"), F.col(f"_handed.{column}")).otherwise(F.col("_lag"))).drop("_first", "_lag", "_handed")


def last_known(rows: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """rows of :func:`in_parts` with the last value of the column that is not null, up to the row itself."""
    known = rows.filter(F.col(column).isNotNull()).groupBy(PART, *keys).agg(F.max_by(column, PLACE).alias("_x"))
    segments = _join(rows.select(PART, *keys).distinct(), known, keys)
    handed = segments.select(PART, *keys, F.last("_x", ignorenulls=True).over(_earlier(keys)).alias("_handed"))
    own = rows.withColumn("_own", F.last(column, ignorenulls=True).over(_within(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return _join(own, handed, keys).withColumn(name, F.coalesce("_own", "_handed")).drop("_own", "_handed")


def numbered(rows: DataFrame, keys: list[str], name: str, counted: Column | None = None) -> DataFrame:
    """rows of :func:`in_parts` with how many rows of their key (that are counted) come before them."""
    one = F.lit(1).cast("long") if counted is None else F.when(counted, 1).otherwise(0).cast("long")
    rows = rows.withColumn("_one", one)
    segments = rows.groupBy(PART, *keys).agg(F.sum("_one").alias("_n"))
    handed = segments.select(PART, *keys, F.coalesce(F.sum("_n").over(_earlier(keys)), F.lit(0)).alias("_handed"))
    own = rows.withColumn("_own", F.sum("_one").over(_within(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_one"))
    return _join(own, handed, keys).withColumn(name, F.col("_own") + F.col("_handed")).drop("_one", "_own", "_handed")

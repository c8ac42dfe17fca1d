"""Keys of any size: rows of one key in many partitions give the rows of a window over all of it."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyworks.operators import derive, scan
from tallyworks.streaming import limits


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    data = [(rng.choice(["hot", "hot", "hot", "hot", "cold", None]), i // 3, None if rng.random() < 0.6 else f"v{i}", i) for i in range(400)]
    return spark.createDataFrame(data, "key string, at int, value string, id int").repartition(5).cache()


def test_scans_of_parts(spark, rows):
    parts = scan.in_parts(rows, ["key"], ["at", "id"], 7)
    assert parts.filter("key = 'hot'").select("_part").distinct().count() >= 4
    w = Window.partitionBy("key").orderBy("at", "id")
    for got, want in (
        (scan.previous(parts, ["key"], "value", "x"), F.lag("value").over(w)),
        (scan.last_known(parts, ["key"], "value", "x"), F.last("value", ignorenulls=True).over(w)),
        (scan.numbered(parts, ["key"], "x"), F.row_number().over(w) - 1),
        (scan.numbered(parts, ["key"], "x", F.col("value").isNotNull()), F.count("value").over(w) - F.col("value").isNotNull().cast("int")),
    ):
        assert sorted(got.select("id", "x").collect()) == sorted(rows.select("id", want.alias("x")).collect())


def test_equal_rows_are_parted_too(spark):
    same = spark.createDataFrame([("k", 1)] * 500, "key string, at int")
    parts = scan.in_parts(same, ["key"], ["at"], 8)
    assert parts.select("_part").distinct().count() >= 4
    assert sorted(r.x for r in scan.numbered(parts, ["key"], "x").collect()) == list(range(500))


def test_large_sessions_and_files(spark, rows):
    e = rows.select(F.coalesce("key", F.lit("")).alias("session_pseudonym"), F.timestamp_seconds(F.col("at") * 700).alias("occurred_at"))
    want = sorted(derive.gaps(e, 3600).collect())
    assert sorted(derive.gaps(e, 3600, most=60).collect()) == want and len(want) > 200
    plain = lambda most: sorted(map(repr, derive.carry_forward(rows, ["key"], ["at", "id"], "value", most).collect()))
    assert plain(60) == plain(10**6) == plain(0)


def by_hand(events, most, window):
    """Event by event: a window starts at the first event beyond the last one; nulls come last, in the last window."""
    out, start, count = {}, {}, {}
    for b, at, i in sorted(events, key=lambda e: (e[0] is not None, e[0] or "", e[1] is None, e[1] or dt.datetime.min, i_key(e[2]))):
        if b not in start or (at is not None and start[b] is not None and (at - start[b]).total_seconds() > window):
            start[b], count[b] = at, 0
        count[b] += 1
        out[b, i] = count[b] <= most
    return out


def i_key(i):
    return (i is None, i or "")


@pytest.mark.parametrize("seed,window,most", [(0, 10.0, 2), (1, 0.0, 1), (3, 37.5, 3)])
def test_limits_of_one_bucket_over_many_parts(spark, seed, window, most):
    rng = random.Random(seed)
    t = dt.datetime(2026, 1, 1)
    rows = [(rng.choice(["hot"] * 9 + ["b", None]), None if rng.random() < 0.02 else t + dt.timedelta(seconds=rng.choice([1, 1, 7]) * rng.randrange(300)), f"{i:04}") for i in range(600)]
    rows += [("nulls", None, "n1"), ("nulls", None, "n2"), ("one", t, "o")]
    df = spark.createDataFrame(rows, "bucket string, at timestamp, id string").repartition(4)
    got = limits.limit(df, most, window, most_in_task=50, parts=9)
    assert {(r.bucket, r.id): r.allowed for r in got.collect()} == by_hand(rows, most, window)

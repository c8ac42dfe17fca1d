"""Rate limits with windows that start at a bucket's first event."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import scan
from ..session import scratch

RESULT = "bucket string, at timestamp, id string, allowed boolean"


def step(start: float | None, count: int, at: float, most: int, window: float) -> tuple[float, int, bool]:
    """State after one event: a window that is over starts anew with it; a full one rejects it."""
    if start is None or at - start > window:
        return at, 1, True
    return (start, count, False) if count >= most else (start, count + 1, True)


def _decide(rows: pd.DataFrame, start: float | None, count: int, most: int, window: float) -> tuple[list[bool], float | None, int]:
    allowed = []
    for at in rows["at"].astype("int64") / 1e9 if rows["at"].dtype.str.endswith("ns]") else rows["at"].astype("datetime64[ns]").astype("int64") / 1e9:
        start, count, ok = step(start, count, at, most, window)
        allowed.append(ok)
    return allowed, start, count


def limit(events: DataFrame, most: int, window_seconds: float, most_in_task: int = scan.MOST, parts: int | None = None) -> DataFrame:
    """allowed for each event (bucket, at, id) of a table, in the order of time and id.

    Events without a time come last, in the last window of their bucket. Spark sorts the events; of a bucket
    only the window's start and count pass from batch to batch.

    :param most_in_task: buckets of more events are no task's: they are read in ``parts`` (by default as many
        as a shuffle has), see :func:`_limit_in_parts`.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, start, count = None, None, 0
        for pdf in batches:
            allowed: list[bool] = []
            names = pdf["bucket"].astype(object).where(pdf["bucket"].notna(), None).tolist()
            cuts = [i for i in range(len(names)) if not i or names[i] != names[i - 1]]
            for a, b in zip(cuts, [*cuts[1:], len(names)], strict=True):
                key = (names[a],)
                if key != last:
                    last, start, count = key, None, 0
                ok, start, count = _decide(pdf.iloc[a:b], start, count, most, window_seconds)
                allowed += ok
            yield pdf.assign(allowed=allowed)[["bucket", "at", "id", "allowed"]]

    rows = events.select("bucket", F.col("at").cast("timestamp").alias("at"), F.col("id").cast("string").alias("id"))
    small, large = scan.by_size(rows, ["bucket"], most_in_task)
    ordered = small.repartition("bucket").sortWithinPartitions("bucket", F.col("at").asc_nulls_last(), F.col("id").asc_nulls_last())
    out = ordered.mapInPandas(run, RESULT)
    return out if large is None else out.union(_limit_in_parts(large, most, window_seconds, parts))


POINTERS = "_part long, _place long, bucket string, key string, at timestamp, id string, idx long, next long"


def _leave(t: pa.Table) -> pa.Table:
    """The events of a bucket in a part, with the event that begins the window after each: where each one's windows leave the part."""
    order = np.argsort(t.column("idx").to_numpy())
    idx, after = t.column("idx").to_numpy()[order], t.column("next").fill_null(-1).to_numpy()[order]
    end = idx[-1] + 1
    out = after.copy()
    while len(inside := np.flatnonzero((out >= 0) & (out < end))):  # each step doubles what is skipped
        out[inside] = out[out[inside] - idx[0]]
    exits = pa.array(out, mask=out < 0)
    return pa.table({"key": t.column("key").slice(0, 1).take(pa.array(np.zeros(len(idx), int))), "idx": pa.array(idx), "exit": exits})


def _begin(t: pa.Table) -> pa.Table:
    """The same with the event at which windows enter the part (null if they pass it by): adds the events that begin one."""
    order = np.argsort(t.column("idx").to_numpy())
    t = t.take(pa.array(order))
    idx, after = t.column("idx").to_numpy(), t.column("next").fill_null(-1).to_numpy()
    begins = np.zeros(len(idx), bool)
    at = t.column("entry")[0].as_py()
    while at is not None and idx[0] <= at <= idx[-1]:
        begins[at - idx[0]] = True
        at = int(after[at - idx[0]])
    return t.drop_columns(["entry"]).append_column("begun", pa.array(idx, mask=~begins))


def _limit_in_parts(rows: DataFrame, most: int, window_seconds: float, parts: int | None = None) -> DataFrame:
    """:func:`limit` for buckets of any size.

    Each event points to the first one beyond the window that it would begin; which events do begin one is
    what is met on the way from a bucket's first event. The events of a bucket in a part are one step of that
    way, from where it enters the part to where it leaves it, and pointers from entry to entry are doubled:
    log2(parts) rounds. The last begun window is handed on from part to part, and an event's place in it tells.
    """
    spark = rows.sparkSession
    kept = lambda df, name: (path := scratch(spark, name), df.write.parquet(path), spark.read.parquet(path))[-1]
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.concat(F.lit("="), "bucket"), F.lit("null"))
    ordered = scan.in_parts(rows.withColumn("key", key), ["key"], [F.col("at").asc_nulls_last(), F.col("id").asc_nulls_last()], n)
    events = kept(scan.numbered(ordered, ["key"], "idx"), "limit-events")
    # the events of no later time than a window's end, counted
    time = F.unix_micros("at")
    known = events.filter("at is not null")
    ends = known.select("key", (time + F.lit(int(min(window_seconds * 1e6, 1e17)))).alias("t"), F.lit(1).alias("kind"), "idx")
    both = scan.in_parts(known.select("key", time.alias("t"), F.lit(0).alias("kind"), "idx").union(ends), ["key"], ["t", "kind"], n)
    after = scan.numbered(both, ["key"], "next", F.col("kind") == 0).filter("kind = 1").select("key", "idx", "next")
    last = known.groupBy("key").agg(F.count("*").alias("known"))
    after = after.join(last, "key").select("key", "idx", F.when(F.col("next") < F.col("known"), F.col("next")).alias("next"))
    columns = [x.split()[0] for x in POINTERS.split(", ")]
    pointers = kept(events.join(after, ["key", "idx"], "left").select(*[F.col(c).cast("long") if c in ("_part", "_place") else F.col(c) for c in columns]), "limit-pointers")
    steps = kept(pointers.groupBy("_part", "key").applyInArrow(_leave, "key string, idx long, exit long"), "limit-steps")
    # of all events only those where windows can enter a part matter
    entries = steps.filter("exit is not null").select("key", F.col("exit").alias("idx")).union(steps.filter("idx = 0").select("key", "idx")).distinct()
    jump = kept(steps.join(entries, ["key", "idx"], "left_semi").filter("exit is not null"), "limit-jumps")
    jumps = [jump]
    for _ in range(max(0, math.ceil(math.log2(n + 1)) - 1)):
        onward = jumps[-1].select("key", F.col("idx").alias("exit"), F.col("exit").alias("far"))
        jumps.append(kept(jumps[-1].join(onward, ["key", "exit"]).select("key", "idx", F.col("far").alias("exit")), "limit-jumps"))
    met = steps.filter("idx = 0").select("key", "idx")
    for jump in reversed(jumps):
        met = kept(met.union(met.join(jump, ["key", "idx"]).select("key", F.col("exit").alias("idx"))).distinct(), "limit-entries")
    where = met.join(pointers.select("key", "idx", "_part"), ["key", "idx"]).select("key", "_part", F.col("idx").alias("entry"))
    begun = pointers.join(where, ["key", "_part"], "left").groupBy("_part", "key").applyInArrow(_begin, f"{POINTERS}, begun long")
    windows = scan.last_known(kept(begun, "limit-begun"), ["key"], "begun", "first")
    return windows.select("bucket", "at", "id", (F.col("idx") - F.col("first") < most).alias("allowed"))


def limit_stream(events: DataFrame, most: int, window_seconds: float) -> DataFrame:
    """The same over a stream: the window's start and count are kept for each bucket."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, count = state.get if state.exists else (None, 0)
        for pdf in parts:
            pdf = pdf.sort_values(["at", "id"], kind="stable")
            allowed, start, count = _decide(pdf, start, count, most, window_seconds)
            yield pdf.assign(allowed=allowed)[["bucket", "at", "id", "allowed"]]
        if start is not None:
            state.update((start, count))

    rows = events.select("bucket", F.col("at").cast("timestamp").alias("at"), F.col("id").cast("string").alias("id"))
    return rows.groupBy("bucket").applyInPandasWithState(run, RESULT, "start double, count int", "append", GroupStateTimeout.NoTimeout)


def invitation_decisions(invitations: DataFrame, by_sender: int = 10, by_receiver: int = 30, window_seconds: float = 24 * 3600) -> DataFrame:
    """id, code of invitations (id, at and the fields of rules.invitation_code), with limits on senders and receivers.

    Only well-formed invitations count against a sender, and only those that pass the sender's limit against
    the receiver. Ids are unique.
    """
    from ..operators.rules import invitation_code

    coded = invitations.select(F.col("id").cast("string").alias("id"), "at", F.lower(F.trim("contact_email")).alias("sender"), F.lower(F.trim("to_handle")).alias("receiver"), invitation_code().alias("code"))
    good = coded.filter("code = 'OK'")
    sent = limit(good.select(F.concat(F.lit("invite:"), "sender").alias("bucket"), "at", "id"), by_sender, window_seconds).select("id", F.col("allowed").alias("sent"))
    through = good.join(sent.filter("sent"), "id")
    got = limit(through.select(F.concat(F.lit("invite-to:"), "receiver").alias("bucket"), "at", "id"), by_receiver, window_seconds).select("id", F.col("allowed").alias("got"))
    full = ~F.coalesce(F.col("got"), F.lit(False))
    return coded.join(got, "id", "left").select("id", F.when((F.col("code") == "OK") & full, "RATE_LIMIT").otherwise(F.col("code")).alias("code"))


def sessions(events: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    """Events by key (user, at) in sessions that end after a gap; works on tables and streams alike."""
    e = events.withWatermark("at", watermark) if events.isStreaming else events
    return e.groupBy("user", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("events")).select("user", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")

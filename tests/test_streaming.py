"""Tailing, the idempotent sink, and rate limits."""

import datetime as dt
import json
import os
import random

import pytest

from tallyworks.operators import store
from tallyworks.sources import tail
from tallyworks.sources.tail import TailReader
from tallyworks.streaming import ingest, limits


def line(i):
    return json.dumps({"timestamp": "2026-05-01T10:00:00Z", "message": {"id": f"m{i}", "model": "claude-x", "usage": {"input_tokens": i, "output_tokens": 1}}}) + "\n"


def reader(tmp_path, **options):
    return TailReader(str(tmp_path / "logs"), "*.jsonl", str(tmp_path / "state"), **options)


def taken(r, start, end):
    return [row[2] for p in r.partitions(start, end) for row in r.read(p)]


def test_tail_states(tmp_path):
    (tmp_path / "logs").mkdir()
    f = tmp_path / "logs" / "a.jsonl"
    f.write_text("one\ntwo\npart")
    r = reader(tmp_path)
    start, end = r.initialOffset(), r.latestOffset()
    assert taken(r, start, end) == ["one", "two"]
    assert r.latestOffset() == end
    with f.open("a") as h:
        h.write("ial\nthree\n")
    later = r.latestOffset()
    assert taken(r, end, later) == ["partial", "three"]
    f.write_text("new\n")  # shrunk
    last = r.latestOffset()
    assert taken(r, later, last) == ["new"]
    # a batch of several changes: what is gone is not looked for
    assert taken(r, start, last) == ["new"]


def test_a_restart_opens_no_file_that_has_not_changed(tmp_path, monkeypatch):
    (tmp_path / "logs").mkdir()
    for i in range(5):
        (tmp_path / "logs" / f"{i}.jsonl").write_text(f"line {i}\n")
    r = reader(tmp_path)
    end = r.latestOffset()
    assert end == {"number": 1} and sorted(taken(r, r.initialOffset(), end)) == [f"line {i}" for i in range(5)]
    with (tmp_path / "logs" / "3.jsonl").open("a") as h:
        h.write("more\n")
    opened = []
    true_read = tail.lines_in
    monkeypatch.setattr(tail, "lines_in", lambda fs, part: opened.append(part.file) or true_read(fs, part))
    again = reader(tmp_path)
    later = again.latestOffset()
    assert not opened and taken(again, end, later) == ["more"] and [os.path.basename(x) for x in opened] == ["3.jsonl"]
    # changes written before a crash, of which Spark knows no offset yet, come with the next batch
    with (tmp_path / "logs" / "1.jsonl").open("a") as h:
        h.write("lost\n")
    again.latestOffset()
    third = reader(tmp_path)
    assert taken(third, later, third.latestOffset()) == ["lost"]


def test_tables_of_changes_become_one(tmp_path):
    (tmp_path / "logs").mkdir()
    r, before, got = reader(tmp_path), {"number": 0}, []
    for i in range(35):
        with (tmp_path / "logs" / f"{i % 4}.jsonl").open("a") as h:
            h.write(f"{i}\n")
        end = r.latestOffset()
        got += taken(r, before, end)
        r.commit(end)
        before = end
        if i % 9 == 8:
            r = reader(tmp_path)
    assert got == [str(i) for i in range(35)]
    state = tail.State(str(tmp_path / "state"))
    assert len(state.numbers("files")) == 1 and len(state.numbers("changes")) < tail.COMPACT
    assert {os.path.basename(f): r["done"] for f, r in state.load()[1].items()} == {f"{k}.jsonl": sum(len(f"{i}\n") for i in range(k, 35, 4)) for k in range(4)}


def test_bounded_batches_take_every_byte_once(tmp_path):
    (tmp_path / "logs").mkdir()
    for i in range(7):
        f = tmp_path / "logs" / f"{i}.jsonl"
        f.write_text(f"a{i}\n")
        os.utime(f, (1000 - i, 1000 - i))
    r, before, batches = reader(tmp_path, max_files=3), {"number": 0}, []
    while (end := r.latestOffset()) != before:
        batches.append(taken(r, before, end))
        before = end
        r = reader(tmp_path, max_files=3)
        if len(batches) == 1:  # one that was taken grows while others wait
            with (tmp_path / "logs" / "6.jsonl").open("a") as h:
                h.write("late\n")
    assert [len(b) for b in batches] == [3, 3, 2] and batches[0] == ["a6", "a5", "a4"]
    assert sorted(x for b in batches for x in b) == sorted([f"a{i}" for i in range(7)] + ["late"])


@pytest.mark.parametrize("split", [1, 7, 64, 1000, 1 << 20])
def test_ranges_hold_every_line_once(tmp_path, monkeypatch, split):
    """Lines of any length, over ranges and chunks of any size; a second batch goes on in the file."""
    monkeypatch.setattr(tail, "CHUNK", 13)
    rng = random.Random(split)
    (tmp_path / "logs").mkdir()
    f, before, rest = tmp_path / "logs" / "a.jsonl", {"number": 0}, ""
    r = TailReader(f"file://{tmp_path}/logs", "*.jsonl", f"file:{tmp_path}/state", split)
    for _ in range(3):
        new = ["x" * rng.choice([0, 1, 5, 12, 13, 14, 100]) + "é" for _ in range(20)]
        with f.open("a") as h:
            h.write("".join(x + "\n" for x in new) + "tail")
        end = r.latestOffset()
        got = [row for part in r.partitions(before, end) for row in r.read(part)]
        assert [x[2] for x in got] == [rest + new[0], *new[1:]]
        data = f.read_bytes()
        assert all(data[x[1] :].startswith(x[2].encode()) for x in got)
        before, rest = end, "tail"


FORMATS = {
    # of lines of one id the first that came counts; here they are alike
    "message_usage": lambda i, rng: json.dumps({"timestamp": "2026-05-01T10:00:00Z", "message": {"id": f"m{(k := rng.randrange(40))}", "usage": {"input_tokens": k, "output_tokens": 1}}}),
    "turn_deltas": lambda i, rng: json.dumps({"timestamp": "2026-05-01T10:00:00Z", "payload": {"type": "turn_context", "model": f"model-{i}"}} if rng.random() < 0.3 else {"timestamp": f"2026-05-01T10:00:{i % 7:02}Z", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": rng.randrange(3), "output_tokens": 2}}}}),
    "cumulative_final": lambda i, rng: json.dumps({"timestamp": "2026-05-01T10:00:00Z", "model": "m-1", "usage": {"inputTokens": 10 + i, "outputTokens": i}}),
    "turn_records": lambda i, rng: json.dumps({"timestamp": "2026-05-01T10:00:00Z", "usage": {"input_other": 5 + i, "output": 1}}),
}


@pytest.mark.parametrize("kind", sorted(FORMATS))
def test_tailing_in_any_cut_gives_the_rows_of_a_whole_read(spark, tmp_path, kind):
    rng = random.Random(kind)
    whole = [("".join(FORMATS[kind](i, rng) + "\n" for i in range(25))).encode() for _ in range(2)]
    logs = tmp_path / "logs"
    logs.mkdir()
    options = {"key": b"k"} if kind == "message_usage" else {}
    run = lambda name, **more: ingest.catch_up(spark, str(logs), str(tmp_path / name / "events"), str(tmp_path / name / "cp"), kind, provider="p", **options, **more)
    columns = ["event_id", "model", "input_tokens", "output_tokens", "total_tokens", "occurred_at_raw"]
    read = lambda name: sorted(map(tuple, spark.read.parquet(str(tmp_path / name / "events")).select(columns).collect()), key=repr)
    at = [0, 0]
    for step in range(3):
        for f, data in enumerate(whole):
            end = len(data) if step == 2 else rng.randrange(at[f], len(data))
            with (logs / f"{f}.jsonl").open("ab") as h:
                h.write(data[at[f] : end])
            at[f] = end
        run("cut", max_files=1 if step == 1 else None, split=500 if step else 1 << 20)
    run("once")
    assert read("cut") == read("once") and len(read("cut")) >= 2
    if kind == "turn_deltas":
        (logs / "0.jsonl").write_bytes(whole[1][: whole[1].index(b"\n", 400) + 1])  # a file that begins anew
        run("cut")
        handed = {os.path.basename(r.file): r.turns for r in ingest.Handed(spark, str(tmp_path / "cut" / "cp-handed")).before(99).collect()}
        assert handed["0.jsonl"] < handed["1.jsonl"]


def test_what_files_hand_on_becomes_one_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "COMPACT", 3)
    h = ingest.Handed(spark, str(tmp_path / "handed"))
    for n in range(9):
        df = spark.createDataFrame([(f"f{n % 4}", f"m{n}", n)], "file string, model string, turns long")
        for _ in range(2):  # a batch that runs again finds the same
            assert {r.file: r.turns for r in h.before(n).collect()} == {f"f{k % 4}": k for k in range(n)}
            h.write(n, df)
    found = h.batches()
    assert len(found["part"]) < 9 and found["whole"]


def test_ingest_appends_only_new_bytes(spark, tmp_path):
    logs, path, point = tmp_path / "logs", str(tmp_path / "events"), str(tmp_path / "checkpoint")
    logs.mkdir()
    (logs / "a.jsonl").write_text(line(1) + line(2) + "{broken\n")
    run = lambda: ingest.ingest(spark, str(logs), path, point, provider="claude", key=b"k").awaitTermination(120)
    run()
    assert spark.read.parquet(path).count() == 2
    with (logs / "a.jsonl").open("a") as f:
        f.write(line(2) + line(3))
    run()
    run()
    got = spark.read.parquet(path)
    assert got.count() == 3 and got.agg({"input_tokens": "sum"}).first()[0] == 6


def totals(path, n):
    (path / "c.log").write_text("".join(json.dumps({"timestamp": f"2026-05-0{n}T10:00:00Z", "usage": {"inputTokens": 10 * i, "outputTokens": 1}}) + "\n" for i in range(1, n + 1)))


def test_tailed_and_reread_rows_share_a_store(spark, tmp_path):
    logs, path = tmp_path / "logs", str(tmp_path / "events")
    logs.mkdir()
    (logs / "a.jsonl").write_text(line(1) + line(2))
    ingest.ingest(spark, str(logs), path, str(tmp_path / "cp"), provider="claude", key=b"k").awaitTermination(120)
    totals(logs, 1)
    again = lambda **o: ingest.reread(spark, str(logs), path, "cumulative_final", "*.log", provider="grok", **o)
    assert again() == {"inserted": 1, "duplicates": 0} and again() == {"inserted": 0, "duplicates": 1}
    read = lambda: sorted((r.provider, r.input_tokens, str(r.local_date)) for r in spark.read.parquet(path).collect())
    assert read() == [("claude", 1, "2026-05-01"), ("claude", 2, "2026-05-01"), ("grok", 10, "2026-05-01")]
    before = {f: os.stat(f).st_mtime_ns for f in map(str, (tmp_path / "events").rglob("*.parquet"))}
    assert again(replace=True) == {"inserted": 0, "replaced": 0, "duplicates": 1}
    assert {f: os.stat(f).st_mtime_ns for f in map(str, (tmp_path / "events").rglob("*.parquet"))} == before
    totals(logs, 3)  # the file's last total has another day
    assert again(replace=True) == {"inserted": 0, "replaced": 1, "duplicates": 0}
    assert read() == [("claude", 1, "2026-05-01"), ("claude", 2, "2026-05-01"), ("grok", 30, "2026-05-03")]
    assert not os.path.exists(f"{path}.next") and not os.path.exists(f"{path}.aside")
    # a swap that was cut short: the partition stands aside, and goes back before the next insert
    os.makedirs(f"{path}.aside/origin=local_log")
    os.rename(f"{path}/origin=local_log/local_date=2026-05-01", f"{path}.aside/origin=local_log/local_date=2026-05-01")
    assert again(replace=True) == {"inserted": 0, "replaced": 0, "duplicates": 1}
    assert len(read()) == 3


def test_replace_empties_a_partition(spark, tmp_path):
    path, order = str(tmp_path / "t"), ["at"]
    df = lambda rows: spark.createDataFrame(rows, "k string, v int, at int, p string")
    put = lambda rows: store.insert_or_replace(df(rows), path, "k", order, ["p"])
    assert put([("a", 1, 1, "x"), ("b", 1, 1, None), ("b", 2, 2, None)]) == {"inserted": 2, "replaced": 0, "duplicates": 1}
    assert put([("a", 5, 3, "y"), ("b", 2, 9, None), ("c", 1, 1, "y")]) == {"inserted": 1, "replaced": 1, "duplicates": 1}
    assert sorted(tuple(r[c] for c in "kvp") for r in spark.read.parquet(path).collect()) == [("a", 5, "y"), ("b", 2, None), ("c", 1, "y")]


def test_rate_limit_windows_start_with_their_first_event(spark):
    at = lambda m: dt.datetime(2026, 1, 1) + dt.timedelta(minutes=m)
    rows = [("a", at(m), str(m)) for m in (0, 10, 20, 61, 62, 200)] + [("b", at(5), "x")]
    got = limits.limit(spark.createDataFrame(rows, "bucket string, at timestamp, id string"), 2, 3600)
    assert {r["id"]: r["allowed"] for r in got.collect()} == {"0": True, "10": True, "20": False, "61": True, "62": True, "200": True, "x": True}


def test_rate_limit_stream_keeps_its_state(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    schema = "bucket string, at timestamp, id string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
    out = str(tmp_path / "out")
    for n, ids in enumerate((("1", "2"), ("3",))):
        (src / f"{n}.json").write_text("".join(json.dumps({"bucket": "a", "at": f"2026-01-01T00:0{i}:00Z", "id": i}) + "\n" for i in ids))
        q = limits.limit_stream(stream, 2, 3600).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
        q.awaitTermination(120)
    assert {r["id"]: r["allowed"] for r in spark.read.parquet(out).collect()} == {"1": True, "2": True, "3": False}


def test_rate_limit_of_a_bucket_in_many_batches(spark):
    """A window goes on from batch to batch, and no group is gathered whole."""
    t = dt.datetime(2026, 1, 1)
    rows = [(None if b == 2 else f"b{b}", t + dt.timedelta(seconds=i), f"{i:03}") for b in range(3) for i in range(50)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = limits.limit(spark.createDataFrame(rows, "bucket string, at timestamp, id string"), 3, 19.5)
        got = {(r.bucket, r.id): r.allowed for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(b, f"{i:03}"): i % 20 < 3 for b in ("b0", "b1", None) for i in range(50)}
    assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().toString()

"""Extraction from the four log formats, and what must not happen."""

import json

from tallyworks.operators import extract, rollup, store
from tallyworks.sources import lines

KEY = b"k" * 32


def write(folder, name, rows, end="\n"):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + end)


def message(i=120, o=340, c=50, r=900, session="s1", mid="m1", rid="r1", model="claude-opus-4", **more):
    return {"type": "assistant", "timestamp": "2026-05-01T10:00:00.000Z", "sessionId": session, "requestId": rid, "cwd": "/Users/x/secret", "gitBranch": "main", "message": {"id": mid, "model": model, "content": "private text", "usage": {"input_tokens": i, "output_tokens": o, "cache_creation_input_tokens": c, "cache_read_input_tokens": r}}} | more


def test_message_usage(spark, tmp_path):
    write(tmp_path, "a.jsonl", [message(), message(session="s2"), message(mid="", rid="", session=""), "not json", {"timestamp": "2026-05-01T10:00:00Z"}, message(i=0, o=0, c=0, r=0, mid="z"), message(timestamp="yesterday", mid="y"), message(i=-5, o="7", c=1, r=None, mid="neg", model="../x")])
    e = extract.extract(lines.read_lines(spark, str(tmp_path)), "message_usage", provider="claude", key=KEY).collect()
    assert sorted(r["total_tokens"] for r in e) == [1, 1410, 1410, 1410]
    same = [r for r in e if r["total_tokens"] == 1410 and r["session_pseudonym"]]
    assert len({r["event_id"] for r in same}) == 1 and len({r["session_pseudonym"] for r in same}) == 2
    assert all(len(r["event_id"]) == 32 for r in e)
    assert not any("private" in str(r) or "/Users" in str(r) or "'s1'" in str(r) for r in e)
    assert {r["model"] for r in e} == {"claude-opus-4", None}
    assert lines.malformed(lines.read_lines(spark, str(tmp_path))).first()["malformed"] == 1


def test_turn_deltas_keep_the_model_and_never_read_totals(spark, tmp_path):
    turn = lambda last, t="2026-05-01T10:00:00Z": {"timestamp": t, "payload": {"type": "token_count", "info": last}}
    rows = [
        {"timestamp": "2026-05-01T09:00:00Z", "payload": {"type": "turn_context", "model": "gpt-5-codex", "cwd": "/Users/x"}},
        turn({"total_token_usage": {"input_tokens": 999999}, "last_token_usage": {"input_tokens": 10731, "cached_input_tokens": 6528, "output_tokens": 649}}),
        turn(None),
        turn({"total_token_usage": {"input_tokens": 5}}),
        turn({"last_token_usage": {"input_tokens": 10, "cached_input_tokens": 20, "output_tokens": 1}}),
        {"type": "turn_context", "payload": {"model": "o3"}},
        turn({"last_token_usage": {"input_tokens": 10731, "cached_input_tokens": 6528, "output_tokens": 649}}),
    ]
    write(tmp_path, "b.jsonl", rows)
    e = extract.turn_deltas(lines.read_lines(spark, str(tmp_path)), "codex").orderBy("total_tokens").collect()
    assert [(r["input_tokens"], r["cache_read_tokens"], r["total_tokens"], r["model"]) for r in e[:1]] == [(0, 20, 11, "gpt-5-codex")]
    assert [(r["input_tokens"], r["cache_read_tokens"], r["output_tokens"], r["total_tokens"]) for r in e[1:]] == [(4203, 6528, 649, 11380)] * 2
    assert {r["model"] for r in e[1:]} == {"gpt-5-codex", "o3"} and len({r["event_id"] for r in e}) == 3


def test_cumulative_final_takes_the_last_line(spark, tmp_path):
    line = lambda i, o, r, **more: {"timestamp": 1767225600, "usage": {"inputTokens": i, "outputTokens": o, "cachedReadTokens": r, "modelUsage": {"grok-4": {}}} | more}
    write(tmp_path / "s1", "updates.jsonl", [line(10, 1, 0), "{bad", {"note": "usage"}, {"deep": [{"x": line(100, 20, 30)}]}], end="")
    write(tmp_path / "s2", "updates.jsonl", [line(5, 0, 9)])
    e = extract.cumulative_final(lines.read_lines(spark, str(tmp_path), "updates.jsonl"), "grok").orderBy("total_tokens").collect()
    assert [(r["input_tokens"], r["cache_read_tokens"], r["total_tokens"], r["model"]) for r in e] == [(5, 9, 14, "grok-4"), (70, 30, 120, "grok-4")]
    assert str(e[1]["occurred_at"]).startswith("2026-01-01")


def test_turn_records_skip_session_totals(spark, tmp_path):
    rows = [
        {"type": "StatusUpdate", "timestamp": "2026-05-01T10:00:00Z", "model": "kimi-k2", "payload": {"message_id": "a", "token_usage": {"input_other": 100, "output": 50, "input_cache_read": 20, "input_cache_creation": 0}}},
        {"type": "usage.record", "scope": "turn", "messageId": "b", "time": 1767225600000, "model": "kimi-k2", "usage": {"inputOther": 40, "output": 30, "inputCacheRead": 10, "inputCacheCreation": 0}},
        {"type": "usage.record", "scope": "session", "messageId": "c", "usage": {"inputOther": 4000, "output": 3000}},
        {"type": "message", "content": "chat about usage"},
    ]
    write(tmp_path, "wire.jsonl", rows)
    read = lambda: extract.turn_records(lines.read_lines(spark, str(tmp_path), "wire.jsonl"), "kimi").orderBy("total_tokens").collect()
    e = read()
    assert [r["total_tokens"] for r in e] == [80, 170]
    assert [r["event_id"] for r in e] == [r["event_id"] for r in read()]


ODD = ["1e300", "1" + "0" * 400, "1" + "0" * 5000, "-1", "NaN", "Infinity", "null", "true", '"7x"', "[]", "9007199254740993"]


def test_no_number_stops_a_format(spark, tmp_path):
    """Counts and times that are none, in each format: what is beside them counts; half characters of names do not."""
    at = '"2026-05-01T10:00:00Z"'
    for i, x in enumerate(ODD):
        (tmp_path / f"a{i}.jsonl").write_text(f'{{"timestamp":{at},"message":{{"id":"m{i}","model":"\\ud800x","usage":{{"input_tokens":{x},"output_tokens":3}}}}}}\n')
        (tmp_path / f"b{i}.jsonl").write_text(f'{{"timestamp":{at},"payload":{{"type":"token_count","info":{{"last_token_usage":{{"input_tokens":{x},"cached_input_tokens":{x},"output_tokens":3}}}}}}}}\n')
        for j, time in enumerate((at, x)):
            (tmp_path / f"c{i}{j}.jsonl").write_text(f'{{"timestamp":{time},"model":"\\ud800x","usage":{{"inputTokens":{x},"outputTokens":3}}}}\n')
            (tmp_path / f"d{i}{j}.jsonl").write_text(f'{{"timestamp":{time},"usage":{{"input_other":{x},"output":3}}}}\n')
    read = lambda kind, name, **o: extract.extract(lines.read_lines(spark, str(tmp_path), name), kind, provider="p", **o).collect()
    for rows, times in ((read("message_usage", "a*", key=KEY), 1), (read("turn_deltas", "b*"), 1), (read("cumulative_final", "c*"), 2), (read("turn_records", "d*"), 2)):
        # 5,000 digits are no number for a JSON parser, which may take the line for broken
        assert 10 * times <= len(rows) <= 11 * times
        assert {r.total_tokens for r in rows} == {3} and all(r.occurred_at for r in rows) and {r.model for r in rows} == {None}


def test_daily_feeds_and_imports_take_any_number(spark):
    from tallyworks.sources import records

    bodies = [f'{{"date":"2026-05-01","inputTokens":{x},"outputTokens":3,"totalTokens":{x},"totalCost":{x},"model":"\\ud800"}}' for x in ODD]
    docs = spark.createDataFrame(list(enumerate(bodies)), "source int, document string")
    rows = records.daily_rows(docs, "p").collect()
    assert len(rows) >= 9 and {r.total_tokens for r in rows} <= {3, 2} and {r.reported_total for r in rows} == {None}
    events = records.import_events(records.import_documents(docs), "s", "json").collect()
    assert len(events) >= 9 and {r.input_tokens for r in events} == {0}


def test_rescans_never_change_totals(spark, tmp_path):
    write(tmp_path / "logs", "a.jsonl", [message(mid=f"m{i}") for i in range(5)])
    path = str(tmp_path / "events")
    for n in range(3):
        events = extract.message_usage(lines.read_lines(spark, str(tmp_path / "logs")), "claude", KEY)
        got = store.insert_new(events, path, "event_id", ["occurred_at_raw"])
        assert got == ({"inserted": 5, "duplicates": 0} if n == 0 else {"inserted": 0, "duplicates": 5})
    assert rollup.daily_totals(spark.read.parquet(path)).first()["total_tokens"] == 5 * 1410


def test_listing(spark, tmp_path):
    write(tmp_path / "x" / "y", "a.jsonl", ["{}"])
    write(tmp_path, "b.txt", ["{}"])
    assert [r["size"] for r in lines.list_files(spark, str(tmp_path)).collect()] == [3]
    assert lines.detect(spark, {"here": (str(tmp_path), "*.jsonl"), "gone": (str(tmp_path / "no"), "*")}) == {"here": 1, "gone": 0}
    assert lines.roots("/a", " /b , /c ") == ["/b", "/c"] and lines.roots("/a", "") == ["/a"]
    kept = lines.read_lines(spark, str(tmp_path), "*.jsonl", keywords=["usage"])
    assert kept.count() == 0

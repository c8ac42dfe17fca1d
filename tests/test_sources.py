"""Daily documents and imports."""

import json

import pytest
from pyspark.sql import functions as F

from tallyworks.operators import merge, rollup
from tallyworks.sources import records


def docs(spark, *bodies):
    return spark.createDataFrame([(i, b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)], "source int, document string")


def test_malformed_daily_feed_never_sums_duplicates(spark):
    day = lambda date, i, o, **more: {"date": date, "inputTokens": i, "outputTokens": o} | more
    feed = {"daily": [day("2026-05-01", 60, 40, totalTokens=999999, modelsUsed=["claude-a", "/etc/x"]), day("2026-05-01", 200, 100, models=["claude-b"], totalCost="$1,234.5"), day("2026-05-02", 0, 0), {"inputTokens": 5}, {"nested": day("2026-05-03", "10", 20, model="m1")}], "totals": {"inputTokens": 1}}
    rows = records.daily_rows(docs(spark, feed, "not json"), "claude")
    assert rows.count() == 3
    got = {str(r["date"]): r for r in merge.keep_max(rows.drop("source", "reported_total")).collect()}
    assert {k: r["total_tokens"] for k, r in got.items()} == {"2026-05-01": 300, "2026-05-03": 30}
    assert got["2026-05-01"]["models"] == ["claude-a", "claude-b"] and got["2026-05-01"]["estimated_cost_usd"] == 1234.5
    assert {r["warning"].split(":")[0] for r in merge.warnings(rows).collect()} == {"duplicate-daily-row", "reported-total-mismatch"}
    assert merge.sum_duplicates(rows).agg(F.sum("total_tokens")).first()[0] > 1_000_000


def test_precedence_and_costs(spark):
    a = spark.createDataFrame([("2026-01-01", "claude", 5)], "date string, provider string, total_tokens long")
    b = spark.createDataFrame([("2026-01-01", "claude", 9), ("2026-01-01", "amp", 2)], a.schema)
    assert sorted((r["provider"], r["total_tokens"]) for r in merge.fill_absent(a, b).collect()) == [("amp", 2), ("claude", 5)]
    d = spark.createDataFrame([("x", 1, 2, 3, 4, None), ("x", 1, 2, 3, 4, 0.5), ("y", 1, 1, 1, 1, None)], "provider string, input_tokens long, output_tokens long, cache_creation_tokens long, cache_read_tokens long, estimated_cost_usd double")
    got = {r["provider"]: (r["total_tokens"], r["estimated_cost_usd"]) for r in rollup.provider_summary(d).collect()}
    assert got == {"x": (20, 0.5), "y": (4, None), None: (24, 0.5)}


def test_csv_import(spark, tmp_path):
    f = tmp_path / "export.csv"
    f.write_bytes(b'Usage Date,Vendor,Model Name,Prompt,Prompt Tokens,completion_tokens,Total Tokens\r\n2026-01-02,"Acme, Inc",gpt-4,"say ""hi""\nthere","1,000",500,\r\n05/06/2026,x,,t,1,1,99\r\n\r\n,x,m,t,1,1,1\r\n2026-01-03,x,m,t,0,0,0\r\n')
    raw = records.read_csv(spark, str(f))
    rows = records.import_table(raw, F.monotonically_increasing_id() + 1)
    e = records.import_events(rows, "mine", "csv")
    got = sorted((str(r["local_date"]), r["provider"], r["total_tokens"], r["origin"], r["confidence"]) for r in e.collect())
    assert got == [("2026-01-02", "Acme Inc", 1500, "imported", "low"), ("2026-05-06", "x", 99, "imported", "low")]
    assert {r["event_id"] for r in e.collect()} == {r["event_id"] for r in e.collect()}
    s = records.import_summary(rows, e).first()
    assert (s["imported"], s["skipped"], s["total_tokens"]) == (2, 2, 1599)


def test_json_import_finds_records_at_any_depth(spark):
    d = docs(spark, {"a": {"rows": [{"Day": "2026-01-02", "tokens": 7, "sub": {"createdAt": "2026-01-04", "output": 3}}]}, "b": [{"date": 1767225600, "input": 5}]})
    e = records.import_events(records.import_documents(d), "x", "json")
    assert sorted((str(r["local_date"]), r["total_tokens"]) for r in e.collect()) == [("2026-01-01", 5), ("2026-01-02", 7), ("2026-01-04", 3)]


@pytest.mark.parametrize("content,name,chosen,kind", [("a,b", "", "auto", "csv"), (" [1]", "", "auto", "json"), ("{", "x.CSV", "auto", "csv"), ("{", "x.csv", "json", "json")])
def test_formats(content, name, chosen, kind):
    assert records.detect_format(content, name, chosen) == kind


def test_imported_rows_stay_apart(spark):
    e = spark.createDataFrame([("local_log", "claude", 5), ("imported", "claude", 100)], "origin string, provider string, total_tokens long").withColumns({c: F.lit(1) for c in ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens")}).withColumn("local_date", F.to_date(F.lit("2026-01-01"))).withColumn("occurred_at", F.current_timestamp())
    assert rollup.daily_totals(e).first()["total_tokens"] == 5

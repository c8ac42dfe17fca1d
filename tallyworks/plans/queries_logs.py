"""Queries over logs, feeds and imports made of the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values
from ..operators import extract, partials, rollup, store
from ..session import scratch
from ..sources import documents, lines, records, roots
from .views import DAILY_SQL, USAGE_SQL, daily, spread, table, usage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
KEY = b"tallyworks-test-key"


def query(sql: str) -> Callable[[Callable[[SparkSession, str], DataFrame]], Callable[[SparkSession, str], DataFrame]]:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


_E = "e AS (SELECT event_id AS id, user_id, ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events)"
_ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"
_FILE = "concat('log-', CAST(user_id AS VARCHAR))"


def numbered(spark: SparkSession, d: str) -> DataFrame:
    """id, user_id, ts, k, at (ISO text) of the events."""
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), "user_id", "ts", F.get_json_object("props", "$.k").cast("long").alias("k"), F.date_format("ts", _ISO).alias("at"))


def as_lines(df: DataFrame, line: Column, seq: Column) -> DataFrame:
    """Lines of a log for each user."""
    return df.select(F.concat(F.lit("log-"), F.col("user_id").cast("string")).alias("file"), F.col("ts").cast("timestamp").alias("modified"), F.lit(0).alias("block"), seq.alias("seq"), line.alias("line"))


def packed(**fields: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in fields.items()])


@query(
    f"""WITH {_E} SELECT substr(sha256(concat('claude|msg:', 'm' || CAST(id % 100 AS VARCHAR), '|req:', 'r' || CAST(id AS VARCHAR))), 1, 32) AS event_id, iso AS occurred_at_raw,
  CASE WHEN k % 10 <> 0 THEN concat('claude-', CAST(k % 5 AS VARCHAR)) END AS model, k + 1 AS input_tokens, k % 5 AS output_tokens, CASE WHEN k % 3 = 0 THEN 0 ELSE k END AS cache_read_tokens, k + 1 + k % 5 + CASE WHEN k % 3 = 0 THEN 0 ELSE k END AS total_tokens FROM e WHERE k % 4 <> 0"""
)
def message_events(spark, d):
    """Format A: usage in each line; broken lines give nothing, path-like models are dropped."""
    e, k = numbered(spark, d), F.col("k")
    usage_ = packed(input_tokens=k + 1, output_tokens=k % 5, cache_read_input_tokens=F.when(k % 3 != 0, k).otherwise(-1))
    message = packed(id=F.concat(F.lit("m"), (F.col("id") % 100).cast("string")), model=F.when(k % 10 == 0, "../x").otherwise(F.concat(F.lit("claude-"), (k % 5).cast("string"))), usage=usage_)
    line = F.to_json(packed(timestamp=F.col("at"), sessionId=F.lit("s"), requestId=F.concat(F.lit("r"), F.col("id").cast("string")), message=message))
    found = extract.message_usage(as_lines(e, F.when(k % 4 == 0, F.concat(F.lit("{broken tokens "), line)).otherwise(line), F.col("id")), "claude", KEY)
    return found.select("event_id", "occurred_at_raw", "model", "input_tokens", "output_tokens", "cache_read_tokens", "total_tokens")


_TURNS = f"""{_E}, o AS (SELECT *, {_FILE} AS file, row_number() OVER (PARTITION BY user_id ORDER BY ts, id) AS n FROM e),
t AS (SELECT *, last_value(CASE WHEN k % 4 = 0 THEN concat('m', CAST(k % 7 AS VARCHAR), '-x') END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS model FROM o)"""


@query(
    f"""WITH {_TURNS}, x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n) AS turn, substr(sha256(file), 1, 24) AS print FROM t WHERE k % 6 <> 0)
SELECT substr(sha256(concat_ws('|', 'codex', iso, coalesce(model, ''), k + 5 - k % 5, 2, k % 5, print, turn)), 1, 32) AS event_id, model, k + 5 - k % 5 AS input_tokens, 2::BIGINT AS output_tokens, k % 5 AS cache_read_tokens, k + 7 AS total_tokens FROM x"""
)
def turn_events(spark, d):
    """Format B: each turn's usage under the model named before it; turns without usage and running totals are passed over."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "id"))
    e, k = numbered(spark, d).withColumn("n", n), F.col("k")
    context = F.to_json(packed(type=F.lit("turn_context"), timestamp=F.col("at"), payload=packed(model=F.concat(F.lit("m"), (k % 7).cast("string"), F.lit("-x")))))
    last = packed(input_tokens=k + 5, cached_input_tokens=k % 5, output_tokens=F.lit(2))
    info = packed(total_token_usage=last, last_token_usage=F.when(k % 6 != 0, last))
    turn = F.to_json(packed(timestamp=F.col("at"), payload=packed(type=F.lit("token_count"), info=info)))
    both = as_lines(e.filter(k % 4 == 0), context, F.col("n") * 2).union(as_lines(e, turn, F.col("n") * 2 + 1))
    both = both.withColumn("block", F.floor(F.col("seq") / 25))  # a file comes in blocks
    return extract.turn_deltas(both, "codex").select("event_id", "model", "input_tokens", "output_tokens", "cache_read_tokens", "total_tokens")


@query(
    f"""WITH {_TURNS}, l AS (SELECT *, sum(k + 3) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS so_far FROM o),
f AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1)
SELECT substr(sha256(concat('grok|', file)), 1, 32) AS event_id, concat('g', CAST(k % 3 AS VARCHAR), '-y') AS model, CAST(so_far - 3 AS BIGINT) AS input_tokens, 7::BIGINT AS output_tokens, 3::BIGINT AS cache_read_tokens, CAST(so_far + 7 AS BIGINT) AS total_tokens, iso AS occurred FROM f"""
)
def file_totals(spark, d):
    """Format C: totals so far, found at any depth of a line; a file's last line counts."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "id")
    e, k = numbered(spark, d).withColumns({"n": F.row_number().over(w), "so_far": F.sum(F.col("k") + 3).over(w)}), F.col("k")
    early = packed(usage=packed(inputTokens=F.lit(1), outputTokens=F.lit(1)))
    late = packed(usage=packed(inputTokens=F.col("so_far"), outputTokens=F.lit(7), cachedReadTokens=F.lit(3)), model=F.concat(F.lit("g"), (k % 3).cast("string"), F.lit("-y")))
    # the walk meets later children first, so that the usage of the first list entry is the last one met
    line = F.concat(F.lit('{"timestamp":"'), "at", F.lit('","inner":{"list":['), F.to_json(late), F.lit(","), F.to_json(early), F.lit("]}}"))
    found = extract.cumulative_final(as_lines(e, line, F.col("n")), "grok")
    return found.select("event_id", "model", "input_tokens", "output_tokens", "cache_read_tokens", "total_tokens", F.date_format("occurred_at", _ISO).alias("occurred"))


@query(
    f"""WITH {_E} SELECT substr(sha256(concat('kimi|', {_FILE}, '|t', CAST(id AS VARCHAR))), 1, 32) AS event_id, CASE WHEN k % 2 = 0 THEN 'k2-a' ELSE 'k2-b' END AS model, k AS input_tokens, 4::BIGINT AS output_tokens, k % 3 AS cache_read_tokens, k % 2 AS cache_creation_tokens, k + 4 + k % 3 + k % 2 AS total_tokens FROM e WHERE k % 3 <> 0"""
)
def record_events(spark, d):
    """Format D: records scoped to a turn, under two spellings; those scoped to a session are left out."""
    e, k = numbered(spark, d), F.col("k")
    model = F.when(k % 2 == 0, "k2-a").otherwise("k2-b")
    key = F.concat(F.lit("t"), F.col("id").cast("string"))
    flat = F.to_json(packed(type=F.lit("usage.record"), scope=F.when(k % 3 == 0, "session").otherwise("turn"), timestamp=F.col("at"), messageId=key, model=model, usage=packed(inputOther=k, output=F.lit(4), inputCacheRead=k % 3, inputCacheCreation=k % 2)))
    deep = F.to_json(packed(type=F.lit("StatusUpdate"), timestamp=F.col("at"), message_id=key, model=model, payload=packed(scope=F.when(k % 3 == 0, "cumulative"), token_usage=packed(input_other=k, output=F.lit(4), input_cache_read=k % 3, input_cache_creation=k % 2))))
    found = extract.turn_records(as_lines(e, F.when(k % 5 == 0, flat).otherwise(deep), F.col("id")), "kimi")
    return found.select("event_id", "model", "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "total_tokens")


# Numbers that are no counts, by id % 7; the last one is a count.
_ODD = ["1e300", "1" + "0" * 400, "-1", "NaN", "null", "9007199254740994", "5"]


@query(
    f"""WITH {_E}, f AS (SELECT *, unnest(['message', 'turn', 'total', 'record']) AS format, CASE WHEN id % 7 = 6 THEN 5 ELSE 0 END AS good FROM e)
SELECT format, id % 7 AS odd, count(*) AS events, sum(3 + good)::BIGINT AS total_tokens, sum(good)::BIGINT AS input_tokens,
  count(*) FILTER (format IN ('total', 'record') OR id % 7 <> 0) AS dated FROM f WHERE format IN ('total', 'record') OR id % 7 <> 0 GROUP BY ALL"""
)
def unusable_numbers(spark, d):
    """Lines of each format with numbers that are no counts, and times beyond the calendar: they count as none, whatever stands beside them counts."""
    e = numbered(spark, d).withColumn("user_id", F.col("id"))  # a file for each event
    odd = F.element_at(F.array(*map(F.lit, _ODD)), (F.col("id") % 7 + 1).cast("int"))
    # where the input is 1e300 the time is too: formats A and B have no event without one, C and D take the file's
    time = F.when(F.col("id") % 7 == 0, "1e300").otherwise(F.concat(F.lit('"'), "at", F.lit('"')))
    line = lambda *parts: F.concat(F.lit('{"timestamp":'), time, *[F.lit(p) if isinstance(p, str) else p for p in parts])
    of = lambda text: as_lines(e, text, F.col("id"))
    found = {
        "message": extract.message_usage(of(line(',"message":{"id":"m', F.col("id").cast("string"), '","usage":{"input_tokens":', odd, ',"output_tokens":3}}}')), "claude", KEY),
        "turn": extract.turn_deltas(of(line(',"payload":{"type":"token_count","info":{"last_token_usage":{"input_tokens":', odd, ',"output_tokens":3}}}}')), "codex"),
        "total": extract.cumulative_final(of(line(',"usage":{"inputTokens":', odd, ',"outputTokens":3}}')), "grok"),
        "record": extract.turn_records(of(line(',"usage":{"input_other":', odd, ',"output":3}}')), "kimi"),
    }
    # the number's kind is told by the event's file
    kinds = e.select(extract.fingerprint(F.concat(F.lit("log-"), F.col("id").cast("string"))).alias("source_fingerprint"), (F.col("id") % 7).alias("odd")).hint("merge")  # a row for each event, too many to broadcast
    parts = [x.join(kinds, "source_fingerprint").groupBy("odd").agg(F.count("*").alias("events"), F.sum("total_tokens").alias("total_tokens"), F.sum("input_tokens").alias("input_tokens"), F.count("occurred_at").alias("dated")).withColumn("format", F.lit(name)) for name, x in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(f"WITH {_E} SELECT {_FILE} AS file, count(*) AS malformed FROM e WHERE k % 4 = 0 GROUP BY 1")
def malformed_lines(spark, d):
    e = numbered(spark, d)
    line = F.when(F.col("k") % 4 == 0, '{"a": ').when(F.col("k") % 4 == 1, "  ").otherwise('{"a": 1}')
    return lines.malformed(as_lines(e, line, F.col("id")))


@query(f"WITH {_E} SELECT count(*) AS lines, count(*) FILTER (k % 2 = 0) AS marked, count(DISTINCT user_id) AS files, count(DISTINCT user_id) FILTER (user_id % 2 = 0) AS some FROM e")
def log_files(spark, d):
    """Files below a root: listed, counted by source, and read as lines, some by a keyword."""
    e, root = numbered(spark, d), scratch(spark, "logs")
    text = F.concat(F.when(F.col("k") % 2 == 0, "marked ").otherwise("plain "), F.col("k").cast("string"))
    logs = e.select(F.concat(F.lit("even"), (F.col("user_id") % 2).cast("string")).alias("kind"), "user_id", text.alias("line")).transform(spread, "user_id")
    lines.write_lines(logs, root, ["kind", "user_id"])
    found = lines.detect(spark, {"all": (root, "*.txt"), "even": (f"{root}/kind=even0", "*.txt"), "none": (f"{root}/nothing", "*.txt")})
    # one listing and one scan for both counts, a kind at a time
    counts = [lines.read_lines(spark, kind, "*.txt").agg(F.count("*"), F.count_if(lines.has_any("line", ["marked"]))).first() for kind in lines.folders(spark, root)]
    return spark.createDataFrame([(sum(c[0] for c in counts), sum(c[1] for c in counts), found["all"] + found["none"], found["even"])], "lines long, marked long, files long, some long")


@query(f"""WITH {DAILY_SQL} SELECT provider, date, input_tokens, output_tokens, cache_creation_tokens, cache_read_tokens, total_tokens, CASE WHEN day(date) % 2 = 0 THEN total_tokens + 1 ELSE -1 END AS reported_total, array_to_string(models[1:8], ',') AS models FROM d WHERE total_tokens > 0""")
def daily_feed(spark, d):
    """Daily records found at any depth of a provider's document, with totals that disagree with their parts."""
    x = daily(spark, d).withColumn("stated", F.col("total_tokens") + F.when(F.dayofmonth("date") % 2 == 0, 1).otherwise(0))
    day = packed(date=F.date_format("date", "yyyy-MM-dd"), inputTokens=F.col("input_tokens"), output=F.col("output_tokens"), cacheWriteTokens=F.col("cache_creation_tokens"), cachedInputTokens=F.col("cache_read_tokens"), totalTokens=F.col("stated").cast("string"), modelsUsed=F.col("models"))
    docs = x.groupBy(F.col("provider").alias("source")).agg(F.to_json(packed(report=packed(daily=F.collect_list(day)), totals=packed(totalTokens=F.sum("total_tokens")))).alias("document"))
    rows = docs.select("source", F.regexp_replace("document", r'"date":', F.concat(F.lit('"agent":"'), "source", F.lit('","date":'))).alias("document"))
    found = records.daily_rows(rows.union(spark.createDataFrame([("broken", "{"), ("none", None)], rows.schema)), "unknown")
    return found.select("provider", "date", "input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "total_tokens", F.coalesce("reported_total", F.lit(-1)).alias("reported_total"), F.array_join("models", ",").alias("models"))


_ORDERS = "o AS (SELECT o_orderkey, o_custkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, o_orderpriority FROM orders WHERE o_orderkey % 7 <> 0)"


@query(f"WITH {_ORDERS} SELECT CAST(day AS DATE) AS local_date, count(*) AS events, CAST(sum(o_custkey + 5) AS BIGINT) AS total_tokens FROM o GROUP BY 1")
def json_import(spark, d):
    """Objects with a date and usage at any depth of JSON exports."""
    o = table(spark, d, "orders").filter("o_orderkey % 7 <> 0")
    one = packed(Usage_Date=F.date_format("o_orderdate", "yyyy-MM-dd"), tool=F.col("o_orderpriority"), promptTokens=F.col("o_custkey"), completionTokens=F.lit("5"))
    docs = o.groupBy(F.pmod("o_orderkey", F.lit(50)).alias("file")).agg(F.to_json(packed(exports=F.array(packed(items=F.collect_list(one))))).alias("document"))
    e = records.import_events(records.import_documents(docs), "orders", "json")
    return e.groupBy("local_date").agg(F.count("*").alias("events"), F.sum("total_tokens").alias("total_tokens"))


@query(f"""WITH {_ORDERS} SELECT CAST(day AS DATE) AS local_date, trim(regexp_replace(o_orderpriority || ', "x"', '[^a-zA-Z0-9 ._:/-]', '', 'g')) AS provider, count(*) AS events, CAST(sum(o_custkey) AS BIGINT) AS total_tokens FROM o WHERE o_custkey > 0 GROUP BY 1, 2""")
def csv_import(spark, d):
    """A CSV file with quoted commas and doubled quotes, written and read back."""
    o, root = table(spark, d, "orders").filter("o_orderkey % 7 <> 0"), scratch(spark, "csv")
    rows = o.select(F.date_format("o_orderdate", "MM/dd/yyyy").alias("Usage Date"), F.concat("o_orderpriority", F.lit(', "x"')).alias("Tool"), F.col("o_custkey").alias("Total Tokens"))
    rows.write.option("header", True).option("escape", '"').csv(root)
    read = records.read_csv(spark, root)
    e = records.import_events(records.import_table(read, F.monotonically_increasing_id()), "orders", "csv")
    return e.groupBy("local_date", "provider").agg(F.count("*").alias("events"), F.sum("total_tokens").alias("total_tokens"))


@query("SELECT n_name AS source, concat(n_name, CASE n_nationkey % 5 WHEN 0 THEN ' timed out after 60000ms' WHEN 1 THEN ' failed' WHEN 2 THEN concat(' exited ', n_nationkey) ELSE ' did not return parseable JSON' END) AS warning FROM nation WHERE n_nationkey % 5 <> 4")
def source_warnings(spark, d):
    k = F.col("n_nationkey")
    runs = table(spark, d, "nation").select(F.col("n_name").alias("source"), F.when(k % 5 == 4, '{"a": 1}').otherwise("{").alias("document"), F.when(k % 5 != 1, F.when(k % 5 == 2, k).otherwise(0)).alias("status"), (k % 5 == 0).alias("timed_out"), F.lit(60_000).alias("limit_ms"))
    return documents.failed_sources(runs)


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'unreachable' WHEN c_custkey % 5 = 1 THEN 'unreachable' WHEN c_custkey % 5 = 2 THEN 'unreachable' ELSE 'landed' END AS state,
  CASE c_custkey % 5 WHEN 0 THEN 'not fetched' WHEN 1 THEN 'HTTP 404' WHEN 2 THEN 'no JSON object' END AS error, CASE WHEN c_custkey % 5 > 2 THEN c_custkey % 90 ELSE -1 END AS active_days, CASE WHEN c_custkey % 5 > 2 THEN 'tool a,tool b' ELSE '' END AS tools FROM customer"""
)
def member_snapshots(spark, d):
    """Landed snapshots by member, one failure each in its own row."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    activity = packed(activeDays=k % 90, toolsUsed=F.array(F.lit(" tool a "), F.lit("tool b")))
    document = F.when(k % 5 == 2, "[1, 2]").otherwise(F.to_json(packed(profile=packed(activity=activity), totals=packed(totalTokens=k))))
    landed = c.filter(k % 5 != 0).select(F.col("c_name").alias("handle"), F.when(k % 5 == 1, 404).otherwise(200).alias("status"), document.alias("document"), F.lit(1).alias("landed_at"))
    old = landed.select("handle", F.lit(500).alias("status"), F.lit("{").alias("document"), F.lit(0).alias("landed_at"))
    got = documents.member_profiles(c.select(F.col("c_name").alias("handle"), "c_custkey"), landed.union(old))
    return got.select("c_custkey", "state", "error", F.coalesce("active_days", F.lit(-1)).alias("active_days"), F.array_join("tools", ",").alias("tools"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS \"index\", n_name AS name, 'absent' AS missing FROM nation WHERE n_nationkey < 20")
def document_history(spark, d):
    """Snapshots appended twice, read by index up to a bound; the latest one replaced; a place that is not there."""
    n, path, latest = table(spark, d, "nation").select(F.col("n_nationkey"), F.col("n_name").alias("name")), scratch(spark, "history"), scratch(spark, "latest")
    documents.append_history(n.filter("n_nationkey < 9"), path, ["n_nationkey"])
    documents.append_history(n.filter("n_nationkey >= 9"), path, ["n_nationkey"])
    for low in (0, 3):
        documents.replace_latest(n.filter(F.col("n_nationkey") >= low), latest)
    absent = documents.read_documents(spark, f"{path}-nowhere").isEmpty() and documents.history(spark, f"{path}-nowhere") is None and spark.read.parquet(latest).count() == 22
    return documents.history(spark, path, 20).select("index", "name", F.lit("absent" if absent else "there").alias("missing"))


@query("SELECT concat('r', CAST(r AS VARCHAR)) AS root, CASE r WHEN 0 THEN 'unchanged' WHEN 1 THEN 'changed' WHEN 2 THEN 'new' WHEN 3 THEN 'gone' ELSE 'unchanged' END AS state FROM range(5) t(r)")
def root_changes(spark, d):
    """Signatures of scan roots: one grew, one is new, one is gone, one stays empty."""
    p = table(spark, d, "part").select(F.concat(F.lit("r"), (F.col("p_partkey") % 3).cast("string")).alias("root"), F.col("p_name").alias("file"), F.col("p_size").alias("size"), F.lit(0).alias("modified"))
    names = lambda *ns: spark.createDataFrame([(f"r{i}",) for i in ns], "root string")
    before = roots.signatures(p.filter("root <> 'r2'").union(p.limit(1).select(F.lit("r3").alias("root"), "file", "size", "modified")), names(0, 1, 3, 4))
    grown = p.withColumn("size", F.when(F.col("root") == "r1", F.col("size") + 1).otherwise(F.col("size")))
    return roots.changes(roots.signatures(grown, names(0, 1, 2, 4)), before).select("root", "state")


@query(f"WITH {USAGE_SQL} SELECT provider, count(*) AS events, CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM u GROUP BY 1")
def stored_events(spark, d):
    """Events inserted in overlapping batches, some then replaced: each is stored once, as last written. Keys are found by the store's index."""
    u, path = usage(spark, d).select("event_id", "provider", "total_tokens", "local_date", "k", F.lit(0).alias("written")), scratch(spark, "store")
    for part in ("k % 3 = 0", "k % 3 < 2"):
        store.insert_new(u.filter(part).withColumn("total_tokens", F.col("total_tokens") + F.when(F.col("k") % 4 == 0, 1).otherwise(0)), path, "event_id", ["event_id"], ["local_date"], index_from=0)
    store.insert_or_replace(u.withColumn("written", F.lit(1)), path, "event_id", ["written"], ["local_date"], index_from=0)
    return spark.read.parquet(path).groupBy("provider").agg(F.count("*").alias("events"), F.sum("total_tokens").alias("total_tokens"))


@query(f"WITH {USAGE_SQL} SELECT local_date AS date, provider, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, count(*) AS rows FROM u WHERE origin = 'local_log' GROUP BY 1, 2")
def kept_totals(spark, d):
    """Daily totals of measured events that follow a store through inserts and replacements, each file summed once."""
    u, path = usage(spark, d).select("event_id", "provider", "total_tokens", "input_tokens", "local_date", "origin", "k", F.lit(0).alias("written")), scratch(spark, "store")
    totals = partials.Totals(spark, path, scratch(spark, "totals"), ["local_date", "provider"], ["total_tokens", "input_tokens"], F.col("origin") == "local_log")
    for part in ("k % 3 = 0", "k % 3 < 2"):
        store.insert_new(u.filter(part).withColumn("total_tokens", F.col("total_tokens") + F.when(F.col("k") % 4 == 0, 1).otherwise(0)), path, "event_id", ["event_id"], ["local_date"])
        totals.refresh()
    store.insert_or_replace(u.withColumn("written", F.lit(1)), path, "event_id", ["written"], ["local_date"])
    return totals.current().withColumnRenamed("local_date", "date")


@query("SELECT * FROM (VALUES ('absent', 'empty'), ('first', 'written'), ('again', 'same'), ('changed', 'written')) v(step, result)")
def idempotent_writes(spark, d):
    n, path = table(spark, d, "nation").repartition(3), scratch(spark, "idempotent")
    steps = [("absent", n.limit(0)), ("first", n), ("again", n.repartition(2)), ("changed", n.filter("n_nationkey > 1"))]
    return spark.createDataFrame([(s, store.write_if_changed(df, path, ["n_nationkey"])) for s, df in steps], "step string, result string")


@query("SELECT CASE WHEN p_partkey % 4 = 0 THEN 'docs' WHEN p_partkey % 4 = 1 THEN 'py' END AS kind, count(*) AS files, max(p_size) AS latest FROM part GROUP BY 1")
def file_kinds(spark, d):
    k = F.col("p_partkey")
    files = table(spark, d, "part").select(F.concat("p_name", F.when(k % 4 == 0, ".MD").when(k % 4 == 1, ".py").otherwise(".bin")).alias("file"), F.col("p_size").alias("modified"))
    return rollup.files_by_kind(files)


@query(f"WITH {_E} SELECT id, CASE WHEN k % 3 < 2 THEN iso END AS \"at\" FROM e")
def time_aliases(spark, d):
    """Times as ISO texts, as epoch seconds or milliseconds, or as neither."""
    e, k = numbered(spark, d), F.col("k")
    number = F.when(k % 3 == 1, F.when(k % 2 == 0, F.unix_timestamp("ts")).otherwise(F.unix_timestamp("ts") * 1000)).cast("double")
    at = values.any_time(F.when(k % 3 == 0, F.col("at")).otherwise("soon"), number)
    return e.select("id", F.date_format(at, _ISO).alias("at"))

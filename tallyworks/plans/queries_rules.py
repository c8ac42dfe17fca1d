"""Queries over rules, texts, publication and the directory, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, values
from ..operators import blocks, derive, directory, merge, publish, rollup, rules, secrets, store
from ..streaming import limits
from .views import DAILY_SQL, MEMBERS_SQL, USAGE_SQL, daily, members, spread, table, usage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Callable[[SparkSession, str], DataFrame]], Callable[[SparkSession, str], DataFrame]]:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN lower(replace(p_brand, '#', '-')) END AS model, CASE WHEN p_partkey % 3 = 0 THEN lower(replace(p_brand, '#', '-')) || ',' ELSE '' END || 'm' || CAST(p_size AS VARCHAR) AS models FROM part"""
)
def model_names(spark, d):
    """Plain identifiers pass, others do not; lists are trimmed, and hold each once."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    name = F.when(k % 3 == 0, F.lower(F.replace("p_brand", F.lit("#"), F.lit("-")))).when(k % 3 == 1, F.col("p_brand")).otherwise("x")
    many = F.array(F.concat(F.lit(" "), name), F.concat(F.lit("m"), F.col("p_size").cast("string")), name, F.lit("../y"))
    return p.select("p_partkey", text.safe_model(name).alias("model"), F.array_join(text.safe_models(many), ",").alias("models"))


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN substr(c_name, 1, 9) END AS name, array_to_string(list_filter([c_mktsegment[1:4], CASE WHEN c_custkey % 2 = 0 THEN 'x' END], lambda e: e IS NOT NULL), ',') AS texts,
  coalesce(nullif(substr(trim(regexp_replace(concat('<', c_name, '>', CASE WHEN c_custkey % 4 = 0 THEN '/a:b' ELSE '' END), '[^a-zA-Z0-9 ._:/-]', '', 'g')), 1, 40), ''), 'none') AS label FROM customer"""
)
def cleaned_texts(spark, d):
    """Texts of third parties: trimmed, without marks that turn the writing direction, cut to length."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    turned = F.when(k % 9 == 0, " ‮ ").otherwise(F.concat(F.lit(" ‮"), "c_name", F.lit("⁦ ")))
    some = F.array(F.concat(F.lit("‏"), "c_mktsegment"), F.when(k % 2 == 0, "x"), F.lit(" ‭"))
    label = F.concat(F.lit("<"), "c_name", F.lit(">"), F.when(k % 4 == 0, "/a:b").otherwise(""))
    return c.select("c_custkey", text.clean_text(turned, 9).alias("name"), F.array_join(text.clean_texts(some, 24, 4), ",").alias("texts"), text.safe_label(label, 40, "none").alias("label"))


@query(
    r"""SELECT page_id, sha256(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS xml, sha256(regexp_replace(regexp_replace(html, '([\\|*_`\[\]<>])', '\\\1', 'g'), '\s+', ' ', 'g')) AS markdown FROM pages"""
)
def escapes(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(text.xml_escape(F.col("html")), 256).alias("xml"), F.sha2(text.markdown_escape(F.col("html")), 256).alias("markdown"))


@query(
    """SELECT c_custkey, round(list_sum(list_transform(string_split(x, ''), lambda c: CASE WHEN regexp_matches(c, '[ijl.,:;''|!]') THEN 0.32 WHEN regexp_matches(c, '[mwMW@%]') THEN 0.86 ELSE 0.56 END))::DOUBLE, 6) AS width FROM (SELECT c_custkey, lower(c_name) || '@' || c_mktsegment AS x FROM customer)"""
)
def text_widths(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", F.round(text.text_width(F.concat(F.lower("c_name"), F.lit("@"), "c_mktsegment")), 6).alias("width"))


@query(
    f"""WITH {DAILY_SQL}, t AS (SELECT provider, CAST(sum(total_tokens) AS BIGINT) AS t, CAST(sum(cached_tokens) AS BIGINT) AS c, CAST(sum(fresh_tokens) AS BIGINT) AS f FROM d GROUP BY 1),
s AS (SELECT provider, unnest([t, f]) AS x, unnest(['tokens', 'fresh tokens']) AS label FROM t)
SELECT provider, label, CASE WHEN x >= 1000000000 THEN printf('%d.%02dB', (x * 100 + 500000000) // 1000000000 // 100, (x * 100 + 500000000) // 1000000000 % 100) WHEN x >= 1000000 THEN printf('%d.%dM', (x * 10 + 500000) // 1000000 // 10, (x * 10 + 500000) // 1000000 % 10) WHEN x >= 1000 THEN printf('%d.%dK', (x * 10 + 500) // 1000 // 10, (x * 10 + 500) // 1000 % 10) ELSE CAST(x AS VARCHAR) END || CASE WHEN label = 'tokens' THEN ' tok' ELSE '' END AS value FROM s
UNION ALL SELECT provider, 'cached', printf('%d.%d%%', (c * 1000 * 2 + t) // (2 * t) // 10, (c * 1000 * 2 + t) // (2 * t) % 10) FROM t"""
)
def badge_values(spark, d):
    """Label and value of a badge, for each metric."""
    t = rollup.provider_summary(daily(spark, d)).filter("provider is not null")
    totals = {c: F.col(c) for c in ("total_tokens", "fresh_tokens", "cached_tokens", "estimated_cost_usd")}
    shown = [F.struct(a.alias("label"), b.alias("value")) for a, b in (text.badge_metric(m, totals) for m in ("total", "fresh", "cached"))]
    return t.select("provider", F.inline(F.array(*shown)))


_AGO = "CASE WHEN s < 60 THEN concat(s, 's ago') WHEN s < 3600 THEN concat(s // 60, 'm ago') WHEN s < 86400 THEN concat(s // 3600, 'h ago') ELSE concat(s // 86400, 'd ago') END"
_MINUTES = "CAST(floor(s / 60 + 0.5) AS BIGINT) AS m"


@query(
    f"""WITH e AS (SELECT event_id, greatest(CAST(epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(date_trunc('second', ts)) AS BIGINT), 0) % (1 + event_id * 37) AS s FROM events), m AS (SELECT *, {_MINUTES} FROM e), h AS (SELECT *, CAST(floor(m / 60 + 0.5) AS BIGINT) AS h FROM m)
SELECT event_id, {_AGO} AS seconds, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN concat(m, 'm ago') WHEN h < 24 THEN concat(h, 'h ago') ELSE concat(CAST(floor(h / 24 + 0.5) AS BIGINT), 'd ago') END AS rounded FROM h"""
)
def relative_times(spark, d):
    """How long ago, in both ways of rounding."""
    now = F.to_timestamp(F.lit("2024-01-31 00:00:00"))
    s = F.greatest(F.unix_timestamp(now) - F.unix_timestamp(F.date_trunc("second", F.col("ts").cast("timestamp"))), F.lit(0)) % (1 + F.col("event_id") * 37)
    e = table(spark, d, "events").select("event_id", F.timestamp_seconds(F.unix_timestamp(now) - s).alias("then"))
    return e.select("event_id", text.ago(F.col("then"), now).alias("seconds"), text.ago_rounded(F.col("then"), now).alias("rounded"))


@query(
    """SELECT l_orderkey, l_linenumber, CAST(floor(x + 0.5) AS BIGINT) AS rounded, CASE WHEN x BETWEEN 0 AND 100 THEN x END AS percent, greatest(-5.0, least(5.0, x))::DOUBLE AS clamped, CAST(floor(l_discount * 1e6 + 0.5) AS BIGINT) AS micro FROM (SELECT *, CAST(l_linenumber * 3 - l_quantity / 2 AS DOUBLE) AS x FROM lineitem)"""
)
def roundings(spark, d):
    """Halves go up, also below zero; shares and bounds."""
    x = (F.col("l_linenumber") * 3 - F.col("l_quantity") / 2).cast("double")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", values.js_round(x).alias("rounded"), values.safe_percent(x).alias("percent"), values.clamped(x, -5.0, 5.0).alias("clamped"), values.micro_usd(F.col("l_discount")).alias("micro"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey END AS ts, CAST(c_custkey % 3 AS BIGINT) AS \"docs\", 2::BIGINT AS entries FROM customer")
def counts_by_kind(spark, d):
    """Entries of a map whose keys fit, with values as counts."""
    k = F.col("c_custkey")
    m = F.create_map(F.lit("ts"), F.when(k % 3 == 0, -1).otherwise(k).cast("double"), F.lit("../x"), F.lit(9.0), F.lit("docs"), (k % 3).cast("double"))
    c = table(spark, d, "customer").select("c_custkey", values.counts_by_key(m, "^[a-z]{1,8}$").alias("m"))
    return c.select("c_custkey", F.col("m")["ts"].alias("ts"), F.col("m")["docs"].alias("docs"), F.size("m").cast("long").alias("entries"))


_PLAIN = "regexp_replace(CAST(c_acctbal AS VARCHAR), '\\.0$', '')"


@query(
    f"""SELECT c_custkey, sha256(concat('{{"balance":', {_PLAIN}, ',"generatedAt":"","list":[1,null,true,"é"],"name":"', c_name, '","verification":{{"snapshotSha256":""}}}}')) AS content,
  sha256(concat('{{"balance":', {_PLAIN}, ',"generatedAt":"t","list":[1,null,true,"é"],"name":"', c_name, '","verification":{{"snapshotSha256":""}}}}')) AS whole FROM customer"""
)
def canonical_documents(spark, d):
    """Hashes over the canonical form: keys in order, numbers as ECMAScript writes them, own hash and signature left out."""
    c = table(spark, d, "customer")
    doc = F.concat(F.lit('{"name": "'), "c_name", F.lit('", "list": [1.0, null, true, "\\u00e9"], "signature": {"x": 1}, "generatedAt": "t", "verification": {"snapshotSha256": "old"}, "balance": '), F.col("c_acctbal").cast("string"), F.lit("}"))
    return c.select("c_custkey", publish.document_hash(doc, content_only=True).alias("content"), publish.document_hash(doc).alias("whole"))


@query("""SELECT event_id, sha256(concat('{"generatedAt":"","k":', json_extract_string(props, '$.k'), ',"verification":{"snapshotSha256":""}}')) AS hash FROM events""")
def document_hashes(spark, d):
    return table(spark, d, "events").select("event_id", publish.document_hash(F.col("props"), content_only=True).alias("hash"))


@query(
    """WITH s AS (SELECT 'c' || CAST(c_custkey AS VARCHAR) AS signal, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS tier, CASE WHEN c_custkey % 3 = 0 THEN ['Expertise'] WHEN c_custkey % 7 = 0 THEN [] ELSE ['activity_occurred'] END AS allowed, CASE WHEN c_nationkey % 4 = 0 THEN ['expertise'] ELSE ['Identity', 'expertise'] END AS excluded FROM customer)
SELECT signal, CASE WHEN list_contains(list_transform(allowed, lambda x: lower(x)), 'expertise') THEN 'claims a universal non-claim' WHEN NOT list_contains(list_transform(excluded, lambda x: lower(x)), 'identity') THEN 'does not exclude identity' ELSE 'lacks a claim or tier' END AS problem FROM s
WHERE list_contains(list_transform(allowed, lambda x: lower(x)), 'expertise') OR NOT list_contains(list_transform(excluded, lambda x: lower(x)), 'identity') OR len(allowed) = 0 OR tier IS NULL"""
)
def ladder_check(spark, d):
    """Signals of the customers, beside those of the ladder: those with a problem. The ladder's own have none."""
    k = F.col("c_custkey")
    allowed = F.when(k % 3 == 0, F.array(F.lit("Expertise"))).when(k % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("activity_occurred")))
    excluded = F.when(F.col("c_nationkey") % 4 == 0, F.array(F.lit("expertise"))).otherwise(F.array(F.lit("Identity"), F.lit("expertise")))
    signals = table(spark, d, "customer").select(F.concat(F.lit("c"), k.cast("string")).alias("signal"), F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("tier"), allowed.alias("allowed"), excluded.alias("excluded"))
    return rules.ladder_problems(rules.ladder(spark).select("signal", "tier", "allowed", "excluded").union(signals))


@query(
    """WITH o AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS price, bool_or(o_orderstatus = 'F') AS done, bool_or(o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY 1),
c AS (SELECT c_custkey AS id, coalesce(n, 0) > 0 AS a, coalesce(price, 0) > 0 AS b, c_acctbal > 0 AS c, c_acctbal > 5000 AS d, false AS e, coalesce(done, false) AS f, coalesce(urgent, false) AS g FROM customer LEFT JOIN o ON o_custkey = c_custkey)
SELECT id, CAST(i AS INTEGER) AS ord, ['usage_observed', 'totals_derived', 'snapshot_hashed', 'snapshot_signed', 'identity_linked', 'work_linked', 'outcome_confirmed'][i + 1] AS step, [a, b, c, d, e, f, g][i + 1] AS reached FROM c, range(7) t(i)"""
)
def verification_steps(spark, d):
    """Steps of verification of the customers, by their orders and balance; what nothing speaks of is not reached."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.lit(True).alias("usage_observed"), (F.sum("o_totalprice") > 0).alias("totals_derived"), F.bool_or(F.col("o_orderstatus") == "F").alias("work_linked"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("outcome_confirmed"))
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") > 0).alias("snapshot_hashed"), (F.col("c_acctbal") > 5000).alias("snapshot_signed"))
    return rules.verification_steps(c.join(o, "c_custkey", "left").withColumnRenamed("c_custkey", "id"))


_CONSENT = """'{"sources": {"claude": ' || CASE WHEN c_nationkey % 9 = 0 THEN '"yes"' WHEN c_nationkey % 2 = 0 THEN 'true' ELSE 'false' END || ', "codex": false}, "directoryListing": {"answer": "' || CASE WHEN c_nationkey % 5 = 0 THEN 'declined' WHEN c_nationkey = 7 THEN 'yes' ELSE 'granted' END || '", "answeredVia": "tty-prompt", "answeredAt": "2026-01-01T00:00:00Z", "disclosureId": "' || CASE WHEN c_custkey % 4 = 0 THEN 'old' ELSE 'now' END || '", "disclosureSha256": "s", "handle": "' || CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE lower(c_name) END || '", "publicUrl": "u", "consentVersion": ' || CASE WHEN c_custkey % 11 = 0 THEN 'true' ELSE '1' END || ', "fieldsAtConsent": ["models", 3, "' || c_mktsegment || '"]' || CASE WHEN c_custkey % 13 = 0 THEN ', "withdrawnAt": ""' WHEN c_custkey % 6 = 0 THEN ', "withdrawnAt": "2026-02-02"' ELSE '' END || CASE WHEN c_custkey % 17 = 0 THEN '}' ELSE '}}' END"""


@query(
    f"""WITH r AS (SELECT c_custkey, CASE WHEN json_valid(x) THEN x END AS j FROM (SELECT c_custkey, {_CONSENT} AS x FROM customer)),
v AS (SELECT c_custkey, j, j IS NOT NULL AND json_type(j, '$.sources.claude') = 'BOOLEAN' AS ok, coalesce(j ->> '$.directoryListing.answer' IN ('granted', 'declined') AND j ->> '$.directoryListing.handle' <> '' AND json_type(j, '$.directoryListing.consentVersion') <> 'BOOLEAN' AND coalesce(j ->> '$.directoryListing.withdrawnAt', 'none') <> '', false) AS whole FROM r)
SELECT c_custkey, ok AS valid, CASE WHEN ok THEN CASE WHEN j ->> '$.sources.claude' = 'false' THEN 'claude,codex' ELSE 'codex' END END AS off, CASE WHEN ok AND whole THEN j ->> '$.directoryListing.handle' END AS handle, CASE WHEN ok AND whole THEN concat('models,', j ->> '$.directoryListing.fieldsAtConsent[2]') END AS fields,
  CASE WHEN NOT (ok AND whole) THEN 'unanswered' WHEN j ->> '$.directoryListing.withdrawnAt' IS NOT NULL THEN 'withdrawn' WHEN j ->> '$.directoryListing.answer' = 'declined' THEN 'declined' WHEN j ->> '$.directoryListing.disclosureId' <> 'now' THEN 'stale-disclosure' ELSE 'granted' END AS state FROM v"""
)
def consent_states(spark, d):
    """Consent records of the customers: some broken, with switches that are none or answers that are not whole."""
    r = table(spark, d, "customer").selectExpr("c_custkey AS id", f"{_CONSENT} AS record")
    listing = F.col("listing")
    return rules.consent_records(r).select(F.col("id").alias("c_custkey"), "valid", F.concat_ws(",", "off").alias("o"), "off", "listing").select("c_custkey", "valid", F.when(F.col("off").isNotNull(), F.col("o")).alias("off"), listing["handle"].alias("handle"), F.when(listing.isNotNull(), F.concat_ws(",", listing["fields"])).alias("fields"), rules.listing_state(listing, "now").alias("state"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'unanswered' WHEN c_custkey % 5 = 0 THEN 'withdrawn' WHEN c_custkey % 3 = 0 THEN 'declined' WHEN c_custkey % 2 = 0 THEN 'stale-disclosure' ELSE 'granted' END AS state FROM customer")
def listing_states(spark, d):
    k = F.col("c_custkey")
    listing = F.when(k % 7 != 0, F.struct(F.when(k % 3 == 0, "declined").otherwise("granted").alias("answer"), F.when(k % 5 == 0, "t").alias("withdrawn_at"), F.when(k % 2 == 0, "old").otherwise("now").alias("disclosure_id")))
    return table(spark, d, "customer").select("c_custkey", rules.listing_state(listing, "now").alias("state"))


_CONFIDENCE = "SELECT DISTINCT event_type AS provider, 'medium' AS confidence, 'mixed' AS truth FROM events UNION ALL SELECT 'claude', 'high', 'mixed'"


@query(_CONFIDENCE)
def confidence_notes(spark, d):
    p = table(spark, d, "events").select(F.col("event_type").alias("provider")).distinct().union(spark.createDataFrame([("claude",)], "provider string"))
    return p.select("provider", merge.confidence_note(F.col("provider")).alias("confidence"), F.lit(merge.source_of_truth(True, True)).alias("truth"))


_ART = "a AS (SELECT p_partkey AS ord, p_partkey % 4 AS k FROM part)"


@query(f"WITH {_ART} SELECT ord, CASE WHEN k = 0 THEN 'collector_observed' WHEN k = 1 THEN 'link_provided' ELSE 'self_reported' END AS verification, CASE k WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS rank, CASE WHEN k = 3 THEN 'self_reported' ELSE 'collector_observed' END AS lowered FROM a")
def artifact_backing(spark, d):
    """What backs an artifact: a found project (whatever its case), a link, or nothing; false badges are lowered."""
    k = F.col("p_partkey") % 4
    a = table(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.when(k == 0, "ALPHA").when(k == 1, "beta").when(k == 2, "gamma").otherwise(" ").alias("linked_project"), F.when(k == 1, "https://a.org").otherwise("ftp://a").alias("url"))
    p = spark.createDataFrame([("Alpha", True), ("beta", False)], "name string, found boolean")
    low = directory.without_false_badges(a.withColumn("verification", F.lit("collector_observed"))).select("ord", F.col("verification").alias("lowered"))
    return directory.observed_artifacts(a, p).select("ord", "verification", "rank").join(low, "ord")


_FOLDER_SQL = """f AS (SELECT p_partkey AS k, lower(replace(p_brand, '#', '-')) AS base, p_partkey % 5 = 0 AS pkg FROM part), p AS (SELECT DISTINCT lower(replace(p_brand, '#', '-')) AS a FROM part WHERE p_partkey <= 60),
s AS (SELECT a AS name, concat('d', CAST(k AS VARCHAR)) AS dir, k, CASE WHEN base = a THEN 340 WHEN contains(base, a) THEN 170 ELSE 0 END + CASE WHEN pkg AND contains(base, a) THEN 260 ELSE 0 END + CASE WHEN contains('text of ' || base, a) OR contains('text of ' || base, replace(a, '-', ' ')) THEN 55 ELSE 0 END + CASE WHEN k % 3 = 0 THEN 30 ELSE 0 END AS score FROM f, p)"""


def scored_folders(spark, d):
    base = F.lower(F.replace("p_brand", F.lit("#"), F.lit("-")))
    k = F.col("p_partkey")
    folders = table(spark, d, "part").select(F.concat(F.lit("d"), k.cast("string")).alias("dir"), base.alias("base"), F.when(k % 5 == 0, base).otherwise("").alias("package"), F.concat(F.lit("text of "), base).alias("evidence"), F.when(k % 3 == 0, F.array(F.lit("package.json"))).otherwise(F.array(F.lit("x"))).alias("files"))
    projects = table(spark, d, "part").filter(k <= 60).select(base.alias("name")).distinct().select("name", F.array("name").alias("aliases"), F.array(F.lit("none.example")).alias("domains"))
    return folders, projects


@query(f"WITH {_FOLDER_SQL} SELECT name, dir, score FROM s WHERE score >= 120 QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, dir) <= 12")
def folder_scores(spark, d):
    """The twelve best folders of each project, by names, packages and texts."""
    folders, projects = scored_folders(spark, d)
    return directory.score_folders(projects, folders)


@query(
    """WITH RECURSIVE n AS (SELECT DISTINCT c_nationkey % 40 AS name FROM customer), c AS (SELECT DISTINCT c_custkey % 60 AS name, concat('d', CAST(c_nationkey AS VARCHAR)) AS dir, CAST(c_custkey % 7 AS INTEGER) AS score FROM customer),
b AS (SELECT name, dir, max(score) AS score FROM c GROUP BY 1, 2),
a AS (SELECT -1::BIGINT AS ord, NULL::VARCHAR AS dir, []::VARCHAR[] AS used
  UNION ALL SELECT a.ord + 1, (list(b.dir ORDER BY b.score DESC, b.dir) FILTER (b.dir IS NOT NULL))[1], list_concat(any_value(a.used), coalesce([(list(b.dir ORDER BY b.score DESC, b.dir) FILTER (b.dir IS NOT NULL))[1]], [])) FROM a LEFT JOIN b ON b.name = a.ord + 1 AND NOT list_contains(a.used, b.dir) WHERE a.ord < 59 GROUP BY a.ord)
SELECT ord AS name, dir FROM a WHERE dir IS NOT NULL"""
)
def folder_assignments(spark, d):
    """One folder for each project, the projects in order, each the best that is left: customers' nations stand for folders."""
    c = table(spark, d, "customer").groupBy((F.col("c_custkey") % 60).alias("name"), F.concat(F.lit("d"), F.col("c_nationkey").cast("string")).alias("dir")).agg(F.max((F.col("c_custkey") % 7).cast("int")).alias("score"))
    return directory.assign_folders(c, c.select("name", F.col("name").alias("ord")).distinct())


@query(
    """SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 0 AND c_custkey % 6 <> 0"""
)
def valid_registry(spark, d):
    """Members with a proper handle and a safe address of their snapshot."""
    k = F.col("c_custkey")
    m = table(spark, d, "customer").select("c_custkey", F.concat(F.when(k % 4 == 0, "-").otherwise("m"), k.cast("string")).alias("handle"), F.when(k % 6 == 0, "https://10.0.0.1/x").otherwise("https://a.org/x").alias("snapshot_url"))
    return directory.valid_members(m).select("c_custkey")


@query("SELECT o_orderkey, c_custkey, c_name AS account, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS profile FROM orders JOIN customer ON o_custkey = c_custkey")
def session_accounts(spark, d):
    c = table(spark, d, "customer")
    s = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("account_id"))
    j = store.join_account(s, c.select(F.col("c_custkey").alias("account_id"), F.col("c_name").alias("account")), c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("account_id"), F.col("c_mktsegment").alias("profile")))
    return j.select("o_orderkey", F.col("account_id").alias("c_custkey"), "account", "profile")


@query("SELECT count(*) FILTER (p_partkey % 3 = 0) AS found, CAST(sum(p_size) AS BIGINT) AS changed_files, CAST(sum(p_size + p_partkey % 5) AS BIGINT) AS files FROM part")
def project_sums(spark, d):
    p = table(spark, d, "part").select((F.col("p_partkey") % 3 == 0).alias("found"), F.col("p_size").cast("long").alias("changed_files"), F.create_map(F.lit("ts"), F.col("p_size").cast("long"), F.lit("py"), F.col("p_partkey") % 5).alias("kinds"))
    return rollup.project_totals(p)


@query("SELECT o_custkey AS handle, count(*) AS invitations FROM orders GROUP BY 1")
def invitations_by_handle(spark, d):
    return rollup.count_by(table(spark, d, "orders").withColumnRenamed("o_custkey", "handle"), "handle", "invitations")


@query(
    """WITH RECURSIVE i AS (SELECT o_orderkey AS id, o_orderdate AS t, o_custkey % 20 AS s, o_custkey % 6 AS r, o_orderkey % 11 <> 0 AS good FROM orders),
a AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY t, CAST(id AS VARCHAR)) AS n FROM i WHERE good),
w AS (SELECT id, s, n, t, t AS start, 1 AS c, true AS ok FROM a WHERE n = 1 UNION ALL
  SELECT a.id, a.s, a.n, a.t, CASE WHEN a.t - w.start > INTERVAL 400 DAY THEN a.t ELSE w.start END, CASE WHEN a.t - w.start > INTERVAL 400 DAY THEN 1 WHEN w.c >= 10 THEN w.c ELSE w.c + 1 END, a.t - w.start > INTERVAL 400 DAY OR w.c < 10 FROM w JOIN a ON a.s = w.s AND a.n = w.n + 1),
b AS (SELECT i.*, row_number() OVER (PARTITION BY i.r ORDER BY i.t, CAST(i.id AS VARCHAR)) AS n FROM i JOIN w ON w.id = i.id WHERE w.ok),
v AS (SELECT id, r, n, t AS start, 1 AS c, true AS ok FROM b WHERE n = 1 UNION ALL
  SELECT b.id, b.r, b.n, CASE WHEN b.t - v.start > INTERVAL 400 DAY THEN b.t ELSE v.start END, CASE WHEN b.t - v.start > INTERVAL 400 DAY THEN 1 WHEN v.c >= 30 THEN v.c ELSE v.c + 1 END, b.t - v.start > INTERVAL 400 DAY OR v.c < 30 FROM v JOIN b ON b.r = v.r AND b.n = v.n + 1)
SELECT CAST(i.id AS VARCHAR) AS id, CASE WHEN NOT good THEN 'INVALID_EMAIL' WHEN coalesce(v.ok, false) THEN 'OK' ELSE 'RATE_LIMIT' END AS code FROM i LEFT JOIN v ON v.id = i.id"""
)
def invitation_limits(spark, d):
    """Invitations with limits on senders and receivers, over windows that start with their first event."""
    o, k = table(spark, d, "orders"), F.col("o_custkey")
    some = {c: F.lit("words enough for a scope") for c in ("organization", "compensation", "expected_time", "scope", "deadline", "data_requested")}
    i = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"), F.concat(F.lit("h"), (k % 6).cast("string")).alias("to_handle"), F.lit("contract").alias("opportunity_type"), F.when(F.col("o_orderkey") % 11 == 0, "nobody").otherwise(F.concat(F.lit("s"), (k % 20).cast("string"), F.lit("@a.org"))).alias("contact_email"), *[c.alias(n) for n, c in some.items()])
    return limits.invitation_decisions(i, window_seconds=400 * 24 * 3600)


@query(
    """WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS bucket, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, CAST(event_id AS VARCHAR)) AS n FROM events),
w AS (SELECT bucket, n, t AS start, 1 AS c, true AS ok FROM e WHERE n = 1 UNION ALL
  SELECT e.bucket, e.n, CASE WHEN e.t - w.start > 86400000000 THEN e.t ELSE w.start END, CASE WHEN e.t - w.start > 86400000000 THEN 1 WHEN w.c >= 3 THEN w.c ELSE w.c + 1 END, e.t - w.start > 86400000000 OR w.c < 3 FROM w JOIN e ON e.bucket = w.bucket AND e.n = w.n + 1)
SELECT bucket, count(*) FILTER (ok) AS allowed, count(*) AS asked FROM w GROUP BY 1"""
)
def rate_limit(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("bucket"), F.col("ts").alias("at"), F.col("event_id").alias("id"))
    return limits.limit(e, 3, 24 * 3600).groupBy("bucket").agg(F.count_if("allowed").alias("allowed"), F.count("*").alias("asked"))


@query(
    """WITH RECURSIVE e AS (SELECT event_type AS bucket, epoch_us(ts) AS t, CAST(event_id AS VARCHAR) AS id FROM events),
s AS (SELECT bucket, min(t) AS start FROM e GROUP BY 1 UNION ALL SELECT e.bucket, min(e.t) FROM s JOIN e ON e.bucket = s.bucket AND e.t > s.start + 21600000000 GROUP BY 1),
w AS (SELECT e.bucket, max(s.start) AS start, e.t, e.id FROM e JOIN s ON s.bucket = e.bucket AND s.start <= e.t GROUP BY e.bucket, e.t, e.id),
n AS (SELECT bucket, row_number() OVER (PARTITION BY bucket, start ORDER BY t, id) AS n FROM w)
SELECT bucket, count(*) FILTER (n <= 4) AS allowed, count(*) AS asked FROM n GROUP BY 1"""
)
def busy_limits(spark, d):
    """Limits of few buckets with very many events, each read in parts by many tasks."""
    e = table(spark, d, "events").select(F.col("event_type").alias("bucket"), F.col("ts").alias("at"), F.col("event_id").alias("id"))
    return limits.limit(e, 4, 6 * 3600, most_in_task=50).groupBy("bucket").agg(F.count_if("allowed").alias("allowed"), F.count("*").alias("asked"))


def _short(x: str, unit: int, digits: int, sign: str) -> str:
    n = 10**digits
    q = f"(({x} * {n} * 2 + {unit}) // (2 * {unit}))"
    return f"concat({q} // {n}, '.', lpad(CAST({q} % {n} AS VARCHAR), {digits}, '0'), '{sign}')"


@query(
    f"""SELECT o_orderkey, CASE WHEN n >= 1000000000000 THEN {_short("n", 10**12, 2, "T")} WHEN n >= 1000000000 THEN {_short("n", 10**9, 2, "B")} WHEN n >= 1000000 THEN {_short("n", 10**6, 1, "M")} WHEN n >= 1000 THEN {_short("n", 1000, 1, "K")} ELSE CAST(n AS VARCHAR) END AS compact,
  format('{{:,}}', n) AS whole, CASE n % 3 WHEN 0 THEN '—' ELSE concat(o_orderkey * 100 // (n % 3), '.0%') END AS share FROM (SELECT o_orderkey, CAST(o_orderkey AS HUGEINT) * o_orderkey * o_custkey AS n FROM orders)"""
)
def number_formats(spark, d):
    key, customer = F.col("o_orderkey").cast("decimal(18,0)"), F.col("o_custkey").cast("decimal(18,0)")
    o = table(spark, d, "orders").select("o_orderkey", (key * key * customer).alias("n"))  # more than a long holds
    return o.select("o_orderkey", text.compact_number(F.col("n")).alias("compact"), text.full_number(F.col("n")).alias("whole"), text.percent(F.col("o_orderkey"), (F.col("n") % 3).cast("int")).alias("share"))


_FNV = "list_reduce(list_concat([2166136261::BIGINT], list_transform(string_split(u, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"
_B36 = "substr(ltrim(array_to_string(list_transform([6, 5, 4, 3, 2, 1, 0], lambda i: '0123456789abcdefghijklmnopqrstuvwxyz'[CAST(f // CAST(power(36, i) AS BIGINT) % 36 AS INTEGER) + 1]), ''), '0'), 1, 6)"


@query(
    f"""WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS u, lower(c_mktsegment) AS h FROM customer), f AS (SELECT u, h, {_FNV} AS f FROM c), s AS (SELECT u, h, {_B36} AS short, row_number() OVER (PARTITION BY h ORDER BY u) AS n FROM f)
SELECT u AS user_id, CASE WHEN n = 1 AND h <> 'building' THEN h ELSE concat(h, '-', short) END AS handle FROM s"""
)
def account_handles(spark, d):
    """Handles of new accounts: the first of a name gets it plain, others a suffix made of their id."""
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("user_id"), F.col("c_mktsegment").alias("username"))
    return store.new_accounts(c, spark.createDataFrame([("x", "building")], "user_id string, handle string")).select("user_id", "handle")


@query(f"WITH {USAGE_SQL} SELECT event_id, input_tokens + output_tokens AS fresh_tokens, cache_creation_tokens + cache_read_tokens AS cached_tokens, total_tokens FROM u")
def derived_metrics(spark, d):
    return merge.with_derived(usage(spark, d).drop("total_tokens")).select("event_id", "fresh_tokens", "cached_tokens", "total_tokens")


@query("SELECT o_orderkey AS \"index\", CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END AS total_tokens, 0::BIGINT AS cached_tokens, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS estimated_cost_usd FROM orders ORDER BY o_orderkey LIMIT 500")
def snapshot_totals(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("index"), F.lit("t").alias("generated_at"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("total_tokens"), F.lit(None).cast("long").alias("cached_tokens"), F.lit(None).cast("long").alias("fresh_tokens"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).alias("estimated_cost_usd"))
    return derive.snapshot_series(o).select("index", "total_tokens", "cached_tokens", "estimated_cost_usd")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def last_checkpoints(spark, d):
    return store.latest_of_each(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("SELECT 'customer' AS name, count(*) AS n FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey % 5 <> 0")
def account_cascade(spark, d):
    """What remains in each table after accounts are deleted."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    left = store.cascade({"customer": (c, "c_custkey"), "orders": (o, "o_custkey")}, c.filter("c_custkey % 5 = 0").select("c_custkey"), "c_custkey")
    return left["customer"].agg(F.count("*").alias("n")).select(F.lit("customer").alias("name"), "n").union(left["orders"].agg(F.count("*").alias("n")).select(F.lit("orders").alias("name"), "n"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'cost,models' WHEN 1 THEN 'models' ELSE '' END AS off, CASE WHEN c_custkey % 3 = 2 THEN '' ELSE 'x' END AS unknown FROM customer")
def withheld_fields(spark, d):
    k = F.col("c_custkey")
    fields = F.create_map(F.lit("models"), k % 3 == 2, F.lit("cost"), k % 3 != 0, F.lit("daily"), F.lit(True))
    keys = F.when(k % 3 == 2, F.array(F.lit("cost"))).otherwise(F.array(F.lit("x"), F.lit("cost")))
    return table(spark, d, "customer").select("c_custkey", F.array_join(publish.disabled(fields), ",").alias("off"), F.array_join(F.array_except(keys, F.array(F.lit("cost"), F.lit("daily"))), ",").alias("unknown"))


@query("SELECT CASE WHEN c_custkey % 10 = 0 THEN 'new-' || CAST(c_custkey AS VARCHAR) ELSE 'old-' || CAST(c_custkey AS VARCHAR) END AS handle, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_name END AS name FROM customer")
def renamed_handles(spark, d):
    """Keys renamed, and an upsert that may set a value to null."""
    k = F.col("c_custkey").cast("string")
    c = table(spark, d, "customer")
    both = store.upsert(c.select(F.concat(F.lit("old-"), k).alias("handle"), F.col("c_name").alias("name")), c.filter("c_custkey % 4 = 0").select(F.concat(F.lit("old-"), k).alias("handle"), F.lit(None).cast("string").alias("name")), "handle", keep_nulls=True)
    return store.rename_keys(both, c.filter("c_custkey % 10 = 0").select(F.concat(F.lit("old-"), k).alias("old"), F.concat(F.lit("new-"), k).alias("new")), "handle")


@query(
    f"""WITH {MEMBERS_SQL} SELECT c_custkey AS id, CASE WHEN c_custkey % 6 = 0 THEN 'Anonymous' ELSE substr(display_name, 1, 60) END AS display_name, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey::DOUBLE END AS cost, CASE WHEN c_custkey % 4 = 1 THEN 0 ELSE 1 END AS models,
  CASE WHEN c_custkey % 4 = 2 THEN 0 ELSE 2 END AS artifacts, CASE WHEN c_custkey % 4 = 2 THEN 0 ELSE 1 END AS observed, CASE WHEN c_custkey % 2 = 0 THEN 'https://a.org/x' ELSE '' END AS links, c_custkey % 5 AS imported, least(c_custkey % 130, 100)::DOUBLE AS remaining,
  array_to_string(list_filter(['totals', 'providers', CASE WHEN c_custkey % 4 <> 3 THEN 'daily' END, 'projects', 'profile', 'durability', 'imported'], lambda x: x IS NOT NULL), ',') AS published, CASE c_custkey % 4 WHEN 0 THEN 'estimatedCost' WHEN 1 THEN 'models' WHEN 2 THEN 'profileWork' ELSE 'daily' END AS withheld, CASE WHEN c_custkey % 5 = 0 THEN 'unknown' ELSE 'Europe/Zurich' END AS zone, CASE WHEN c_custkey % 7 = 0 THEN '1970-01-01T00:00:00.000Z' ELSE '2026-01-02T03:04:05Z' END AS made FROM mem"""
)
def published_blocks(spark, d):
    """Drafts of customers projected to their published blocks, one field of each withheld."""
    k = F.col("c_custkey")
    link = F.when(k % 2 == 0, "https://a.org/x").otherwise("http://a.org/x")
    art = lambda title, project: F.struct(F.lit(title).alias("title"), F.lit("collector_observed").alias("verification"), F.lit(project).alias("linkedProject"), F.lit("no such").alias("type"))
    identity = F.struct(F.when(k % 6 == 0, "/Users/ann/x").otherwise(F.col("display_name")).alias("displayName"), F.array(F.struct(F.lit("site").alias("label"), link.alias("url"))).alias("links"), F.lit("secret").alias("unknown"))
    draft = F.struct(
        F.when(k % 5 == 0, "Europe/../Zurich x").otherwise("Europe/Zurich").alias("timezone"), F.when(k % 7 == 0, "now").otherwise("2026-01-02T03:04:05Z").alias("generatedAt"),
        F.struct(k.alias("totalTokens"), k.cast("double").alias("estimatedCostUsd")).alias("totals"),
        F.create_map(F.lit("claude"), F.struct(F.array(F.lit("m-1")).alias("models"), F.lit(1.0).alias("estimatedCostUsd")), F.lit("NO"), F.struct(F.array(F.lit("m-1")).alias("models"), F.lit(1.0).alias("estimatedCostUsd"))).alias("providers"),
        F.array(F.struct(F.lit("2026-01-01").alias("date"), F.lit("claude").alias("provider"))).alias("daily"),
        F.struct(identity.alias("identity"), F.struct(F.array(art("one", "alpha"), art("two", None), art(None, "alpha")).alias("artifacts")).alias("work")).alias("profile"),
        F.struct(F.array(F.struct(F.lit("alpha").alias("projectName"), F.array(F.struct(F.lit("7d").alias("window"), (k % 130).alias("remainingPct"))).alias("windows"))).alias("projects")).alias("durability"),
        F.array(F.struct(F.lit("file").alias("sourceLabel"), (k % 5).alias("totalTokens"))).alias("imported"),
    )
    off = F.element_at(F.array(*map(F.lit, ("estimatedCost", "models", "profileWork", "daily"))), (k % 4 + 1).cast("int"))
    b = blocks.blocks(spread(members(spark, d), "c_custkey").select(k.alias("id"), F.to_json(draft).alias("draft"), F.create_map(off, F.lit(False)).alias("consent")))
    return b.select(
        "id", F.col("profile.identity.displayName").alias("display_name"), F.col("measurement.estimatedCostUsd").alias("cost"), F.size("providers.claude.models").alias("models"), F.col("profile.work.totalArtifacts").alias("artifacts"), F.col("profile.work.collectorObserved").alias("observed"),
        F.array_join("profile.identity.links.url", ",").alias("links"), F.col("imported.totalTokens").alias("imported"), F.col("durability.projects")[0]["windows"][0]["remainingPct"].alias("remaining"), F.array_join("privacy.fieldsPublished", ",").alias("published"), F.array_join("privacy.fieldsWithheld", ",").alias("withheld"), F.col("timezone").alias("zone"), F.col("generatedAt").alias("made"),
    )


@query(
    """SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'a.password' WHEN 1 THEN 'list[1].cwd' WHEN 2 THEN 'Prompt' END AS path FROM customer WHERE c_custkey % 4 <> 3"""
)
def forbidden_paths(spark, d):
    """Paths of keys that must not appear, at any depth."""
    k = F.col("c_custkey")
    doc = F.when(k % 4 == 0, '{"a": {"password": 1, "totalTokens": 2}}').when(k % 4 == 1, '{"list": [1, {"cwd": []}]}').when(k % 4 == 2, '{"Prompt": null}').otherwise('{"inputTokens": 5, "text": "password"}')
    return secrets.forbidden_keys(secrets.leaves(table(spark, d, "customer").select(k.alias("id"), doc.alias("document")))).select("id", "path")


_UNION = "list_sort(list_distinct(flatten(list(models ORDER BY ord))))"


@query(f"""WITH {USAGE_SQL}, x AS (SELECT local_date AS date, provider, k % 3 AS ord, list_sort(list(DISTINCT model) FILTER (model IS NOT NULL)) AS models FROM u GROUP BY 1, 2, 3)
SELECT date, provider, array_to_string({_UNION}, ',') AS models FROM x GROUP BY 1, 2""")
def merged_models(spark, d):
    """Models of duplicate days, joined within a source."""
    from .queries import doubled

    k = merge.keep_max(doubled(spark, d).withColumn("models", F.coalesce("models", F.array().cast("array<string>"))), most_models=50)
    return k.select("date", "provider", F.array_join(F.array_sort("models"), ",").alias("models"))

"""Queries by name over the test tables, one or more for each family of operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, values
from ..operators import derive, directory, integrity, merge, publish, rollup, rules, secrets, store
from ..session import scratch
from ..sources import records
from ..streaming import limits
from .views import daily, members, table, usage

REFERENCE = "2024-02-01"
KEY = b"tallyworks-test-key"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def by_user(spark: SparkSession, d: str) -> DataFrame:
    return usage(spark, d).select("user_id", F.col("local_date").alias("date")).distinct()


def doubled(spark: SparkSession, d: str) -> DataFrame:
    """Daily rows with duplicates: of each event day one row by provider and parity of k, in a total order."""
    u = usage(spark, d).groupBy(F.col("local_date").alias("date"), "provider", (F.col("k") % 3).alias("ord")).agg(F.sum("total_tokens").alias("total_tokens"), F.array_sort(F.collect_set("model")).alias("models"))
    return u.withColumn("reported_total", F.when(F.col("ord") == 1, F.col("total_tokens") + 1))


@query
def daily_totals(spark, d):
    return rollup.daily_totals(usage(spark, d))


@query
def daily_by_local_zone(spark, d):
    u = usage(spark, d).withColumn("local_date", values.local_date(F.col("occurred_at").cast("timestamp"), "America/Phoenix"))
    return rollup.daily_totals(u).select("date", "provider", "total_tokens", "events")


@query
def daily_utc_models(spark, d):
    return rollup.daily_utc(usage(spark, d)).withColumn("models", F.when(F.size("models") > 0, F.array_join("models", ",")))


@query
def models_used(spark, d):
    return rollup.models_used(usage(spark, d))


@query
def event_count_by_origin(spark, d):
    return rollup.count_by(usage(spark, d), "origin", "events")


@query
def session_scalars(spark, d):
    return rollup.session_scalars(usage(spark, d))


@query
def provider_totals_rollup(spark, d):
    return rollup.provider_summary(daily(spark, d)).withColumn("estimated_cost_usd", F.round("estimated_cost_usd", 2)).withColumn("overall", F.col("overall").cast("int"))


@query
def provider_models(spark, d):
    return rollup.provider_models(daily(spark, d)).withColumn("models", F.array_join("models", ","))


@query
def provider_model_hierarchy(spark, d):
    return rollup.hierarchy(usage(spark, d))


@query
def hierarchy_top_models(spark, d):
    return rollup.top_models(rollup.hierarchy(usage(spark, d)), models=3, providers=4)


@query
def nested_models(spark, d):
    n = rollup.nested(rollup.top_models(rollup.hierarchy(usage(spark, d)), models=3, providers=4))
    return n.select("provider", "provider_events", F.array_join(F.transform("models", lambda m: m["model"]), ",").alias("models"))


@query
def session_size_stats(spark, d):
    return rollup.size_statistics(rollup.session_sizes(usage(spark, d)))


@query
def inter_event_gap_median(spark, d):
    return derive.gap_median(usage(spark, d))


@query
def sampled_gap_median(spark, d):
    return derive.gap_median(derive.sample_sessions(usage(spark, d), 12, 400))


@query
def longest_streak(spark, d):
    return derive.longest_streak(by_user(spark, d), ["user_id"])


@query
def current_streak(spark, d):
    return derive.current_streak(by_user(spark, d), F.to_date(F.lit("2024-01-31")), ["user_id"])


@query
def active_window_counts(spark, d):
    return derive.activity(daily(spark, d), REFERENCE)


@query
def activity_heatmap(spark, d):
    return derive.heatmap(daily(spark, d), REFERENCE)


@query
def presence_strip(spark, d):
    days = by_user(spark, d).select("date").distinct()
    return derive.presence_strip(days, REFERENCE, 60, 40)


@query
def efficiency_shares(spark, d):
    return derive.efficiency(daily(spark, d))


@query
def daily_provider_pivot(spark, d):
    return rollup.daily_pivot(daily(spark, d), ["click", "view"])


@query
def last_n_days(spark, d):
    return rollup.last_days(rollup.daily_pivot(daily(spark, d), ["click"]), 7)


@query
def largest_day(spark, d):
    return rollup.largest_day(daily(spark, d))


@query
def relative_shares(spark, d):
    return rollup.relative_shares(daily(spark, d)).select("date", "provider", F.round("share", 6).alias("share"))


@query
def history_series(spark, d):
    return derive.history_series(daily(spark, d))


@query
def keep_max_dedup(spark, d):
    k = merge.keep_max(doubled(spark, d))
    return k.select("date", "provider", "total_tokens", "duplicates")


@query
def keep_max_across_sources(spark, d):
    return merge.keep_max(doubled(spark, d), join_models=False).select("date", "provider", "total_tokens", F.when(F.size("models") > 0, F.array_join("models", ",")).alias("models"))


@query
def summed_duplicates(spark, d):
    return merge.sum_duplicates(doubled(spark, d))


@query
def merge_warnings(spark, d):
    return merge.warnings(doubled(spark, d)).select("warning")


@query
def first_write_wins(spark, d):
    u = usage(spark, d).withColumn("id", F.substring("event_id", 1, 3))
    return store.first_write_wins(u, "id", ["occurred_at", "event_id"]).select("id", "event_id", "total_tokens")


@query
def new_events_only(spark, d):
    u = usage(spark, d)
    return store.not_stored(u, u.filter("k % 3 = 0")).groupBy("provider").agg(F.count("*").alias("events"))


@query
def event_identity_hash(spark, d):
    u = usage(spark, d)
    return u.select("event_id", values.event_id(F.col("provider"), F.when(F.col("k") % 2 == 0, F.col("k").cast("string")), F.lit(None).cast("string"), F.col("model"), F.col("input_tokens"), F.col("session_pseudonym")).alias("identity"))


@query
def session_hmac(spark, d):
    return usage(spark, d).select("session_pseudonym").distinct().select("session_pseudonym", values.pseudonym(F.col("session_pseudonym"), KEY).alias("pseudonym"))


@query
def source_precedence_merge(spark, d):
    x = daily(spark, d).select("date", "provider", "total_tokens")
    return merge.fill_absent(x.filter("provider in ('click', 'view')"), x.filter("provider <> 'click'").withColumn("total_tokens", F.col("total_tokens") * 2))


@query
def models_by_provider(spark, d):
    m = rollup.models_used(usage(spark, d))
    return merge.with_models(spark.createDataFrame([("claude",), ("codex",)], "provider string"), m).withColumn("models", F.array_join("models", ","))


@query
def registry_merge(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("handle"), F.col("c_name").alias("display_name"))
    b = table(spark, d, "supplier").select((F.col("s_suppkey") * 2).cast("string").alias("handle"), F.col("s_name").alias("display_name"))
    return directory.merge_registries(a, b)


@query
def imported_sources(spark, d):
    u = usage(spark, d).withColumns({"adapter": F.lit("import:csv"), "measurement_class": F.lit("user_submitted"), "confidence": F.lit("low")})
    return rollup.imported_sources(u).withColumn("models", F.array_join("models", ","))


@query
def import_events(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").cast("string").alias("Usage Date"), F.col("o_orderpriority").alias("Tool"), F.concat(F.lit("$"), F.col("o_custkey").cast("string")).alias("Input_Tokens"), F.col("o_orderkey").alias("id"))
    e = records.import_events(records.import_table(o, F.col("id")), "orders", "csv")
    return e.select("event_id", "local_date", "provider", "total_tokens", "origin", "confidence")


@query
def import_summary(spark, d):
    o = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 5 == 0, "never").otherwise(F.col("o_orderdate").cast("date").cast("string")).alias("date"), F.col("o_custkey").alias("total"), F.col("o_orderkey").alias("id"))
    rows = records.import_table(o, F.col("id"))
    return records.import_summary(rows, records.import_events(rows, "orders", "csv"))


@query
def integrity_report(spark, d):
    x = daily(spark, d)
    return integrity.report(x, "2024-01-20", x.filter(F.dayofmonth("date") % 2 == 0))


@query
def backfill_diff(spark, d):
    x = daily(spark, d)
    return integrity.backfilled(x, x.filter(F.dayofmonth("date") % 2 == 0)).select("date", "provider", "total_tokens")


@query
def model_carry_forward(spark, d):
    u = usage(spark, d)
    return derive.carry_forward(u, ["user_id"], ["occurred_at", "event_id"], "model").select("event_id", "model")


@query
def cumulative_final(spark, d):
    u = usage(spark, d).select("session_pseudonym", "occurred_at", "event_id", "total_tokens", "model")
    return derive.last_of_each(u, ["session_pseudonym"], ["occurred_at", "event_id"]).select("session_pseudonym", "event_id", "total_tokens", "model")


@query
def trust_classification(spark, d):
    c = table(spark, d, "customer")
    signed = c.select("c_custkey", F.when(F.col("c_custkey") % 6 == 5, "invalid").otherwise("valid").alias("crypto_state"), F.when(F.col("c_custkey") % 11 != 0, F.concat(F.lit("key"), F.col("c_nationkey").cast("string"))).alias("key_id"), F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("c_custkey") % 60).cast("int")).alias("issued_at"))
    n = table(spark, d, "nation").filter("n_nationkey < 20")
    history = n.select(F.concat(F.lit("key"), F.col("n_nationkey").cast("string")).alias("key_id"), F.when(F.col("n_nationkey") == 3, "active").when(F.col("n_nationkey") % 5 == 0, "revoked").otherwise("rotated").alias("status"), F.when(F.col("n_nationkey") % 4 == 0, F.to_date(F.lit("2024-01-20"))).alias("revoked_at"))
    revoked = n.filter("n_nationkey in (7, 8)").select(F.concat(F.lit("key"), F.col("n_nationkey").cast("string")).alias("key_id"))
    return directory.classify_trust(signed, history, revoked, "key3").select("c_custkey", "trust")


@query
def key_history(spark, d):
    n = table(spark, d, "nation").select(F.col("n_name").alias("key_id"))
    r = table(spark, d, "nation").filter("n_nationkey % 6 = 1").select(F.col("n_name").alias("key_id"), F.lit("2024-01-02").alias("revoked_at"), F.lit("lost").alias("reason"))
    active = table(spark, d, "nation").agg(F.min("n_name")).first()[0]
    return directory.key_history(n, r, active).select("key_id", "status")


@query
def key_conflicts(spark, d):
    n = table(spark, d, "nation")
    keys = n.select(F.col("n_nationkey").alias("key_id"), F.col("n_regionkey").alias("account_id"), F.col("n_name").alias("public_key"))
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("key_id"), (F.col("c_custkey") % 5).cast("int").alias("account_id"), F.lit("none").alias("public_key"))
    reg = c.join(n.select(F.col("n_nationkey").alias("key_id"), "n_name"), "key_id").withColumn("public_key", F.when(F.col("c_custkey") % 2 == 0, F.col("n_name")).otherwise(F.col("public_key"))).drop("n_name")
    return store.key_conflicts(reg, keys, n.filter("n_nationkey < 4").select(F.col("n_nationkey").alias("key_id"))).select("c_custkey", "code")


@query
def directory_search(spark, d):
    return directory.search(members(spark, d), " BUILD", tool="tool2", verified=True, open_only=True).select("handle", "signature")


@query
def indexed_search(spark, d):
    """The same search through an index of the members' texts."""
    index = directory.SearchIndex(spark, scratch(spark, "search")).build(members(spark, d))
    return index.search(" BUILD", tool="tool2", verified=True, open_only=True).select("handle", "signature")


@query
def employer_search(spark, d):
    return directory.employer_search(members(spark, d), tool="tool1", category="machinery", least_days=30, verified=True).select("handle", "active_days")


@query
def facets(spark, d):
    return directory.facet(members(spark, d), "tools")


@query
def directory_order(spark, d):
    p = members(spark, d).withColumn("published_at", F.when(F.col("c_custkey") % 3 != 0, F.col("active_days")))
    return directory.listed(p).select("handle", F.col("published_at").cast("string").alias("published_at"))


@query
def safe_urls(spark, d):
    p = table(spark, d, "pages").select("page_id", F.coalesce(directory.safe_url(F.regexp_replace("url", "^http:", "https:")), F.lit(False)).alias("safe"))
    return p


@query
def snapshot_versions(spark, d):
    h = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("handle"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderkey") % 9 == 0).alias("revoked_key"))
    return store.versions(h).select("id", "status")


@query
def current_versions(spark, d):
    h = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("handle"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.lit(False).alias("revoked_key"))
    return store.current(store.versions(h)).select("handle", "id")


@query
def keyed_upsert(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    new = c.filter("c_custkey % 3 = 0").select((F.col("c_custkey") * 2).alias("c_custkey"), F.upper("c_name").alias("c_name"), F.lit(None).cast("string").alias("c_mktsegment"))
    return store.upsert(c, new, "c_custkey")


@query
def delete_source(spark, d):
    return rollup.count_by(store.without(usage(spark, d), F.col("source_label") == "file-1"), "provider", "events")


def spread(spark: SparkSession, df: DataFrame) -> DataFrame:
    """df over all cores, if it comes in fewer parts than there are: a small table of long texts, never a large one."""
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


@query
def secret_scan(spark, d):
    kinds = (("document", "documents", "text"), ("page", "pages", "html"), ("conversation", "conversations", "text"))
    each = [spread(spark, table(spark, d, name).select(F.col(column).alias("text"))).select(F.lit(kind).alias("kind"), F.explode(secrets.findings(F.col("text"), encoded=False)).alias("rule")) for kind, name, column in kinds]
    return each[0].union(each[1]).union(each[2]).groupBy("kind", "rule").agg(F.count("*").alias("texts"))


@query
def secret_scan_encoded(spark, d):
    none = F.lit(None).cast("long").alias("turn")
    t = table(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("id"), none, "text")
    p = table(spark, d, "pages").select(F.lit("page").alias("kind"), F.col("page_id").cast("string").alias("id"), none, F.col("html").alias("text"))
    c = table(spark, d, "conversations").select(F.lit("conversation").alias("kind"), F.col("conv_id").cast("string").alias("id"), F.col("turn").cast("long").alias("turn"), "text")
    return t.union(p).union(c).select("kind", "id", F.coalesce("turn", F.lit(-1)).alias("turn"), F.array_join(secrets.findings(F.col("text")), ",").alias("rules")).filter("rules <> ''")


@query
def json_usage_extract(spark, d):
    e = table(spark, d, "events").select("event_id", values.count_or_zero(F.get_json_object("props", "$.k").try_cast("double")).alias("k"), values.count_or_zero(F.get_json_object("props", "$.none").try_cast("double")).alias("none"))
    return e


@query
def provider_slug_normalize(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit(" "), F.col("p_type"), F.when(F.col("p_partkey") % 7 == 0, "/x").otherwise(" ")).alias("x"))
    slug = text.provider_slug(F.col("x"), "unknown")
    return p.select("p_partkey", slug.alias("slug"), text.provider_name(slug).alias("name"))


@query
def handles(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", text.handle(F.concat(F.lit("--"), F.col("p_name"), F.lit("!!"))).alias("handle"), text.header_key(F.col("p_name")).alias("key"), text.initials(F.col("p_name")).alias("initials"))


@query
def follow_up_classify(spark, d):
    p = table(spark, d, "part").select((F.col("p_partkey") % 10).alias("group"), F.concat(F.when(F.col("p_partkey") % 3 == 0, "Fix ").when(F.col("p_partkey") % 3 == 1, "Revert fix ").otherwise("hot-fix "), F.col("p_name"), F.when(F.col("p_partkey") % 4 == 0, " closes #12").otherwise("")).alias("subject"))
    f = text.follow_up(F.col("subject"))
    return p.groupBy("group").agg(*[F.count_if(c).alias(k) for k, c in f.items()])


@query
def provider_of_model(spark, d):
    """Models named by the words, sizes and brands of the parts."""
    words = ["gpt-5-codex", "o3", "o1-mini", "Opus-4", "sonnet", "grok-2", "moonshot-v1", "gemini-2", "qwen3", "llama-3", "my-Claude", "x-Kimi"]
    word = F.element_at(F.array(*map(F.lit, words)), (F.col("p_partkey") % len(words) + 1).cast("int"))
    # in every fifth name the word does not begin it
    model = F.concat(F.when(F.col("p_size") % 5 == 0, "my/").otherwise(""), word, F.lit("-"), F.col("p_size").cast("string"), F.lit(" "), "p_brand")
    p = table(spark, d, "part").select(model.alias("model"))
    return p.groupBy("model").agg(F.count("*").alias("parts")).select("model", "parts", text.provider_of_model(F.col("model")).alias("provider"), text.known_family(F.col("model")).alias("known"))


@query
def durability_windows(spark, d):
    names = F.array(*[F.lit(w) for w in derive.WINDOWS])
    s = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("project"), F.get(names, (F.col("l_linenumber") % 4).cast("int")).alias("window")).agg(F.sum(F.col("l_quantity").cast("long")).alias("introduced_lines"), F.sum(F.when(F.col("l_returnflag") != "R", F.col("l_quantity").cast("long")).otherwise(0)).alias("remaining_lines"))
    return derive.durability(s)


@query
def live_drift(spark, d):
    p = rollup.provider_summary(daily(spark, d)).filter("provider is not null").select("provider", "fresh_tokens", "cached_tokens", "total_tokens", F.to_timestamp(F.lit("2024-02-01 00:00:00")).alias("anchor"), (F.col("provider") != "view").alias("simulated"))
    return derive.live_drift(p, F.to_timestamp(F.lit("2024-02-01 01:00:00")), {"fresh": 1550.0, "cached": 17300.0}, {"click": 0.62, "purchase": 0.38}).drop("anchor")


@query
def published_daily(spark, d):
    p = publish.consented(publish.allowlisted(daily(spark, d)), {"cost": False, "models": True})
    return p.select("date", "provider", F.array_join("models", ",").alias("models"), "total_tokens", "estimated_cost_usd")


@query
def payload_gate(spark, d):
    """Documents that fail each rule in turn, signed ones by a key for each region, and good ones."""
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey", F.explode(F.sequence(F.lit(0), F.lit(14))).alias("variant"))
    plain = ("oops", None, '{"extra": 1}', '{"profile": {"password": "x"}}', '{"privacy": {"rawContentPersisted": true}}', '{"privacy": {"allowlistPublication": false}}', '{"verification": {"rawLogsPublished": true}}', '{"warnings": ["mail a@b.org"]}', '{"source": "n"}', '{"privacy": {"rawContentPersisted": "true"}}', "[" * 20_000)
    big = F.concat(F.lit('{"source": "'), F.repeat(F.lit("x"), 600_000), F.lit('"}'))
    unsigned = F.when(F.col("variant") == 1, big).otherwise(F.get(F.array(*[F.lit(x) for x in plain]), F.col("variant")))
    seed = F.unhex(F.repeat(F.concat(F.lit("0"), (F.col("r_regionkey") + 1).cast("string")), 32))
    keys = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), seed.alias("seed"), F.explode(F.array(F.lit(False), F.lit(True))).alias("odd"))
    good = F.lit('{"source": "n", "generatedAt": "2026-01-01T00:00:00Z"}')
    keys = keys.select("n_regionkey", "odd", publish.signed_documents(good, F.col("seed"), F.when(F.col("odd"), "not a number")).alias("sealed"))
    document = F.when(F.col("variant") < len(plain), unsigned).when(F.col("variant") == 11, F.replace("sealed", F.lit('"source": "n"'), F.lit('"source": "m"'))).otherwise(F.col("sealed"))
    docs = n.withColumn("odd", F.col("variant") == 12).join(keys, ["n_regionkey", "odd"]).select((F.col("n_nationkey") * 100 + F.col("variant")).alias("id"), document.alias("document"), F.when(F.col("variant") == 13, "another key").alias("expected_key"))
    revoked = spark.createDataFrame([(publish.key_number(bytes([1]) * 32),)], "key_id string")
    return publish.gate(docs, revoked)


@query
def claim_ladder(spark, d):
    c = members(spark, d).select(F.col("c_custkey").alias("id"), (F.col("active_days") > 30).alias("has_activity"), F.col("signature").isin("valid", "historical").alias("is_signed"))
    return rules.claims(c).groupBy("signal").agg(F.count_if("present").alias("present"), F.count("*").alias("members"))


@query
def invitation_codes(spark, d):
    c = table(spark, d, "customer")
    i = c.select(F.concat(F.lit("member-"), F.col("c_custkey").cast("string")).alias("to_handle"), F.when(F.col("c_custkey") % 7 == 0, "gift").otherwise("contract").alias("opportunity_type"), F.col("c_name").alias("organization"), F.when(F.col("c_custkey") % 5 == 0, "nobody").otherwise("a@b.org").alias("contact_email"), F.when(F.col("c_custkey") % 3 == 0, "$5").otherwise("500 a day").alias("compensation"), F.lit("2 weeks").alias("expected_time"), F.repeat(F.lit("scope "), (F.col("c_custkey") % 6).cast("int")).alias("scope"), F.lit("soon").alias("deadline"), F.lit("none").alias("data_requested"))
    return i.select(rules.invitation_code().alias("code")).groupBy("code").agg(F.count("*").alias("invitations"))


@query
def event_sessions(spark, d):
    """Extension: sessions by a gap of 30 minutes."""
    e = table(spark, d, "events").select(F.col("user_id").alias("user"), F.col("ts").cast("timestamp").alias("at"))
    return limits.sessions(e).groupBy("user").agg(F.count("*").alias("sessions"), F.sum("events").alias("events"))


@query
def pricing_summary(spark, d):
    """Extension: a filtered aggregate over the largest table."""
    money = lambda x: F.sum(x.cast("decimal(18,4)")).cast("double")
    l = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))  # noqa: E741
    return l.groupBy("l_returnflag", "l_linestatus").agg(money(F.col("l_quantity")).alias("sum_qty"), money(F.col("l_extendedprice")).alias("sum_price"), F.count("*").alias("n"))


@query
def revenue_by_nation(spark, d):
    """Extension: a five-way join; small dimensions are broadcast by their size."""
    l, o, c, n, r = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    j = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("r_name", "n_name").agg(F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")).cast("double").alias("revenue"))


@query
def top_orders_by_customer(spark, d):
    """Extension: ranking within groups."""
    o = table(spark, d, "orders")
    return rollup.top_n(o, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 2).select("o_custkey", "o_orderkey")


@query
def unsold_parts(spark, d):
    """Extension: set difference."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("k")).subtract(table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("k")))


@query
def order_cube(spark, d):
    """Extension: a cube over two columns."""
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))

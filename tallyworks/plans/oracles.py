"""SQL for DuckDB that gives the rows of the queries of the same name."""

from __future__ import annotations

from .queries import KEY, REFERENCE
from .views import DAILY_SQL, MEMBERS_SQL, USAGE_SQL

_BLOCK = KEY.ljust(64, b"\0")
_INNER, _OUTER = (bytes(b ^ pad for b in _BLOCK).hex() for pad in (0x36, 0x5C))
_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "total_tokens"))
_KNOWN = "^(claude|gpt|o[0-9]|gemini|llama|mistral|deepseek|qwen|grok|codex|command|sonar)"
_U, _D, _M = f"WITH {USAGE_SQL}", f"WITH {DAILY_SQL}", f"WITH {MEMBERS_SQL}"
_LEVELS = """lv AS (SELECT CASE WHEN grouping(model) = 0 THEN 'model' ELSE 'provider' END AS level, provider, model, count(*) AS events, count(DISTINCT session) AS sessions, CAST(sum(total_tokens) AS BIGINT) AS total_tokens
  FROM (SELECT provider, coalesce(nullif(model, ''), '(unattributed)') AS model, total_tokens, nullif(session_pseudonym, '') AS session FROM u WHERE origin = 'local_log')
  GROUP BY GROUPING SETS ((provider, model), (provider)))"""
_TOP = f"""{_U}, {_LEVELS}, p AS (SELECT provider, events AS provider_events, sessions AS provider_sessions, total_tokens AS provider_tokens FROM lv WHERE level = 'provider' ORDER BY events DESC, provider LIMIT 4),
t AS (SELECT provider, model, events, sessions, total_tokens, CAST(row_number() OVER (PARTITION BY provider ORDER BY events DESC, model) AS INTEGER) AS place FROM lv WHERE level = 'model'),
top AS (SELECT provider, provider_events, provider_sessions, provider_tokens, model, place, events, sessions, total_tokens FROM t JOIN p USING (provider) WHERE place <= 3)"""
_GAPS = """SELECT count(*) AS gaps, CAST(floor(median(gap) + 0.5) AS BIGINT) AS median_gap FROM (
  SELECT floor((epoch_us(occurred_at) - epoch_us(lag(occurred_at) OVER (PARTITION BY session_pseudonym ORDER BY occurred_at))) / 1e6 + 0.5) AS gap FROM {source}) WHERE gap BETWEEN 0 AND 3600"""
_RUNS = """runs AS (SELECT user_id, min(date) AS first, max(date) AS last, CAST(count(*) AS INTEGER) AS length FROM (
  SELECT user_id, date, date - CAST(row_number() OVER (PARTITION BY user_id ORDER BY date) AS INTEGER) AS run FROM (SELECT DISTINCT user_id, local_date AS date FROM u)) GROUP BY user_id, run)"""
_DOUBLED = """x AS (SELECT local_date AS date, provider, k % 3 AS ord, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, list_sort(list(DISTINCT model) FILTER (model IS NOT NULL)) AS models FROM u GROUP BY 1, 2, 3)"""
_PRIVATE = r"^(10\.|127\.|169\.254\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.|0\.0\.0\.0$|localhost$)"


def _secret_sql() -> str:
    from ..operators.secrets import RULES

    quoted = lambda p: p.replace("'", "''")
    each = " UNION ALL ".join(f"SELECT kind, '{n}' AS rule, count(*) AS texts FROM t WHERE regexp_matches(text, '{quoted(p)}') GROUP BY kind" for n, p in RULES.items())
    return f"WITH t AS (SELECT 'document' AS kind, text FROM documents UNION ALL SELECT 'page', html FROM pages UNION ALL SELECT 'conversation', text FROM conversations) {each}"


def _encoded_sql() -> str:
    from ..operators.secrets import RULES

    quoted = lambda p: p.replace("'", "''")
    hit = lambda n, p: f"CASE WHEN regexp_matches(text, '{quoted(p)}')" + ("" if n in ("local host", "conversation") else f" OR regexp_matches(plain, '{quoted(p)}')") + f" THEN '{n}' END"
    rules = ", ".join(hit(n, p) for n, p in sorted(RULES.items()))
    return f"""WITH t AS (SELECT 'document' AS kind, CAST(doc_id AS VARCHAR) AS id, -1::BIGINT AS turn, text FROM documents UNION ALL SELECT 'page', CAST(page_id AS VARCHAR), -1, html FROM pages UNION ALL SELECT 'conversation', CAST(conv_id AS VARCHAR), turn, text FROM conversations),
w AS (SELECT *, array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z0-9+/]{{24,}}={{0,2}}'), lambda w: coalesce(TRY(decode(from_base64(w))), '')), chr(10)) AS plain FROM t)
SELECT kind, id, turn, array_to_string(list_filter([{rules}], lambda r: r IS NOT NULL), ',') AS rules FROM w WHERE rules <> ''"""


_SLUG = "substr(regexp_replace(regexp_replace(lower(trim(x)), '\\s+', '-', 'g'), '[^a-z0-9_-]', '', 'g'), 1, 40)"
_TITLE = "array_to_string(list_transform(string_split(regexp_replace(slug, '[-_]', ' ', 'g'), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
_HIST = "h AS (SELECT CAST(o_custkey AS VARCHAR) AS handle, o_orderkey AS id, o_orderdate AS created_at FROM orders)"

ORACLES = {
    "daily_totals": f"{_U} SELECT local_date AS date, provider, {_SUMS}, count(*) AS events FROM u WHERE origin = 'local_log' GROUP BY 1, 2",
    "daily_by_local_zone": f"{_U} SELECT CAST((occurred_at AT TIME ZONE 'UTC') AT TIME ZONE 'America/Phoenix' AS DATE) AS date, provider, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, count(*) AS events FROM u WHERE origin = 'local_log' GROUP BY 1, 2",
    "daily_utc_models": f"{_U} SELECT CAST(occurred_at AS DATE) AS date, provider, {_SUMS}, count(*) AS events, array_to_string(list_sort(list(DISTINCT model) FILTER (model IS NOT NULL)), ',') AS models FROM u GROUP BY 1, 2",
    "models_used": f"{_U} SELECT DISTINCT model FROM u WHERE origin = 'local_log' AND model IS NOT NULL",
    "event_count_by_origin": f"{_U} SELECT origin, count(*) AS events FROM u GROUP BY 1",
    "session_scalars": f"{_U} SELECT count(*) AS events, count(*) FILTER (nullif(session_pseudonym, '') IS NULL) AS without_session, count(DISTINCT nullif(session_pseudonym, '')) AS sessions FROM u WHERE origin = 'local_log'",
    "provider_totals_rollup": f"""{_D} SELECT *, cached_tokens + fresh_tokens AS total_tokens FROM (SELECT *, cache_creation_tokens + cache_read_tokens AS cached_tokens, input_tokens + output_tokens AS fresh_tokens FROM (
  SELECT provider, CAST(grouping(provider) AS INTEGER) AS overall, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cache_creation_tokens) AS BIGINT) AS cache_creation_tokens, CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens, round(sum(estimated_cost_usd), 2) AS estimated_cost_usd FROM d GROUP BY ROLLUP (provider)))""",
    "provider_models": f"{_D} SELECT provider, array_to_string(list_sort(list(DISTINCT model))[1:10], ',') AS models FROM (SELECT provider, unnest(models) AS model FROM d) GROUP BY 1",
    "provider_model_hierarchy": f"{_U}, {_LEVELS} SELECT * FROM lv",
    "hierarchy_top_models": f"{_TOP} SELECT * FROM top",
    "nested_models": f"{_TOP} SELECT provider, provider_events, string_agg(model, ',' ORDER BY place) AS models FROM top GROUP BY 1, 2",
    "session_size_stats": f"{_U} SELECT count(*) AS sessions, CAST(floor(median(n) + 0.5) AS BIGINT) AS median_events, CAST(quantile_disc(n, 0.95) AS BIGINT) AS p95_events, max(n) AS largest FROM (SELECT session_pseudonym, count(*) AS n FROM u WHERE origin = 'local_log' AND nullif(session_pseudonym, '') IS NOT NULL GROUP BY 1)",
    "inter_event_gap_median": f"{_U} {_GAPS.format(source='u')}",
    "sampled_gap_median": f"{_U}, big AS (SELECT session_pseudonym FROM u GROUP BY 1 ORDER BY count(*) DESC, session_pseudonym LIMIT 12), s AS (SELECT * FROM u WHERE session_pseudonym IN (SELECT session_pseudonym FROM big) QUALIFY row_number() OVER (PARTITION BY session_pseudonym ORDER BY occurred_at, event_id) <= 400) {_GAPS.format(source='s')}",
    "longest_streak": f"{_U}, {_RUNS} SELECT user_id, max(length) AS longest_streak FROM runs GROUP BY 1",
    "current_streak": f"{_U}, {_RUNS} SELECT user_id, CASE WHEN DATE '2024-01-31' - max(last) <= 1 THEN arg_max(length, last) ELSE 0 END AS current_streak FROM runs GROUP BY 1",
    "active_window_counts": f"""{_D}, a AS (SELECT DISTINCT date FROM d WHERE total_tokens > 0) SELECT count(*) AS active_days, min(date) AS first_date, max(date) AS last_date, CAST(max(date) - min(date) + 1 AS INTEGER) AS span_days,
  count(*) FILTER (DATE '{REFERENCE}' - date BETWEEN 0 AND 29) AS last_30, count(*) FILTER (DATE '{REFERENCE}' - date BETWEEN 0 AND 89) AS last_90 FROM a""",
    "activity_heatmap": f"""{_D}, g AS (SELECT CAST(unnest(generate_series(e - INTERVAL 181 DAY, CAST(e AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT DATE '{REFERENCE}' + CAST(6 - dayofweek(DATE '{REFERENCE}') AS INTEGER) AS e)),
  t AS (SELECT date, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM d GROUP BY 1), mx AS (SELECT greatest(max(tokens), 1) AS most FROM t)
  SELECT g.date, coalesce(tokens, 0) AS tokens, CASE WHEN g.date > DATE '{REFERENCE}' THEN -1 WHEN coalesce(tokens, 0) = 0 THEN 0 WHEN tokens / most > 0.6 THEN 4 WHEN tokens / most > 0.3 THEN 3 WHEN tokens / most > 0.1 THEN 2 ELSE 1 END AS level FROM g LEFT JOIN t ON g.date = t.date CROSS JOIN mx""",
    "presence_strip": f"""{_U}, h AS (SELECT DISTINCT CAST(floor((59 - (DATE '{REFERENCE}' - date)) * 20 / 60) AS INTEGER) AS bucket FROM (SELECT DISTINCT local_date AS date FROM u) WHERE DATE '{REFERENCE}' - date BETWEEN 0 AND 59)
  SELECT CAST(b AS INTEGER) AS bucket, h.bucket IS NOT NULL AS active FROM range(20) r(b) LEFT JOIN h ON h.bucket = b""",
    "efficiency_shares": f"""{_D} SELECT floor(c / t * 1000 + 0.5) / 10 AS cached_share, floor(f / t * 1000 + 0.5) / 10 AS fresh_share, floor(o / (i + o) * 1000 + 0.5) / 10 AS output_share, CAST(floor(t / n + 0.5) AS BIGINT) AS per_active_day FROM (
  SELECT CAST(sum(cached_tokens) AS BIGINT) AS c, CAST(sum(fresh_tokens) AS BIGINT) AS f, CAST(sum(output_tokens) AS BIGINT) AS o, CAST(sum(input_tokens) AS BIGINT) AS i, CAST(sum(total_tokens) AS BIGINT) AS t, count(DISTINCT date) FILTER (total_tokens > 0) AS n FROM d)""",
    "daily_provider_pivot": f"{_D} SELECT date, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(sum(fresh_tokens) AS BIGINT) AS fresh_tokens, CAST(sum(cached_tokens) AS BIGINT) AS cached_tokens, CAST(coalesce(sum(total_tokens) FILTER (provider = 'click'), 0) AS BIGINT) AS click, CAST(coalesce(sum(total_tokens) FILTER (provider = 'view'), 0) AS BIGINT) AS \"view\" FROM d GROUP BY 1",
    "last_n_days": f"{_D} SELECT date, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(sum(fresh_tokens) AS BIGINT) AS fresh_tokens, CAST(sum(cached_tokens) AS BIGINT) AS cached_tokens, CAST(coalesce(sum(total_tokens) FILTER (provider = 'click'), 0) AS BIGINT) AS click FROM d GROUP BY 1 ORDER BY date DESC LIMIT 7",
    "largest_day": f"{_D} SELECT date, CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM d GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1",
    "relative_shares": f"{_D} SELECT date, provider, round(total_tokens / greatest((SELECT max(total_tokens) FROM d), 1), 6) AS share FROM d",
    "history_series": f"{_D} SELECT date, provider, total_tokens, cached_tokens, fresh_tokens FROM d",
    "keep_max_dedup": f"{_U}, {_DOUBLED} SELECT date, provider, max(total_tokens) AS total_tokens, count(*) - 1 AS duplicates FROM x GROUP BY 1, 2",
    "keep_max_across_sources": f"{_U}, {_DOUBLED} SELECT date, provider, total_tokens, array_to_string(models, ',') AS models FROM x QUALIFY row_number() OVER (PARTITION BY date, provider ORDER BY total_tokens DESC, ord) = 1",
    "summed_duplicates": f"{_U}, {_DOUBLED} SELECT date, provider, CAST(sum(total_tokens + CASE WHEN ord = 1 THEN 1 ELSE 0 END) AS BIGINT) AS total_tokens FROM x GROUP BY 1, 2",
    "merge_warnings": f"""{_U}, {_DOUBLED}, w AS (SELECT min(ord) AS ord, concat('duplicate-daily-row:', date, ':', provider) AS warning FROM x GROUP BY date, provider HAVING count(*) > 1
  UNION ALL SELECT ord, concat('reported-total-mismatch:', date, ':', provider, ':reported=', total_tokens + 1, ':derived=', total_tokens) FROM x WHERE ord = 1) SELECT warning FROM (SELECT warning, min(ord) AS o FROM w GROUP BY 1 ORDER BY o, warning LIMIT 12)""",
    "first_write_wins": f"{_U} SELECT substr(event_id, 1, 3) AS id, event_id, total_tokens FROM u QUALIFY row_number() OVER (PARTITION BY substr(event_id, 1, 3) ORDER BY occurred_at, event_id) = 1",
    "new_events_only": f"{_U} SELECT provider, count(*) AS events FROM u WHERE NOT EXISTS (SELECT 1 FROM u o WHERE o.k % 3 = 0 AND o.event_id = u.event_id) GROUP BY 1",
    "event_identity_hash": f"{_U} SELECT event_id, substr(sha256(concat(provider, '|', CASE WHEN k % 2 = 0 THEN concat('msg:', k, '|req:') ELSE concat('content:', coalesce(model, ''), '|', input_tokens, '|', session_pseudonym) END)), 1, 32) AS identity FROM u",
    "session_hmac": f"{_U} SELECT DISTINCT session_pseudonym, substr(sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode(session_pseudonym)))), 1, 24) AS pseudonym FROM u",
    "source_precedence_merge": f"{_D} SELECT date, provider, total_tokens FROM d WHERE provider IN ('click', 'view') UNION ALL SELECT date, provider, total_tokens * 2 FROM d WHERE provider <> 'click' AND provider NOT IN (SELECT provider FROM d WHERE provider IN ('click', 'view'))",
    "models_by_provider": f"{_U} SELECT p AS provider, CASE WHEN p = 'claude' THEN (SELECT array_to_string(list_sort(list(DISTINCT model)), ',') FROM u WHERE origin = 'local_log' AND model LIKE '%claude%') ELSE '' END AS models FROM (VALUES ('claude'), ('codex')) v(p)",
    "registry_merge": "WITH a AS (SELECT CAST(c_custkey AS VARCHAR) AS handle, c_name FROM customer), b AS (SELECT CAST(s_suppkey * 2 AS VARCHAR) AS handle, s_name FROM supplier) SELECT handle, CASE WHEN s_name IS NOT NULL THEN 'hosted' ELSE 'static' END AS origin, coalesce(s_name, c_name) AS display_name FROM a FULL JOIN b USING (handle)",
    "imported_sources": f"""{_U} SELECT source_label, 'import:csv' AS adapter, 'user_submitted' AS measurement_class, 'low' AS confidence, count(*) AS events, {_SUMS}, min(local_date) AS first_date, max(local_date) AS last_date,
  nullif(array_to_string(list_sort(list(DISTINCT model) FILTER (model IS NOT NULL))[1:24], ','), '') AS models FROM u WHERE origin = 'imported' GROUP BY 1""",
    "import_events": """SELECT substr(sha256(concat_ws('|', 'imported', 'orders', date, o_orderpriority, '', o_custkey, 0, 0, 0, o_orderkey)), 1, 32) AS event_id, CAST(date AS DATE) AS local_date, o_orderpriority AS provider, o_custkey AS total_tokens, 'imported' AS origin, 'low' AS confidence
  FROM (SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, trim(regexp_replace(o_orderpriority, '[^a-zA-Z0-9 ._:/-]', '', 'g')) AS o_orderpriority, o_custkey, o_orderkey FROM orders) WHERE o_custkey > 0""",
    "import_summary": "SELECT count(*) AS rows, count(*) FILTER (ok) AS imported, count(*) FILTER (NOT ok) AS skipped, CAST(coalesce(sum(o_custkey) FILTER (ok), 0) AS BIGINT) AS total_tokens FROM (SELECT o_custkey, o_orderkey % 5 <> 0 AND o_custkey > 0 AS ok FROM orders)",
    "integrity_report": f"""{_D}, n AS (SELECT count(*) FILTER (date > DATE '2024-01-20') AS f1, count(*) FILTER (total_tokens > 50000000000) AS f2, count(*) FILTER (total_tokens < 0) AS f3 FROM d),
  fam AS (SELECT count(*) AS f5 FROM (SELECT DISTINCT unnest(models) AS model FROM d) WHERE NOT regexp_matches(model, '(?i){_KNOWN}')),
  b AS (SELECT count(*) AS f6 FROM d WHERE date < (SELECT max(date) FROM d WHERE day(date) % 2 = 0) AND NOT EXISTS (SELECT 1 FROM d p WHERE day(p.date) % 2 = 0 AND p.date = d.date AND p.provider = d.provider)),
  r AS (SELECT 1 AS ord, 'No future-dated activity' AS name, f1 AS findings, 0 AS most FROM n UNION ALL SELECT 2, 'Plausible daily volume', f2, 0 FROM n UNION ALL SELECT 3, 'Well-formed totals', f3, 0 FROM n
   UNION ALL SELECT 4, 'No duplicate day-rows', (SELECT count(*) - count(DISTINCT (date, provider)) FROM d), 0 UNION ALL SELECT 5, 'Recognized model families', f5, 0 FROM fam UNION ALL SELECT 6, 'No large retroactive backfill', f6, 5 FROM b)
  SELECT ord, name, findings, CASE WHEN findings > most THEN 'flag' ELSE 'ok' END AS status FROM r""",
    "backfill_diff": f"{_D} SELECT date, provider, total_tokens FROM d WHERE date < (SELECT max(date) FROM d WHERE day(date) % 2 = 0) AND NOT EXISTS (SELECT 1 FROM d p WHERE day(p.date) % 2 = 0 AND p.date = d.date AND p.provider = d.provider)",
    "model_carry_forward": f"{_U} SELECT event_id, last_value(model IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY occurred_at, event_id ROWS UNBOUNDED PRECEDING) AS model FROM u",
    "cumulative_final": f"{_U} SELECT session_pseudonym, event_id, total_tokens, model FROM u QUALIFY row_number() OVER (PARTITION BY session_pseudonym ORDER BY occurred_at DESC, event_id DESC) = 1",
    "trust_classification": """WITH s AS (SELECT c_custkey, CASE WHEN c_custkey % 6 = 5 THEN 'invalid' ELSE 'valid' END AS crypto, CASE WHEN c_custkey % 11 <> 0 THEN c_nationkey END AS k, DATE '2024-01-01' + CAST(c_custkey % 60 AS INTEGER) AS issued FROM customer),
  h AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey = 3 THEN 'active' WHEN n_nationkey % 5 = 0 THEN 'revoked' ELSE 'rotated' END AS status, CASE WHEN n_nationkey % 4 = 0 THEN DATE '2024-01-20' END AS gone FROM nation WHERE n_nationkey < 20)
  SELECT c_custkey, CASE WHEN crypto <> 'valid' THEN crypto WHEN s.k IS NULL THEN 'history_unavailable' WHEN s.k IN (7, 8) THEN 'revoked' WHEN status = 'revoked' THEN 'revoked' WHEN s.k = 3 THEN 'active' WHEN issued > gone THEN 'revoked' ELSE 'historical' END AS trust FROM s LEFT JOIN h ON s.k = h.k""",
    "key_history": "SELECT n_name AS key_id, CASE WHEN n_nationkey % 6 = 1 THEN 'revoked' WHEN n_name = (SELECT min(n_name) FROM nation) THEN 'active' ELSE 'rotated' END AS status FROM nation",
    "key_conflicts": "SELECT c_custkey, CASE WHEN c_nationkey < 4 THEN 'KEY_REVOKED' WHEN n_regionkey <> c_custkey % 5 THEN 'KEY_TAKEN' WHEN c_custkey % 2 <> 0 THEN 'KEY_MISMATCH' ELSE 'OK' END AS code FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "directory_search": f"{_M} SELECT handle, signature FROM mem WHERE list_contains(tools, 'tool2') AND signature IN ('valid', 'historical') AND is_open AND contains(lower(concat_ws(' ', display_name, headline, coalesce(location, ''), work_categories[1], tools[1], tools[2], proofs[1])), 'build')",
    "indexed_search": f"{_M} SELECT handle, signature FROM mem WHERE list_contains(tools, 'tool2') AND signature IN ('valid', 'historical') AND is_open AND contains(lower(concat_ws(' ', display_name, headline, coalesce(location, ''), work_categories[1], tools[1], tools[2], proofs[1])), 'build')",
    "employer_search": f"{_M} SELECT handle, active_days FROM mem WHERE list_contains(tools, 'tool1') AND list_contains(work_categories, 'machinery') AND active_days >= 30 AND signature = 'valid'",
    "facets": f"{_M} SELECT DISTINCT unnest(tools) AS value FROM mem",
    "directory_order": f"{_M} SELECT handle, CASE WHEN c_custkey % 3 <> 0 THEN CAST(active_days AS VARCHAR) END AS published_at FROM mem",
    "safe_urls": f"SELECT page_id, coalesce(regexp_matches(url, '^https?://') AND NOT contains(regexp_extract(url, '^https?://([^/?#]*)', 1), '@') AND NOT regexp_matches(host, '{_PRIVATE}') AND NOT ends_with(host, '.local'), false) AS safe FROM (SELECT page_id, url, lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) AS host FROM pages)",
    "snapshot_versions": f"WITH {_HIST} SELECT id, CASE WHEN id % 9 = 0 THEN 'revoked_key' WHEN lead(id) OVER (PARTITION BY handle ORDER BY created_at, id) IS NULL THEN 'active' ELSE 'superseded' END AS status FROM h",
    "current_versions": f"WITH {_HIST} SELECT handle, id FROM h QUALIFY row_number() OVER (PARTITION BY handle ORDER BY created_at DESC, id DESC) = 1",
    "keyed_upsert": "SELECT coalesce(c.c_custkey, n.k) AS c_custkey, coalesce(n.c_name, c.c_name) AS c_name, c.c_mktsegment FROM customer c FULL JOIN (SELECT c_custkey * 2 AS k, upper(c_name) AS c_name FROM customer WHERE c_custkey % 3 = 0) n ON c.c_custkey = n.k",
    "delete_source": f"{_U} SELECT provider, count(*) AS events FROM u WHERE source_label IS DISTINCT FROM 'file-1' GROUP BY 1",
    "secret_scan": _secret_sql(),
    "secret_scan_encoded": _encoded_sql(),
    "json_usage_extract": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(0 AS BIGINT) AS none FROM events",
    "provider_slug_normalize": f"SELECT p_partkey, slug, CASE WHEN slug = 'unknown' THEN 'Unknown' ELSE {_TITLE} END AS name FROM (SELECT p_partkey, CASE WHEN contains(x, '/') THEN 'unknown' ELSE {_SLUG} END AS slug FROM (SELECT p_partkey, concat(' ', p_type, CASE WHEN p_partkey % 7 = 0 THEN '/x' ELSE ' ' END) AS x FROM part))",
    "handles": "SELECT p_partkey, substr(trim(regexp_replace(lower(p_name), '[^a-z0-9-]+', '-', 'g'), '-'), 1, 39) AS handle, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS key, upper(concat(substr(regexp_split_to_array(p_name, '\\s+')[1], 1, 1), substr(coalesce(regexp_split_to_array(p_name, '\\s+')[2], ''), 1, 1))) AS initials FROM part",
    "follow_up_classify": "SELECT p_partkey % 10 AS \"group\", count(*) FILTER (p_partkey % 3 = 1) AS revert, count(*) FILTER (p_partkey % 3 <> 1 AND regexp_matches(s, '\\b(fix|bugfix|patch|correct)\\b')) AS corrective, count(*) FILTER (regexp_matches(s, '\\bhot[\\s-]?fix\\b')) AS hotfix, count(*) FILTER (p_partkey % 4 = 0) AS bug_linked FROM (SELECT p_partkey, lower(concat(CASE p_partkey % 3 WHEN 0 THEN 'Fix ' WHEN 1 THEN 'Revert fix ' ELSE 'hot-fix ' END, p_name)) AS s FROM part) GROUP BY 1",
    "provider_of_model": """WITH m AS (SELECT concat(CASE WHEN p_size % 5 = 0 THEN 'my/' ELSE '' END, ['gpt-5-codex', 'o3', 'o1-mini', 'Opus-4', 'sonnet', 'grok-2', 'moonshot-v1', 'gemini-2', 'qwen3', 'llama-3', 'my-Claude', 'x-Kimi'][1 + p_partkey % 12], '-', CAST(p_size AS VARCHAR), ' ', p_brand) AS model FROM part)
  SELECT model, count(*) AS parts, CASE WHEN lower(model) LIKE '%codex%' OR regexp_matches(lower(model), '^(gpt-|o1|o3|o4)') THEN 'codex' WHEN lower(model) LIKE '%claude%' OR regexp_matches(lower(model), '^(opus|sonnet|haiku)') THEN 'claude' WHEN lower(model) LIKE '%grok%' THEN 'grok'
    WHEN lower(model) LIKE '%kimi%' OR lower(model) LIKE '%moonshot%' THEN 'kimi' WHEN lower(model) LIKE '%gemini%' THEN 'gemini' WHEN lower(model) LIKE '%qwen%' THEN 'qwen' ELSE 'unknown' END AS provider,
    regexp_matches(lower(model), '^(claude|gpt|o[0-9]|gemini|llama|mistral|deepseek|qwen|grok|codex|command|sonar)') AS known FROM m GROUP BY model""",
    "durability_windows": """WITH s AS (SELECT l_suppkey AS project, ['24h', '7d', '30d', '90d'][1 + l_linenumber % 4] AS "window", CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS introduced_lines, CAST(sum(CASE WHEN l_returnflag <> 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS remaining_lines FROM lineitem GROUP BY 1, 2)
  SELECT "window", project, introduced_lines, remaining_lines, CASE WHEN introduced_lines > 0 THEN floor(least(100, remaining_lines / introduced_lines * 100) * 10 + 0.5) / 10 END AS remaining_share, CASE "window" WHEN '24h' THEN 1 WHEN '7d' THEN 7 WHEN '30d' THEN 30 ELSE 90 END AS days FROM s""",
    "live_drift": f"""{_D}, p AS (SELECT provider, CAST(sum(fresh_tokens) AS BIGINT) AS f, CAST(sum(cached_tokens) AS BIGINT) AS c, CAST(sum(total_tokens) AS BIGINT) AS t, provider <> 'view' AS simulated, CASE provider WHEN 'click' THEN 0.62 WHEN 'purchase' THEN 0.38 ELSE 0 END AS part FROM d GROUP BY provider)
  SELECT provider, f + CASE WHEN simulated THEN CAST(floor(5580000 * part) AS BIGINT) ELSE 0 END AS fresh_tokens, c + CASE WHEN simulated THEN CAST(floor(62280000 * part) AS BIGINT) ELSE 0 END AS cached_tokens, t + CASE WHEN simulated THEN CAST(floor(67860000 * part) AS BIGINT) ELSE 0 END AS total_tokens, simulated FROM p""",
    "published_daily": f"{_D} SELECT CAST(date AS VARCHAR) AS date, provider, array_to_string(models[1:8], ',') AS models, total_tokens, CAST(NULL AS DOUBLE) AS estimated_cost_usd FROM d",
    "payload_gate": """SELECT n_nationkey * 100 + v AS id, CASE v WHEN 0 THEN 'INVALID_JSON' WHEN 1 THEN 'PAYLOAD_TOO_LARGE' WHEN 2 THEN 'UNKNOWN_FIELDS' WHEN 3 THEN 'FORBIDDEN_FIELDS' WHEN 4 THEN 'RAW_CONTENT' WHEN 5 THEN 'NOT_ALLOWLIST'
  WHEN 6 THEN 'RAW_LOGS' WHEN 7 THEN 'SECRET_PATTERN' WHEN 10 THEN 'INVALID_JSON' WHEN 12 THEN 'MALFORMED_SIGNATURE' WHEN 13 THEN 'KEY_MISMATCH' WHEN 14 THEN CASE WHEN n_regionkey = 0 THEN 'KEY_REVOKED' ELSE 'OK' END ELSE 'INVALID_SIGNATURE' END AS code
  FROM nation, (SELECT CAST(unnest(range(15)) AS INTEGER) AS v)""",
    "claim_ladder": f"{_M} SELECT s AS signal, count(*) FILTER (CASE s WHEN 'collector_observed_activity' THEN active_days > 30 WHEN 'device_signed_snapshot' THEN signature IN ('valid', 'historical') ELSE false END) AS present, count(*) AS members FROM mem, (VALUES ('collector_observed_activity'), ('provider_reported_token_counts'), ('device_signed_snapshot'), ('project_activity'), ('public_link'), ('self_reported_work'), ('imported_usage'), ('integrity_checks'), ('identity_proof'), ('durability_evidence')) v(s) GROUP BY 1",
    "invitation_codes": "SELECT code, count(*) AS invitations FROM (SELECT CASE WHEN c_custkey % 7 = 0 THEN 'INVALID_OPPORTUNITY_TYPE' WHEN c_custkey % 6 = 0 THEN 'FIELD_REQUIRED' WHEN c_custkey % 5 = 0 THEN 'INVALID_EMAIL' WHEN c_custkey % 6 * 6 - 1 < 20 THEN 'SCOPE_TOO_SHORT' WHEN c_custkey % 3 = 0 THEN 'COMPENSATION_REQUIRED' ELSE 'OK' END AS code FROM customer) GROUP BY 1",
    "event_sessions": "SELECT \"user\", count(*) AS sessions, CAST(sum(n) AS BIGINT) AS events FROM (SELECT \"user\", s, count(*) AS n FROM (SELECT \"user\", sum(new) OVER (PARTITION BY \"user\" ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id AS \"user\", ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1, 2) GROUP BY 1",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS sum_price, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    "revenue_by_nation": "SELECT r_name, n_name, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
    "top_orders_by_customer": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2",
    "unsold_parts": "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'",
    "order_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
}

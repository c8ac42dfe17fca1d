"""Usage records at any depth of JSON documents, and tables of imports."""

from __future__ import annotations

import json
import marshal
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, values

# Keys of daily feeds.
DAILY_DATES = ("date", "day", "period", "timestamp", "createdAt", "lastActivity")
DAILY_MARKS = ("inputTokens", "outputTokens", "cacheReadTokens", "cacheCreationTokens", "totalTokens", "totalCost", "cachedInputTokens")
DAILY_ALIASES = {
    "input_tokens": ("inputTokens", "input_tokens", "input", "tokensInput"),
    "output_tokens": ("outputTokens", "output_tokens", "output", "tokensOutput"),
    "cache_creation_tokens": ("cacheCreationTokens", "cache_creation_tokens", "cacheWriteTokens", "cache_write_tokens", "cacheCreateTokens"),
    "cache_read_tokens": ("cacheReadTokens", "cache_read_tokens", "cachedInputTokens", "cachedReadTokens", "cache_read"),
    "reported_total": ("totalTokens", "total_tokens", "tokensTotal", "total"),
    "cost": ("estimatedCostUsd", "totalCost", "total_cost", "cost", "costUsd", "cost_usd"),
}
# Import columns by their names without case and signs. Bare "prompt" and "completion" hold text, not counts.
IMPORT_ALIASES = {
    "date": ("date", "day", "timestamp", "occurredat", "createdat", "time", "usagedate"),
    "provider": ("provider", "source", "tool", "vendor", "service", "platform"),
    "model": ("model", "modelname", "modelid", "engine"),
    "input": ("inputtokens", "input", "prompttokens", "intokens"),
    "output": ("outputtokens", "output", "completiontokens", "outtokens"),
    "cache_read": ("cachereadtokens", "cachereadinputtokens", "cachedtokens", "cachedinputtokens", "cacheread"),
    "cache_creation": ("cachecreationtokens", "cachewritetokens", "cachecreationinputtokens", "cachecreate"),
    "total": ("totaltokens", "tokens", "totaltoken", "total"),
}


def _plain(key: str) -> str:
    return "".join(c for c in key.lower() if c.isascii() and c.isalnum())


def objects(document: object) -> Iterator[dict]:
    """All objects of a document, parents before children, in document order."""
    waiting = [document]
    while waiting:
        x = waiting.pop()
        if isinstance(x, dict):
            yield x
            waiting.extend(reversed(list(x.values())))
        elif isinstance(x, list):
            waiting.extend(reversed(x))


def _parsed(document: str | None, each: Callable[[list[tuple[str, object]]], object] | None = None) -> object:
    """A document's value, with ``each`` in the place of its objects; None for one that is no JSON, or nested too deep for a parser."""
    try:
        return json.loads(document, object_pairs_hook=each) if document else None
    except (ValueError, RecursionError):
        return None


def _written(record: dict) -> str | None:
    try:
        return json.dumps(record)
    except RecursionError:
        return None


class DailyRecords:
    """UDTF: documents to their dated, usage-shaped objects: ord, record (JSON)."""

    def eval(self, document: str):
        n = 0
        for x in objects(_parsed(document)):
            date = next((x[k] for k in DAILY_DATES if x.get(k) is not None), None)
            if isinstance(date, str) and date[:10].count("-") == 2 and any(k in x for k in DAILY_MARKS) and (record := _written(x)):
                yield n, record
                n += 1


def _as_text(x: object) -> str | None:
    """A JSON scalar as text, half characters replaced; None for null, objects and lists."""
    if x is None or isinstance(x, (str, bytes, dict, list)):
        return x.encode("utf-8", "replace").decode() if isinstance(x, str) else None
    return json.dumps(x)


class _Kept(list):
    """What stays of an object that holds others: packed records and what their objects hold, in document order."""


def _packed(x: list | bytes) -> list | bytes:
    """What of a value holds records; lists of whatever depth become one."""
    if isinstance(x, (bytes, _Kept)):
        return x
    out, waiting = _Kept(), [x]
    while waiting:
        y = waiting.pop()
        if isinstance(y, (bytes, _Kept)):
            out.append(y)
        elif isinstance(y, list):
            waiting.extend(reversed(y))
    return out


def _import_record(pairs: list[tuple[str, object]]) -> list | bytes | None:
    """What stays of an object while its document is read: its own record, packed, if it has a date and usage, and what its values hold."""
    x = dict(pairs)
    plain = {_plain(k): v for k, v in x.items()}
    kept = _Kept(w for v in x.values() if isinstance(v, (bytes, list)) and (w := _packed(v)))
    if any(a in plain for a in IMPORT_ALIASES["date"]) and any(a in plain for f in ("input", "output", "total") for a in IMPORT_ALIASES[f]):
        record = marshal.dumps(tuple(next((t for a in aliases if (t := _as_text(plain.get(a))) is not None), None) for aliases in IMPORT_ALIASES.values()))
        return _Kept([record, *kept]) if kept else record
    return kept or None


class ImportRecords:
    """UDTF: documents to objects with a date and usage under any known name: ord, and the text of each known field.

    Of a document only the packed records are kept while it is read, not its objects.
    """

    def eval(self, document: str):
        n, waiting = 0, [_parsed(document, _import_record)]
        while waiting:
            x = waiting.pop()
            if isinstance(x, bytes):
                yield n, *marshal.loads(x)
                n += 1
            elif isinstance(x, list):
                waiting.extend(reversed(x))


def _records(documents: DataFrame, finder: type, columns: str) -> DataFrame:
    """documents with the ord and other columns of each object that a finder yields."""
    return documents.lateralJoin(F.udtf(finder, returnType=f"ord int, {columns}")(F.col("document").outer()))


def _first_number(record: Column, aliases: tuple[str, ...]) -> Column:
    """The first alias that holds a number, or a text that reads as one; else 0."""
    return F.coalesce(*[values.lenient_number(record[a]) for a in aliases], F.lit(0.0))


def daily_rows(documents: DataFrame, provider: str) -> DataFrame:
    """Daily rows of documents (source, document) in the order of sources and records.

    date, provider, models, counts, total as the sum of its parts, the reported total where it disagrees,
    cost (null if none). Rows without a positive total are dropped: nothing is made up.
    """
    names = dict.fromkeys([*DAILY_DATES, "provider", "agent", "source", "models", "modelsUsed", "model", "modelName", *[a for x in DAILY_ALIASES.values() for a in x]])
    parsed = F.from_json("record", ",".join(f"`{n}` string" for n in names))  # once, not for each name
    r = _records(documents.select("source", "document"), DailyRecords, "record string").select("source", "ord", values.once(parsed).alias("record"))
    get = lambda k: F.col("record")[k]
    own = text.provider_slug(F.coalesce(get("provider"), get("agent"), get("source")))
    models = F.coalesce(*[F.from_json(get(k), "array<string>") for k in ("models", "modelsUsed")], *[F.array(get(k)) for k in ("model", "modelName")])
    r = r.select("source", "ord", F.coalesce(*[get(k) for k in DAILY_DATES]).alias("raw_date"), F.coalesce(F.when(own != "all", own), F.lit(provider)).alias("provider"), F.coalesce(text.safe_models(models), F.array().cast("array<string>")).alias("models"), *[_first_number(F.col("record"), a).alias(k) for k, a in DAILY_ALIASES.items()])
    r = r.withColumn("date", F.substring("raw_date", 1, 10).try_cast("date"))
    counts = [values.whole_or_zero(F.col(k)).alias(k) for k in ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens")]
    r = r.select("source", "ord", "date", "provider", "models", *counts, values.whole_or_zero(F.col("reported_total")).alias("reported_total"), F.when(F.col("cost") > 0, F.col("cost")).alias("estimated_cost_usd"))
    r = r.withColumn("cached_tokens", F.col("cache_creation_tokens") + F.col("cache_read_tokens")).withColumn("fresh_tokens", F.col("input_tokens") + F.col("output_tokens"))
    r = r.withColumn("total_tokens", F.col("cached_tokens") + F.col("fresh_tokens"))
    r = r.withColumn("reported_total", F.when((F.col("reported_total") > 0) & (F.col("reported_total") != F.col("total_tokens")), F.col("reported_total")))
    return r.filter("date is not null and total_tokens > 0")


def detect_format(content: str, filename: str = "", chosen: str = "auto") -> str:
    """csv or json: as chosen, else by the file's ending, else by the first sign."""
    if chosen != "auto":
        return chosen
    for kind in ("csv", "json"):
        if filename.lower().endswith(f".{kind}"):
            return kind
    return "json" if content.lstrip()[:1] in ("{", "[") else "csv"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header: quoted fields, doubled quotes, line ends within quotes; blank rows are dropped."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).csv(path)
    return df.filter(F.coalesce(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in df.columns]).isNotNull()) if df.columns else df


def columns_by_field(headers: list[str]) -> dict[str, str]:
    """Field -> the first header that names it."""
    found: dict[str, str] = {}
    for h in headers:
        for field, aliases in IMPORT_ALIASES.items():
            if field not in found and _plain(h) in aliases:
                found[field] = h
    return found


def import_table(df: DataFrame, ordinal: Column) -> DataFrame:
    """A table under any headers as text columns ord and the known fields (null where there is none)."""
    named = columns_by_field(df.columns)
    return df.select(ordinal.alias("ord"), *[(F.col(f"`{named[f]}`").cast("string") if f in named else F.lit(None).cast("string")).alias(f) for f in IMPORT_ALIASES])


def import_documents(documents: DataFrame) -> DataFrame:
    """Records of JSON exports (document) as text columns ord and the known fields."""
    return _records(documents.select("document"), ImportRecords, ", ".join(f"{f} string" for f in IMPORT_ALIASES)).select("ord", *IMPORT_ALIASES)


def import_events(rows: DataFrame, source: str, kind: str, provider: str = "imported") -> DataFrame:
    """Events of imported rows: low confidence, at noon of their day, apart from measured ones.

    An explicit total is trusted, else it is the sum of the parts; rows without a date or a positive total
    are skipped. Ids hold the row's ordinal, so that the same file again adds nothing.
    """
    n = {f: values.whole_or_zero(values.lenient_number(F.col(f), spaces=True, negatives=False)) for f in ("input", "output", "cache_read", "cache_creation", "total")}
    read = F.struct(values.any_date(F.col("date")).alias("local_date"), text.safe_label(F.coalesce("provider", F.lit(provider)), 40, provider).alias("provider"), text.safe_label(F.col("model"), 80, None).alias("model"), n["input"].alias("input_tokens"), n["output"].alias("output_tokens"), n["cache_creation"].alias("cache_creation_tokens"), n["cache_read"].alias("cache_read_tokens"), n["total"].alias("explicit"))
    r = rows.select("ord", read.alias("read")).select("ord", values.once(F.col("read")).alias("read")).select("ord", "read.*")
    parts = F.col("input_tokens") + F.col("output_tokens") + F.col("cache_creation_tokens") + F.col("cache_read_tokens")
    r = r.withColumn("total_tokens", F.when(F.col("explicit") > 0, F.col("explicit")).otherwise(parts)).filter("local_date is not null and total_tokens > 0")
    return r.withColumns(
        {
            "event_id": values.short_hash(F.lit("imported"), F.lit(source), F.col("local_date"), F.col("provider"), F.col("model"), F.col("input_tokens"), F.col("output_tokens"), F.col("cache_read_tokens"), F.col("cache_creation_tokens"), F.col("ord")),
            "occurred_at": F.to_timestamp(F.concat(F.col("local_date").cast("string"), F.lit("T12:00:00Z"))),
            "measurement_class": F.lit("user_submitted"),
            "confidence": F.lit("low"),
            "adapter": F.lit(f"import:{kind}"),
            "adapter_version": F.lit("1.0.0"),
            "source_fingerprint": values.short_hash(F.lit(f"import:{source}"), n=24),
            "origin": F.lit("imported"),
            "source_label": F.lit(source),
        }
    ).drop("explicit", "ord")


def import_summary(rows: DataFrame, events: DataFrame) -> DataFrame:
    """rows, imported, skipped, total_tokens of an import."""
    a = rows.agg(F.count("*").alias("rows"))
    b = events.agg(F.count("*").alias("imported"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"))
    return a.crossJoin(b).select("rows", "imported", (F.col("rows") - F.col("imported")).alias("skipped"), "total_tokens")  # one row each

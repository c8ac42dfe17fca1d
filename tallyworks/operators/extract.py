"""Usage events from the lines of four log formats.

Input: lines with file, modified, block, seq, line (see sources.lines). Only the columns named here are
read of a line; texts, folders and ids never reach an event but as keyed or plain hashes.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, values
from ..schema import EVENT_VERSION

COUNTS = ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens")


def _events(df: DataFrame, provider: str, adapter: str, version: str) -> DataFrame:
    return df.withColumns({"provider": F.lit(provider), "adapter": F.lit(adapter), "adapter_version": F.lit(version), "event_schema_version": F.lit(EVENT_VERSION), "measurement_class": F.lit("provider_reported"), "confidence": F.lit("high"), "origin": F.lit("local_log"), "source_label": F.lit(None).cast("string"), "occurred_at": F.try_to_timestamp("occurred_at_raw")})


def fingerprint(file: Column) -> Column:
    return values.short_hash(file, n=24)


_USAGE = "struct<input_tokens:double,inputTokens:double,output_tokens:double,outputTokens:double,cache_creation_input_tokens:double,cacheCreationInputTokens:double,cache_read_input_tokens:double,cacheReadInputTokens:double>"


def message_usage(lines: DataFrame, provider: str, key: bytes, adapter: str = "jsonl", version: str = "1.0.0") -> DataFrame:
    """Format A: a message with its usage in each line. key: of the session pseudonyms."""
    schema = f"timestamp string, sessionId string, requestId string, model string, usage {_USAGE}, message struct<id:string,model:string,usage:{_USAGE}>"
    j = lines.filter(F.col("line").contains("oken")).select("file", values.once(F.from_json("line", schema)).alias("j")).select("file", "j.*")
    u = F.coalesce("message.usage", "usage")
    pick = lambda *names: values.count_or_zero(F.coalesce(*[u[n] for n in names]))
    e = j.select(
        "file", values.iso_or_null(F.col("timestamp")).alias("occurred_at_raw"), text.safe_model(F.coalesce("message.model", "model")).alias("model"),
        pick("input_tokens", "inputTokens").alias("input_tokens"), pick("output_tokens", "outputTokens").alias("output_tokens"),
        pick("cache_creation_input_tokens", "cacheCreationInputTokens").alias("cache_creation_tokens"), pick("cache_read_input_tokens", "cacheReadInputTokens").alias("cache_read_tokens"),
        values.pseudonym(F.col("sessionId"), key).alias("session_pseudonym"), F.col("message.id").alias("message_id"), F.col("requestId").alias("request_id"),
    ).withColumn("total_tokens", sum((F.col(c) for c in COUNTS), F.lit(0)))
    e = e.filter("total_tokens > 0 and occurred_at_raw is not null").withColumn("event_id", values.event_id(F.lit(provider), F.col("message_id"), F.col("request_id"), F.col("occurred_at_raw"), F.col("model"), *[F.col(c) for c in COUNTS], F.col("session_pseudonym")))
    return _events(e.withColumn("source_fingerprint", fingerprint(F.col("file"))).drop("message_id", "request_id", "file"), provider, adapter, version)


def _turns(lines: DataFrame, before: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(usage lines with the model named last and the turn's number, what each file hands on: file, model, turns)."""
    last = "struct<input_tokens:double,cached_input_tokens:double,output_tokens:double>"
    schema = f"type string, timestamp string, payload struct<type:string,model:string,info:struct<last_token_usage:{last}>>"
    j = lines.select("file", "block", "seq", values.once(F.from_json("line", schema)).alias("j")).select("file", "block", "seq", "j.*")
    context = F.coalesce((F.col("payload.type") == "turn_context") | (F.col("type") == "turn_context"), F.lit(False))
    usage = F.col("payload.info.last_token_usage")
    whole, out = values.count_or_zero(usage["input_tokens"]), values.count_or_zero(usage["output_tokens"])
    at = values.iso_or_null(F.col("timestamp"))
    is_event = F.coalesce(~context & (F.col("payload.type") == "token_count") & usage.isNotNull() & (whole + out > 0) & at.isNotNull(), F.lit(False))
    named = F.when(context, text.safe_model(F.col("payload.model")))
    some = j.filter(context | is_event).select("file", "block", "seq", is_event.alias("is_event"), named.alias("named"), at.alias("occurred_at_raw"), whole.alias("whole"), out.alias("out"), values.count_or_zero(usage["cached_input_tokens"]).alias("cached"))
    handed = some.groupBy("file", "block").agg(F.max_by("named", F.when(F.col("named").isNotNull(), F.col("seq"))).alias("last_named"), F.count_if("is_event").alias("turns"))
    if before is not None:  # as a block before all others
        handed = handed.unionByName(before.select("file", F.lit(-1).cast("long").alias("block"), F.col("model").alias("last_named"), "turns"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    after = handed.groupBy("file").agg(F.max_by("last_named", F.when(F.col("last_named").isNotNull(), F.col("block"))).alias("model"), F.sum("turns").alias("turns"))
    handed = handed.select("file", "block", F.last("last_named", ignorenulls=True).over(earlier).alias("model_before"), F.coalesce(F.sum("turns").over(earlier), F.lit(0)).alias("turns_before"))
    w = Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = some.withColumns({"model_here": F.last("named", ignorenulls=True).over(w), "turns_here": F.sum(F.col("is_event").cast("long")).over(w)}).filter("is_event")
    # there may be as many files as lines: never a table to broadcast, however small its scan looks
    return own.join(handed.hint("merge"), ["file", "block"]), after


def turn_state(lines: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """What files hand on after these lines: file, model, turns. See ``before`` of :func:`turn_deltas`."""
    return _turns(lines, before)[1]


def turn_deltas(lines: DataFrame, provider: str, adapter: str = "turns", version: str = "1.0.0", before: DataFrame | None = None) -> DataFrame:
    """Format B: each turn's usage, with the model named in an earlier line of the file.

    Cached input is part of the input. Computed from a file's start; a running total is never read. Lines are
    ordered within the blocks of a file, and what each block hands on - the model last named, the turns so far -
    is carried over its blocks, so that a large file is not one task.

    :param before: what files handed on before these lines (file, model, turns), where the lines are not all.
    """
    j = _turns(lines, before)[0]
    e = j.select(F.coalesce("model_here", "model_before").alias("model"), (F.col("turns_before") + F.col("turns_here")).alias("turn"), "occurred_at_raw", F.greatest(F.col("whole") - F.col("cached"), F.lit(0)).alias("input_tokens"), F.col("out").alias("output_tokens"), F.lit(0).cast("long").alias("cache_creation_tokens"), F.col("cached").alias("cache_read_tokens"), (F.col("whole") + F.col("out")).alias("total_tokens"), fingerprint(F.col("file")).alias("source_fingerprint"))
    e = e.withColumn("event_id", values.short_hash(F.lit(provider), F.col("occurred_at_raw"), F.col("model"), F.col("input_tokens"), F.col("output_tokens"), F.col("cache_read_tokens"), F.col("source_fingerprint"), F.col("turn")))
    return _events(e.drop("turn").withColumn("session_pseudonym", F.lit(None).cast("string")), provider, adapter, version)


# Names that cumulative lines use, in the order they are tried.
TOTALS_SO_FAR = {
    "input": ("inputTokens", "input_tokens"),
    "output": ("outputTokens", "output_tokens"),
    "read": ("cachedReadTokens", "cacheReadTokens", "cache_read_tokens"),
    "creation": ("cacheCreationTokens", "cache_creation_tokens"),
}
LINE_TIMES = ("timestamp", "updated_at", "created_at")


def _first(names: tuple[str, ...], *objects: dict) -> object:
    return next((o[n] for o in objects for n in names if o.get(n) is not None), None)


def _walk(document: object, most_entries: int | None) -> Iterator[dict]:
    """Objects of a line, parents first, later children before earlier ones; of a list the first ``most_entries``, or all."""
    waiting = [document]
    while waiting:
        x = waiting.pop()
        if isinstance(x, dict):
            yield x
        waiting.extend(child for child in ([*x.values()] if isinstance(x, dict) else x[:most_entries]) if isinstance(child, (dict, list)))


def _number(x: object, least: float, most: float) -> float | None:
    """A JSON number within bounds as a double; whole numbers may have any digits."""
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) and least <= x <= most else None


def _string(x: object) -> str | None:
    """A JSON string, half characters replaced."""
    return x.encode("utf-8", "replace").decode() if isinstance(x, str) else None


def _totals(holder: dict) -> dict | None:
    """Counts, model and time that an object holds, itself or under ``usage``; null, and what is no count, counts as none."""
    usage = holder["usage"] if isinstance(holder.get("usage"), dict) else holder
    got = {k: _first(names, usage) for k, names in TOTALS_SO_FAR.items()}
    got = {k: _number(v, 0, values.MOST_COUNT) or 0.0 for k, v in got.items()}
    if not got["input"] + got["output"] + got["read"]:
        return None
    model, time = _first(("model",), usage, holder) or holder.get("modelId"), _first(LINE_TIMES, holder)
    if not model and isinstance(usage.get("modelUsage"), dict):
        model = next(iter(usage["modelUsage"]), None)
    return got | {"model": _string(model), "text_time": _string(time), "number_time": _number(time, values.FIRST_MS, values.LAST_MS)}


def usage_in(line: object, most_entries: int | None = None) -> dict | None:
    """The usage met last on the walk of a line; a model or time that it lacks comes from those before."""
    met = [t for t in map(_totals, _walk(line, most_entries)) if t] if isinstance(line, (dict, list)) else []
    if not met:
        return None
    return met[-1] | {k: next((t[k] for t in reversed(met) if t[k] is not None), None) for k in ("model", "text_time", "number_time")}


_FOUND = "struct<input:double,output:double,read:double,creation:double,model:string,text_time:string,number_time:double>"


def cumulative_final(lines: DataFrame, provider: str, adapter: str = "cumulative", version: str = "1.0.0", by_counts: bool = False, most_entries: int | None = None) -> DataFrame:
    """Format C: totals so far in each line; a file's last one counts. One event for each file.

    :param most_entries: of a list in a line only so many entries are looked at (some logs' readers stop
        there); None for all. Lines that are no JSON, or nested too deep for a parser, have no usage.

    Cached input is taken off the input where it fits in. The time is the line's, else the file's. With
    by_counts the id holds the counts, so that a file that has grown gives another event (as some logs'
    readers do); without, it replaces the older one.
    """

    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cols = ["input", "output", "read", "creation", "model", "text_time", "number_time"]
        for s in batches:
            rows = []
            for x in s:
                try:
                    rows.append(usage_in(json.loads(x), most_entries) or dict.fromkeys(cols))
                except (ValueError, RecursionError):
                    rows.append(dict.fromkeys(cols))
            yield pd.DataFrame(rows, columns=cols)

    usage = F.pandas_udf(find, _FOUND)
    u = lines.filter(F.col("line").contains("usage") | F.col("line").contains("Token")).select("file", "modified", F.struct("block", "seq").alias("at"), usage("line").alias("u")).filter("u.input is not null")
    last = u.groupBy("file").agg(F.max_by(F.struct("u", "modified"), "at").alias("x")).select("file", "x.u.*", "x.modified")
    count = lambda c: F.col(c).cast("long")
    fresh = F.when(F.col("input") >= F.col("read"), count("input") - count("read")).otherwise(count("input"))
    time = F.coalesce(values.any_time(F.col("text_time"), F.col("number_time")), F.col("modified"))
    e = last.select("file", text.safe_model(F.trim("model")).alias("model"), time.alias("time"), fresh.alias("input_tokens"), count("output").alias("output_tokens"), count("creation").alias("cache_creation_tokens"), count("read").alias("cache_read_tokens")).withColumn("total_tokens", sum((F.col(c) for c in COUNTS), F.lit(0))).filter("total_tokens > 0")
    extra = [F.col(c) for c in COUNTS] if by_counts else []
    e = e.withColumn("event_id", values.short_hash(F.lit(provider), F.col("file"), *extra)).withColumn("source_fingerprint", fingerprint(F.col("file"))).withColumn("session_pseudonym", values.short_hash(F.col("file"), n=24)).withColumn("occurred_at_raw", F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    return _events(e.drop("file", "time"), provider, adapter, version)


# Names that turn records use, in the order they are tried.
TURN_INPUT = ("input_other", "inputOther", "input_tokens", "inputTokens", "prompt_tokens", "promptTokens")
TURN_OUTPUT = ("output", "output_tokens", "outputTokens", "completion_tokens")
TURN_READ = ("input_cache_read", "inputCacheRead", "cache_read_tokens", "cacheReadTokens", "cache_read_input_tokens")
TURN_CREATION = ("input_cache_creation", "inputCacheCreation", "cache_creation_tokens", "cacheCreationTokens", "cache_creation_input_tokens")
TURN_KEYS = ("message_id", "messageId", "turn_id", "turnId", "id")
TURN_MODELS = ("model", "model_name", "modelName")
TURN_SCOPES = ("scope", "recordScope", "level")
TURN_TOTALS = ("sessionTotal", "isSessionTotal")
TURN_TIMES = ("timestamp", "occurredAt", "created_at", "createdAt", "updated_at", "time")


def turn_records(lines: DataFrame, provider: str, adapter: str = "turn-records", version: str = "1.0.0", default_model: str | None = None) -> DataFrame:
    """Format D: records scoped to a turn; those scoped to a session restate totals and are left out.

    Of the places where a line may hold usage the first with a positive total counts.
    """
    # the line is parsed once, into the places where usage may stand
    names_ = dict.fromkeys((*TURN_INPUT, *TURN_OUTPUT, *TURN_READ, *TURN_CREATION, *TURN_KEYS, *TURN_TIMES, *TURN_MODELS, *TURN_SCOPES, *TURN_TOTALS))
    fields = ",".join(f"{n}:string" for n in names_)
    usage = ",".join(f"{n}:struct<{fields}>" for n in ("usage", "token_usage", "tokenUsage"))
    schema = f"struct<{fields},{usage},payload:struct<{fields},{usage}>,message:struct<{fields}>,data:struct<{fields}>>"
    number = lambda base, names: values.count_or_zero(F.coalesce(*[base[n].try_cast("double") for n in names]))
    string = lambda base, names: F.coalesce(*[base[n] for n in names])

    def candidate(base: Column) -> Column:
        i, o, r, c = (number(base, n) for n in (TURN_INPUT, TURN_OUTPUT, TURN_READ, TURN_CREATION))
        return F.struct(i.alias("input_tokens"), o.alias("output_tokens"), c.alias("cache_creation_tokens"), r.alias("cache_read_tokens"), (i + o + c + r).alias("total_tokens"), string(base, TURN_MODELS).alias("model"), string(base, TURN_TIMES).alias("time"), string(base, TURN_KEYS).alias("key"), session_scoped(base).alias("scoped"))

    def session_scoped(base: Column) -> Column:
        scope = F.lower(string(base, TURN_SCOPES))
        return F.coalesce(scope.isin("session", "session_scoped", "cumulative"), F.lit(False)) | F.coalesce(string(base, TURN_TOTALS) == "true", F.lit(False))

    root, payload = F.col("j"), F.col("j.payload")
    own = lambda c: F.struct(*[c[n].alias(n) for n in names_])
    places = [F.col(f"j.{p}") for p in ("usage", "token_usage", "tokenUsage", "payload.usage", "payload.token_usage", "payload.tokenUsage")] + [own(payload), F.col("j.message"), F.col("j.data"), own(root)]
    j = lines.filter(F.col("line").contains("sage") | F.col("line").contains("oken")).select("file", "block", "seq", "modified", values.once(F.from_json("line", schema)).alias("j"))
    j = j.filter(~session_scoped(root) & ~session_scoped(payload))
    there = F.filter(F.array(*places), lambda x: x.isNotNull())  # most lines have few of the places
    found = F.explode(F.slice(F.filter(F.transform(there, candidate), lambda x: (x["total_tokens"] > 0) & ~x["scoped"]), 1, 1))  # the first, or no row
    j = j.select("file", "block", "seq", "modified", found.alias("u"), string(root, TURN_MODELS).alias("root_model"), string(root, TURN_TIMES).alias("root_time"), string(payload, TURN_TIMES).alias("payload_time"), string(root, ("message_id", "messageId", "id")).alias("root_key"))
    raw = F.coalesce("u.time", "root_time", "payload_time")
    time = F.coalesce(values.any_time(raw, raw.try_cast("double")), F.col("modified"))
    key = F.substring(F.coalesce("u.key", "root_key", F.concat_ws(":", "block", "seq")), 1, 120)
    e = j.select("file", "u.input_tokens", "u.output_tokens", "u.cache_creation_tokens", "u.cache_read_tokens", "u.total_tokens", text.safe_model(F.trim(F.coalesce("u.model", "root_model", F.lit(default_model)))).alias("model"), time.alias("time"), key.alias("key"))
    e = e.withColumn("event_id", values.short_hash(F.lit(provider), F.col("file"), F.col("key"))).withColumn("source_fingerprint", fingerprint(F.col("file"))).withColumn("session_pseudonym", values.short_hash(F.col("file"), n=24)).withColumn("occurred_at_raw", F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    return _events(e.drop("file", "time", "key"), provider, adapter, version)


#: Extractors by format; more can be added under a name of their own.
EXTRACTORS: dict[str, Callable[..., DataFrame]] = {"message_usage": message_usage, "turn_deltas": turn_deltas, "cumulative_final": cumulative_final, "turn_records": turn_records}


def register(name: str, extractor: Callable[..., DataFrame]) -> None:
    EXTRACTORS[name] = extractor


def extract(lines: DataFrame, kind: str, **options) -> DataFrame:
    return EXTRACTORS[kind](lines, **options)

"""Numbers, times, arrays, maps and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"


#: Counts above it are none: doubles, as logs hold them, skip whole numbers from there on.
MOST_COUNT = (1 << 53) - 1
#: Milliseconds of the years 1 to 9999.
FIRST_MS, LAST_MS = -62_135_596_800_000, 253_402_300_799_999


def once(x: Column) -> Column:
    """A column computed once for each row: filters that read a generated column do not compute it again below themselves."""
    return F.explode(F.array(x))


def count_or_zero(x: Column) -> Column:
    """A number as a count: null, NaN, negative values and those above MOST_COUNT are 0."""
    return F.when(x.try_cast("double").between(0, MOST_COUNT), x.try_cast("long")).otherwise(F.lit(0).cast("long"))


def whole_or_zero(x: Column) -> Column:
    """A number cut to a whole one: null, NaN and those beyond MOST_COUNT, up or down, are 0."""
    return F.when(x.try_cast("double").between(-MOST_COUNT, MOST_COUNT), x.try_cast("long")).otherwise(F.lit(0).cast("long"))


def lenient_number(x: Column, spaces: bool = False, negatives: bool = True) -> Column:
    """Number of a text like $1,234; the empty text is 0; null where it is none.

    With ``spaces`` white space goes too; without ``negatives`` they, and texts that are no number, are 0.
    """
    plain = F.regexp_replace(x.cast("string"), r"[$,\s]" if spaces else "[$,]", "")
    n = F.when(F.trim(plain) == "", F.lit(0.0)).otherwise(F.trim(plain).try_cast("double"))
    n = F.when(F.isnan(n) | (F.abs(n) == float("inf")), None).otherwise(n)
    return n if negatives else F.when(n >= 0, n).otherwise(0.0)


def js_round(x: Column) -> Column:
    """Halves towards plus infinity."""
    return F.floor(x + 0.5)


def share(part: Column, whole: Column) -> Column:
    """Per cent with one decimal; null where the whole is not positive."""
    return F.when(whole > 0, js_round(part / whole * 1000) / 10)


def clamped(x: Column, least: float, most: float) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), x))


def safe_percent(x: Column) -> Column:
    return F.when(x.between(0, 100), x)


def micro_usd(x: Column) -> Column:
    return js_round(x * 1e6)


def iso_or_null(x: Column) -> Column:
    return F.when(x.rlike(ISO), x)


def from_epoch(x: Column) -> Column:
    """Timestamp of seconds, or of milliseconds where the number is above 1e12; null outside the years 1 to 9999."""
    d = x.try_cast("double")
    ms = F.when(d > 1e12, d).otherwise(d * 1000)
    return F.timestamp_millis(F.when(ms.between(FIRST_MS, LAST_MS), ms).cast("long"))


def any_time(text: Column, number: Column) -> Column:
    """Timestamp of an ISO text, else of an epoch number."""
    return F.coalesce(F.try_to_timestamp(iso_or_null(text)), from_epoch(number))


#: Date texts understood beside YYYY-MM-DD...; a closed list in place of open-ended guessing.
DATE_FORMATS = ("MM/dd/yyyy", "M/d/yyyy", "MMM d, yyyy", "d MMM yyyy", "yyyy/MM/dd")


def any_date(text: Column) -> Column:
    """Date of a text: an ISO beginning, one of DATE_FORMATS, or an epoch number; else null."""
    t = F.trim(text)
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(t, 1, 10).try_cast("date"))
    epoch = F.when(t.rlike(r"^\d{9,14}$"), F.to_date(from_epoch(t.try_cast("long"))))
    return F.coalesce(iso, epoch, *[F.to_date(F.try_to_timestamp(t, F.lit(f))) for f in DATE_FORMATS])


def local_date(ts: Column, zone: str | Column) -> Column:
    """Calendar date of a UTC timestamp in a zone."""
    return F.to_date(F.from_utc_timestamp(ts, zone))


def known_zone(zone: str) -> str:
    """The zone, or UTC if there is none of this name."""
    from zoneinfo import ZoneInfo

    try:
        return ZoneInfo(zone).key
    except (KeyError, ValueError, OSError):
        return "UTC"


def short_hash(*parts: Column, n: int = 32) -> Column:
    """First n hex digits of SHA-256 over the parts, joined by bars; null parts are empty."""
    joined = parts[0] if len(parts) == 1 else F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.substring(F.sha2(joined, 256), 1, n)


def event_id(provider: Column, message_id: Column, request_id: Column, *content: Column) -> Column:
    """Identity of a call: the provider's own ids if there are any, else the content."""
    m, r = F.coalesce(message_id, F.lit("")), F.coalesce(request_id, F.lit(""))
    by_id = F.concat(F.lit("msg:"), m, F.lit("|req:"), r)
    by_content = F.concat(F.lit("content:"), F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in content]))
    return F.substring(F.sha2(F.concat(provider, F.lit("|"), F.when((m != "") | (r != ""), by_id).otherwise(by_content)), 256), 1, 32)


def hmac_sha256(message: Column, key: bytes) -> Column:
    """HMAC-SHA-256 in hex, composed of two hashes."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda byte: F.unhex(F.lit(bytes(b ^ byte for b in block).hex()))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def pseudonym(value: Column, key: bytes, n: int = 24) -> Column:
    """Keyed pseudonym of a non-empty text, else null."""
    return F.when(F.length(value) > 0, F.substring(hmac_sha256(value, key), 1, n))


def fnv1a_base36(x: Column, n: int = 6) -> Column:
    """FNV-1a of the characters, 32 bits, in base 36, the first n digits."""
    step = lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF))
    h = F.aggregate(F.filter(F.split(x, ""), lambda c: c != ""), F.lit(2166136261), step)
    return F.substring(F.lower(F.conv(h.cast("string"), 10, 36)), 1, n)


def union_arrays(collected: Column, most: int | None = None) -> Column:
    """Sorted distinct members of collected arrays."""
    out = F.array_sort(F.array_distinct(F.flatten(collected)))
    return out if most is None else F.slice(out, 1, most)


def counts_by_key(m: Column, key_pattern: str = r"^[A-Za-z0-9._-]{1,40}$") -> Column:
    """Entries of a map whose keys fit, with values as counts."""
    return F.transform_values(F.map_filter(m, lambda k, v: k.rlike(key_pattern)), lambda k, v: count_or_zero(v))


def merged_map(base: Column, over: Column) -> Column:
    """Entries of both maps; ``over`` wins."""
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(over), k)), over)


def sum_of_map(m: Column) -> Column:
    return F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda a, x: a + whole_or_zero(x))

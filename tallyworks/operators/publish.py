"""The published snapshot: allowlisted columns, consent, canonical form, hashes, signatures."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import safe_models
from ..functions.values import count_or_zero

METRICS = ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "cached_tokens", "fresh_tokens", "total_tokens")
DATE = r"^\d{4}-\d{2}-\d{2}$"
ZONE = r"^[A-Za-z0-9_+/-]{1,64}$"


def allowlisted(daily: DataFrame, most_models: int = 8) -> DataFrame:
    """Daily rows with the published columns only, typed and bounded, in a fixed order."""
    day = F.col("date").cast("string")
    return daily.filter(day.rlike(DATE)).select(day.alias("date"), F.substring("provider", 1, 40).alias("provider"), F.coalesce(safe_models(F.col("models"), most_models), F.array().cast("array<string>")).alias("models"), *[count_or_zero(F.col(c)).alias(c) for c in METRICS], F.when(F.col("estimated_cost_usd") >= 0, F.col("estimated_cost_usd")).alias("estimated_cost_usd"))


def capped(entries: Column, fields: dict[str, int], most: int) -> Column:
    """An array of structs with these text fields only, each cut to length, at most ``most`` entries."""
    return F.slice(F.transform(entries, lambda e: F.struct(*[F.substring(e[f], 1, n).alias(f) for f, n in fields.items()])), 1, most)


def consented(daily: DataFrame, fields: dict[str, bool]) -> DataFrame:
    """Fields that a member switched off: cost becomes null, models empty, other columns go."""
    off = [f for f, on in fields.items() if not on]
    for f in off:
        if f == "cost":
            daily = daily.withColumn("estimated_cost_usd", F.lit(None).cast("double"))
        elif f == "models":
            daily = daily.withColumn("models", F.array().cast("array<string>"))
        else:
            daily = daily.drop(f)
    return daily


def disabled(fields: Column) -> Column:
    """Names of a map field -> allowed that are switched off, in order."""
    return F.array_sort(F.map_keys(F.map_filter(fields, lambda k, v: v == False)))  # noqa: E712


def number_text(x: float | int) -> str:
    """A number as ECMAScript writes it: the shortest digits that read back, plain from 1e-7 to 1e21."""
    if isinstance(x, int) and abs(x) < 10**21:
        return str(x) if abs(x) <= 2**53 else number_text(float(x))
    if x != x or x in (float("inf"), float("-inf")):
        raise ValueError("not a finite number")
    if x == 0:
        return "0"
    sign, digits, exponent = ("-" if x < 0 else ""), *repr(abs(float(x))).lower().partition("e")[::2]
    whole, _, part = digits.partition(".")
    part = "" if part == "0" else part
    point = len(whole) + int(exponent or 0)
    figures = (whole + part).lstrip("0")
    point -= len(whole + part) - len((whole + part).lstrip("0"))
    figures = figures.rstrip("0")
    if len(figures) <= point <= 21:
        return sign + figures + "0" * (point - len(figures))
    if 0 < point <= 21:
        return f"{sign}{figures[:point]}.{figures[point:]}"
    if -6 < point <= 0:
        return f"{sign}0.{'0' * -point}{figures}"
    power = point - 1
    return f"{sign}{figures[0]}{'.' + figures[1:] if len(figures) > 1 else ''}e{'+' if power > 0 else '-'}{abs(power)}"


def canonical(x: object) -> str:
    """Canonical JSON: keys by UTF-16 units, no blanks, ECMAScript numbers, short escapes. Any depth of nesting."""
    out: list[str] = []
    waiting: list[tuple[bool, object]] = [(False, x)]  # (whether it is text to write, what)
    while waiting:
        written, v = waiting.pop()
        if written:
            out.append(v)
        elif v is None or isinstance(v, bool):
            out.append(json.dumps(v))
        elif isinstance(v, (int, float)):
            out.append(number_text(v))
        elif isinstance(v, str):
            out.append(json.dumps(v, ensure_ascii=False))
        elif isinstance(v, list):
            waiting.append((True, "]"))
            for i in range(len(v) - 1, -1, -1):
                waiting += [(False, v[i]), (True, "," if i else "[")]
            if not v:
                waiting.append((True, "["))
        elif isinstance(v, dict):
            waiting.append((True, "}"))
            keys = sorted(v, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
            for i in range(len(keys) - 1, -1, -1):
                waiting += [(False, v[keys[i]]), (True, f"{',' if i else '{'}{json.dumps(keys[i], ensure_ascii=False)}:")]
            if not v:
                waiting.append((True, "{"))
        else:
            raise TypeError(type(v).__name__)
    return "".join(out)


def stable(document: dict, content_only: bool) -> dict:
    """What is hashed: without signature and own hash, and for the content hash without the time."""
    d = {k: v for k, v in document.items() if k != "signature"}
    d["verification"] = dict(d.get("verification") or {}) | {"snapshotSha256": ""}
    return d | {"generatedAt": ""} if content_only else d


def document_hash(documents: Column, content_only: bool = False) -> Column:
    """SHA-256 of the canonical form of JSON documents; null for text that is none, is nested too deep for a parser, or has no canonical form."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = []
            for x in s:
                try:
                    out.append(hashlib.sha256(canonical(stable(json.loads(x), content_only)).encode()).hexdigest())
                except (ValueError, TypeError, AttributeError, RecursionError):
                    out.append(None)
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(run, "string")(documents)


# Ed25519 verification, RFC 8032: the curve's field, order and base point are the standard's.
P = 2**255 - 19
Q = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, P - 2, P) % P
ROOT = pow(2, (P - 1) // 4, P)


def _add(a: tuple, b: tuple) -> tuple:
    m, n = (a[1] - a[0]) * (b[1] - b[0]) % P, (a[1] + a[0]) * (b[1] + b[0]) % P
    s, t = 2 * a[3] * b[3] * D % P, 2 * a[2] * b[2] % P
    e, f, g, h = n - m, t - s, t + s, n + m
    return e * f % P, g * h % P, f * g % P, e * h % P


def _times(k: int, a: tuple) -> tuple:
    out = (0, 1, 1, 0)
    while k:
        if k & 1:
            out = _add(out, a)
        a, k = _add(a, a), k >> 1
    return out


def _point(b: bytes) -> tuple | None:
    y = int.from_bytes(b, "little")
    sign, y = y >> 255, y & (1 << 255) - 1
    if y >= P:
        return None
    square = (y * y - 1) * pow(D * y * y + 1, P - 2, P) % P
    x = pow(square, (P + 3) // 8, P)
    if (x * x - square) % P:
        x = x * ROOT % P
    if (x * x - square) % P or (x == 0 and sign):
        return None
    x = P - x if x & 1 != sign else x
    return x, y, 1, x * y % P


BASE = _point((4 * pow(5, P - 2, P) % P).to_bytes(32, "little"))


def _encoded(a: tuple) -> bytes:
    z = pow(a[2], P - 2, P)
    x, y = a[0] * z % P, a[1] * z % P
    return (y | (x & 1) << 255).to_bytes(32, "little")


def _secret(seed: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(seed).digest()
    return int.from_bytes(h[:32], "little") & ((1 << 254) - 8) | 1 << 254, h[32:]


def public_key(seed: bytes) -> bytes:
    return _encoded(_times(_secret(seed)[0], BASE))


def sign(seed: bytes, message: bytes) -> bytes:
    a, prefix = _secret(seed)
    pub = public_key(seed)
    r = int.from_bytes(hashlib.sha512(prefix + message).digest(), "little") % Q
    point = _encoded(_times(r, BASE))
    k = int.from_bytes(hashlib.sha512(point + pub + message).digest(), "little") % Q
    return point + ((r + k * a) % Q).to_bytes(32, "little")


def verify(public: bytes, message: bytes, signature: bytes) -> bool:
    if len(signature) != 64 or len(public) != 32:
        return False
    a, r, s = _point(public), _point(signature[:32]), int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= Q:
        return False
    k = int.from_bytes(hashlib.sha512(signature[:32] + public + message).digest(), "little") % Q
    left, right = _times(s, BASE), _add(r, _times(k, a))
    return (left[0] * right[2] - right[0] * left[2]) % P == 0 and (left[1] * right[2] - right[1] * left[2]) % P == 0


BOUND = ("algorithm", "issuedAt", "keyId", "nonce", "payloadSha256", "scope", "signatureVersion")


# What a key's number and an encoded public key look like.
KEY_ID = r"[a-f0-9]{16}"
PUBLIC_KEY = r"[A-Za-z0-9+/=]{40,200}"


def signature_state(document: str | None) -> str:
    """unsigned, invalid, malformed (valid, but without a proper key) or valid, by the key that the signature block itself names."""
    import base64
    import re

    try:
        d = json.loads(document or "")
        m = d.get("signature")
    except (ValueError, AttributeError, RecursionError):
        return "invalid"
    if not m:
        return "unsigned"
    try:
        payload = {k: v for k, v in d.items() if k != "signature"}
        if m["algorithm"] != "ed25519" or hashlib.sha256(canonical(payload).encode()).hexdigest() != m["payloadSha256"]:
            return "invalid"
        bound = canonical({k: m[k] for k in BOUND if k in m}).encode()
        if not verify(base64.b64decode(m["publicKey"])[-32:], bound, base64.b64decode(m["signature"])):
            return "invalid"
        whole = re.fullmatch(KEY_ID, str(m.get("keyId"))) and re.fullmatch(PUBLIC_KEY, m["publicKey"])
        return "valid" if whole else "malformed"
    except (KeyError, TypeError, ValueError):
        return "invalid"


def signature_states(documents: Column) -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(signature_state)

    return F.pandas_udf(run, "string")(documents)


def signed_document(document: dict, seed: bytes, issued_at: str, nonce: str, key_id: str | None = None) -> dict:
    """The document with a signature block over its canonical form, its key, time and nonce."""
    import base64

    pub = public_key(seed)
    m = {"algorithm": "ed25519", "issuedAt": issued_at, "keyId": key_id or key_number(seed), "nonce": nonce, "payloadSha256": hashlib.sha256(canonical(document).encode()).hexdigest(), "scope": "published_snapshot", "signatureVersion": "1"}
    sealed = base64.b64encode(sign(seed, canonical(m).encode())).decode()
    return document | {"signature": m | {"publicKey": base64.b64encode(pub).decode(), "signature": sealed}}


def key_number(seed: bytes) -> str:
    """The number of a seed's public key."""
    return hashlib.sha256(public_key(seed)).hexdigest()[:16]


def signed_documents(documents: Column, seeds: Column, key_id: Column | None = None, issued_at: str = "2026-01-01T00:00:00Z", nonce: str = "0") -> Column:
    """JSON documents signed with 32-byte seeds."""

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for docs, keys, ids in batches:
            yield pd.Series([json.dumps(signed_document(json.loads(d), bytes(k), issued_at, nonce, i)) for d, k, i in zip(docs, keys, ids, strict=True)], dtype=object)

    return F.pandas_udf(run, "string")(documents, seeds, F.lit(None).cast("string") if key_id is None else key_id)


# The keys an uploaded document may have at its top, beside those of a publisher's own blocks.
ALLOWED_KEYS = ("claimAuthority", "collectorVersion", "daily", "durability", "generatedAt", "imported", "integrity", "isSampleData", "measurement", "privacy", "profile", "providerConfidence", "providers", "scanner", "signature", "source", "sourceOfTruth", "telemetry", "timezone", "totals", "verification", "warnings")
PROJECTS = "projects"


def gate(documents: DataFrame, revoked: DataFrame, most_bytes: int = 512 * 1024, allowed: tuple[str, ...] = (*ALLOWED_KEYS, PROJECTS)) -> DataFrame:
    """code of each uploaded document (id, document): the first rule it fails, or OK.

    :param revoked: key_id. :param allowed: keys that a document may have at its top. A column expected_key of
        documents, if there is one, names the public key that a member has registered.

    A text that is no JSON object, or is nested too deep for a parser, is INVALID_JSON. Ids should be unique.
    """
    from . import secrets
    from .integrity import first_failure

    keys = F.json_object_keys("document")
    # what the first rules reject is not scanned
    found = secrets.leaves(documents.filter(keys.isNotNull() & (F.octet_length("document") <= most_bytes)))
    # both scans of the leaves in one pass over the documents
    each = found.withColumn("bad_key", secrets.forbidden_key()).withColumn("leak", F.col("text").isNotNull() & ~F.col("path").startswith("signature") & ~F.col("path").rlike("(?i)(sha256|contact)") & ~secrets.is_safe(F.col("text")))
    marks = each.groupBy("id").agg(F.max("bad_key").alias("bad_keys"), F.max("leak").alias("leaks"))
    get = lambda p: F.get_json_object("document", f"$.{p}")
    flags = F.from_json("document", "privacy struct<rawContentPersisted:boolean,allowlistPublication:boolean>, verification struct<rawLogsPublished:boolean>")
    expected = F.col("expected_key") if "expected_key" in documents.columns else F.lit(None).cast("string")
    d = documents.withColumns({"state": signature_states(F.when(F.octet_length("document") <= most_bytes, F.col("document"))), "key_id": get("signature.keyId"), "public_key": get("signature.publicKey"), "flags": flags, "expected": expected})
    d = d.join(marks, "id", "left").join(revoked.select("key_id", F.lit(True).alias("gone")).distinct(), "key_id", "left")
    rules = [
        ("INVALID_JSON", keys.isNull()),
        ("PAYLOAD_TOO_LARGE", F.octet_length("document") > most_bytes),
        ("UNKNOWN_FIELDS", F.size(F.array_except(keys, F.array(*map(F.lit, allowed)))) > 0),
        ("FORBIDDEN_FIELDS", F.col("bad_keys")),
        ("RAW_CONTENT", F.col("flags.privacy.rawContentPersisted")),
        ("NOT_ALLOWLIST", ~F.col("flags.privacy.allowlistPublication")),
        ("RAW_LOGS", F.col("flags.verification.rawLogsPublished")),
        ("SECRET_PATTERN", F.col("leaks")),
        ("INVALID_SIGNATURE", ~F.col("state").isin("valid", "malformed")),
        ("MALFORMED_SIGNATURE", F.col("state") == "malformed"),
        ("KEY_MISMATCH", F.col("expected") != F.col("public_key")),
        ("KEY_REVOKED", F.col("gone")),
    ]
    return d.select("id", first_failure(rules).alias("code"))

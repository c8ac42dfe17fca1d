"""Ordered rules and small fixed dimensions: what evidence may be claimed, listings, invitations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .integrity import first_failure

#: What no single signal establishes. Fixed values.
NEVER = ("identity", "expertise", "authorship", "productivity", "work_quality")
#: Signals by the context flag that makes them present: (signal, tier, allowed claim, flag).
SIGNALS = (
    ("collector_observed_activity", "collector_observed", "activity_occurred", "has_activity"),
    ("provider_reported_token_counts", "provider_attested", "activity_occurred", "has_totals"),
    ("device_signed_snapshot", "device_signed", "snapshot_integrity", "is_signed"),
    ("project_activity", "collector_observed", "project_activity_occurred", "has_projects"),
    ("public_link", "link_provided", "link_exists", "has_links"),
    ("self_reported_work", "self_reported", "member_states_it", "has_work"),
    ("imported_usage", "self_reported", "member_submitted_it", "has_imports"),
    ("integrity_checks", "derived", "checks_were_run", "has_checks"),
    ("identity_proof", "third_party", "account_control", "has_proofs"),
    ("durability_evidence", "collector_observed", "lines_remained", "has_durability"),
)


def ladder(spark: SparkSession) -> DataFrame:
    """The fixed dimension of signals; every one but the identity proof excludes identity."""
    rows = [(i, s, tier, [claim], [n for n in NEVER if (s, n) != ("identity_proof", "identity")], flag) for i, (s, tier, claim, flag) in enumerate(SIGNALS)]
    return spark.createDataFrame(rows, "ord int, signal string, tier string, allowed array<string>, excluded array<string>, flag string")


def claims(context: DataFrame) -> DataFrame:
    """Signals of each context (id, flags as boolean columns) and whether they are present."""
    flags = [f for *_, f in SIGNALS if f in context.columns]
    on = F.create_map(*[x for f in flags for x in (F.lit(f), F.coalesce(f, F.lit(False)))])
    return context.select("id", on.alias("on")).crossJoin(F.broadcast(ladder(context.sparkSession))).select("id", "ord", "signal", "tier", "allowed", "excluded", F.coalesce(F.try_element_at("on", F.col("flag")), F.lit(False)).alias("present"))  # ten signals


def ladder_problems(signals: DataFrame) -> DataFrame:
    """Signals that allow what none may, do not exclude identity, or lack a claim or tier."""
    rules = [
        ("claims a universal non-claim", F.arrays_overlap(F.transform("allowed", F.lower), F.array(*map(F.lit, NEVER)))),
        ("does not exclude identity", (F.col("signal") != "identity_proof") & ~F.array_contains(F.transform("excluded", F.lower), "identity")),
        ("lacks a claim or tier", (F.size("allowed") == 0) | F.col("tier").isNull()),
    ]
    return signals.select("signal", first_failure(rules).alias("problem")).filter("problem <> 'OK'")


def listing_state(listing: Column, disclosure: str) -> Column:
    """State of a listing answer (struct answer, withdrawn_at, disclosure_id), in this order."""
    return F.when(listing.isNull(), "unanswered").when(listing["withdrawn_at"].isNotNull(), "withdrawn").when(listing["answer"] == "declined", "declined").when(~listing["disclosure_id"].eqNullSafe(F.lit(disclosure)), "stale-disclosure").otherwise("granted")


def valid_consent(config: dict) -> dict:
    """A consent record with known parts only: switches are booleans, anything else is an error."""
    out = {}
    for part in ("sources", "fields"):
        given = config.get(part, {})
        if not isinstance(given, dict) or any(not isinstance(v, bool) for v in given.values()):
            raise ValueError(f"{part} must map names to true or false")
        out[part] = dict(given)
    listing = valid_listing(config.get("directoryListing"))
    return out | ({"directoryListing": listing} if listing else {})


#: Ways in which a listing question is answered. Fixed values.
ANSWERS, WAYS = ("granted", "declined"), ("tty-prompt", "cli-unlist")
NAMED = ("disclosureId", "disclosureSha256", "handle", "publicUrl")


def valid_listing(record: object) -> dict | None:
    """A listing answer that is whole and well formed; None, as if never asked, for any other."""
    from datetime import datetime

    full = lambda k: isinstance(record.get(k), str) and record[k] != ""
    if not isinstance(record, dict) or record.get("answer") not in ANSWERS or record.get("answeredVia") not in WAYS or not all(map(full, (*NAMED, "answeredAt"))):
        return None
    version, fields = record.get("consentVersion"), record.get("fieldsAtConsent")
    if isinstance(version, bool) or not isinstance(version, (int, float)) or not isinstance(fields, list):
        return None
    if "withdrawnAt" in record and not full("withdrawnAt"):
        return None  # present but empty would read as not withdrawn
    try:
        datetime.fromisoformat(record["answeredAt"].replace("Z", "+00:00"))
    except ValueError:
        return None
    kept = {k: record[k] for k in ("answer", "answeredAt", "answeredVia", "consentVersion", *NAMED, "withdrawnAt") if k in record}
    return kept | {"fieldsAtConsent": [f for f in fields if isinstance(f, str)]}


def consent_records(records: DataFrame) -> DataFrame:
    """The rules of :func:`valid_consent` for a table of records (id, record as JSON text).

    Returns id, valid (switches are booleans, or absent), off (sources switched off), and listing (answer,
    withdrawn_at, disclosure_id, handle, fields), null for an answer that is not whole. What is no JSON is not valid.
    """
    v = F.try_parse_json("record")
    at = lambda path: F.try_variant_get(v, path, "variant")
    kind = lambda path: F.schema_of_variant(at(path))
    listing = lambda k: f"$.directoryListing.{k}"
    string = lambda k: F.when(kind(listing(k)) == "STRING", F.try_variant_get(v, listing(k), "string"))
    full = lambda k: F.coalesce(string(k) != "", F.lit(False))
    switches = lambda part: F.try_variant_get(v, f"$.{part}", "map<string,variant>")
    good = lambda part: at(f"$.{part}").isNull() | F.coalesce(kind(f"$.{part}").startswith("OBJECT") & F.forall(F.map_values(switches(part)), lambda x: F.schema_of_variant(x) == "BOOLEAN"), F.lit(False))
    valid = v.isNotNull() & F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)) & good("sources") & good("fields")
    dated = string("answeredAt").rlike(r"^\d{4}-\d{2}-\d{2}") & F.replace(string("answeredAt"), F.lit("Z"), F.lit("+00:00")).try_cast("timestamp").isNotNull()
    whole = string("answer").isin(*ANSWERS) & string("answeredVia").isin(*WAYS) & dated & kind(listing("consentVersion")).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)") & kind(listing("fieldsAtConsent")).startswith("ARRAY")
    for k in NAMED:
        whole = whole & full(k)
    whole = F.coalesce(whole, F.lit(False)) & (at(listing("withdrawnAt")).isNull() | full("withdrawnAt"))
    texts = F.transform(F.filter(F.try_variant_get(v, listing("fieldsAtConsent"), "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string"))
    answer = F.struct(string("answer").alias("answer"), string("withdrawnAt").alias("withdrawn_at"), string("disclosureId").alias("disclosure_id"), string("handle").alias("handle"), texts.alias("fields"))
    off = F.array_sort(F.map_keys(F.map_filter(F.try_variant_get(v, "$.sources", "map<string,boolean>"), lambda k, x: ~x)))
    return records.select("id", valid.alias("valid"), F.when(valid, F.coalesce(off, F.array().cast("array<string>"))).alias("off"), F.when(valid & whole, answer).alias("listing"))


def enabled_sources(config: dict, sources: list[str]) -> list[str]:
    """Sources to open; a source switched off is never read."""
    return [s for s in sources if config["sources"].get(s, True)]


#: Kinds of invitations. Fixed values.
KINDS = ("paid_evaluation", "research_study", "technical_beta", "contract", "interview", "employment")
NEEDED = ("organization", "contact_email", "compensation", "expected_time", "scope", "deadline", "data_requested")
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"


def invitation_code(sender_full: Column | None = None, receiver_full: Column | None = None) -> Column:
    """First fault of an invitation, or OK. The last two say that a rate limit is used up."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    missing = F.lit(False)
    for c in NEEDED:
        missing = missing | blank(c)
    rules = [
        ("INVALID_HANDLE", ~F.coalesce(F.lower(F.trim("to_handle")).rlike(r"^[a-z0-9](?:[a-z0-9-]{0,37}[a-z0-9])?$"), F.lit(False))),
        ("INVALID_OPPORTUNITY_TYPE", ~F.coalesce(F.trim("opportunity_type").isin(*KINDS), F.lit(False))),
        ("FIELD_REQUIRED", missing),
        ("INVALID_EMAIL", ~F.col("contact_email").rlike(EMAIL)),
        ("SCOPE_TOO_SHORT", F.length(F.trim("scope")) < 20),
        ("COMPENSATION_REQUIRED", F.length(F.trim("compensation")) < 3),
    ]
    rules += [("RATE_LIMIT", c) for c in (sender_full, receiver_full) if c is not None]
    return first_failure(rules)


#: Steps of verification, in order. Fixed values.
STEPS = ("usage_observed", "totals_derived", "snapshot_hashed", "snapshot_signed", "identity_linked", "work_linked", "outcome_confirmed")


def verification_steps(contexts: DataFrame) -> DataFrame:
    """The seven steps for each context (id, and a boolean column for each step that may hold): id, ord, step, reached."""
    reached = lambda s: F.coalesce(F.col(s).cast("boolean"), F.lit(False)) if s in contexts.columns else F.lit(False)
    steps = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(s).alias("step"), reached(s).alias("reached")) for i, s in enumerate(STEPS)])
    return contexts.select("id", F.explode(steps).alias("s")).select("id", "s.*")


def verification_ladder(spark: SparkSession, context: dict[str, bool]) -> DataFrame:
    """The steps of one context."""
    flags = [F.lit(bool(context.get(s))).alias(s) for s in STEPS]
    return verification_steps(spark.range(1).select("id", *flags)).drop("id")

"""The blocks of a published snapshot: drafts are projected through shapes that name every field that may pass.

A shape says of each field what it may be; a column of the draft's JSON, read with the schema that the shape
implies, becomes a struct of just these fields: counts as counts, texts cut and free of secrets, lists bounded,
choices from a closed list. What no shape names cannot reach the result. Consent is applied to the projected
blocks before anything is derived from them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import count_or_zero, counts_by_key
from . import secrets
from .publish import DATE, PROJECTS

SLUG = r"^[a-z][a-z0-9_-]{0,39}$"
HTTPS = r"(?i)^https://[a-z0-9.-]+\.[a-z]{2,}(?:/\S*)?$"
MAIL_OR_HTTPS = r"^mailto:[^\s@]+@[^\s@]+\.[^\s@]+(\?\S*)?$|(?i)^https://[a-z0-9.-]+\.[a-z]{2,}(?:/[^\s<>\x22']*)?$"


class Shape:
    kind = "string"

    def project(self, c: Column) -> Column:
        raise NotImplementedError


@dataclass(frozen=True)
class Text(Shape):
    """A text without secrets, cut to ``most``; null, or the default, if it holds one or does not fit the pattern."""

    most: int = 400
    default: str | None = None
    pattern: str | None = None
    checked: bool = True

    def project(self, c):
        good = ~secrets.breaks_any(c) if self.checked else F.lit(True)
        if self.pattern:
            good = good & c.rlike(self.pattern)
        return F.coalesce(F.when(good, F.substring(c, 1, self.most)), F.lit(self.default))


@dataclass(frozen=True)
class Texts(Shape):
    """The first ``entries`` texts that hold no secret, cut to ``most``."""

    entries: int = 12
    most: int = 200
    kind = "array<string>"

    def project(self, c):
        good = F.filter(c, lambda x: x.isNotNull() & ~secrets.breaks_any(x))
        return F.coalesce(F.slice(F.transform(good, lambda x: F.substring(x, 1, self.most)), 1, self.entries), F.array().cast(self.kind))


@dataclass(frozen=True)
class Count(Shape):
    optional: bool = False
    kind = "double"

    def project(self, c):
        return F.when(c.isNotNull(), count_or_zero(c)) if self.optional else count_or_zero(c)


@dataclass(frozen=True)
class Number(Shape):
    """A finite number within bounds, else null; with ``clamp`` moved to the nearer bound."""

    least: float = float("-inf")
    most: float = float("inf")
    clamp: bool = False
    kind = "double"

    def project(self, c):
        finite = c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
        if self.clamp:
            return F.when(finite, F.greatest(F.lit(self.least), F.least(F.lit(self.most), c)))
        return F.when(finite & (c >= self.least) & (c <= self.most), c)


@dataclass(frozen=True)
class Choice(Shape):
    values: tuple[str, ...]
    default: str

    def project(self, c):
        return F.coalesce(F.when(c.isin(*self.values), c), F.lit(self.default))


@dataclass(frozen=True)
class Flag(Shape):
    kind = "boolean"

    def project(self, c):
        return F.coalesce(c, F.lit(False))


@dataclass(frozen=True)
class Fixed(Shape):
    value: str

    def project(self, c):
        return F.lit(self.value)


@dataclass(frozen=True)
class Counts(Shape):
    """Counts by a key that fits a pattern."""

    key: str
    kind = "map<string,double>"

    def project(self, c):
        return counts_by_key(c, self.key)


@dataclass(frozen=True)
class Part(Shape):
    fields: Mapping[str, Shape]

    @property
    def kind(self):
        return f"struct<{','.join(f'{n}:{s.kind}' for n, s in self.fields.items())}>"

    def project(self, c):
        return F.struct(*[s.project(c[n]).alias(n) for n, s in self.fields.items()])


def _has(name: str) -> Callable[[Column], Column]:
    return lambda x: F.coalesce(x[name] != "", F.lit(False))


def _value(change: Callable[[Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda k, v: change(v)


@dataclass(frozen=True)
class Rows(Shape):
    """The first ``entries`` objects in which none of ``needs`` is null or empty."""

    fields: Mapping[str, Shape]
    entries: int
    needs: tuple[str, ...] = ()

    @property
    def kind(self):
        return f"array<{Part(self.fields).kind}>"

    def project(self, c):
        out = F.transform(c, Part(self.fields).project)
        for n in self.needs:
            out = F.filter(out, _has(n))
        return F.coalesce(F.slice(out, 1, self.entries), F.slice(F.array(Part(self.fields).project(F.from_json(F.lit("{}"), Part(self.fields).kind))), 1, 0))


# Fixed values from here on: the fields of the published format, with their bounds.
METRICS = {"inputTokens": Count(), "outputTokens": Count(), "cacheCreationTokens": Count(), "cacheReadTokens": Count(), "cachedTokens": Count(), "freshTokens": Count(), "totalTokens": Count(), "estimatedCostUsd": Number()}
TOTALS = Part(METRICS)
PROVIDER = Part({"provider": Text(40), "displayName": Text(40, ""), "models": Texts(10, 80), **METRICS})
DAILY = Rows({"date": Text(10, pattern=DATE, checked=False), "provider": Text(40, pattern=SLUG), "displayName": Text(40, ""), "models": Texts(8, 80), **METRICS}, 100_000, ("date", "provider"))
PROJECT = Rows(
    {
        "name": Text(60), "category": Text(40, "Unknown"), "status": Text(40, "unknown"), "description": Text(400, ""), "found": Flag(),
        "git": Part({"branch": Text(80), "commit": Text(60), "changedFiles": Number()}), "stack": Texts(10, 40), "scripts": Texts(14, 60),
        "fileCounts": Counts("^[a-z]{1,8}$"), "lastModified": Text(40), "scannerWarnings": Texts(6, 200), "publicUrl": Text(400, pattern=HTTPS),
    },
    10_000,
    ("name",),
)
IDENTITY = Part(
    {
        "displayName": Text(60, "Anonymous"), "headline": Text(120, ""), "pronouns": Text(24), "location": Text(60), "bio": Text(600), "availability": Text(160),
        "workCategories": Texts(10, 40), "openTo": Texts(10, 40), "links": Rows({"label": Text(40), "url": Text(200, pattern=HTTPS)}, 6, ("label", "url")),
        "identityProofs": Rows({"type": Text(6, pattern="^github$"), "handle": Text(40, pattern="^[a-zA-Z0-9](?:[a-zA-Z0-9]|-(?=[a-zA-Z0-9])){0,38}$"), "gistId": Text(64, pattern="(?i)^[a-f0-9]{6,64}$")}, 6, ("type", "handle", "gistId")),
        "avatarUrl": Text(300, pattern=HTTPS),
        # a member's own address is what this field is for
        "contact": Part({"label": Text(40), "href": Text(200, pattern=MAIL_OR_HTTPS, checked=False)}),
    }
)
ACTIVITY = Part(
    {
        "referenceDate": Text(10, "1970-01-01", DATE, False), "activeDays": Count(), "firstActiveDate": Text(10, None, DATE, False), "lastActiveDate": Text(10, None, DATE, False), "spanDays": Count(),
        "activeDaysLast30": Count(), "activeDaysLast90": Count(), "currentStreakDays": Count(), "longestStreakDays": Count(), "toolsUsed": Texts(8, 40), "modelsUsed": Texts(24, 80), "projectsActive": Count(),
    }
)
ARTIFACTS = Rows(
    {
        "type": Choice(("repository", "deployment", "publication", "case_study", "evaluation", "research"), "repository"), "title": Text(100), "description": Text(300, ""), "url": Text(200, pattern=HTTPS),
        "period": Text(40), "linkedProject": Text(60), "verification": Choice(("collector_observed", "link_provided", "self_reported"), "self_reported"), "basis": Text(300, ""),
    },
    40,
    ("title",),
)
OUTCOMES = Rows({"title": Text(100), "description": Text(300, ""), "metric": Text(80), "period": Text(40), "verification": Fixed("self_reported"), "basis": Text(300, "")}, 40, ("title",))
OPPORTUNITY = Part({"engagementTypes": Texts(12, 40), "compensation": Text(80), "typicalProjectSize": Text(60), "workArrangement": Text(60), "timezone": Text(60), "responseTime": Text(60), "computeCostRange": Text(80), "note": Text(300, "")})
EFFICIENCY = Part({"cachedSharePct": Number(0, 100), "freshSharePct": Number(0, 100), "outputSharePct": Number(0, 100), "avgTokensPerActiveDay": Count(True), "note": Text(300, "")})
PRACTICE = Part({"tokenEfficiencyArchitecture": Texts(12, 160), "contextInjectionSystems": Texts(12, 160), "problemFocus": Texts(12, 160), "leveragePatterns": Texts(12, 160), "operatingCostNote": Text(300), "valueDeliveredNote": Text(400), "verification": Fixed("self_reported"), "note": Text(400, "")})
STEPS = Rows({"label": Text(60, ""), "status": Choice(("verified", "reported", "self_submitted", "unverified", "pending"), "unverified"), "basis": Text(300, "")}, 12, ("label",))
PROFILE = Part({"identity": IDENTITY, "activity": ACTIVITY, "work": Part({"artifacts": ARTIFACTS, "outcomes": OUTCOMES}), "opportunity": OPPORTUNITY, "efficiency": EFFICIENCY, "practice": PRACTICE, "verification": STEPS, "note": Text(400, "")})
_NODE = {"events": Count(), "sessions": Count(), "totalTokens": Count()}
TELEMETRY = Part(
    {
        "measurementClass": Fixed("collector_derived"), "confidence": Choice(("low", "medium"), "medium"), "totalEvents": Count(),
        "hierarchy": Rows({"provider": Text(40, "unknown"), **_NODE, "models": Rows({"model": Text(80, "(unattributed)"), **_NODE}, 24)}, 8),
        "sessions": Part({"distinctSessions": Count(), "eventsWithoutSession": Count(), **{n: Count(True) for n in ("medianEventsPerSession", "p95EventsPerSession", "maxEventsPerSession", "medianInterEventSeconds")}}),
        "note": Text(500, ""), "limitations": Texts(8, 240), "doesNotEstablish": Texts(12, 60),
    }
)
DURABILITY = Part(
    {
        "note": Text(500, ""), "doesNotEstablish": Texts(12, 40),
        "projects": Rows(
            {
                "projectName": Text(60), "linkedArtifact": Text(100), "measurementClass": Choice(("collector_observed_git",), "unavailable"), "limitations": Texts(8, 200), "note": Text(300, ""),
                "windows": Rows({"window": Choice(("24h", "7d", "30d", "90d"), "30d"), "days": Count(), "introducedLines": Count(), "remainingLines": Count(), "remainingPct": Number(0, 100, clamp=True), **{n: Count() for n in ("reverts", "correctiveCommits", "hotfixes", "bugLinkedFollowUps", "failedCiAfterMerge", "filesReopened")}, "summary": Text(400, "")}, 4),
            },
            20,
            ("projectName",),
        ),
    }
)
INTEGRITY = Part({"checks": Rows({"name": Text(60, ""), "status": Choice(("flag",), "ok"), "detail": Text(200, "")}, 20, ("name",)), "note": Text(300, "")})
IMPORTED = Rows({"sourceLabel": Text(60), "adapter": Text(40, "import"), "measurementClass": Fixed("user_submitted"), "confidence": Choice(("low", "medium", "high"), "low"), "events": Count(), "totalTokens": Count(), "firstDate": Text(10, None, DATE, False), "lastDate": Text(10, None, DATE, False), "models": Texts(24, 80)}, 30, ("sourceLabel",))
CONFIDENCE = Part({"confidence": Choice(("high",), "medium"), "note": Text(400, "")})
ISO_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"
ZONE = r"^[A-Za-z]+(?:/[A-Za-z0-9_+-]+){0,2}$"
HEAD = {
    "generatedAt": Text(40, "1970-01-01T00:00:00.000Z", ISO_TIME, False), "timezone": Text(64, "unknown", ZONE, False), "isSampleData": Flag(), "gitCommit": Text(60),
    "sourceOfTruth": Choice(("event_store", "mixed"), "aggregates"), "scanner": Part({"rootsChecked": Count(), "allowlistedProjects": Count(), "foundProjects": Count(), "privacyMode": Fixed("allowlist_no_paths")}),
}
# End of the fixed values.

_PARTS = HEAD | {"totals": TOTALS, "daily": DAILY, PROJECTS: PROJECT, "profile": PROFILE, "telemetry": TELEMETRY, "durability": DURABILITY, "integrity": INTEGRITY, "imported": IMPORTED, "warnings": Texts(12, 200)}
_MAPS = {"providers": PROVIDER, "providerConfidence": CONFIDENCE}
#: Fields of a consent record that take a whole block away.
BLOCKS = ("providers", "daily", PROJECTS)


def draft_schema() -> str:
    """The schema by which a draft's JSON is read: of no other field is anything known."""
    return ", ".join([f"{n} {s.kind}" for n, s in _PARTS.items()] + [f"{n} map<string,{s.kind}>" for n, s in _MAPS.items()])


def without_cost(c: Column) -> Column:
    return c.withField("estimatedCostUsd", F.lit(None).cast("double"))


def without_models(c: Column) -> Column:
    return c.withField("models", F.array().cast("array<string>"))


def blocks(drafts: DataFrame) -> DataFrame:
    """The published blocks of drafts (id, draft, and consent as a map field -> allowed; null allows all).

    A draft is JSON text; one that cannot be read, and any field of another type than its shape's, counts as
    absent (a number in the place of a text is its digits). Returns id and the blocks in columns of their names;
    measurement and privacy are derived from what consent has left.
    """
    consent = F.col("consent") if "consent" in drafts.columns else F.lit(None).cast("map<string,boolean>")
    d = drafts.select("id", consent.alias("consent"), F.from_json("draft", draft_schema()).alias("d"))
    allowed = lambda field: F.coalesce(F.try_element_at("consent", F.lit(field)), F.lit(True))
    out = {n: s.project(F.col(f"d.{n}")) for n, s in _PARTS.items()}
    out |= {n: F.transform_values(F.map_filter(F.col(f"d.{n}"), lambda k, v: k.rlike(SLUG)), _value(s.project)) for n, s in _MAPS.items()}
    p = d.select("id", "consent", *[c.alias(n) for n, c in out.items()], *[F.col(f"d.{n}").isNotNull().alias(f"has_{n}") for n in ("profile", "integrity", "telemetry", "durability", "imported")])
    # an observed badge needs a linked project
    honest = lambda a: a.withField("verification", F.when((a["verification"] == "collector_observed") & (F.coalesce(a["linkedProject"], F.lit("")) == ""), "self_reported").otherwise(a["verification"]))
    artifacts = F.when(allowed("profileWork"), F.transform("profile.work.artifacts", honest)).otherwise(F.slice("profile.work.artifacts", 1, 0))
    outcomes = F.when(allowed("profileWork"), F.col("profile.work.outcomes")).otherwise(F.slice("profile.work.outcomes", 1, 0))
    # consent, before anything is derived
    for field, change in (("estimatedCost", without_cost), ("models", without_models)):
        when = lambda c, x, field=field: F.when(allowed(field), c).otherwise(x)
        p = p.withColumns({"providers": when(F.col("providers"), F.transform_values("providers", _value(change))), "daily": when(F.col("daily"), F.transform("daily", change))})
    p = p.withColumns({"totals": F.when(allowed("estimatedCost"), F.col("totals")).otherwise(without_cost(F.col("totals"))), "artifacts": artifacts, "outcomes": outcomes})
    p = p.withColumns({b: F.when(allowed(b), F.col(b)) for b in BLOCKS})
    work = F.struct("artifacts", "outcomes", F.size(F.filter("artifacts", lambda a: a["verification"] == "collector_observed")).alias("collectorObserved"), F.size("artifacts").alias("totalArtifacts"), F.size("outcomes").alias("totalOutcomes"))
    checks = F.col("integrity.checks")
    has = {
        "profile": F.col("has_profile"),
        "integrity": F.size(checks) > 0,
        "imported": F.size("imported") > 0,
        "telemetry": F.col("telemetry.totalEvents") > 0,
        "durability": F.size("durability.projects") > 0,
    }
    p = p.withColumns({"profile": F.when(has["profile"], F.col("profile").withField("work", work)), "integrity": F.when(has["integrity"], F.col("integrity").withField("flags", F.size(F.filter(checks, lambda c: c["status"] == "flag")))), "telemetry": F.when(has["telemetry"], F.col("telemetry")), "durability": F.when(has["durability"], F.col("durability"))})
    imported = F.struct(F.aggregate("imported", F.lit(0).cast("long"), lambda s, x: s + x["totalTokens"]).alias("totalTokens"), F.col("imported").alias("sources"))
    named = [F.when(F.col(n).isNotNull(), F.lit(n)) for n in ("totals", *BLOCKS, "profile", "integrity", "telemetry", "durability")] + [F.when(F.size("imported") > 0, F.lit("imported"))]
    withheld = F.coalesce(F.array_sort(F.map_keys(F.map_filter("consent", lambda k, v: ~v))), F.array().cast("array<string>"))
    return p.select(
        "id", *HEAD, "totals", "providers", "daily", PROJECTS, "warnings", "profile", "integrity", "telemetry", "durability", "providerConfidence",
        F.when(F.size("imported") > 0, imported).alias("imported"),
        F.struct(F.col("totals.totalTokens").alias("totalTokens"), F.col("totals.estimatedCostUsd").alias("estimatedCostUsd")).alias("measurement"),
        F.struct(F.lit(False).alias("rawContentPersisted"), F.lit(True).alias("allowlistPublication"), F.filter(F.array(*named), lambda n: n.isNotNull()).alias("fieldsPublished"), withheld.alias("fieldsWithheld")).alias("privacy"),
    )


def published(drafts: DataFrame) -> DataFrame:
    """id and the blocks of each draft as one JSON document; blocks that are withheld or absent are left out."""
    b = blocks(drafts)
    return b.select("id", F.to_json(F.struct(*[c for c in b.columns if c != "id"])).alias("document"))

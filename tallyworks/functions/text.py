"""Text: slugs, labels, model names, numbers for display, escapes, rules on words."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# What names of models and slugs look like.
MODEL = r"^[a-zA-Z0-9._:-]{2,80}$"
SLUG = r"^[a-z][a-z0-9_-]{0,39}$"

# Names shown for providers.
DISPLAY_NAMES = {
    "claude": "Claude Code",
    "codex": "Codex",
    "opencode": "OpenCode",
    "amp": "Amp",
    "droid": "Droid",
    "codebuff": "Codebuff",
    "hermes": "Hermes",
    "pi": "pi-agent",
    "goose": "Goose",
    "kilo": "Kilo",
    "copilot": "GitHub Copilot CLI",
    "gemini": "Gemini CLI",
    "kimi": "Kimi",
    "qwen": "Qwen",
    "openclaw": "OpenClaw",
    "grok": "Grok",
    "openai": "OpenAI",
    "chatgpt": "ChatGPT",
    "cursor": "Cursor",
    "unknown": "Unknown",
}
# Fixed value: model families that count as known.
KNOWN_FAMILY = r"(?i)^(claude|gpt|o[0-9]|gemini|llama|mistral|deepseek|qwen|grok|codex|command|sonar)"


def provider_slug(x: Column, fallback: str | None = None) -> Column:
    """A short slug from a label; null (or the fallback) for labels that look like paths or hold nothing usable."""
    raw = F.trim(x)
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower(raw), r"\s+", "-"), r"[^a-z0-9_-]", ""), 1, 40)
    bad = raw.contains("/") | raw.contains("\\") | raw.contains("..")
    return F.coalesce(F.when(~bad & slug.rlike(SLUG), slug), F.lit(fallback))


def provider_name(slug: Column) -> Column:
    """The dictionary's name, else words in title case."""
    names = F.create_map(*[F.lit(x) for kv in DISPLAY_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, slug), F.initcap(F.regexp_replace(slug, "[-_]", " ")))


def safe_model(x: Column) -> Column:
    """The name if it is a plain identifier, else null."""
    return F.when(x.rlike(MODEL), x)


def safe_models(xs: Column, most: int = 8) -> Column:
    """Distinct plain identifiers of an array, trimmed, the first ``most``."""
    return F.slice(F.array_distinct(F.filter(F.transform(xs, lambda m: F.trim(m)), lambda m: m.rlike(MODEL))), 1, most)


def handle(x: Column) -> Column:
    """Lower case, anything but letters, digits and dashes as one dash, none at the ends, at most 39 long."""
    dashed = F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9-]+", "-"), "-+", "-")
    return F.substring(F.regexp_replace(dashed, "^-|-$", ""), 1, 39)


def header_key(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


def safe_label(x: Column, most: int, fallback: str | None) -> Column:
    cleaned = F.substring(F.trim(F.regexp_replace(x, r"[^a-zA-Z0-9 ._:\-/]", "")), 1, most)
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit(fallback))


def clean_text(x: Column, most: int = 300) -> Column:
    """Trimmed, without marks that turn the writing direction, at most ``most`` long; null if nothing is left."""
    plain = F.regexp_replace(F.trim(x), "[‪-‮⁦-⁩‎‏]", "")
    return F.nullif(F.substring(plain, 1, most), F.lit(""))


def clean_texts(xs: Column, most: int = 24, length: int = 60) -> Column:
    return F.slice(F.filter(F.transform(xs, lambda x: clean_text(x, length)), lambda x: x.isNotNull()), 1, most)


def compact_number(x: Column) -> Column:
    """1.23T, 4.56B, 7.8M, 9.1K or a whole number; n/a for null. Whole numbers are divided as decimals, so that halves go away from zero at any size."""
    a, whole = F.abs(x), x.try_cast("decimal(24,0)")
    exact = F.coalesce(whole == x, F.lit(False))

    def short(unit: int, digits: int, sign: str) -> Column:
        divided = F.round(whole / F.lit(Decimal(unit)), digits).cast("string")
        return F.concat(F.when(exact, divided).otherwise(F.format_string(f"%.{digits}f", x.cast("double") / F.lit(float(unit)))), F.lit(sign))

    return F.when(x.isNull(), "n/a").when(a >= 1e12, short(10**12, 2, "T")).when(a >= 1e9, short(10**9, 2, "B")).when(a >= 1e6, short(10**6, 1, "M")).when(a >= 1e3, short(10**3, 1, "K")).otherwise(x.cast("long").cast("string"))


#: From here on doubles are whole, and a half can not be added to them.
ALL_WHOLE = 1 << 52


def full_number(x: Column) -> Column:
    large = F.when((x >= ALL_WHOLE) | (x <= -ALL_WHOLE), x.try_cast("decimal(38,0)"))
    return F.coalesce(F.format_number(large, 0), F.format_number(F.floor(x + 0.5), 0), F.lit("—"))


def currency(x: Column) -> Column:
    return F.coalesce(F.concat(F.when(x < 0, "-$").otherwise("$"), F.format_number(F.abs(x), 2)), F.lit("—"))


def percent(part: Column, whole: Column) -> Column:
    return F.when(F.coalesce(whole, F.lit(0)) != 0, F.format_string("%.1f%%", part / whole * 100)).otherwise("—")


def ago(then: Column, now: Column) -> Column:
    """Whole seconds, minutes, hours or days since a timestamp."""
    s = F.greatest(F.unix_timestamp(now) - F.unix_timestamp(then), F.lit(0))
    unit = lambda n, sign: F.concat(F.floor(s / n).cast("string"), F.lit(f"{sign} ago"))
    return F.when(then.isNull(), "never").when(s < 60, unit(1, "s")).when(s < 3600, unit(60, "m")).when(s < 86400, unit(3600, "h")).otherwise(unit(86400, "d"))


def ago_rounded(then: Column, now: Column) -> Column:
    """The same from minutes rounded to the nearest, then hours and days of those: unknown for null, just now below one minute."""
    minutes = F.floor((F.unix_millis(now) - F.unix_millis(then)) / 60000 + 0.5)
    hours = F.floor(minutes / 60 + 0.5)
    unit = lambda n, sign: F.concat(n.cast("string"), F.lit(f"{sign} ago"))
    return F.when(then.isNull(), "unknown").when(minutes < 1, "just now").when(minutes < 60, unit(minutes, "m")).when(hours < 24, unit(hours, "h")).otherwise(unit(F.floor(hours / 24 + 0.5), "d"))


def initials(name: Column) -> Column:
    """First letters of the first two words; Q where there are none."""
    words = F.slice(F.filter(F.split(name, r"\s+"), lambda w: w != ""), 1, 2)
    return F.coalesce(F.nullif(F.array_join(F.transform(words, lambda w: F.upper(F.substring(w, 1, 1))), ""), F.lit("")), F.lit("Q"))


def xml_escape(x: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(sign), F.lit(name))
    return x


def markdown_escape(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"([\\|*_`\[\]<>])", r"\\$1"), r"\s+", " ")


def text_width(x: Column, narrow: float = 0.32, usual: float = 0.56, wide: float = 0.86) -> Column:
    """Width of a text in units of its font size, by classes of characters."""
    one = lambda c: F.when(c.rlike(r"[ijl.,:;'|!]"), narrow).when(c.rlike("[mwMW@%]"), wide).otherwise(usual)
    return F.aggregate(F.filter(F.split(x, ""), lambda c: c != ""), F.lit(0.0), lambda a, c: a + one(c))


def provider_of_model(model: Column) -> Column:
    """The provider that a model's name points to, first rule that fits. The words of the rules."""
    m = F.lower(model)
    begins = lambda *xs: m.rlike(f"^({'|'.join(xs)})")
    return F.when(m.contains("codex") | begins("gpt-", "o1", "o3", "o4"), "codex").when(m.contains("claude") | begins("opus", "sonnet", "haiku"), "claude").when(m.contains("grok"), "grok").when(m.contains("kimi") | m.contains("moonshot"), "kimi").when(m.contains("gemini"), "gemini").when(m.contains("qwen"), "qwen").otherwise("unknown")


def follow_up(subject: Column) -> dict[str, Column]:
    """What a commit's subject says it is: revert, corrective (no revert), hotfix, bug_linked. The patterns."""
    s = F.lower(subject)
    revert = s.rlike(r"\brevert\b")
    return {
        "revert": revert,
        "corrective": s.rlike(r"\b(fix|bugfix|patch|correct)\b") & ~revert,
        "hotfix": s.rlike(r"\bhot[\s-]?fix\b"),
        "bug_linked": s.rlike(r"\b(fixes|closes|resolves)\s+#?\d+") | s.rlike(r"\bbug-\d+\b"),
    }


def known_family(model: Column) -> Column:
    return model.rlike(KNOWN_FAMILY)


def badge_metric(metric: str, totals: dict[str, Column], provider_total: Column | None = None) -> tuple[Column, Column]:
    """(label, value) of a badge for cost, cached, fresh, a provider, or the total."""
    if metric == "cost":
        return F.lit("est. spend"), F.coalesce(F.concat(F.lit("$"), F.format_number(totals["estimated_cost_usd"], 0)), F.lit("n/a"))
    if metric == "cached":
        whole = F.coalesce(F.nullif(totals["total_tokens"], F.lit(0)), F.lit(1))
        return F.lit("cached"), F.format_string("%.1f%%", totals["cached_tokens"] / whole * 100)
    if metric == "fresh":
        return F.lit("fresh tokens"), compact_number(totals["fresh_tokens"])
    if provider_total is not None:
        return F.lit(metric), F.concat(compact_number(provider_total), F.lit(" tok"))
    return F.lit("tokens"), F.concat(compact_number(totals["total_tokens"]), F.lit(" tok"))

"""Small texts made on the driver from small results: badges and a dossier."""

from __future__ import annotations

from collections.abc import Sequence
from html import escape

GREEN, GREY, RED = "#0a7", "#ddd", "#b33"
STATES = {"revoked": "signing key revoked", "unverified": "signature did not verify"}


def width(text: str, size: float = 11) -> int:
    """Pixels that a text takes, about, by classes of characters."""
    return round(size * sum(0.32 if c in "ijl.,:;'|!" else 0.86 if c in "mwMW@%" else 0.56 for c in text))


def _words(x: float, y: float, text: str, size: float = 11, anchor: str = "start", fill: str = "#222") -> str:
    return f'<text x="{x:g}" y="{y:g}" font-size="{size:g}" text-anchor="{anchor}" fill="{fill}">{escape(text)}</text>'


def _box(x: float, y: float, w: float, h: float, fill: str) -> str:
    return f'<rect x="{x:g}" y="{y:g}" width="{w:g}" height="{h:g}" fill="{fill}"/>'


def _svg(w: int, h: int, label: str, body: str) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{w}" height="{h}" viewBox="0 0 {w} {h}" role="img" aria-label="{escape(label)}" font-family="sans-serif"><title>{escape(label)}</title>{body}</svg>'


def badge_svg(label: str, value: str, color: str = GREEN) -> str:
    """A two-part badge; widths follow the texts. With text.badge_metric it is the live badge."""
    a, b = width(label) + 12, width(value) + 12
    body = _box(0, 0, a, 20, "#444") + _box(a, 0, b, 20, color) + _words(a / 2, 14, label, 11, "middle", "#fff") + _words(a + b / 2, 14, value, 11, "middle", "#fff")
    return _svg(a + b, 20, f"{label}: {value}", body)


def _linked(svg: str, profile_url: str) -> str:
    """A badge that does not lead to its evidence is not made."""
    if not profile_url.lower().startswith(("https://", "http://")):
        raise ValueError("an absolute address is needed")
    return f'<a href="{escape(profile_url)}">{svg}</a>'


def _strip(buckets: Sequence[bool], x: float, y: float, w: float, h: float) -> str:
    step = w / max(1, len(buckets))
    return "".join(_box(x + i * step, y, 0.75 * step, h, GREEN if hit else GREY) for i, hit in enumerate(buckets))


def strip_svg(buckets: Sequence[bool], profile_url: str) -> str:
    """A presence strip that leads to a profile."""
    return _linked(_svg(2 * len(buckets), 12, f"{sum(buckets)} of {len(buckets)} active", _strip(buckets, 0, 0, 2 * len(buckets), 12)), profile_url)


def days_text(n: int) -> str:
    return f"{n} active {'day' if n == 1 else 'days'}"


def profile_badge(facts: dict, profile_url: str, variant: str = "inline") -> str:
    """The badge of a profile: inline with its active days, mark with none, or card with tools, strip and what it does not show.

    facts: active_days, as_of, and for a card tools, first_date, last_date, strip; signature may be revoked or
    unverified, which the badge then says instead.
    """
    state = STATES.get(facts.get("signature", ""))
    color = RED if state else GREEN
    if variant != "card":
        return _linked(badge_svg("activity", state or ("signed snapshot" if variant == "mark" else days_text(facts["active_days"])), color), profile_url)
    lines = [" · ".join(facts.get("tools") or ["no tools recorded"]), f"measured from {facts.get('first_date') or 'unknown'} to {facts.get('last_date') or 'unknown'}"]
    notes = ["An active day has at least one recorded session; it is no measure of effort.", "Measured by its owner; nobody else has checked it.", state or "A signature shows that nothing was changed since, and nothing about the person."]
    body = _box(0, 0, 400, 26, "#444") + _words(12, 18, "ACTIVITY", 11, fill="#fff") + _words(388, 18, facts["as_of"], 11, "end", "#fff") + _words(12, 52, days_text(facts["active_days"]), 16, fill=color)
    body += "".join(_words(12, 72 + 16 * i, x) for i, x in enumerate(lines)) + _strip(facts.get("strip") or [], 12, 98, 376, 10) + "".join(_words(12, 128 + 15 * i, x) for i, x in enumerate(notes))
    return _linked(_svg(400, 170, f"{days_text(facts['active_days'])}, as of {facts['as_of']}", body), profile_url)


def dossier(title: str, signals: list[dict], providers: list[dict], most_signals: int = 16, most_models: int = 12, facts: dict | None = None, withheld: Sequence[str] = (), checks: Sequence[dict] = ()) -> str:
    """Markdown of the present signals, of activity, of the totals by provider, of checks, and of what was withheld."""
    cell = lambda x: str(x).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {cell(title)}", "", "## Evidence", ""]
    lines += [f"- {s['signal']} ({s['tier']}): {', '.join(s['allowed'])}; not: {', '.join(s['excluded'])}" for s in signals if s["present"]][:most_signals]
    if facts:
        lines += ["", "## Activity", "", *[f"- {k.replace('_', ' ')}: {cell(v)}" for k, v in facts.items() if v is not None]]
    lines += ["", "## Usage", "", "| Provider | Tokens | Models |", "| --- | --- | --- |"]
    lines += [f"| {cell(p['provider'])} | {p['total_tokens']:,} | {cell(', '.join(p['models'][:most_models]))} |" for p in providers]
    if checks:
        lines += ["", "## Checks", "", *[f"- {c['name']}: {c['status']}" for c in checks]]
    if withheld:
        lines += ["", f"Withheld by the owner: {', '.join(withheld)}."]
    return "\n".join(lines) + "\n"

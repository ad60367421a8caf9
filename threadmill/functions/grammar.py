"""The search grammar: terms, phrases, facets, regular expressions and dates, parsed on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

# Facet and date keys of the grammar.
FACET_KEYS = (
    "is", "origin", "provider", "agent", "model", "project", "cwd", "file", "content", "role", "tool", "skill", "mcp", "tool_cmd", "tool_status", "tool_mutating",
    "git_cmd", "git_pr", "git_pr_num", "git_commit", "git_branch", "git_remote",
)
DOCUMENTED_KEYS = ("source", "subagent", "tool_type", "tool_location", "tool_mutability", "tool_privilege")
DATE_KEYS = ("before", "after", "since", "until", "when")
#: Keys whose values are matched as substrings, without case.
METADATA_KEYS = ("provider", "agent", "model", "project", "cwd", "file", "source")
DAY_MS = 86_400_000


class QueryError(ValueError):
    """A query that can't be run, with the reason."""


@dataclass
class ParsedQuery:
    terms: list[str] = field(default_factory=list)
    phrases: list[str] = field(default_factory=list)
    facets: list[tuple[str, str]] = field(default_factory=list)
    dates: list[tuple[str, str]] = field(default_factory=list)
    regexes: list[str] = field(default_factory=list)

    @property
    def is_empty(self) -> bool:
        return not (self.terms or self.phrases or self.facets or self.regexes or self.dates)

    @property
    def highlights(self) -> list[str]:
        return [*self.terms, *self.phrases]

    def names(self, key: str) -> bool:
        return any(k == key for k, _ in self.facets)


def tokens(query: str) -> list[tuple[str, bool]]:
    """(text, quoted); an open quote runs to the end."""
    out = []
    for m in re.finditer(r'"([^"]*)(?:"|$)|[^\s"]+', query):
        text, quoted = (m[1], True) if m[0].startswith('"') else (m[0], False)
        if text:
            out.append((text, quoted))
    return out


def _dashed(value: str) -> str:
    return re.sub("[-_]{1,2}", "-", value.lower())


def _short_commit(value: str) -> str:
    return re.sub(r"^([0-9a-f]{7})[0-9a-f]+$", r"\1", value.lower())


#: How a facet's value is written in the tables, by key; a key that isn't here keeps its value.
_WRITTEN = (
    {"git_commit": _short_commit}
    | dict.fromkeys(("tool", "tool_cmd", "skill", "mcp"), str.lower)
    | dict.fromkeys(("tool_status", "content", "is", "origin", "provider", "agent", "role", "subagent", "tool_type", "tool_location", "tool_mutability", "tool_privilege"), _dashed)
)
_PATTERN = re.compile(r"/(.+)(?<!\\)/", re.S)
_KEYED = re.compile(r"([^:]+):(.*\S.*)", re.S)


def facet_value(key: str, value: str) -> str:
    """The value as the tables hold it; a /pattern/ stays, and one leading @ goes."""
    value = value.strip()
    is_pattern = len(value) > 2 and value[0] == value[-1] == "/"
    return value if is_pattern else _WRITTEN.get(key, str)(value.removeprefix("@"))


def _compiled(text: str, pattern: str) -> str:
    try:
        re.compile(pattern)
    except re.error as e:
        raise QueryError(f"invalid pattern {text}: {e}") from e
    return pattern.replace("\\/", "/")


def _bare(text: str) -> str:
    """A term without outer punctuation, lower-cased."""
    return re.sub(r"^[^\w*?/.\-]+|[^\w*?/.\-]+$", "", text).lower()


def parse_query(query: str) -> ParsedQuery:
    """Quoted text is a phrase and never a facet; key:value is a facet where the key is known and the value isn't empty;
    /pattern/ is a regular expression; the rest are terms, lower-cased, without outer punctuation, of two characters at least.
    """
    parts = tokens(query)
    words = [t for t, quoted in parts if not quoted]
    patterns = {w: m[1] for w in words if (m := _PATTERN.fullmatch(w))}
    keyed = {w: (m[1].strip().lower().replace("-", "_"), m[2].strip()) for w in words if w not in patterns and (m := _KEYED.fullmatch(w))}
    dates = {w: kv for w, kv in keyed.items() if kv[0] in DATE_KEYS}
    facets = {w: (k, facet_value(k, v)) for w, (k, v) in keyed.items() if k in FACET_KEYS + DOCUMENTED_KEYS}
    terms = [_bare(w) for w in words if not (w in patterns or w in dates or w in facets)]
    return ParsedQuery(
        terms=[t for t in terms if len(t) > 1],
        phrases=[t.strip().lower() for t, quoted in parts if quoted and t.strip()],
        facets=[facets[w] for w in words if w in facets],
        dates=[dates[w] for w in words if w in dates],
        regexes=[_compiled(w, patterns[w]) for w in words if w in patterns],
    )


def glob_pattern(value: str) -> str | None:
    """A whole-value Java pattern for a value with * or ?; None without them."""
    if not re.search(r"[*?]", value):
        return None
    return "(?s)^" + "".join({"*": ".*", "?": "."}.get(c) or re.sub(r"[\\.+()\[\]{}|^$]", r"\\\g<0>", c) for c in value) + "$"


def duration_ms(text: str) -> int:
    """1h, 5m, 30s or bare seconds, with a fraction."""
    m = re.fullmatch(r"\s*([0-9]*\.?[0-9]+)\s*([hms]?)\s*", text)
    if not m:
        raise QueryError(f"not a duration: {text}")
    return int(float(m[1]) * {"h": 3_600_000, "m": 60_000}.get(m[2], 1000))


def instant_ms(text: str, now_ms: int, zone: str = "UTC") -> int:
    """Nd: N days before now; YYYY-MM-DD: that day's start in the zone."""
    if m := re.fullmatch(r"([0-9]+)d", text):
        return now_ms - int(m[1]) * DAY_MS
    try:
        day = date.fromisoformat(text)
    except ValueError as e:
        raise QueryError(f"not a date: {text}") from e
    return int(datetime(day.year, day.month, day.day, tzinfo=ZoneInfo(zone)).timestamp() * 1000)


def date_range(dates: list[tuple[str, str]], now_ms: int, zone: str = "UTC") -> tuple[int | None, int | None]:
    """[from, to) of all date facets together; an empty range is an error."""
    low: int | None = None
    high: int | None = None
    for key, value in dates:
        at = instant_ms(value, now_ms, zone)
        if key in ("since", "after", "when"):
            low = at if low is None else max(low, at)
        if key in ("before", "until"):
            high = at if high is None else min(high, at)
        if key == "when" and not value.endswith("d"):
            end = instant_ms((date.fromisoformat(value) + timedelta(days=1)).isoformat(), now_ms, zone)
            high = end if high is None else min(high, end)
    if low is not None and high is not None and low >= high:
        raise QueryError("the date facets leave no time")
    return low, high

"""Per-turn column functions: ids, times, tokens, visibility, prompts, previews, projects. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that a harness injects begin with one of these.
INJECTED_PREFIXES = (
    "<environment_context>", "<permissions instructions>", "<collaboration_mode>", "<apps_instructions>", "<skills_instructions>", "<plugins_instructions>", "<turn_aborted>",
    "<system-reminder>", "<local-command-caveat>", "<local-command-stdout>", "<command-name>", "<user_instructions>", "<environment_details>", "# AGENTS.md instructions for ",
)
# System speakers whose turns are shown; the first is the engine itself.
VISIBLE_SPEAKERS = ("threadmill", "error", "tool_rejected", "turn_aborted", "task_notification", "scheduled_prompt")
TOKEN_KINDS = ("input", "output", "cache_creation", "cache_read", "reasoning", "estimated")
SPACE = r"\s"


def stable_id(source_path: Column) -> Column:
    """The conversation id of a source path."""
    return F.concat(F.lit("rg_"), F.substring(F.sha2(source_path, 256), 1, 24))


def is_conversation_id(c: Column) -> Column:
    return c.rlike("^rg_[0-9a-fA-F]{24}(:.*)?$")


def exchange_ref(c: Column) -> tuple[Column, Column]:
    """(id, zero-based ordinal) of 'id#eN' with N from 1; nulls for anything else."""
    pattern = r"^(rg_[0-9a-fA-F]{24}(?::[^#]*)?)#e([1-9][0-9]*)$"
    ok = c.rlike(pattern)
    return F.when(ok, F.regexp_extract(c, pattern, 1)), F.when(ok, F.regexp_extract(c, pattern, 2).cast("bigint") - 1)


def millis_from_number(n: Column) -> Column:
    """Seconds below 1e11, milliseconds below 1e14, else microseconds; null unless positive and finite."""
    n = n.cast("double")
    good = (n > 0) & ~F.isnan(n) & (n < F.lit(float("inf")))
    return F.when(good & (n < 1e11), (n * 1000).cast("bigint")).when(good & (n < 1e14), n.cast("bigint")).when(good, (n / 1000).cast("bigint"))


def parse_timestamp(s: Column) -> Column:
    """Milliseconds of an RFC 3339 time or a bare number in any of the units above."""
    s = F.trim(s)
    zoned = F.when(s.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"), F.unix_millis(F.try_to_timestamp(s)))
    return F.coalesce(zoned, F.when(s.rlike(r"^-?\d+$"), millis_from_number(s.try_cast("double"))))


def token_estimate(text: Column) -> Column:
    return F.floor(F.octet_length(F.coalesce(text, F.lit(""))) / 4).cast("bigint")


def accounted(prefix: str = "") -> Column:
    return sum((F.col(f"{prefix}{k}") for k in TOKEN_KINDS[1:4]), F.col(f"{prefix}input"))


def display_total(prefix: str = "") -> Column:
    return F.when(accounted(prefix) > 0, accounted(prefix)).otherwise(F.col(f"{prefix}estimated"))


def is_injected(text: Column) -> Column:
    head = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{SPACE}+", "")
    out = F.lit(False)
    for p in INJECTED_PREFIXES:
        out = out | head.startswith(p)
    return out


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(r"\S")


def is_visible(role: Column, speaker: Column, text: Column, special: Column, synthetic: Column) -> Column:
    """Not blank (unless special), not synthetic or injected, and system turns only of known speakers or special ones."""
    shown = (role != "system") | speaker.isin(*VISIBLE_SPEAKERS) | special.isNotNull()
    return ~(is_blank(text) & special.isNull()) & ~synthetic & ~is_injected(text) & shown


def opens_exchange(role: Column, text: Column, special: Column, synthetic: Column) -> Column:
    """A real prompt: a user turn that no harness made."""
    made = F.coalesce(special.rlike("^(task_notification|scheduled_prompt|compact_boundary)"), F.lit(False))
    return (role == "user") & ~synthetic & ~made & ~is_injected(text)


def preview(text: Column, most: int = 200) -> Column:
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    return F.translate(F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("…"))).otherwise(t), "\n", " ")


def title_line(text: Column, most: int = 120) -> Column:
    line = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?m)^\s*(\S.*?)\s*$", 1)
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most), F.lit("…"))).otherwise(line)


def scraped_cwd(text: Column) -> Column:
    """The first <cwd> tag's content."""
    return F.nullif(F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?is)<cwd>(.*?)</cwd>", 1)), F.lit(""))


def clean_path(p: Column) -> Column:
    """An absolute path without empty, '.' and '..' parts."""
    parts = F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def project_slug(cwd: Column) -> Column:
    """The project key of a working directory: every character that isn't a letter or digit becomes '-'."""
    return F.regexp_replace(clean_path(cwd), r"[^A-Za-z0-9]", "-")


def normalized_project(project: Column, cwd: Column) -> Column:
    """A slug stands; a path is cleaned and slugged; 'home' or nothing is repaired from the working directory."""
    slug = F.when(project.startswith("/"), project_slug(project)).otherwise(project)
    poor = project.isNull() | (F.trim(project) == "") | project.isin("home", "-home")
    return F.when(poor & cwd.isNotNull(), project_slug(cwd)).otherwise(F.coalesce(slug, F.lit("")))


def normalize_role(role: Column) -> Column:
    """The role's common name; a role without one stays, lower-cased (``records.known_role`` shows it as an event)."""
    r = F.lower(F.trim(role))
    known = F.when(r.isin("human", "user"), "user").when(r.isin("ai", "model", "assistant"), "assistant").when(r.isin("developer", "system"), "system")
    return known.when(r.isin("function", "tool"), "tool").otherwise(r)


def label(ts_ms: Column, period: str, zone: str = "UTC") -> Column:
    """Day, ISO week or month of the hour that holds the time, in a zone."""
    hour = F.timestamp_millis(F.floor(ts_ms / 3_600_000) * 3_600_000)
    local = F.from_utc_timestamp(hour, zone)
    if period == "daily":
        return F.date_format(local, "yyyy-MM-dd")
    if period == "monthly":
        return F.date_format(local, "yyyy-MM")
    if period == "weekly":
        return F.concat(F.extract(F.lit("YEAROFWEEK"), local).cast("string"), F.lit("-W"), F.lpad(F.extract(F.lit("WEEK"), local).cast("string"), 2, "0"))
    raise ValueError(f"no such period: {period}")

"""Presentation helpers: cut texts, short token counts, heat shades, JSON rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHADES = " ░▒▓█"
MOST_BYTES = 2400


def cut_text(text: str, most: int = MOST_BYTES) -> str:
    """The text's first ``most`` bytes at a character's end, marked where something is missing."""
    raw = text.encode()
    return text if len(raw) <= most else raw[:most].decode(errors="ignore") + "…"


def short_count(n: Column) -> Column:
    """999, 1.2k, 3.4M."""
    return F.when(n >= 1_000_000, F.format_string("%.1fM", n / 1e6)).when(n >= 1000, F.format_string("%.1fk", n / 1e3)).otherwise(n.cast("string"))


def shade(n: Column, top: Column) -> Column:
    """One of five shades by the share of the largest cell; blank for nothing."""
    step = F.when(n <= 0, 0).otherwise(F.least(F.lit(4), F.ceil(4 * n / F.greatest(top, F.lit(1)))))
    return F.substring(F.lit(SHADES), (step + 1).cast("int"), F.lit(1))


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as a JSON object, in a column named value."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))

"""Text analysis, BM25 and excerpts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

K1, B = 1.2, 0.75
HALF_LIFE_DAYS = 30.0
EXCERPT_BYTES = 360
MOST_RANGES = 64


def analyze(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def analyze_local(text: str) -> list[str]:
    import regex

    return [t for t in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if t]


def phrase_count(tokens: Column, words: list[str]) -> Column:
    """Occurrences of the words in order and side by side, over an analyzed array."""
    if len(words) == 1:
        return F.size(F.filter(tokens, lambda t: t == words[0]))
    # tokens hold letters and digits only, so the joined text needs no escapes; the look-ahead counts overlaps too
    joined = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    return F.regexp_count(joined, F.lit(f"(?= {' '.join(words)} )"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25_part(tf: Column, length: Column, average: Column, weight: Column) -> Column:
    return F.when(tf > 0, weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))).otherwise(0.0)


def recency(score: Column, last_ts: Column, now_ms: int, half_life_days: float = HALF_LIFE_DAYS) -> Column:
    """The score halved for each half-life since the last activity; no time counts as now minus nothing."""
    age = F.greatest(F.lit(0.0), (F.lit(now_ms) - F.coalesce(last_ts, F.lit(0))) / 86_400_000.0)
    return score * F.pow(F.lit(2.0), -age / half_life_days)


def excerpt_of(text: str, terms: list[str], most: int = EXCERPT_BYTES) -> tuple[str, list[tuple[int, int]]]:
    """A window of about ``most`` bytes whose first match stands a third in, and (start, length) of matches in its bytes."""
    raw = text.strip().encode()
    lower = text.strip().lower().encode()
    spans: set[tuple[int, int]] = set()
    for t in (t.lower().encode() for t in terms):
        at = lower.find(t) if t else -1
        while at >= 0:
            spans.add((at, at + len(t)))
            if len(spans) > MOST_RANGES:
                break
            at = lower.find(t, at + len(t))
    ranges = sorted(spans)

    def edge(i: int, step: int) -> int:
        i = min(max(i, 0), len(raw))
        while 0 < i < len(raw) and raw[i] & 0xC0 == 0x80:
            i += step
        return i

    start = edge(ranges[0][0] - most // 3, -1) if ranges else 0
    end = edge(start + most, 1)
    if ranges and ranges[0][1] > end:
        end = edge(min(ranges[0][1], start + 2 * most), 1)
    lead = "…" if start else ""
    shown = lead + raw[start:end].decode(errors="replace") + ("…" if end < len(raw) else "")
    shift = len(lead.encode()) - start
    return shown.replace("\n", " "), [(a + shift, b - a) for a, b in ranges if a >= start and b <= end]


def excerpt(text: Column, terms: list[str], most: int = EXCERPT_BYTES) -> Column:
    """STRUCT<excerpt, highlights>: an Arrow function, meant for the few rows of a result."""
    kind = T.StructType([T.StructField("excerpt", T.StringType()), T.StructField("highlights", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("len", T.IntegerType())])))])

    @F.arrow_udf(kind)
    def cut(texts: pa.Array) -> pa.Array:
        found = [excerpt_of(t or "", terms, most) for t in texts.to_pylist()]
        marks = pa.array([[{"start": a, "len": n} for a, n in h] for _, h in found], pa.list_(pa.struct([("start", pa.int32()), ("len", pa.int32())])))
        return pa.StructArray.from_arrays([pa.array([e for e, _ in found], pa.string()), marks], ["excerpt", "highlights"])

    return cut(text)

import re
from collections import Counter, defaultdict

import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def shingle_set(text, k=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows, percent=85):
    """[(doc_id, n_shingles, component_id)] of (doc_id, text) rows by comparing all sets that share a shingle."""
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in holders[x])
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
        for x in s:
            holders[x].append(i)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return [(d, len(sets[i]), low.get(root(i))) for i, (d, _) in enumerate(rows)]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, repeated rows, ties, and extra columns with clashing names."""
    rows = [
        (1, None, "en", "a", None), (2, "", None, None, 0), (3, "  \n\t ", "en", "a", 5), (4, "one", "en", "b", 3), (4, "one", "en", "b", 3), (5, "Zebra zebra ZEBRA", "de", "Ä", None),
        (None, "no id here at all my friend", "en", None, 1), (None, None, None, None, None), (6, "x" * 30_000, "en", "a", 1), (7, "w " * 9_000, "en", "b", 1), (8, "é ü ñ  double  spaces nbsp", "fr", "b", 1), (9, "<|endoftext|> it's 12!!", "en", "c", 1),
    ]
    from pyspark.sql import functions as F

    extra = {c: F.lit(c) for c in ("score", "label", "key", "size", "part", "row", "piece", "length", "name", "root", "target", "before", "copy")}
    return spark.createDataFrame(rows, DOCS).withColumns(extra)

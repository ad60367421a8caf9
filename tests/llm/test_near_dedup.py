import random

import numpy as np
import pytest
from conftest import SF, brute_components

from threadmill.llm import near_dedup as N
from threadmill.llm import shingles, support


def variants(n, seed=1, words=120):
    """Texts around a few bases, whose similarities lie on both sides of 0.85, and chains of small edits."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    out = []
    for b in range(n // 30):
        base = [rng.choice(vocab) for _ in range(words)]
        chain = list(base)
        for k in range(30):
            t = list(base) if k % 2 else chain
            for _ in range(rng.choice((0, 1, 1, 2, 3, 4))):
                t[rng.randrange(words)] = rng.choice(vocab)
            out.append(" ".join(t).upper() if k % 7 == 0 else " ".join(t))
    rng.shuffle(out)
    return list(enumerate(out))


def result(spark, rows, **more):
    df = N.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), **more)
    return sorted((r[0], r[1], r[2]) for r in df.select("doc_id", "n_shingles", "component_id").collect())


def test_against_brute_force(spark):
    rows = variants(300)
    assert result(spark, rows) == sorted(brute_components(rows))


def test_large_clusters_take_rounds(spark):
    rows = variants(180, seed=2)
    assert result(spark, rows, cluster_sets=5, cluster_shingles=10**9) == sorted(brute_components(rows))


@pytest.mark.parametrize("percent", [80, 85])
def test_deepest_nodes_keep_links(spark, percent):
    """Pairs at the threshold in nodes that stay large: hardly any is apart in every tree."""
    rng, n = np.random.default_rng(5), 4000
    common = percent * 2  # of a union of 200
    x = rng.integers(1, 2**63, (n, 200), dtype=np.uint64)
    half = common + (200 - common) // 2
    sets = [np.sort(s) for row in x for s in (row[:half], np.concatenate([row[:common], row[half:]]))]
    sig = N.signatures(sets)
    reps = spark.createDataFrame([(f"{i // 2:06d}{'ab'[i % 2]}".encode(), sig[i].tobytes()) for i in range(2 * n)], "name binary, sig binary")
    _, joined = N.tree_nodes(reps, node=1)
    found = {bytes(r["u"])[:6] for r in joined.distinct().collect() if r["u"] != r["v"] and bytes(r["u"])[:6] == bytes(r["v"])[:6]}
    assert 1 - len(found) / n <= 0.001


def test_documents(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = N.op9_near_duplicates(spark, SF).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute_components(rows))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_odd_and_empty_tables(spark, odd_docs):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in N.near_duplicates(odd_docs).collect()]
    key = lambda r: str(r)
    want = [(d, n, c if n else d, d == (c if n else d)) for d, n, c in brute_components([(r["doc_id"], r["text"]) for r in odd_docs.collect()])]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert N.near_duplicates(odd_docs.limit(0)).count() == 0


def test_keep_one(spark, odd_docs):
    kept = N.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(x) for x in (1, 2, 3, 4, 5, None, None, 6, 7, 8, 9))
    rows = variants(120, seed=3)
    own = {c for _, _, c in brute_components(rows)}
    assert {r["doc_id"] for r in N.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()} == own


def test_keep_one_at_80(spark):
    rows = variants(120, seed=4, words=80)
    own = {c for _, _, c in brute_components(rows, 80)}
    assert own != {c for _, _, c in brute_components(rows)}
    assert {r["doc_id"] for r in N.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string"), percent=80).collect()} == own


def test_word_hashes_follow_words():
    import pyarrow as pa

    texts = ["A b\tc", "", None, "a B c", "x" * 5000 + " y", "X" * 5000 + " y", "é", "ab", "ba", " lead"]
    data, off = shingles.text_bytes(pa.array(texts))
    start, end, text, h = shingles.words(data, off)
    words = [bytes(data[a:b]).decode() for a, b in zip(start, end, strict=True)]
    assert words == ["A", "b", "c", "a", "B", "c", "x" * 5000, "y", "X" * 5000, "y", "é", "ab", "ba", "lead"]
    same = lambda w: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
    assert len(set(h.tolist())) == len({same(w) for w in words})
    assert text.tolist() == [0, 0, 0, 3, 3, 3, 4, 4, 5, 5, 6, 7, 8, 9]


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(i, i + 1) for i in range(200, 260)] + [(300, i) for i in range(301, 360)] + [(7, 7)]
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in support.components(spark.createDataFrame(edges, "u bigint, v bigint").union(spark.sql("select null, 1L"))).collect()}
    assert got == {i: root(i) for i in list(up)}
    assert support.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0

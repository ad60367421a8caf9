"""Quality, toxicity and nearest neighbours: held-out accuracy, recall, and odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadmill.llm import graph_index as A
from threadmill.llm import quality, toxicity
from threadmill.llm.support import is_held_out

SF = "/root/testdata/sf0.01"
OPS = {"quality": (quality, "quality", 0.3, 0.97), "toxicity": (toxicity, "toxic", 0.5, 0.88)}


@pytest.mark.parametrize("name", list(OPS))
def test_held_out_accuracy(spark, name):
    module, label, cut, least = OPS[name]
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r["doc_id"]: r for r in module.scored(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r["held_out"] == is_held_out(d) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut) for d, r in got.items())
    held = [(got[r["doc_id"]]["predicted"], r[label]) for r in labels.collect() if is_held_out(r["doc_id"]) and r["doc_id"] in got]
    assert np.mean([a == b for a, b in held]) >= least


@pytest.mark.parametrize("name", list(OPS))
def test_held_out_labels_are_not_read(spark, name):
    module, label, _, _ = OPS[name]
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 250"), spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn(label, F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col(label)).otherwise(F.col(label)))
    one, two = ({r["doc_id"]: r["score"] for r in module.scored(docs, x).collect()} for x in (labels, flipped))
    assert one == two


@pytest.mark.parametrize("name", list(OPS))
def test_odd_and_empty_tables(spark, odd_docs, name):
    module, label, _, _ = OPS[name]
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, 1), (4, 1), (5, 0), (6, None), (None, 1), (7, 0), (8, 1)], f"doc_id bigint, {label} int")
    got = module.scored(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 4}) == 1
    assert module.scored(odd_docs.limit(0), labels).count() == 0
    none = module.scored(odd_docs, labels.limit(0)).collect()
    assert len(none) == len(got) and len({r["score"] for r in none}) == 1
    keep = module.keep_good if name == "quality" else module.keep_ordinary
    assert keep(odd_docs, labels).columns == odd_docs.columns


def test_rare_words_count(spark):
    """A toxic word that the labelled rows hold once or twice is not an unseen word."""
    plain = [f"the garden near house {w} was green and quiet" for w in ("one", "two", "red", "old", "new")]
    ids = [i for i in range(400) if not is_held_out(i)]
    rows = [(i, plain[i % 5] + (" zubrwix" if i in ids[:2] else " vlokhund" if i % 2 else ""), int(i in ids[:2] or i % 2)) for i in ids]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(1000, plain[0] + " zubrwix"), (1001, plain[0] + " kimolat")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id bigint, toxic int")).collect()}
    assert got[1000] > got[1001]


def test_words_beyond_the_broadcast_are_joined(spark, monkeypatch):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 250"), spark.read.parquet(f"{SF}/labels.parquet")
    want = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, labels).collect()}
    keep = sorted(r["doc_id"] for r in toxicity.keep_ordinary(docs, labels).collect())
    monkeypatch.setattr(toxicity, "HOT", 50)
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, labels).collect()}
    assert set(got) == set(want) and max(abs(got[i] - want[i]) for i in want) < 1e-6
    assert sorted(r["doc_id"] for r in toxicity.keep_ordinary(docs, labels).collect()) == keep


def brute(rows, queries, k=20):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for i, v in queries:
        s = (x * np.array(v, float)).sum(axis=1)
        own = ids != i
        order = np.lexsort((ids[own], -s[own]))[:k]
        out[i] = list(zip(ids[own][order].tolist(), s[own][order].tolist(), strict=True))
    return out


def searched(spark, rows, every=20, **more):
    df = spark.createDataFrame([(i, [float(c) if c is not None else None for c in v] if v is not None else None) for i, v in rows], "vec_id bigint, embedding array<float>")
    got = {}
    for r in A.search(A.index(df, **more), df.where(F.col("vec_id") % every == 0)).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got.setdefault(r["query_id"], [])) + 1
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    return got


@pytest.mark.parametrize("scale", [False, True])
def test_recall(spark, scale):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(1500, 16)).astype(np.float32)
    if scale:
        v *= rng.lognormal(size=(1500, 1)).astype(np.float32)
    rows = [(i, v[i].tolist()) for i in range(1500)]
    want, got = brute(rows, [r for r in rows if r[0] % 20 == 0]), searched(spark, rows, shard=400)
    assert set(got) == set(want)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.95
    exact = {q: dict(brute(rows, [rows[q]], k=1499)[q]) for q in list(want)[:5]}
    assert all(abs(s - exact[q][i]) < 1e-12 * max(1, abs(s)) for q in exact for i, s in got[q])


def test_ties_repeats_and_unusable_vectors(spark):
    rng = np.random.default_rng(4)
    hot = [1.0, 2.0, 0.5]
    rows = [(i, hot if i % 3 == 0 else rng.normal(size=3).astype(np.float32).tolist()) for i in range(300)]
    good = list(rows)
    rows += [(400, None), (420, [0.0, 0.0, 0.0]), (440, [1.0, None, 2.0]), (460, [float("nan"), 1.0, 1.0]), (480, [float("inf"), 1.0, 1.0]), (60, hot)]
    got, want = searched(spark, rows), brute(good, [r for r in good if r[0] % 20 == 0])
    assert set(got) == set(want)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
    assert searched(spark, rows[:1]) == {}
    assert searched(spark, rows[:3]) == brute(rows[:3], rows[:1])


def test_doubles_wide_norms_and_ids_of_several_vectors(spark):
    rng = np.random.default_rng(9)
    rows = [(i, (rng.normal(size=4) * 0.73).tolist()) for i in range(100)] + [(20, [0.73, 0.73, 0.1, 0.2]), (101, [1e300, 0.0, 0.0, 0.0]), (41, [5.0, 5.0, 5.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("rank", F.lit("x")).withColumn("score", F.lit(1)).withColumn("dim", F.lit(2))
    got = {}
    for r in A.search(A.index(df), df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    for i, found in got.items():
        assert len(found) == 20 == len({v for v, _ in found}) and i not in {v for v, _ in found}
        asks = [np.array(v) for j, v in rows if j == i]
        want = [sorted(((-max(float((q * np.array(v)).sum()) for k, v in rows if k == j), j) for j in {j for j, _ in rows} - {i}))[:20] for q in asks]
        assert found in [[(j, -s) for s, j in w] for w in want]
    assert set(got) == {0, 20, 40, 60, 80}
    assert A.search(A.index(df.limit(0)), df.limit(0)).count() == 0


def test_recall_in_a_dense_group_with_hubs(spark):
    """A third of the vectors in one dense group of distinct vectors, over several shards of the registered size."""
    rng = np.random.default_rng(12)
    n = 20_000
    v = rng.normal(size=(n, 16))
    v[::3] = rng.normal(size=16) + 0.01 * rng.normal(size=(len(v[::3]), 16))
    v = v.astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<float>")
    graphs = A.index(df)
    assert graphs.count() == 3
    got = {}
    for r in A.search(graphs, df.where("vec_id % 200 = 0")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    x = v.astype(float)
    recall = []
    for i, found in got.items():
        s = (x * x[i]).sum(axis=1)
        s[i] = -np.inf
        recall.append(len(found & set(np.argsort(-s, kind="stable")[:20].tolist())) / 20)
    assert len(recall) == 100 and np.mean(recall) >= 0.9


def test_documents_recall(spark):
    rows = [(r[0], list(r[1])) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = {}
    for r in A.op2_nearest_neighbours(spark, SF).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = brute(rows, [r for r in rows if r[0] % 20 == 0])
    assert np.mean([len(got[q] & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_quality_bins_count_ngrams():
    """The bins against literal counts: as many as n-grams, equal for equal texts, and apart by text."""
    import pyarrow as pa

    from threadmill.llm import shingles

    texts = ["ab cd ab cd", "", "é!", "x", "ab cd ab cd", "a" * 9, " ", "cd ab"]
    data, off = shingles.text_bytes(pa.array(texts))
    _, _, text, h = shingles.words(data, off)
    got = quality.binned(data, off, text, h)
    for i, t in enumerate(texts):
        raw, words = t.encode(), t.split()
        grams = [raw[a : a + k] for k in (2, 3, 4) for a in range(len(raw) - k + 1)]
        pairs = [(w,) for w in words] + list(zip(words, words[1:]))
        for part, items in ((got[i, : quality.CHAR_BINS], grams), (got[i, quality.CHAR_BINS :], pairs)):
            counts = sorted({x: items.count(x) for x in items}.values())
            want = np.sqrt(np.array(counts, float) / max(1, len(items)))
            assert np.isclose((part**2).sum(), bool(items))
            assert len(part[part > 0]) <= len(counts) and (len(part[part > 0]) < len(counts) or np.allclose(np.sort(part[part > 0]), want))
        alone = shingles.text_bytes(pa.array([t]))
        _, _, one, own = shingles.words(*alone)
        assert (quality.binned(*alone, one, own)[0] == got[i]).all()


def test_quality_fit_against_newton_on_written_differences():
    rng = np.random.default_rng(11)
    n = quality.CHAR_BINS + quality.WORD_BINS + 6
    x = rng.normal(size=(300, n)).astype(np.float32)
    y = (x[:, -1] + 0.5 * x[:, 3] + rng.normal(size=300) > 0).astype(int)
    m = quality.fit(x, y, pairs=3000)
    z = np.clip((x - m["mean"]) / m["sd"], -8, 8)
    draw = np.random.default_rng(7)
    d = z[draw.choice(np.flatnonzero(y == 1), 3000)] - z[draw.choice(np.flatnonzero(y == 0), 3000)]
    ridge = np.where(np.arange(n) < quality.CHAR_BINS + quality.WORD_BINS, quality.BIN_RIDGE, quality.RIDGE)
    w = np.zeros(n)
    for _ in range(60):
        p = 1 / (1 + np.exp(d @ w))
        w += np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / 3000 + np.diag(ridge), d.T @ p / 3000 - ridge * w)
    assert np.abs(z @ (m["w"] - w)).max() < 0.02 * np.abs(z @ w).max()
    assert np.isclose(m["cut"], np.quantile(z @ m["w"], (y == 0).mean()))
    assert np.isclose(quality.score(m, x), 1 / (1 + np.exp(-(m["scale"] * (z @ m["w"] - m["cut"]) + np.log(0.3 / 0.7))))).all()


def test_kneser_ney_against_literal_counts(spark):
    """Every word's difference of log-likelihoods, and every head's for a new rest, from literal counts of words, heads and rests."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    vocab = ["a", "toad", "toads", "toadies", "grim", "grimmer", "hammer", "hammers", "clams", "ünder", "zebra"]
    rows = [(i, int(i % 2), " ".join(rng.choice(vocab, 12, p=np.arange(1, 12) / 66 if i % 2 else np.arange(11, 0, -1) / 66))) for i in range(40)]
    by_word, by_head, _ = toxicity.parameters(toxicity.count_words(spark.createDataFrame(rows, "doc_id bigint, label int, text string")))
    counts = [{}, {}]
    for _, label, text in rows:
        for w in text.split():
            counts[label][w] = counts[label].get(w, 0) + 1
    words = sorted(set(counts[0]) | set(counts[1]))
    head, rest = lambda w: w.encode()[:4], lambda w: w.encode()[4:]
    d = toxicity.DISCOUNT
    heads = sorted({head(w) for w in words})
    kinds = {h: sum(head(w) == h for w in words) for h in heads}
    n = [{h: sum(c for w, c in counts[k].items() if head(w) == h) for h in heads} for k in (0, 1)]
    types = [{h: sum(head(w) == h for w in counts[k]) for h in heads} for k in (0, 1)]

    def p_head(k, h):
        total, live = sum(n[k].values()), sum(x > 0 for x in n[k].values())
        base = (kinds[h] + 1) / (len(words) + len(heads) + 1)
        return (max(n[k][h] - d, 0) + d * live * base) / (total + d)

    back = lambda k, h: min(d * max(types[k][h], 1) / n[k][h], 1) if n[k][h] else 1.0
    follows = lambda r: sum(rest(w) == r for w in words)
    p_rest = lambda k, w: max(counts[k].get(w, 0) - d, 0) / max(n[k][head(w)], 1) + back(k, head(w)) * follows(rest(w)) / len(words)
    got = {r["word"]: r["l0"] for r in by_word.collect()}
    column = pa.array(words)
    for i, w in enumerate(words):
        _, h, x, _ = toxicity.units(column, i, i + 1, rests=True)
        want = np.log(p_rest(1, w)) - np.log(p_rest(0, w)) + np.log(p_head(1, head(w))) - np.log(p_head(0, head(w)))
        assert np.isclose(got[int((x & ~np.uint64(3)).view(np.int64)[0])], want, atol=1e-5), w
        of_head = by_head.where(F.col("head") == int(h.view(np.int64)[0])).first()["r0"]
        some = np.log(back(1, head(w)) / back(0, head(w)) * p_head(1, head(w)) / p_head(0, head(w)))
        assert np.isclose(of_head, some if kinds[head(w)] > 1 else some / 2, atol=1e-5), w

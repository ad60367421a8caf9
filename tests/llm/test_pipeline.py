"""The pipeline against a version that applies its models to rows one after another and does the rest by brute force."""

import zlib

import corpus_pipeline as P
import numpy as np
import public_tokenizers
import pyarrow as pa
from conftest import SF, brute_components
from test_native_and_mixing import shares
from tokenizers import Tokenizer

from threadmill.llm import quality, shingles, toxicity


def scores(module, model, texts):
    column = pa.array(texts, pa.string())
    data, off = shingles.text_bytes(column)
    if module is quality:
        return np.concatenate([quality.score(model, quality.features(data[off[i] : off[i + 1]], off[i : i + 2] - off[i])) for i in range(len(texts))])
    return np.concatenate([toxicity.score(model, column, i, i + 1) for i in range(len(texts))])


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    schema = docs.schema
    for module, keep in ((quality, lambda s: s >= 0.3), (toxicity, lambda s: s < 0.5)):
        ids = sorted(rows)
        model = module.train(spark.createDataFrame([rows[i] for i in ids], schema), labels)
        kept = keep(scores(module, model, [rows[i]["text"] for i in ids]))
        rows = {i: rows[i] for i, k in zip(ids, kept, strict=True) if k}
    comps = brute_components([(i, rows[i]["text"]) for i in sorted(rows)])
    rows = {d: rows[d] for d, n, c in comps if not n or c == d}
    size = {i: len((r["text"] or "").split()) for i, r in rows.items()}
    by_source = {}
    for i, r in rows.items():
        by_source.setdefault(r["source"], []).append(i)
    goal = shares({s: sum(size[i] for i in ids) for s, ids in by_source.items()})
    stage = docs
    tables = []
    for name, f in P.STAGES:
        stage = f(spark, stage, SF)
        tables.append((name, stage.collect(), stage.schema))
        stage = spark.createDataFrame(tables[-1][1], stage.schema)
    assert [n for n, _, _ in tables] == ["quality", "toxicity", "near_duplicates", "mixing", "packing"]
    assert all(s.names == docs.columns for _, _, s in tables[:-1])
    assert sorted(r["doc_id"] for r in tables[2][1]) == sorted(rows)
    got_mix = tables[3][1]
    for s, ids in by_source.items():
        own = [r for r in got_mix if r["source"] == s]
        assert sum(len((r["text"] or "").split()) for r in own) == round(goal[s])
        cut = [r for r in own if r["text"] != rows[r["doc_id"]]["text"]]
        assert len(cut) <= 1 and all(rows[r["doc_id"]]["text"].startswith(r["text"]) for r in cut)
        times = [sum(1 for r in own if r["doc_id"] == i) for i in ids if size[i]]
        assert not times or max(times) - min(times) <= 1
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r in got_mix:
        ids = [*lib.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        want += [(r["doc_id"], k, k * 2048, len(p), zlib.crc32(np.asarray(p, "<u4").tobytes())) for k, p in enumerate(ids[a : a + 2048] for a in range(0, len(ids), 2048))]
    packed = tables[4][1]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == sorted(want)
    full = P.run(spark, SF).collect()
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in full) == sorted(w[:2] + w[4:] for w in want)

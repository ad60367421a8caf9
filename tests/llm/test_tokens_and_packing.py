import io
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from threadmill.llm import packing, support, token_files, tokens

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")


def plain(name):
    return Tokenizer.from_file(P.path(name))


@pytest.fixture(scope="module")
def both():
    return {n: (tokens.Encoder(tokens.tokenizer_json(P.path(n))), plain(n)) for n in FILES}


@pytest.mark.parametrize("name", FILES)
def test_encoding_equals_the_library(both, name, spark):
    enc, lib = both[name]
    texts = [r[0] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    texts += ["", " ", "\n", "a\n\nb", "a \n b", "\ta", "é a ́b", "don't IT'S", "<|endoftext|>", "hi <|endoftext|> there", "a<|startoftext|>b <|endoftext|><|startoftext|>", "<|ENDOFTEXT|> x", "<| endoftext |> <|endoftext", "x\x1cy z", "a b", "THE!! ### $$$ a|b", "İ Σας ﬁ 中文　字", "a\x85b", "end "]
    assert enc.encode(texts) == [np.asarray(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abE é'.!#| \n\t12 ß́"))), max_size=4))
def test_encoding_of_odd_texts(both, texts):
    for enc, lib in both.values():
        assert enc.encode(texts) == [np.asarray(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


@pytest.mark.parametrize("vocabulary", [2, 3, 257, 32_000, 50_257, 70_000])
def test_bit_packing_and_random_access(vocabulary):
    rng = np.random.default_rng(vocabulary)
    out = io.BytesIO()
    w = token_files.Writer(out, vocabulary)
    docs = [(None if i == 3 else i, rng.integers(0, vocabulary, n).astype(np.uint32)) for i, n in enumerate((5, 0, 70_000, 1, 140_000, 3))]
    for d, ids in docs:
        w.add(d, ids)
    w.close()
    r = token_files.Reader(io.BytesIO(out.getvalue()), len(out.getvalue()))
    whole = np.concatenate([ids for _, ids in docs])
    assert r.width == max(1, (vocabulary - 1).bit_length()) and r.total == len(whole)
    for a, b in ((0, 5), (65_530, 65_545), (70_000, 70_001), (131_000, 215_009), (7, 7)):
        assert (r.ids(a, b) == whole[a:b]).all()
    back = list(r.documents_from(blocks_at_once=1))
    assert [d for d, _, _ in back] == [d for d, _ in docs]
    assert all((x == ids).all() for (_, _, x), (_, ids) in zip(back, docs, strict=True))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|", "|>", "word", "Word,", " ", "\n", "é"]), max_size=8).map("".join), max_size=4))
def test_added_tokens_are_found_as_the_library_finds_them(both, texts):
    for enc, lib in both.values():
        assert enc.encode(texts) == [np.asarray(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def brute_ids(rows, name):
    lib = plain(name)
    return {d: [*lib.encode(t or "", add_special_tokens=False).ids, 0] for d, t in rows}


def test_op3_against_brute_force(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want, at = {}, 0
    for d, ids in sorted(brute_ids(rows, FILES[0]).items()):
        want[d] = (at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        at += len(ids)
    got = {r[0]: tuple(r[1:4]) for r in token_files.op3_token_files(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()}
    assert got == want


def test_token_files_of_odd_and_empty_tables(spark, odd_docs):
    path = P.path(FILES[0])
    got = token_files.read(token_files.write(odd_docs, support.scratch_path(spark, "t"), path)).collect()
    assert len(got) == odd_docs.count()
    by_start = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in by_start] == np.cumsum([0, *[r["n_tokens"] for r in by_start[:-1]]]).tolist()
    ids = [r["doc_id"] for r in by_start]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])
    assert token_files.read(token_files.write(odd_docs.limit(0), support.scratch_path(spark, "t"), path)).count() == 0


def check_packing(rows, limit=2048):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for s in by.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= limit
    return len(by)


def test_op10_against_brute_force(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = {(d, k): (k * 2048, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())) for d, ids in brute_ids(rows, FILES[1]).items() for k, part in enumerate(ids[a : a + 2048] for a in range(0, len(ids), 2048))}
    got = packing.op10_best_fit_packing(spark, SF).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    total = sum(r["length"] for r in got)
    assert check_packing(got) <= 1.02 * total / 2048 + 2


def test_packing_of_odd_and_empty_tables(spark, odd_docs):
    parts = packing.pieces(odd_docs, P.path(FILES[1]), with_ids=True)
    got = packing.pack(parts, group_pieces=4).collect()
    assert len({(r["doc_id"], r["piece"]) for r in got}) == 11 + max(r["piece"] for r in got if r["doc_id"] == 6) + max(r["piece"] for r in got if r["doc_id"] == 7) - 1
    check_packing(got)
    assert all(len(r["ids"]) == 4 * r["length"] for r in got)
    assert packing.pack(packing.pieces(odd_docs.limit(0), P.path(FILES[1]))).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=80), st.sampled_from(["norm", "dot"]), st.sampled_from([(1, 0, 0), (1, 0.5, 0.5)]))
def test_every_capacity_holds(lengths, score, weights):
    lengths = sorted(lengths, reverse=True)
    c = packing.Capacity(tokens=100, documents=5, attention=10_000, weights=weights, score=score)
    seq, off = packing.pack_lengths(np.array(lengths), c)
    for s in set(seq.tolist()):
        own = [n for n, q in zip(lengths, seq, strict=True) if q == s]
        assert sum(own) <= 100 and len(own) <= 5 and sum(n * n for n in own) <= 10_000
        assert sorted(off[seq == s].tolist()) == np.cumsum([0, *own[:-1]]).tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=60), st.sampled_from(["norm", "dot"]), st.sampled_from([(1, 0, 0), (1, 0.1, 0.1), (0.1, 1, 3)]))
def test_each_choice_is_the_best_of_all_open_sequences(lengths, score, weights):
    lengths = sorted(lengths, reverse=True)
    limits = (60, 6, 2500)
    c = packing.Capacity(*limits, weights=weights, score=score)
    if lengths and lengths[0] > 50:
        with pytest.raises(ValueError):
            packing.pack_lengths(np.array(lengths), c)
        return
    seq, _ = packing.pack_lengths(np.array(lengths), c)
    rooms = {}
    for n, q in zip(lengths, seq.tolist(), strict=True):
        need = (n, 1, n * n)
        value = lambda r: sum(w / m**2 * ((x - y) ** 2 if score == "norm" else -x * y) for w, m, x, y in zip(weights, limits, r, need, strict=True))  # noqa: B023, E731
        fits = {k: value(r) for k, r in rooms.items() if all(x >= y for x, y in zip(r, need, strict=True))}
        assert (q in fits) == bool(fits)
        if fits:
            assert fits[q] <= min(fits.values()) + 1e-12
        rooms[q] = tuple(x - y for x, y in zip(rooms.get(q, limits), need, strict=True))


def test_vector_weights_cost_no_sequence(spark):
    """The default weights of documents and attention choose between sequences and leave their number at the bound of the tokens."""
    rng = np.random.default_rng(6)
    lengths = np.sort(np.minimum(2048, rng.lognormal(6, 1.2, 20_000).astype(int) + 1))[::-1]
    for c in (packing.Capacity(), packing.Capacity(weights=(1, 0, 0))):
        seq, _ = packing.pack_lengths(lengths, c)
        assert seq.max() + 1 <= -(-lengths.sum() // 2048) + 1


def test_a_piece_beyond_a_capacity_fails():
    with pytest.raises(ValueError):
        packing.pack_lengths(np.array([50]), packing.Capacity(tokens=100, attention=100))

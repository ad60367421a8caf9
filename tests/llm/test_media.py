import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from threadmill.llm import media as M


def payload(text):
    b = (text or "").encode()
    return b + b"\xff" * (max(1, -(-len(b) // 576)) * 576 - len(b))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=1500).map(lambda b: b.decode("latin-1")), max_size=5))
def test_round_trip(texts):
    files = M.store(pa.array([*texts, None], pa.string())).to_pylist()
    assert [p for p, _ in M.decode(files)] == [payload(t) for t in [*texts, None]]


def test_a_general_decoder_agrees():
    rng = np.random.default_rng(1)
    frames = rng.integers(0, 256, (2, M.FRAME)).astype(np.uint8)
    for image, frame in zip(M.encode_frames(frames), frames, strict=True):
        pixels = M.decode_jpeg(image)
        assert pixels.shape == (192, 192)
        assert (pixels == np.kron(frame.reshape(24, 24), np.ones((8, 8), np.uint8))).all()
        assert (M.decode_frames([image.replace(b"\xff\xda", b"\xff\xfe\x00\x04hi\xff\xda", 1)])[0] == frame).all()  # with a comment it isn't the own layout
    with pytest.raises(ValueError):
        M.decode_jpeg(b"no image")


def test_avi_layout():
    images = M.encode_frames(np.arange(2 * M.FRAME).reshape(2, -1).astype(np.uint8))
    data = M.write_avi(images, frame_us=50_000)
    assert data[:4] == b"RIFF" and struct.unpack("<I", data[4:8])[0] == len(data) - 8
    assert M.read_avi(data) == M.Avi(50_000, images)
    cut = data.index(b"idx1")
    assert M.read_avi(data[:cut]).images == images  # without an index, in the order of chunks
    with pytest.raises(ValueError):
        M.read_avi(b"RIFF....WAVE")


def test_shots():
    rng = np.random.default_rng(2)
    scenes = [(0, 60), (100, 160), (190, 250)]
    frames = np.concatenate([rng.integers(a, b, (20, M.FRAME)) for a, b in scenes]).astype(np.uint8)
    found = M.shots(M.histograms(frames), 40_000)
    assert [c[:4] for c in found] == [(0, 20, 0, 800), (20, 20, 800, 1600), (40, 20, 1600, 2400)]


def test_op6_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in M.op6_media_columns(spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        p, g = payload(r["text"]), got[r["doc_id"]]
        assert (g["n_bytes"], g["payload_bytes"], g["payload_sha256"], g["tail_crc32"]) == (len((r["text"] or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert g["media_bytes"] > len(p) and g["feature"].startswith("clips=")


def test_odd_and_empty_tables(spark, odd_docs):
    media = M.with_media(odd_docs)
    got = M.digests(media).collect()
    assert len(got) == odd_docs.count()
    assert len({(r["media_sha256"], r["feature"]) for r in got if r["n_bytes"] == 0}) == 1
    clips = M.clips(media).collect()
    assert sum(r["frames"] for r in clips) == sum(r["payload_bytes"] for r in got) // 576
    assert M.digests(M.with_media(odd_docs.limit(0))).count() == 0

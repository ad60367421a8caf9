"""Media columns: AVI motion-JPEG, written, parsed and decoded in numpy.

A frame is SIDE x SIDE units of eight by eight pixels, grey, baseline JPEG.  A unit stores one
8-bit sample: all its pixels have the sample's value, so its only coefficient is the mean, and with a
mean quantiser of 8 any baseline decoder returns the sample exactly.  The Huffman table gives
category s a code of 9 - s bits, so every sample takes nine bits and its end-of-block mark one:
encoding and decoding are reshapes over all frames of a batch, not loops over bits.  Frames of other
writers (any Huffman tables, AC coefficients, several components) take the general decoder.

Shots are told apart by differences of frames' histograms against a threshold that adapts
to the differences around: a cut is where the difference is above the mean plus two deviations of
its neighbourhood and a floor.  Clips are timed by the header's frame duration.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.llm import shingles, support

#: Units of a frame's side, and samples of a frame.
SIDE = 24
FRAME = SIDE * SIDE
FRAME_US = 40_000
PAD = 255
BINS, AROUND, FLOOR = 32, 8, 0.25

# Code words of the mean's difference: category s has 8 - s ones and a zero (nine bits for s = 0), then s bits of value.
_DIFF = np.arange(-255, 256)
_CAT = np.array([int(abs(d)).bit_length() for d in _DIFF])
_BITS = np.where(_DIFF < 0, _DIFF + (1 << _CAT) - 1, _DIFF)
_PREFIX = ((1 << (8 - _CAT)) - 1) << 1
_CODE = ((_PREFIX << _CAT) | _BITS).astype(np.uint64)
_VALUE = np.zeros(512, np.int16)
_VALUE[_CODE.astype(int)] = _DIFF


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_DQT = _segment(0xDB, bytes([0, 8]) + bytes([1] * 63))
_SOF = _segment(0xC0, struct.pack(">BHHB", 8, SIDE * 8, SIDE * 8, 1) + bytes([1, 0x11, 0]))
_DHT = _segment(0xC4, bytes([0x00]) + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1))) + _segment(0xC4, bytes([0x10]) + bytes([1] + [0] * 15) + bytes([0]))
_SOS = _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
HEAD = b"\xff\xd8" + _DQT + _SOF + _DHT + _SOS
TAIL = b"\xff\xd9"


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """JPEG images of frames [n, FRAME] of 8-bit samples."""
    d = samples.astype(np.int16)
    d[:, 1:] -= samples[:, :-1].astype(np.int16)
    d[:, 0] -= 128
    code = (_CODE[d + 255] << np.uint64(1)).reshape(len(d), -1, 4)  # ten bits each: four samples are five bytes
    word = code[:, :, 0] << np.uint64(30) | code[:, :, 1] << np.uint64(20) | code[:, :, 2] << np.uint64(10) | code[:, :, 3]
    raw = word.astype(">u8").view(np.uint8).reshape(len(d), -1, 8)[:, :, 3:]
    flat = np.ascontiguousarray(raw).reshape(len(d), -1)
    return [HEAD + row.tobytes().replace(b"\xff", b"\xff\x00") + TAIL for row in flat]


def decode_frames(images: list[bytes]) -> np.ndarray:
    """Frames [n, FRAME] of samples; images of this module's own layout are decoded together, others one by one."""
    out = np.empty((len(images), FRAME), np.uint8)
    fast = [i for i, x in enumerate(images) if x.startswith(HEAD) and x.endswith(TAIL)]
    scans = [images[i][len(HEAD) : -len(TAIL)].replace(b"\xff\x00", b"\xff") for i in fast]
    size = FRAME * 10 // 8
    good = [k for k, s in enumerate(scans) if len(s) == size]
    if good:
        raw = np.frombuffer(b"".join([scans[k] for k in good]), np.uint8).reshape(-1, FRAME // 4, 5).astype(np.uint64)
        word = raw[:, :, 0] << np.uint64(32) | raw[:, :, 1] << np.uint64(24) | raw[:, :, 2] << np.uint64(16) | raw[:, :, 3] << np.uint64(8) | raw[:, :, 4]
        code = np.stack([word >> np.uint64(31), word >> np.uint64(21), word >> np.uint64(11), word >> np.uint64(1)], axis=2) & np.uint64(511)
        out[[fast[k] for k in good]] = np.cumsum(_VALUE[code.astype(np.intp)].reshape(len(good), FRAME), axis=1, dtype=np.int16) + 128
    for i in sorted(set(range(len(images))) - {fast[k] for k in good}):
        pixels = decode_jpeg(images[i])
        out[i] = pixels[::8, ::8][:SIDE, :SIDE].ravel()
    return out


_ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
_COS = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for u in range(8)] for x in range(8)])


def decode_jpeg(image: bytes) -> np.ndarray:
    """The first component (luminance) of a baseline JPEG image, as [height, width] of 8-bit samples."""
    quant: dict[int, np.ndarray] = {}
    huff: dict[int, dict[tuple[int, int], int]] = {}
    parts: list[tuple[int, int, int, int]] = []
    height = width = every = 0
    at = 2
    if image[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG image")
    while True:
        while image[at] == 0xFF and image[at + 1] == 0xFF:
            at += 1
        marker, size = image[at + 1], struct.unpack(">H", image[at + 2 : at + 4])[0]
        body, at = image[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * (wide + 1)], ">u2" if wide else "u1").astype(int)
                body = body[1 + 64 * (wide + 1) :]
        elif marker == 0xC4:
            while body:
                table, code, k = {}, 0, 17
                for n, many in enumerate(body[1:17], 1):
                    for _ in range(many):
                        table[n, code] = body[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                huff[body[0]], body = table, body[k:]
        elif marker == 0xC0:
            height, width = struct.unpack(">HH", body[1:5])
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif 0xC1 <= marker <= 0xCF:
            raise ValueError("only baseline images are decoded")
        elif marker == 0xDD:
            every = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            tables = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
            break
    hmax, vmax = max(p[1] for p in parts), max(p[2] for p in parts)
    across, down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    plane = np.zeros((down * 8 * parts[0][2], across * 8 * parts[0][1]))
    bits, pos = 0, 0  # the bit buffer and its fill

    def take(n: int) -> int:
        nonlocal bits, pos, at
        while pos < n:
            byte = image[at] if at < len(image) else 0
            if byte == 0xFF:
                if at + 1 < len(image) and image[at + 1] == 0:
                    at += 1
                else:
                    byte, at = 0, at - 1  # a marker: zeros follow
            bits, pos, at = bits << 8 | byte, pos + 8, at + 1
        pos -= n
        value = bits >> pos & ((1 << n) - 1)
        bits &= (1 << pos) - 1
        return value

    def symbol(table: dict) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | take(1)
            if (n, code) in table:
                return table[n, code]
        raise ValueError("a damaged image")

    def extend(n: int) -> int:
        v = take(n) if n else 0
        return v if not n or v >> (n - 1) else v - (1 << n) + 1

    last = [0] * len(parts)
    for mcu in range(across * down):
        if every and mcu and mcu % every == 0:
            bits = pos = 0
            at = image.index(b"\xff", at) + 2
            last = [0] * len(parts)
        for c, (ident, h, v, q) in enumerate(parts):
            dc, ac = tables[ident]
            for by in range(v):
                for bx in range(h):
                    coef = np.zeros(64)
                    last[c] += extend(symbol(huff[dc]))
                    coef[0], k = last[c], 1
                    while k < 64:
                        s = symbol(huff[0x10 | ac])
                        if s == 0:
                            break
                        k += s >> 4
                        if s & 15 and k < 64:
                            coef[k] = extend(s & 15)
                        k += 1
                    if c == 0:
                        block = np.zeros(64)
                        block[_ZIGZAG] = coef * quant[q]
                        y, x = (mcu // across * v + by) * 8, (mcu % across * h + bx) * 8
                        plane[y : y + 8, x : x + 8] = _COS @ block.reshape(8, 8) @ _COS.T
    return np.clip(np.rint(plane + 128), 0, 255).astype(np.uint8)[: -(-height * parts[0][2] // vmax), : -(-width * parts[0][1] // hmax)]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(images: list[bytes], frame_us: int = FRAME_US, side: int = SIDE * 8) -> bytes:
    """A RIFF AVI file of motion-JPEG images with an index."""
    most = max(map(len, images), default=0)
    avih = struct.pack("<14I", frame_us, 0, 0, 0x10, len(images), 0, 1, most, side, side, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, frame_us, 1_000_000, 0, len(images), most, 0xFFFFFFFF, 0, 0, 0, side, side)
    strf = struct.pack("<IiiHH4sIiiII", 40, side, side, 1, 24, b"MJPG", side * side * 3, 0, 0, 0, 0)
    hdrl = b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    movi, index, at = [b"movi"], [], 4
    for x in images:
        movi.append(_chunk(b"00dc", x))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(x)))
        at += len(movi[-1])
    body = b"AVI " + _chunk(b"LIST", hdrl) + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


@dataclass
class Avi:
    frame_us: int
    images: list[bytes]


def read_avi(data: bytes) -> Avi:
    """Frame duration and images of an AVI file, by its index where it has one, else in the order of its chunks."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    frame_us, movi, index, loose = FRAME_US, 0, [], []

    def walk(a: int, b: int, within: bytes) -> None:
        nonlocal frame_us, movi
        while a + 8 <= b:
            name, size = data[a : a + 4], struct.unpack("<I", data[a + 4 : a + 8])[0]
            if name == b"LIST":
                kind = data[a + 8 : a + 12]
                if kind == b"movi":
                    movi = a + 8
                walk(a + 12, min(b, a + 8 + size), kind)
            elif name == b"avih":
                frame_us = struct.unpack("<I", data[a + 8 : a + 12])[0]
            elif name == b"idx1":
                index.extend(struct.iter_unpack("<4sIII", data[a + 8 : a + 8 + size - size % 16]))
            elif within == b"movi" and name[2:] in (b"dc", b"db"):
                loose.append((a + 8, size))
            a += 8 + size + (size & 1)

    walk(12, min(len(data), 8 + struct.unpack("<I", data[4:8])[0]), b"")
    found = [x for x in index if x[0][2:] in (b"dc", b"db")]
    if found and loose:
        base = movi if data[movi + found[0][2] : movi + found[0][2] + 4] == found[0][0] else 0  # offsets from 'movi', or from the file's start
        spans = [(base + x[2] + 8, x[3]) for x in found]
    else:
        spans = loose
    return Avi(frame_us, [data[a : a + n] for a, n in spans])


def histograms(frames: np.ndarray) -> np.ndarray:
    n = len(frames)
    at = (np.arange(n)[:, None] * BINS + (frames >> 3)).ravel()
    return np.bincount(at, minlength=n * BINS).reshape(n, BINS) / max(1, frames.shape[1])


def shots(hist: np.ndarray, frame_us: int) -> list[tuple[int, int, int, int, float]]:
    """Clips (first frame, frames, start ms, end ms, difference at its cut) of a video's histograms."""
    n = len(hist)
    diff = np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2
    cuts = [0]
    if len(diff):
        c1, c2 = np.concatenate([[0], np.cumsum(diff)]), np.concatenate([[0], np.cumsum(diff * diff)])
        a, b = np.maximum(0, np.arange(len(diff)) - AROUND), np.minimum(len(diff), np.arange(len(diff)) + AROUND + 1)
        mean = (c1[b] - c1[a]) / (b - a)
        sd = np.sqrt(np.maximum(0, (c2[b] - c2[a]) / (b - a) - mean * mean))
        cuts += (np.flatnonzero((diff > mean + 2 * sd) & (diff > FLOOR)) + 1).tolist()
    ends = [*cuts[1:], n]
    return [(a, b - a, a * frame_us // 1000, b * frame_us // 1000, round(float(diff[a - 1]), 4) if a else 0.0) for a, b in zip(cuts, ends, strict=True)]


def store(column: pa.Array) -> pa.Array:
    """The AVI file of each text: UTF-8 bytes, padded with 255 to whole frames (at least one)."""
    data, off = shingles.text_bytes(column)
    out: list[bytes] = []
    for a, b in shingles.slices(off):
        size = np.diff(off[a : b + 1])
        count = np.maximum(1, -(-size // FRAME))
        first = np.concatenate([[0], np.cumsum(count)])
        padded = np.full(first[-1] * FRAME, PAD, np.uint8)
        for k in range(b - a):
            padded[first[k] * FRAME : first[k] * FRAME + size[k]] = data[off[a + k] : off[a + k + 1]]
        images = encode_frames(padded.reshape(-1, FRAME))
        out += [write_avi(images[first[k] : first[k + 1]]) for k in range(b - a)]
    return pa.array(out, pa.binary())


def decode(files: list[bytes]) -> list[tuple[bytes, list[tuple[int, int, int, int, float]]]]:
    """(payload, clips) of each file."""
    read = [read_avi(x) for x in files]
    frames = decode_frames([x for r in read for x in r.images])
    hist = histograms(frames)
    out, a = [], 0
    for r in read:
        b = a + len(r.images)
        out.append((frames[a:b].tobytes(), shots(hist[a:b], r.frame_us)))
        a = b
    return out


def with_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (an AVI file) of every row of ``docs`` (doc_id, text; other columns are ignored). A null text is empty."""
    support.bounded_batches(docs.sparkSession)

    def task(batches):
        for batch in batches:
            data, off = shingles.text_bytes(batch.column(1))
            for a, b in shingles.slices(off):
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(np.diff(off[a : b + 1])), store(batch.column(1).slice(a, b - a))], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(task, "doc_id bigint, n_bytes bigint, media binary")


def _by_size(files: list[bytes], most: int = 4 << 20):
    a, size = 0, 0
    for i, x in enumerate(files):
        if i > a and size + len(x) > most:
            yield a, i
            a, size = i, 0
        size += len(x)
    if a < len(files):
        yield a, len(files)


def clips(media: DataFrame) -> DataFrame:
    """Timed clip rows (doc_id, clip, first_frame, frames, start_ms, end_ms, difference) of a media column."""

    def task(batches):
        for batch in batches:
            ids, files = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in _by_size(files):
                rows = [(ids[a + k], j, *c) for k, (_, found) in enumerate(decode(files[a:b])) for j, c in enumerate(found)]
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 6 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "clip", "first_frame", "frames", "start_ms", "end_ms", "difference"])

    return media.select("doc_id", "media").mapInArrow(task, "doc_id bigint, clip bigint, first_frame bigint, frames bigint, start_ms bigint, end_ms bigint, difference double")


def digests(media: DataFrame) -> DataFrame:
    """What the stored files hold, read back: payload and media sizes and hashes, and the clips as ``feature``.

    Equal texts give equal values; rows that repeat stay.  An empty table gives an empty result.
    """

    def task(batches):
        for batch in batches:
            files = batch.column(2).to_pylist()
            for a, b in _by_size(files):
                rows = []
                for x, (payload, found) in zip(files[a:b], decode(files[a:b]), strict=True):
                    feature = f"clips={len(found)};" + ",".join(f"{c[2]}-{c[3]}" for c in found)
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(x), hashlib.sha256(x).hexdigest(), feature))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(task, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every text of documents as an AVI column, read it back, and digest what it holds."""
    return digests(with_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))

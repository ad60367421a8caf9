"""Token-id files: fixed-width bit packing with block offsets.

A file holds the ids of whole documents in ascending order of (doc_id, text).

    magic "TMTOK1\\n\\0"
    payload   blocks of BLOCK_IDS ids, each id in the fewest bits that the vocabulary needs,
              most significant bit first, each block padded to whole bytes
    footer    doc ids (int64), null flags (uint8), first id of each document and the total
              (uint64), byte offset of each block and the end (uint64)
    trailer   width, vocabulary, documents, ids, blocks (five uint64), magic

Any block is read and unpacked alone, so a slice of a file costs its own blocks
only.  Files are written through the file system that the scratch folder names,
under a temporary name and then moved: a repeated task replaces its own file by the same bytes.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.llm import support, tokens

MAGIC = b"TMTOK1\n\0"
#: Ids of a block. A multiple of 8, so that full blocks end on a byte.
BLOCK_IDS = 1 << 16
END_ID = 0
TRAILER = struct.Struct("<5Q8s")


def width_of(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Unsigned ids below 2**width, most significant bit first."""
    if width in (8, 16, 32):
        return ids.astype(f">u{width // 8}").tobytes()
    bits = (ids.astype(np.uint64)[:, None] >> np.arange(width - 1, -1, -1, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel()).tobytes()


def unpack(raw: bytes, n: int, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(raw, f">u{width // 8}", n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * width).reshape(n, width)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out << np.uint64(1) | bits[:, k]
    return out.astype(np.uint32)


class Writer:
    """Appends documents' ids; memory holds one block and the footer (25 bytes a document)."""

    def __init__(self, out, vocabulary: int) -> None:
        self.out, self.vocabulary, self.width = out, vocabulary, width_of(vocabulary)
        self.rest, self.held, self.total = [], 0, 0
        self.docs: list[int] = []
        self.nulls = bytearray()
        self.starts: list[int] = []
        self.offsets = [len(MAGIC)]
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.starts.append(self.total)
        self.total += len(ids)
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK_IDS:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.empty(0, np.uint32)
        stop = len(ids) if last else len(ids) - len(ids) % BLOCK_IDS
        for a in range(0, stop, BLOCK_IDS):
            raw = pack(ids[a : min(a + BLOCK_IDS, stop)], self.width)
            self.out.write(raw)
            self.offsets.append(self.offsets[-1] + len(raw))
        self.rest = [ids[stop:]]
        self.held = len(ids) - stop

    def close(self) -> None:
        self._flush(True)
        for x, kind in ((self.docs, "<i8"), (self.nulls, "u1"), ([*self.starts, self.total], "<u8"), (self.offsets, "<u8")):
            self.out.write(np.asarray(x, kind).tobytes())
        self.out.write(TRAILER.pack(self.width, self.vocabulary, len(self.docs), self.total, len(self.offsets) - 1, MAGIC))


class Reader:
    """Random access to a file written by ``Writer``."""

    def __init__(self, source, size: int) -> None:
        self.source = source
        source.seek(size - TRAILER.size)
        self.width, self.vocabulary, self.documents, self.total, blocks, magic = TRAILER.unpack(source.read(TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        n = self.documents
        foot = n * 9 + (n + 1) * 8 + (blocks + 1) * 8
        source.seek(size - TRAILER.size - foot)
        raw = source.read(foot)
        self.doc_ids = np.frombuffer(raw, "<i8", n)
        self.nulls = np.frombuffer(raw, "u1", n, n * 8).astype(bool)
        self.starts = np.frombuffer(raw, "<u8", n + 1, n * 9).astype(np.int64)
        self.offsets = np.frombuffer(raw, "<u8", blocks + 1, n * 9 + (n + 1) * 8).astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` up to ``stop``: only the blocks that hold them are read."""
        if stop <= start:
            return np.empty(0, np.uint32)
        a, b = start // BLOCK_IDS, (stop - 1) // BLOCK_IDS + 1
        self.source.seek(int(self.offsets[a]))
        raw = self.source.read(int(self.offsets[b] - self.offsets[a]))
        parts = [unpack(raw[int(self.offsets[k] - self.offsets[a]) : int(self.offsets[k + 1] - self.offsets[a])], min(BLOCK_IDS, self.total - k * BLOCK_IDS), self.width) for k in range(a, b)]
        return np.concatenate(parts)[start - a * BLOCK_IDS : stop - a * BLOCK_IDS]

    def documents_from(self, blocks_at_once: int = 16) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start, ids) of every document, reading some blocks at a time."""
        held, first, upto = np.empty(0, np.uint32), 0, 0
        for i in range(self.documents):
            a, b = int(self.starts[i]), int(self.starts[i + 1])
            if b > upto:
                more = self.ids(upto, min(self.total, max(b, upto + blocks_at_once * BLOCK_IDS)))
                held, first = np.concatenate([held[a - first :], more]), a
                upto += len(more)
            yield None if self.nulls[i] else int(self.doc_ids[i]), a, held[a - first : b - first]


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Encode every whole text of ``docs`` (doc_id, text; other columns are ignored), append ``end_id``, and write token files.

    Rows are range-partitioned by doc_id (nulls first; equal ids by the text's hash), so
    file names in ascending order hold the ids in ascending doc_id order.
    A null text is empty.  An empty table gives no files.
    Returns the manifest (file, path, n_docs, n_ids): one row per file, written already.
    """
    spark = docs.sparkSession
    support.bounded_batches(spark)
    spec = spark.sparkContext.broadcast(tokens.tokenizer_json(tokenizer_path))

    def task(batches):
        from pyspark import TaskContext

        enc = tokens.encoder(spec.value)
        part = TaskContext.get().partitionId()
        system, root = fs.FileSystem.from_uri(folder)
        writer = None
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, chunk in tokens.text_chunks(texts):
                for k, raw in enumerate(enc.encode(chunk)):
                    if writer is None:
                        system.create_dir(root, recursive=True)
                        path = f"{root}/part-{part:07d}.tok"
                        tmp = f"{root}/.{uuid.uuid4().hex}"
                        out = system.open_output_stream(tmp)
                        writer = Writer(out, enc.vocabulary)
                    writer.add(ids[first + k], np.append(np.frombuffer(raw, "<u4"), np.uint32(end_id)))
        if writer is not None:
            writer.close()
            out.close()
            system.move(tmp, path)
            yield pa.RecordBatch.from_pydict({"file": pa.array([part], pa.int32()), "path": [f"{folder}/{os.path.basename(path)}"], "n_docs": pa.array([len(writer.docs)], pa.int64()), "n_ids": pa.array([writer.total], pa.int64())})

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    return support.materialise(ordered.mapInArrow(task, "file int, path string, n_docs bigint, n_ids bigint"), "token-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """Read token files back: (doc_id, start, n_tokens, ids_crc32) per document.

    ``start`` counts the ids of all documents before it, over all files.
    """

    def task(batches):
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                system, name = fs.FileSystem.from_uri(path)
                rows: list[tuple] = []
                with system.open_input_file(name) as source:
                    reader = Reader(source, source.size())
                    for doc, start, ids in reader.documents_from():
                        rows.append((doc, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        if len(rows) == 20_000:
                            yield _rows(rows)
                            rows = []
                if rows:
                    yield _rows(rows)

    n = max(1, manifest.count())
    files = _bases(manifest).repartition(n, "file")
    return files.select("path", "base").mapInArrow(task, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _bases(manifest: DataFrame) -> DataFrame:
    """Ids in all files before each: one row per file, so the window holds as many rows as there are files."""
    from pyspark.sql.window import Window

    over = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(over), F.lit(0)))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the token files of all documents and return what they hold."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = support.scratch_path(spark, "tokens")
    return read(write(docs, folder, public_tokenizers.path("byte_bpe_50k.json")))

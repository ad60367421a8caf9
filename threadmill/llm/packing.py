"""Best-fit packing of documents into fixed-length sequences under several capacities.

Documents become pieces of at most ``seq_len`` tokens; pieces are packed by vector
best fit: each piece goes to the open sequence that is feasible in every dimension
(tokens, documents, attention cost = sum of squared lengths) and scores best, by the
smallest weighted residual norm or the largest weighted dot product of demand and residual.
Open sequences with equal residuals are alternatives of one another, so they are kept by their residual vector, in the order
of the tokens left; a search by norm starts at the piece's size and ends where the tokens alone cost more than the best found.
Pieces are packed in descending length within hash groups of about ``GROUP_PIECES`` pieces,
which bounds memory and lets groups run apart; a group leaves at most a few sequences
partly filled (the README has the counts against the bound).
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadmill.llm import support, tokens

#: Pieces that one task packs together, about.
GROUP_PIECES = 20_000


@dataclass(frozen=True)
class Capacity:
    """Limits of a sequence, and what a residual in each dimension weighs when a piece looks for its sequence.

    A sequence of ``tokens`` tokens never holds more documents than tokens, nor costs more than their square: with these defaults the
    tokens alone limit, as fewest sequences need, and the other dimensions choose between sequences about as tight.
    """

    tokens: int = 2048
    documents: int = 2048
    attention: float = 2048.0**2
    #: Weights of the three dimensions, each taken relative to its limit.
    weights: tuple[float, float, float] = (1.0, 0.1, 0.1)
    #: "norm": smallest weighted residual after placing; "dot": largest weighted dot product of demand and residual.
    score: str = "norm"


class _Open:
    """Open sequences by their residual vector: tokens left -> (documents left, attention left) -> numbers."""

    def __init__(self) -> None:
        self.by_room: dict[int, dict[tuple, list[int]]] = {}
        self.rooms: list[int] = []

    def add(self, room: tuple, number: int) -> None:
        if room[0] not in self.by_room:
            self.by_room[room[0]] = {}
            insort(self.rooms, room[0])
        self.by_room[room[0]].setdefault(room[1:], []).append(number)

    def take(self, room: tuple) -> int:
        states = self.by_room[room[0]]
        numbers = states[room[1:]]
        number = numbers.pop()
        if not numbers:
            del states[room[1:]]
            if not states:
                del self.by_room[room[0]]
                del self.rooms[bisect_left(self.rooms, room[0])]
        return number

    def best(self, need: tuple, weights: list[float], norm: bool) -> tuple | None:
        """The residual vector of the best feasible sequence; None where none is feasible."""
        best, least = None, 0.0
        size, one, cost = need
        wt, wd, wa = weights
        for i in range(bisect_left(self.rooms, size), len(self.rooms)):
            r = self.rooms[i]
            tight = wt * (r - size) ** 2
            if norm and best is not None and tight >= least:
                break
            for d, a in self.by_room[r]:
                if d < one or a < cost:
                    continue
                value = tight + wd * (d - one) ** 2 + wa * (a - cost) ** 2 if norm else -(wt * r * size + wd * d + wa * a * cost)
                if best is None or value < least:
                    best, least = (r, d, a), value
        return best


def pack_lengths(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece; lengths are in descending order, each at least 1 and at most the token limit."""
    limits = (capacity.tokens, capacity.documents, capacity.attention)
    weights = [w / m**2 for w, m in zip(capacity.weights, limits, strict=True)]
    n = len(lengths)
    seq, off = np.empty(n, np.int64), np.empty(n, np.int64)
    open_, made = _Open(), 0
    least = int(lengths[-1]) if n else 0
    for i, size in enumerate(lengths.tolist()):
        need = (size, 1, size * size)
        room = open_.best(need, weights, capacity.score == "norm")
        if room is None:
            if any(x > m for x, m in zip(need, limits, strict=True)):
                raise ValueError("a piece exceeds a capacity on its own")
            room, number, made = limits, made, made + 1
        else:
            number = open_.take(room)
        seq[i], off[i] = number, capacity.tokens - room[0]
        left = (room[0] - size, room[1] - 1, room[2] - size * size)
        if left[0] >= least and left[1] >= 1 and left[2] >= least * least:  # something may still fit
            open_.add(left, number)
    return seq, off


def pieces(docs: DataFrame, tokenizer_path: str, seq_len: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece of each row of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32, and ids if asked for.

    A null text is empty and has the end id alone.  Equal rows give equal pieces.
    """
    spark = docs.sparkSession
    support.bounded_batches(spark)
    spec = spark.sparkContext.broadcast(tokens.tokenizer_json(tokenizer_path))
    end = np.uint32(end_id)

    def task(batches):
        enc = tokens.encoder(spec.value)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for first, chunk in tokens.text_chunks(texts):
                rows: list[tuple] = []
                for k, raw in enumerate(enc.encode(chunk)):
                    raw += end.astype("<u4").tobytes()
                    n = len(raw) // 4
                    for p, a in enumerate(range(0, n, seq_len)):
                        part = raw[a * 4 : (a + seq_len) * 4]
                        rows.append((first + k, p, a, len(part) // 4, zlib.crc32(part), part))
                cols = list(zip(*rows, strict=True))
                data = [ids.take(pa.array(cols[0])), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    data.append(pa.array(cols[5], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(data, names)

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(task, schema)


def pack(parts: DataFrame, capacity: Capacity = Capacity(), group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``parts`` (at least doc_id, piece, length, ids_crc32) with sequence_id and offset.

    Groups come from a hash of the row and its place in the written table, so rows that repeat
    spread over groups, and a repeated task finds the same rows.  An empty table gives an empty result.
    """
    parts = support.materialise(parts, "pieces")
    n = parts.count()
    groups = max(1, round(n / group_pieces))
    names = parts.columns
    grouped = parts.withColumn("__group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))

    def pack_group(pdf: pd.DataFrame) -> pd.DataFrame:
        group = int(pdf["__group"].iloc[0])
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        seq, off = pack_lengths(pdf["length"].to_numpy(), capacity)
        return pdf[names].assign(sequence_id=(group << 32) + seq, offset=off)

    schema = T.StructType([*parts.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return grouped.groupBy("__group").applyInPandas(pack_group, schema)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 2048 tokens."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(pieces(docs, public_tokenizers.path("word_bpe_49k.json")))

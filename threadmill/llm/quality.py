"""Quality scores by Bradley-Terry ranking.

Features describe the whole text: how often its character n-grams (two to four bytes) and its words and word pairs
occur, hashed to ``CHAR_BINS`` and ``WORD_BINS`` bins, and counts of characters, words, lines, repetition, and the worst stretch of
``STRETCH`` words.  A document's worth is a linear function of them, and P(a is preferred to b) =
1 / (1 + exp(worth(b) - worth(a))); it is fitted by logistic loss on feature differences
of preference pairs (a document labelled good over one labelled bad).  The differences are never written out: a pair
adds to the gradient of its two documents.  The cut is a
quantile of the worths: as many of the sample fall below as are labelled bad.  The score maps worth to 0..1
so that the cut has score ``CUT_SCORE``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadmill.llm import shingles, support

#: Labelled rows that the model is fitted on at most (those with the smallest hash of their id).
MAX_LABELLED = 20_000
#: Preference pairs drawn from them.
PAIRS = 200_000
STRETCH = 40
CUT_SCORE = 0.3
CHAR_BINS = WORD_BINS = 256
#: Ridge of the counts, and of the hashed bins, which are many and say little each.
RIDGE, BIN_RIDGE = 1e-3, 2e-2

_KINDS = np.zeros((256, 8), bool)
_KINDS[65:91, 0] = True  # capital letters
_KINDS[97:123, 1] = True  # small letters
_KINDS[128:, 1] = True
_KINDS[48:58, 2] = True  # digits
_KINDS[[ord(c) for c in "#$%&*@^~<>{}[]\\=_+"], 3] = True
_KINDS[ord("!"), 4] = True
_KINDS[ord("|"), 5] = True
_KINDS[[ord(c) for c in ".,;:?'\"()-/"], 6] = True
_KINDS[ord("\n"), 7] = True


def binned(data: np.ndarray, offsets: np.ndarray, text: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Square roots of the shares of each text's character and word n-grams by bin; ``text`` and ``h`` are its words and their hashes."""
    n = len(offsets) - 1
    chars, words = np.zeros(n * CHAR_BINS), np.zeros(n * WORD_BINS)
    of = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    raw = data.astype(np.uint32)
    roll = raw
    for k in range(2, 5):
        if len(data) < k:
            break
        roll = roll[:-1] * np.uint32(0x01000193) ^ raw[k - 1 :]
        at = (roll * np.uint32(0x9E3779B1) >> np.uint32(16)) % np.uint32(CHAR_BINS)
        inside = of[k - 1 :] == of[: len(roll)]
        chars += np.bincount((of[: len(roll)].astype(np.int64) * CHAR_BINS + at)[inside], minlength=n * CHAR_BINS)
    words += np.bincount(text * WORD_BINS + (h % np.uint64(WORD_BINS)).astype(np.int64), minlength=n * WORD_BINS)
    if len(h) > 1:
        pair = shingles.mix(h[:-1] * np.uint64(0x9FB21C651E98DF25) + h[1:])
        inside = text[1:] == text[:-1]
        words += np.bincount((text[1:] * WORD_BINS + (pair % np.uint64(WORD_BINS)).astype(np.int64))[inside], minlength=n * WORD_BINS)
    parts = []
    for counts, bins in ((chars, CHAR_BINS), (words, WORD_BINS)):
        counts = counts.reshape(n, bins)
        parts.append(np.sqrt(counts / np.maximum(1, counts.sum(axis=1, keepdims=True))))
    return np.concatenate(parts, axis=1)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of features per text (float32): the bins, then the counts; a text without words has a row of its own kind (zeros and a flag)."""
    n = len(offsets) - 1
    start, end, text, h = shingles.words(data, offsets)
    count = np.bincount(text, minlength=n).astype(float)
    per = lambda x: np.bincount(text, x, minlength=n) / np.maximum(count, 1)
    by_word = []
    for k in range(7):
        c = np.concatenate([[0], np.cumsum(_KINDS[data, k], dtype=np.int32)])
        by_word.append((c[end] - c[start]).astype(float))
    upper, lower, digit, symbol, bang, bar, mark = by_word
    length = (end - start).astype(float)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    shout = (upper > 1) & (lower == 0)
    first = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
    order = np.lexsort((h, text))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])
    distinct = np.bincount(text[order], fresh, minlength=n)
    lines = np.bincount(np.searchsorted(offsets, np.flatnonzero(data == 10), "right") - 1, minlength=n)[:n] + 1.0
    letters = np.bincount(text, upper + lower, minlength=n)
    cols = [
        np.log1p(count), count == 0, np.bincount(text, upper, minlength=n) / np.maximum(letters, 1), per(bang), per(symbol > 0), per(symbol), per(bar), per(digit > 0),
        per(again), distinct / np.maximum(count, 1), np.log1p(count) * distinct / np.maximum(count, 1), per(length) / 10, per(shout), per(mark > 0), lines / np.maximum(count, 1),
        per(length > 20),
    ]
    if len(h):  # the worst stretch
        stretch = (np.arange(len(h)) - first[text]) // STRETCH
        base = np.concatenate([[0], np.cumsum(np.ceil(count / STRETCH))]).astype(np.int64)
        at = base[text] + stretch
        size = np.bincount(at, minlength=base[-1]).astype(float)
        some = count > 0
        for x in (shout, symbol > 0, bar > 0, again, bang > 0, digit > 0):
            share = np.bincount(at, x, minlength=base[-1]) / np.maximum(size, STRETCH / 2)
            worst = np.zeros(n)
            worst[some] = np.maximum.reduceat(share, base[:-1][some])
            cols.append(worst)
    else:
        cols += [np.zeros(n)] * 6
    x = np.stack([np.asarray(c, float) for c in cols], axis=1)
    return np.concatenate([binned(data, offsets, text, h), x, np.sqrt(np.abs(x[:, 2:9])), np.sqrt(x[:, 16:22])], axis=1).astype(np.float32)


def pair_loss(w: np.ndarray, z: np.ndarray, i: np.ndarray, j: np.ndarray, ridge: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean logistic loss of the pairs "row i of z over row j" with half the ridge, and its gradient."""
    worth = z @ w
    lead = worth[i] - worth[j]
    loss = float(np.logaddexp(0, -lead).mean() + 0.5 * (ridge * w * w).sum())
    p = 1 / (1 + np.exp(np.clip(lead, -30, 30))) / len(i)
    return loss, z.T @ (np.bincount(j, p, len(z)) - np.bincount(i, p, len(z))) + ridge * w


def minimise(f, w: np.ndarray, rounds: int = 200, memory: int = 12, tolerance: float = 1e-6) -> np.ndarray:
    """A minimum of the smooth convex ``f`` (value and gradient) by limited-memory quasi-Newton steps."""
    value, grad = f(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        step, shares = -grad, []
        for s, y in reversed(past):
            a = (s @ step) / (s @ y)
            step = step - a * y
            shares.append(a)
        if past:
            s, y = past[-1]
            step = step * ((s @ y) / (y @ y))
        for (s, y), a in zip(past, reversed(shares), strict=True):
            step = step + (a - (y @ step) / (s @ y)) * s
        slope, size = grad @ step, 1.0 if past else 1.0 / max(1.0, float(np.abs(grad).sum()))
        while True:
            nxt = w + size * step
            new_value, new_grad = f(nxt)
            if new_value <= value + 1e-4 * size * slope or size < 1e-10:
                break
            size /= 2
        s, y = nxt - w, new_grad - grad
        if s @ y > 1e-12:
            past = [*past[1 - memory :], (s, y)]
        gain, w, value, grad = value - new_value, nxt, new_value, new_grad
        if gain < tolerance * max(1e-3, abs(value)) * 1e-2:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 7) -> dict:
    """Worths and cut from features and labels 0/1. With one class only, every score is that class's share."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return {"constant": float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))}
    mean, sd = x.mean(axis=0, dtype=np.float64), x.std(axis=0, dtype=np.float64)
    sd[sd < 1e-9] = 1.0
    z = np.clip((x - mean) / sd, -8, 8)
    rng = np.random.default_rng(seed)
    i, j = rng.choice(good, pairs), rng.choice(bad, pairs)
    bins = min(CHAR_BINS + WORD_BINS, max(0, x.shape[1] - 1))
    ridge = np.where(np.arange(x.shape[1]) < bins, BIN_RIDGE, RIDGE)
    w = minimise(lambda w: pair_loss(w, z, i, j, ridge), np.zeros(x.shape[1]))
    worth = z @ w
    low, high = np.sort(worth[bad]), np.sort(worth[good])
    share = len(bad) / len(y)
    cut = float(np.quantile(worth, share))
    below = worth[worth < cut]
    scale = 4.0 / max(1e-6, float(np.median(high)) - float(np.median(low)))
    return {"mean": mean, "sd": sd, "w": w, "cut": cut, "scale": scale, "share": share, "below": len(below)}


def score(model: dict, x: np.ndarray) -> np.ndarray:
    """Scores of rows of features; each row is summed alone, so equal rows have equal scores in any batch."""
    if "constant" in model:
        return np.full(len(x), model["constant"])
    worth = (np.clip((x - model["mean"]) / model["sd"], -8, 8) * model["w"]).sum(axis=1)
    at = np.log(CUT_SCORE / (1 - CUT_SCORE))
    return 1 / (1 + np.exp(-np.clip(model["scale"] * (worth - model["cut"]) + at, -30, 30)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """text and label of at most ``most`` training rows: labelled, not held out, the smallest hashes of doc_id first.

    An id with several labels has the largest of them.

    At most ``most`` ids are broadcast, whatever the size of the tables.
    """
    train = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~support.held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).alias("label"))
    ids = train.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "label", "text")


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> dict:
    """The model; labels of rows whose crc32(doc_id) leaves no remainder modulo 5 are never read."""
    support.bounded_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, "quality", most)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = shingles.text_bytes(batch.column(2))
            for a, b in shingles.slices(off):
                x = features(data[off[a] : off[b]], off[a : b + 1] - off[a])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "label", "x"])

    rows = sample.select("doc_id", F.col("label").cast("int"), "text").mapInArrow(task, "doc_id bigint, label int, x binary").toArrow()
    y = rows["label"].to_numpy()
    if not len(y):
        return fit(np.empty((0, 1)), y)
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float32).reshape(len(y), -1)
    # rows of one id and label stand in the order of their features, so that reruns agree
    order = np.lexsort((x[:, 0], x[:, -1], y, rows["doc_id"].to_numpy()))
    return fit(x[order], y[order])


def scorer(spark: SparkSession, model: dict):
    """An Arrow function of the text column: the score of each whole text."""
    support.bounded_batches(spark)

    @F.arrow_udf(T.DoubleType())
    def quality_score(text: pa.Array) -> pa.Array:
        data, off = shingles.text_bytes(text)
        out = [score(model, features(data[off[a] : off[b]], off[a : b + 1] - off[a])) for a, b in shingles.slices(off)]
        return pa.array(np.concatenate(out) if out else np.empty(0), pa.float64())

    return quality_score


def scored(docs: DataFrame, labels: DataFrame, threshold: float = CUT_SCORE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text; other columns are ignored).

    A null text is empty; an empty text has a score like any other.  Rows that repeat get equal scores.
    A null doc_id counts as '' for the hold-out and takes no label.  An empty table gives an empty result.
    """
    f = scorer(docs.sparkSession, train(docs, labels))
    out = docs.select("doc_id", support.held_out(F.col("doc_id")).alias("held_out"), f("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = CUT_SCORE) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``, all columns kept."""
    f = scorer(docs.sparkSession, train(docs, labels))
    return docs.where(f("text") >= threshold)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))

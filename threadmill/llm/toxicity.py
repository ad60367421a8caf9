"""Toxicity by class-conditional Kneser-Ney models.

A word is a run of letters, lower-cased, and is generated in two units: its head (the first
``HEAD`` bytes) and the rest given the head.  Each class has an interpolated Kneser-Ney
bigram model of these units: P(rest | head) discounts the class's own counts and backs off to the
continuation distribution of rests (how many heads a rest follows), and P(head) to that of heads (how many words one begins);
both backoff distributions are shared by the classes (types pooled over both), so an expression that neither class has
seen costs both the same, and one with a known head is told apart by its head.

A text's evidence is the difference of the two log-likelihoods, normalised by
length: over the whole text, and over its 1, 2, 3, 4 and 6 most telling words, because a long text may hold a
few.  A logistic map of these to 0..1 is fitted on models of the other half of the labelled rows.

Counts cover all labelled training rows and every word.  They are pooled by word before they leave a task; the
type counts, backoffs and parameters of all words and heads are computed in Spark and stay in tables.  Tasks get
those of the ``HOT`` most frequent words and heads; any other word of a text is looked up by a join, so what is
broadcast is bounded and no word is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadmill.llm import quality, shingles, support

HEAD = 4
DISCOUNT = 0.75
#: Words, and heads, whose parameters tasks hold (20 bytes each); the others are joined.
HOT = 1 << 17
#: Labelled rows that the logistic map is fitted on at most; the counts use them all.
MAX_CALIBRATION = 20_000
TOP = (1, 2, 3, 4, 6)
THRESHOLD = 0.5

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def rest_hashes(spaced: np.ndarray, off: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of what follows each word's head; 0 where nothing does."""
    out = np.zeros(len(start), np.uint64)
    longer = np.flatnonzero(end - start > HEAD)
    if len(longer):
        tails = spaced.copy()
        for k in range(HEAD):
            at = start + k
            tails[at[at < end]] = 32
        out[longer] = shingles.words(tails, off)[3]
    return out


def units(column: pa.Array, a: int, b: int, rests: bool = False) -> tuple[np.ndarray, ...]:
    """(text number, head hash, word hash, and the rest's hash if asked for) of every word of texts a to b of a string column."""
    texts = [(x or "").lower() for x in column.slice(a, b - a).to_pylist()]
    data, off = shingles.text_bytes(pa.array(texts, pa.large_string()))
    n = len(data)
    spaced = (np.where(_LETTER[data], data, 32) if n else data).astype(np.uint8)
    start, end, text, word = shingles.words(spaced, off)
    head = np.zeros(len(start), np.uint64)
    for k in range(HEAD):
        at = start + k
        byte = np.where(at < end, spaced[np.minimum(at, n - 1)] if n else 0, 0).astype(np.uint64)
        head = head * np.uint64(257) + byte
    found = text, shingles.mix(head), word
    return (*found, rest_hashes(spaced, off, start, end)) if rests else found


def count_words(sample: DataFrame) -> DataFrame:
    """word, head, rest, n0 to n3: counts by kind = label * 2 + half, pooled over ``sample`` (doc_id, label, text)."""
    support.bounded_batches(sample.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            kind = batch.column(1).to_numpy() * 2 + (shingles.mix(ids.astype(np.int64).astype(np.uint64)) & np.uint64(1)).astype(int)
            _, off = shingles.text_bytes(batch.column(2))
            for a, b in shingles.slices(off):
                text, head, word, rest = units(batch.column(2), a, b, rests=True)
                held.append((word, head, rest, kind[a:b][text]))
                size += len(word)
                if size > 1_500_000:
                    yield _pooled(held)
                    held, size = [], 0
        if size:
            yield _pooled(held)

    parts = sample.select("doc_id", F.col("label").cast("int"), "text").mapInArrow(task, "word bigint, head bigint, rest bigint, kind int, n bigint")
    return parts.groupBy("word").agg(F.first("head").alias("head"), F.first("rest").alias("rest"), *[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(4)])


def _pooled(held: list[tuple]) -> pa.RecordBatch:
    word, head, rest, kind = (np.concatenate(x) for x in zip(*held, strict=True))
    key = (word & ~np.uint64(3)) | kind.astype(np.uint64)
    _, at, n = np.unique(key, return_index=True, return_counts=True)
    columns = [(word[at] & ~np.uint64(3)).view(np.int64), head[at].view(np.int64), rest[at].view(np.int64)]
    return pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), pa.array(kind[at], pa.int32()), pa.array(n, pa.int64())], ["word", "head", "rest", "kind", "n"])


#: Kinds of the ordinary and of the toxic counts that a model reads: all rows, the rows of half 0, those of half 1.
MODELS = (((0, 1), (2, 3)), ((0,), (2,)), ((1,), (3,)))


def parameters(counts: DataFrame) -> tuple[DataFrame, DataFrame, list[float]]:
    """(word, seen, l0 to l2), (head, seen, r0 to r2) and the value of a new head, by model: log-likelihood differences, toxic minus ordinary.

    l: of a word, null where the model hasn't seen it; r: of a new rest of a known head, null where the head is new.
    """
    d = F.lit(DISCOUNT)
    own = lambda m, c: sum((F.col(f"n{k}") for k in MODELS[m][c]), F.lit(0))
    any_ = lambda x: F.sum((x > 0).cast("bigint"))
    aggs = []
    for m in range(3):
        aggs += [x for c in (0, 1) for x in (F.sum(own(m, c)).alias(f"h{m}{c}"), any_(own(m, c)).alias(f"k{m}{c}"))]
        aggs.append(any_(own(m, 0) + own(m, 1)).alias(f"kinds{m}"))
    heads = support.materialise(counts.groupBy("head").agg(F.sum(sum((F.col(f"n{k}") for k in range(4)), F.lit(0))).alias("seen"), *aggs), "head-counts")
    sums = []
    for m in range(3):
        sums += [F.sum(f"kinds{m}").alias(f"words{m}"), any_(F.col(f"kinds{m}")).alias(f"heads{m}")]
        sums += [x for c in (0, 1) for x in (F.sum(f"h{m}{c}").alias(f"total{m}{c}"), any_(F.col(f"h{m}{c}")).alias(f"live{m}{c}"))]
    g = {k: float(v or 0) for k, v in heads.agg(*sums).first().asDict().items()}
    at_least_one = lambda name: max(1.0, g[name])
    new, cols, rest = [], [], []
    for m in range(3):
        base = (F.col(f"kinds{m}") + 1) / (at_least_one(f"words{m}") + g[f"heads{m}"] + 1)  # shared: heads by the distinct words they begin
        left = [DISCOUNT * at_least_one(f"live{m}{c}") for c in (0, 1)]
        all_ = [at_least_one(f"total{m}{c}") + DISCOUNT for c in (0, 1)]
        p_head = [(F.greatest(F.col(f"h{m}{c}") - d, F.lit(0.0)) + left[c] * base) / all_[c] for c in (0, 1)]
        # what a class leaves to the shared backoff, by head
        back = [F.when(F.col(f"h{m}{c}") > 0, F.least(d * F.greatest(F.col(f"k{m}{c}"), F.lit(1)) / F.col(f"h{m}{c}"), F.lit(1.0))).otherwise(1.0) for c in (0, 1)]
        new.append(float(np.log(left[1] / all_[1]) - np.log(left[0] / all_[0])))
        cols += [(F.log(p_head[1]) - F.log(p_head[0])).alias(f"head{m}"), back[0].alias(f"back{m}0"), back[1].alias(f"back{m}1")]
        some = F.log(back[1]) - F.log(back[0]) + F.log(p_head[1]) - F.log(p_head[0])
        rest.append(F.when(F.col(f"kinds{m}") >= 2, some).when(F.col(f"kinds{m}") == 1, 0.5 * some).cast("float").alias(f"r{m}"))
    by_head = support.materialise(heads.select("head", "seen", *rest), "head-parameters")
    # how many heads each rest follows, over both classes
    follows = counts.groupBy("rest").agg(*[any_(own(m, 0) + own(m, 1)).alias(f"follows{m}") for m in range(3)])
    joined = support.hot_join(counts, follows, "rest", "inner").join(heads.select("head", *[f"h{m}{c}" for m in range(3) for c in (0, 1)], *[f"kinds{m}" for m in range(3)], *cols), "head")
    llr = []
    for m in range(3):
        pooled = own(m, 0) + own(m, 1)
        p_back = F.col(f"follows{m}") / at_least_one(f"words{m}")  # shared: rests by the heads that they follow
        p_rest = [F.greatest(own(m, c) - d, F.lit(0.0)) / F.greatest(F.col(f"h{m}{c}"), F.lit(1)) + F.col(f"back{m}{c}") * p_back for c in (0, 1)]
        llr.append(F.when(pooled > 0, F.log(p_rest[1]) - F.log(p_rest[0]) + F.col(f"head{m}")).cast("float").alias(f"l{m}"))
    by_word = support.materialise(joined.select("word", sum((F.col(f"n{k}") for k in range(4)), F.lit(0)).alias("seen"), *llr), "word-parameters")
    support.drop_scratch(counts.sparkSession, heads)
    return by_word, by_head, new


class Hot:
    """The parameters that tasks hold: sorted tables of hashes, and a column a model (NaN where the model hasn't seen the entry)."""

    def __init__(self, words: DataFrame, heads: DataFrame, new: list[float], most: int) -> None:
        self.word, self.word_llr, self.all_words = self._top(words, "word", "l", most)
        self.head, self.rest_llr, self.all_heads = self._top(heads, "head", "r", most)
        self.new = np.array(new)

    @staticmethod
    def _top(table: DataFrame, key: str, value: str, most: int) -> tuple[np.ndarray, np.ndarray, bool]:
        rows = table.orderBy(F.desc("seen"), key).limit(most + 1).toArrow()
        whole = len(rows) <= most
        rows = rows.slice(0, most)
        keys = rows[key].to_numpy().view(np.uint64)
        order = np.argsort(keys)
        return keys[order], np.stack([rows[f"{value}{m}"].to_numpy(zero_copy_only=False).astype(np.float32)[order] for m in range(3)], axis=1), whole

    @property
    def complete(self) -> bool:
        return self.all_words and self.all_heads

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), bool), np.zeros(len(wanted), int)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return keys[at] == wanted, at

    def differences(self, head: np.ndarray, word: np.ndarray, m: np.ndarray) -> np.ndarray:
        """By word; NaN where the tables must be asked."""
        out = np.full(len(word), np.nan)
        known, at = self._find(self.word, word & ~np.uint64(3))
        if len(self.word):
            out[known] = self.word_llr[at[known], m[known]]
        new = np.flatnonzero(np.isnan(out) & (known | self.all_words))
        found, at = self._find(self.head, head[new])
        rest = np.where(found | self.all_heads, self.new[m[new]], np.nan)
        if len(self.head):
            own = self.rest_llr[at, m[new]]
            rest = np.where(found & ~np.isnan(own), own, rest)
        out[new] = rest
        return out

    def parts(self, column: pa.Array, a: int, b: int, m: np.ndarray) -> tuple:
        """(words, sum of differences, the largest differences of distinct words, cold) of texts a to b under models ``m``;
        cold: (text, word, head, times) of the distinct words that aren't held here.
        """
        n = b - a
        text, head, word = units(column, a, b)
        word = word & ~np.uint64(3)
        llr = np.clip(self.differences(head, word, m[text]), -12, 12)
        count = np.bincount(text, minlength=n)
        cold = np.isnan(llr)
        total = np.bincount(text[~cold], llr[~cold], minlength=n)
        # each distinct word of a text once: a word that a text repeats tells no more than once
        order = np.lexsort((word, -llr, text))
        own = np.ones(len(order), bool)
        own[1:] = (word[order][1:] != word[order][:-1]) | (text[order][1:] != text[order][:-1])
        first = np.flatnonzero(own)
        times = np.diff(np.append(first, len(order)))
        first, at = order[first], np.isnan(llr[order[first]])
        ranked, of = llr[first][~at], text[first][~at]
        distinct = np.bincount(of, minlength=n)
        base = np.concatenate([[0], np.cumsum(distinct)])
        top = np.zeros((n, max(TOP)))
        for k in range(max(TOP)):
            some = k < distinct
            top[some, k] = np.maximum(ranked[base[:-1][some] + k], 0)
        return count, total, top, (text[first][at], word[first][at], head[first][at], times[at])

    def evidence(self, column: pa.Array, a: int, b: int) -> np.ndarray:
        """Length-normalised differences of texts a to b where nothing is cold: the whole text's, and those of its most telling words."""
        count, total, top, _ = self.parts(column, a, b, np.zeros(b - a, int))
        return np.stack([total / np.maximum(count, 1), np.log1p(count), *[top[:, :m].sum(axis=1) / m for m in TOP]], axis=1)


def evidence(docs: DataFrame, model: dict, keep: list[str], other_half: bool = False) -> DataFrame:
    """``keep`` and x, the evidence of every row of ``docs`` (keep, text) by the model of all rows, or of those that the row's doc_id is not in."""
    spark = docs.sparkSession
    support.bounded_batches(spark)
    sent = spark.sparkContext.broadcast(model["hot"])
    rows = docs.select(F.monotonically_increasing_id().alias("__row"), *keep, "text")
    kept = T.StructType(rows.schema.fields[:-1])
    for name, kind in (("__m", "int"), ("__n", "bigint"), ("__total", "double"), ("__top", "array<double>"), ("__cold", "array<struct<word:bigint,head:bigint,n:int>>")):
        kept = kept.add(name, T.DataType.fromDDL(kind))
    where = keep.index("doc_id") + 1 if other_half else 0

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(keep) + 1)
            m = np.zeros(len(column), int)
            if other_half:
                ids = batch.column(where).to_numpy(zero_copy_only=False)
                m = 2 - (shingles.mix(ids.astype(np.int64).astype(np.uint64)) & np.uint64(1)).astype(int)
            _, off = shingles.text_bytes(column)
            for a, b in shingles.slices(off):
                count, total, top, (text, word, head, times) = sent.value.parts(column, a, b, m[a:b])
                starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=b - a))])
                cold = pa.StructArray.from_arrays([pa.array(word.view(np.int64)), pa.array(head.view(np.int64)), pa.array(times, pa.int32())], ["word", "head", "n"])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c)[a:b] for c in range(len(keep) + 1)), pa.array(m[a:b], pa.int32()), pa.array(count, pa.int64()), pa.array(total, pa.float64()), pa.array(list(top), pa.list_(pa.float64())), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), cold)],
                    kept.names,
                )

    parts = rows.mapInArrow(task, kept)
    zero = F.lit(0.0)
    if not model["hot"].complete:
        parts = support.materialise(parts, "evidence")
        asked = parts.select("__row", "__m", F.inline("__cold"))
        found = asked.join(model["words"].drop("seen"), "word", "left").join(model["heads"].drop("seen"), "head", "left")
        pick = lambda xs: F.when(F.col("__m") == 0, xs[0]).when(F.col("__m") == 1, xs[1]).otherwise(xs[2])
        value = F.coalesce(pick([F.col(f"l{m}") for m in range(3)]), pick([F.col(f"r{m}") for m in range(3)]), pick([F.lit(x) for x in model["hot"].new])).cast("double")
        value = F.least(F.greatest(value, F.lit(-12.0)), F.lit(12.0))
        # summed in one order, so that equal texts have equal scores
        sums = found.groupBy("__row").agg(F.sort_array(F.collect_list(F.struct(value.alias("v"), "n")), asc=False).alias("seen")).select(
            "__row", F.aggregate("seen", zero, lambda s, x: s + x["v"] * x["n"]).alias("__more"), F.transform(F.slice("seen", 1, max(TOP)), lambda x: F.greatest(x["v"], F.lit(0.0))).alias("__rest")
        )
        parts = parts.drop("__cold").join(sums, "__row", "left")
        parts = parts.withColumn("__total", F.col("__total") + F.coalesce("__more", zero)).withColumn("__top", F.sort_array(F.concat("__top", F.coalesce("__rest", F.array().cast("array<double>"))), asc=False))
    x = F.array(F.col("__total") / F.greatest("__n", F.lit(1)), F.log1p("__n"), *[F.aggregate(F.slice("__top", 1, m), zero, lambda s, v: s + v) / m for m in TOP])
    return parts.select(*keep, x.alias("x"))


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, sd, weights with an intercept) of a ridge logistic regression by Newton steps."""
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd[sd < 1e-9] = 1.0
    z = np.concatenate([(x - mean) / sd, np.ones((len(x), 1))], axis=1)
    share = np.full(len(y), 1.0 / len(y))
    w = np.zeros(z.shape[1])
    ridge = 1e-3 * np.append(np.ones(len(w) - 1), 0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (share * p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-9), z.T @ (share * (y - p)) - ridge * w)
        w += step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-5:
            break
    return mean, sd, w


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """The model; labels of held-out rows are never read.  Without both classes every score is the share of toxic rows."""
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~support.held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("label"))
    share = known.agg(F.avg("label")).first()[0]
    if share is None or share in (0.0, 1.0):
        return {"constant": 0.0 if share is None else float(np.clip(share, 0.01, 0.99))}
    # sorted and merged at every size: labels grow with the documents, so they are no table to broadcast
    sample = docs.select("doc_id", "text").join(known.hint("merge"), "doc_id").select("doc_id", "label", "text")
    with support.shuffles_dropped(spark):
        counts = support.materialise(count_words(sample), "word-counts")
        words, heads, new = parameters(counts)
    support.drop_scratch(spark, counts)
    model = {"words": words, "heads": heads, "hot": Hot(words, heads, new, HOT)}
    few = quality.labelled_sample(docs, labels, "toxic", MAX_CALIBRATION)
    rows = evidence(few.select("doc_id", F.col("label").cast("int").alias("label"), "text"), model, ["doc_id", "label"], other_half=True).toArrow()
    y = rows["label"].to_numpy()
    if len(set(y.tolist())) < 2:
        return {"constant": float(np.clip(share, 0.01, 0.99))}
    x = np.array(rows["x"].to_pylist(), float).reshape(len(y), -1)
    order = np.lexsort((y, rows["doc_id"].to_numpy()))
    return model | {"map": fit_logistic(x[order], y[order])}


def score(model: dict, column: pa.Array, a: int, b: int) -> np.ndarray:
    if "constant" in model:
        return np.full(b - a, model["constant"])
    if not model["hot"].complete:
        raise ValueError("the model has words that only its tables hold: use with_score")
    mean, sd, w = model["map"]
    x = (model["hot"].evidence(column, a, b) - mean) / sd
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def scorer(spark: SparkSession, model: dict):
    """An Arrow function of the text column: the score of each whole text."""
    support.bounded_batches(spark)
    sent = spark.sparkContext.broadcast({k: v for k, v in model.items() if k not in ("words", "heads")})

    @F.arrow_udf(T.DoubleType())
    def toxicity_score(text: pa.Array) -> pa.Array:
        _, off = shingles.text_bytes(text)
        out = [score(sent.value, text, a, b) for a, b in shingles.slices(off)]
        return pa.array(np.concatenate(out) if out else np.empty(0), pa.float64())

    return toxicity_score


def with_score(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """``keep`` and score of every row of ``docs``."""
    if "constant" in model or model["hot"].complete:
        return docs.select(*keep, scorer(docs.sparkSession, model)("text").alias("score"))
    mean, sd, w = model["map"]
    z = sum(((F.col("x")[i] - float(mean[i])) / float(sd[i]) * float(w[i]) for i in range(len(mean))), F.lit(float(w[-1])))
    score = 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))
    return evidence(docs, model, keep).select(*keep, score.alias("score"))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text; other columns are ignored).

    A null text is empty; an empty text has a score like any other.  Rows that repeat get equal scores.
    A null doc_id counts as '' for the hold-out and takes no label; an id with several labels has the largest of them.
    An empty table gives an empty result.
    """
    out = with_score(docs, train(docs, labels), ["doc_id"]).select("doc_id", support.held_out(F.col("doc_id")).alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_ordinary(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with a score below ``threshold``, all columns kept."""
    model = train(docs, labels)
    if "constant" in model or model["hot"].complete:
        return docs.where(scorer(docs.sparkSession, model)("text") < threshold)
    # a score depends on the text alone: rows are dropped by two hashes of their text
    name = {"__a": F.xxhash64("text"), "__b": F.xxhash64(F.lit(1), "text")}
    toxic = with_score(docs.select("text").withColumns(name), model, list(name)).where(F.col("score") >= threshold).select(*name).distinct()
    return docs.withColumns(name).join(toxic, list(name), "left_anti").select(*docs.columns)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))

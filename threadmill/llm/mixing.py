"""Mixing sources to target weights, in words.

Every document gets a hash-random key (md5 of a seed, its id and its text).  Keys are uniform, so
cutting their range evenly range-partitions each source into parts of like size, without a
sampling pass; within a source, documents are ordered by key, words are summed by a
two-level prefix sum (sums of parts, and a window within each part), and the source is cut
at its exact budget: whole epochs first, then the documents in front of the cut, and
the first words of the one that it falls in.  A large source has as many parts as a
small one has, each of fewer than about ``PART_ROWS`` rows, so no task holds a source.
"""

from __future__ import annotations

import re
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from threadmill.llm import support

WEIGHTS = (5, 2, 1)
#: No source gives more than so many times its words.
MOST = 3
PART_ROWS = 20_000
SEED = "mix-1"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sizes`` (source, source_size) with rank, weight and target.

    Sources by code point, null last, take the weights in turn, and share all words by them.  A share
    beyond ``most`` times its source's words stops there and the rest is shared anew by weight.
    Each round is one aggregation to a single row; rounds end when no further source is capped.
    """
    # one small row per source: a rank over them is the only global order here
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    t = support.materialise(sizes.withColumn("rank", rank.cast("bigint")).withColumn("weight", weight.cast("bigint")).withColumn("most", F.col("source_size") * most), "sources")
    total = t.agg(F.sum("source_size")).first()[0] or 0
    share, capped = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(share) > F.col("most") if capped >= 0 else F.lit(False)
        n, fixed, rest = t.agg(F.count_if(over), F.sum(F.when(over, F.col("most")).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight")))).first()
        if n == capped or not rest:
            break
        capped, share = n, (total - fixed) / rest
    share_of = F.lit(float(share)) * F.col("weight")
    return t.withColumn("target", F.least(share_of, F.col("most").cast("double"))).drop("most")


def size_of(text: str = "text") -> Column:
    """Words of the whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(support.WORD)), F.lit(0)).cast("bigint")


def key_of(seed: str = SEED) -> Column:
    """The hash-random key: rows that share an id, or have none, are told apart by their texts."""
    null = F.lit("null")
    return F.md5(F.concat(F.lit(seed + "/"), F.coalesce(F.col("doc_id").cast("string"), null), F.lit("/"), F.coalesce(F.md5("text"), null)))


def sizes_and_keys(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source, size (words of the whole text), key of every row."""
    return docs.select("doc_id", "source", size_of().alias("size"), key_of(seed).alias("key"))


def mix(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, part_rows: int = PART_ROWS) -> DataFrame:
    """``rows`` (doc_id, source, size, key and others) with source_size, target, before (words of its source in front), epochs and taken.

    Rows that repeat are mixed apart.  Rows of equal keys have one id and one text, so it makes no difference which
    of them comes first.  A source's budget is its target rounded to whole words.  An empty table gives an empty result.
    """
    rows = support.materialise(rows, "mix-rows")
    n = rows.count()
    shards = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = min(28, max(0, (max(n // part_rows, 2 * shards) - 1).bit_length()))
    t = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    t = support.materialise(t, "targets")
    part = F.shiftright(F.conv(F.substring("key", 1, 7), 16, 10).cast("bigint"), 28 - bits)
    goals = t.select(support.never_null("source", "string").alias("__source"), "source_size", "target")
    placed = rows.withColumn("part", part).withColumn("__source", support.never_null("source", "string"))
    s = support.running_total(placed, ["__source", "part"], ["key", "size"], "size", "before").join(goals, "__source")
    budget = F.round("target").cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("bigint")
    left = budget - F.col("epochs") * F.col("source_size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("before"))).cast("bigint")
    return s.withColumn("epochs", epochs).withColumn("last", last).withColumn("taken", F.col("epochs") * F.col("size") + F.col("last")).drop("part", "__source")


@F.arrow_udf(T.StringType())
def _first_words(text: pa.Array, words: pa.Array) -> pa.Array:
    """The start of each text up to the end of its first ``words`` words; null for null."""
    out = []
    for t, n in zip(text, words, strict=True):
        t, n = t.as_py(), n.as_py()
        if t is not None:
            end = next(islice(re.finditer(support.WORD, t), n - 1, None)).end()
            t = t[:end]
        out.append(t)
    return pa.array(out, pa.string())


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document as often as the epochs take it, and where the cut
    falls in a document, its first words up to the cut.  Documents without words stay once (they cost nothing).
    """
    names = docs.columns
    support.bounded_batches(docs.sparkSession)
    # rows that differ in other columns alone are ordered by those, so that a repeated run cuts the same one
    key = F.concat(key_of(), F.hex(F.xxhash64(*names)))
    out = mix(docs.select(F.struct(*[F.col(c) for c in names]).alias("row"), "doc_id", "source", size_of().alias("size"), key.alias("key")), weights, most)
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("epochs") + (F.col("last") > 0).cast("bigint"))
    cut = (F.col("copy") > F.col("epochs")) & (F.col("last") < F.col("size"))
    exploded = out.where(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), copies)))
    exploded = exploded.withColumn("head", _first_words(F.when(cut, F.col("row.text")), F.col("last")))  # null for all rows but one of a source
    text = F.when(cut, F.col("head")).otherwise(F.col("row.text"))
    return exploded.select(*[text.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in names])


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document a mix at weights 5, 2, 1 takes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(sizes_and_keys(docs)).select("doc_id", "size", "source_size", "target", "taken")


#: The same by DuckDB: capped shares by the order of most/weight, prefix sums by the key's order.
ORACLE = rf"""
WITH rows_ AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('{SEED}/' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '/' || coalesce(md5(text), 'null')) AS key
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows_ GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM sizes),
weighed AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * {MOST} AS most FROM ranked),
ordered AS (SELECT *, row_number() OVER (ORDER BY most / weight, rank) AS k, sum(source_size) OVER () AS total FROM weighed),
cuts AS (
  SELECT k, most / weight AS ratio, total,
         coalesce(sum(most) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fixed,
         sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM ordered),
share AS (SELECT CAST(total - fixed AS DOUBLE) / rest AS share FROM cuts WHERE CAST(total - fixed AS DOUBLE) / rest <= ratio ORDER BY k LIMIT 1),
goal AS (SELECT source, source_size, least((SELECT share FROM share) * weight, CAST(most AS DOUBLE)) AS target FROM weighed),
placed AS (
  SELECT r.*, g.source_size, g.target, CAST(round(g.target) AS BIGINT) AS budget,
         coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.key, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_
  FROM rows_ r JOIN goal g ON r.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
            + greatest(0, least(size, budget - (budget // source_size) * source_size - before_)) END AS BIGINT) AS taken
FROM placed
"""

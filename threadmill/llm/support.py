"""What the training-data operators share: scratch tables, batch bounds, prefix sums, components.

Scratch tables are Parquet under the folder that the cluster names in
``spark.checkpoint.dir``; every executor sees it, so a lost executor costs
a re-read and nothing else.  Where that setting is absent, a temporary folder takes
its place in a local session (tests); on a cluster that is an error.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space of the word definition: \x20 and \x09 to \x0D, as a Java regex.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_root(spark: SparkSession) -> str:
    """The shared scratch folder of this application."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("threadmill.scratch.dir", None)
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="threadmill-")
        spark.conf.set("threadmill.scratch.dir", root)
    return f"{root.rstrip('/')}/threadmill-{sc.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_drop, spark, path)
    return path


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the application is ending; the folder is per application
        pass


def drop_scratch(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove scratch tables that no later result reads."""
    for t in tables:
        if path := getattr(t, "_threadmill_path", None):
            _drop(spark, path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a scratch table and return the table: lineage ends here."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._threadmill_path = path
    return out


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a query are removed when it ends; for queries whose results are written to scratch tables."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def bounded_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound what one Arrow batch holds, so that very long texts don't add up in memory.

    The options stay set for the session: plans are lazy and read them when they run.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves no remainder modulo 5; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def is_held_out(doc_id) -> bool:
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 5 == 0


def running_total(df: DataFrame, group: list[str], order: list[str], value: str, into: str) -> DataFrame:
    """Exclusive prefix sums of ``value`` within pieces: ``group`` names the pieces of a range-partitioned table,
    its first columns the sequences and its last column the piece (none of them null), which orders as its rows do.  Two levels: sums of
    pieces, and a window within each.  ``df`` is read twice.
    """
    piece = group[-1]
    sums = df.groupBy(*group).agg(F.sum(value).alias("__sum"))
    over = Window.partitionBy(*group[:-1]).orderBy(piece) if group[:-1] else Window.partitionBy(F.lit(1)).orderBy(piece)
    sums = sums.withColumn("__base", F.coalesce(F.sum("__sum").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__sum")
    within = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = df.withColumn("__within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    # equality on non-null keys: the join finds the rows where the window left them
    return placed.join(sums, group).withColumn(into, F.col("__base") + F.col("__within")).drop("__base", "__within")


def frequent(counts: DataFrame, keys: list[str], least: int = 200, most: int = 20_000) -> DataFrame:
    """The ``most`` keys of the largest counts above ``least`` (``counts``: keys, n): a written table of that many rows at most."""
    return materialise(counts.where(F.col("n") > least).orderBy(F.desc("n"), *keys).limit(most).select(*keys), "hot-keys")


def hot_join(left: DataFrame, right: DataFrame, keys: str | list[str], how: str = "left", counts: DataFrame | None = None, least: int = 200, most: int = 20_000) -> DataFrame:
    """``left`` joined with ``right``, which has one row a key at most and short rows; ``how`` is left or inner.

    ``left`` may hold any number of rows of one key: the ``most`` most frequent keys of more than ``least`` rows meet their row of
    ``right`` by a broadcast of ``most`` rows at most, at any size; all others, each less than 1/``most`` of ``left``, are joined by hash.
    Rows with a null key match nothing and move nowhere.  ``left`` is read several times: it should be a written table.
    ``counts`` (keys, n) saves counting where the caller has it.
    """
    keys = [keys] if isinstance(keys, str) else keys
    known = reduce(and_, [F.col(k).isNotNull() for k in keys])
    rows = left.where(known)
    if counts is None:
        counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    hot = frequent(counts, keys, least, most)
    if hot.isEmpty():
        out = rows.join(right, keys, how)
    else:
        few = F.broadcast(hot)
        answers = materialise(right.join(few, keys, "left_semi"), "hot-rows")
        out = rows.join(few, keys, "left_semi").join(F.broadcast(answers), keys, how)
        out = out.unionByName(rows.join(few, keys, "left_anti").join(right, keys, how))
    if how == "left":
        kinds = {f.name: f.dataType for f in right.schema.fields}
        nothing = [F.lit(None).cast(kinds[c]).alias(c) for c in right.columns if c not in keys]
        out = out.unionByName(left.where(~known).select(*left.columns, *nothing))
    return out


def never_null(name: str, kind: str) -> Column:
    """A grouping key that stands for the column and is null for no row."""
    return F.struct(F.col(name).isNull().alias("is_null"), F.coalesce(F.col(name), F.lit("" if kind == "string" else 0).cast(kind)).alias("value"))


def components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge table: (node, component), the component being its smallest node.

    Alternating large-star and small-star steps.  Each step is one grouped
    minimum (combined before the shuffle) and one join that spreads hubs; the edge table is written
    after each round, and rounds grow with the logarithm of the longest path.
    Self loops and nulls are dropped; nodes without edges don't appear.
    """
    e = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null and u <> v")
    e = materialise(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        if e.isEmpty():
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialise(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "lows")
        # the edges of a node to its larger neighbours; a hub has many
        up = e.select(F.col("v").alias("u"), F.col("u").alias("v"))
        large = materialise(hot_join(up, low.drop("n"), "u", "inner", low.select("u", "n")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large-star")
        low2 = materialise(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "lows")
        small = hot_join(large, low2.drop("n"), "u", "inner", low2.select("u", "n")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low2.select("u", F.col("m").alias("v")))
        nxt = materialise(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        # a star forest: no node is both a centre and a leaf, and each leaf has one centre
        centres = nxt.select(F.col("v").alias("u")).distinct()
        bent = nxt.join(centres, "u", "left_semi").limit(1).count() or nxt.groupBy("u").count().where("count > 1").limit(1).count()
        drop_scratch(e.sparkSession, e, low, large, low2)
        e = nxt
        if not bent:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

"""Incremental refresh: what changed since the last run, a store whose tables change together, the writer's lock, and a streaming runner.

The watermark is a file's state (size, time, parser version) or a session's fingerprint, not event time.  A refresh writes the
buckets that it changes into a folder of its own (a generation) and then one manifest that names, for every table, the generations that hold
its buckets.  Until the manifest stands under its final name readers and later refreshes see the last complete state, so a
crash at any moment loses nothing and leaves the same work to do again; running a refresh twice is the same as running it once.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadmill.sources.discovery import PARSER_VERSIONS

#: Buckets of a store at least, and log bytes that one bucket stands for.
BUCKETS, BUCKET_BYTES = 64, 128 << 20
#: Generations of a table after which all its buckets are written anew.
GENERATIONS = 16


def diff_files(known: DataFrame, found: DataFrame) -> DataFrame:
    """path, state (new, changed, removed) between checkpoints and a scan: both have path, size, mtime_ns, version."""
    k, f = known.alias("k"), found.alias("f")
    same = F.col("k.size").eqNullSafe(F.col("f.size")) & F.col("k.mtime_ns").eqNullSafe(F.col("f.mtime_ns")) & F.col("k.version").eqNullSafe(F.col("f.version"))
    state = F.when(F.col("k.path").isNull(), "new").when(F.col("f.path").isNull(), "removed").when(~same, "changed")
    return k.join(f, F.col("k.path") == F.col("f.path"), "full_outer").select(F.coalesce("k.path", "f.path").alias("path"), state.alias("state")).where("state is not null")


def with_versions(files: DataFrame) -> DataFrame:
    version = F.lit(1)
    for kind, v in PARSER_VERSIONS.items():
        version = F.when(F.col("kind") == kind, v).otherwise(version)
    return files.withColumn("version", version)


def buckets_for(size: int) -> int:
    """A power of two, so that a bucket stands for about ``BUCKET_BYTES`` of logs."""
    return max(BUCKETS, 1 << max(0, (size // BUCKET_BYTES - 1).bit_length()))


class Files:
    """The few file operations that the store needs, by the file system that a path names."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm = spark.sparkContext._jvm
        self._fs = self.path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        p = self.path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(p)] if self._fs.exists(p) else []

    def read(self, name: str) -> str:
        with_stream = self._fs.open(self.path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(with_stream, "UTF-8")
        finally:
            with_stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Write a file that appears whole or not at all; False where one of that name is there already."""
        tmp, target = self.path(f"{name}.{uuid.uuid4().hex}.tmp"), self.path(name)
        out = self._fs.create(tmp, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if self._fs.exists(target) or not self._fs.rename(tmp, target):
            self._fs.delete(tmp, False)
            return False
        return True

    def delete(self, name: str) -> None:
        self._fs.delete(self.path(name), True)


class Store:
    """Tables of conversations in hash buckets, and whole tables, that change together."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.files = spark, root, Files(spark, root)

    def manifest(self) -> dict:
        """The last complete state: number, buckets, and the tables' schemas and generations."""
        names = sorted(n for n in self.files.names(self.root) if n.startswith("manifest-") and n.endswith(".json"))
        return json.loads(self.files.read(f"{self.root}/{names[-1]}")) if names else {"number": 0, "buckets": None, "tables": {}}

    def read(self, name: str, manifest: dict | None = None, only: list[int] | None = None) -> DataFrame | None:
        """A table of the last complete state (``only``: of some buckets), with its bucket column; None before the first refresh."""
        entry = (manifest or self.manifest())["tables"].get(name)
        if entry is None:
            return None
        schema = T.StructType.fromJson(json.loads(entry["schema"]))
        out = None
        for generation, buckets in entry["generations"].items():
            folder = f"{self.root}/data/{generation}/{name}"
            wanted = None if buckets is None else [b for b in buckets if only is None or b in only]
            if wanted == []:
                continue
            paths = [folder] if wanted is None else [f"{folder}/bucket={b}" for b in wanted]
            part = self.spark.read.schema(schema).option("basePath", folder).parquet(*paths)
            out = part if out is None else out.unionByName(part)
        return self.spark.createDataFrame([], schema) if out is None else out

    def begin(self, buckets: int, full: bool = False) -> Refresh:
        return Refresh(self, buckets, full)


#: Seed of Spark's xxhash64.
_SEED = 42


def _bucket(conversation_id, buckets: int):
    return F.pmod(F.xxhash64(conversation_id), F.lit(buckets)).cast("int")


def bucket_number(conversation_id: str, buckets: int) -> int:
    """The bucket of one conversation, without a Spark job."""
    h = xxhash.xxh64_intdigest(conversation_id.encode(), seed=_SEED)
    return (h - (1 << 64) if h >> 63 else h) % buckets


class Refresh:
    """One change of the store: tables are written to a new generation, and ``commit`` makes them the store's state."""

    def __init__(self, store: Store, buckets: int, full: bool) -> None:
        self.store, self.before, self.full = store, store.manifest(), full
        self.number = self.before["number"] + 1
        self.name = f"{self.number:08d}-{uuid.uuid4().hex[:8]}"
        self.buckets = buckets if full or not self.before["buckets"] else self.before["buckets"]
        self.tables = {} if full else dict(self.before["tables"])

    def _folder(self, table: str) -> str:
        return f"{self.store.root}/data/{self.name}/{table}"

    def whole(self, table: str, rows: DataFrame) -> DataFrame:
        """Write a table anew; the result reads what was written."""
        rows.write.parquet(self._folder(table))
        self.tables[table] = {"schema": json.dumps(json.loads(rows.schema.json())), "generations": {self.name: None}}
        return self.store.spark.read.schema(rows.schema).parquet(self._folder(table))

    def replace(self, table: str, fresh: DataFrame, gone: DataFrame) -> None:
        """Put ``fresh`` rows in the place of their conversations' old ones and drop the conversations in ``gone`` (conversation_id).

        Buckets without an old row of these are only added to; the others are written anew with the rows that stay.
        """
        spark = self.store.spark
        fresh = fresh.withColumn("bucket", _bucket(F.col("conversation_id"), self.buckets))
        old = None if self.full else self.store.read(table, self.before)
        generations = {} if old is None else self.before["tables"][table]["generations"]
        rows, rewritten = fresh, set()
        if old is not None:
            dropped = gone.select("conversation_id").union(fresh.select("conversation_id")).distinct()
            if len(generations) >= GENERATIONS:
                rest = old.join(dropped, "conversation_id", "left_anti")
                rewritten = set(range(self.buckets))
            else:
                hit = old.select("conversation_id", "bucket").join(dropped, "conversation_id", "left_semi").select("bucket").distinct()
                rewritten = {r[0] for r in hit.collect()}  # bucket numbers, of which a store has one for each BUCKET_BYTES of logs
                rest = self.store.read(table, self.before, sorted(rewritten)).join(dropped, "conversation_id", "left_anti")
            rows = rest.unionByName(fresh, allowMissingColumns=True) if rewritten else fresh
        folder = self._folder(table)
        dealt = rows.repartition("bucket")
        if "term" in rows.columns:  # postings: a term's rows stand together, so its row groups alone are read
            dealt = dealt.sortWithinPartitions("bucket", "term", "conversation_id", "turn_index")
        dealt.write.partitionBy("bucket").parquet(folder)
        written = sorted(int(n.partition("=")[2]) for n in self.store.files.names(folder) if n.startswith("bucket="))
        kept = {g: [b for b in own if b not in rewritten] for g, own in generations.items()}
        kept = {g: own for g, own in kept.items() if own}
        if written:
            kept[self.name] = written
        self.tables[table] = {"schema": json.dumps(json.loads(rows.schema.json())), "generations": kept}

    def commit(self) -> None:
        """Publish the manifest; then folders that neither this state nor the one before names are removed (readers of that may still run)."""
        state = {"number": self.number, "buckets": self.buckets, "tables": self.tables}
        root, files = self.store.root, self.store.files
        if not files.publish(f"{root}/manifest-{self.number:08d}.json", json.dumps(state)):
            raise RuntimeError("another writer has published a refresh of the same state; this one is void")
        live = {g for m in (state, self.before) for t in m["tables"].values() for g in t["generations"]}
        for g in files.names(f"{root}/data"):
            if g not in live:
                files.delete(f"{root}/data/{g}")
        for name in sorted(n for n in files.names(root) if n.startswith("manifest-"))[:-2]:
            files.delete(f"{root}/{name}")


class WriterLock:
    """An advisory lock: a file that only one writer can create. A loser doesn't wait; it reads what is there.

    The holder renews the file's time while it works; a lock that nobody has renewed for ``expiry`` seconds was left by a crash and is
    taken over.  The store doesn't hang on it: of two writers that both believe to hold it, one fails to publish.
    """

    def __init__(self, spark: SparkSession, path: str, expiry: float = 900.0) -> None:
        jvm = spark.sparkContext._jvm
        self._path, self._aside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
        self._fs = self._path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._expiry, self._done, self.held = expiry, threading.Event(), False

    def _stale(self) -> bool:
        return self._fs.exists(self._path) and time.time() * 1000 - self._fs.getFileStatus(self._path).getModificationTime() > self._expiry * 1000

    def _renew(self) -> None:
        while not self._done.wait(self._expiry / 3):
            self._fs.setTimes(self._path, int(time.time() * 1000), -1)

    def __enter__(self) -> WriterLock:
        self._fs.mkdirs(self._path.getParent())
        if self._stale() and self._fs.rename(self._path, self._aside):  # of several, one moves it away
            self._fs.delete(self._aside, False)
        self.held = self._fs.createNewFile(self._path)
        if self.held:
            threading.Thread(target=self._renew, daemon=True).start()
        return self

    def __exit__(self, *_: object) -> None:
        self._done.set()
        if self.held:
            self._fs.delete(self._path, False)


def stream_exchanges(turns: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """A streaming query over turns that hands each micro-batch to an idempotent sink; it ends when the source is drained."""
    return turns.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Finding session logs: provider roots, skip rules, provider claims, and lines with their byte offsets."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders below a home folder that hold logs.
PROVIDER_ROOTS = (".claude/projects", ".codex/sessions", ".cursor/projects", ".grok/sessions", ".grok/logs", "Library/Application Support/Claude/local-agent-mode-sessions")
LINE_CAP = 16 * 1024 * 1024
#: Parser versions; a file parsed by another version is parsed anew.
PARSER_VERSIONS = {"claude": 2, "claude-cowork": 1, "codex": 3, "cursor": 1, "grok": 2, "hermes": 1, "opencode": 1, "generic": 1}


def provider_of(path: Column) -> Column:
    """The provider that a path's shape names, by the first rule that fits; null for none."""
    return (
        F.when(path.contains("/local-agent-mode-sessions/"), "claude-cowork")
        .when(path.contains("/.claude/projects/"), "claude")
        .when(path.contains("/.codex/sessions/"), "codex")
        .when(path.contains("/.cursor/projects/") & path.contains("/agent-transcripts/"), "cursor")
        .when(path.contains("/.grok/sessions/") | path.contains("/.grok/logs/"), "grok")
        .when(path.rlike("/spool/hermes/"), "hermes")
        .when(path.rlike("/spool/opencode/"), "opencode")
    )


def skipped(path: Column) -> Column:
    """Files of provider roots that hold no session."""
    return path.endswith("/history.jsonl") | path.endswith("/audit.jsonl") | (path.contains("/.cursor/projects/") & ~path.contains("/agent-transcripts/"))


def _scan(spark: SparkSession, roots: list[str]) -> DataFrame | None:
    """Metadata of the JSONL files below existing roots; the content column isn't read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there = [r for r in roots if (p := jvm.org.apache.hadoop.fs.Path(r)).getFileSystem(conf).exists(p)]
    if not there:
        return None
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(there)
    path = F.regexp_replace("path", "^file:/+", "/")
    return files.select(path.alias("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"))


def discover(spark: SparkSession, home: str, extra_roots: list[str] = (), disabled: list[str] = ()) -> DataFrame:
    """path, kind, size, mtime_ns of each session file, once; files of extra roots that no provider claims are generic."""
    parts = []
    own = _scan(spark, [f"{home.rstrip('/')}/{r}" for r in PROVIDER_ROOTS])
    if own is not None:
        parts.append(own.where(~skipped(F.col("path"))).withColumn("kind", provider_of(F.col("path"))).where("kind is not null"))
    extra = _scan(spark, list(extra_roots))
    if extra is not None:
        parts.append(extra.withColumn("kind", F.coalesce(provider_of(F.col("path")), F.lit("generic"))))
    if not parts:
        return spark.createDataFrame([], "path string, kind string, size bigint, mtime_ns bigint")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.dropDuplicates(["path"]).select("path", "kind", "size", "mtime_ns")
    return out.where(~F.col("kind").isin(*disabled)) if disabled else out


def stream_lines(read: Callable[[int], bytes], cap: int = LINE_CAP, block: int = 8 << 20) -> Iterator[tuple[int, int, int, bytes | None]]:
    """(number from 1, start, exclusive end, bytes) of each line that isn't blank, from a reader of blocks; a line beyond ``cap`` has no bytes.

    The end includes the line break; a carriage return before it isn't part of the bytes.  Memory holds a block and a line of ``cap`` bytes.
    """
    start, number, held, dropped, last = 0, 0, b"", 0, False
    while not last:
        more = read(block)
        last = not more
        *whole, held = (held + more).split(b"\n")
        ends = [(line, 1) for line in whole] + ([(held, 0)] if last and (held or dropped) else [])
        for line, broken in ends:
            number, end = number + 1, start + dropped + len(line) + broken
            body = line.removesuffix(b"\r")
            if dropped or len(body) > cap:
                yield number, start, end, None
            elif body.strip():
                yield number, start, end, body
            start, dropped = end, 0
        if len(held) > cap + 1:
            dropped, held = dropped + len(held), b""


def lines_of(content: bytes, cap: int = LINE_CAP) -> Iterator[tuple[int, int, int, bytes | None]]:
    return stream_lines(io.BytesIO(content).read, cap)


LINES_SCHEMA = "path string, kind string, line bigint, byte_start bigint, byte_end bigint, raw string, oversized boolean"
#: Log bytes, and files, that one task reads, about; lines and bytes of an Arrow batch.
TASK_BYTES, TASK_FILES = 128 << 20, 500
BATCH_LINES, BATCH_BYTES = 2000, 8 << 20


def _open(path: str):
    system, name = (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)
    return system.open_input_stream(name)


def read_lines(spark: SparkSession, files: DataFrame, cap: int = LINE_CAP) -> DataFrame:
    """Every physical line of the files (path, kind, and size where known) with exact byte offsets.

    Tasks open the files themselves and stream them, so the driver never lists them and a file may have any size.  Paths are those of
    a file system that all executors see; ones with a scheme go by it.
    """
    size = F.sum("size") if "size" in files.columns else F.lit(0)
    n, total = files.agg(F.count(F.lit(1)), size).first()
    tasks = max(1, min(n, max(spark.sparkContext.defaultParallelism, (total or 0) // TASK_BYTES, n // TASK_FILES)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, kind in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                held = 0
                with _open(path) as source:
                    for number, a, b, body in stream_lines(source.read, cap):
                        rows.append((path, kind, number, a, b, None if body is None else body.decode(errors="replace"), body is None))
                        held += b - a if body is not None else 0
                        if len(rows) == BATCH_LINES or held > BATCH_BYTES:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return files.select("path", "kind").repartition(tasks).mapInArrow(task, LINES_SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["path", "kind", "line", "byte_start", "byte_end", "raw", "oversized"])

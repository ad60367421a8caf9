"""Session stores in SQLite, read as spool lines: one session is one virtual file of JSON records.

Databases are opened read-only and their columns are probed, so a missing column reads as null.  One row
of the input names one database; a task streams its sessions, so memory holds one session's rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import sqlite3
from collections.abc import Iterator
from contextlib import closing

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.sources.discovery import LINES_SCHEMA, _batch

FINGERPRINTS_SCHEMA = "path string, kind string, session_id string, fingerprint string"


def _connect(path: str) -> sqlite3.Connection:
    db = sqlite3.connect(f"file:{path}?mode=ro", uri=True, timeout=0.4)
    db.row_factory = sqlite3.Row
    return db


def _columns(db: sqlite3.Connection, table: str) -> set[str]:
    return {r["name"] for r in db.execute(f"PRAGMA table_info({table})")}


def _select(db: sqlite3.Connection, table: str, names: tuple[str, ...], rest: str, args: tuple = ()) -> list[dict]:
    there = _columns(db, table)
    cols = ", ".join(n if n in there else f"NULL AS {n}" for n in names)
    return [dict(r) for r in db.execute(f"SELECT {cols} FROM {table} {rest}", args)]


def _filter(db: sqlite3.Connection, table: str, column: str, condition: str) -> str:
    return condition if column in _columns(db, table) else "1 = 1"


def safe_name(session: str) -> str:
    return re.sub(r"[^A-Za-z0-9._-]", "_", session)


def virtual_path(database: str, kind: str, session: str) -> str:
    """The path of a session's virtual file: sessions of two databases, or names that differ in odd characters only, stay apart."""
    mark = hashlib.sha256(f"{database}\0{session}".encode()).hexdigest()[:12]
    return f"/spool/{kind}/{safe_name(session)}-{mark}.jsonl"


def hermes_sessions(db: sqlite3.Connection) -> Iterator[tuple[str, str, list[dict]]]:
    """(session, fingerprint, records) of sessions that aren't archived, with their active messages."""
    live = _filter(db, "sessions", "archived", "coalesce(archived, 0) = 0")
    for s in _select(db, "sessions", ("id", "source", "model", "cwd", "title", "parent_session_id", "started_at", "rewind_count"), f"WHERE {live} ORDER BY id"):
        active = _filter(db, "messages", "active", "coalesce(active, 1) = 1")
        rows = _select(db, "messages", ("id", "role", "content", "tool_calls", "tool_call_id", "tool_name", "timestamp", "token_count"), f"WHERE session_id = ? AND {active} ORDER BY id", (s["id"],))
        last = max((r["timestamp"] or 0 for r in rows), default=0)
        mark = f"{max((r['id'] for r in rows), default=0)}:{len(rows)}:{last}:{s['rewind_count'] or 0}:{s['title'] or ''}"
        meta = {"type": "session_meta", "session_id": s["id"], **{k: s[k] for k in ("source", "cwd", "title", "model", "parent_session_id", "started_at")}}
        yield str(s["id"]), mark, [meta, *({"type": "message", **{k: v for k, v in r.items() if k != "id"}} for r in rows)]


def opencode_sessions(db: sqlite3.Connection) -> Iterator[tuple[str, str, list[dict]]]:
    """(session, fingerprint, records): parts in order, each with its message's role and model (a left join)."""
    live = _filter(db, "session", "time_archived", "time_archived IS NULL")
    for s in _select(db, "session", ("id", "directory", "title", "model", "parent_id", "time_created"), f"WHERE {live} ORDER BY id"):
        messages = {m["id"]: json.loads(m["data"] or "{}") for m in _select(db, "message", ("id", "data"), "WHERE session_id = ?", (s["id"],))}
        parts = _select(db, "part", ("id", "message_id", "data", "time_created", "time_updated"), "WHERE session_id = ? ORDER BY time_created, id", (s["id"],))
        mark = f"{max((p['id'] for p in parts), default='')}:{len(parts)}:{max((p['time_updated'] or 0 for p in parts), default=0)}:{s['title'] or ''}"
        model = s["model"]
        if isinstance(model, str) and model.startswith("{"):
            model = json.loads(model).get("id") or json.loads(model).get("modelID")
        records = [{"type": "session_meta", "session_id": s["id"], "cwd": s["directory"], "title": s["title"], "model": model, "parent_session_id": s["parent_id"], "started_at": s["time_created"]}]
        for p in parts:
            m = messages.get(p["message_id"], {})
            records.append({"type": "part", "part_id": p["id"], "message_id": p["message_id"], "message_role": m.get("role"), "model": m.get("modelID"), "ts": p["time_created"], "data": json.loads(p["data"] or "{}")})
        yield str(s["id"]), mark, records


READERS = {"hermes": hermes_sessions, "opencode": opencode_sessions}


def read_sessions(spark: SparkSession, databases: list[tuple[str, str]], wanted: DataFrame | None = None) -> DataFrame:
    """Lines (as of ``read_lines``) of the sessions of (path, kind) databases; of those alone whose virtual path ``wanted`` (path) names."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with closing(_connect(path)) as db:
                    for session, _, records in READERS[kind](db):
                        rows, at = [], 0
                        for n, r in enumerate(records, 1):
                            raw = json.dumps(r, ensure_ascii=False)
                            rows.append((virtual_path(path, kind, session), kind, n, at, at + len(raw.encode()) + 1, raw, False))
                            at = rows[-1][4]
                        yield _batch(rows)

    lines = spark.createDataFrame(databases, "path string, kind string").repartition(max(1, len(databases))).mapInArrow(task, LINES_SCHEMA)
    return lines if wanted is None else lines.join(wanted.select("path"), "path", "left_semi")


def fingerprints(spark: SparkSession, databases: list[tuple[str, str]]) -> DataFrame:
    """path (virtual), kind, session_id, fingerprint of each session: what tells a changed session from a known one."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with closing(_connect(path)) as db:
                    rows = [(virtual_path(path, kind, s), kind, s, mark) for s, mark, _ in READERS[kind](db)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["path", "kind", "session_id", "fingerprint"])

    return spark.createDataFrame(databases, "path string, kind string").repartition(max(1, len(databases))).mapInArrow(task, FINGERPRINTS_SCHEMA)


def changed_sessions(known: DataFrame, found: DataFrame) -> DataFrame:
    """Sessions that are new or whose fingerprint moved."""
    k = known.select("path", "session_id", F.col("fingerprint").alias("__known"))
    return found.join(k, ["path", "session_id"], "left").where(~F.col("fingerprint").eqNullSafe(F.col("__known"))).drop("__known")

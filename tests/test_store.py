"""The store: crashes between any two writes, locks left behind, sessions of databases, and searches by postings."""

import os
import shutil
import sqlite3
import time

import pytest
from pyspark.sql import functions as F
from test_ingest import CLAUDE, PATH, log, said

from threadmill.functions import grammar as G
from threadmill.operators import search
from threadmill.plans import engine as E
from threadmill.streaming import incremental as R

COLUMNS = ("conversation_id", "turn_index", "exchange_ordinal", "role", "text", "tool_status", "input", "output")
NAMES = [f".claude/projects/-home-u-src-proj/{i}.jsonl" for i in range(5)]


def rows(engine, name="turns", columns=COLUMNS):
    return sorted(str(r) for r in engine.table(name).select(*columns).collect())


def test_a_crash_between_writes_loses_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "BUCKETS", 2)  # conversations share buckets
    home, store = f"{tmp_path}/home", f"{tmp_path}/store"
    for i, n in enumerate(NAMES):
        log(home, n, [said("user", f"prompt {i} of many", "00:00"), said("assistant", f"answer {i}", "00:01")])
    e = E.Engine(spark, store, home)
    e.sync()
    first = rows(e)
    assert len(first) == 10
    log(home, NAMES[0], [said("user", "prompt 0 of many", "00:00"), said("assistant", "answer 0", "00:01"), said("user", "more", "00:02")])
    os.remove(f"{home}/{NAMES[1]}")
    log(home, PATH, CLAUDE)
    replace, whole, publish = R.Refresh.replace, R.Refresh.whole, R.Files.publish

    class Crash(Exception):
        pass

    def crashing(f, at, after):
        calls = [0]

        def run(*args, **more):
            calls[0] += 1
            if calls[0] == at and not after:
                raise Crash
            out = f(*args, **more)
            if calls[0] == at:
                raise Crash
            return out

        return run

    # before and after the scan's record, around the first, a middle and the last table, and before the manifest
    for owner, name, f, at, after in [(R.Refresh, "whole", whole, 1, True), (R.Refresh, "replace", replace, 1, False), (R.Refresh, "replace", replace, 4, True), (R.Refresh, "replace", replace, len(E.TABLES), True), (R.Files, "publish", publish, 1, False)]:
        with monkeypatch.context() as m:
            m.setattr(owner, name, crashing(f, at, after))
            with pytest.raises(Crash):
                e.sync()
        assert rows(E.Engine(spark, store, home)) == first
    assert e.sync() == {"new": 1, "changed": 1, "removed": 1}
    whole_parse = E.Engine(spark, f"{tmp_path}/anew", home)
    whole_parse.sync()
    assert rows(e) == rows(whole_parse) and len(rows(e)) == 2 * 3 + 3 + 7
    for t in ("exchanges", "conversations", "git_ops", "search_docs", "postings"):
        assert e.table(t).count() == whole_parse.table(t).count() > 0
    assert e.sync() == {"new": 0, "changed": 0, "removed": 0}
    assert len(os.listdir(f"{e.store}/data")) == 2  # this state's generation and the one before it, which still holds buckets
    # a full refresh drops what vanished, and a store of many generations is written anew
    os.remove(f"{home}/{NAMES[2]}")
    e.sync(full=True)
    assert "prompt 2" not in str(rows(e)) and len(rows(e)) == 14


def test_many_generations_become_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "GENERATIONS", 2)
    store = R.Store(spark, f"{tmp_path}/s")
    none = spark.createDataFrame([], "conversation_id string")
    for i in range(4):
        r = store.begin(4)
        r.replace("t", spark.createDataFrame([(f"c{i}", i), ("same", i)], "conversation_id string, v int"), none)
        r.commit()
    got = sorted((r[0], r[1]) for r in store.read("t").select("conversation_id", "v").collect())
    assert got == [("c0", 0), ("c1", 1), ("c2", 2), ("c3", 3), ("same", 3)]
    assert len(store.manifest()["tables"]["t"]["generations"]) <= 2
    assert all(R.bucket_number(c, 4) == b for c, b in store.read("t").select("conversation_id", "bucket").collect())
    late = store.begin(4)
    late.replace("t", spark.createDataFrame([("x", 1)], "conversation_id string, v int"), none)
    other = store.begin(4)
    other.replace("t", spark.createDataFrame([("y", 1)], "conversation_id string, v int"), none)
    other.commit()
    with pytest.raises(RuntimeError):
        late.commit()
    assert store.read("t").where("conversation_id = 'y'").count() == 1


def test_a_lock_left_by_a_crash_expires(spark, tmp_path):
    path = f"{tmp_path}/writer.lock"
    left = R.WriterLock(spark, path, expiry=3600)
    left.__enter__()
    left._done.set()  # the process died: nobody renews it
    with R.WriterLock(spark, path, expiry=3600) as second:
        assert left.held and not second.held
    os.utime(path, (time.time() - 7200,) * 2)
    with R.WriterLock(spark, path, expiry=3600) as third:
        assert third.held
    assert not os.path.exists(path)
    with R.WriterLock(spark, path, expiry=1.5) as renewed:
        time.sleep(2.5)
        with R.WriterLock(spark, path, expiry=1.5) as late:
            assert renewed.held and not late.held


def _database(path, sessions):
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE IF NOT EXISTS session(id, directory, title, model, parent_id, time_created, time_archived)")
    db.execute("CREATE TABLE IF NOT EXISTS message(id, session_id, data)")
    db.execute("CREATE TABLE IF NOT EXISTS part(id, message_id, session_id, data, time_created, time_updated)")
    for s, text in sessions:
        db.execute("INSERT INTO session VALUES (?, '/w', ?, NULL, NULL, 1783072800000, NULL)", (s, f"T {s}"))
        db.execute("INSERT INTO message VALUES (?, ?, '{\"role\":\"user\"}')", (f"m{s}", s))
        db.execute("INSERT INTO part VALUES (?, ?, ?, ?, 1783072800000, 1783072800000)", (f"p{s}", f"m{s}", s, '{"type":"text","text":"' + text + '"}'))
    db.commit()
    return db


def test_sessions_of_databases_follow_their_fingerprints(spark, tmp_path, monkeypatch):
    one, two = f"{tmp_path}/one.db", f"{tmp_path}/two.db"
    a = _database(one, [("s", "hello one"), ("a/b", "slash"), ("a_b", "line")])
    _database(two, [("s", "hello two")]).close()
    e = E.Engine(spark, f"{tmp_path}/store", databases=[(one, "opencode"), (two, "opencode")])
    assert e.sync() == {"new": 4, "changed": 0, "removed": 0}
    assert sorted(r["text"] for r in e.table("turns").collect()) == ["hello one", "hello two", "line", "slash"]
    assert e.sync() == {"new": 0, "changed": 0, "removed": 0}
    a.execute("UPDATE session SET time_archived = 1 WHERE id = 'a/b'")
    a.execute("UPDATE session SET title = 'new' WHERE id = 's'")
    a.commit()
    assert e.sync() == {"new": 0, "changed": 1, "removed": 1}
    assert sorted(r["title"] for r in e.table("conversations").collect()) == ["T a_b", "T s", "new"]


def test_postings_find_what_a_scan_finds(spark, tmp_path):
    docs = [("a", 0, "the quick brown fox the quick"), ("a", 1, "quick the"), ("b", 0, "the the the quick brown"), ("c", 0, ""), ("d", 0, "Brown FOX"), ("d", 1, None), ("e", 0, "quick brown fox quick brown fox " * 40)]
    from threadmill.functions import textsearch as X

    d = spark.createDataFrame(docs, "conversation_id string, turn_index bigint, text string").withColumn("tokens", X.analyze(F.col("text"))).withColumn("length", F.size("tokens"))
    none = F.lit(None).cast("string")
    d = d.withColumns({"visible": F.lit(True), "origin": F.lit("interactive"), "ts_ms": F.lit(0).cast("bigint"), "facets": F.array(F.lit("tool:x")), "files": F.array().cast("array<string>")} | {c: none for c in ("cwd", "project", "provider", "model", "role", "source_path")})
    folder = f"{tmp_path}/p"
    search.postings(d).sortWithinPartitions("term").write.parquet(folder)
    index = spark.read.parquet(folder)
    for q in ("quick", "the quick", '"the quick"', '"the the"', '"quick brown fox" quick', '"fox quick brown"', "absent", "tool:x quick", "tool:y quick"):
        plain, by_index = (sorted((r["conversation_id"], r["turn_index"], round(r["score"], 9)) for r in search.scored(d, G.parse_query(q), 0, index=i).collect()) for i in (None, index))
        assert plain == by_index, q
    plan = search.scored(d, G.parse_query("quick"), 0, index=index)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,quick)" in plan
    shutil.rmtree(folder)

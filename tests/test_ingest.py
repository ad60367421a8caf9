"""Session logs from files and databases to tables, and their refresh."""

import json
import os
import sqlite3

import pytest

from threadmill.functions import grammar as G
from threadmill.plans.engine import Engine
from threadmill.streaming import incremental as R
from threadmill.sources import discovery, normalize, records, sqlite


def log(home, path, rows):
    full = f"{home}/{path}"
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "w") as f:
        f.write("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))
    return full


def said(role, content, at, **more):
    return {"type": role, "timestamp": f"2026-07-01T10:{at}Z", "cwd": "/home/u/src/proj", "message": {"role": role, "content": content, **more}}


CLAUDE = [
    said("user", "Fix the reader", "00:00"),
    said("assistant", [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "ok"}], "00:05", id="m1", model="model-1", usage={"input_tokens": 5, "output_tokens": 7, "cache_read_input_tokens": 100}),
    said("assistant", [{"type": "tool_use", "id": "t1", "name": "Bash", "input": {"command": "git commit -m x"}}], "00:06", id="m1", usage={"input_tokens": 5, "output_tokens": 7}),
    said("user", [{"type": "tool_result", "tool_use_id": "t1", "is_error": True, "content": "[main abc1234] x"}], "00:07"),
    "not json",
    said("user", "[Request interrupted by user]", "01:00"),
    {"type": "ai-title", "aiTitle": "Reader fix"},
    {"type": "summary", "summary": "another title"},
    said("user", "<task-notification><task-id>9</task-id><summary>done</summary></task-notification>", "01:30"),
    said("user", "next", "02:00"),
]
PATH = ".claude/projects/-home-u-src-proj/a.jsonl"


def parse(spark, home):
    notes = normalize.annotate(records.emit(discovery.read_lines(spark, discovery.discover(spark, home))))
    turns = normalize.turns(notes)
    return [r.asDict() for r in turns.orderBy("path", "turn_index").collect()], {r["provider"]: r.asDict() for r in normalize.conversations(notes, turns).collect()}


def test_claude(spark, tmp_path):
    log(tmp_path, PATH, CLAUDE)
    t, c = parse(spark, str(tmp_path))
    assert [x["role"] for x in t] == ["user", "assistant", "tool", "tool", "system", "system", "user"]
    assert [x["exchange_ordinal"] for x in t] == [0, 0, 0, 0, 0, 0, 1]
    assert t[1]["text"] == "hm\nok" and (t[1]["input"], t[1]["output"], t[1]["cache_read"]) == (5, 7, 100)
    assert t[2]["tool_status"] == "failed" and t[2]["command"] == "git commit -m x"
    assert t[4]["special_kind"] == "turn_aborted" and t[4]["aborted_user_turn"] == 0
    assert t[5]["special_kind"] == "task_notification" and t[5]["visible"]
    c = c["claude"]
    assert (c["title"], c["malformed_lines"], c["exchange_count"], c["model"], c["normalized_project"]) == ("Reader fix", 1, 2, "model-1", "-home-u-src-proj")


def test_byte_offsets():
    raw = b'{"a":1}\r\n\n  \n{"b":2}'
    assert list(discovery.lines_of(raw)) == [(1, 0, 9, b'{"a":1}'), (4, 13, 20, b'{"b":2}')]
    assert list(discovery.lines_of(b"xxxxx\ny\n", cap=3)) == [(1, 0, 6, None), (2, 6, 8, b"y")]


def codex(kind, **payload):
    return {"timestamp": "2026-07-03T10:00:00Z", "type": kind, "payload": payload}


def test_codex(spark, tmp_path):
    usage = lambda i, c, o: codex("event_msg", type="token_count", info={"total_token_usage": {"input_tokens": i, "cached_input_tokens": c, "output_tokens": o}})
    log(
        tmp_path, ".codex/sessions/2026/07/03/b.jsonl",
        [
            codex("session_meta", cwd="/home/u/src/proj"), codex("turn_context", turn_id="T1", model="m-x"), codex("response_item", type="message", role="user", content=[{"type": "input_text", "text": "do it"}]), usage(300, 100, 10),
            codex("response_item", type="function_call", name="shell", arguments='{"cmd":"cargo test"}', call_id="c1"), codex("response_item", type="function_call_output", call_id="c1", output="Process exited with code 1"),
            codex("response_item", type="message", role="assistant", content=[{"type": "output_text", "text": "failed"}]), usage(500, 150, 40),
            codex("response_item", type="function_call", name="shell", arguments='{"cmd":"rm x"}', call_id="c2"), codex("event_msg", type="tool_rejected", call_id="c2"), codex("event_msg", type="turn_aborted", reason="user_interrupt", turn_id="T1"),
        ],
    )
    t, c = parse(spark, str(tmp_path))
    answer = next(x for x in t if x["role"] == "assistant")
    assert (answer["input"], answer["cache_read"], answer["output"]) == (350, 150, 40)
    assert [x["tool_status"] for x in t if x["tool_direction"] == "use"] == ["failed", "rejected"]
    assert t[-1]["aborted_user_turn"] == 0 and t[-1]["abort_reason"] == "user_interrupt"
    assert c["codex"]["origin"] == "interactive" and c["codex"]["cwd"] == "/home/u/src/proj"


def test_other_providers(spark, tmp_path):
    log(tmp_path, ".cursor/projects/home-u/agent-transcripts/c.jsonl", [{"role": "user", "message": {"content": [{"type": "text", "text": "<timestamp>Wednesday, May 27, 2026, 9:06 PM (UTC)</timestamp>\n<user_query>hi</user_query>"}]}}])
    log(tmp_path, ".grok/sessions/%2Fhome%2Fu%2Fproj/s/chat_history.jsonl", [{"type": "system", "content": "You are Grok 4.3 released"}, {"type": "user", "content": "<user_query>go</user_query>"}, {"type": "assistant", "content": "ok", "tool_calls": [{"id": "1", "name": "run_terminal_command", "arguments": '{"command":"ls"}'}]}, {"type": "tool_result", "tool_call_id": "1", "content": "x", "is_error": True}])
    t, c = parse(spark, str(tmp_path))
    by = {k: [x for x in t if x["kind"] == k] for k in ("cursor", "grok")}
    assert (by["cursor"][0]["text"], by["cursor"][0]["ts_ms"]) == ("hi", 1779915960000)
    assert [x["tool_name"] for x in by["grok"]] == [None, None, None, "run_terminal_cmd", "tool_result"] and by["grok"][3]["tool_status"] == "failed"
    assert c["grok"]["model"] == "grok-4.3" and c["grok"]["cwd"] == "/home/u/proj"


def test_sqlite_sessions(spark, tmp_path):
    path = f"{tmp_path}/h.db"
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE sessions(id, model, title, started_at)")
    db.execute("CREATE TABLE messages(id INTEGER, session_id, role, content, tool_calls, tool_call_id, tool_name, timestamp, token_count)")
    db.execute("INSERT INTO sessions VALUES ('s1', 'm', 'T', 1.0)")
    db.execute("INSERT INTO messages VALUES (1, 's1', 'user', 'hello', NULL, NULL, NULL, 1783072800.5, NULL), (2, 's1', 'assistant', 'hi', '[{\"id\":\"a\",\"function\":{\"name\":\"run\",\"arguments\":\"{\\\"command\\\":\\\"ls\\\"}\"}}]', NULL, NULL, 1783072801, 9)")
    db.commit()
    lines = sqlite.read_sessions(spark, [(path, "hermes")])
    notes = normalize.annotate(records.emit(lines))
    t = normalize.turns(notes).orderBy("turn_index").collect()
    assert [x["role"] for x in t] == ["user", "assistant", "tool"] and t[1]["output"] == 9 and t[0]["ts_ms"] == 1783072800500
    before = sqlite.fingerprints(spark, [(path, "hermes")]).collect()
    db.execute("UPDATE sessions SET title = 'U'")
    db.commit()
    after = sqlite.fingerprints(spark, [(path, "hermes")])
    assert sqlite.changed_sessions(spark.createDataFrame(before), after).count() == 1


def test_sync_and_queries(spark, tmp_path):
    home, store = f"{tmp_path}/home", f"{tmp_path}/store"
    log(home, PATH, CLAUDE)
    other = log(home, ".claude/projects/-home-u-src-proj/b.jsonl", [said("user", "second thing", "00:00"), said("assistant", "gone soon", "00:01")])
    e = Engine(spark, store, home)
    assert e.sync() == {"new": 2, "changed": 0, "removed": 0}
    assert e.sync() == {"new": 0, "changed": 0, "removed": 0}
    cid = e.table("turns").where("text = 'Fix the reader'").first()["conversation_id"]
    assert e.search("reader").first()["conversation_id"] == cid
    assert e.search("tool_cmd:git git_commit:abc1234567").count() == 1
    assert e.search("tool_mutating:true").count() == 1
    ops = e.git_ops(cid).collect()
    assert len(ops) == 1 and ops[0]["commits"] == ["abc1234"] and ops[0]["status"] == "failed"
    told = e.trajectory(commit="abc1234").first()
    assert (told["relevance"], told["origin"], told["title"], told["next_turn"], told["summary"]) == (2, False, "Reader fix", 2, "git commit -m x")
    assert e.trajectory("ABC1234ffff").first()["conversation_id"] == cid and f"{cid} --around 2" in told["inspect"]
    with pytest.raises(G.QueryError):
        e.trajectory()
    assert e.turns(f"{cid}#e2").first()["text"] == "next"
    assert e.ask(f"{cid}#e2").count() == 1 and e.ask("reader").first()["match_count"] == 1
    assert e.document_count() == 9 and e.notifications().count() == 1
    with R.WriterLock(spark, f"{e.store}/writer.lock") as lock:
        assert lock.held and e.sync() is None
    assert e.exchanges(failed=True).count() == 1 and e.exchanges(interrupted=True).count() == 1
    assert e.stats("daily").where("bucket = 'TOTAL'").first()["turns"] == 9
    log(home, PATH, [*CLAUDE, said("assistant", "done", "03:00")])
    os.remove(other)
    assert e.sync() == {"new": 0, "changed": 1, "removed": 1}
    assert e.table("turns").count() == 8 and e.conversations().count() == 1
    assert e.doctor().first()["files"] == 1


@pytest.mark.parametrize("cut", [7])
def test_growth_equals_full_parse(spark, tmp_path, cut):
    """Syncing a prefix and then the whole file gives the tables of one full parse."""
    rows = []
    for steps in ([cut, len(CLAUDE)], [len(CLAUDE)]):
        home, store = f"{tmp_path}/h{len(steps)}", f"{tmp_path}/s{len(steps)}"
        e = Engine(spark, store, home)
        for n in steps:
            log(home, PATH, CLAUDE[:n])
            e.sync()
        rows.append(sorted(str(r) for r in e.table("turns").select("turn_index", "exchange_ordinal", "role", "text", "tool_status", "input", "output").collect()))
    assert rows[0] == rows[1]

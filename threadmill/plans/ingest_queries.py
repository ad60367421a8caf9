"""Registered queries over literal log lines, one per source family, with the tables they must give."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.functions import columns as C
from threadmill.functions import grammar as G
from threadmill.operators import gitops
from threadmill.plans import views as V
from threadmill.plans.queries import _values, register
from threadmill.sources import discovery, normalize, records
from threadmill.streaming import exchange_state as ES

_HOME = "/home/u"
CLAUDE, CODEX, CURSOR = f"{_HOME}/.claude/projects/-home-u-src-proj/s1.jsonl", f"{_HOME}/.codex/sessions/2026/07/03/c1.jsonl", f"{_HOME}/.cursor/projects/home-u/agent-transcripts/t.jsonl"
GROK, HERMES, OPENCODE, GENERIC = f"{_HOME}/.grok/sessions/%2Fhome%2Fu%2Fproj/s/chat_history.jsonl", "/spool/hermes/h1.jsonl", "/spool/opencode/o1.jsonl", f"{_HOME}/logs/g.jsonl"
SUBAGENT = f"{_HOME}/.claude/projects/-home-u-src-proj/s1/subagents/a1.jsonl"


def _said(role, content, second, **more):
    return {"type": role, "timestamp": f"2026-07-01T10:00:{second:02d}Z", "cwd": "/home/u/src/proj", "message": {"role": role, "content": content, **more}}


def _codex(kind, **payload):
    return {"timestamp": "2026-07-03T10:00:00Z", "type": kind, "payload": payload}


def _total(i, c, o):
    return _codex("event_msg", type="token_count", info={"total_token_usage": {"input_tokens": i, "cached_input_tokens": c, "output_tokens": o}})


FILES: dict[str, list] = {
    CLAUDE: [
        _said("user", "Fix the reader", 0), _said("assistant", [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "ok"}], 5, id="m1", model="model-1", usage={"input_tokens": 5, "output_tokens": 7}),
        _said("assistant", [{"type": "tool_use", "id": "t1", "name": "Bash", "input": {"command": "git commit -m x"}}], 6, id="m1", usage={"input_tokens": 5, "output_tokens": 7}),
        _said("user", [{"type": "tool_result", "tool_use_id": "t1", "is_error": True, "content": "[main abc1234] x"}], 7), "broken", _said("user", "[Request interrupted by user]", 8),
        {"type": "ai-title", "aiTitle": "Reader"}, {"type": "summary", "summary": "later"}, _said("user", "<system-reminder>x</system-reminder>", 9), _said("assistant", [{"type": "tool_use", "id": "t2", "name": "Edit", "input": {"file_path": "src/a.py"}}], 10), _said("user", "next", 11),
    ],
    SUBAGENT: [_said("user", "look", 1)],
    CODEX: [
        _codex("session_meta", cwd="/home/u/src/proj"), _codex("turn_context", turn_id="T1", model="m-x"), _codex("response_item", type="message", role="user", content=[{"type": "input_text", "text": "do it"}]), _total(300, 100, 10),
        _codex("response_item", type="function_call", name="shell", arguments='{"cmd":"cargo test"}', call_id="c1"), _codex("response_item", type="function_call_output", call_id="c1", output="Process exited with code 1"),
        _codex("response_item", type="message", role="assistant", content=[{"type": "output_text", "text": "failed"}]), _total(500, 150, 40), _codex("response_item", type="function_call", name="shell", arguments='{"cmd":"rm x"}', call_id="c2"),
        _codex("event_msg", type="tool_rejected", call_id="c2"), _codex("event_msg", type="turn_aborted", reason="user_interrupt", turn_id="T1"), _codex("compacted"),
    ],
    CURSOR: [{"role": "user", "message": {"content": [{"type": "text", "text": "<timestamp>Wednesday, May 27, 2026, 9:06 PM (UTC)</timestamp>\n<user_query>hi</user_query>"}]}}, {"role": "assistant", "message": {"content": "yo"}}],
    GROK: [{"type": "system", "content": "You are Grok 4.3 now"}, {"type": "user", "content": "<user_info>x</user_info>"}, {"type": "user", "content": "<user_query>go</user_query>"}, {"type": "assistant", "content": "ok", "tool_calls": [{"id": "1", "name": "run_terminal_command", "arguments": '{"command":"ls"}'}]}, {"type": "tool_result", "tool_call_id": "1", "content": "x", "is_error": True}],
    HERMES: [{"type": "session_meta", "cwd": "/w", "title": "H", "model": "hm", "parent_session_id": "p"}, {"type": "message", "role": "user", "content": "hello", "timestamp": 1783072800.5}, {"type": "message", "role": "assistant", "content": "hi", "token_count": 9, "timestamp": 1783072801, "tool_calls": '[{"id":"a","function":{"name":"run","arguments":"{\\"command\\":\\"ls\\"}"}}]'}, {"type": "message", "role": "tool", "content": "out", "tool_call_id": "a"}],
    OPENCODE: [
        {"type": "session_meta", "cwd": "/w", "title": "O"}, {"type": "part", "message_role": "user", "ts": 1783072800000, "data": {"type": "text", "text": "q"}}, {"type": "part", "message_role": "assistant", "model": "om", "ts": 1783072801000, "data": {"type": "text", "text": "a"}},
        {"type": "part", "message_role": "assistant", "ts": 1783072802000, "data": {"type": "tool", "tool": "bash", "callID": "k", "state": {"status": "error", "input": {"command": "x"}, "output": "bad"}}}, {"type": "part", "ts": 1783072803000, "data": {"type": "step-finish", "tokens": {"input": 3, "output": 4, "reasoning": 1, "cache": {"read": 2, "write": 1}}}},
    ],
    GENERIC: [{"role": "human", "text": "one", "time": 1783072800}, {"role": "model", "content": [{"type": "text", "text": "two"}]}, {"speaker": "watcher", "text": "three", "ts": "2026-07-03T10:00:05Z"}],
}


def _lines(spark: SparkSession, *paths: str) -> DataFrame:
    rows = [(p, n, x if isinstance(x, str) else json.dumps(x)) for p in paths for n, x in enumerate(FILES[p], 1)]
    df = spark.createDataFrame(rows, "path string, line bigint, raw string")
    kind = F.coalesce(discovery.provider_of(F.col("path")), F.lit("generic"))
    return df.select("path", kind.alias("kind"), "line", F.lit(0).cast("bigint").alias("byte_start"), F.lit(0).cast("bigint").alias("byte_end"), "raw", F.lit(False).alias("oversized"))


def _tables(spark, *paths):
    notes = normalize.annotate(records.emit(_lines(spark, *paths)))
    return notes, normalize.turns(notes)


_COLS = "kind, i, e, role, speaker, text, status, input, output, cache_read"


def _turn_query(name: str, paths: tuple[str, ...], want: list[tuple]) -> None:
    sql = f"SELECT kind, CAST(i AS BIGINT) AS turn_index, CAST(e AS BIGINT) AS exchange_ordinal, role, speaker, text, status AS tool_status, CAST(input AS BIGINT) AS input, CAST(output AS BIGINT) AS output, CAST(cache_read AS BIGINT) AS cache_read FROM {_values(want, _COLS)}"

    def run(spark: SparkSession, d: str) -> DataFrame:
        _, t = _tables(spark, *paths)
        return t.select("kind", "turn_index", "exchange_ordinal", "role", "speaker", "text", "tool_status", "input", "output", "cache_read")

    register(name, sql)(run)


_turn_query("claude_turns", (CLAUDE,), [
    ("claude", 0, 0, "user", "user", "Fix the reader", None, 0, 0, 0), ("claude", 1, 0, "assistant", "assistant", "hm\nok", None, 5, 7, 0), ("claude", 2, 0, "tool", "Bash", '{"command":"git commit -m x"}', "failed", 0, 0, 0),
    ("claude", 3, 0, "tool", "tool_result", "[main abc1234] x", "failed", 0, 0, 0), ("claude", 4, 0, "system", "turn_aborted", "Turn aborted: interrupted", None, 0, 0, 0), ("claude", 5, 0, "user", "user", "<system-reminder>x</system-reminder>", None, 0, 0, 0),
    ("claude", 6, 0, "tool", "Edit", '{"file_path":"src/a.py"}', "unknown", 0, 0, 0), ("claude", 7, 1, "user", "user", "next", None, 0, 0, 0),
])
_turn_query("codex_turns", (CODEX,), [
    ("codex", 0, 0, "user", "user", "do it", None, 0, 0, 0), ("codex", 1, 0, "tool", "shell", '{"cmd":"cargo test"}', "failed", 0, 0, 0), ("codex", 2, 0, "tool", "tool_result", "Process exited with code 1", "failed", 0, 0, 0),
    ("codex", 3, 0, "assistant", "assistant", "failed", None, 350, 40, 150), ("codex", 4, 0, "tool", "shell", '{"cmd":"rm x"}', "rejected", 0, 0, 0), ("codex", 5, 0, "system", "tool_rejected", "Tool rejected", "rejected", 0, 0, 0),
    ("codex", 6, 0, "system", "turn_aborted", "Turn aborted: user_interrupt", None, 0, 0, 0), ("codex", 7, 0, "system", "compaction", "Conversation compacted", None, 0, 0, 0),
])
_turn_query("cursor_grok_turns", (CURSOR, GROK), [
    ("cursor", 0, 0, "user", "user", "hi", None, 0, 0, 0), ("cursor", 1, 0, "assistant", "assistant", "yo", None, 0, 0, 0), ("grok", 0, 0, "system", "system", "You are Grok 4.3 now", None, 0, 0, 0), ("grok", 1, 0, "system", "system", "<user_info>x</user_info>", None, 0, 0, 0),
    ("grok", 2, 1, "user", "user", "go", None, 0, 0, 0), ("grok", 3, 1, "assistant", "assistant", "ok", None, 0, 0, 0), ("grok", 4, 1, "tool", "run_terminal_command", '{"command":"ls"}', "failed", 0, 0, 0), ("grok", 5, 1, "tool", "tool_result", "x", "failed", 0, 0, 0),
])
_turn_query("spool_turns", (HERMES, OPENCODE), [
    ("hermes", 0, 0, "user", "user", "hello", None, 0, 0, 0), ("hermes", 1, 0, "assistant", "assistant", "hi", None, 0, 9, 0), ("hermes", 2, 0, "tool", "run", '{"command":"ls"}', "succeeded", 0, 0, 0), ("hermes", 3, 0, "tool", "tool_result", "out", "succeeded", 0, 0, 0),
    ("opencode", 0, 0, "user", "user", "q", None, 0, 0, 0), ("opencode", 1, 0, "assistant", "assistant", "a", None, 3, 4, 2), ("opencode", 2, 0, "tool", "bash", '{"command":"x"}', "failed", 0, 0, 0), ("opencode", 3, 0, "tool", "tool_result", "bad", "failed", 0, 0, 0),
])
_turn_query("generic_turns", (GENERIC,), [("generic", 0, 0, "user", "user", "one", None, 0, 0, 0), ("generic", 1, 0, "assistant", "assistant", "two", None, 0, 0, 0), ("generic", 2, 0, "event", "watcher", "three", None, 0, 0, 0)])

_CONVS = [
    (CLAUDE, "claude", "Reader", "model-1", "/home/u/src/proj", "-home-u-src-proj", "interactive", 8, 2, 1), (SUBAGENT, "claude", "look", None, "/home/u/src/proj", "-home-u-src-proj", "subagent", 1, 1, 0), (CODEX, "codex", "do it", "m-x", "/home/u/src/proj", "-home-u-src-proj", "interactive", 8, 1, 0),
    (GROK, "grok", "go", "grok-4.3", "/home/u/proj", "-home-u-proj", "interactive", 6, 2, 0), (HERMES, "hermes", "H", "hm", "/w", "-w", "subagent", 4, 1, 0), (OPENCODE, "opencode", "O", "om", "/w", "-w", "interactive", 4, 1, 0),
]


@register("conversation_summaries", f"SELECT source_path, provider, title, model, cwd, normalized_project, origin, CAST(t AS BIGINT) AS turn_count, CAST(e AS BIGINT) AS exchange_count, CAST(m AS BIGINT) AS malformed_lines FROM {_values(_CONVS, 'source_path, provider, title, model, cwd, normalized_project, origin, t, e, m')}")
def conversation_summaries(spark, d):
    notes, t = _tables(spark, CLAUDE, SUBAGENT, CODEX, GROK, HERMES, OPENCODE)
    return normalize.conversations(notes, t).select("source_path", "provider", "title", "model", "cwd", "normalized_project", "origin", "turn_count", "exchange_count", "malformed_lines")


@register("subagent_parents", f"SELECT 'rg_' || substr(sha256('{SUBAGENT}'), 1, 24) AS child, '{CLAUDE}' AS parent_path")
def subagent_parents(spark, d):
    notes, t = _tables(spark, CLAUDE, SUBAGENT)
    c = normalize.conversations(notes, t)
    parents = c.select(F.col("conversation_id").alias("parent_conversation_id"), F.col("source_path").alias("parent_path"))
    return c.where("is_subagent").join(parents, "parent_conversation_id").select(F.col("conversation_id").alias("child"), "parent_path")


@register("turn_facet_tokens", "SELECT * FROM (VALUES (CAST(2 AS BIGINT), CAST(['git_cmd:commit', 'tool:bash', 'tool_cmd:git', 'tool_mutating:true', 'tool_status:failed'] AS VARCHAR[])), (3, ['tool_status:failed']), (4, ['is:interrupted']), (6, ['tool:edit', 'tool_status:unknown'])) v(turn_index, facets)")
def turn_facet_tokens(spark, d):
    _, t = _tables(spark, CLAUDE)
    return gitops.turn_facets(t).where(F.size("facets") > 0).select("turn_index", "facets")


@register("file_references", "SELECT CAST(6 AS BIGINT) AS turn_index, '/home/u/src/proj/src/a.py' AS path, 'mutate' AS mode")
def file_references(spark, d):
    _, t = _tables(spark, CLAUDE)
    return gitops.file_refs(t.drop("path").withColumnRenamed("path_arg", "path")).select("turn_index", "path", "mode")


@register("trajectory_commit", f"SELECT 'rg_' || substr(sha256('{CLAUDE}'), 1, 24) AS conversation_id, 'Reader' AS title, CAST(2 AS INT) AS relevance, false AS origin, CAST(1 AS BIGINT) AS matching_ops, CAST(2 AS BIGINT) AS next_turn, 'git commit -m x' AS summary, epoch_ms(TIMESTAMP '2026-07-01 10:00:00') AS first_seen")
def trajectory_commit(spark, d):
    notes, t = _tables(spark, CLAUDE, CODEX)
    found = t.select("conversation_id").distinct().withColumn("turn", F.lit(0).cast("bigint"))
    return gitops.trajectory(found, gitops.timeline(t), normalize.conversations(notes, t), commit="abc1234ff").drop("inspect")


@register("malformed_lines", f"SELECT '{CLAUDE}' AS path, CAST(5 AS BIGINT) AS line")
def malformed_lines(spark, d):
    return records.emit(_lines(spark, CLAUDE, CODEX)).where("malformed").select("path", "line")


@register("grammar_parse")
def grammar_parse(spark, d):
    asked = ['fix "the reader" tool_cmd:Cargo', "git_commit:ABCDEF1234 https://x.y", "since:2d project:@me", r"/a\s+b/ is:interrupted", '"open quote']
    rows = []
    for i, text in enumerate(asked):
        q = G.parse_query(text)
        rows.append((i, q.terms, q.phrases, [f"{k}:{v}" for k, v in q.facets], [f"{k}:{v}" for k, v in q.dates], q.regexes))
    return spark.createDataFrame(rows, "id int, terms array<string>, phrases array<string>, facets array<string>, dates array<string>, regexes array<string>")


@register("stream_exchange_state", f"WITH {V.TURNS_SQL} SELECT conversation_id, count(*) AS turns, CAST(count(*) FILTER (opens) AS BIGINT) AS exchanges, max(turn_index) FILTER (opens) AS open_turn FROM turns GROUP BY 1")
def stream_exchange_state(spark, d):
    schema = spark.read.parquet(f"{d}/conversations.parquet").schema
    source = spark.readStream.schema(schema).parquet(f"{d}/conversations.parque[t]")
    opens = C.opens_exchange(F.col("role"), F.col("text"), F.lit(None).cast("string"), F.lit(False))
    turns = source.select(C.stable_id(F.concat(F.lit("conv/"), F.col("conv_id").cast("string"))).alias("conversation_id"), F.col("turn").alias("turn_index"), F.coalesce(opens, F.lit(False)).alias("opens"))
    return ES.latest(ES.drain(ES.exchange_state(turns), ES.shared_folder(spark, "exchange-state")))

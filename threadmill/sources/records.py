"""One log record to rows: what it says about its file (signals) and the turns it holds.

Stateless: each JSON line is read alone, in Arrow batches, and every decision that depends on other
records (indexes, exchanges, inherited values, usage, pairing) is left to windows in ``normalize``.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from datetime import datetime, timezone
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

# name, Spark type; the columns of an emitted row. A record gives one signal row (emit_pos 0) and its turns (from 1).
COLUMNS = (
    ("path", "string"), ("kind", "string"), ("line", "bigint"), ("byte_start", "bigint"), ("byte_end", "bigint"), ("emit_pos", "int"), ("malformed", "boolean"), ("is_turn", "boolean"),
    ("rec_ts", "string"), ("rec_cwd", "string"), ("rec_model", "string"), ("rec_title", "string"), ("title_rank", "int"), ("rec_origin", "string"), ("rec_tag", "string"),
    ("role", "string"), ("speaker", "string"), ("text", "string"), ("own_ts_ms", "bigint"), ("tool_name", "string"), ("tool_direction", "string"), ("tool_status", "string"), ("pair_id", "string"), ("exit_code", "bigint"),
    ("command", "string"), ("file_path", "string"), ("path_arg", "string"), ("notebook_path", "string"), ("skill", "string"), ("input_fields", "map<string,string>"),
    ("special_kind", "string"), ("special_summary", "string"), ("special_status", "string"), ("signature", "string"), ("abort_reason", "string"), ("abort_tag", "string"), ("synthetic", "boolean"), ("content_image", "boolean"), ("tag", "string"), ("rejects_pair", "boolean"),
    ("usage_kind", "string"), ("message_id", "string"), ("u_input", "bigint"), ("u_output", "bigint"), ("u_cache_creation", "bigint"), ("u_cache_read", "bigint"), ("u_reasoning", "bigint"), ("estimated", "bigint"),
)
SCHEMA = ", ".join(f"{n} {t}" for n, t in COLUMNS)
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "map<string,string>": pa.map_(pa.string(), pa.string())}

# Record types without a conversation's content, keys that tool inputs keep, keys that may hold a time or a text.
CLAUDE_IGNORED = ("file-history-snapshot", "file-history-delta", "permission-mode", "mode", "last-prompt", "agent-name", "todos", "session-hook")
INPUT_KEYS = {
    "claude": ("command", "file_path", "path", "pattern", "prompt", "description", "query", "url", "cmd", "skill", "notebook_path"),
    "codex": ("cmd", "command", "workdir", "path", "file_path", "pattern", "query"),
    "grok": ("command", "target_directory", "path", "file_path", "pattern", "query"),
    "hermes": ("command", "cmd", "path", "file_path", "pattern", "query"),
    "opencode": ("command", "cmd", "filePath", "file_path", "path", "pattern", "query"),
}
TIME_KEYS = ("timestamp", "created_at", "createdAt", "time", "ts")
TEXT_KEYS = ("text", "content", "message", "summary", "result", "output")
REVIEW_MODEL = "codex-auto-review"

Obj = dict[str, Any]
Row = dict[str, Any]


def string(v: Any) -> str:
    if isinstance(v, str):
        return v.strip()
    if isinstance(v, bool):
        return "true" if v else "false"
    return "" if v is None or isinstance(v, (dict, list)) else json.dumps(v)


def count(v: Any) -> int:
    """A whole number of at least 0; texts of digits count, anything else is 0."""
    if isinstance(v, bool):
        return 0
    if isinstance(v, (int, float)):
        return max(0, int(v))
    return max(0, int(v)) if isinstance(v, str) and re.fullmatch(r"\s*-?\d+\s*", v) else 0


def whole(v: Any) -> int | None:
    if isinstance(v, bool) or v is None:
        return None
    if isinstance(v, (int, float)):
        return int(v)
    return int(v) if isinstance(v, str) and re.fullmatch(r"\s*-?\d+\s*", v) else None


def time_text(v: Any) -> str:
    """A time as text: numbers become whole milliseconds by their size (seconds, milliseconds, microseconds)."""
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        if not 0 < v < float("inf"):
            return ""
        return str(int(v * 1000 if v < 1e11 else v if v < 1e14 else v / 1000))
    return string(v)


def obj(v: Any) -> Obj | None:
    return v if isinstance(v, dict) else None


def compact(v: Any) -> str:
    return json.dumps(v, ensure_ascii=False, separators=(",", ":"))


def content_text(v: Any) -> str:
    """Any content as text: strings, lists joined by lines, and of objects the first key that holds text."""
    if isinstance(v, list):
        parts = [content_text(x) or (compact(x) if isinstance(x, dict) else "") for x in v]
        return "\n".join(p for p in parts if p).strip()
    if isinstance(v, dict):
        return next((t for k in TEXT_KEYS if k in v and (t := content_text(v[k]))), "")
    return string(v)


def role_of(v: Any) -> str:
    r = string(v).lower()
    return {"human": "user", "ai": "assistant", "model": "assistant", "developer": "system", "function": "tool"}.get(r, r)


def known_role(r: str) -> str:
    return r if r in ("user", "assistant", "tool", "system", "event") else "event"


def tagged(text: str, tag: str) -> str | None:
    m = re.search(rf"<{tag}>(.*?)</{tag}>", text, re.S | re.I)
    return m[1].strip() if m else None


def kept_inputs(kind: str, args: Any) -> Row:
    """The fields of a tool's input that are kept, also as columns."""
    fields = {("file_path" if k == "filePath" else k): (v if isinstance(v, str) else compact(v)) for k in INPUT_KEYS[kind] if isinstance(args, dict) and (v := args.get(k)) is not None}
    command = next((fields[k] for k in ("command", "cmd") if isinstance((args or {}).get(k), str) and fields.get(k, "").strip()), None)
    return {"input_fields": fields, "command": command, "file_path": fields.get("file_path"), "path_arg": fields.get("path"), "notebook_path": fields.get("notebook_path"), "skill": fields.get("skill")}


def parsed(text: str) -> Any:
    try:
        return json.loads(text)
    except ValueError:
        return None


def turn(role: str, text: str, speaker: str | None = None, **more: Any) -> Row:
    return {"role": role, "speaker": role if speaker is None else speaker, "text": text, **more}


def call(kind: str, name: str, text: str, pair: Any, args: Any, speaker: str | None = None, **more: Any) -> Row:
    return turn("tool", text, speaker or name, tool_name=name, tool_direction="use", tool_status="unknown", pair_id=string(pair) or None, **kept_inputs(kind, args), **more)


def result(text: str, pair: Any, status: str, name: str = "tool_result", **more: Any) -> Row:
    return {"estimated": len(text.encode()) // 4, **turn("tool", text, "tool_result", tool_name=name, tool_direction="output", tool_status=status, pair_id=string(pair) or None), **more}


def compaction() -> Row:
    return turn("system", "Conversation compacted", "compaction", special_kind="compact_boundary")


def aborted(reason: str, tag: str | None = None) -> Row:
    return turn("system", f"Turn aborted: {reason}", "turn_aborted", special_kind="turn_aborted", abort_reason=reason, abort_tag=tag)


def message_turns(role: str, message: Obj) -> Iterator[Row]:
    """Turns of a message's content: runs of text and thinking blocks are one turn; tool and image blocks stand alone."""
    content = message.get("content")
    if not isinstance(content, list):
        if text := content_text(content):
            yield turn(known_role(role), text, role)
        return
    run: list[str] = []
    for block in [*content, None]:
        kind = string(block.get("type")) if isinstance(block, dict) else ""
        alone = block is None or kind in ("tool_use", "tool_result", "image")
        if alone:
            if text := "\n".join(run).strip():
                yield turn(known_role(role), text, role)
            run = []
        if kind == "tool_use":
            given = block.get("input")
            text = (content_text(given) or compact(given)) if given is not None else compact(block)
            yield call("claude", string(block.get("name")) or "tool_use", text, block.get("id"), given)
        elif kind == "tool_result":
            own = len(content_text(block.get("content")).encode()) // 4
            yield result(content_text(block) or compact(block), block.get("tool_use_id"), "failed" if block.get("is_error") is True else "succeeded", estimated=own)
        elif kind == "image":
            yield turn(known_role(role), "[image]", role, content_image=True)
        elif not alone:
            run.append(string(block.get("thinking")) if kind == "thinking" else content_text(block))
            run = [x for x in run if x]


def special(t: Row, is_meta: bool, queue: str | None) -> Row:
    """Task notifications and scheduled prompts become system turns, so that they open no exchange."""
    if t.get("special_kind"):
        return t
    queued = queue is not None and queue.lower() in ("", "enqueue")
    text = t["text"].strip()
    sign = lambda kind, seed: f"{kind}{'-queued' * queued}:{hashlib.sha256(seed.encode()).hexdigest()[:16]}"
    m = re.fullmatch(r"<task-notification>(.*?)</task-notification>", text, re.S | re.I)
    if m:
        fields = {k: v for k in ("task-id", "tool-use-id", "output-file", "status", "summary", "result", "usage") if (v := tagged(m[1], k))}
        if fields:
            summary = fields.get("summary", "")
            seed = fields.get("task-id") or fields.get("tool-use-id") or summary or m[1]
            shown = f"Task queued: {summary}" if queued and summary else t["text"]
            return t | {"role": "system", "speaker": "task_notification", "text": shown, "special_kind": "task_notification" + "_queued" * queued, "special_summary": summary, "special_status": fields.get("status"), "signature": sign("task-notification", seed)}
    if text and (queued or is_meta and t["role"] == "user" and "<scheduled-task" in text.lower()):
        summary = text if len(text) <= 240 else text[:240] + "…"
        return t | {"role": "system", "speaker": "scheduled_prompt", "special_kind": "scheduled_prompt" + "_queued" * queued, "special_summary": summary, "signature": sign("scheduled-prompt", text)}
    return t


def attachment(a: Obj) -> Row | None:
    kind = string(a.get("type"))
    if kind in ("", "file-history-snapshot", "permission-mode"):
        return None
    speaker, text = "attachment", content_text(a) or compact(a)
    if kind in ("selected_lines_in_ide", "opened_file_in_ide"):
        first, last = whole(a.get("lineStart")) or 0, whole(a.get("lineEnd")) or 0
        place = string(a.get("displayPath")) or string(a.get("filename"))
        place += f":{first}" * (first > 0) + f"-{last}" * (first > 0 and last > first)
        speaker, text = "ide selection", "\n\n".join(x for x in (place, string(a.get("content"))) if x)
    elif kind in ("skill_listing", "deferred_tools_delta"):
        speaker, text = ("skills available" if kind == "skill_listing" else "tools available"), content_text(a)
    if not text.strip():
        return None
    return turn("tool", text, speaker, special_kind="attachment", special_summary=text[:160], synthetic=True)


def claude(r: Obj) -> Iterator[Row]:
    kind = string(r.get("type"))
    if (cwd := string(r.get("cwd"))).startswith("/"):
        yield {"rec_cwd": cwd}
    if kind in ("ai-title", "summary"):
        if title := string(r.get("aiTitle" if kind == "ai-title" else "summary")):
            yield {"rec_title": title, "title_rank": int(kind == "ai-title")}
    elif kind == "attachment":
        if (a := obj(r.get("attachment"))) and (t := attachment(a)):
            yield t
    elif kind == "queue-operation":
        if text := content_text(r):
            yield special(turn("system", text, "queue-operation"), False, string(r.get("operation")))
    elif kind in CLAUDE_IGNORED:
        return
    elif (m := obj(r.get("message"))) is None:
        if kind == "system":
            if string(r.get("subtype")) == "compact_boundary":
                yield compaction()
            elif text := content_text(r):
                yield turn("system", text)
    elif string(r.get("subtype")) == "compact_boundary":
        yield compaction()
    else:
        if (model := string(m.get("model"))) and model != "<synthetic>":
            yield {"rec_model": model}
        meta, used = r.get("isMeta") is True, obj(m.get("usage"))
        for t in message_turns(role_of(m.get("role")), m):
            if used is not None and t["role"] == "assistant":
                t |= {"usage_kind": "message", "message_id": string(m.get("id")), "u_input": count(used.get("input_tokens")), "u_output": count(used.get("output_tokens")), "u_cache_creation": count(used.get("cache_creation_input_tokens")), "u_cache_read": count(used.get("cache_read_input_tokens"))}
                used = None
            if meta and t["role"] == "user" and "<scheduled-task" not in t["text"].lower():
                t["synthetic"] = True
            if t["text"].strip() in ("[Request interrupted by user]", "[Request interrupted by user for tool use]"):
                t = aborted("interrupted")
            yield special(t, meta, None)


def cowork(r: Obj) -> Iterator[Row]:
    for t in claude(r):
        if t.get("rec_cwd"):
            t["rec_cwd"] = re.sub(r"^/sessions/[^/]+/mnt/", "/cowork/", t["rec_cwd"])
        yield t


def codex_model(p: Obj) -> str:
    inner = obj(p.get("collaboration_mode")) or {}
    return next((m for o in (p, obj(p.get("settings")) or {}, obj(inner.get("settings")) or {}) if (m := string(o.get("model")))), "")


def codex_status(p: Obj, text: str) -> tuple[str, int | None]:
    """(status, exit code): from metadata, else a JSON envelope in the text, else the exit message near its start."""
    envelope = obj(parsed(text)) or {}
    sources = [x for x in (obj(p.get("metadata")), obj(envelope.get("metadata")), envelope) if x]
    code = next((c for s in sources if (c := whole(s.get("exit_code"))) is not None), None)
    said = next((w for s in sources for k in ("status", "tool_status") if (w := string(s.get(k)))), "")
    if code is None and (m := re.search(r"Process exited with code (-?\d+)", text[:425])) and m.start() <= 375:
        code = int(m[1])
    if said in ("rejected", "failed", "error"):
        return ("rejected" if said == "rejected" else "failed"), code
    if code is None:
        return ("succeeded" if said in ("completed", "success", "succeeded", "ok") else "unknown"), None
    return ("succeeded" if code == 0 else "failed"), code


def codex(r: Obj) -> Iterator[Row]:
    kind, p = string(r.get("type")), obj(r.get("payload"))
    if kind == "compacted":
        yield compaction()
        return
    if p is None:
        return
    if kind in ("session_meta", "turn_context") and (cwd := string(p.get("cwd"))).startswith("/"):
        yield {"rec_cwd": cwd}
    if kind == "session_meta":
        source = (obj(p.get("source")) or {}).get("subagent")
        if source is not None or string(p.get("thread_source")) == "subagent":
            yield {"rec_origin": "auxiliary" if source is not None and "guardian" in compact(source) else "subagent"}
    elif kind == "turn_context":
        model = codex_model(p)
        yield {"rec_model": model or None, "rec_origin": "auxiliary" if model == REVIEW_MODEL else None, "rec_tag": string(p.get("turn_id")) or None}
    elif kind == "response_item":
        if model := codex_model(p):
            yield {"rec_model": model}
        what = string(p.get("type"))
        if what == "message" and (text := content_text(p.get("content"))).strip():
            role = role_of(p.get("role"))
            yield special(turn(known_role(role), text, role), False, None)
        elif what in ("function_call", "tool_call", "custom_tool_call", "web_search_call"):
            name = string(p.get("name")) or ("web_search" if what == "web_search_call" else what)
            text = string(p.get("arguments")) or string(p.get("input")) or (compact(p["action"]) if "action" in p else "") or compact(p)
            yield call("codex", name, text, p.get("call_id"), parsed(string(p.get("arguments"))), tag=string((obj(p.get("metadata")) or {}).get("turn_id")) or None)
        elif what in ("function_call_output", "tool_call_output", "custom_tool_call_output"):
            text = string(p.get("output")) or content_text(p.get("content")) or compact(p)
            status, code = codex_status(p, text)
            yield result(text, p.get("call_id"), status, exit_code=code)
    elif kind == "event_msg":
        what = string(p.get("type"))
        if what == "error":
            yield turn("system", string(p.get("message")) or compact(p), "error")
        elif what == "tool_rejected":
            pair = string(p.get("call_id")) or string(p.get("tool_call_id"))
            yield turn("system", string(p.get("message")) or "Tool rejected", "tool_rejected", tool_name="tool_rejected", tool_direction="output", tool_status="rejected", pair_id=pair or None, rejects_pair=True)
        elif what == "turn_aborted":
            yield aborted(string(p.get("reason")) or "aborted", string(p.get("turn_id")) or None)
        elif what == "context_compacted":
            yield compaction()
        elif what == "token_count" and (info := obj(p.get("info"))) is not None:
            u = obj(info.get("total_token_usage")) or {}
            cached = count(u.get("cached_input_tokens"))
            yield {"usage_kind": "total", "u_input": max(0, count(u.get("input_tokens")) - cached), "u_output": count(u.get("output_tokens")), "u_cache_creation": 0, "u_cache_read": cached, "u_reasoning": count(u.get("reasoning_output_tokens"))}


def cursor(r: Obj) -> Iterator[Row]:
    m = obj(r.get("message"))
    if m is None:
        return
    yield {"rec_model": "cursor"}
    for t in message_turns(role_of(r.get("role")) or role_of(m.get("role")), m):
        if t["role"] == "user" and (query := tagged(t["text"], "user_query")):
            try:
                at = datetime.strptime((tagged(t["text"], "timestamp") or "").replace(" (UTC)", ""), "%A, %B %d, %Y, %I:%M %p")
                t["own_ts_ms"] = int(at.replace(tzinfo=timezone.utc).timestamp() * 1000)
            except ValueError:
                pass
            t["text"] = query
        yield special(t, False, None)


def called(kind: str, c: Any, bare: str | None) -> Row | None:
    """A tool call of {name, arguments} or {function: {name, arguments}}."""
    if (c := obj(c)) is None:
        return None
    f = obj(c.get("function")) or {}
    name, args = string(c.get("name")) or string(f.get("name")), string(c.get("arguments")) or string(f.get("arguments"))
    tool = "run_terminal_cmd" if name == "run_terminal_command" else name
    text = args or (name if bare == "name" else compact(c))
    return call(kind, tool or ("tool_use" if bare == "name" else ""), text, c.get("id"), parsed(args), speaker=name or "tool_use")


def grok(r: Obj) -> Iterator[Row]:
    kind, text = string(r.get("type")), content_text(r.get("content"))
    if kind == "system":
        if m := re.search(r"You are Grok ([0-9.]*)", text):
            yield {"rec_model": "-".join(x for x in ("grok", m[1].rstrip(".")) if x)}
        if text:
            yield turn("system", text)
    elif kind == "user" and text:
        text = tagged(text, "user_query") or text
        made = string(r.get("synthetic_reason")) == "system_reminder" or text.lstrip().startswith(("<user_info>", "<system-reminder>"))
        yield special(turn("system" if made else "user", text, synthetic=made), False, None)
    elif kind == "assistant":
        if text.strip():
            yield turn("assistant", text)
        yield from (t for c in r.get("tool_calls") or [] if (t := called("grok", c, None)))
    elif kind == "tool_result":
        yield result(text, r.get("tool_call_id"), "failed" if r.get("is_error") is True else "succeeded")


def session_meta(r: Obj) -> Iterator[Row]:
    cwd = string(r.get("cwd"))
    yield {"rec_cwd": cwd if cwd.startswith("/") else None, "rec_title": string(r.get("title")) or None, "title_rank": 0, "rec_model": string(r.get("model")) or None, "rec_origin": "subagent" if string(r.get("parent_session_id")) else None}


def hermes(r: Obj) -> Iterator[Row]:
    if string(r.get("type")) == "session_meta":
        yield from session_meta(r)
    elif string(r.get("type")) == "message":
        role, text = string(r.get("role")), string(r.get("content"))
        if role in ("user", "system") and text:
            yield special(turn(role, text), False, None)
        elif role == "assistant":
            if text:
                yield turn("assistant", text, usage_kind="own", u_output=count(r.get("token_count")))
            calls = parsed(string(r.get("tool_calls")))
            yield from (t for c in (calls if isinstance(calls, list) else []) if (t := called("hermes", c, "name")))
        elif role == "tool":
            yield result(text, r.get("tool_call_id"), "succeeded", name=string(r.get("tool_name")) or "tool_result")


def opencode(r: Obj) -> Iterator[Row]:
    if string(r.get("type")) == "session_meta":
        yield from session_meta(r)
        return
    data = obj(r.get("data"))
    if string(r.get("type")) != "part" or data is None:
        return
    if model := string(r.get("model")):
        yield {"rec_model": model}
    what, role = string(data.get("type")), string(r.get("message_role"))
    if what == "text" and (text := string(data.get("text"))):
        yield special(turn(role if role in ("user", "assistant") else "event", text, role), False, None)
    elif what == "tool":
        name, state = string(data.get("tool")), obj(data.get("state")) or {}
        given, output, said = state.get("input"), string(state.get("output")), string(state.get("status"))
        code = whole((obj(state.get("metadata")) or {}).get("exit"))
        status = "failed" if said in ("error", "failed") or code not in (None, 0) else "succeeded" if code == 0 or said == "completed" else "unknown"
        yield call("opencode", name or "tool_use", name if given is None else compact(given), data.get("callID"), given)
        if output or status != "unknown":
            yield result(output, data.get("callID"), status, exit_code=code)
    elif what == "step-finish" and (u := obj(data.get("tokens"))) is not None:
        cache = obj(u.get("cache")) or {}
        yield {"usage_kind": "step", "u_input": count(u.get("input")), "u_output": count(u.get("output")), "u_reasoning": count(u.get("reasoning")), "u_cache_read": count(cache.get("read")), "u_cache_creation": count(cache.get("write"))}


def generic(r: Obj) -> Iterator[Row]:
    if (cwd := string(r.get("cwd"))).startswith("/"):
        yield {"rec_cwd": cwd}
    m = obj(r.get("message"))
    role = next((x for k in ("role", "speaker", "type") if (x := role_of(r.get(k)))), "") or role_of((m or {}).get("role"))
    if m is not None and "content" in m:
        for t in message_turns(role_of(m.get("role")) or role, m):
            yield special(t, False, None)
    elif text := content_text(r):
        yield special(turn(known_role(role), text, role), False, None)


PROVIDERS = {"claude": claude, "claude-cowork": cowork, "codex": codex, "cursor": cursor, "grok": grok, "hermes": hermes, "opencode": opencode, "generic": generic}


def record_rows(kind: str, raw: str | None) -> list[Row]:
    """The signal row and the turn rows of a line."""
    r = parsed(raw) if raw is not None else None
    if not isinstance(r, dict):
        return [{"malformed": True, "is_turn": False}]
    stamp = next((s for k in TIME_KEYS if (s := time_text(r.get(k)))), None)
    signal: Row = {"malformed": False, "is_turn": False, "rec_ts": stamp}
    turns: list[Row] = []
    for row in PROVIDERS.get(kind, generic)(r):
        if "text" in row:
            turns.append({"malformed": False, "is_turn": True, "rec_ts": stamp} | row)
        else:
            signal |= {k: v for k, v in row.items() if v is not None}
    return [signal, *turns]


#: Bytes of the lines that one batch parses, about.
BATCH_BYTES = 16 << 20


def emit(lines: DataFrame) -> DataFrame:
    """Rows of every line (see ``COLUMNS``), in Arrow batches of bounded bytes; nothing depends on another line."""
    lines.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[Row] = []
            for x in batch.to_pylist():
                for pos, row in enumerate(record_rows(x["kind"], x["raw"])):
                    rows.append({"path": x["path"], "kind": x["kind"], "line": x["line"], "byte_start": x["byte_start"], "byte_end": x["byte_end"], "emit_pos": pos} | row)
            arrays = []
            for name, kind in COLUMNS:
                values = [row.get(name) for row in rows]
                if kind.startswith("map"):
                    values = [None if v is None else list(v.items()) for v in values]
                arrays.append(pa.array(values, _ARROW[kind]))
            yield pa.RecordBatch.from_arrays(arrays, [n for n, _ in COLUMNS])

    return lines.mapInArrow(task, SCHEMA)

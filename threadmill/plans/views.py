"""The engine's tables over the driver's test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.functions import columns as C
from threadmill.functions import textsearch as X
from threadmill.operators import sequence as S

BASE_MS = 1_704_067_200_000
NOW_MS = 1_709_251_200_000  # 2024-03-01, the "now" of every registered query


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with exchanges from the conversations table; times are made from ids."""
    c = _table(spark, sf_dir, "conversations")
    none = lambda kind: F.lit(None).cast(kind)
    t = c.select(
        C.stable_id(F.concat(F.lit("conv/"), F.col("conv_id").cast("string"))).alias("conversation_id"), F.col("turn").cast("bigint").alias("turn_index"), "role", F.lit("").alias("speaker"), "text",
        (F.lit(BASE_MS) + F.col("conv_id") * 3_600_000 + F.col("turn") * 60_000).cast("bigint").alias("ts_ms"), none("string").alias("model"), none("string").alias("special_kind"), F.lit(False).alias("synthetic"),
        none("string").alias("tool_direction"), none("string").alias("tool_status"), *[F.lit(0).cast("bigint").alias(k) for k in C.TOKEN_KINDS[:5]], C.token_estimate(F.col("text")).alias("estimated"),
    )
    t = t.withColumn("visible", C.is_visible(F.col("role"), F.col("speaker"), F.col("text"), F.col("special_kind"), F.col("synthetic")))
    return S.segment_exchanges(t)


def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.exchange_rollup(turns(spark, sf_dir))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = S.conversation_rollup(turns(spark, sf_dir))
    project = F.concat(F.lit("-p"), F.substring("conversation_id", 4, 1))
    origin = F.when(F.substring("conversation_id", 5, 1) == "0", "auxiliary").otherwise("interactive")
    return c.withColumn("title", F.coalesce("first_line", "conversation_id")).withColumn("normalized_project", project).withColumn("origin", origin)


def tool_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("conversation_id"), F.col("event_id").alias("turn_index"), F.col("event_type").alias("tool"), F.when(F.col("event_type") == "error", "failed").otherwise("succeeded").alias("status"),
        F.col("event_type").alias("cmd_head"), F.col("event_type").isin("purchase", "signup").alias("mutating"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        F.when(F.col("event_type") == "purchase", "git_cmd:commit tool_cmd:git").when(F.col("event_type") == "signup", "git_cmd:push git_pr:create").alias("git_facets"), "value",
    )


def search_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of real work and one turn for each document, analyzed."""
    t = turns(spark, sf_dir)
    d = _table(spark, sf_dir, "documents")
    origin = F.when(F.substring("conversation_id", 5, 1) == "0", "auxiliary").otherwise("interactive")
    none = F.lit(None).cast("string")
    a = t.select("conversation_id", "turn_index", "exchange_ordinal", "ts_ms", "role", "visible", "text", F.array(F.concat(F.lit("tool:"), F.col("role"))).alias("facets"), F.array().cast("array<string>").alias("files"), none.alias("cwd"), F.lit("-chat").alias("project"), F.lit("claude").alias("provider"), none.alias("model"), origin.alias("origin"), F.lit("conversations").alias("source_path"))
    doc_id = C.stable_id(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")))
    b = d.select(doc_id.alias("conversation_id"), F.lit(0).cast("bigint").alias("turn_index"), F.lit(0).cast("bigint").alias("exchange_ordinal"), (F.lit(BASE_MS) + F.col("doc_id") * 60_000).cast("bigint").alias("ts_ms"), F.lit("user").alias("role"), F.lit(True).alias("visible"), "text", F.array(F.concat(F.lit("tool_cmd:"), F.col("lang")), F.lit("is:notification")).alias("facets"), F.array(F.concat(F.lit("/data/"), F.col("source"), F.lit(".txt"))).alias("files"), F.concat(F.lit("/home/u/"), F.col("lang")).alias("cwd"), F.col("source").alias("project"), F.col("lang").alias("provider"), F.concat(F.lit("Model-"), F.col("lang")).alias("model"), F.lit("interactive").alias("origin"), F.lit("documents").alias("source_path"))
    return a.unionByName(b).withColumn("tokens", X.analyze(F.col("text"))).withColumn("length", F.size("tokens"))


# The same tables in DuckDB SQL, as CTEs.
_KINDS = ", ".join(f"CAST(0 AS BIGINT) AS {k}" for k in C.TOKEN_KINDS[:5])
_INJECTED = " OR ".join(f"starts_with(ltrim(coalesce(text, ''), E' \\t\\n\\r'), '{p}')" for p in C.INJECTED_PREFIXES)
TURNS_SQL = f"""
base AS (
  SELECT 'rg_' || substr(sha256('conv/' || CAST(conv_id AS VARCHAR)), 1, 24) AS conversation_id, CAST(turn AS BIGINT) AS turn_index, role, text,
         CAST({BASE_MS} + conv_id * 3600000 + turn * 60000 AS BIGINT) AS ts_ms, {_KINDS}, CAST(strlen(coalesce(text, '')) // 4 AS BIGINT) AS estimated
  FROM conversations),
flags AS (
  SELECT *, coalesce(role = 'user' AND NOT ({_INJECTED}), false) AS opens,
         (role <> 'system') AND NOT ({_INJECTED}) AND regexp_matches(coalesce(text, ''), '\\S') AS visible FROM base),
turns AS (
  SELECT *, CAST(greatest(sum(CAST(opens AS INT)) OVER w - CAST(first(opens) OVER w AS INT), 0) AS BIGINT) AS exchange_ordinal
  FROM flags WINDOW w AS (PARTITION BY conversation_id ORDER BY turn_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
_SUMS = ", ".join(f"CAST(sum({k}) AS BIGINT) AS {k}" for k in C.TOKEN_KINDS)
_PREVIEW = "translate(CASE WHEN length(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) > 200 THEN substr(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g'), 1, 200) || '…' ELSE regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') END, chr(10), ' ')"
EXCHANGES_SQL = f"""{TURNS_SQL},
exchanges AS (
  SELECT conversation_id, exchange_ordinal, min(turn_index) FILTER (opens) AS user_turn_index, min(turn_index) AS start_turn, max(turn_index) + 1 AS end_turn,
         min_by(ts_ms, turn_index) AS started_at, max_by(ts_ms, turn_index) AS ended_at, min_by({_PREVIEW}, turn_index) FILTER (opens) AS user_preview,
         count(*) FILTER (role = 'assistant') AS assistant_turns, CAST(0 AS BIGINT) AS tool_calls, CAST(0 AS BIGINT) AS failed_tool_calls, CAST(0 AS BIGINT) AS rejected_tool_calls,
         false AS has_error, false AS interrupted, false AS compacted, {_SUMS},
         CASE WHEN max_by(ts_ms, turn_index) >= min_by(ts_ms, turn_index) THEN max_by(ts_ms, turn_index) - min_by(ts_ms, turn_index) END AS duration_ms
  FROM turns GROUP BY ALL)"""
_LINE = "trim(regexp_extract(coalesce(text, ''), '(?m)^\\s*(\\S.*?)\\s*$', 1))"
CONVERSATIONS_SQL = f"""{TURNS_SQL},
convs AS (
  SELECT conversation_id, min(ts_ms) AS started_at, max(ts_ms) AS last_activity_at, count(*) AS turn_count, count(DISTINCT exchange_ordinal) AS exchange_count, CAST(NULL AS VARCHAR) AS model,
         min_by(CASE WHEN length({_LINE}) > 120 THEN substr({_LINE}, 1, 120) || '…' ELSE {_LINE} END, turn_index) FILTER (role = 'user' AND visible) AS first_line, {_SUMS}
  FROM turns GROUP BY conversation_id),
conversation_rows AS (
  SELECT *, coalesce(first_line, conversation_id) AS title, '-p' || substr(conversation_id, 4, 1) AS normalized_project,
         CASE WHEN substr(conversation_id, 5, 1) = '0' THEN 'auxiliary' ELSE 'interactive' END AS origin FROM convs)"""
TOOLS_SQL = """
tool_events AS (
  SELECT user_id AS conversation_id, event_id AS turn_index, event_type AS tool, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'succeeded' END AS status, event_type AS cmd_head,
         event_type IN ('purchase', 'signup') AS mutating, epoch_ms(ts) AS ts_ms,
         CASE event_type WHEN 'purchase' THEN 'git_cmd:commit tool_cmd:git' WHEN 'signup' THEN 'git_cmd:push git_pr:create' END AS git_facets FROM events)"""
DOCS_SQL = f"""{TURNS_SQL},
raw_docs AS (
  SELECT conversation_id, turn_index, exchange_ordinal, ts_ms, role, visible, text, ['tool:' || role] AS facets, CAST([] AS VARCHAR[]) AS files, CAST(NULL AS VARCHAR) AS cwd, '-chat' AS project, 'claude' AS provider,
         CAST(NULL AS VARCHAR) AS model, CASE WHEN substr(conversation_id, 5, 1) = '0' THEN 'auxiliary' ELSE 'interactive' END AS origin FROM turns
  UNION ALL
  SELECT 'rg_' || substr(sha256('doc/' || CAST(doc_id AS VARCHAR)), 1, 24), 0, 0, CAST({BASE_MS} + doc_id * 60000 AS BIGINT), 'user', true, text, ['tool_cmd:' || lang, 'is:notification'], ['/data/' || source || '.txt'],
         '/home/u/' || lang, source, lang, 'Model-' || lang, 'interactive' FROM documents),
docs AS (SELECT *, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS tokens FROM raw_docs)"""

"""The registered queries of the session engine, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadmill.functions import columns as C
from threadmill.functions import grammar as G
from threadmill.functions import shell
from threadmill.functions import textsearch as X
from threadmill.operators import gitops, search, stats
from threadmill.operators import sequence as S
from threadmill.plans import views as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
NOW = V.NOW_MS
EX = [*"conversation_id exchange_ordinal user_turn_index start_turn end_turn started_at ended_at user_preview assistant_turns tool_calls failed_tool_calls rejected_tool_calls has_error interrupted compacted".split(), *C.TOKEN_KINDS, "duration_ms"]
EXC = ", ".join(EX)
SUMS = ("input", "output", "cache_creation", "cache_read", "estimated")
SUM_SQL = ", ".join(f"CAST(sum({k}) AS BIGINT) AS {k}" for k in SUMS)


def register(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


# Exchanges and conversations


@register("exchange_rollup", f"WITH {V.EXCHANGES_SQL} SELECT {EXC} FROM exchanges")
def exchange_rollup(spark, d):
    return V.exchanges(spark, d).select(*EX)


@register("exchange_segmentation", f"WITH {V.TURNS_SQL} SELECT conversation_id, turn_index, opens, exchange_ordinal FROM turns")
def exchange_segmentation(spark, d):
    return V.turns(spark, d).select("conversation_id", "turn_index", "opens", "exchange_ordinal")


@register("exchange_preview", f"WITH {V.EXCHANGES_SQL} SELECT conversation_id, exchange_ordinal, user_preview FROM exchanges WHERE user_turn_index IS NOT NULL")
def exchange_preview(spark, d):
    return V.exchanges(spark, d).where("user_turn_index is not null").select("conversation_id", "exchange_ordinal", "user_preview")


_JOINED = f"WITH {V.EXCHANGES_SQL}, {V.CONVERSATIONS_SQL.replace(V.TURNS_SQL + ',', '')}, e AS (SELECT e.*, end_turn - start_turn AS turns, e.input + e.output + e.cache_creation + e.cache_read + e.estimated AS tokens, normalized_project FROM exchanges e JOIN conversation_rows c USING (conversation_id) WHERE origin <> 'auxiliary' AND user_turn_index IS NOT NULL)"


@register("exchange_filters", f"{_JOINED} SELECT conversation_id, exchange_ordinal, turns, duration_ms, normalized_project FROM e WHERE turns >= 2 AND duration_ms >= 60000 AND started_at >= {V.BASE_MS + 7_200_000} ORDER BY started_at DESC, conversation_id, exchange_ordinal LIMIT 50")
def exchange_filters(spark, d):
    e = stats.filter_exchanges(V.exchanges(spark, d), V.conversations(spark, d), min_turns=2, min_duration_ms=G.duration_ms("1m"), since=V.BASE_MS + 7_200_000, limit=50)
    return e.select("conversation_id", "exchange_ordinal", "turns", "duration_ms", "normalized_project")


for _by, _key in (("tokens", "tokens"), ("turns", "turns"), ("duration", "duration_ms"), ("tool_calls", "tool_calls")):

    def _top(spark, d, by=_by, key=_key):
        return stats.top_exchanges(V.exchanges(spark, d), V.conversations(spark, d), by=by, limit=10).select("conversation_id", "exchange_ordinal", key)

    register(f"top_exchanges_{_by}", f"{_JOINED} SELECT conversation_id, exchange_ordinal, {_key} FROM e ORDER BY {_key} DESC NULLS LAST, conversation_id, exchange_ordinal LIMIT 10")(_top)

_CV = ["conversation_id", "started_at", "last_activity_at", "turn_count", "exchange_count", *C.TOKEN_KINDS]


@register("conversation_rollup", f"WITH {V.CONVERSATIONS_SQL} SELECT {', '.join(_CV)} FROM conversation_rows")
def conversation_rollup(spark, d):
    return V.conversations(spark, d).select(*_CV)


@register("display_title", f"WITH {V.CONVERSATIONS_SQL} SELECT conversation_id, title FROM conversation_rows")
def display_title(spark, d):
    return V.conversations(spark, d).select("conversation_id", "title")


@register("recent_conversations", f"WITH {V.CONVERSATIONS_SQL} SELECT conversation_id, last_activity_at, turn_count FROM conversation_rows ORDER BY last_activity_at DESC, conversation_id LIMIT 20")
def recent_conversations(spark, d):
    return stats.recent(V.conversations(spark, d)).select("conversation_id", "last_activity_at", "turn_count")


@register("visible_turns", f"WITH {V.TURNS_SQL} SELECT role, visible, count(*) AS turns FROM turns GROUP BY ALL")
def visible_turns(spark, d):
    return V.turns(spark, d).groupBy("role", "visible").agg(F.count(F.lit(1)).alias("turns"))


@register("token_estimate", "SELECT doc_id, CAST(strlen(coalesce(text, '')) // 4 AS BIGINT) AS estimated FROM documents")
def token_estimate(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", C.token_estimate(F.col("text")).alias("estimated"))


@register("display_total_tokens", f"WITH {V.EXCHANGES_SQL} SELECT conversation_id, exchange_ordinal, CASE WHEN input + output + cache_creation + cache_read > 0 THEN input + output + cache_creation + cache_read ELSE estimated END AS total FROM exchanges")
def display_total_tokens(spark, d):
    return V.exchanges(spark, d).select("conversation_id", "exchange_ordinal", C.display_total().alias("total"))


# Statistics


@register("usage_hourly", f"WITH {V.TURNS_SQL} SELECT ts_ms // 3600000 AS hour, count(*) AS turns, count(DISTINCT conversation_id) AS conversations, {SUM_SQL} FROM turns GROUP BY 1")
def usage_hourly(spark, d):
    return stats.hourly(V.turns(spark, d))


def _bucket(x: str, period: str, zone: str) -> str:
    local = f"(make_timestamptz(({x} // 3600000) * 3600000000) AT TIME ZONE '{zone}')"
    return f"strftime({local}, '{ {'daily': '%Y-%m-%d', 'weekly': '%G-W%V', 'monthly': '%Y-%m'}[period] }')"


def _usage_sql(period: str, zone: str) -> str:
    return f"""WITH {V.EXCHANGES_SQL}, t AS (SELECT {_bucket("ts_ms", period, zone)} AS bucket, count(*) AS turns, count(DISTINCT conversation_id) AS conversations, {SUM_SQL} FROM turns GROUP BY 1),
x AS (SELECT {_bucket("started_at", period, zone)} AS bucket, count(*) AS exchanges FROM exchanges WHERE user_turn_index IS NOT NULL GROUP BY 1)
SELECT bucket, turns, conversations, coalesce(exchanges, 0) AS exchanges, {', '.join(SUMS)} FROM t LEFT JOIN x USING (bucket)"""


for _name, _period, _zone in (("usage_daily", "daily", "UTC"), ("usage_daily_tz", "daily", "America/New_York"), ("usage_daily_half_hour_zone", "daily", "Asia/Kolkata"), ("usage_weekly_iso", "weekly", "UTC"), ("usage_monthly", "monthly", "UTC")):

    def _usage(spark, d, period=_period, zone=_zone):
        return stats.usage(V.turns(spark, d), V.exchanges(spark, d), period, zone)

    register(_name, _usage_sql(_period, _zone))(_usage)

_TOTALS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("turns", "conversations", "exchanges", *SUMS))


@register("usage_total_rollup", f"SELECT bucket, turns, conversations, exchanges, {', '.join(SUMS)} FROM ({_usage_sql('daily', 'UTC')}) UNION ALL SELECT 'TOTAL', {_TOTALS} FROM ({_usage_sql('daily', 'UTC')})")
def usage_total_rollup(spark, d):
    return stats.with_total(stats.usage(V.turns(spark, d), V.exchanges(spark, d)))


_LOW, _HIGH = V.BASE_MS + 5 * 3_600_000 + 1_000, V.BASE_MS + 60 * 3_600_000 + 61_000


@register(
    "usage_since_until",
    f"""WITH {V.EXCHANGES_SQL}, n AS (SELECT {_bucket("ts_ms", "daily", "UTC")} AS bucket, count(*) AS turns, {SUM_SQL} FROM turns WHERE ts_ms >= {_LOW} AND ts_ms < {_HIGH} GROUP BY 1),
c AS (SELECT {_bucket("ts_ms", "daily", "UTC")} AS bucket, count(DISTINCT conversation_id) AS conversations FROM turns WHERE ts_ms >= {_LOW // 3600000 * 3600000} AND ts_ms < {_HIGH // 3600000 * 3600000} GROUP BY 1),
x AS (SELECT {_bucket("started_at", "daily", "UTC")} AS bucket, count(*) AS exchanges FROM exchanges WHERE user_turn_index IS NOT NULL AND started_at >= {_LOW} AND started_at < {_HIGH} GROUP BY 1)
SELECT bucket, turns, conversations, coalesce(exchanges, 0) AS exchanges, {', '.join(SUMS)} FROM n JOIN c USING (bucket) LEFT JOIN x USING (bucket)""",
)
def usage_since_until(spark, d):
    return stats.usage(V.turns(spark, d), V.exchanges(spark, d), since=_LOW, until=_HIGH)


@register("heatmap_dense", f"WITH {V.TURNS_SQL}, n AS (SELECT CAST(isodow(make_timestamp(ts_ms * 1000)) - 1 AS INT) AS weekday, CAST(hour(make_timestamp(ts_ms * 1000)) AS INT) AS hour, count(*) AS turns FROM turns GROUP BY 1, 2), g AS (SELECT CAST(i // 24 AS INT) AS weekday, CAST(i % 24 AS INT) AS hour FROM range(168) r(i)) SELECT weekday, hour, coalesce(turns, 0) AS turns FROM g LEFT JOIN n USING (weekday, hour)")
def heatmap_dense(spark, d):
    return stats.heatmap(V.turns(spark, d))


@register("project_rollup", f"WITH {V.CONVERSATIONS_SQL} SELECT normalized_project, count(*) AS conversations, CAST(sum(turn_count) AS BIGINT) AS turns, CAST(sum(exchange_count) AS BIGINT) AS exchanges, {SUM_SQL}, max(last_activity_at) AS last_activity_at FROM conversation_rows WHERE origin <> 'auxiliary' GROUP BY 1")
def project_rollup(spark, d):
    return stats.projects(V.conversations(spark, d))


@register("tool_usage", f"WITH {V.TOOLS_SQL} SELECT tool, count(*) AS calls, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (mutating) AS mutating FROM tool_events GROUP BY 1")
def tool_usage(spark, d):
    return stats.tools(V.tool_events(spark, d))


@register("command_usage_topk", f"WITH {V.TOOLS_SQL} SELECT cmd_head, count(*) AS calls, count(*) FILTER (status = 'failed') AS failed FROM tool_events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def command_usage_topk(spark, d):
    return stats.commands(V.tool_events(spark, d), limit=3)


@register("git_activity_daily", f"WITH {V.TOOLS_SQL} SELECT strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d') AS day, count(*) FILTER (git_facets ILIKE '%git_cmd:commit%') AS commits, count(*) FILTER (git_facets ILIKE '%git_cmd:push%') AS pushes, count(*) FILTER (git_facets ILIKE '%git_pr:%') AS prs FROM tool_events WHERE git_facets IS NOT NULL GROUP BY 1")
def git_activity_daily(spark, d):
    return stats.git_activity(V.tool_events(spark, d))


# Search

_HIT = "conversation_id, turn_index"


def _hits(query: str, exact: bool = False):
    def run(spark, d):
        return V.search_docs(spark, d).where(search.predicate(G.parse_query(query), NOW, exact=exact)).select("conversation_id", "turn_index")

    return run


def _has(word: str) -> str:
    return f"list_contains(tokens, '{word}')"


_SCOPE = "visible AND origin <> 'auxiliary'"
for _name, _query, _cond in (
    ("search_term", "the", f"{_has('the')} AND {_SCOPE}"),
    ("search_multi_term", "the and", f"{_has('the')} AND {_has('and')} AND {_SCOPE}"),
    ("search_phrase", '"of the"', f"contains(' ' || array_to_string(tokens, ' ') || ' ', ' of the ') AND {_SCOPE}"),
    ("search_facet_exact", "tool_cmd:en role:user", f"list_contains(facets, 'tool_cmd:en') AND role = 'user' AND {_SCOPE}"),
    ("search_facet_glob", "file:*src1?.txt tool_cmd:*", f"len(list_filter(files, lambda f: regexp_matches(f, '^.*src1.\\.txt$'))) > 0 AND len(list_filter(facets, lambda f: starts_with(f, 'tool_cmd:'))) > 0 AND {_SCOPE}"),
    ("search_facet_substring", "project:RC1 model:EN", f"contains(lower(project), 'rc1') AND contains(lower(model), 'en') AND {_SCOPE}"),
    ("search_facet_regex", "tool_cmd:/e./", f"len(list_filter(facets, lambda f: regexp_matches(lower(f), '^tool_cmd:(?:e.)$'))) > 0 AND {_SCOPE}"),
    ("search_regex", r"/[Tt]he\s+[a-z]+ing\b/", rf"regexp_matches(text, '[Tt]he\s+[a-z]+ing\b') AND {_SCOPE}"),
    ("search_ts_range", "since:2024-01-01 before:2024-01-02 role:user", f"ts_ms >= {V.BASE_MS} AND ts_ms < {V.BASE_MS + G.DAY_MS} AND role = 'user' AND {_SCOPE}"),
    ("search_default_scope", "role:assistant", f"role = 'assistant' AND {_SCOPE}"),
    ("search_named_origin", "origin:auxiliary the", f"origin = 'auxiliary' AND {_has('the')} AND visible"),
    ("search_subagent_sugar", "subagent:false cwd:/u/de", f"origin <> 'subagent' AND contains(lower(cwd), '/u/de') AND {_SCOPE}"),
):
    register(_name, f"WITH {V.DOCS_SQL} SELECT {_HIT} FROM docs WHERE {_cond}")(_hits(_query))

_BM25 = f"""{V.DOCS_SQL}, counted AS (SELECT *, len(list_filter(tokens, lambda t: t = 'the')) AS tf0, len(list_filter(tokens, lambda t: t = 'and')) AS tf1, len(tokens) AS size FROM docs),
stat AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(size) AS average, CAST(count(*) FILTER (tf0 > 0) AS DOUBLE) AS df0, CAST(count(*) FILTER (tf1 > 0) AS DOUBLE) AS df1 FROM counted),
scored AS (SELECT c.*, ln(1 + (n - df0 + 0.5) / (df0 + 0.5)) * tf0 * 2.2 / (tf0 + 1.2 * (0.25 + 0.75 * size / average)) + ln(1 + (n - df1 + 0.5) / (df1 + 0.5)) * tf1 * 2.2 / (tf1 + 1.2 * (0.25 + 0.75 * size / average)) AS score
           FROM counted c, stat WHERE tf0 > 0 AND tf1 > 0 AND {_SCOPE}),
grouped AS (SELECT conversation_id, count(*) AS match_count, max(score) AS best, max(ts_ms) AS last_ts FROM scored GROUP BY 1)"""


@register("search_bm25_topk", f"WITH {_BM25} SELECT conversation_id, turn_index, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, conversation_id, turn_index LIMIT 20")
def search_bm25_topk(spark, d):
    s = search.scored(V.search_docs(spark, d), G.parse_query("the and"), NOW)
    return s.orderBy(F.desc("score"), "conversation_id", "turn_index").limit(20).select("conversation_id", "turn_index", F.round("score", 6).alias("score"))


def _indexed(spark, d, query):
    docs = V.search_docs(spark, d)
    return search.scored(docs, G.parse_query(query), NOW, index=search.postings(docs))


@register("search_index_bm25", f"WITH {_BM25} SELECT conversation_id, turn_index, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, conversation_id, turn_index LIMIT 20")
def search_index_bm25(spark, d):
    s = _indexed(spark, d, "the and")
    return s.orderBy(F.desc("score"), "conversation_id", "turn_index").limit(20).select("conversation_id", "turn_index", F.round("score", 6).alias("score"))


@register("search_index_phrase", f"WITH {V.DOCS_SQL} SELECT conversation_id, turn_index FROM docs WHERE contains(' ' || array_to_string(tokens, ' ') || ' ', ' of the ') AND {_has('and')} AND {_SCOPE}")
def search_index_phrase(spark, d):
    return _indexed(spark, d, '"of the" and').select("conversation_id", "turn_index")


_AGED = f"best * pow(2, -greatest(0, ({NOW} - last_ts) / 86400000.0) / 30.0)"


@register("search_recency_rerank", f"WITH {_BM25} SELECT conversation_id, match_count, round({_AGED}, 6) AS score, last_ts FROM grouped ORDER BY {_AGED} DESC, conversation_id LIMIT 20")
def search_recency_rerank(spark, d):
    r = search.search(V.search_docs(spark, d), V.conversations(spark, d), "the and", NOW)
    return r.select("conversation_id", "match_count", F.round("score", 6).alias("score"), "last_ts")


@register("search_sort_recent", f"WITH {_BM25} SELECT conversation_id, match_count, last_ts FROM grouped ORDER BY last_ts DESC, conversation_id LIMIT 20")
def search_sort_recent(spark, d):
    return search.search(V.search_docs(spark, d), V.conversations(spark, d), "the and", NOW, sort="recent").select("conversation_id", "match_count", "last_ts")


_CONV = "'rg_' || substr(sha256('conv/6'), 1, 24)"


def _conv() -> str:
    import hashlib

    return "rg_" + hashlib.sha256(b"conv/6").hexdigest()[:24]


@register("find_strict", f"WITH {V.DOCS_SQL} SELECT conversation_id, turn_index, count(*) OVER () AS total_turn_hits FROM docs WHERE conversation_id = {_CONV} AND {_has('the')} ORDER BY turn_index LIMIT 20")
def find_strict(spark, d):
    return search.find_strict(V.search_docs(spark, d), _conv(), "the", NOW).select("conversation_id", "turn_index", "total_turn_hits")


@register("find_passage_exchanges", f"WITH {V.DOCS_SQL} SELECT conversation_id, exchange_ordinal FROM docs WHERE conversation_id = {_CONV} GROUP BY 1, 2 HAVING bool_or({_has('the')}) AND bool_or({_has('and')})")
def find_passage_exchanges(spark, d):
    return search.find_passages(V.search_docs(spark, d), _conv(), "the and")


@register("find_term_counts", f"WITH {V.DOCS_SQL} SELECT 'the' AS term, count(*) FILTER ({_has('the')}) AS turns FROM docs WHERE conversation_id = {_CONV} UNION ALL SELECT 'of a', count(*) FILTER (contains(' ' || array_to_string(tokens, ' ') || ' ', ' of a ')) FROM docs WHERE conversation_id = {_CONV}")
def find_term_counts(spark, d):
    return search.find_term_counts(V.search_docs(spark, d), _conv(), 'the "of a"')


@register("find_substring", f"WITH {V.TURNS_SQL} SELECT conversation_id, turn_index FROM turns WHERE conversation_id = {_CONV} AND contains(lower(text), 'he t')")
def find_substring(spark, d):
    return search.find_substring(V.turns(spark, d), _conv(), "he T").select("conversation_id", "turn_index")


@register("x_semi_join", f"WITH {V.DOCS_SQL}, {V.EXCHANGES_SQL.replace(V.TURNS_SQL + ',', '')} SELECT {EXC} FROM exchanges e WHERE EXISTS (SELECT 1 FROM docs d WHERE d.conversation_id = e.conversation_id AND d.exchange_ordinal = e.exchange_ordinal AND {_has('the')} AND {_SCOPE})")
def x_semi_join(spark, d):
    return search.exchanges_matching(V.search_docs(spark, d), V.exchanges(spark, d), "the", NOW).select(*EX)


@register("turn_window_around", f"WITH {V.TURNS_SQL} SELECT conversation_id, turn_index, role FROM turns WHERE conversation_id = {_CONV} AND turn_index BETWEEN 1 AND 4")
def turn_window_around(spark, d):
    return search.turn_window(V.turns(spark, d), _conv(), around=3, limit=4).select("conversation_id", "turn_index", "role")


@register("turn_page", f"WITH {V.TURNS_SQL} SELECT conversation_id, turn_index, role FROM turns WHERE conversation_id = {_CONV} ORDER BY turn_index LIMIT 2 OFFSET 1")
def turn_page(spark, d):
    return search.turn_window(V.turns(spark, d), _conv(), offset=1, limit=2).select("conversation_id", "turn_index", "role")


@register("analyzer_tokens", f"WITH {V.DOCS_SQL} SELECT conversation_id, turn_index, len(tokens) AS tokens, count_distinct FROM (SELECT *, len(list_distinct(tokens)) AS count_distinct FROM docs)")
def analyzer_tokens(spark, d):
    return V.search_docs(spark, d).select("conversation_id", "turn_index", F.size("tokens").cast("bigint").alias("tokens"), F.size(F.array_distinct("tokens")).cast("bigint").alias("count_distinct"))


# Sequential operators over literal or event rows


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _values(rows: list[tuple], names: str) -> str:
    lit = lambda x: "NULL" if x is None else ("true" if x else "false") if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(lit(x) for x in r) + ')' for r in rows)}) v({names})"


@register("cumulative_usage_delta", "SELECT event_id, CAST(greatest(total - coalesce(lag(total) OVER w, 0), 0) AS BIGINT) AS delta FROM (SELECT *, CAST(floor(value) AS BIGINT) AS total FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def cumulative_usage_delta(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("total", F.floor("value").cast("bigint"))
    return e.select("event_id", S.usage_delta(F.col("total"), Window.partitionBy("user_id").orderBy("event_id")).alias("delta"))


_EV = "(SELECT user_id AS conversation_id, event_id AS turn_index, CASE WHEN event_type = 'signup' THEN '/home/' || CAST(event_id % 7 AS VARCHAR) END AS cwd FROM events)"


def _cwd_events(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.col("user_id").alias("conversation_id"), F.col("event_id").alias("turn_index"), F.when(F.col("event_type") == "signup", F.concat(F.lit("/home/"), (F.col("event_id") % 7).cast("string"))).alias("cwd"))


@register("cwd_fill_forward", f"SELECT conversation_id, turn_index, last_value(cwd IGNORE NULLS) OVER (PARTITION BY conversation_id ORDER BY turn_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cwd FROM {_EV}")
def cwd_fill_forward(spark, d):
    return _cwd_events(spark, d).select("conversation_id", "turn_index", S.fill_forward(F.col("cwd")).alias("cwd"))


@register("first_cwd_per_conversation", f"SELECT conversation_id, min_by(cwd, turn_index) FILTER (cwd IS NOT NULL) AS cwd FROM {_EV} GROUP BY 1")
def first_cwd_per_conversation(spark, d):
    return _cwd_events(spark, d).groupBy("conversation_id").agg(F.min_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("turn_index"))).alias("cwd"))


@register("usage_once_per_message", "SELECT event_id, (id = '' OR id IS DISTINCT FROM prev) AS counts FROM (SELECT *, last_value(nullif(id, '') IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM (SELECT *, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS id FROM events))")
def usage_once_per_message(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("id", F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")))
    return e.select("event_id", S.counts_usage(F.col("id"), F.lit(True), Window.partitionBy("user_id").orderBy("event_id")).alias("counts"))


@register("text_block_islands", "WITH b AS (SELECT user_id, event_id, CASE WHEN event_type IN ('view', 'click') THEN 'text' ELSE 'tool' END AS kind, event_type AS body FROM events), m AS (SELECT *, CASE WHEN kind = 'text' AND lag(kind) OVER (PARTITION BY user_id ORDER BY event_id) = 'text' THEN 0 ELSE 1 END AS cut FROM b), i AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM m) SELECT user_id, CAST(island AS BIGINT) AS island, min(event_id) AS event_id, min_by(kind, event_id) AS kind, string_agg(body, chr(10) ORDER BY event_id) AS body FROM i GROUP BY 1, 2")
def text_block_islands(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", F.when(F.col("event_type").isin("view", "click"), "text").otherwise("tool").alias("kind"), F.col("event_type").alias("body"))
    return S.merge_blocks(e, ["user_id"], "event_id", "kind", "body")


_PAIRS = [(1, 0, 0, "use", "a", "unknown"), (1, 1, 0, "output", "a", "unknown"), (1, 2, 0, "output", "a", "failed"), (1, 3, 0, "output", "a", "succeeded"), (1, 4, 1, "use", "a", "unknown"), (1, 5, 1, "use", "b", "unknown"), (1, 6, 1, "output", "b", "succeeded"), (1, 7, 1, "use", None, "unknown"), (2, 0, 0, "output", "a", "failed"), (2, 1, 0, "use", "a", "unknown")]


@register("tool_pairing_status", f"WITH t AS (SELECT * FROM {_values(_PAIRS, 'c, i, e, dir, pair, st')}) SELECT CAST(c AS BIGINT) AS conversation_id, CAST(i AS BIGINT) AS turn_index, CASE WHEN dir = 'use' AND pair IS NOT NULL AND st = 'unknown' THEN coalesce((SELECT min_by(o.st, o.i) FROM t o WHERE o.c = t.c AND o.e = t.e AND o.pair = t.pair AND o.dir = 'output' AND o.st <> 'unknown' AND o.i > t.i AND NOT EXISTS (SELECT 1 FROM t u WHERE u.c = t.c AND u.e = t.e AND u.pair = t.pair AND u.dir = 'use' AND u.i > t.i AND u.i < o.i)), st) ELSE st END AS tool_status FROM t")
def tool_pairing_status(spark, d):
    t = _rows(spark, _PAIRS, "conversation_id bigint, turn_index bigint, exchange_ordinal bigint, tool_direction string, pair_id string, tool_status string")
    return S.stamp_tool_status(t).select("conversation_id", "turn_index", "tool_status")


_USAGE = [(1, 0, 0, "user", False, 0), (1, 1, 0, "assistant", True, 0), (1, 2, 0, "usage", False, 10), (1, 3, 1, "user", False, 0), (1, 4, 1, "usage", False, 7), (1, 5, 2, "user", False, 0), (1, 6, 2, "assistant", True, 0), (1, 7, 2, "usage", False, 5)]


@register("usage_attach_pending", f"WITH t AS (SELECT * FROM {_values(_USAGE, 'c, i, e, role, msg, n')}) SELECT CAST(target AS BIGINT) AS target, CAST(sum(n) AS BIGINT) AS tokens FROM (SELECT n, coalesce((SELECT max(a.i) FROM t a WHERE a.c = u.c AND a.e = u.e AND a.role = 'assistant' AND a.i <= u.i), (SELECT min(a.i) FROM t a WHERE a.c = u.c AND a.msg AND a.i >= u.i)) AS target FROM t u WHERE role = 'usage') GROUP BY 1")
def usage_attach_pending(spark, d):
    t = _rows(spark, _USAGE, "conversation_id bigint, turn_index bigint, exchange_ordinal bigint, role string, msg boolean, n bigint")
    t = t.withColumn("target", S.usage_target(F.col("role") == "assistant", F.col("msg")))
    return t.where("role = 'usage'").groupBy("target").agg(F.sum("n").alias("tokens"))


# Scalar functions


@register("stable_id_sha256", "SELECT doc_id, 'rg_' || substr(sha256(source || '/' || CAST(doc_id AS VARCHAR)), 1, 24) AS id FROM documents")
def stable_id_sha256(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", C.stable_id(F.concat_ws("/", "source", F.col("doc_id").cast("string"))).alias("id"))


_TIMES = [(1, "2026-07-03T10:00:00.123Z", 1783072800123), (2, "2026-07-03T10:00:00+02:00", 1783065600000), (3, "1783072800", 1783072800000), (4, "1783072800123", 1783072800123), (5, "1783072800123456", 1783072800123), (6, "-5", None), (7, "0", None), (8, "soon", None), (9, None, None)]


@register("timestamp_normalization", f"SELECT CAST(id AS BIGINT) AS id, CAST(ms AS BIGINT) AS ms FROM {_values([(i, m) for i, _, m in _TIMES], 'id, ms')}")
def timestamp_normalization(spark, d):
    t = _rows(spark, [(i, s) for i, s, _ in _TIMES], "id bigint, s string")
    return t.select("id", C.parse_timestamp(F.col("s")).alias("ms"))


_PROJECTS = [(1, "-home-u-src-proj", "/x", "-home-u-src-proj"), (2, "home", "/home/u/src/proj", "-home-u-src-proj"), (3, None, "/home/u/./src/../proj/", "-home-u-proj"), (4, "/home//u/a_b", None, "-home-u-a-b"), (5, None, None, "")]


@register("project_normalization", f"SELECT CAST(id AS BIGINT) AS id, slug FROM {_values([(i, s) for i, _, _, s in _PROJECTS], 'id, slug')}")
def project_normalization(spark, d):
    t = _rows(spark, [(i, p, c) for i, p, c, _ in _PROJECTS], "id bigint, project string, cwd string")
    return t.select("id", C.normalized_project(F.col("project"), F.col("cwd")).alias("slug"))


@register("role_normalization", "SELECT DISTINCT role, CASE role WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'assistant' WHEN 'tool' THEN 'tool' WHEN 'developer' THEN 'system' ELSE lower(trim(role)) END AS normalized FROM conversations")
def role_normalization(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet").select("role", C.normalize_role(F.col("role")).alias("normalized")).distinct()


# Sets, diffs, unions


@register("removed_files_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def removed_files_anti(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").join(spark.read.parquet(f"{d}/labels.parquet").where("doc_id is not null"), "doc_id", "left_anti").select("doc_id")


@register("changed_files_full_outer", "WITH a AS (SELECT doc_id AS id, n_chars % 2 AS size FROM documents), b AS (SELECT doc_id AS id, quality AS size FROM labels) SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'new' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS state FROM a FULL OUTER JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.size IS DISTINCT FROM b.size")
def changed_files_full_outer(spark, d):
    from threadmill.streaming.incremental import diff_files

    same = [F.lit(1).cast("bigint").alias("mtime_ns"), F.lit(1).alias("version")]
    known = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("path"), (F.col("n_chars") % 2).alias("size"), *same)
    found = spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("path"), F.col("quality").cast("bigint").alias("size"), *same)
    return diff_files(known, found).select(F.col("path").alias("id"), "state")


@register("candidate_union_priority", f"WITH {V.DOCS_SQL}, u AS (SELECT conversation_id, 0 AS priority, row_number() OVER (ORDER BY ts_ms DESC, conversation_id, turn_index) AS rank FROM docs WHERE list_contains(facets, 'tool_cmd:en') UNION ALL SELECT conversation_id, 1, row_number() OVER (ORDER BY ts_ms DESC, conversation_id, turn_index) FROM docs WHERE {_has('the')}), f AS (SELECT conversation_id, min(priority * 1000000000 + rank) AS place FROM u GROUP BY 1) SELECT conversation_id FROM f ORDER BY place LIMIT 40")
def candidate_union_priority(spark, d):
    docs = V.search_docs(spark, d)
    en = docs.where(F.array_contains("facets", "tool_cmd:en"))
    the = docs.where(F.array_contains("tokens", "the"))
    return gitops.ordered_union([en, the], [F.desc("ts_ms"), F.col("conversation_id"), F.col("turn_index")], 40).select("conversation_id")


# (conversation, turn, created pull request, pull requests, branches, commits, command) and (conversation, start, title, turn of its best text)
_OPS = [("c1", 3, 48, "48", "", "", "gh pr create"), ("c1", 5, None, "48", "", "", "gh pr view 48"), ("c2", 1, None, "", "main", "", "git pull"), ("c3", 2, None, "", "", "abc1234", "git commit"), ("c3", 4, None, "48", "", "", "gh pr merge 48"), ("c5", 7, None, "7", "x/48", "", "git push"), ("c6", 0, 48, "48", "", "", "gh pr create -f")]
_FOUND = [("c1", 100, "one", 9), ("c2", 50, "two", 8), ("c3", 90, "three", 7), ("c4", 10, "four", 6), ("c5", None, "five", 5), ("c6", None, "six", 4)]
_TIERED = f"""WITH op AS (SELECT c, i, created, list_contains(string_split(prs, ','), $PR) AS is_pr, list_contains(string_split(branches, ','), $BRANCH) AS is_branch, list_contains(string_split(commits, ','), $COMMIT) AS is_commit, command FROM {_values(_OPS, 'c, i, created, prs, branches, commits, command')}),
g AS (SELECT c, CASE WHEN bool_or(coalesce(created = $CREATED, false)) THEN 3 WHEN bool_or(is_pr OR is_branch OR is_commit) THEN 2 ELSE 1 END AS tier, count(*) FILTER (is_pr OR is_branch OR is_commit) AS n, min(i) FILTER (is_pr OR is_branch OR is_commit) AS first_at, min_by(command, i) FILTER (is_pr OR is_branch OR is_commit) AS summary FROM op GROUP BY 1),
e AS (SELECT v.c AS conversation_id, title, CAST(coalesce(tier, 0) AS INT) AS relevance, coalesce(tier = 3, false) AS origin, CAST(v.started AS BIGINT) AS first_seen, coalesce(n, 0) AS matching_ops, CAST(coalesce(first_at, v.turn) AS BIGINT) AS next_turn, coalesce(summary, '') AS summary
      FROM {_values(_FOUND, 'c, started, title, turn')} LEFT JOIN g ON v.c = g.c)
SELECT * FROM e WHERE relevance >= 2 OR (SELECT max(relevance) FROM e) < 2 ORDER BY relevance DESC, first_seen NULLS FIRST, conversation_id LIMIT 8"""


def _tiered(**asked):
    def run(spark, d):
        listed = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
        ops = _rows(spark, _OPS, "conversation_id string, turn_index bigint, created_pr bigint, prs string, branches string, commits string, command string")
        ops = ops.select("conversation_id", "turn_index", "created_pr", listed("prs").cast("array<bigint>").alias("pr_numbers"), listed("branches").alias("branches"), listed("commits").alias("commits"), "command", F.lit("").alias("output_head"))
        found = _rows(spark, _FOUND, "conversation_id string, started_at bigint, title string, turn bigint")
        return gitops.trajectory(found.select("conversation_id", "turn"), ops, found.drop("turn"), **asked).drop("inspect")

    return run


for _name, _asked in (("relevance_tiering", {"pr": 48}), ("trajectory_branch", {"branch": "x/48"}), ("trajectory_by_commit", {"commit": "ABC1234ff"}), ("trajectory_weak", {"branch": "none"})):
    _sql = _TIERED.replace("$PR", f"'{_asked.get('pr', '-')}'").replace("$CREATED", str(_asked.get("pr", -1))).replace("$BRANCH", f"'{_asked.get('branch', '-')}'").replace("$COMMIT", f"'{_asked.get('commit', '-').lower()[:7]}'")
    register(_name, _sql)(_tiered(**_asked))


@register("provider_file_inventory", "SELECT lang AS kind, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY 1")
def provider_file_inventory(spark, d):
    return stats.inventory(spark.read.parquet(f"{d}/documents.parquet").select(F.col("lang").alias("kind"), F.col("n_chars").alias("size")))


@register("facet_union_distinct", f"WITH {V.DOCS_SQL} SELECT conversation_id, turn_index, list_sort(list_distinct(list_concat(facets, ['role:' || role, 'is:notification']))) AS facets FROM docs")
def facet_union_distinct(spark, d):
    f = F.array_sort(F.array_distinct(F.concat("facets", F.array(F.concat(F.lit("role:"), F.col("role")), F.lit("is:notification")))))
    return V.search_docs(spark, d).select("conversation_id", "turn_index", f.alias("facets"))


@register("events_hour_window", "SELECT epoch_ms(date_trunc('hour', ts)) AS hour_ms, event_type, count(*) AS n FROM events GROUP BY ALL")
def events_hour_window(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.unix_millis("w.start").alias("hour_ms"), "event_type", "n")


_PATHS = [("/h/.claude/projects/p/a.jsonl", "claude"), ("/h/.codex/sessions/2026/07/03/b.jsonl", "codex"), ("/h/.cursor/projects/p/agent-transcripts/c.jsonl", "cursor"), ("/h/.grok/sessions/%2Fh/s/chat_history.jsonl", "grok"), ("/h/logs/x.jsonl", "generic")]


@register("provider_claim", f"SELECT path, kind FROM {_values(_PATHS, 'path, kind')}")
def provider_claim(spark, d):
    from threadmill.sources.discovery import provider_of

    return _rows(spark, [(p,) for p, _ in _PATHS], "path string").select("path", F.coalesce(provider_of(F.col("path")), F.lit("generic")).alias("kind"))


# Facets of commands: literal rows, as the tables have none

_COMMANDS = [
    (1, "git push origin feature/x && cargo test | head", ["git_branch:feature/x", "git_cmd:push", "git_remote:origin", "tool_cmd:cargo", "tool_cmd:git"]),
    (2, "cd /x; sudo git commit -m 'a && b'", ["tool_cmd:git"]),
    (3, "bash -lc 'git checkout abc1234'", ["git_cmd:checkout", "git_commit:abc1234", "tool_cmd:git"]),
    (4, "cat <<EOF\nrm -rf /\nEOF\ngh pr merge 48 --squash", ["git_pr:merge", "git_pr_num:48", "tool_cmd:cat", "tool_cmd:gh"]),
    (5, "ssh host 'git pull origin main'", ["git_branch:main", "git_cmd:pull", "git_remote:origin", "tool_cmd:ssh"]),
    (6, None, []),
]


@register("shell_facets", f"SELECT CAST(id AS BIGINT) AS id, facets FROM (VALUES {', '.join(f'({i}, CAST({f} AS VARCHAR[]))' for i, _, f in _COMMANDS)}) v(id, facets)")
def shell_facets(spark, d):
    return _rows(spark, [(i, c) for i, c, _ in _COMMANDS], "id bigint, command string").select("id", gitops.command_facets(F.col("command")).alias("facets"))


_TURNS = [
    ("c", 0, "use", "bash", "p1", "succeeded", "gh pr create --head feat/a", None), ("c", 1, "output", None, "p1", "succeeded", None, "https://github.com/o/r/pull/48"),
    ("c", 2, "use", "bash", "p2", "unknown", "git commit -m x", None), ("c", 3, "output", None, "p2", "failed", None, "[main abc1234] x"), ("c", 4, "use", "bash", "p3", "succeeded", "ls", None), ("c", 5, "use", "read", "p4", "succeeded", None, None),
]


@register("git_timeline", "SELECT * FROM (VALUES ('c', CAST(0 AS BIGINT), true, CAST(48 AS BIGINT), CAST([48] AS BIGINT[]), CAST(['feat/a'] AS VARCHAR[]), CAST([] AS VARCHAR[]), 'succeeded'), ('c', 2, true, NULL, [], [], ['abc1234'], 'failed')) v(conversation_id, turn_index, mutating, created_pr, pr_numbers, branches, commits, status)")
def git_timeline(spark, d):
    t = _rows(spark, _TURNS, "conversation_id string, turn_index bigint, tool_direction string, tool_name string, pair_id string, tool_status string, command string, text string").withColumn("ts_ms", F.lit(None).cast("bigint"))
    return gitops.timeline(t).select("conversation_id", "turn_index", "mutating", "created_pr", "pr_numbers", "branches", "commits", "status")


@register("excerpt_highlight")
def excerpt_highlight(spark, d):
    docs = V.search_docs(spark, d).where(F.array_contains("tokens", "the"))
    return docs.withColumn("x", X.excerpt(F.col("text"), ["the"])).select("conversation_id", "turn_index", "x.excerpt", F.size("x.highlights").alias("highlights"))


@register("mutating_classifier", "SELECT * FROM (VALUES ('git_cmd:status', false), ('git_cmd:fetch', true), ('git_pr:view', false), ('git_pr:create', true), ('git_pr:create-num:4', false)) v(facet, mutating)")
def mutating_classifier(spark, d):
    rows = [(f,) for f in ("git_cmd:status", "git_cmd:fetch", "git_pr:view", "git_pr:create", "git_pr:create-num:4")]
    return _rows(spark, rows, "facet string").select("facet", gitops.mutating(F.array("facet")).alias("mutating"))


@register("tool_type_facets")
def tool_type_facets(spark, d):
    commands = ["pytest -q", "git status", "pip install x", "curl http://x", "ls -la", "sudo systemctl restart x", "python3 -c 'print(1)'", "rsync a b", "rm -rf x"]
    rows = [(i, c, shell.described_facets("bash", c)) for i, c in enumerate(commands)]
    return _rows(spark, rows, "id bigint, command string, facets array<string>")

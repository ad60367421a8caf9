"""Emitted rows to turns and conversations: every order-dependent step is a window over one partitioning by file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadmill.functions import columns as C
from threadmill.operators import sequence as S

USAGE = ("input", "output", "cache_creation", "cache_read", "reasoning")


def _file(*extra: str):
    return Window.partitionBy("path", *extra).orderBy("line", "emit_pos")


def _so_far(*extra: str):
    return _file(*extra).rowsBetween(Window.unboundedPreceding, 0)


def _whole():
    return _file().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def _path_facts(rows: DataFrame) -> DataFrame:
    """project, directory and start time that a path tells, and the link of a subagent's file to its parent's."""
    path = F.col("path")
    slug = F.when(F.col("kind").isin("claude", "claude-cowork"), F.regexp_extract(path, r"/projects/([^/]+)/", 1)).when(F.col("kind") == "cursor", F.regexp_extract(path, r"/\.cursor/projects/([^/]+)/", 1))
    grok_dir = F.when(F.col("kind") == "grok", F.url_decode(F.regexp_replace(F.regexp_extract(path, r"/\.grok/sessions/([^/]+)/", 1), r"\+", "%2B")))
    seed = F.when(slug.startswith("-"), F.regexp_replace(slug, "-", "/")).otherwise(F.when(grok_dir.startswith("/"), grok_dir))
    uuid7 = F.regexp_extract(path, r"/([0-9a-f]{8})-([0-9a-f]{4})-7[0-9a-f]{3}-", 0)
    ms = F.conv(F.substring(F.regexp_replace(uuid7, "[/-]", ""), 1, 12), 16, 10).cast("bigint")
    child = F.regexp_extract(path, r"^(.*)/subagents/[^/]+\.jsonl$", 1)
    return rows.withColumns({
        "conversation_id": C.stable_id(path), "project": F.nullif(slug, F.lit("")), "cwd_seed": seed, "default_ts": F.when((F.col("kind") == "grok") & (uuid7 != "") & ms.between(1_420_070_400_000, 4_102_444_800_000), ms),
        "parent_conversation_id": F.when((F.col("kind") == "claude") & (child != ""), C.stable_id(F.concat(child, F.lit(".jsonl")))), "subagent_id": F.when((F.col("kind") == "claude") & (child != ""), F.regexp_extract(path, r"/subagents/([^/]+)\.jsonl$", 1)),
    })


def annotate(emitted: DataFrame) -> DataFrame:
    """All rows, signals too, with indexes, exchanges, inherited values and usage targets."""
    r = _path_facts(emitted)
    r = r.withColumn("is_turn", F.coalesce("is_turn", F.lit(False))).withColumn("synthetic", F.coalesce("synthetic", F.lit(False)))
    opens = F.coalesce(F.col("is_turn") & C.opens_exchange(F.col("role"), F.col("text"), F.col("special_kind"), F.col("synthetic")), F.lit(False))
    r = r.withColumns({"opens": opens, "ts_ms": F.coalesce("own_ts_ms", C.parse_timestamp(F.col("rec_ts")))})
    starts = F.coalesce(F.first(F.when(F.col("is_turn"), F.col("opens")), ignorenulls=True).over(_whole()), F.lit(False))
    last = lambda c: F.last(c, ignorenulls=True).over(_so_far())
    r = r.withColumns({
        "turn_index": F.when(F.col("is_turn"), F.count_if("is_turn").over(_so_far()) - 1), "exchange_ordinal": F.greatest(F.count_if("opens").over(_so_far()) - starts.cast("bigint"), F.lit(0)).cast("bigint"),
        "cwd": last("rec_cwd"), "model": F.when(F.col("role") == "assistant", last("rec_model")), "tag": F.coalesce("tag", F.when((F.col("kind") == "codex") & F.col("is_turn"), last("rec_tag"))),
        "scraped": C.scraped_cwd(F.col("text")),
    })
    here = _so_far("exchange_ordinal")
    prompt = F.first(F.when(F.col("opens"), F.col("turn_index")), ignorenulls=True).over(here)
    users = F.collect_list(F.when(F.col("role") == "user", F.struct("tag", "turn_index"))).over(here)  # the users of an exchange up to here: its prompt, and few others
    same = F.filter(users, lambda u: F.col("abort_tag").isNull() | (u["tag"] == F.col("abort_tag")))
    target = F.when(F.col("kind") == "codex", F.try_element_at(same, F.lit(1))["turn_index"]).otherwise(prompt)
    r = r.withColumn("aborted_user_turn", F.when(F.col("special_kind") == "turn_aborted", target))
    return _usage(r)


def _usage(r: DataFrame) -> DataFrame:
    """Tokens that a row adds and the turn that gets them."""
    kind = F.col("usage_kind")
    message = F.coalesce(kind == "message", F.lit(False))
    counted = S.counts_usage(F.col("message_id"), message, _file())
    total = kind == "total"
    amounts = {}
    for k in USAGE:
        v = F.coalesce(F.col(f"u_{k}"), F.lit(0))
        before = F.last(F.when(total, v), ignorenulls=True).over(_file().rowsBetween(Window.unboundedPreceding, -1))
        grown = F.greatest(v - F.coalesce(before, F.lit(0)), F.lit(0))
        amounts[f"d_{k}"] = F.when(message, F.when(counted, v)).when(total, grown).when(kind.isin("own", "step"), v)
    here = _so_far("exchange_ordinal")
    latest = F.last(F.when(F.col("role") == "assistant", F.col("turn_index")), ignorenulls=True).over(here)
    later = F.first(F.when(F.col("role") == "assistant", F.col("turn_index")), ignorenulls=True).over(_file().rowsBetween(0, Window.unboundedFollowing))
    target = F.when(message | (kind == "own"), F.col("turn_index")).when(total, F.coalesce(latest, later)).when(kind == "step", latest)
    return r.withColumns({**amounts, "usage_target": target})


def turns(annotated: DataFrame) -> DataFrame:
    """The turn table of annotated rows: tokens attached, tool statuses stamped, visibility and lengths."""
    got = annotated.where(F.col("usage_target").isNotNull()).groupBy(F.col("path").alias("__path"), F.col("usage_target").alias("__turn")).agg(*[F.sum(f"d_{k}").alias(f"t_{k}") for k in USAGE])
    t = annotated.where("is_turn")
    t = S.stamp_tool_status(t).drop(*[f"d_{k}" for k in USAGE], *[f"u_{k}" for k in USAGE], "usage_target")
    t = t.join(got, (F.col("path") == F.col("__path")) & (F.col("turn_index") == F.col("__turn")), "left").drop("__path", "__turn")
    t = t.withColumns({k: F.coalesce(f"t_{k}", F.lit(0)).cast("bigint") for k in USAGE}).withColumn("estimated", F.coalesce("estimated", F.lit(0)))
    visible = C.is_visible(F.col("role"), F.col("speaker"), F.col("text"), F.col("special_kind"), F.col("synthetic"))
    return t.withColumns({"visible": visible, "text_len": F.octet_length("text")}).drop(*[f"t_{k}" for k in USAGE])


def conversations(annotated: DataFrame, turn_rows: DataFrame) -> DataFrame:
    """One row per file."""
    at = F.struct("line", "emit_pos")
    title = F.max_by("rec_title", F.when(F.col("rec_title").isNotNull(), F.struct(F.coalesce("title_rank", F.lit(0)), at)))
    signals = annotated.groupBy("conversation_id").agg(
        F.first("path").alias("source_path"), F.first("kind").alias("provider"), F.first("project", ignorenulls=True).alias("project"), F.first("cwd_seed", ignorenulls=True).alias("cwd_seed"), F.first("default_ts", ignorenulls=True).alias("default_ts"),
        F.first("parent_conversation_id", ignorenulls=True).alias("parent_conversation_id"), F.first("subagent_id", ignorenulls=True).alias("subagent_id"), F.min_by("rec_cwd", F.when(F.col("rec_cwd").isNotNull(), at)).alias("rec_cwd"),
        F.min_by("scraped", F.when(F.col("scraped").isNotNull(), at)).alias("scraped"), F.min_by("rec_model", F.when(F.col("rec_model").isNotNull(), at)).alias("model"), title.alias("provider_title"), F.max_by("rec_origin", F.when(F.col("rec_origin").isNotNull(), at)).alias("rec_origin"),
        F.count_if(F.col("malformed")).alias("malformed_lines"),
    )
    rolled = S.conversation_rollup(turn_rows).drop("model")
    c = signals.join(rolled, "conversation_id", "left")
    cwd = F.coalesce("rec_cwd", "cwd_seed", "scraped")
    origin = F.when(F.col("parent_conversation_id").isNotNull(), "subagent").otherwise(F.coalesce("rec_origin", F.lit("interactive")))
    return c.withColumns({
        "cwd": cwd, "origin": origin, "is_subagent": F.col("parent_conversation_id").isNotNull(), "title": F.coalesce("provider_title", "first_line", "conversation_id"), "normalized_project": C.normalized_project(F.col("project"), cwd),
        "started_at": F.coalesce("started_at", "default_ts"), "last_activity_at": F.coalesce("last_activity_at", "default_ts"), "turn_count": F.coalesce("turn_count", F.lit(0)), "exchange_count": F.coalesce("exchange_count", F.lit(0)),
    }).drop("rec_cwd", "cwd_seed", "scraped", "rec_origin", "default_ts")

"""Usage statistics: one aggregation each, over columns of the turn, exchange and tool tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmill.functions import columns as C

SUMS = ("input", "output", "cache_creation", "cache_read", "estimated")


def between(df: DataFrame, column: str, since: int | None, until: int | None) -> DataFrame:
    """Rows from ``since`` up to before ``until``; a null time never matches a bound."""
    if since is not None:
        df = df.where(F.col(column) >= since)
    if until is not None:
        df = df.where(F.col(column) < until)
    return df


def hourly(turns: DataFrame) -> DataFrame:
    """Turns, conversations and tokens of each UTC hour."""
    t = turns.where(F.col("ts_ms").isNotNull())
    return t.groupBy(F.expr("ts_ms div 3600000").alias("hour")).agg(F.count(F.lit(1)).alias("turns"), F.countDistinct("conversation_id").alias("conversations"), *[F.sum(k).alias(k) for k in SUMS])


def usage(turns: DataFrame, exchanges: DataFrame, period: str = "daily", zone: str = "UTC", since: int | None = None, until: int | None = None) -> DataFrame:
    """Turns, distinct conversations, prompted exchanges and tokens of each bucket.

    Turns use exact bounds and conversations use bounds floored to hours; exchanges count only in buckets that have turns.
    """
    floor = lambda x: None if x is None else x // 3_600_000 * 3_600_000
    label = C.label(F.col("ts_ms"), period, zone).alias("bucket")
    timed = turns.where(F.col("ts_ms").isNotNull())
    if since is None and until is None:
        t = timed.groupBy(label).agg(F.count(F.lit(1)).alias("turns"), F.countDistinct("conversation_id").alias("conversations"), *[F.sum(k).alias(k) for k in SUMS])
    else:
        n = between(timed, "ts_ms", since, until).groupBy(label).agg(F.count(F.lit(1)).alias("turns"), *[F.sum(k).alias(k) for k in SUMS])
        c = between(timed, "ts_ms", floor(since), floor(until)).groupBy(label).agg(F.countDistinct("conversation_id").alias("conversations"))
        t = n.join(c, "bucket")
    e = between(exchanges.where(F.col("user_turn_index").isNotNull() & F.col("started_at").isNotNull()), "started_at", since, until)
    e = e.groupBy(C.label(F.col("started_at"), period, zone).alias("bucket")).agg(F.count(F.lit(1)).alias("exchanges"))
    return t.join(e, "bucket", "left").select("bucket", "turns", "conversations", F.coalesce("exchanges", F.lit(0)).alias("exchanges"), *SUMS)


def with_total(report: DataFrame) -> DataFrame:
    """The report and a TOTAL row, which sums the buckets (so a conversation of two buckets counts twice)."""
    numbers = [c for c in report.columns if c != "bucket"]
    return report.unionByName(report.agg(*[F.sum(c).alias(c) for c in numbers]).withColumn("bucket", F.lit("TOTAL")))


def heatmap(turns: DataFrame, zone: str = "UTC") -> DataFrame:
    """Turns by weekday (Monday is 0) and local hour; all 168 cells."""
    local = F.from_utc_timestamp(F.timestamp_millis("ts_ms"), zone)
    n = turns.where(F.col("ts_ms").isNotNull()).groupBy(F.weekday(local).alias("weekday"), F.hour(local).alias("hour")).agg(F.count(F.lit(1)).alias("turns"))
    grid = turns.sparkSession.range(168).select((F.expr("id div 24")).cast("int").alias("weekday"), (F.col("id") % 24).cast("int").alias("hour"))  # a grid of fixed size
    return grid.join(n, ["weekday", "hour"], "left").select("weekday", "hour", F.coalesce("turns", F.lit(0)).alias("turns"))


def projects(conversations: DataFrame) -> DataFrame:
    c = conversations.where("origin <> 'auxiliary'")
    return c.groupBy("normalized_project").agg(F.count(F.lit(1)).alias("conversations"), F.sum("turn_count").alias("turns"), F.sum("exchange_count").alias("exchanges"), *[F.sum(k).alias(k) for k in SUMS], F.max("last_activity_at").alias("last_activity_at"))


def tools(events: DataFrame) -> DataFrame:
    return events.groupBy("tool").agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "rejected").alias("rejected"), F.count_if("mutating").alias("mutating")).orderBy(F.desc("calls"), "tool")


def commands(events: DataFrame, limit: int = 20) -> DataFrame:
    c = events.where(F.col("cmd_head").isNotNull()).groupBy("cmd_head").agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("status") == "failed").alias("failed"))
    return c.orderBy(F.desc("calls"), "cmd_head").limit(limit)


def git_activity(events: DataFrame) -> DataFrame:
    """Calls with commits, pushes and pull request actions of each UTC day; days without any are left out."""
    f = F.coalesce("git_facets", F.lit(""))
    day = F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd").alias("day")
    return (
        events.where(F.col("ts_ms").isNotNull() & (f != ""))
        .groupBy(day)
        .agg(F.count_if(F.ilike(f, F.lit("%git_cmd:commit%"))).alias("commits"), F.count_if(F.ilike(f, F.lit("%git_cmd:push%"))).alias("pushes"), F.count_if(F.ilike(f, F.lit("%git_pr:%"))).alias("prs"))
        .where("commits + pushes + prs > 0")
    )


def top_exchanges(exchanges: DataFrame, conversations: DataFrame, by: str = "tokens", limit: int = 10) -> DataFrame:
    """The largest prompted exchanges of real work, by tokens (estimates included), duration, turns or tool_calls."""
    e = exchanges.where(F.col("user_turn_index").isNotNull()).join(conversations.where("origin <> 'auxiliary'").select("conversation_id", "normalized_project"), "conversation_id")
    e = e.withColumn("tokens", sum((F.col(k) for k in SUMS[1:]), F.col(SUMS[0]))).withColumn("turns", F.col("end_turn") - F.col("start_turn"))
    key = {"tokens": "tokens", "duration": "duration_ms", "turns": "turns", "tool_calls": "tool_calls"}[by]
    return e.orderBy(F.desc_nulls_last(key), "conversation_id", "exchange_ordinal").limit(limit)


def filter_exchanges(exchanges: DataFrame, conversations: DataFrame, failed: bool = False, interrupted: bool = False, min_duration_ms: int | None = None, min_turns: int | None = None, project: str | None = None, since: int | None = None, limit: int | None = 20) -> DataFrame:
    """Prompted exchanges of real work under every filter given, newest first."""
    keep = conversations.where("origin <> 'auxiliary'")
    if project is not None:
        keep = keep.where(F.col("normalized_project") == project)
    e = exchanges.where(F.col("user_turn_index").isNotNull()).withColumn("turns", F.col("end_turn") - F.col("start_turn"))
    if failed:
        e = e.where("failed_tool_calls > 0")
    if interrupted:
        e = e.where("interrupted")
    if min_duration_ms is not None:
        e = e.where(F.col("duration_ms") >= min_duration_ms)
    if min_turns is not None:
        e = e.where(F.col("turns") >= min_turns)
    e = between(e, "started_at", since, None).join(keep.select("conversation_id", "normalized_project"), "conversation_id").orderBy(F.desc_nulls_last("started_at"), "conversation_id", "exchange_ordinal")
    return e if limit is None else e.limit(limit)


def recent(conversations: DataFrame, limit: int = 20, project: str | None = None) -> DataFrame:
    c = conversations if project is None else conversations.where(F.col("normalized_project") == project)
    return c.orderBy(F.desc_nulls_last("last_activity_at"), "conversation_id").limit(limit)


def inventory(files: DataFrame) -> DataFrame:
    """Files and bytes of each provider."""
    return files.groupBy("kind").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))

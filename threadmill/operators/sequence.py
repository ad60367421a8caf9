"""Order-dependent operators over turns, as windows: one shuffle by conversation serves them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadmill.functions import columns as C

CONV = "conversation_id"
SUMS = [f"{k}" for k in C.TOKEN_KINDS]


def ordered(*extra: str):
    return Window.partitionBy(CONV, *extra).orderBy("turn_index")


def so_far(*extra: str):
    return ordered(*extra).rowsBetween(Window.unboundedPreceding, 0)


def after(*extra: str):
    return ordered(*extra).rowsBetween(0, Window.unboundedFollowing)


def index_turns(emitted: DataFrame, conversation: str = CONV) -> DataFrame:
    """Dense turn indexes from 0 in the order of (line, emit_pos)."""
    w = Window.partitionBy(conversation).orderBy("line", "emit_pos")
    return emitted.withColumn("turn_index", (F.row_number().over(w) - 1).cast("bigint"))


def fill_forward(value: Column, *extra: str) -> Column:
    """The value, or the last one before it."""
    return F.last(value, ignorenulls=True).over(so_far(*extra))


def first_known(value: Column) -> Column:
    return F.first(value, ignorenulls=True).over(Window.partitionBy(CONV).orderBy("turn_index").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))


def segment_exchanges(turns: DataFrame) -> DataFrame:
    """exchange_ordinal and opens of each turn. A real prompt opens an exchange; turns before the first are exchange 0, a preamble."""
    opens = F.coalesce(C.opens_exchange(F.col("role"), F.col("text"), F.col("special_kind"), F.col("synthetic")), F.lit(False))
    t = turns.withColumn("opens", opens)
    starts = F.first("opens").over(so_far())
    count = F.sum(F.col("opens").cast("bigint")).over(so_far())
    return t.withColumn("exchange_ordinal", F.greatest(count - starts.cast("bigint"), F.lit(0)).cast("bigint"))


def exchange_rollup(turns: DataFrame) -> DataFrame:
    """One row per exchange of segmented turns."""
    at = F.col("turn_index")
    user = F.when(F.col("opens"), at)
    tool_use = F.col("tool_direction") == "use"
    return (
        turns.groupBy(CONV, "exchange_ordinal")
        .agg(
            F.min(user).alias("user_turn_index"), F.min(at).alias("start_turn"), (F.max(at) + 1).alias("end_turn"),
            F.min_by("ts_ms", F.when(F.col("ts_ms").isNotNull(), at)).alias("started_at"), F.max_by("ts_ms", F.when(F.col("ts_ms").isNotNull(), at)).alias("ended_at"),
            F.min_by(C.preview(F.col("text")), user).alias("user_preview"),
            F.count_if(F.col("role") == "assistant").alias("assistant_turns"), F.count_if(tool_use).alias("tool_calls"),
            F.count_if(tool_use & (F.col("tool_status") == "failed")).alias("failed_tool_calls"), F.count_if(tool_use & (F.col("tool_status") == "rejected")).alias("rejected_tool_calls"),
            F.coalesce(F.bool_or((F.col("speaker") == "error") | (tool_use & (F.col("tool_status") == "failed"))), F.lit(False)).alias("has_error"),
            F.coalesce(F.bool_or(F.col("special_kind") == "turn_aborted"), F.lit(False)).alias("interrupted"),
            F.coalesce(F.bool_or(F.col("special_kind") == "compact_boundary"), F.lit(False)).alias("compacted"),
            *[F.sum(k).alias(k) for k in SUMS],
        )
        .withColumn("duration_ms", F.when(F.col("ended_at") >= F.col("started_at"), F.col("ended_at") - F.col("started_at")))
    )


def conversation_rollup(turns: DataFrame) -> DataFrame:
    """One row per conversation of segmented turns."""
    visible_user = (F.col("role") == "user") & F.col("visible")
    return turns.groupBy(CONV).agg(
        F.min("ts_ms").alias("started_at"), F.max("ts_ms").alias("last_activity_at"), F.count(F.lit(1)).alias("turn_count"),
        F.countDistinct("exchange_ordinal").alias("exchange_count"), F.min_by("model", F.when(F.col("model").isNotNull(), F.col("turn_index"))).alias("model"),
        F.min_by(C.title_line(F.col("text")), F.when(visible_user, F.col("turn_index"))).alias("first_line"), *[F.sum(k).alias(k) for k in SUMS],
    )


def stamp_tool_status(turns: DataFrame) -> DataFrame:
    """tool_status of calls from their outputs: the first output of known status after a call, in its exchange and pair,
    stamps the nearest call before it that is still unknown; a rejection for the pair overrides.
    """
    w = Window.partitionBy(CONV, "exchange_ordinal", "pair_id").orderBy("turn_index")
    ahead = w.rowsBetween(1, Window.unboundedFollowing)
    use = F.col("tool_direction") == "use"
    # calls of one pair are told apart by their number; an output belongs to the last call before it
    group = F.count_if(use).over(w.rowsBetween(Window.unboundedPreceding, 0))
    known = F.when((F.col("tool_direction") == "output") & (F.col("tool_status") != "unknown"), F.col("tool_status"))
    t = turns.withColumn("__call", F.when(F.col("pair_id").isNotNull(), group))
    per_call = Window.partitionBy(CONV, "exchange_ordinal", "pair_id", "__call").orderBy("turn_index").rowsBetween(1, Window.unboundedFollowing)
    first_output = F.first(known, ignorenulls=True).over(per_call)
    rejected = F.max(F.when(F.col("rejects_pair"), F.lit(True))).over(ahead) if "rejects_pair" in turns.columns else F.lit(None).cast("boolean")
    status = F.when(use & F.col("pair_id").isNotNull() & rejected, F.lit("rejected")).when(use & F.col("pair_id").isNotNull() & (F.coalesce("tool_status", F.lit("unknown")) == "unknown"), F.coalesce(first_output, F.col("tool_status"), F.lit("unknown")))
    return t.withColumn("tool_status", F.coalesce(status, F.col("tool_status"))).drop("__call")


def usage_delta(total: Column, window=None) -> Column:
    """Growth of a running total over the one before it, never negative."""
    w = window if window is not None else Window.partitionBy(CONV).orderBy("turn_index")
    return F.greatest(total - F.coalesce(F.lag(total).over(w), F.lit(0)), F.lit(0))


def usage_target(is_assistant: Column, is_message: Column) -> Column:
    """The turn that a usage record's tokens go to: the latest assistant turn of its exchange, else the next assistant message anywhere after."""
    here = F.last(F.when(is_assistant, F.col("turn_index")), ignorenulls=True).over(so_far("exchange_ordinal"))
    later = F.first(F.when(is_message, F.col("turn_index")), ignorenulls=True).over(after())
    return F.coalesce(here, later)


def counts_usage(message_id: Column, has_usage: Column, window=None) -> Column:
    """True for the first of consecutive usage records with one message id; records without an id always count."""
    w = window if window is not None else Window.partitionBy(CONV).orderBy("turn_index")
    before = F.last(F.when(has_usage & (F.coalesce(message_id, F.lit("")) != ""), message_id), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    own = F.coalesce(message_id, F.lit(""))
    return has_usage & ((own == "") | ~own.eqNullSafe(before))


def distinct_notifications(turns: DataFrame) -> DataFrame:
    """Notifications without their repeats: one row per conversation and signature, the first delivered or queued."""
    w = Window.partitionBy(CONV, "signature").orderBy("turn_index")
    return turns.where(F.col("signature").isNotNull()).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def merge_blocks(blocks: DataFrame, keys: list[str], order: str, kind: str, text: str) -> DataFrame:
    """Consecutive text blocks of a record join by line ends into one; other blocks stand alone (gaps and islands)."""
    w = Window.partitionBy(*keys).orderBy(order)
    is_text = F.col(kind).isin("text", "thinking")
    breaks = F.when(is_text & F.lag(is_text).over(w), F.lit(0)).otherwise(F.lit(1))
    islands = blocks.withColumn("island", F.sum(breaks).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return islands.groupBy(*keys, "island").agg(F.min(order).alias(order), F.min_by(kind, order).alias(kind), F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias(text))

"""Multi-party perspective rotation of dialogues, by DataFrame functions alone.

For every participant of a conversation the dialogue is rendered with that speaker as the
assistant and everybody else as a named user; system messages stay system messages.  One
row is one rendered message: concatenated in the order of ``position`` the rows of a
perspective are its dialogue, ``start`` is the message's place in it, and the mask span is the
part that the model learns (the content and the end mark of the assistant's messages).
A mark of the format inside a text or a name gets a backslash (one more, if it has some), and line ends in a
name become a space, so no message can forge another's frame; taking one backslash away gives the text back.

A conversation is never gathered in one row or task: messages get their position by prefix sums over
parts of at most ``PART_TURNS`` turns (dense parts are split by turn, speaker and the text's beginning), starts by prefix sums over
parts of ``PART_TURNS`` positions, and the participants of long conversations are replicated to salted parts.
Texts move once for their order and once to be rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.llm import support

PART_TURNS = 64
#: Messages of a part above which it is split further, and characters of the text that split it.
DENSE, PREFIX = 256, 32
#: Parts to which the participants of a long conversation are replicated.
SALTS = 64
#: Roles that frame the dialogue and take no perspective.
CONTEXT = ("system",)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\|(\\*)(im_start|im_end)\|>", r"<|\\$1$2|>")


def _positions(m: DataFrame, part_turns: int) -> DataFrame:
    """``m`` (conv_key, turn, speaker, text) with each message's position in its conversation."""
    m = m.withColumn("bucket", F.floor(F.coalesce("turn", F.lit(-(2**40))) / part_turns))
    counts = m.groupBy("conv_key", "bucket").agg(F.count(F.lit(1)).alias("n"))
    dense = F.broadcast(support.frequent(counts, ["conv_key", "bucket"], DENSE)).withColumn("dense", F.lit(True))
    m = m.join(dense, ["conv_key", "bucket"], "left")
    # a part's name orders as its rows do: null turns first, then by turn, speaker and text
    fine = F.col("dense").isNotNull()
    piece = F.struct("bucket", F.when(fine, F.col("turn")).alias("t"), F.when(fine, F.col("speaker")).alias("s"), F.when(fine, F.substring("text", 1, PREFIX)).alias("x"))
    m = m.withColumn("piece", piece).withColumn("one", F.lit(1).cast("bigint")).drop("bucket", "dense")
    return support.running_total(m, ["conv_key", "piece"], ["turn", "speaker", "text"], "one", "position").drop("piece", "one")


def rotate(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, perspective, position, turn, role, name, rendered, start, mask_start, mask_end of each message and perspective.

    ``conversations`` has conv_id, turn, role, text; other columns are ignored.  The speaker is the trimmed role; a null or
    blank one is 'unknown' and has a perspective like any other.  Messages are ordered by turn (null first), then speaker, then
    text; rows that repeat are messages of their own.  A null text renders as empty, a very long one whole.  A null conv_id is a
    conversation.  Conversations of system messages alone have no perspective and no rows; an empty table gives an empty result.
    Masks are character spans of the whole dialogue, empty (equal ends) for others' messages.
    """
    speaker = F.coalesce(F.nullif(F.trim("role"), F.lit("")), F.lit("unknown"))
    m = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), speaker.alias("speaker"), escaped(F.coalesce("text", F.lit(""))).alias("text"))
    m = support.materialise(m.withColumn("conv_key", support.never_null("conv_id", "bigint")), "messages")
    placed = support.materialise(_positions(m, part_turns), "placed-messages")
    people = m.where(~F.col("speaker").isin(*CONTEXT)).select("conv_key", F.col("speaker").alias("perspective")).distinct()
    long = F.broadcast(support.frequent(m.groupBy("conv_key").agg(F.count(F.lit(1)).alias("n")), ["conv_key"])).withColumn("salts", F.lit(SALTS))
    one = F.lit(1)
    salted = people.join(long, "conv_key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", one) - 1))).drop("salts")
    slim = placed.select("conv_key", "position", "speaker", F.length("text").alias("chars")).join(long, "conv_key", "left")
    slim = slim.withColumn("salt", F.pmod("position", F.coalesce("salts", one)).cast("int")).drop("salts")
    each = slim.join(salted, ["conv_key", "salt"]).drop("salt")
    own, context = F.col("speaker") == F.col("perspective"), F.col("speaker").isin(*CONTEXT)
    role = F.when(context, F.col("speaker")).when(own, F.lit("assistant")).otherwise(F.lit("user"))
    name = F.when(role == "user", F.col("speaker"))
    shown = escaped(F.regexp_replace("speaker", r"[\r\n]+", " "))
    head = F.concat(F.lit(OPEN), role, F.when(role == "user", F.concat(F.lit(" name="), shown)).otherwise(F.lit("")), F.lit("\n"))
    size = (F.length(head) + F.col("chars") + len(CLOSE)).cast("bigint")
    each = support.materialise(each.select("conv_key", "perspective", "position", F.floor(F.col("position") / part_turns).alias("piece"), role.alias("role"), name.alias("name"), own.alias("own"), head.alias("head"), size.alias("size")), "perspectives")
    started = support.running_total(each, ["conv_key", "perspective", "piece"], ["position"], "size", "start").drop("piece")
    r = started.join(placed.select("conv_key", "conv_id", "position", "turn", "text"), ["conv_key", "position"])
    begin = F.col("start") + F.length("head")
    return r.select(
        "conv_id", "perspective", "position", "turn", "role", "name",
        F.concat("head", "text", F.lit(CLOSE)).alias("rendered"), "start",
        begin.alias("mask_start"), F.when(F.col("own"), F.col("start") + F.col("size")).otherwise(begin).alias("mask_end"),
    )


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from every participant's perspective."""
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def _escaped_sql(text: str) -> str:
    return rf"regexp_replace({text}, '<\|(\\*)(im_start|im_end)\|>', '<|\\\1\2|>', 'g')"


ORACLE = f"""
WITH m AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(nullif(trim(role), ''), 'unknown') AS speaker, {_escaped_sql("coalesce(text, '')")} AS text FROM conversations),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM m WHERE speaker <> 'system'),
r AS (
  SELECT m.*, perspective, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
  FROM m JOIN people p ON m.conv_id IS NOT DISTINCT FROM p.conv_id),
h AS (
  SELECT *, CASE WHEN role = 'user' THEN speaker END AS name,
         '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || {_escaped_sql("regexp_replace(speaker, '[\\r\\n]+', ' ', 'g')")} ELSE '' END || chr(10) AS head FROM r),
s AS (
  SELECT *, length(head) + length(text) + {len(CLOSE)} AS size FROM h),
o AS (
  SELECT *, row_number() OVER w - 1 AS position,
         CAST(coalesce(sum(size) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM s WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text))
SELECT conv_id, perspective, CAST(position AS BIGINT) AS position, turn, role, name, head || text || '<|im_end|>' || chr(10) AS rendered, start,
       start + length(head) AS mask_start, CASE WHEN role = 'assistant' THEN start + size ELSE start + length(head) END AS mask_end
FROM o
"""

"""Exchanges of a stream of turns: per conversation, the number of turns and exchanges so far and where the open one began.

Exchanges are sessions that the data bounds (a real prompt), so no gap or watermark closes them; the state of a
conversation is four numbers, kept by Spark's state store and recovered with the stream's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "conversation_id string, turns bigint, exchanges bigint, open_turn bigint"


def _step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    turns, exchanges, open_turn = state.get if state.exists else (0, 0, -1)  # -1: no prompt yet
    for p in parts:
        starts = p.loc[p["opens"], "turn_index"]
        turns, exchanges = turns + len(p), exchanges + len(starts)
        if len(starts):
            open_turn = int(max(starts.max(), open_turn))
    state.update((turns, exchanges, open_turn))
    yield pd.DataFrame({"conversation_id": [key[0]], "turns": [turns], "exchanges": [exchanges], "open_turn": [open_turn]})


def exchange_state(turns: DataFrame) -> DataFrame:
    """A streaming DataFrame of conversations' states, for update mode; ``turns`` has conversation_id, turn_index, opens."""
    slim = turns.select("conversation_id", F.col("turn_index").cast("bigint"), "opens")
    out = slim.groupBy("conversation_id").applyInPandasWithState(_step, OUT, "turns bigint, exchanges bigint, open_turn bigint", "update", GroupStateTimeout.NoTimeout)
    return out.withColumn("open_turn", F.nullif("open_turn", F.lit(-1)))


def drain(stream: DataFrame, folder: str) -> DataFrame:
    """Run an update-mode stream until its source is empty; the table of every state it told, by batch.

    A batch overwrites its own folder, so one that is repeated after a failure leaves no copies.
    """
    spark = stream.sparkSession

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/states/batch={number}")

    q = stream.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(f"{OUT}, batch int").parquet(f"{folder}/states")


def latest(states: DataFrame) -> DataFrame:
    """Each conversation's last state."""
    s = states.groupBy("conversation_id").agg(F.max_by(F.struct("turns", "exchanges", "open_turn"), "batch").alias("s"))
    return s.select("conversation_id", "s.turns", "s.exchanges", "s.open_turn")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared checkpoint folder, or below a temporary one where none is set."""
    import tempfile
    import uuid

    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="threadmill-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"

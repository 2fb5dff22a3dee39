"""Commitments of conversations whose turns come late and unordered, as a stream that keeps state and closes it.

A speaker's part of a conversation is a session: turns less than `idle` of event time apart. Its state is a row of Spark's own
aggregates (turns, the last low one, the first accusation, and the high ones, of which the first after the last low one is looked for
when it closes), so no key costs a call of Python. It is told once, when the watermark has passed its end, and forgotten, and a result does
not depend on how turns were dealt to batches. Turns that come when their session would have ended are dropped and counted.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

NONE = -1


def fold(state: tuple[int, int, int, int], turns: list[tuple[int, int, bool, bool]]) -> tuple[int, int, int, int]:
    """The state (turns, last low, first high after it, first accusation) after turns (at, turn, high, accused) in order: the rule that the aggregates follow."""
    count, low, first, public = state
    for _, turn, high, accused in turns:
        if high:
            first = turn if first == NONE else first
        else:
            low, first = turn, NONE
        if accused and public == NONE:
            public = turn
        count += 1
    return count, low, first, public


def closed_conversations(turns: DataFrame, threshold: float, delay: str, idle: timedelta) -> DataFrame:
    """turns (conv, speaker, turn, ts, score, accused), a stream, to (conv, speaker, n_turns, t_private, t_public, commitment_gap).

    A row for each speaker of a conversation, once it is closed: no turn for `idle`. delay: how late a turn may come; a later one still counts
    where its conversation is open, and is dropped where it would have ended. A null
    score counts as low, a null accusation as none; a turn without conv, speaker, turn or ts takes no part. A turn given twice counts
    twice in n_turns. Turns of a conversation that was closed open another of the same name.
    """
    clean = turns.where("conv is not null and speaker is not null and turn is not null and ts is not null").withWatermark("ts", delay)
    place = F.struct(F.unix_millis("ts").alias("at"), F.col("turn").cast("long").alias("turn"))
    high = F.coalesce(F.col("score") >= threshold, F.lit(False))
    idle_ms = int(idle.total_seconds() * 1000)
    held = clean.groupBy(
        F.col("conv").cast("string").alias("conv"), F.col("speaker").cast("string").alias("speaker"), F.session_window("ts", f"{idle_ms} milliseconds")
    ).agg(
        F.count("*").alias("n_turns"), F.max(F.when(~high, place)).alias("low"), F.collect_list(F.when(high, place)).alias("highs"),
        F.min(F.when(F.col("accused"), place)).alias("public"),
    )
    after = F.array_min(F.filter("highs", lambda x: F.col("low").isNull() | (x >= F.col("low"))))  # low comes before high in one place
    return held.select("conv", "speaker", "n_turns", after["turn"].alias("t_private"), F.col("public.turn").alias("t_public")).withColumn(
        "commitment_gap", F.col("t_public") - F.col("t_private")
    )


def dropped(query: StreamingQuery) -> int:
    """Turns that came too late, over the batches that the query remembers; those of one speaker and time that came together count once."""
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])


def run_to_end(closing: DataFrame, place: str) -> tuple[DataFrame, StreamingQuery]:
    """What the stream tells until its sources have no more, written below place, and the query, for dropped().

    Run again on the same place, it goes on where it ended; the file sink takes each batch once.
    """
    spark = closing.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = closing.writeStream.format("parquet").outputMode("append").option("path", f"{place}/out").option(
            "checkpointLocation", f"{place}/state"
        ).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(closing.schema).parquet(f"{place}/out"), query

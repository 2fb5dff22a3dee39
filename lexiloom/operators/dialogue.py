"""Two models in conversation: a round asks every open conversation's next speaker at once."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.text import parse_turn
from lexiloom.plans.buckets import append, bucketed
from lexiloom.plans.lineage import shared_dir
from lexiloom.sources.schemas import AGENT, TURN

# The two roles, what follows the other side's words, turns of each side, the first seed.
ROLES = ["initiator", "responder"]
REMINDER = "\n[Respond with a JSON object only — no other text.]"
MOST_TURNS, SEED = 12, 42

MESSAGES = "array<struct<role: string, content: string>>"
ANSWER = f"conv_id string, me {AGENT}, answer string, prompt_tokens int, gen_tokens int, latency_ms double"


def messages(history: Column, me: Column, system: Column, suffix: str = REMINDER) -> Column:
    """What a speaker is shown: the system text, own replies as `assistant`, the other's as `user` with the suffix."""
    said = F.transform(
        history,
        lambda x: F.when(
            x["speaker_id"] == me, F.struct(F.lit("assistant").alias("role"), x["reply"].alias("content"))
        ).otherwise(F.struct(F.lit("user").alias("role"), F.concat(x["reply"], F.lit(suffix)).alias("content"))),
    )
    return F.concat(F.array(F.struct(F.lit("system").alias("role"), system.alias("content"))), said).cast(MESSAGES)


def ask(rows: DataFrame, provider: Callable[[str, list[dict], int], tuple[str, int, int]]) -> DataFrame:
    """rows (conv_id, me, model_id, messages, seed) to their answers. A call that raises is a null answer of no tokens that keeps its latency."""

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            columns = ("conv_id", "me", "model_id", "messages", "seed")
            for conv, me, model, shown, seed in zip(*(frame[c] for c in columns), strict=True):
                began = time.monotonic()
                try:
                    got = provider(model, [dict(m) for m in shown], int(seed))
                except Exception:  # any failure of the model's server is a neutral turn
                    got = (None, 0, 0)
                out.append((conv, me, *got, (time.monotonic() - began) * 1000))
            yield pd.DataFrame(out, columns=["conv_id", "me", "answer", "prompt_tokens", "gen_tokens", "latency_ms"])

    return rows.select("conv_id", "me", "model_id", "messages", "seed").mapInPandas(call, ANSWER)


def heard(log: DataFrame) -> DataFrame:
    """(conv_id, history, over) of a log of turns: what was said, in order, and whether somebody accused. Within buckets, without an exchange."""
    said = F.array_sort(F.collect_list(F.struct("turn_idx", "speaker_id", "reply")))
    return log.groupBy("conv_id").agg(said.alias("history"), F.max("public_accusation").alias("over"))


def converse(
    configs: DataFrame, provider: Callable[[str, list[dict], int], tuple[str, int, int]], systems: dict[str, str],
    most_turns: int = MOST_TURNS, buckets: int | None = None,
) -> DataFrame:
    """The turns (schema TURN) of conversations (conv_id, agent_A_cfg, agent_B_cfg, seed).

    A speaks at even turns and B at odd ones, `most_turns` times each, until either accuses. Only replies pass between
    them. Configs and the log of turns are bucketed by conv_id, so a round reads histories where they lie, and what is shuffled is its
    new turns alone. A round is appended to the log before the next one begins, so a lost executor repeats no call of earlier
    rounds. conv_id tells configs apart; a null conv_id takes no part. buckets: as many as shuffle partitions unless given.
    """
    spark = configs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = f"{shared_dir(spark)}/dialogue-{uuid.uuid4().hex}"
    cfg = f"conv_id string, agent_A_cfg {AGENT}, agent_B_cfg {AGENT}, seed int"
    parties, log = bucketed(spark, f"{place}/configs", cfg, "conv_id", buckets), bucketed(spark, f"{place}/log", TURN, "conv_id", buckets)
    agents = [F.col(f"agent_{x}_cfg").cast(AGENT).alias(f"agent_{x}_cfg") for x in "AB"]
    rows = configs.where("conv_id is not null").select(
        F.col("conv_id").cast("string").alias("conv_id"), *agents, F.coalesce(F.col("seed"), F.lit(SEED)).cast("int").alias("seed")
    )
    append(rows, parties, "conv_id", buckets)
    for turn in range(2 * most_turns):
        who, role = "AB"[turn % 2], ROLES[turn % 2]
        me = F.col(f"agent_{who}_cfg")
        open_ = spark.table(parties)
        if turn:
            # both are bucketed alike, and however small they are a broadcast would move all histories
            open_ = open_.hint("merge").join(heard(spark.table(log)), "conv_id").where(~F.col("over"))
        else:
            open_ = open_.withColumn("history", F.array().cast("array<struct<turn_idx: int, speaker_id: string, reply: string>>"))
        shown = messages(F.col("history"), F.lit(who), F.lit(systems[role]))
        answers = ask(open_.select("conv_id", me.alias("me"), me["model_id"].alias("model_id"), shown.alias("messages"), (F.col("seed") + turn).alias("seed")), provider)
        said = answers.withColumn("t", F.when(F.col("answer").isNotNull(), parse_turn(F.col("answer"))).otherwise(parse_turn(F.lit("{}"))))
        trap = F.struct(F.col("t.plan").alias("plan"), F.col("t.trap").alias("type"))
        now = said.select(
            "conv_id", F.lit(turn).alias("turn_idx"), F.lit(who).alias("speaker_id"), F.lit(role).alias("speaker_role"), "me.model_id", "me.adapter_id",
            "prompt_tokens", "gen_tokens", "latency_ms", "me.ground_truth_is_llm", "t.reply", "t.suspicion_score", "t.reasoning_trace", "t.cues",
            trap.alias("trap_strategy"), "t.public_accusation",
        )
        append(now, log, "conv_id", buckets)
        if not spark.table(log).where(F.col("turn_idx") == turn).limit(1).count():
            break
    return spark.table(log)


def failed(turns: DataFrame) -> DataFrame:
    """turns with is_failed: a call that raised has no tokens of either kind."""
    return turns.withColumn("is_failed", (F.col("prompt_tokens") == 0) & (F.col("gen_tokens") == 0))

"""Two-party conversations: histories, commitments, outcomes, trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.plans.broadcasts import small

# The score from which a speaker is suspicious, and a curve's fall.
SUSPICIOUS, HIGH, FALL = 0.7, 0.5, 0.2


def perspective_history(turns: DataFrame, conv: str, turn: str, speaker: str, text: str, suffix: str = "") -> DataFrame:
    """turns with history: what was said before, as the one about to speak sees it; the other side's words get the suffix."""
    before = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    said = F.collect_list(F.struct(F.col(speaker).alias("s"), F.col(text).alias("t"))).over(before)
    mine = lambda x: x["s"] == F.col(speaker)
    view = F.transform(
        said,
        lambda x: F.struct(
            F.when(mine(x), "assistant").otherwise("user").alias("role"),
            F.when(mine(x), x["t"]).otherwise(F.concat(x["t"], F.lit(suffix))).alias("content"),
        ),
    )
    return turns.withColumn("history", view)


def commitments(
    turns: DataFrame, conv: str, speaker: str, turn: str, score: Column, accused: Column, threshold: float = SUSPICIOUS
) -> DataFrame:
    """(conv, speaker, t_private, t_public, commitment_gap).

    t_private: the first turn from which all scores of the speaker reach the threshold; t_public: the first accusation.
    t_private follows the last turn below the threshold, so two aggregations do and no conversation needs a sort.
    """
    rows = turns.select(
        conv, speaker, F.col(turn).alias("t"), (F.coalesce(score, F.lit(0.0)) >= threshold).alias("high"), accused.alias("accused")
    )
    last = rows.groupBy(conv, speaker).agg(
        F.max(F.when(~F.col("high"), F.col("t"))).alias("low"), F.min(F.when(F.col("accused"), F.col("t"))).alias("t_public")
    )
    after = rows.join(
        last.select(conv, speaker, "low"), [conv, speaker]
    ).where("high and (low is null or t > low)").groupBy(conv, speaker).agg(F.min("t").alias("t_private"))
    return last.join(after, [conv, speaker], "left").select(
        conv, speaker, "t_private", "t_public", (F.col("t_public") - F.col("t_private")).alias("commitment_gap")
    )


def outcome(turns: DataFrame, conv: str, turn: str, speaker: str, accused: Column) -> DataFrame:
    """(conv, n_turns, t_end, winner, termination_reason)."""
    first = F.min(F.when(accused, F.struct(F.col(turn).alias("t"), F.col(speaker).alias("s"))))
    one = turns.groupBy(conv).agg(F.count("*").alias("n_turns"), first.alias("first"))
    return one.select(
        conv, "n_turns", F.col("first.t").alias("t_end"), F.col("first.s").alias("winner"),
        F.when(F.col("first").isNull(), "max_turns").otherwise("accusation").alias("termination_reason"),
    )


def until_end(turns: DataFrame, outcomes: DataFrame, conv: str, turn: str) -> DataFrame:
    """Turns up to the first accusation."""
    return turns.join(outcomes.select(conv, "t_end"), conv).where(F.col("t_end").isNull() | (F.col(turn) <= F.col("t_end"))).drop("t_end")


def rollup_conversations(outcomes: DataFrame, metrics: DataFrame, conv: str, speaker: str, first: Column) -> DataFrame:
    """Outcomes with the winner's metrics, or the first speaker's where nobody won."""
    named = outcomes.withColumn("__who", F.coalesce("winner", first))
    m = metrics.withColumnsRenamed({conv: "__c", speaker: "__s"})
    return named.join(m, (F.col(conv) == F.col("__c")) & (F.col("__who") == F.col("__s")), "left").drop("__c", "__s", "__who")


def for_all_speakers(outcomes: DataFrame, metrics: DataFrame, conv: str, speaker: str, speakers: list[str]) -> DataFrame:
    """A row for each conversation and speaker; one who said nothing has null metrics."""
    every = outcomes.select(conv, F.explode(F.array(*map(F.lit, speakers))).alias(speaker))
    return every.join(metrics, [conv, speaker], "left")


def correctness(winner: Column, who: str, other_is_model: Column) -> Column:
    """Whether an accuser was right; null for one who did not accuse."""
    return F.when(winner == who, other_is_model)


def batch_summary(records: DataFrame) -> DataFrame:
    """One row: conversations by how they ended, commitment gaps as (gap, n) in order, their number and mean."""
    gaps = records.where("commitment_gap is not null").groupBy(F.col("commitment_gap").alias("gap")).agg(F.count("*").alias("n"))
    listed = gaps.agg(F.sort_array(F.collect_list(F.struct("gap", "n"))).alias("gaps"))  # a row for each different gap
    return _summary(records).crossJoin(F.broadcast(listed))


def _summary(records: DataFrame) -> DataFrame:
    return records.agg(
        F.count("*").alias("n"), F.count_if(F.col("termination_reason") == "accusation").alias("n_accusation"),
        F.count_if(F.col("termination_reason") == "max_turns").alias("n_max_turns"), F.count("commitment_gap").alias("n_gaps"),
        F.avg("commitment_gap").alias("mean_gap"),
    )


def trajectory(turns: DataFrame, turn: str, speaker: str, speakers: list[str], score: Column) -> DataFrame:
    """Mean score by turn, a column for each speaker."""
    return turns.groupBy(turn).agg(*[F.avg(F.when(F.col(speaker) == s, score)).alias(s) for s in speakers])


def trap_histogram(turns: DataFrame, kind: Column) -> DataFrame:
    return turns.select(kind.alias("trap")).where("trap is not null and trap <> 'none'").groupBy("trap").agg(F.count("*").alias("n"))


def violations(turns: DataFrame, kinds: list[str]) -> DataFrame:
    """Turns (reply, suspicion_score, trap, public_accusation, ...) that break the schema, with what they break."""
    found = F.array_compact(
        F.array(
            F.when(F.col("reply").isNull(), "reply missing"), F.when(F.col("suspicion_score").isNull(), "score missing"),
            F.when(~F.col("suspicion_score").between(0, 1), "score out of range"), F.when(F.col("trap").isNull(), "trap missing"),
            F.when(~F.col("trap").isin(kinds), "trap unknown"), F.when(F.col("public_accusation").isNull(), "accusation missing"),
        )
    )
    return turns.withColumn("violations", found).where(F.size("violations") > 0)


def censored(outcomes: DataFrame, longest: Column) -> DataFrame:
    """(…, time, event): the accusation's turn, or the last possible one where there was none."""
    return outcomes.select("*", F.coalesce("t_end", longest).alias("time"), F.col("t_end").isNotNull().alias("event"))


def non_monotonic(turns: DataFrame, keys: list[str], turn: str, score: Column, high: float = HIGH, fall: float = FALL) -> DataFrame:
    """(keys, non_monotonic): whether a score falls by `fall` below the highest one before, that one having reached `high`."""
    before = Window.partitionBy(*keys).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    peak = F.max("__s").over(before)
    rows = turns.select(*keys, turn, score.alias("__s")).withColumn("__p", peak)
    return rows.groupBy(*keys).agg(
        F.coalesce(F.bool_or((F.col("__p") >= high) & (F.col("__p") - F.col("__s") >= fall)), F.lit(False)).alias("non_monotonic")
    )


def peaks(turns: DataFrame, keys: list[str], turn: str, score: Column) -> DataFrame:
    """(keys, n_peaks, n_valleys) of the scores in turn order."""
    w = Window.partitionBy(*keys).orderBy(turn)
    rows = turns.select(*keys, turn, score.alias("s")).withColumns({"b": F.lag("s").over(w), "a": F.lead("s").over(w)})
    return rows.groupBy(*keys).agg(
        F.count_if((F.col("s") > F.col("b")) & (F.col("s") > F.col("a"))).alias("n_peaks"),
        F.count_if((F.col("s") < F.col("b")) & (F.col("s") < F.col("a"))).alias("n_valleys"),
    )


def divergence(reply: Column, trace: Column) -> Column:
    """One less the Jaccard similarity of two texts' words."""
    a, b = (F.array_distinct(F.filter(F.split(F.lower(x), r"\W+"), lambda w: w != "")) for x in (reply, trace))
    return 1 - F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(1.0))


def accuracy_by(records: DataFrame, keys: list[str], correct: str) -> DataFrame:
    """Share of right accusations for each prefix of keys, and over all."""
    return records.where(F.col(correct).isNotNull()).rollup(*keys).agg(
        F.count("*").alias("n"), F.avg(F.col(correct).cast("double")).alias("accuracy")
    )


def pairing_means(turns: DataFrame, pairing: Column, score: Column) -> DataFrame:
    return turns.groupBy(pairing.alias("pairing")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"))


def pairing_matrix(variants: DataFrame, name: str, repeats: int, seed: int = 42) -> DataFrame:
    """Every ordered pair of a registry's variants, `repeats` times, with a seed each."""
    a, b = variants.select(F.col(name).alias("variant_a")), variants.select(F.col(name).alias("variant_b"))
    return a.crossJoin(small(b)).withColumn(
        "repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))
    ).withColumn("seed", F.col("repeat") + seed)

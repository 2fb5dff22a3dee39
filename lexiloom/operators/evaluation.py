"""Windows, perplexity, choices, markers, and the gates on them. Scores come as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.text import DEDUCTION, HEDGING, marker_count, marker_density, word_count

# Gates, and the form of a question.
PERPLEXITY_DROP, PERPLEXITY_DRIFT, ACCURACY_DROP = 0.05, 0.05, 3.0
QUESTION = "The following is a multiple-choice question. Choose the single best answer.\n\n%s\nA. %s\nB. %s\nC. %s\nD. %s\n\nAnswer:"


def window_plan(docs: DataFrame, n: str, keep: list[str], longest: int = 1024, stride: int = 512) -> DataFrame:
    """keep, begin, end, target_len of the sliding windows over n tokens; no window begins once one has ended at n."""
    begins = F.explode(
        F.sequence(F.lit(0), F.greatest(F.ceil((F.col(n) - longest) / stride), F.lit(0)) * stride, F.lit(stride).cast("long"))
    )
    cut = docs.where(F.col(n) > 0).select(*keep, F.col(n).alias("__n"), begins.alias("begin"))
    end = F.least(F.col("begin") + longest, F.col("__n"))
    before = F.when(F.col("begin") > 0, F.least(F.col("begin") - stride + longest, F.col("__n"))).otherwise(0)
    return cut.select(*keep, "begin", end.alias("end"), (end - before).alias("target_len"))


def perplexity(windows: DataFrame, by: list[str]) -> DataFrame:
    return windows.groupBy(*by).agg(F.exp(F.sum(F.col("loss") * F.col("target_len")) / F.sum("target_len")).alias("perplexity"))


def first_tokens(tokens: Column, most: int = 8192) -> Column:
    return F.slice(tokens, 1, most)


def perplexity_gate(base_in: Column, tuned_in: Column, base_out: Column, tuned_out: Column) -> Column:
    """drop on held-out text at least 5 %, drift on general text at most 5 % either way."""
    drop, drift = (base_in - tuned_in) / base_in, (tuned_out - base_out) / base_out
    return F.struct(
        drop.alias("drop"), drift.alias("drift"), (drop >= PERPLEXITY_DROP).alias("h1"), (F.abs(drift) <= PERPLEXITY_DRIFT).alias("h2")
    )


def question(text: Column, choices: Column) -> Column:
    return F.format_string(QUESTION, text, *[choices[i] for i in range(4)])


def best_choice(scores: Column) -> Column:
    """The first of the largest scores, from 0."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def first_of_group(rows: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= n).drop("rank")


def accuracy(rows: DataFrame, by: str, correct: Column) -> DataFrame:
    """Per group, and over all rows as `ALL`."""
    rolled = rows.withColumn("ok", correct.cast("long")).rollup(by).agg(
        F.count("*").alias("n"), F.sum("ok").alias("correct"), F.grouping(by).alias("whole")
    )
    return rolled.select(
        F.when(F.col("whole") == 1, "ALL").otherwise(F.col(by).cast("string")).alias(by), "n", "correct",
        (F.col("correct") / F.col("n")).alias("accuracy"),
    )


def accuracy_gate(base: Column, tuned: Column) -> Column:
    return (base - tuned) * 100 < ACCURACY_DROP


def accuracy_tier(base: Column, tuned: Column) -> Column:
    drop = (base - tuned) * 100
    return F.when(drop < 3, "pass").when(drop <= 5, "flag").otherwise("stop")


def score_markers(rows: DataFrame, text: str, more: list[str] = DEDUCTION, less: list[str] = HEDGING) -> DataFrame:
    counted = rows.withColumns(
        {
            "n_deduction_markers": marker_count(F.col(text), more), "n_hedging_markers": marker_count(F.col(text), less),
            "word_count": word_count(F.col(text)),
        }
    )
    return counted.withColumn(
        "deduction_density", marker_density(F.col("n_deduction_markers"), F.col("n_hedging_markers"), F.col("word_count"))
    )


def variants(probes: DataFrame, names: list[str]) -> DataFrame:
    return probes.withColumn("variant", F.explode(F.array(*map(F.lit, names))))


def mean_density(scored: DataFrame, names: list[str], by: str = "category", density: str = "deduction_density") -> DataFrame:
    """A row for each category, a column for each variant: mean of the rounded densities, 0.0 where there are none."""
    return scored.groupBy(by).agg(*[F.coalesce(F.avg(F.when(F.col("variant") == v, F.col(density))), F.lit(0.0)).alias(v) for v in names])


def probe_gate(base: Column, tuned: Column) -> Column:
    return tuned > base


def decide(h1: Column, h2: Column, h3: Column, h4: Column) -> Column:
    """The first gate that fails, in the order perplexity, capability, probes; else proceed."""
    return F.when(~(h1 & h2), "stop: perplexity").when(~h3, "stop: capability").when(~h4, "stop: probes").otherwise("proceed")

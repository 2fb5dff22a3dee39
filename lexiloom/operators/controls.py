"""Control corpora, judged probes, samples for checking by hand, and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lexiloom.operators.labeling import hash_order
from lexiloom.plans.numbering import running_total

# Sampled answers for a probe, the share of them that is checked by hand.
SAMPLES, CHECKED = 3, 0.2
SENTENCE_END = r"(?<=[.!?])\s+"


def shuffle_sentences(text: Column, key: Column, seed: int = 42) -> Column:
    """The text's sentences in a seeded order that key decides: words kept, argument lost. Joined by spaces."""
    cut = F.split(text, SENTENCE_END, -1)
    named = F.transform(
        cut,
        lambda s, i: F.struct(
            F.sha2(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), i.cast("string")), 256).alias("h"), s.alias("s")
        ),
    )
    return F.array_join(F.transform(F.array_sort(named), lambda x: x["s"]), " ")


def match_tokens(docs: DataFrame, key: str, tokens: str, target: int, seed: int = 42) -> DataFrame:
    """Documents in a seeded order as long as their tokens together stay within the target, with tokens_so_far.

    key tells rows apart. A row without tokens counts as none.
    """
    shuffled = docs.withColumns({"__h": hash_order(seed, key), "__n": F.coalesce(F.col(tokens).cast("long"), F.lit(0))})
    return running_total(shuffled, ["__h", key], "__n", "tokens_so_far").where(F.col("tokens_so_far") <= target).drop("__h", "__n")


def sampled_probes(probes: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Each probe once for each answer to be drawn."""
    return probes.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(samples))))


def judged(scores: DataFrame, by: list[str], dimensions: list[str]) -> DataFrame:
    """(by, dimension, n, mean, spread) from one row an answer with a column for each dimension; nulls are no score."""
    long = scores.unpivot(by, dimensions, "dimension", "score").where("score is not null")
    return long.groupBy(*by, "dimension").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("spread"))


def checked_by_hand(seed: int, *keys: str, share: float = CHECKED) -> Column:
    """Whether a row falls into the seeded share that is checked by hand."""
    return F.conv(F.substring(hash_order(seed, *keys), 1, 8), 16, 10).cast("long") < int(share * 2**32)


def progress(rows: DataFrame, label: str, labels: list[str], name: str = "progress") -> tuple[DataFrame, Observation]:
    """rows, and the counts that are known once they have been written: all rows and each label, from the same pass."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(label) == x).alias(x) for x in labels]), seen

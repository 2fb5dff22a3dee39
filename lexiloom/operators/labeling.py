"""Labels by an external model, kept by content, and what they add up to."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lexiloom.functions.text import cache_key, parse_label, parse_reason
from lexiloom.operators.corpus import LABELS
from lexiloom.plans.lineage import materialise
from lexiloom.sources.io import read_jsonl_quarantined, write_jsonl


def call_once(rows: DataFrame, key: str, prompt: str, provider: Callable[[list[str]], list[str | None]]) -> DataFrame:
    """(key, answer, error): the provider is asked once for each key, in batches; an answer of None is a failure.

    Where a batch raises, its prompts are asked one by one, and those that raise fail with the error's text.
    """

    def one(text: str) -> tuple[str | None, str | None]:
        try:
            return provider([text])[0], None
        except Exception as error:  # whatever a model's server does, the rows go on
            return None, str(error)

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame[prompt].tolist()
            try:
                got = [(answer, None) for answer in provider(texts)]
            except Exception:
                got = [one(text) for text in texts]
            yield pd.DataFrame({key: frame[key], "answer": [a for a, _ in got], "error": [e for _, e in got]})

    return rows.groupBy(key).agg(F.min(prompt).alias(prompt)).mapInPandas(ask, f"{key} string, answer string, error string")


def read_cache(spark: SparkSession, path: str, key: str = "key") -> DataFrame:
    """(key, answer, error) of a cache written by write_cache(); an entry that cannot be read counts as none, and so does a cache that is not there."""
    schema = f"{key} string, answer string, error string"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    good, _ = read_jsonl_quarantined(spark, path, schema)
    return good.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.min_by(F.struct("answer", "error"), F.col("answer").isNull()).alias("r")
    ).select(key, "r.*")


def write_cache(fresh: DataFrame, path: str) -> None:
    write_jsonl(fresh, path, "append")


def memoised(rows: DataFrame, key: str, prompt: str, cache: DataFrame, provider, keep_failures: bool) -> tuple[DataFrame, DataFrame]:
    """rows with answer, error and cached, and the new cache rows (key, answer, error).

    Answers are written down before either result is read, so a retried task asks nobody twice.
    """
    error = F.col("error") if "error" in cache.columns else F.lit(None).cast("string")
    known = cache.select(F.col(key), F.col("answer").alias("held"), error.alias("held_error"), F.lit(True).alias("hit"))
    misses = rows.join(cache.select(key), key, "left_anti")
    fresh = materialise(call_once(misses, key, prompt, provider))
    joined = rows.join(known, key, "left").join(fresh, key, "left")
    out = joined.withColumns(
        {"answer": F.coalesce("held", "answer"), "error": F.coalesce("held_error", "error"), "cached": F.coalesce("hit", F.lit(False))}
    )
    return out.drop("held", "held_error", "hit"), fresh if keep_failures else fresh.where("answer is not null")


def classify(chunks: DataFrame, cache: DataFrame, provider, model: str, version: str) -> tuple[DataFrame, DataFrame]:
    """chunks with label, justification, model, prompt_version, cached.

    Failures are the label `error` with the error's text as justification, and are kept in the cache.
    """
    rows = chunks.withColumn("key", cache_key(F.lit(model), F.lit(version), F.col("content")))
    out, fresh = memoised(rows, "key", "content", cache, provider, keep_failures=True)
    label = F.when(F.col("answer").isNull(), "error").otherwise(parse_label(F.col("answer")))
    reason = F.when(F.col("answer").isNull(), F.coalesce("error", F.lit(""))).otherwise(parse_reason(F.col("answer")))
    out = out.withColumns({"label": label, "justification": reason, "model": F.lit(model), "prompt_version": F.lit(version)})
    return out.drop("key", "answer", "error"), fresh


def distribution(rows: DataFrame, label: str = "label", domain: list[str] = LABELS) -> DataFrame:
    """(label, n, pct, bar) over the whole domain, zeros included."""
    names = rows.sparkSession.createDataFrame([(x, i) for i, x in enumerate(domain)], "label string, place int")
    counts = rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("c"))
    filled = names.join(counts, "label", "left").withColumn("n", F.coalesce("c", F.lit(0)))
    pct = F.coalesce(F.try_divide(F.col("n") * 100.0, F.sum("n").over(Window.partitionBy())), F.lit(0.0))
    return filled.withColumn("pct", pct).select(
        "label", "n", "pct", F.repeat(F.lit("#"), F.floor(F.col("pct") / 2).cast("int")).alias("bar")
    )


def pivot_labels(rows: DataFrame, by: str, labels: list[str], label: str = "label") -> DataFrame:
    """A row for each group with a count for each label and their total."""
    return rows.groupBy(by).agg(*[F.count_if(F.col(label) == x).alias(x) for x in labels], F.count("*").alias("total"))


def crosstab_share(rows: DataFrame, by: str, labels: list[str], label: str = "label") -> DataFrame:
    """pivot_labels() as shares of a row, with a row `ALL` for the whole."""
    rolled = rows.rollup(by).agg(
        *[F.avg((F.col(label) == x).cast("double")).alias(f"share_{x}") for x in labels], F.count("*").alias("total"),
        F.grouping(by).alias("whole"),
    )
    return rolled.select(F.when(F.col("whole") == 1, "ALL").otherwise(F.col(by)).alias(by), *[f"share_{x}" for x in labels], "total")


def hash_order(seed: int, *columns: str) -> Column:
    """A seeded order of rows that any engine can repeat."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]), 256)


def sample_rows(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    return rows.orderBy(hash_order(seed, key)).limit(n)


def stratified_sample(rows: DataFrame, key: str, label: str, n: int, seed: int = 42) -> DataFrame:
    """At most n rows of each label."""
    rank = F.row_number().over(Window.partitionBy(label).orderBy(hash_order(seed, key), key))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)


def evaluate_models(rows: DataFrame, models: list[str]) -> DataFrame:
    """Each row for each model."""
    return rows.withColumn("model", F.explode(F.array(*map(F.lit, models))))


def ask_models(rows: DataFrame, models: list[str], text: str, provider: Callable[[str, str], str]) -> DataFrame:
    """Each row for each model with label, justification, raw_response and latency_ms; a call that raises is the label `error`."""
    spread = evaluate_models(rows, models)
    at, model = spread.columns.index(text), len(spread.columns) - 1

    def ask(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            answers, errors, took = [], [], []
            for asked, name in zip(part.column(at).to_pylist(), part.column(model).to_pylist(), strict=True):
                began = time.monotonic()
                try:
                    answers.append(provider(name, asked))
                    errors.append(None)
                except Exception as error:  # a failed call is a row like any other
                    answers.append(None)
                    errors.append(str(error))
                took.append((time.monotonic() - began) * 1000)
            more = [pa.array(answers, pa.string()), pa.array(errors, pa.string()), pa.array(took, pa.float64())]
            yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, "raw_response", "error", "latency_ms"])

    schema = StructType(
        spread.schema.fields + [
            StructField("raw_response", StringType()), StructField("error", StringType()), StructField("latency_ms", DoubleType())
        ]
    )
    got = materialise(spread.mapInArrow(ask, schema))
    answer = F.col("raw_response")
    label = F.when(answer.isNull(), "error").otherwise(parse_label(answer))
    reason = F.when(answer.isNull(), F.coalesce("error", F.lit(""))).otherwise(parse_reason(answer))
    return got.withColumns({"label": label, "justification": reason, "raw_response": F.coalesce(answer, F.lit(""))}).drop("error")


def compare(long: DataFrame, key: str, a: str, b: str, label: str = "label") -> DataFrame:
    """(key, label_a, label_b, flag) from one row for each key and model."""
    wide = long.where(F.col("model").isin(a, b)).groupBy(key).agg(
        F.max(F.when(F.col("model") == a, F.col(label))).alias("label_a"), F.max(F.when(F.col("model") == b, F.col(label))).alias("label_b")
    )
    return wide.withColumn("flag", F.when(F.col("label_a") != F.col("label_b"), "[DISAGREE]").otherwise(""))


def agreement(compared: DataFrame) -> DataFrame:
    return compared.agg(
        F.count("*").alias("n"), F.count_if(F.col("label_a") == F.col("label_b")).alias("n_agree"),
        F.avg((F.col("label_a") == F.col("label_b")).cast("double")).alias("rate"),
    )


def direction(compared: DataFrame, ordered: list[str] = LABELS[:3]) -> DataFrame:
    """How often a is above, below or equal to b in the order of labels."""
    place = lambda c: F.array_position(F.array(*map(F.lit, ordered)), F.col(c))
    sign = F.signum(place("label_a") - place("label_b"))
    return compared.where(F.col("label_a").isin(ordered) & F.col("label_b").isin(ordered)).groupBy(
        F.when(sign > 0, "higher").when(sign < 0, "lower").otherwise("equal").alias("direction")
    ).agg(F.count("*").alias("n"))


def scenarios(rows: DataFrame, factors: list[int], label: str = "label", count: str = "word_count") -> DataFrame:
    """Words and tokens by label for each oversampling factor."""
    base = rows.groupBy(label).agg(F.sum(count).alias("w"))
    return base.withColumn("factor", F.explode(F.array(*map(F.lit, factors)))).select(
        label, "factor", (F.col("w") * F.col("factor")).alias("words"),
        F.floor(F.col("w") * F.col("factor") * 1.33).cast("long").alias("tokens"),
    )

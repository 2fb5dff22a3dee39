"""Dense numbers without a window over one partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.plans.lineage import materialise


def number_within(df: DataFrame, keys: list[str], order: list[str], into: str, spread: int = 64, bucket: Column | None = None) -> DataFrame:
    """Gapless numbers from 0 within keys, without all rows of a key in one task.

    Rows of a key are cut into `spread` buckets (by a hash of the order columns unless `bucket` is
    given), numbered there, and moved by the sizes of the buckets before them. The sizes are one
    row a key and bucket. Rows equal in keys and order get different numbers.
    """
    bucket = F.pmod(F.xxhash64(*order), F.lit(spread)) if bucket is None else bucket
    cut = df.withColumn("__bucket", bucket)
    sizes = cut.groupBy(*keys, "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__bucket").alias("__b"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"),
    )
    within = F.row_number().over(Window.partitionBy(*keys, "__bucket").orderBy(*order)) - 1
    same = F.col("__bucket") == F.col("__b")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return cut.withColumn("__within", within).join(starts, same).withColumn(into, (F.col("__start") + F.col("__within")).cast("long")).drop(
        "__bucket", "__b", "__within", "__start", *[f"__k{i}" for i in range(len(keys))]
    )


def number_all(df: DataFrame, order: list[str], into: str) -> DataFrame:
    """Gapless numbers from 0 over the whole table in the order given, which must tell rows apart.

    Rows are dealt out by range, numbered in their partition, and moved by the sizes of the
    partitions before; only those sizes meet in one task.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the range exchange samples its input, so df is written first and not worked out twice
    dealt = materialise(materialise(df).repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    starts = sizes.select(
        F.col("__part").alias("__p"),
        F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"),
    )
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return dealt.withColumn("__within", within).join(F.broadcast(starts), F.col("__part") == F.col("__p")).withColumn(
        into, (F.col("__start") + F.col("__within")).cast("long")
    ).drop("__part", "__p", "__within", "__start")


def running_total(df: DataFrame, order: list[str], amount: str, into: str) -> DataFrame:
    """The sum of amount over rows up to each one in the order given, its own included, in the manner of number_all()."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(materialise(df).repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    totals = dealt.groupBy("__part").agg(F.sum(amount).alias("__n"))
    starts = totals.select(
        F.col("__part").alias("__p"),
        F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"),
    )
    within = F.sum(amount).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("__within", within).join(F.broadcast(starts), F.col("__part") == F.col("__p")).withColumn(
        into, (F.col("__start") + F.col("__within")).cast("long")
    ).drop("__part", "__p", "__within", "__start")

"""Files of JSON lines taken in once each, bad lines to the side, whatever fails on the way.

A file stream remembers which files it has taken and which batch they belong to. Each batch writes into folders of its own number and
replaces them, so a batch that failed between its writes and is taken again leaves nothing twice; and last it writes its number down,
without which no reader looks at its folders. Rows whose key an earlier batch, or an earlier line of the same one, has landed are
told apart as skipped, so a file that comes again under another name changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.functions.text import strip

SIDE = "file string, value string"


def _batches(spark: SparkSession, place: str, name: str, schema: str) -> DataFrame:
    """All rows below place/name with the number of their batch; none where nothing was written."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/{name}")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], f"{schema}, batch long")
    return spark.read.schema(f"{schema}, batch long").parquet(f"{place}/{name}")


def _done(spark: SparkSession, place: str, name: str, schema: str) -> DataFrame:
    rows, whole = _batches(spark, place, name, schema), _batches(spark, place, "done", "files long")
    return rows.join(whole.select("batch"), "batch", "left_semi").select(*[c for c in rows.columns if c != "batch"], "batch")


def landed(spark: SparkSession, place: str, schema: str) -> DataFrame:
    """Good rows of batches that were finished, and batch."""
    return _done(spark, place, "landed", schema)


def quarantined(spark: SparkSession, place: str) -> DataFrame:
    """Lines that do not fit the schema, or have no key: file, value, batch."""
    return _done(spark, place, "quarantined", SIDE)


def skipped(spark: SparkSession, place: str) -> DataFrame:
    """Lines whose key had been landed: file, value, batch."""
    return _done(spark, place, "skipped", SIDE)


def ingest(
    spark: SparkSession, source: str, place: str, schema: str, key: str, files: int = 1000, between: Callable[[int], None] | None = None
) -> None:
    """Take in the files of source that are new, `files` a batch, until there are none; what is kept lies below place.

    Empty lines are passed over. Of lines with one key in a batch the first by file name and text stays. between(batch) is called
    after the lines to the side are written and before the good rows are.
    """

    def land(batch: DataFrame, number: int) -> None:
        read = F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
        rows = batch.where(strip(F.col("value")) != "").select("file", "value", read.alias("r")).withColumn("k", F.col(f"r.{key}"))
        good = F.col("r._bad").isNull() & F.col("k").isNotNull()
        before = _batches(batch.sparkSession, place, "landed", schema).where(F.col("batch") < number)
        first = F.row_number().over(Window.partitionBy("k").orderBy("file", "value"))  # a key's lines of one batch
        known = before.select(F.col(key).alias("k"), F.lit(True).alias("known")).distinct()
        told = rows.where(good).withColumn("rank", first).join(known, "k", "left").withColumn("again", F.col("known").isNotNull() | (F.col("rank") > 1))
        out = lambda name: f"{place}/{name}/batch={number}"
        told.persist()
        try:
            rows.where(~F.coalesce(good, F.lit(False))).select("file", "value").write.mode("overwrite").parquet(out("quarantined"))
            told.where("again").select("file", "value").write.mode("overwrite").parquet(out("skipped"))
            if between:
                between(number)
            told.where("not again").select("r.*").drop("_bad").write.mode("overwrite").parquet(out("landed"))
        finally:
            told.unpersist()
        batch.select(F.countDistinct("file").alias("files")).write.mode("overwrite").parquet(out("done"))

    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files).load(source)
    lines.select("value", F.col("_metadata.file_name").alias("file")).writeStream.foreachBatch(land).option(
        "checkpointLocation", f"{place}/state"
    ).trigger(availableNow=True).start().awaitTermination()

"""Tables in the shared folder that are dealt by a key once, so that joins and groups by it need no exchange."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def bucketed(spark: SparkSession, path: str, ddl: str, key: str, buckets: int) -> str:
    """The name of a table over the files at path, those there too; file names say which bucket each is. Dropping it leaves the files."""
    name = f"bucketed_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({ddl}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return name


def append(rows: DataFrame, table: str, key: str, buckets: int) -> None:
    """One file a bucket: rows, with the table's columns in order, are dealt as it is."""
    rows.repartition(buckets, key).write.mode("append").insertInto(table)

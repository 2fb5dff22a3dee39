"""Joins whose keys may be held by a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_HEAVY = 1024
EACH = 16


def heavy_from(total: int, partitions: int) -> int:
    """More rows than this make a key heavy; so fewer than EACH * partitions keys are."""
    return max(LEAST_HEAVY, -(-total // (EACH * partitions)))


def join_heavy(rows: DataFrame, table: DataFrame, keys: list[str], count: str, how: str = "left") -> DataFrame:
    """rows joined with table, one row for each key, whose column `count` says how many of rows have the key.

    Rows of heavy keys meet a broadcast of the table's few heavy rows, so they stay where they are; only the others are
    shuffled. Both are read twice, so they should be written tables. how: left or inner; no row of it is lost. Keys must
    not be null in heavy numbers.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    most = heavy_from(total, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    more = [c for c in table.columns if c not in keys]
    few = F.broadcast(table.where(F.col(count) > most))
    light = rows.join(few.select(*keys), keys, "left_anti").join(table.where(F.col(count) <= most), keys, how)
    return light.select(*rows.columns, *more).unionByName(rows.join(few, keys).select(*rows.columns, *more))

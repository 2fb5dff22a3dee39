"""Broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ROWS = 100_000


def small(df: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most `most` rows; else as it is, and the join is one of shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df

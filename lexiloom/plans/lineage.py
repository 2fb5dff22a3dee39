"""Cutting lineage in a folder that every executor can read."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a temporary one if all runs on this machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can read")
    made = tempfile.mkdtemp(prefix="lexiloom-")
    atexit.register(shutil.rmtree, made, True)
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


def tidy(spark: SparkSession) -> None:
    """Let the driver drop what no plan needs any more: a collection is what makes Spark delete the shuffle files and broadcasts of finished work."""
    spark._jvm.System.gc()


_made: list[tuple[SparkSession, str]] = []
_seen = [0]


def _forget_all() -> None:
    """What nobody has forgotten goes when the driver ends."""
    with contextlib.suppress(Exception):  # a session that has ended took its folder along
        forget(_made)


atexit.register(_forget_all)


def forget(tables: list[tuple[SparkSession, str]]) -> None:
    """Delete tables that materialise() wrote; nothing that reads them may run any more."""
    for spark, path in tables:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def recorded() -> list[tuple[SparkSession, str]]:
    """The tables written since the last call."""
    out = _made[_seen[0] :]
    _seen[0] = len(_made)
    return out


def materialise(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    The plan above starts from files, so a lost executor costs a reread and not a recomputation,
    and readers prune columns. No rows: the schema alone comes back.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexiloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)

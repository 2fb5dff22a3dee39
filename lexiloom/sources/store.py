"""A content-addressed store: answers by key in a table bucketed by key, appended to and compacted.

Every append writes its rows into the table's buckets, so a lookup shuffles the rows that ask and never the store, however large it has
grown; a task reads one bucket. The newest entry of a key holds. An entry whose payload does not match its checksum is no entry,
and an older one that does is used instead. Compacting writes the newest entries alone as the table's next generation, and then points to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.plans.buckets import append, bucketed

ENTRY = "key STRING, answer STRING, error STRING, at BIGINT, crc BIGINT"


def _sum_of(answer, error):
    side = lambda c: F.coalesce(F.concat(F.lit("+"), c), F.lit("-"))
    return F.crc32(F.concat(side(answer), F.lit("\n"), side(error)))


class KeyedStore:
    """The store at path, which all executors can read. buckets is fixed when it is made; give as many as lookups have shuffle partitions, or more."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        found = [g for g in self._listed("") if g.startswith("g")]
        sizes = {int(g.split("-")[1]) for g in found}
        self.buckets = sizes.pop() if sizes else buckets
        done = {g.removeprefix("done-") for g in self._listed("") if g.startswith("done-")}
        whole = sorted((g for g in found if g in done), key=lambda g: int(g.split("-")[0][1:]))
        self._attach(whole[-1] if whole else self._begin(0))

    def _fs(self, at: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{at}" if at else self.path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _listed(self, at: str) -> list[str]:
        fs, where = self._fs(at)
        return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []

    def _begin(self, number: int) -> str:
        """An empty generation that is seen at once."""
        name = f"g{number}-{self.buckets}"
        for at in (name, f"done-{name}"):
            fs, where = self._fs(at)
            fs.mkdirs(where)
        return name

    def _attach(self, generation: str) -> None:
        self.generation, self.table = generation, self._over(generation)

    def _over(self, generation: str) -> str:
        return bucketed(self.spark, f"{self.path}/{generation}", ENTRY, "key", self.buckets)

    def entries(self) -> DataFrame:
        """(key, answer, error): the newest readable entry of each key. Made within buckets, without an exchange."""
        held = self.spark.table(self.table).where(F.col("crc") == _sum_of(F.col("answer"), F.col("error")))
        return held.groupBy("key").agg(F.max_by(F.struct("answer", "error"), F.struct("at", "crc")).alias("r")).select("key", "r.answer", "r.error")

    def put(self, rows: DataFrame) -> None:
        """Append (key, answer, error); null keys are passed over. Of rows with one key in a call one stays."""
        at = (self.spark.table(self.table).agg(F.max("at")).first()[0] or 0) + 1
        sealed = rows.where("key is not null").select("key", "answer", "error", F.lit(at).cast("long").alias("at"), _sum_of(F.col("answer"), F.col("error")).alias("crc"))
        append(sealed, self.table, "key", self.buckets)

    def lookup(self, rows: DataFrame, key: str) -> DataFrame:
        """rows with answer, error and hit, whether the store has an entry; a null key has none."""
        held = self.entries().select(F.col("key").alias(key), "answer", "error", F.lit(True).alias("hit"))
        return rows.join(held.hint("merge"), key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))

    def misses(self, rows: DataFrame, key: str) -> DataFrame:
        return rows.join(self.entries().select(F.col("key").alias(key)).hint("merge"), key, "left_anti")

    def compact(self) -> None:
        """Write the newest entries as the next generation; then it is the store. Stopped before that, the store is as it was."""
        after = f"g{int(self.generation.split('-')[0][1:]) + 1}-{self.buckets}"
        fs, where = self._fs(after)
        fs.delete(where, True)
        fs.mkdirs(where)
        name = self._over(after)
        newest = self.entries().select("key", "answer", "error", F.lit(1).cast("long").alias("at"), _sum_of(F.col("answer"), F.col("error")).alias("crc"))
        append(newest, name, "key", self.buckets)
        fs, done = self._fs(f"done-{after}")
        fs.mkdirs(done)
        before, self.generation, self.table = (self.generation, self.table), after, name
        self.spark.sql(f"DROP TABLE {before[1]}")
        for at in (f"done-{before[0]}", before[0]):
            fs, where = self._fs(at)
            fs.delete(where, True)

"""The data source: what is planned and read, and writes that fail."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In
from pyspark.sql.types import StructType

from lexiloom.sources.hub import Hub, HubReader, HubWriter, manifest

SCHEMA = "subject string, answer int, question string, split string"


@pytest.fixture
def path(spark, tmp_path):
    spark.dataSource.register(Hub)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rows = spark.range(40).select(F.concat(F.lit("s"), F.floor(F.col("id") / 10).cast("string")).alias("subject"), F.col("id").cast("int").alias("answer"), F.lit("q").alias("question"))
    where = str(tmp_path / "data")
    for k in range(4):  # a file for each subject
        rows.where(F.col("subject") == f"s{k}").coalesce(1).write.format("hub").mode("append").option("split", "test").option("by", "subject").save(where)
    rows.limit(7).coalesce(1).write.format("hub").mode("append").option("split", "dev").option("by", "subject").save(where)
    return where


def test_round_trip(spark, path):
    got = spark.read.format("hub").load(path)
    assert sorted(got.columns) == ["answer", "question", "split", "subject"] and got.count() == 47
    assert got.where("split = 'dev'").count() == 7 and got.where("split = 'test' and subject in ('s1', 's3') and answer > 15").count() == 14
    assert {(r["subject"], r["n"]) for r in got.where("split = 'test'").groupBy("subject").agg(F.count("*").alias("n")).collect()} == {(f"s{k}", 10) for k in range(4)}
    assert spark.read.format("hub").schema("answer int").load(path).agg(F.sum("answer")).first()[0] == sum(range(40)) + sum(range(7))


def test_files_and_columns_are_pruned(path):
    """A partition for each file that filters leave, and the rows and columns asked for alone."""
    reader = HubReader(path, StructType.fromDDL("answer int, subject string, split string"))
    left = list(reader.pushFilters([EqualTo(("split",), "test"), In(("subject",), ("s1", "s2")), GreaterThan(("answer",), 3)]))
    assert left == [GreaterThan(("answer",), 3)] and len(reader.partitions()) == 2
    read = [b for p in reader.partitions() for b in reader.read(p)]
    assert sum(b.num_rows for b in read) == 20 and read[0].schema.names == ["answer", "subject", "split"]
    one = HubReader(path, StructType.fromDDL("answer int"))
    assert list(one.pushFilters([EqualTo(("answer",), 25)])) == [] and [b.to_pylist() for p in one.partitions() for b in one.read(p)] == [[{"answer": 25}]]
    none = HubReader(path, StructType.fromDDL(SCHEMA))
    assert not list(none.pushFilters([EqualTo(("split",), "no such")])) and [b for p in none.partitions() for b in none.read(p)] == []


def test_failed_write_leaves_nothing(spark, path, tmp_path):
    before = manifest(path)
    broken = spark.range(100, numPartitions=1).select(F.when(F.col("id") == 99, F.raise_error(F.lit("broken"))).otherwise("s9").alias("subject"), F.col("id").cast("int").alias("answer"), F.lit("q").alias("question"))
    with pytest.raises(Exception, match="broken"):
        broken.write.format("hub").mode("append").option("split", "test").save(path)
    assert manifest(path) == before and spark.read.format("hub").load(path).count() == 47
    assert {f.name for f in (tmp_path / "data").glob("*.parquet")} == {f["file"] for f in before[1]}
    # overwriting takes the place of one split
    spark.createDataFrame([("s0", 1, "q")], "subject string, answer int, question string").write.format("hub").mode("overwrite").option("split", "test").save(path)
    assert spark.read.format("hub").load(path).groupBy("split").count().orderBy("split").collect() == [("dev", 7), ("test", 1)]


def test_second_writer_fails(path):
    """Of two that began with one manifest the second finds its number taken, and its files go."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"subject": "s7", "answer": 7, "question": "q"}])
    one, two = (HubWriter(path, "test", "subject", False) for _ in range(2))
    first, second = one.write(iter([batch])), two.write(iter([batch]))
    one.commit([first, None])
    with pytest.raises(RuntimeError, match="meanwhile"):
        two.commit([second])
    import os

    assert os.path.exists(f"{path}/{first.files[0]['file']}") and not os.path.exists(f"{path}/{second.files[0]['file']}")
    assert sum(f["rows"] for f in manifest(path)[1]) == 48

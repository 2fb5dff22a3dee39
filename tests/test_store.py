"""The keyed store: newest entries, broken ones, compaction, and a plan that never shuffles it."""

from pyspark.sql import functions as F

from lexiloom.sources.store import KeyedStore

ROW = "key string, answer string, error string"


def exchanges(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.count("Exchange hashpartitioning")


def test_store(spark, tmp_path):
    place = f"file://{tmp_path}/store"
    store = KeyedStore(spark, place, 8)
    assert store.entries().count() == 0
    store.put(spark.createDataFrame([(f"k{i}", f"a{i}", None) for i in range(50)] + [(None, "x", None)], ROW))
    store.put(spark.createDataFrame([("k1", "new", None), ("k2", None, "failed"), ("k90", "", None)], ROW))
    want = {f"k{i}": (f"a{i}", None) for i in range(50)} | {"k1": ("new", None), "k2": (None, "failed"), "k90": ("", None)}
    held = lambda s: {r["key"]: (r["answer"], r["error"]) for r in s.entries().collect()}
    assert held(store) == want
    asked = spark.createDataFrame([(1, "k1"), (2, "no"), (3, None), (4, "k90"), (5, "k1")], "id int, k string")
    got = {r["id"]: (r["answer"], r["hit"]) for r in store.lookup(asked, "k").collect()}
    assert got == {1: ("new", True), 2: (None, False), 3: (None, False), 4: ("", True), 5: ("new", True)}
    assert {r["id"] for r in store.misses(asked, "k").collect()} == {2, 3}

    # the rows that ask are shuffled, and the store is not, nor is it for its newest entries
    assert exchanges(store.entries()) == 0 and exchanges(store.lookup(asked, "k")) == 1 and exchanges(store.misses(asked, "k")) == 1

    # an entry that is broken counts as none, and the one before it holds
    spark.createDataFrame([("k1", "torn", None, 9, 123), ("k77", "torn", None, 9, 5)], f"{ROW}, at long, crc long").repartition(8, "key").write.mode("append").insertInto(store.table)
    assert held(store) == want

    files = lambda s: len(s.spark.table(s.table).inputFiles())
    before = files(store)
    store.compact()
    assert held(store) == want and files(store) <= 8 < before and exchanges(store.lookup(asked, "k")) == 1
    # opened again, with the number of buckets that it was made with
    again = KeyedStore(spark, place, 3)
    again.put(spark.createDataFrame([("k1", "newest", None)], ROW))
    assert again.buckets == 8 and held(again) == want | {"k1": ("newest", None)}


def test_stopped_compaction(spark, tmp_path):
    """A generation that was begun and not ended is not seen, and the next compaction writes it anew."""
    store = KeyedStore(spark, f"file://{tmp_path}/s", 4)
    store.put(spark.createDataFrame([("a", "1", None)], ROW))
    half = tmp_path / "s" / "g1-4"
    half.mkdir()
    (half / "part-00000_00000.c000.snappy.parquet").write_bytes(b"half")
    again = KeyedStore(spark, f"file://{tmp_path}/s")
    assert [tuple(r) for r in again.entries().collect()] == [("a", "1", None)]
    again.compact()
    assert [tuple(r) for r in KeyedStore(spark, f"file://{tmp_path}/s").entries().collect()] == [("a", "1", None)]

"""Titles whose capitals or small letters differ in number of letters, and turns that look like headings, against SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lexiloom.functions import text as tx
from lexiloom.queries import ORACLES, QUERIES

LETTERS = [chr(k) for k in [*range(1, 0x250), *range(0x370, 0x590), *range(0x1E00, 0x2000), *range(0xFB00, 0xFB20), *range(0x10400, 0x10450)]]


TURNS = {
    1: [("user", "achpfß ja"), ("bot", "eins"), ("user", "ΟΔΟΣ"), ("bot", "zwei"), ("user", "ACHPFẞ"), ("bot", "drei")],
    2: [("bot", "Cimi. Looks like a heading"), ("user", " "), ("bot", "Mix. So does this\n"), ("user", "\v\u00a0x\u00a0"), ("bot", None), ("user", None), ("bot", "end")],
    4: [("bot", "I. Alone")],
}


def compared(spark, place, name):
    rows = [(c + more, k, *turn) for more in (0, 2) for c, turns in TURNS.items() for k, turn in enumerate(turns) if c + more != 4 or more]
    rows += [(c * 3, k, *turn) for c, turns in TURNS.items() for k, turn in enumerate(turns)]
    rows = list({r[:2]: r for r in rows}.values())
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{place}/conversations.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS FROM '{place}/conversations.parquet/*.parquet'")
    df = QUERIES[name](spark, str(place))
    want = duck.execute(ORACLES[name])
    names = [x[0] for x in want.description]
    assert sorted(map(str, df.select(names).toPandas().values.tolist())) == sorted(str(list(r)) for r in want.fetchall())


def test_sections_of_titles_with_a_sharp_s(spark, tmp_path):
    compared(spark, tmp_path, "split_sections_last_wins")


def test_code_points_keep_their_number(spark):
    df = spark.createDataFrame([(c,) for c in LETTERS], "c string").select("c", tx.upper(F.col("c")).alias("u"))
    duck = duckdb.connect()
    # letters that the two engines' tables of letters do not both have
    new = {"ƛ", "ɤ"}
    assert [r for r in df.collect() if r["c"] not in new and r["u"] != duck.execute("SELECT upper(?)", [r["c"]]).fetchone()[0]] == []
    odd = spark.createDataFrame([("straße 🙂",), ("",), (None,)], "c string")
    assert [r[0] for r in odd.select(tx.upper(F.col("c"))).collect()] == ["STRAẞE 🙂", "", None]


def test_routed_titles_and_works(spark, tmp_path):
    compared(spark, tmp_path, "route_sources")


def test_small_letters_keep_their_number(spark):
    odd = spark.createDataFrame([("ΣΑΣ İX ẞ",), ("",), (None,)], "c string")
    assert [r[0] for r in odd.select(tx.lower(F.col("c"))).collect()] == ["σασ ix ß", "", None]

"""Each query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from lexiloom.queries import ORACLES, QUERIES

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations sale_lines clicks client_changes clients sales vendors items stamps".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS FROM '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, D)
    got = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    if name not in ORACLES:
        assert got
        return
    found = duck.execute(ORACLES[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall())


def test_stream_equals_batch(spark):
    rows = lambda n: sorted(map(tuple, QUERIES[n](spark, D).select("conv", "speaker", "t_private", "t_public").collect()), key=str)
    assert rows("streaming_sustained") == rows("sustained_threshold")


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

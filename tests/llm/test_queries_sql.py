"""The operators' queries that SQL can express, against it on the smallest tables."""

import duckdb
import pytest

from lexiloom.llm.queries import ORACLES, QUERIES

D = "/root/testdata/sf0.001"
NAMES = ["op12_name_automaton", "op13_merkle_manifest"]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    c = duckdb.connect()
    for t in ("documents", "clients", "vendors"):
        c.execute(f"CREATE VIEW {t} AS FROM '{D}/{t}.parquet'")
    df = QUERIES[name](spark, D)
    got = sorted((tuple(r[x] for x in sorted(df.columns)) for r in df.collect()), key=str)
    found = c.execute(ORACLES[name])
    names = [x[0] for x in found.description]
    assert got and sorted(names) == sorted(df.columns)
    assert got == sorted((tuple(r[names.index(x)] for x in sorted(names)) for r in found.fetchall()), key=str)

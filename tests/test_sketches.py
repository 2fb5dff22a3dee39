"""Sketches against exact answers, and unions of groups against one pass."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.operators.sketches import merged, sketched, told

RANKS = {"p10": 0.1, "p50": 0.5, "p99": 0.99}


def within(values, found, off):
    """Whether found's rank among values is as asked, give or take `off`."""
    values = np.sort(values)
    return all(np.searchsorted(values, found[c], "left") / len(values) - off <= r <= np.searchsorted(values, found[c], "right") / len(values) + off for c, r in RANKS.items())


def test_any_roll_up(spark):
    pick = np.random.default_rng(1)
    n = 60_000
    source, day = pick.integers(0, 3, n), pick.integers(0, 10, n)
    who, value = pick.integers(0, 20_000, n), pick.lognormal(0, 2, n)
    rows = spark.createDataFrame([(int(a), int(b), int(c), float(d)) for a, b, c, d in zip(source, day, who, value, strict=True)], "source int, day int, who long, value double")
    kept = sketched(rows, ["source", "day"], F.col("who"), F.col("value")).cache()
    assert kept.count() == 30 and kept.select(F.max(F.length("seen") + F.length("spread"))).first()[0] < 20_000
    for by, part in ((["source"], source), (["day"], day), ([], np.zeros(n))):
        union = told(merged(kept, by), RANKS).collect()
        once = told(sketched(rows, by, F.col("who"), F.col("value")), RANKS).collect()
        assert len(union) == len(once) == len(np.unique(part))
        for r in [*union, *once]:
            mine = part == (r[by[0]] if by else 0)
            exact = len(np.unique(who[mine]))
            assert abs(r["n_distinct"] - exact) <= 0.05 * exact and within(value[mine], r, 0.02)
            assert r["n"] == mine.sum() and r["mean"] == pytest.approx(value[mine].mean()) and (r["least"], r["most"]) == (value[mine].min(), value[mine].max())


def test_awkward(spark):
    rows = spark.createDataFrame([("a", None, None), ("a", 1, None), ("b", 1, 2.0), ("b", 1, float("nan")), (None, 2, 3.0)], "g string, who long, value double")
    got = {r["g"]: r for r in told(sketched(rows, ["g"], F.col("who"), F.col("value")), {"p50": 0.5}).collect()}
    assert (got["a"]["n"], got["a"]["mean"], got["a"]["p50"], got["a"]["n_distinct"]) == (0, None, None, 1)
    assert (got["b"]["n"], got["b"]["p50"], got["b"]["n_distinct"]) == (1, 2.0, 1) and got[None]["p50"] == 3.0

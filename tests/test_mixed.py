"""The mixed model against a dense fit, and power against simulation and the normal distribution."""

from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.operators.mixed import effect_power, mixed_effects, normal_cdf

D = "/root/testdata"


def dense(y, x, group):
    """Maximum likelihood with the covariance matrices of the groups written out, by golden section on the ratio."""
    x = np.column_stack([np.ones(len(y)), x])
    parts = [np.flatnonzero(group == g) for g in np.unique(group)]

    def at(ratio):
        a, b, q, det = 0.0, 0.0, 0.0, 0.0
        for p in parts:
            v = np.eye(len(p)) + ratio
            solved = np.linalg.solve(v, np.column_stack([x[p], y[p]]))
            a, b, q = a + x[p].T @ solved[:, :-1], b + x[p].T @ solved[:, -1], q + y[p] @ solved[:, -1]
            det += np.linalg.slogdet(v)[1]
        beta = np.linalg.solve(a, b)
        rss = q - beta @ b
        return -0.5 * (len(y) * np.log(rss / len(y)) + det), beta, rss / len(y), np.linalg.inv(a)

    low, high, golden = -12.0, 6.0, (5**0.5 - 1) / 2
    while high - low > 1e-9:
        one, two = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, two) if at(np.exp(one))[0] > at(np.exp(two))[0] else (one, high)
    best = np.exp((low + high) / 2)
    if at(0.0)[0] >= at(best)[0]:
        best = 0.0
    _, beta, within, inverse = at(best)
    return [*beta, best * within, within], np.sqrt(np.diag(inverse) * within)


def check(rows, group, y, x, tolerance=1e-6):
    got = mixed_effects(rows, group, F.col(y), {c: F.col(c) for c in x}).collect()
    p = rows.select(group, y, *x).dropna().toPandas()
    values, errors = dense(p[y].to_numpy(float), p[x].to_numpy(float), p[group].to_numpy())
    assert [r["term"] for r in got] == ["intercept", *x, "between", "within"]
    scale = [1.0] * (len(x) + 1) + [values[-1]] * 2  # a variance of nearly 0 is compared with the other one
    for r, v, s in zip(got, values, scale, strict=True):
        assert abs(r["estimate"] - v) <= tolerance * max(abs(v), s)
    assert [r["std_error"] for r in got[: len(x) + 1]] == pytest.approx(errors, rel=1e-5) and got[-1]["std_error"] is None


def test_made_rows(spark):
    """Groups of very different sizes, one of a third of all rows, nulls, three covariates."""
    pick = np.random.default_rng(1)
    group = np.concatenate([np.zeros(200, int), pick.integers(1, 40, 380), np.arange(40, 60)])
    x = pick.normal(size=(600, 3))
    y = 2 + x @ [1.0, -0.5, 0.0] + pick.normal(size=60)[group] * 1.5 + pick.normal(size=600)
    rows = [(int(g), float(v), *map(float, r)) for g, v, r in zip(group, y, x, strict=True)] + [(None, 1.0, 1.0, 1.0, 1.0), (1, None, 1.0, 1.0, 1.0), (2, 1.0, None, 1.0, 1.0)]
    check(spark.createDataFrame(rows, "g long, y double, a double, b double, c double"), "g", "y", ["a", "b", "c"])


def test_orders_by_customer(spark):
    orders = spark.read.parquet(f"{D}/sf0.001/orders.parquet").withColumn("urgent", F.col("o_orderpriority").startswith("1").cast("int"))
    check(orders, "o_custkey", "o_totalprice", ["urgent"])


def test_lines_by_item(spark):
    check(spark.read.parquet(f"{D}/sf0.001/sale_lines.parquet").where("item_id < 60"), "item_id", "amount", ["quantity"], 2e-6)


def test_awkward(spark):
    """No rows, one row, a constant covariate; ratio 0 gives ordinary least squares."""
    rows = spark.createDataFrame([(1, 1.0, 0.5), (2, 3.0, 0.5), (1, 2.0, 0.5)], "g long, y double, x double")
    x = {"x": F.col("x")}
    assert mixed_effects(rows.limit(0), "g", F.col("y"), x).count() == 0
    assert all(np.isfinite(r["estimate"]) for r in mixed_effects(rows, "g", F.col("y"), x).collect())
    alike = spark.createDataFrame([(g, float(v)) for g in range(5) for v in (1, 2, 3, 4)], "g long, y double")
    got = {r["term"]: r["estimate"] for r in mixed_effects(alike, "g", F.col("y"), {}).collect()}
    assert got["between"] == 0 and got["intercept"] == pytest.approx(2.5) and got["within"] == pytest.approx(1.25)


def test_power(spark):
    z = [-9.0, -8.0, -3.0, -1.0, 0.0, 0.5, 1.96, 5.0, 9.0]
    got = spark.createDataFrame([(v,) for v in z], "z double").select(normal_cdf(F.col("z")).alias("p")).collect()
    assert [r["p"] for r in got] == pytest.approx([NormalDist().cdf(v) for v in z], abs=1e-9)
    rows = [(64, 64, 0.5), (20, 200, -0.8), (10, 10, 0.0), (0, 5, 0.3), (5, 5, None)]
    found = effect_power(spark.createDataFrame(rows, "n_a long, n_b long, d double")).collect()
    pick, reach = np.random.default_rng(2), NormalDist().inv_cdf(0.975)
    for r, (a, b, d) in zip(found[:3], rows, strict=False):
        means = pick.normal(d, 1 / a**0.5, 200_000) - pick.normal(0, 1 / b**0.5, 200_000)
        assert r["power"] == pytest.approx((np.abs(means) > reach * (1 / a + 1 / b) ** 0.5).mean(), abs=0.006)
    assert [r["needed"] for r in found] == [63, 25, None, 175, None] and found[3]["power"] is None and found[4]["power"] is None

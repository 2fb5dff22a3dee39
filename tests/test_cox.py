"""Cox regression over range parts against a plain Newton search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.operators.stats import cox_fit


def plain(t, e, x, efron):
    """Newton steps over the rows in order of time, by the words of the likelihood."""
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        risk, g, h = np.exp(x @ beta), np.zeros(len(beta)), np.zeros((len(beta),) * 2)
        for u in np.unique(t[e]):
            at, dead = t >= u, (t == u) & e
            d = dead.sum()
            for k in range(d):
                w = risk * at - (k / d * risk * dead if efron else 0)
                mean = w @ x / w.sum()
                h += (x * w[:, None]).T @ x / w.sum() - np.outer(mean, mean)
                g -= mean
            g += x[dead].sum(axis=0)
        step = np.linalg.solve(h, g)
        beta = beta + step
        if np.abs(step).max() < 1e-12:
            break
    return beta, np.sqrt(np.diag(np.linalg.inv(h)))


@pytest.mark.parametrize(("ties", "digits"), [("breslow", 1), ("efron", 1), ("efron", 9)])
def test_fit(spark, ties, digits):
    """Many ties with one time of a third of the rows, or continuous times; nulls take no part."""
    pick = np.random.default_rng(digits)
    x = pick.normal(size=(300, 2))
    t = np.round(pick.exponential(np.exp(-x @ [0.8, -0.5])), digits)
    t[:100] = t[0]
    e = pick.random(300) < 0.7
    rows = [(float(a), bool(b), float(c), float(f)) for a, b, (c, f) in zip(t, e, x, strict=True)] + [(None, True, 1.0, 1.0), (1.0, None, 1.0, 1.0), (1.0, True, None, 1.0)]
    got = cox_fit(spark.createDataFrame(rows, "t double, e boolean, p double, q double"), "t", "e", ["p", "q"], ties)
    beta, errors = plain(t, e, x, ties == "efron")
    assert [got[c][0] for c in "pq"] == pytest.approx(beta, abs=1e-7) and [got[c][1] for c in "pq"] == pytest.approx(errors, rel=1e-6)


def test_nothing_happens(spark):
    rows = spark.createDataFrame([(1.0, False, 2.0), (2.0, False, 1.0)], "t double, e boolean, p double")
    assert cox_fit(rows, "t", "e", ["p"]) == {"p": (0.0, 0.0)} and cox_fit(rows.where(F.lit(False)), "t", "e", ["p"]) == {"p": (0.0, 0.0)}

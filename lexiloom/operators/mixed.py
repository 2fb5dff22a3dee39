"""Linear models with a random intercept for each group, and the power of an effect size.

A group enters the likelihood by its number of rows and the sums of its variables alone, so rows are read once, into one row for each
group; and groups of one size enter alike, so those rows are summed again by size. The ratio of the variances is then found on the
table of sizes: a search step is one small aggregation that returns a row for each ratio tried, whatever the rows and groups.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.plans.lineage import materialise

TRIED, LOW, HIGH = 15, -25.0, 25.0  # ratios a step; bounds of their logarithm


def group_sums(rows: DataFrame, group: str, y: Column, x: dict[str, Column]) -> DataFrame:
    """(n, groups, and sums over all groups of n rows): what the likelihood needs. Rows with a null in any variable or the group are left out."""
    held = {"y": y, **x}
    clean = rows.select(F.col(group).alias("g"), *[c.cast("double").alias(f"v{k}") for k, c in enumerate(held.values())]).dropna()
    pairs = [(i, j) for i in range(len(held)) for j in range(i, len(held))]
    each = clean.groupBy("g").agg(
        F.count("*").alias("n"), *[F.sum(f"v{i}").alias(f"s{i}") for i in range(len(held))],
        *[F.sum(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"c{i}_{j}") for i, j in pairs],
    )
    return each.groupBy("n").agg(
        F.count("*").alias("groups"), *[F.sum(f"c{i}_{j}").alias(f"c{i}_{j}") for i, j in pairs],
        *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"p{i}_{j}") for i, j in pairs],
    )


class _Tried:
    """The likelihood's profile at one ratio of the variances, from sums over the table of sizes."""

    def __init__(self, row, k: int) -> None:
        def square(name: str) -> np.ndarray:
            out = np.zeros((k, k))
            for i in range(k):
                for j in range(i, k):
                    out[i, j] = out[j, i] = row[f"{name}{i}_{j}"]
            return out

        whole, within, slope = square("c"), square("w"), square("d")
        a = whole - within  # cross products as the ratio weighs them; the first variable is y
        self.inverse = np.linalg.pinv(a[1:, 1:])
        self.beta = self.inverse @ a[1:, 0]
        self.rows = row["rows"]
        self.rss = a[0, 0] - self.beta @ a[1:, 0]
        r = np.append(1.0, -self.beta)
        self.gradient = -0.5 * row["trace"] + 0.5 * self.rows * (r @ slope @ r) / self.rss


def mixed_effects(
    rows: DataFrame, group: str, y: Column, x: dict[str, Column], steps: int = 14, tolerance: float = 1e-9
) -> DataFrame:
    """(term, estimate, std_error): coefficients of an intercept and of x, and the variances `between` groups and `within` them.

    Maximum likelihood. Rows with a null in y, x or the group are left out. Where the likelihood falls from a ratio of 0 on, `between` is 0
    and the coefficients are those of ordinary least squares. A constant or repeated variable shares its coefficient (least norm). Without rows
    the result is empty. Variances have no standard errors (null).
    """
    spark, k = rows.sparkSession, len(x) + 2
    table = materialise(group_sums(rows, group, y, {"intercept": F.lit(1.0), **x}))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    n, ratio = F.col("n"), F.col("ratio")

    def tried(ratios: list[float]) -> list[_Tried]:
        shrunk = ratio / (1 + n * ratio)
        found = table.crossJoin(F.broadcast(spark.createDataFrame([(r,) for r in ratios], "ratio double"))).groupBy("ratio").agg(
            F.sum(n * F.col("groups")).alias("rows"), F.sum(F.col("groups") * n / (1 + n * ratio)).alias("trace"),
            *[F.sum(f"c{i}_{j}").alias(f"c{i}_{j}") for i, j in pairs], *[F.sum(shrunk * F.col(f"p{i}_{j}")).alias(f"w{i}_{j}") for i, j in pairs],
            *[F.sum(F.col(f"p{i}_{j}") / (1 + n * ratio) / (1 + n * ratio)).alias(f"d{i}_{j}") for i, j in pairs],
        )
        return [_Tried(r, k) for r in found.orderBy("ratio").collect()]

    schema = "term string, estimate double, std_error double"
    if not table.limit(1).count():
        return spark.createDataFrame([], schema)
    low, high = LOW, HIGH
    at, best = 0.0, tried([0.0])[0]
    first = tried([math.exp(low)])[0]
    if first.gradient > 0:
        for _ in range(steps):
            grid = np.linspace(low, high, TRIED + 2)[1:-1]
            got = tried([math.exp(g) for g in grid])
            up = [i for i, t in enumerate(got) if t.gradient > 0]  # the last ratio at which the likelihood still rises
            i = up[-1] if up else -1
            low, high = (grid[i] if i >= 0 else low), (grid[i + 1] if i + 1 < len(grid) else high)
            near = got[max(i, 0)]
            at, best = math.exp(grid[max(i, 0)]), near
            if high - low < tolerance:
                break
    within = best.rss / best.rows
    errors = np.sqrt(np.maximum(np.diag(best.inverse) * within, 0))
    out = [(t, float(b), float(e)) for t, b, e in zip(["intercept", *x], best.beta, errors, strict=True)]
    return spark.createDataFrame([*out, ("between", float(at * within), None), ("within", float(within), None)], schema)


def normal_cdf(z: Column, intervals: int = 200) -> Column:
    """The standard normal distribution by Simpson's rule from 0; right to 1e-9 for |z| up to 8, beyond which it is 0 or 1."""
    parts = F.sequence(F.lit(0), F.lit(intervals))
    weight = lambda k: F.when((k == 0) | (k == intervals), 1.0).when(k % 2 == 1, 4.0).otherwise(2.0)
    area = F.aggregate(
        F.transform(parts, lambda k: weight(k) * F.exp(-F.pow(z * k / intervals, F.lit(2.0)) / 2)), F.lit(0.0), lambda a, v: a + v
    )
    inside = 0.5 + z * area / (3 * intervals) / math.sqrt(2 * math.pi)
    return F.when(z > 8, 1.0).when(z < -8, 0.0).otherwise(inside)


def effect_power(effect: DataFrame, alpha: float = 0.05, wanted: float = 0.8) -> DataFrame:
    """effect (n_a, n_b, d) with the power of a two-sided test at alpha, and the rows a group that `wanted` power would take.

    By the normal approximation. Without rows in a group power is null; without an effect needed is null.
    """
    reach, aim = NormalDist().inv_cdf(1 - alpha / 2), NormalDist().inv_cdf(wanted)
    both = F.when((F.col("n_a") > 0) & (F.col("n_b") > 0), F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b")))
    size = F.sqrt(both) * F.abs("d")
    needed = F.ceil(F.try_divide(F.lit(2 * (reach + aim) ** 2), F.col("d") * F.col("d")))
    return effect.withColumn("power", normal_cdf(size - reach) + normal_cdf(-size - reach)).withColumn("needed", needed.cast("long"))

"""Survival curves, rank tests and effect sizes over aggregated counts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.plans.lineage import materialise
from lexiloom.plans.numbering import running_total


def kaplan_meier(rows: DataFrame, condition: str, time: str, event: str) -> DataFrame:
    """(condition, time, at_risk, events, survival) at the times that have rows; windows run over distinct times only."""
    counts = rows.groupBy(condition, time).agg(F.count("*").alias("n"), F.count_if(event).alias("events"))
    w = Window.partitionBy(condition).orderBy(time)
    risk = F.sum("n").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    left = F.product(1 - F.col("events") / F.col("at_risk")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return counts.withColumn("at_risk", risk).withColumn("survival", left).select(condition, time, "at_risk", "events", "survival")


def mann_whitney(rows: DataFrame, group: str, value: str, a: str, b: str) -> DataFrame:
    """(n_a, n_b, u, z) with mid-ranks and the normal approximation, tie-corrected. Ranks come from counts of distinct values."""
    counts = rows.where(F.col(group).isin(a, b) & F.col(value).isNotNull()).groupBy(value).agg(
        F.count_if(F.col(group) == a).cast("double").alias("na"), F.count("*").cast("double").alias("t")
    )
    # values are dealt by range, so that however many there are, none of them meet in one task
    ranked = running_total(counts, [value], "t", "upto").withColumn("mid", F.col("upto") - F.col("t") + (F.col("t") + 1) / 2)
    sums = ranked.agg(
        F.sum("na").alias("n1"), (F.sum("t") - F.sum("na")).alias("n2"), F.sum(F.col("na") * F.col("mid")).alias("r"),
        F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"),
    )
    n = F.col("n1") + F.col("n2")
    u = F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2
    var = F.col("n1") * F.col("n2") / 12 * ((n + 1) - F.col("ties") / (n * (n - 1)))
    return sums.select(
        F.col("n1").cast("long").alias("n_a"), F.col("n2").cast("long").alias("n_b"), u.alias("u"),
        F.try_divide(u - F.col("n1") * F.col("n2") / 2, F.sqrt(var)).alias("z"),
    )


def cohens_d(rows: DataFrame, group: str, value: str, a: str, b: str) -> DataFrame:
    s = rows.agg(
        *[
            f(F.when(F.col(group) == g, F.col(value))).alias(f"{n}_{k}") for k, g in (("a", a), ("b", b)) for n, f in (
                ("n", F.count), ("m", F.avg), ("v", F.var_samp)
            )
        ]
    )
    pooled = F.sqrt(((F.col("n_a") - 1) * F.col("v_a") + (F.col("n_b") - 1) * F.col("v_b")) / (F.col("n_a") + F.col("n_b") - 2))
    return s.select("n_a", "n_b", F.try_divide(F.col("m_a") - F.col("m_b"), pooled).alias("d"))


def cox_fit(
    rows: DataFrame, time: str, event: str, covariates: list[str], ties: str = "breslow", rounds: int = 25, tolerance: float = 1e-9
) -> dict[str, tuple[float, float]]:
    """(coefficient, standard error) of each covariate under proportional hazards; ties: breslow or efron.

    Rows are dealt by range of time once. In a Newton step they are summed by time, sums are added up from the last time down within a
    part and moved by the totals of the parts after it, and each time gives its share of gradient and Hessian; so all that meets in one
    task or the driver is a row a part and k x k numbers, however many times there are. Rows with a null in any column take no part.
    """
    spark, k = rows.sparkSession, len(covariates)
    held = rows.select(
        F.col(time).cast("double").alias("t"), F.col(event).cast("boolean").alias("e"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(covariates)]
    ).dropna()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the range exchange samples its input, so rows are written first
    dealt = materialise(materialise(held).repartitionByRange(parts, "t").withColumn("part", F.spark_partition_id()))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    names = ["s0", *[f"s1_{i}" for i in range(k)], *[f"s2_{i}_{j}" for i, j in pairs]]
    tied = [n.replace("s", "t") for n in names]
    beta, hessian = np.zeros(k), np.zeros((k, k))
    for _ in range(rounds):
        risk = F.exp(sum((F.col(f"x{i}") * float(beta[i]) for i in range(k)), F.lit(0.0)))
        terms = [risk, *[risk * F.col(f"x{i}") for i in range(k)], *[risk * F.col(f"x{i}") * F.col(f"x{j}") for i, j in pairs]]
        risks = [F.sum(v).alias(n) for v, n in zip(terms, names, strict=True)]
        dead = [F.sum(F.when(F.col("e"), v).otherwise(0.0)).alias(n) for v, n in zip(terms, tied, strict=True)]
        seen = [F.sum(F.when(F.col("e"), F.col(f"x{i}")).otherwise(0.0)).alias(f"e_{i}") for i in range(k)]
        times = dealt.groupBy("part", "t").agg(*risks, *dead, F.count_if("e").alias("d"), *seen)
        after = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)  # a row a part
        totals = dealt.groupBy("part").agg(*risks).select("part", *[F.coalesce(F.sum(n).over(after), F.lit(0.0)).alias(f"{n}_after") for n in names])
        down = Window.partitionBy("part").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
        risky = times.select("part", "d", *tied, *[f"e_{i}" for i in range(k)], *[F.sum(n).over(down).alias(n) for n in names]).where("d > 0").join(
            F.broadcast(totals), "part"
        )
        # by Efron's rule the tied deaths leave the risk set one after the other, on the mean
        steps = F.sequence(F.lit(0), F.col("d").cast("int") - 1) if ties == "efron" else F.array(F.lit(0))
        each = risky.withColumn("step", F.explode(steps)).withColumn("gone", F.col("step") / F.col("d"))
        weight = F.lit(1.0) if ties == "efron" else F.col("d")
        left = {n: F.col(n) + F.col(f"{n}_after") - F.col("gone") * F.col(m) for n, m in zip(names, tied, strict=True)}
        mean = [left[f"s1_{i}"] / left["s0"] for i in range(k)]
        got = each.agg(
            *[F.sum(F.when(F.col("step") == 0, F.col(f"e_{i}")).otherwise(0.0) - weight * mean[i]).alias(f"g{i}") for i in range(k)],
            *[F.sum(weight * (left[f"s2_{i}_{j}"] / left["s0"] - mean[i] * mean[j])).alias(f"h{i}_{j}") for i, j in pairs],
        ).first()
        gradient = np.array([got[f"g{i}"] or 0.0 for i in range(k)])
        for i, j in pairs:
            hessian[i, j] = hessian[j, i] = got[f"h{i}_{j}"] or 0.0
        step = np.linalg.pinv(hessian) @ gradient
        beta = beta + step
        if np.abs(step).max(initial=0.0) < tolerance:
            break
    errors = np.sqrt(np.maximum(np.diag(np.linalg.pinv(hessian)), 0.0))
    return {c: (float(b), float(e)) for c, b, e in zip(covariates, beta, errors, strict=True)}


def cox(rows: DataFrame, time: str, event: str, covariates: list[str], rounds: int = 25, tolerance: float = 1e-9) -> dict[str, float]:
    """The coefficients of cox_fit() by Breslow's rule for ties."""
    return {c: b for c, (b, _) in cox_fit(rows, time, event, covariates, "breslow", rounds, tolerance).items()}

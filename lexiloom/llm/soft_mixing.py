"""Mixing to target weights by soft membership, in DataFrame functions alone.

A multinomial naive Bayes over hashed words, counted from a bounded sample of labelled documents, gives
each document posteriors over the labelled domains. Evidence of long texts is tempered to that of `evidence` words, so
posteriors stay soft. Document rates r >= 0 are then fitted by projected-gradient least squares: with
t tokens and posteriors p, the expected tokens of domain k are S_k(r) = sum r t p_k, and

    minimise  sum_k (S_k(r) - T_k)^2 / S_k(1)   over r >= least.

In the metric of the tokens its gradient is g = sum_k p_k (S_k(r) - T_k) / S_k(1); as posteriors sum to
one, the Lipschitz constant is one, so the step is one. Rates start at one. An iteration is one
aggregation to as many sums as there are domains, and the rates are a fold of the iterations' small
vectors over each document's posteriors, written down every few iterations.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.plans.lineage import materialise


def words_of(text: Column) -> Column:
    """Words between spaces and \\x09-\\x0D, A-Z in lower case, with empty strings where those repeat."""
    plain = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.split(F.lower(plain), " ")


def posteriors(
    docs: DataFrame, labels: DataFrame, domain: Column, domains: list[str], id_: str = "doc_id", text: str = "text",
    buckets: int = 1 << 14, evidence: int = 200, alpha: float = 1.0, taught_most: int = 20_000, by: tuple[str, ...] = (),
) -> DataFrame:
    """(row, id, n_tokens, p: array of posteriors in the order of domains, and the columns of by) for each row of docs.

    domain: an expression over labels that names a row's domain; null and other names are no label. A document with
    labels of several domains counts for the one whose name comes first.
    The classifier learns from at most taught_most labelled documents, those of the smallest id hashes.
    Without labels in a domain its prior is that of one text.
    """
    named = labels.select(
        F.col(id_).alias("id"), domain.alias("domain")
    ).where("id is not null").where(F.col("domain").isin(domains)).groupBy("id").agg(F.min("domain").alias("domain"))
    source = docs.select(
        F.col(id_).alias("id"), F.col(text).cast("string").alias("text"), *by
    ).withColumn("row", F.monotonically_increasing_id())
    bucket = F.pmod(F.xxhash64("w"), F.lit(buckets)).cast("int")

    sample = named.orderBy(F.xxhash64("id"), "id").limit(taught_most)  # bounded, so its broadcast is
    taught = docs.select(F.col(id_).alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(sample), "id")
    counts = taught.select(
        "domain", F.explode(words_of(F.col("text"))).alias("w")
    ).where("w <> ''").select("domain", bucket.alias("b")).groupBy("domain", "b").agg(F.count("*").alias("n"))
    seen: dict[str, dict[int, int]] = {d: {} for d in domains}
    for r in counts.collect():  # at most buckets x domains rows
        seen[r["domain"]][r["b"]] = r["n"]
    texts = {r["domain"]: r["n"] for r in named.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    prior = [log((texts.get(d, 0) + 1) / (sum(texts.values()) + len(domains))) for d in domains]
    total = [sum(seen[d].values()) + alpha * buckets for d in domains]
    like = [[log((seen[d].get(b, 0) + alpha) / total[k]) for k, d in enumerate(domains)] for b in range(buckets)]
    table = docs.sparkSession.createDataFrame(
        [(b, *[x - row[0] for x in row[1:]]) for b, row in enumerate(like)],
        ", ".join(["b int", *[f"l{k} double" for k in range(1, len(domains))]]),
    )

    word = source.select(
        "row", "id", *by, F.explode(words_of(F.col("text"))).alias("w")
    ).where("w <> ''").select("row", "id", *by, bucket.alias("b"))
    ratios = range(1, len(domains))
    found = word.join(F.broadcast(table), "b").groupBy("row", "id", *by).agg(
        F.count("*").alias("n"), *[F.sum(f"l{k}").alias(f"s{k}") for k in ratios]
    )
    blank = source.where(F.trim(F.translate(F.coalesce("text", F.lit("")), "\t\n\x0b\x0c\r", "     ")) == "").select(
        "row", "id", *by, F.lit(0).cast("long").alias("n"), *[F.lit(0.0).alias(f"s{k}") for k in ratios]
    )
    every = found.unionByName(blank)
    z = [
        F.lit(prior[0]),
        *[
            F.lit(prior[k]) + F.col(f"s{k}") * F.least(
                F.lit(1.0), F.lit(float(evidence)) / F.greatest(F.col("n"), F.lit(1))
            ) for k in ratios
        ],
    ]
    every = every.withColumn("z", F.array(*z)).withColumn("z", F.expr("transform(z, x -> exp(x - array_max(z)))"))
    share = F.expr("transform(z, x -> x / aggregate(z, 0D, (a, y) -> a + y))")
    return every.select("row", "id", *by, F.col("n").alias("n_tokens"), share.alias("p"))


def fit_rates(
    state: DataFrame, targets: list[float] | None, weights: list[float], least: float = 0.0, tolerance: float = 1e-5, most: int = 200,
    fold: int = 8,
) -> DataFrame:
    """state (n_tokens, p, ...) with the column rate. targets: tokens wanted of each domain; None: as few as the weights need for no domain to shrink."""
    k = len(weights)
    sums = [F.sum(F.col("n_tokens") * F.col("p")[i]).alias(f"s{i}") for i in range(k)]
    start = [x or 0.0 for x in state.agg(*sums).first()]
    if targets is None:
        grown = max((s / w for s, w in zip(start, weights, strict=True) if w), default=0.0)
        targets = [w * grown for w in weights]
    now, at = state.withColumn("rate", F.lit(1.0)), start
    steps: list[list[float]] = []
    for _ in range(most):
        gap = [t - s for t, s in zip(targets, at, strict=True)]
        if max((abs(g) / max(t, 1.0) for g, t, s in zip(gap, targets, start, strict=True) if s), default=0.0) <= tolerance:
            break
        steps.append([g / s if s else 0.0 for g, s in zip(gap, start, strict=True)])
        if len(steps) == fold:
            now, steps = materialise(_moved(now, steps, least)), []
        ahead = _moved(now, steps, least) if steps else now
        was, at = at, [x or 0.0 for x in ahead.agg(*[F.sum(F.col("rate") * F.col("n_tokens") * F.col("p")[i]) for i in range(k)]).first()]
        if max((abs(a - b) / max(s, 1.0) for a, b, s in zip(at, was, start, strict=True)), default=0.0) <= 10 * tolerance:
            break  # the rates that may still move do no more good
    return _moved(now, steps, least) if steps else now


def _moved(state: DataFrame, steps: list[list[float]], least: float) -> DataFrame:
    rate = F.col("rate")
    for step in steps:
        move = sum((F.col("p")[i] * F.lit(x) for i, x in enumerate(step)), F.lit(0.0))
        rate = F.greatest(rate + move, F.lit(float(least)))
    return state.withColumn("rate", rate)


def copies_of(rate: Column, *key: str) -> Column:
    """Whole copies whose mean is the rate: the whole part, and one more for the part of rows that a hash picks."""
    u = F.pmod(F.xxhash64(*key), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return (F.floor(rate) + (u < rate - F.floor(rate)).cast("long")).cast("long")


def soft_mix(
    docs: DataFrame, labels: DataFrame, domain: Column, weights: dict[str, float], id_: str = "doc_id", text: str = "text",
    least: float = 0.0, shrink: bool = True, by: tuple[str, ...] = (), **classifier,
) -> DataFrame:
    """A row for each row of docs: id_, n_tokens, p_<domain> for each domain, rate, copies, and the columns of by.

    weights: a target share of the tokens for each domain; they are scaled to sum to one. The expected
    token totals are those shares of the present total or, without shrink, of the least total under which no domain's is
    below its present one. Rates are at least `least`. A domain that no document belongs to is left out of the fit; a target that
    nonnegative rates cannot meet is met as nearly as least squares can. Null and empty texts have no tokens, the
    prior as posteriors and a rate like others. Repeated rows and null ids are rows like others.
    """
    domains, whole = list(weights), sum(weights.values())
    share = [w / whole for w in weights.values()]
    state = materialise(posteriors(docs, labels, domain, domains, id_, text, by=by, **classifier))
    total = state.agg(F.sum("n_tokens")).first()[0] or 0
    rated = fit_rates(state, [w * total for w in share] if shrink else None, share, least)
    return rated.select(
        F.col("id").alias(id_), *by, "n_tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(domains)], "rate",
        copies_of(F.col("rate"), "id", "row").alias("copies"),
    )

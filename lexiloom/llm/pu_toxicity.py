"""Toxicity by non-negative positive-unlabelled learning.

The classifiers are linear over hashed words and word beginnings. A text is cut into even windows of some `WINDOW` words, and a
feature's value is how many different words of a window have it, on the mean of the windows; so what a text says throughout
counts, at any length, and what a long text happens to hold once does not. They learn from confirmed toxic texts (P) and texts of unknown kind (U) with the risk

    prior * loss(P as toxic) + max(0, loss(U as clean) - prior * loss(P as clean)),

logistic loss, prior the toxic share of the labelled training rows. Where the second term falls
below zero, the step goes against it instead, so U's hidden toxic texts are not learned as clean.

P is a bounded sample of the labelled rows: the confirmed texts of the `positives` smallest id hashes, each text
once. U is every training text. Features come in when their rate in P exceeds that in U by `screen` standard errors and
`lift` times, or half the way from 1 to 1 / prior where that is less, as what only toxic texts hold
reaches 1 / prior; the rest get no weight. Rates are counted over all of P and U on the cluster. U is then dealt by hash
into blocks of about `block` texts; a task learns a numpy classifier from P and one block, and the model is the mean of
the classifiers, so every text teaches and no task holds more than a block. No text counts for more than one in `copies` of
U's rows, on however many it stands; so a corpus and its double weigh their texts alike. The driver sees counts of P's features and the weights, both bounded by P.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lexiloom.llm.words import Words, batches, combine, mix, release
from lexiloom.plans.lineage import materialise

SPACE = 1 << 31  # of feature numbers; few enough features are used that they hardly ever share one
GATES = 1 << 20
CUTS = (4, 5, 6)
#: What the pooled standard error takes for the size of U, in sizes of P.
RATIO = 3.0
WINDOW = 128
#: Values are kept in steps of 1 / STEPS, up to MOST of them.
STEPS, MOST = 16, 255


def features(words: Words, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of a column and the row of each, repeats included."""
    hashes, at = words.beginnings(text, CUTS)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    spread = [(mix(h ^ np.uint64(k)) & np.uint64(SPACE - 1)).astype(np.int32) for k, h in enumerate(hashes)]
    return np.concatenate(spread), np.tile(row, len(spread))


def present(words: Words, text: pa.Array, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, places in used) of the used features that texts hold, without repeats, in order."""
    f, row = features(words, text)
    hit, place = among(f, used)
    pairs = np.unique(row[hit].astype(np.int64) * SPACE + place)
    return pairs // SPACE, pairs % SPACE


def valued(words: Words, text: pa.Array, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, places in used, values in steps) of the used features that texts hold, without repeats, in order."""
    hashes, at = words.beginnings(text, CUTS)
    count = np.diff(at)
    windows = np.maximum(1, np.rint(count / WINDOW).astype(np.int64))
    found = []
    for k, h in enumerate(hashes):
        hit, place = among((mix(h ^ np.uint64(k)) & np.uint64(SPACE - 1)).astype(np.int32), used)
        r = np.searchsorted(at, hit, side="right") - 1
        window = ((hit - at[r]) * windows[r] // count[r]).astype(np.uint64)
        found.append((r * SPACE + place, combine(window, hashes[0][hit])))
    pair, said = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((said, pair))
    pair, said = pair[order], said[order]
    other = np.ones(len(pair), bool)
    other[1:] = (pair[1:] != pair[:-1]) | (said[1:] != said[:-1])
    pairs, different = np.unique(pair[other], return_counts=True)  # a word once in each window
    r = pairs // SPACE
    return r, pairs % SPACE, np.clip(np.ceil(different / windows[r] * STEPS), 1, MOST).astype(np.int64)


def chosen(p: np.ndarray, u: np.ndarray, prior: float, screen: float = 4.0, lift: float = 2.5) -> np.ndarray:
    """Whether features come in; p: (texts of P with each, texts of P), u: each one's rate in U."""
    count, size = p
    rate = count / max(1, size)
    both = (rate + RATIO * u) / (1 + RATIO)
    gap = (rate - u) / np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 + 1 / RATIO) / max(1, size))
    return (gap >= screen) & (rate >= min(lift, (1 + 1 / prior) / 2) * u) & (count >= 3)


def learn(
    positive: tuple, unlabelled: tuple, prior: float, used: int, steps: int = 400, rate: float = 0.1, ridge: float = 5e-5
) -> tuple[np.ndarray, float]:
    """Weights of `used` features and the bias at the non-negative risk's minimum.

    The samples: (rows, features) without repeats, their values, and the weight of each text.
    """
    (pr, pc, px, pw), (ur, uc, ux, uw) = positive, unlabelled
    np_, nu = len(pw), len(uw)
    pw, uw = pw / pw.sum(), uw / uw.sum()
    w, b = np.zeros(used), float(np.log(prior / (1 - prior)))
    m1, m2 = np.zeros(used + 1), np.zeros(used + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, steps + 1):
        zp, zu = b + np.bincount(pr, w[pc] * px, np_), b + np.bincount(ur, w[uc] * ux, nu)
        sp, su = sigmoid(zp) * pw, sigmoid(zu) * uw
        as_clean = uw @ np.logaddexp(0, zu) - prior * (pw @ np.logaddexp(0, zp))
        if as_clean >= 0:
            dp, du = -prior * pw, su
        else:
            dp, du = prior * sp, -su
        g = np.append(np.bincount(pc, dp[pr] * px, used) + np.bincount(uc, du[ur] * ux, used), dp.sum() + du.sum())
        g[:-1] += ridge * w
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        step = rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def among(f: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where f holds used features, and their places in used."""
    if not len(used):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gate = np.zeros(GATES, bool)
    gate[used & (GATES - 1)] = True
    hit = np.flatnonzero(gate[f & (GATES - 1)])
    at = np.minimum(np.searchsorted(used, f[hit]), len(used) - 1)
    same = used[at] == f[hit]
    return hit[same], at[same]


def _constant(prior: float) -> tuple[np.ndarray, np.ndarray, float]:
    return np.zeros(0, np.int32), np.zeros(0), float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))


def _positive_counts(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features of at least three texts, in order, and in how many texts each is."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for whole in parts:
            for part in batches(whole, 1 << 21):
                f, row = features(words, part.column(0))
                f, n = np.unique(np.unique(row.astype(np.int64) * SPACE + f) % SPACE, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(f.astype(np.int32)), pa.array(n)], names=["f", "n"])

    got = texts.select("text").mapInArrow(count, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).where("n >= 3").toArrow()
    f, n = got.column("f").to_numpy(), got.column("n").to_numpy()
    order = np.argsort(f)
    return f[order], n[order]


def _rates(rows: DataFrame, wanted: np.ndarray) -> np.ndarray:
    """The rate of each feature in rows (text, weight)."""
    held = rows.sparkSession.sparkContext.broadcast(wanted)

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sums, total = Words(), np.zeros(len(held.value)), 0.0
        for whole in parts:
            for part in batches(whole, 1 << 21):
                row, f = present(words, part.column(0), held.value)
                weight = part.column(1).to_numpy(zero_copy_only=False)
                sums += np.bincount(f, weight[row], len(sums))
                total += weight.sum()
                release()
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(sums[some], total))], names=["f", "w"]
        )

    got = rows.select("text", "weight").mapInArrow(count, "f int, w double").groupBy("f").agg(F.sum("w").alias("w")).toArrow()
    f, w = got.column("f").to_numpy(), got.column("w").to_numpy()
    total = w[f < 0].sum()
    out = np.zeros(len(wanted))
    out[f[f >= 0]] = w[f >= 0] / max(total, 1e-9)
    held.unpersist()
    return out


def weighed(source: DataFrame, copies: int) -> tuple[int, DataFrame]:
    """The number of source's rows (id, text), and them with a weight each, so that no text has more in all than one in `copies` rows."""
    whole, name = source.count(), F.xxhash64("text")
    # texts on more rows than that: fewer than `copies`, or all where these are no more rows
    common = source.groupBy(name.alias("h")).agg(F.count("*").alias("n")).where(F.col("n") * copies > whole)
    return whole, source.join(F.broadcast(common), name == F.col("h"), "left").select(
        "id", "text", F.coalesce(whole / (copies * F.col("n")), F.lit(1.0)).alias("weight")
    )


def fit(
    docs: DataFrame, labels: DataFrame, train: Column, id_: str = "doc_id", text: str = "text", label: str = "toxic",
    positives: int = 4000, block: int = 12_000, screen: float = 4.0, lift: float = 2.5, copies: int = 10_000,
) -> tuple[np.ndarray, np.ndarray, float]:
    """(features used, in order, their weights, bias): what the blocks' classifiers are on the mean."""
    spark = docs.sparkSession
    rows = labels.where(train).select(
        F.col(id_).alias("id"), F.col(label).alias("y")
    ).where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    prior = rows.agg(F.avg(F.col("y").cast("double"))).first()[0] or 0.0
    if not 0 < prior < 1:
        return _constant(prior)
    picked = rows.where("y = 1").orderBy(F.xxhash64("id"), "id").limit(positives).select("id")  # bounded, so the broadcast is
    source = docs.where(F.coalesce(train, F.lit(False))).select(
        F.col(id_).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )
    confirmed = materialise(source.join(F.broadcast(picked), "id", "left_semi").select("text").distinct())
    wanted, count = _positive_counts(confirmed)
    size = confirmed.count()
    able = chosen((count, size), np.zeros(len(wanted)), prior, screen, lift)
    wanted, count = wanted[able], count[able]

    whole, unlabelled = weighed(source, copies)
    rate = _rates(unlabelled, wanted)
    used = wanted[chosen((count, size), rate, prior, screen, lift)]
    if not len(used):
        return _constant(prior)

    held = spark.sparkContext.broadcast(used)

    def hold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for whole in parts:
            for part in batches(whole, 1 << 21):
                row, f, x = valued(words, part.column(0), held.value)
                at = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                release()
                both = f * (MOST + 1) + x
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array(at), pa.array(both)), *part.columns[1:]],
                    names=["f", *part.schema.names[1:]],
                )

    def sample(lists: list[np.ndarray], weight: np.ndarray) -> tuple[np.ndarray, ...]:
        both = np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64)
        return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), both // (MOST + 1), both % (MOST + 1) / STEPS, weight

    known = confirmed.select("text").mapInArrow(hold, "f array<long>").toArrow().column("f").to_pylist()
    toxic = spark.sparkContext.broadcast(sample(known, np.ones(len(known))))

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        w, b = learn(toxic.value, sample(list(frame["f"]), frame["weight"].to_numpy()), prior, len(used))
        return pd.DataFrame(
            {"at": np.arange(len(w) + 1, dtype=np.int32), "w": np.append(w, b), "n": np.full(len(w) + 1, frame["weight"].sum())}
        )

    spread = F.pmod(F.xxhash64("id", F.xxhash64("text")), F.lit(max(1, round(whole / block)))).alias("block")
    # rows of a block that hold the same features are one, so that no text repeated without end fills a task
    blocks = unlabelled.select("text", "weight", spread).mapInArrow(
        hold, "f array<long>, weight double, block long"
    ).groupBy("block", "f").agg(F.sum("weight").alias("weight"))
    mean = blocks.groupBy("block").applyInPandas(one, "at int, w double, n double").groupBy("at").agg(
        (F.sum(F.col("w") * F.col("n")) / F.sum("n")).alias("w")
    )
    got = mean.toArrow()
    model = np.empty(len(used) + 1)
    model[got.column("at").to_numpy()] = got.column("w").to_numpy()
    for b in (held, toxic):
        b.unpersist()
    return used, model[:-1], float(model[-1])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text: str = "text", into: str = "score") -> DataFrame:
    """docs with the score of each row's whole text in the column `into`, which docs must not have."""
    *weights, bias = model
    held_by_all = docs.sparkSession.sparkContext.broadcast(tuple(weights))
    schema = StructType([*docs.schema.fields, StructField(into, DoubleType())])
    at, size = docs.columns.index(text), len(docs.columns)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (held, w) = Words(), held_by_all.value
        for whole in parts:
            for part in batches(whole, 1 << 21):
                column = part.column(at)
                row, f, x = valued(
                    words,
                    column if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.cast(pa.string()), held,
                )
                release()
                z = bias + np.bincount(row, w[f] * x / STEPS, part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(size)), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))],
                    names=[*part.schema.names, into],
                )

    return docs.mapInArrow(run, schema)


def pu_toxicity(
    docs: DataFrame, labels: DataFrame, train: Column, id_: str = "doc_id", text: str = "text", label: str = "toxic",
    threshold: float = 0.7, **sampling,
) -> DataFrame:
    """A row for each row of docs: id_, score (0 to 1), predicted (1 from threshold on).

    train: a condition on id_ that picks the rows whose labels may be learned; null counts as no. A
    document labelled more than once is toxic if any label says so; null labels count as none. Empty
    and null texts get the score of a text without features. Without confirmed toxic texts every
    score is the prior. Rows with a null id and repeated rows are scored like others. Other columns
    are left out. Only the confirmed texts are a sample, of at most `positives` labelled rows.
    """
    model = fit(docs, labels, train, id_, text, label, **sampling)
    scored = score(docs.select(F.col(id_).alias("id"), F.col(text).cast("string").alias("text")), model)
    return scored.select(F.col("id").alias(id_), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

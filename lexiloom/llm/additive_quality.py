"""Quality by a generalised additive model with pairwise interactions.

A text is some thirty measures (text_measures), of letters, words, lines and repetition; no words are looked up. Each measure is cut
into bins at quantiles over all labelled training rows. The model is a bias, a lookup table over the bins of each measure, and
tables over coarse bins of some pairs. Tables are learned by cyclic boosting: round after round, measure after measure, a
tree of at most three leaves is fitted to the bins' gradients and a part of it added to the measure's table, so none takes what
another explains. Then the pairs of measures that still tell most about the residuals get tables by trees of four leaves.

Labelled rows are dealt by hash into blocks of about `block` rows; a task learns tables from its block, and the model is their mean
by rows, so all labelled rows teach and no task holds more than a block. Texts are read once: measures are written, joined with
labels and scored from there. The driver sees edges, tables and the pairs' gains, whose number does not depend on the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.words import Words, batches, combine, release, text_bytes
from lexiloom.plans.lineage import materialise

BINS, COARSE = 32, 8
RATE, PENALTY, LEAST = 0.1, 1.0, 2.0
_PUNCTUATION, _LOUD, _QUOTES = b".,;:", b"!?", b"\"'()-"


def _classes() -> np.ndarray:
    """What each byte is: 0 other symbols, 1 small letters, 2 capitals, 3 digits, 4 blanks, 5 line ends, 6 stops, 7 ! and ?, 8 quotes, 9 beyond ASCII, 10 controls."""
    out = np.zeros(256, np.uint8)
    out[:32] = 10
    out[127] = 10
    out[97:123], out[65:91], out[48:58], out[128:] = 1, 2, 3, 9
    out[[9, 11, 12, 32]], out[[10, 13]] = 4, 5
    for k, some in ((6, _PUNCTUATION), (7, _LOUD), (8, _QUOTES)):
        out[list(some)] = k
    return out


_KIND = _classes()
MEASURES = (
    "bytes", "words", "lines", "symbols", "small", "capitals", "digits", "stops", "loud", "quotes", "beyond", "controls", "blanks", "entropy",
    "word_length", "word_spread", "word_longest", "short_words", "sentence_ends", "capital_words", "marked_words", "bare_words", "distinct_words",
    "repeated_words", "top_word", "distinct_triples", "top_triple", "words_a_line", "words_a_sentence",
)


def text_measures(words: Words, text: pa.Array) -> np.ndarray:
    """(rows, measures) of a column's whole texts; null and empty texts are 0 in all."""
    data, at = text_bytes(text)
    n, size = len(at) - 1, np.diff(at).astype(np.float64)
    token, first = words.tokens(text)
    count = np.diff(first).astype(np.float64)
    row = np.repeat(np.arange(n), np.diff(first))
    per = lambda x, of: np.divide(x, of, out=np.zeros(n), where=of > 0)

    kinds, spread = np.zeros((n, 11)), np.zeros(n)
    for i in range(n):  # a row at a time: counts of bytes, whose tables are small
        seen = np.bincount(data[at[i] : at[i + 1]], minlength=256)
        kinds[i] = np.bincount(_KIND, seen, 11)
        held = seen[seen > 0] / max(1.0, size[i])
        spread[i] = -(held * np.log2(held)).sum()
    letters = kinds[:, 1] + kinds[:, 2]

    word = ~words.space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    begins = np.flatnonzero(word & np.concatenate([[True], ~word[:-1]] if len(data) else [np.zeros(0, bool)]) | word & edge[:-1])
    ends = np.flatnonzero(word & (np.concatenate([~word[1:], [True]]) if len(data) else np.zeros(0, bool)) | word & edge[1:])
    length = (ends - begins + 1).astype(np.float64)
    add = lambda x: np.bincount(row, x, n)
    head, tail = _KIND[data[begins]], _KIND[data[ends]]
    mean = per(add(length), count)
    longest = np.zeros(n)
    np.maximum.at(longest, row, length)
    sentence = add((data[ends] == 46) | (tail == 7))

    def shape(keys: np.ndarray, rows: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The share of different keys in each row, and that of its most frequent one."""
        order = np.lexsort((keys, rows))
        k, r = keys[order], rows[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
        starts = np.flatnonzero(new)
        top = np.zeros(n)
        np.maximum.at(top, r[starts], np.diff(np.append(starts, len(k))).astype(np.float64))
        return per(np.bincount(r[starts], minlength=n).astype(np.float64), of), per(top, of)

    distinct, top = shape(token, row, count)
    triples = combine(combine(token[:-2], token[1:-1]), token[2:]) if len(token) > 2 else np.zeros(0, np.uint64)
    inside = row[:-2] == row[2:] if len(token) > 2 else np.zeros(0, bool)
    distinct3, top3 = shape(triples[inside], row[:-2][inside] if len(token) > 2 else row[:0], np.maximum(count - 2, 0))
    again = np.zeros(len(token))
    again[1:] = (token[1:] == token[:-1]) & (row[1:] == row[:-1])
    lines = kinds[:, 5] + (size > 0)
    out = np.stack(
        [
            np.log1p(size), np.log1p(count), np.log1p(lines), per(kinds[:, 0], size), per(kinds[:, 1], size), per(kinds[:, 2], letters),
            per(kinds[:, 3], size), per(kinds[:, 6], size), per(kinds[:, 7], size), per(kinds[:, 8], size), per(kinds[:, 9], size),
            per(kinds[:, 10], size), per(kinds[:, 4], size), spread, mean, np.sqrt(np.maximum(per(add(length * length), count) - mean**2, 0)),
            np.log1p(longest), per(add(length <= 3), count), per(sentence, count), per(add(head == 2), count), per(add(tail == 0), count),
            per(add((length == 1) & (head == 0)), count), distinct, per(add(again), count), top, distinct3, top3,
            np.log1p(per(count, lines)), np.log1p(per(count, sentence)),
        ],
        axis=1,
    )
    return np.nan_to_num(out).astype(np.float32)


class Additive(NamedTuple):
    """edges: for each measure, in order; a value's bin is the number of edges below or at it. The score's logit is the bias and all tables' entries."""

    edges: list[np.ndarray]
    bias: float
    mains: np.ndarray  # (measures, BINS)
    pairs: list[tuple[int, int]]
    tables: np.ndarray  # (pairs, COARSE * COARSE)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def logit(self, b: np.ndarray) -> np.ndarray:
        z = self.bias + self.mains[np.arange(b.shape[1]), b].sum(axis=1)
        for (i, j), table in zip(self.pairs, self.tables, strict=True):
            z = z + table[_coarse(b[:, i]) * COARSE + _coarse(b[:, j])]
        return z


def _coarse(b: np.ndarray) -> np.ndarray:
    return b.astype(np.int64) * COARSE // BINS


_CUT = np.array([(i, j) for i in range(1, BINS) for j in range(i, BINS)])


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return np.where(h >= LEAST, g * g / (h + PENALTY), -np.inf)


def three_leaves(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The values of the best tree of at most three leaves over ordered bins with sums of gradients and hessians."""
    cg, ch = np.append(0, np.cumsum(g)), np.append(0, np.cumsum(h))
    i, j = _CUT[:, 0], _CUT[:, 1]
    middle = _gain(cg[j] - cg[i], ch[j] - ch[i])
    gain = _gain(cg[i], ch[i]) + np.where(i == j, 0.0, middle) + _gain(cg[-1] - cg[j], ch[-1] - ch[j])
    best = int(np.argmax(gain))
    out = np.zeros(len(g))
    if not gain[best] > cg[-1] ** 2 / (ch[-1] + PENALTY):
        return out
    for low, high in ((0, i[best]), (i[best], j[best]), (j[best], len(g))):
        out[low:high] = (cg[high] - cg[low]) / (ch[high] - ch[low] + PENALTY)
    return out


def four_leaves(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The values, over a square of bins, of the best tree that cuts it into quarters, and what it gains."""
    cg, ch = (np.zeros((COARSE + 1, COARSE + 1)) for _ in range(2))
    cg[1:, 1:], ch[1:, 1:] = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def quarters(c: np.ndarray) -> list[np.ndarray]:
        a, b, whole = c[1:-1, 1:-1], c, c[-1, -1]
        top, left = b[1:-1, -1:], b[-1:, 1:-1]
        return [a, top - a, left - a, whole - top - left + a]

    gq, hq = quarters(cg), quarters(ch)
    gain = sum(np.where(y > 0, x * x / (y + PENALTY), 0.0) for x, y in zip(gq, hq, strict=True)) - cg[-1, -1] ** 2 / (ch[-1, -1] + PENALTY)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.zeros((COARSE, COARSE))
    leaf = [x[i, j] / (y[i, j] + PENALTY) for x, y in zip(gq, hq, strict=True)]
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = leaf
    return out, float(gain[i, j])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def learn_mains(b: np.ndarray, y: np.ndarray, w: np.ndarray, bias: float, rounds: int) -> np.ndarray:
    """The measures' tables, each centred, after rounds of cyclic boosting on rows of bins, labels and weights."""
    mains, z = np.zeros((b.shape[1], BINS)), np.full(len(y), bias)
    for _ in range(rounds):
        for k in range(b.shape[1]):
            p = _sigmoid(z)
            step = RATE * three_leaves(np.bincount(b[:, k], w * (y - p), BINS), np.bincount(b[:, k], w * p * (1 - p), BINS))
            mains[k] += step
            z += step[b[:, k]]
    return mains


def pair_gains(b: np.ndarray, y: np.ndarray, w: np.ndarray, z: np.ndarray) -> np.ndarray:
    """(measures, measures): what a tree over each pair's coarse bins gains on the residuals of logits z."""
    p = _sigmoid(z)
    g, h, c, n = w * (y - p), w * p * (1 - p), _coarse(b), b.shape[1]
    out = np.zeros((n, n))
    for i in range(n):
        for j in range(i + 1, n):
            cell = c[:, i] * COARSE + c[:, j]
            square = lambda x: np.bincount(cell, x, COARSE * COARSE).reshape(COARSE, COARSE)  # noqa: B023, E731
            out[i, j] = four_leaves(square(g), square(h))[1]
    return out


def learn_pairs(b: np.ndarray, y: np.ndarray, w: np.ndarray, z: np.ndarray, pairs: list[tuple[int, int]], rounds: int) -> np.ndarray:
    c, tables = _coarse(b), np.zeros((len(pairs), COARSE * COARSE))
    cells, z = [c[:, i] * COARSE + c[:, j] for i, j in pairs], z.copy()
    for _ in range(rounds):
        for k, cell in enumerate(cells):
            p = _sigmoid(z)
            square = lambda x: np.bincount(cell, x, COARSE * COARSE).reshape(COARSE, COARSE)  # noqa: B023, E731
            step = RATE * four_leaves(square(w * (y - p)), square(w * p * (1 - p)))[0].ravel()
            tables[k] += step
            z += step[cell]
    return tables


def measured(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, x): the measures of each row's whole text."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for whole in parts:
            for part in batches(whole, 1 << 21):
                x = text_measures(words, part.column(1))
                at = pa.array(np.arange(0, x.size + 1, len(MEASURES)), pa.int32())
                release()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(at, pa.array(x.ravel()))], names=["id", "x"])

    rows = docs.select(F.col(id_).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, x array<float>")


def _matrix(column: pa.Array, dtype: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(dtype, copy=False)


def fit(rows: DataFrame, block: int, rounds: int, pairs: int) -> Additive:
    """The model of rows (id, x, y), a written table. Without rows of both labels it is a bias."""
    count = len(MEASURES)
    none = Additive([np.zeros(0)] * count, 0.0, np.zeros((count, BINS)), [], np.zeros((0, COARSE * COARSE)))
    total, prior = rows.agg(F.count("*"), F.avg(F.col("y").cast("double"))).first()
    if not total or not 0 < prior < 1:
        share = min(max(prior if total else 0.5, 1e-3), 1 - 1e-3)
        return none._replace(bias=float(np.log(share / (1 - share))))
    cuts = [k / BINS for k in range(1, BINS)]
    got = rows.agg(*[F.percentile_approx(F.col("x")[k], cuts, 10_000).alias(f"e{k}") for k in range(count)]).first()
    model = none._replace(edges=[np.unique(np.array(e, np.float32)) for e in got], bias=float(np.log(prior / (1 - prior))))

    def binned(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            b = model.bins(_matrix(part.column(2), np.float32))
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array([r.tobytes() for r in b], pa.binary())], names=["block", "y", "b"])

    # rows of a block that fall into the same bins are one, so that no text repeated without end fills a task
    spread = F.pmod(F.xxhash64("id"), F.lit(max(1, round(total / block)))).alias("block")
    blocks = materialise(
        rows.select(spread, F.col("y").cast("int").alias("y"), "x").mapInArrow(binned, "block long, y int, b binary").groupBy("block", "y", "b").agg(
            F.count("*").cast("double").alias("w")
        )
    )

    def sample(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        b = np.frombuffer(b"".join(frame["b"]), np.uint8).reshape(len(frame), count)
        return b, frame["y"].to_numpy(np.float64), frame["w"].to_numpy(np.float64)

    def mean(learn, weighted: bool = True) -> np.ndarray:
        """The mean of what learn(b, y, w) returns over the blocks, by their rows; or its sum."""

        def one(frame: pd.DataFrame) -> pd.DataFrame:
            b, y, w = sample(frame)
            v = learn(b, y, w).ravel()
            n = w.sum() if weighted else 1.0
            return pd.DataFrame({"at": np.arange(len(v), dtype=np.int32), "v": v * n, "n": n})

        of = F.sum("v") / F.sum("n") if weighted else F.sum("v")
        out = blocks.groupBy("block").applyInPandas(one, "at int, v double, n double").groupBy("at").agg(of.alias("v")).toArrow()
        v = np.zeros(out.num_rows)
        v[out.column("at").to_numpy()] = out.column("v").to_numpy()
        return v

    bias = model.bias
    model = model._replace(mains=mean(lambda b, y, w: learn_mains(b, y, w, bias, rounds)).reshape(count, BINS))
    gains = mean(lambda b, y, w, m=model: pair_gains(b, y, w, m.logit(b)), weighted=False).reshape(count, count)
    chosen = [divmod(int(k), count) for k in np.argsort(-gains, axis=None, kind="stable")[:pairs] if gains.flat[k] > 0]
    if not chosen:
        return model
    tables = mean(lambda b, y, w, m=model: learn_pairs(b, y, w, m.logit(b), chosen, max(1, rounds // 4)))
    return model._replace(pairs=chosen, tables=tables.reshape(len(chosen), -1))


def additive_quality(
    docs: DataFrame, labels: DataFrame, train: Column, id_: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.7,
    block: int = 20_000, rounds: int = 120, pairs: int = 8,
) -> DataFrame:
    """A row for each row of docs: id_, score (0 to 1), predicted (1 from threshold on).

    train: a condition on id_ that picks the rows whose labels may be learned; null counts as no. A document labelled more than once
    counts with the mean of its labels, rounded up; null labels count as none, and documents that share an id with its label. Empty and null
    texts get the score of a text whose measures are 0. Where one label has no rows every score is that label's share, kept within 0.001 to
    0.999; without labels it is 0.5. Rows with a null id and repeated rows are scored like others. Other columns are left out.
    """
    known = labels.where(F.coalesce(train, F.lit(False))).select(F.col(id_).alias("id"), F.col(label).cast("double").alias("y")).where(
        "id is not null and y is not null"
    ).groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    rows = materialise(measured(docs, id_, text))
    model = fit(materialise(rows.join(known, "id")), block, rounds, pairs)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            score = _sigmoid(model.logit(model.bins(_matrix(part.column(1), np.float32))))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score)], names=["id", "score"])

    scored = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double")
    return scored.select(F.col("id").alias(id_), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

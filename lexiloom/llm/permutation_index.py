"""Nearest neighbours by a permutation index.

Each vector is represented by the order of its `length` nearest pivots, of many more, and posted in their inverted
files with the place that the pivot has for it. A query reads the files of its own pivots alone and ranks the
vectors that it meets there by the footrule distance, the sum of |place for the query - place for the vector|
over its pivots, where a pivot that a vector is not posted under counts as the place `ABSENT` * length. The best of a
block, `share` of its vectors and SPARE more for each neighbour, ties at the edge included, are ranked again by exact
inner product; vectors met in no file are not looked at.
Vectors get one more component, sqrt(M^2 - |x|^2) with M the largest norm, so that the order of pivots follows the inner product and not the angle.

With 2048 pivots and 64 places a query reads two postings for each vector of a block, on the mean, and multiplies out
an eighth of the vectors and 160 more: a fifth of a block of 2048, 13 % of a large one. The 160 are there because the order of a small
block's vectors by footrule is as noisy as a large one's, and its best twenty a larger part of it; the rule is the same at
all sizes. A smaller table has a pivot for every fourth vector.

Vectors are dealt into blocks of bounded size, each with its own inverted files, and queries into blocks of theirs. A
vector moves once for each block of queries, and a query once for each block of vectors; a meeting leaves the best k for each
query, and the best k of these are the result. In a block equal vectors are one, with their k + 1 smallest
ids. Only the pivots, picked from a bounded sample, are fitted.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.vectors import rows_by_dimension
from lexiloom.plans.lineage import materialise

ABSENT = 4
SMALL_BLOCK = 2048
SPARE = 8


def lift(x: np.ndarray, most: float) -> np.ndarray:
    """Vectors with the component that makes all norms equal."""
    x = x / most
    return np.column_stack([x, np.sqrt(np.maximum(0.0, 1 - np.einsum("ij,ij->i", x, x)))])


def orders(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """Each row's `length` nearest pivots, nearest first, ties to the first pivot."""
    out = np.empty((len(x), length), np.int32)
    for low in range(0, len(x), 512):
        near = -(x[low : low + 512] @ pivots.T)
        if length < near.shape[1]:
            near = np.where(near <= np.partition(near, length - 1, axis=1)[:, length - 1 : length], near, np.inf)
        out[low : low + 512] = np.argsort(near, axis=1, kind="stable")[:, :length]
    return out


def reranked(size: int, k: int, share: float) -> int:
    """How many of a block of `size` different vectors are multiplied out, without ties at the edge."""
    return min(size, SPARE * k + ceil(share * size))


class Files:
    """The inverted files of a block of different vectors."""

    def __init__(self, order: np.ndarray, pivots: int) -> None:
        self.size, self.length = order.shape
        by_pivot = np.argsort(order.ravel(), kind="stable")
        self.begins = np.searchsorted(order.ravel()[by_pivot], np.arange(pivots + 1))
        self.vector, self.place = np.divmod(by_pivot, self.length)

    def ranked(self, order: np.ndarray, want: int) -> np.ndarray:
        """The `want` vectors of least footrule distance to a query's order and all that are as near as the last, if they share a file with it."""
        parts = [slice(self.begins[p], self.begins[p + 1]) for p in order]
        vector = np.concatenate([self.vector[s] for s in parts])
        own = np.repeat(np.arange(len(order)), [s.stop - s.start for s in parts])
        place = np.concatenate([self.place[s] for s in parts])
        # what a posting takes off the distance of a vector met nowhere
        less = np.bincount(vector, ABSENT * self.length - own - np.abs(own - place), self.size)
        met = np.flatnonzero(less > 0)
        if len(met) <= want:
            return met
        edge = np.partition(less[met], len(met) - want)[len(met) - want]
        return met[less[met] >= edge]


def nearest(
    query: np.ndarray, query_id: np.ndarray, x: np.ndarray, ids: np.ndarray, pivots: np.ndarray, most: float, length: int, share: float,
    k: int,
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, ids, inner products) of the best k found in a block for each query."""
    x, ids, first = _different(x, ids, k + 1)
    held = Files(orders(lift(x, most), pivots, length), len(pivots))
    flat = np.column_stack([query / np.abs(query).max(axis=1, keepdims=True), np.zeros(len(query))])
    want = reranked(len(x), k, share)
    for own, q, order in zip(query_id, query, orders(flat, pivots, length), strict=True):
        pick = np.arange(len(x)) if want >= len(x) else held.ranked(order, want)
        score = np.einsum("ij,j->i", x[pick], q)
        if len(pick) > k + 1:
            best = score >= np.partition(score, len(score) - k - 1)[len(score) - k - 1]
            pick, score = pick[best], score[best]
        many = first[pick + 1] - first[pick]
        at = np.repeat(first[pick] - np.cumsum(many) + many, many) + np.arange(many.sum())
        found, score = ids[at], np.repeat(score, many)
        found, score = found[found != own], score[found != own]
        best = np.lexsort((found, -score))[:k]
        yield int(own), found[best], score[best]


def _different(x: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different rows of x, ids in their order, and where each one's begin; at most the `most` smallest of each."""
    order = np.lexsort((ids, *x.T[::-1]))
    x, ids = x[order], ids[order]
    fresh = np.ones(len(x), bool)
    fresh[1:] = (x[1:] != x[:-1]).any(axis=1)
    number = np.cumsum(fresh) - 1
    rank = np.arange(len(x)) - np.flatnonzero(fresh)[number]
    kept = rank < most
    return x[fresh], ids[kept], np.searchsorted(number[kept], np.arange(fresh.sum() + 1))


def permutation_search(
    table: DataFrame, queries, id_: str = "vec_id", vector: str = "embedding", k: int = 20, pivots: int = 2048, length: int = 64, share: float = 1 / 8, sample: int = 4096, block: int = 32_768, query_block: int = 16_384
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors of largest inner product found for each query, ties to the smaller id.

    queries: a condition that picks query rows; all other rows are a query's candidates. Null, empty
    and zero vectors, those with null or non-finite components and rows with a null id take no part. A query
    meets vectors of its dimension only. Rows that repeat an id are one: the largest of their products counts, and
    a query repeated is asked once, by its first vector. Blocks of so few vectors that reranked() takes them all are searched whole.
    Other columns are left out. The rerank share is a part of all vectors: what is bounded is memory, not work.
    """
    spark = table.sparkSession

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row, x in rows_by_dimension(part.column(1)):
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(take), part.column(2).take(take), pa.array(np.full(len(row), x.shape[1], np.int32)),
                        pa.array(np.linalg.norm(x, axis=1)), pa.array([v.tobytes() for v in x], pa.binary()),
                    ],
                    names=["id", "asked", "dim", "norm", "v"],
                )

    rows = table.where(F.col(id_).isNotNull()).select(
        F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"),
        F.coalesce(queries, F.lit(False)).alias("asked"),
    )
    rows = materialise(rows.mapInArrow(read, "id long, asked boolean, dim int, norm double, v binary"))
    shape = {
        r["dim"]: r for r in rows.groupBy("dim").agg(
            F.count("*").alias("n"), F.count_if("asked").alias("q"), F.max("norm").alias("most")
        ).collect()
    }
    first = Window.partitionBy("dim").orderBy(F.xxhash64("id"), "id", "v")
    fitted = {}
    for r in rows.select(
        "dim", "v", F.row_number().over(first).alias("n")
    ).where(F.col("n") <= sample).groupBy("dim").agg(F.sort_array(F.collect_set("v")).alias("vs")).collect():
        held = np.stack([np.frombuffer(v, np.float64) for v in r["vs"]])
        picked = np.random.default_rng(17).permutation(len(held))[: max(1, min(pivots, shape[r["dim"]]["n"] // 4))]
        fitted[r["dim"]] = (lift(held[picked], shape[r["dim"]]["most"]), float(shape[r["dim"]]["most"]))
    model = spark.sparkContext.broadcast(fitted)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_dim = lambda f: F.element_at(F.create_map(*[F.lit(y) for d, s in shape.items() for y in (d, f(s))]) if shape else F.create_map(F.lit(0), F.lit(1)), F.col("dim"))
    blocks = by_dim(lambda s: max(ceil(s["n"] / block), min(parts, ceil(s["n"] / SMALL_BLOCK))))
    groups = by_dim(lambda s: max(1, ceil(s["q"] / query_block)))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    dealt = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    asked = rows.where("asked").groupBy("id").agg(F.min(F.struct("dim", "v")).alias("r")).select("id", "r.dim", "r.v")
    asked = asked.select("id", "dim", "v", dealt(groups).alias("g"), every(blocks).alias("b"))
    posted = rows.select("id", "dim", "v", dealt(blocks).alias("b"), every(groups).alias("g"))

    def search(asked: pa.Table, posted: pa.Table) -> pa.Table:
        got = []
        if asked.num_rows and posted.num_rows:
            dim = asked.column("dim")[0].as_py()
            q, x = (np.frombuffer(b"".join(t.column("v").to_pylist()), np.float64).reshape(-1, dim) for t in (asked, posted))
            pivot, most = model.value[dim]
            got = list(
                nearest(q, asked.column("id").to_numpy(), x, posted.column("id").to_numpy(), pivot, most, min(length, len(pivot)), share, k)
            )
        empty = (0, np.zeros(0, np.int64), np.zeros(0))
        columns = [np.concatenate(c) for c in zip(*[(np.full(len(i), q, np.int64), i, s) for q, i, s in (*got, empty)], strict=True)]
        return pa.table(columns, names=["query_id", "vec_id", "score"])

    found = asked.groupBy("dim", "b", "g").cogroup(posted.groupBy("dim", "b", "g")).applyInArrow(
        search, "query_id long, vec_id long, score double"
    )
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

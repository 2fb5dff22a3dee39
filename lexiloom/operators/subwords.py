"""Subword ids of whole texts as a table function, and scores of windows of them by a model that is loaded once a worker.

    subwords(docs, "doc_id", "text", vocabulary, 1024, 1024, end=2)   # pieces, for packing
    subwords(docs, "doc_id", "text", vocabulary, 1024, 512)           # sliding windows, for perplexity
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

# Bytes of text that are tokenised at once (a longer text alone), and rows of windows that are counted at once: what a worker holds
# beside a batch. A tokenizer keeps some 100 bytes for each id.
AT_ONCE, ROWS_AT_ONCE = 1 << 19, 256
WINDOW = "begin bigint, end bigint, target_len bigint, ids array<int>"


def windows(n: int, longest: int, stride: int) -> list[tuple[int, int, int]]:
    """(begin, end, target_len) of the windows over n tokens: none begins once one has ended at n, and targets are what no window before held."""
    out: list[tuple[int, int, int]] = []
    begin = done = 0
    while done < n:
        end = min(begin + longest, n)
        out.append((begin, end, end - done))
        begin, done = begin + stride, end
    return out


def runs(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of runs in order whose sizes sum to `most` at most, or hold one item."""
    begin = held = 0
    for k, size in enumerate(sizes):
        if k > begin and held + size > most:
            yield begin, k
            begin, held = k, 0
        held += size
    if sizes:
        yield begin, len(sizes)


def subwords(
    docs: DataFrame, id_: str, text: str, vocabulary: str, longest: int, stride: int, end: int | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """(id_, keep, begin, end, target_len, ids) of each text's windows of `longest` ids, a new one each `stride`.

    vocabulary: the path of a tokenizers file, the same on all machines. end: an id put after each text's. Null and empty texts have
    no window, or that of the end id alone. A row holds one window, so no row grows with its text; texts are tokenised some AT_ONCE
    bytes at a time, whatever a batch of rows holds.
    """
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (id_, *keep))

    @F.arrow_udtf(returnType=f"{kinds}, {WINDOW}")
    class Subwords:
        def __init__(self) -> None:
            from tokenizers import Tokenizer

            self.made = Tokenizer.from_file(vocabulary)

        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            column = batch.column(batch.schema.get_field_index("__text"))
            sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
            for first, last in runs(sizes, AT_ONCE) if sizes else [(0, 0)]:
                yield self._cut(batch.slice(first, last - first), column.slice(first, last - first).to_pylist())

        def _cut(self, batch: pa.RecordBatch, texts: list[str | None]) -> pa.Table:
            row, cut, ids = [], [], []
            for i, got in enumerate(self.made.encode_batch([t or "" for t in texts], add_special_tokens=False)):
                whole = np.array(got.ids if end is None else [*got.ids, end], np.int32)
                for one in windows(len(whole), longest, stride):
                    row.append(i)
                    cut.append(one)
                    ids.append(whole[one[0] : one[1]])
            held = [batch.column(batch.schema.get_field_index(c)).take(pa.array(row, pa.int32())) for c in (id_, *keep)]
            ends = np.array(cut, np.int64).reshape(-1, 3)
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]), pa.int32()), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]))
            )
            return pa.Table.from_arrays([*held, *(pa.array(ends[:, k]) for k in range(3)), lists], names=[id_, *keep, "begin", "end", "target_len", "ids"])

    return Subwords(docs.select(id_, *keep, F.col(text).cast("string").alias("__text")).asTable())


def scored(rows: DataFrame, ids: str, target: str, longest: int, load: Callable[[], Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]], batch: int = 64) -> DataFrame:
    """rows with loss, the mean loss of each window's last `target` tokens, and error, what the model said where it failed.

    load() makes the model, once a worker: a function of (ids, lengths, targets), ids a matrix of at most `batch` windows filled up with
    zeros, that returns a loss for each. Where it raises, the batch's windows are asked one by one, and those that raise again have an error.
    """

    def make() -> Callable:
        model = load()

        def one(ids: np.ndarray, length: np.ndarray, target: np.ndarray, k: int) -> tuple[float, str | None]:
            try:
                return float(model(ids[k : k + 1], length[k : k + 1], target[k : k + 1])[0]), None
            except Exception as error:  # whatever a model does, the rows go on
                return float("nan"), str(error) or type(error).__name__

        def predict(ids: np.ndarray, length: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
            ids, length, target = ids.astype(np.int64), length.astype(np.int64).ravel(), target.astype(np.int64).ravel()
            try:
                got, why = np.asarray(model(ids, length, target), float), [None] * len(ids)
            except Exception:
                each = [one(ids, length, target, k) for k in range(len(ids))]
                got, why = np.array([x for x, _ in each]), [e for _, e in each]
            return {"loss": got, "error": np.array([w or "" for w in why])}

        return predict

    schema = StructType([StructField("loss", DoubleType()), StructField("error", StringType())])
    ask = predict_batch_udf(make, return_type=schema, batch_size=batch, input_tensor_shapes=[[longest], [1], [1]])
    size = F.size(ids)
    filled = F.concat(F.col(ids), F.array_repeat(F.lit(0), F.lit(longest) - size))
    said = ask(filled.cast("array<int>"), F.array(size), F.array(F.col(target).cast("int")))
    error = F.nullif(F.col("said.error"), F.lit(""))
    return rows.withColumn("said", said).withColumns({"loss": F.when(error.isNull(), F.col("said.loss")), "error": error}).drop("said")


BUCKETS = 1 << 18


def _bucket(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)) % np.uint64(BUCKETS)


def cuts(column: pa.Array, most: int) -> Iterator[pa.Array]:
    """The column in pieces of `most` rows, none copied."""
    return (column.slice(k, most) for k in range(0, len(column), most))


def bigram_counts(rows: DataFrame, ids: str, vocabulary_size: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts of ids, counts of hashed pairs of following ids) over windows that do not overlap; as many numbers at any size of rows."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single, pair = np.zeros(vocabulary_size, np.int64), np.zeros(BUCKETS, np.int64)
        for part in parts:
            for column in cuts(part.column(0), ROWS_AT_ONCE):
                flat = column.flatten().to_numpy(zero_copy_only=False)
                first = np.zeros(len(flat), bool)
                at = np.cumsum([0, *column.value_lengths().to_numpy(zero_copy_only=False)])[:-1]
                first[at[at < len(flat)]] = True
                single += np.bincount(flat, minlength=vocabulary_size)
                inside = ~first[1:]
                pair += np.bincount(_bucket(flat[:-1][inside], flat[1:][inside]).astype(np.int64), minlength=BUCKETS)
        every = np.concatenate([single, pair])
        some = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(every[some])], names=["at", "n"])

    got = rows.select(ids).mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    every = np.zeros(vocabulary_size + BUCKETS, np.int64)
    every[got.column("at").to_numpy()] = got.column("n").to_numpy()
    return every[:vocabulary_size], every[vocabulary_size:]


def bigram_model(single: np.ndarray, pair: np.ndarray, weight: float = 32.0) -> Callable[[], Callable]:
    """A loader of a model for scored(): the probability of an id is its share after the one before, drawn to its share of all ids by `weight`."""

    def load() -> Callable:
        share = (single + 0.5) / (single.sum() + 0.5 * len(single))

        def loss(ids: np.ndarray, length: np.ndarray, target: np.ndarray) -> np.ndarray:
            p = share[ids]
            before, now = ids[:, :-1], ids[:, 1:]
            p[:, 1:] = (np.minimum(pair[_bucket(before, now).astype(np.int64)], single[before]) + weight * share[now]) / (single[before] + weight)
            place = np.arange(ids.shape[1])
            asked = (place < length[:, None]) & (place >= (length - target)[:, None])
            return (-np.log(p) * asked).sum(axis=1) / np.maximum(asked.sum(axis=1), 1)

        return loss

    return load


"""LM scoring with a log-frequency Bloom filter: quantised n-gram counts, read by repeated membership probes.

Words are the vocabulary's tokens, each text ends in one end token. The unigram floor is exact:
p(w) = (c + 0.5) / (N + 0.5 (V + 1)). Above it stand bigrams and trigrams, with Dirichlet smoothing:

    p(w | v)   = (c(v w) + m2 p(w)) / (c(v) + m2)
    p(w | u v) = (c(u v w) + m3 p(w | v)) / (c(u v) + m3)

A bigram's or trigram's count is held as level q, the largest with edge(q) <= count, edges 1, 2, ...
growing by `ratio`: the n-gram is inserted with each of 1 .. q. A reader probes 1, 2, ... until one is
missing. Numerators take the lower edge of a level and bigram histories the upper edge, so the
probabilities given a history sum to at most one, up to the filter's false positives. A history that
reads as none leaves the distribution below it as it is. Words and the end token keep exact counts.

The filter takes some 1.5 bytes for each different n-gram, so it grows with the corpus and cannot be
broadcast within a bound. It is cut by hash into segments instead, and n-grams go to their segment:
texts are packed into pieces; a piece sends each segment its different n-grams once, with how often its
training rows hold them; a segment is filled by the sums and then probed for each piece; the levels go back
to the piece, one byte for each n-gram before compression. So texts are read once whatever the size of the
filter, every n-gram counts, and each task holds one piece or one segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.bitsets import positions, steps
from lexiloom.llm.words import Words, batches, combine, mix, release

END, BEGIN = np.uint64(0x656E645F746F6B65), np.uint64(0x626567696E5F746F)
GRAMS = (1, 2, 3)


def edges(ratio: float) -> np.ndarray:
    """Lower edges of the levels 1, 2, ...; entry 0 is level 0's."""
    out = [0, 1]
    while out[-1] < 1 << 50:
        out.append(max(out[-1] + 1, int(np.ceil(out[-1] * ratio))))
    return np.array(out, np.int64)


def sequences(token: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens with ends, row boundaries, places in the rows, bigram keys, trigram keys (of use from place 1 on)."""
    seq, to = np.insert(token, at[1:], END), at + np.arange(len(at))
    place = np.arange(len(seq)) - np.repeat(to[:-1], np.diff(to))
    before = np.empty_like(seq)
    before[1:], before[place == 0] = seq[:-1], BEGIN
    two = combine(before, seq)
    three = np.zeros_like(two)
    three[1:] = combine(two[:-1], seq[1:])
    return seq, to, place, two, three


class Segment:
    """A part of the log-frequency filter: levels of its n-grams, held as bits alone."""

    def __init__(self, key: np.ndarray, level: np.ndarray, hashes: int) -> None:
        self.hashes = hashes
        inserts = int(level.sum())
        self.bits = 1 << max(6, int(np.ceil(np.log2(max(1, inserts) * hashes * 1.4427))))
        held = np.zeros(self.bits, bool)
        for q in range(1, int(level.max(initial=0)) + 1):
            named = self._named(key[level >= q], q)
            step = steps(named)
            for i in range(hashes):
                held[positions(named, step, i, self.bits).view(np.int64)] = True
        self.data = np.packbits(held, bitorder="little")

    @staticmethod
    def _named(key: np.ndarray, level: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(key + np.uint64(level) * np.uint64(0xD6E8FEB86659FD93))

    def _has(self, key: np.ndarray) -> np.ndarray:
        alive, step = np.arange(len(key)), steps(key)
        for i in range(self.hashes):  # a key that has missed a bit is not probed again
            at = positions(key, step, i, self.bits)
            hit = (self.data[(at >> np.uint64(3)).view(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            alive, key, step = alive[hit], key[hit], step[hit]
        return alive

    def levels(self, key: np.ndarray) -> np.ndarray:
        """The level of each key, by probes of 1, 2, ... up to the first that is missing."""
        out, alive, now = np.zeros(len(key), np.uint8), np.arange(len(key)), 1
        while len(alive):
            alive = alive[self._has(self._named(key[alive], now))]
            out[alive] = now
            now += 1
        return out


def squeeze(key: np.ndarray) -> bytes:
    """Sorted 64-bit keys as the planes of their gaps' bytes, compressed."""
    gap = np.diff(key, prepend=np.uint64(0))
    return pa.compress(np.ascontiguousarray(gap.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True) if len(key) else b""


def unsqueeze(data, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(pa.decompress(data, decompressed_size=8 * int(n), codec="zstd"), np.uint8).reshape(8, int(n))
    with np.errstate(over="ignore"):
        return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1), dtype=np.uint64)


def _small(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), codec="zstd", asbytes=True) if len(x) else b""


def _unsmall(data, n: int, kind) -> np.ndarray:
    return np.frombuffer(
        pa.decompress(data, decompressed_size=int(n) * np.dtype(kind).itemsize, codec="zstd"), kind
    ) if n else np.zeros(0, kind)


def _packed(docs: DataFrame, piece_bytes: int) -> DataFrame:
    """Rows (id, text, train) packed into pieces: (piece, payload), the piece named by its content."""

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            whole = pa.Table.from_batches(held).combine_chunks()
            with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
                to.write_table(whole)
            data = sink.getvalue().to_pybytes()
            return pa.RecordBatch.from_arrays(
                [pa.array([xxhash.xxh128_digest(data)], pa.binary()), pa.array([data], pa.binary())], names=["piece", "payload"]
            )

        for whole in parts:
            for part in batches(whole, piece_bytes // 4):
                held.append(part)
                size += part.nbytes
                if size >= piece_bytes:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return docs.mapInArrow(pack, "piece binary, payload binary")


def _keys(words: Words, payload) -> tuple:
    """A piece's rows and n-grams: (rows, token sequence parts, keys by order)."""
    with pa.ipc.open_stream(payload) as got:
        rows = got.read_all().combine_chunks()
    text = rows.column(1).combine_chunks()
    seq, to, place, two, three = sequences(*words.tokens(text))
    three[place == 0] = two[place == 0]
    return rows, to, place, [seq, two, three]


def lm_score(
    docs: DataFrame, train: Column, id_: str = "doc_id", text: str = "text", ratio: float = 1.5, hashes: int = 8, m2: float = 20_000.0,
    m3: float = 200.0, piece_bytes: int = 12 << 20, segment_bytes: int = 1 << 22,
) -> DataFrame:
    """A row for each row of docs: id_, n_tokens, n_known, train_tokens, base_score, score; sums of log10 probabilities.

    train: which rows the model learns from (null: not). Null text is empty: one end token. Repeated
    rows count each time. No training text at all: N = V = 0, and every token has probability 1.
    Null ids keep their rows. Other columns are left out, whatever their names. piece_bytes: text in a
    piece, more only for a longer text; segment_bytes: text for each segment of the filter. Both bound a task's memory.
    """
    picked = docs.select(
        F.col(id_).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        F.coalesce(train, F.lit(False)).alias("train"),
    )
    size = picked.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    segments = 1 + size // segment_bytes
    cuts = np.array([(b << 64) // segments for b in range(1, segments)], np.uint64)
    lower = edges(ratio)
    fields = ", ".join(f"n{g} int, k{g} binary, c{g} binary" for g in GRAMS)

    def ask(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for part in parts:
            for piece, payload in zip(part.column(0), part.column(1), strict=True):
                rows, to, _, keys = _keys(words, payload.as_buffer())
                taught = np.repeat(np.asarray(rows.column(2)), np.diff(to))
                columns = {
                    "segment": pa.array(np.arange(segments, dtype=np.int32)), "piece": pa.array([piece.as_py()] * segments, pa.binary())
                }
                for g in GRAMS:
                    key = keys.pop(0)  # so that it is let go
                    order = np.argsort(key)
                    key = key[order]
                    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                    count = np.add.reduceat(taught[order], first, dtype=np.uint32)
                    key = key[first]
                    at = np.concatenate([[0], np.searchsorted(key, cuts), [len(key)]])
                    columns[f"n{g}"] = pa.array(np.diff(at).astype(np.int32))
                    columns[f"k{g}"] = pa.array([squeeze(key[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
                    columns[f"c{g}"] = pa.array([_small(count[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
                release()
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    def answer(asked: pa.Table) -> pa.Table:
        columns = {"segment": asked.column("segment"), "piece": asked.column("piece")}
        for g in GRAMS:
            sizes = asked.column(f"n{g}").to_numpy()
            key = np.concatenate([unsqueeze(x.as_buffer(), n) for x, n in zip(asked.column(f"k{g}"), sizes, strict=True)])
            count = np.concatenate([_unsmall(x.as_buffer(), n, np.uint32) for x, n in zip(asked.column(f"c{g}"), sizes, strict=True)])
            order = np.argsort(key)
            fresh = np.ones(len(key), bool)
            fresh[1:] = key[order[1:]] != key[order[:-1]]
            first = np.flatnonzero(fresh)
            total = np.add.reduceat(count[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
            if g == 1:  # words keep exact counts
                columns["tokens"], columns["known"] = (pa.array(np.full(len(sizes), x, np.int64)) for x in (total.sum(), (total > 0).sum()))
                found = total
            else:
                key = key[order[first]]
                found = Segment(key, np.searchsorted(lower, total, side="right") - 1, hashes).levels(key)
            back = np.empty(len(order), found.dtype)
            back[order] = found[np.cumsum(fresh) - 1] if len(order) else found
            at = np.concatenate([[0], np.cumsum(sizes)])
            columns[f"n{g}"] = pa.array(sizes)
            columns[f"a{g}"] = pa.array([_small(back[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
        release()
        return pa.table(columns)

    def score(packed: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("segment")
        name = answers.column("segment").to_numpy()
        once = np.flatnonzero(np.diff(name, prepend=-1))  # pieces of equal content have equal answers
        if len(once) != segments:
            raise RuntimeError("a piece of text has lost its answers")
        n, v = (int(answers.column(c).to_numpy()[once].sum()) for c in ("tokens", "known"))
        held = []
        for g, kind in zip(GRAMS, (np.int64, np.uint8, np.uint8), strict=True):
            data, sizes = answers.column(f"a{g}"), answers.column(f"n{g}").to_numpy()
            held.append(np.concatenate([_unsmall(data[int(i)].as_buffer(), int(sizes[i]), kind) for i in once]))
        rows, to, place, keys = _keys(Words(), packed.column("payload")[0].as_buffer())
        c, l2, l3 = (held.pop(0)[np.unique(keys.pop(0), return_inverse=True)[1]] for _ in GRAMS)
        starts = place == 0
        h1 = np.concatenate([c[-1:], c[:-1]])
        h1[starts] = c[-1]  # a text begins after an end
        upper = np.where(l2 > 0, lower[l2 + 1] - 1, 0)
        h2 = np.where(starts, 0, np.concatenate([upper[-1:], upper[:-1]]))
        p = (c + 0.5) / (n + 0.5 * (v + 1))
        q = (np.minimum(lower[l2], h1) + m2 * p) / (h1 + m2)
        c3 = np.minimum(np.minimum(lower[l3], h2), upper)
        q = np.where(h2 > 0, (c3 + m3 * q) / (h2 + m3), q)
        sums = [np.add.reduceat(x, to[:-1]) for x in ((c > 0).astype(np.int64), np.log10(p), np.log10(q))]
        out = pa.table(
            {
                "id": rows.column(0), "n_tokens": np.diff(to), "n_known": sums[0], "train_tokens": np.full(len(to) - 1, n),
                "base_score": sums[1], "score": sums[2],
            }
        )
        release()
        return pa.concat_tables([out] * packed.num_rows)

    packed = _packed(picked, piece_bytes).repartition("piece")  # texts move once: both readers take this exchange
    answers = packed.mapInArrow(ask, f"segment int, piece binary, {fields}").groupBy("segment")
    answers = answers.applyInArrow(
        answer, "segment int, piece binary, tokens long, known long, " + ", ".join(f"n{g} int, a{g} binary" for g in GRAMS)
    )
    id_type = picked.schema["id"].dataType.simpleString()
    scored = packed.groupBy("piece").cogroup(answers.groupBy("piece"))
    scored = scored.applyInArrow(score, f"id {id_type}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumnRenamed("id", id_)

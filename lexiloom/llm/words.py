"""Words and shingles of Arrow text columns as 64-bit hashes, whole batches at a time.

A word is a maximal run of bytes other than \\x20 and \\x09-\\x0D, with A-Z lower-cased. UTF-8
keeps those bytes for ASCII alone, so the work is done on bytes and no text is decoded. A word's
hash is a polynomial in its bytes mod 2^64, mixed; with V different words the chance that any two
share a hash is about V^2 / 2^65.
"""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all hang on all input bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX1
        x = (x ^ (x >> np.uint64(27))) * _MIX2
        return x ^ (x >> np.uint64(31))


def combine(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a sequence of which left is the hash so far."""
    with np.errstate(over="ignore"):
        return mix(left * _STEP + right + np.uint64(1))


def _space() -> np.ndarray:
    out = np.zeros(256, bool)
    out[[0x20, *range(0x09, 0x0E)]] = True
    return out


def _letters() -> np.ndarray:
    out = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
    out[65:91] = out[97:123]
    return out


class Words:
    """The tables for hashing; made once a task."""

    def __init__(self) -> None:
        self.space, self.letter = _space(), _letters()
        self.grow(_BLOCK)

    def grow(self, size: int) -> None:
        back = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64))]) for b in (_BASE, back))

    def _hash(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, cuts: tuple[int, ...]) -> list[np.ndarray]:
        if len(data) >= len(self.up):
            self.grow(len(data))
        with np.errstate(over="ignore"):
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(self.letter[data] * self.up[: len(data)], out=sums[1:])
            ends = [end, *(np.minimum(end, start + k) for k in cuts)]
            return [mix((sums[e] - sums[start]) * self.down[start] + (e - start).astype(np.uint64) * _STEP) for e in ends]

    def tokens(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words of a column in order, and where each row's begin (one more entry than rows). Null: no words."""
        (out,), at = self.beginnings(text, ())
        return out, at

    def beginnings(self, text: pa.Array, cuts: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray]:
        """As tokens(), with the hashes of each word's first k bytes for each k of cuts besides."""
        data, at = text_bytes(text)
        n = len(data)
        if not n:
            return [np.zeros(0, np.uint64)] * (1 + len(cuts)), np.zeros(len(at), np.int64)
        word = ~self.space[data]
        first = np.zeros(n, bool)
        first[at[:-1][at[:-1] < n]] = True
        before = np.zeros(n, bool)
        before[1:] = word[:-1]
        begins = word & (~before | first)
        after = np.ones(n, bool)
        after[:-1] = ~word[1:] | first[1:]
        start, end = np.flatnonzero(begins), np.flatnonzero(word & after) + 1
        out, done = [np.empty(len(start), np.uint64) for _ in range(1 + len(cuts))], 0
        while done < len(start):  # blocks end between words, so memory follows the block and not the batch
            low = start[done]
            upto = max(done + 1, int(np.searchsorted(end, low + _BLOCK, side="right")))
            for to, x in zip(out, self._hash(data[low : end[upto - 1]], start[done:upto] - low, end[done:upto] - low, cuts), strict=True):
                to[done:upto] = x
            done = upto
        return out, np.searchsorted(start, at)

    def shingles(self, text: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all shingles in order with repeats, and where each row's begin. A row of fewer words has its whole sequence as one."""
        token, at = self.tokens(text)
        return shingle(token, at, width)


def text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and row boundaries; nulls are empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if text.null_count:
        text = text.fill_null("")
    wide = pa.types.is_large_string(text.type)
    _, offsets, data = text.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[
        text.offset : text.offset + len(text) + 1
    ].astype(np.int64) if offsets is not None else np.zeros(1, np.int64)
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def shingle(token: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    count = np.diff(at)
    made = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    to = np.concatenate([[0], np.cumsum(made)])
    out = np.empty(to[-1], np.uint64)
    if len(token) >= width:
        whole = token[: len(token) - width + 1].copy()
        for k in range(1, width):
            whole = combine(whole, token[k : len(token) - width + 1 + k])
        row = np.repeat(np.arange(len(count)), np.where(count >= width, made, 0))
        inside = np.arange(len(row)) - np.repeat(
            (np.cumsum(np.where(count >= width, made, 0)) - np.where(count >= width, made, 0))[count >= width], made[count >= width]
        )
        out[to[row] + inside] = whole[at[row] + inside]
    for r in np.flatnonzero((count > 0) & (count < width)):
        h = token[at[r] : at[r] + 1]
        for k in range(1, count[r]):
            h = combine(h, token[at[r] + k : at[r] + k + 1])
        out[to[r]] = mix(h ^ np.uint64(count[r]))[0]
    return out, to


def batches(batch: pa.RecordBatch, most: int = 1 << 23):
    """Slices of a batch of about `most` bytes each, whole rows."""
    size = max(1, batch.nbytes // max(1, batch.num_rows))
    step = max(1, most // size)
    for low in range(0, batch.num_rows, step):
        yield batch.slice(low, step)


def release() -> None:
    """Give freed memory back to the system; between pieces of a task's work, so that a worker holds one piece."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)

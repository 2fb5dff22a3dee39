"""Bloom filters built across the cluster: the hash space is cut into segments, and each segment's bits are set in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.words import mix, release

SEGMENTS = 64


class Bits:
    """SEGMENTS bit arrays of one size, a power of two. A key's top six bits choose the segment."""

    def __init__(self, segment_bits: int, hashes: int) -> None:
        self.segment_bits, self.hashes = segment_bits, hashes
        self.data = np.zeros(SEGMENTS * segment_bits // 8, np.uint8)

    def fill(self, segment: int, bits: bytes) -> None:
        size = self.segment_bits // 8
        self.data[segment * size : (segment + 1) * size] = np.frombuffer(bits, np.uint8)

    def has(self, key: np.ndarray) -> np.ndarray:
        alive, step = np.arange(len(key)), None
        for i in range(self.hashes):  # a key that has missed a bit is not probed again
            at = (key >> np.uint64(58)) * np.uint64(self.segment_bits) + positions(key, step, i, self.segment_bits)
            hit = (self.data[(at >> np.uint64(3)).view(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            alive, key = alive[hit], key[hit]
            step = steps(key) if step is None else step[hit]
        return alive


def steps(key: np.ndarray) -> np.ndarray:
    return mix(key ^ np.uint64(0xA5A5A5A5A5A5A5A5)) | np.uint64(1)


def positions(key: np.ndarray, step: np.ndarray | None, i: int, segment_bits: int) -> np.ndarray:
    """The place of a key's i-th bit in its segment; step is of no use for the first."""
    with np.errstate(over="ignore"):
        return (key if not i else key + np.uint64(i) * step) & np.uint64(segment_bits - 1)


def segment_bits_for(inserts: int, hashes: int, most_bits: int) -> int:
    """Bits of a segment: a power of two that leaves filters at most half full, within most_bits overall."""
    need = max(1, inserts) * hashes * 1.4427 / SEGMENTS
    return int(min(1 << max(6, int(np.ceil(np.log2(need)))), most_bits // SEGMENTS))


def build(keys: DataFrame, column: str, segment_bits: int, hashes: int, expand=None) -> Bits:
    """The filter of a column of 64-bit keys. expand: from the rows of a batch to more keys (numpy), else the column itself.

    Keys are shuffled once, as longs; the driver gets the filter alone, whose size the caller bounds.
    """

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segment, bits = None, None
        for frame in frames:
            segment = int(frame["__segment"].iloc[0]) if segment is None else segment
            bits = np.zeros(segment_bits, bool) if bits is None else bits
            key = expand(frame) if expand else frame[column].to_numpy(np.int64).view(np.uint64)
            step = steps(key)
            for i in range(hashes):
                bits[positions(key, step, i, segment_bits).view(np.int64)] = True
        if bits is not None:
            yield pd.DataFrame({"segment": [segment], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    dealt = keys.where(F.col(column).isNotNull()).withColumn("__segment", F.shiftrightunsigned(F.col(column), 58).cast("int"))
    out = Bits(segment_bits, hashes)
    for batch in dealt.groupBy("__segment").applyInPandas(_whole(fill), "segment int, bits binary").toArrow().to_batches():
        for segment, bits in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            out.fill(segment, bits.as_buffer())
    return out


def _whole(fill):
    """applyInPandas hands over one frame a group; fill takes pieces, so its temporaries stay small."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        release()
        pieces = (frame.iloc[i : i + 250_000] for i in range(0, len(frame), 250_000))
        return pd.concat(list(fill(pieces)))

    return run

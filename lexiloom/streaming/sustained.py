"""Commitment metrics over a stream of turns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "conv long, speaker string, t_private long, t_public long, commitment_gap long"
STATE = "last_low long, first_high long, t_public long"
NONE = -1


def commitments_stream(turns: DataFrame, threshold: float = 0.7) -> DataFrame:
    """turns (conv, speaker, turn, score, accused) as a stream to updates of (conv, speaker, t_private, t_public, commitment_gap).

    A speaker's state is three numbers: the last low turn, the first high one after it, the first accusation. A low score
    takes an earlier t_private back, so results are updates. Turns of one speaker are taken in order within a batch
    and must not come out of order across batches.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        low, high, public = state.get if state.exists else (NONE, NONE, NONE)
        for frame in [pd.concat(list(frames)).sort_values("turn")]:
            for turn, score, accused in zip(frame["turn"], frame["score"], frame["accused"], strict=True):
                if score >= threshold:
                    high = int(turn) if high == NONE else high
                else:
                    low, high = int(turn), NONE
                if accused and public == NONE:
                    public = int(turn)
        state.update((low, high, public))
        some = lambda v: None if v == NONE else v
        gap = public - high if NONE not in (public, high) else None
        yield pd.DataFrame(
            {
                "conv": [key[0]], "speaker": [key[1]], "t_private": pd.array([some(high)], "Int64"),
                "t_public": pd.array([some(public)], "Int64"), "commitment_gap": pd.array([gap], "Int64"),
            }
        )

    return turns.groupBy("conv", "speaker").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.NoTimeout)

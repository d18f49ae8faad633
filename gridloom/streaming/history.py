"""Undo and redo over a stream of edits: a state for each board, kept between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.history import MOST, State

_OUT = "board long, version long, shown long, undoable int, redoable int"


def boards_now(stream: DataFrame, order: str, most: int = MOST) -> DataFrame:
    """What ``operators.history.replay`` gives, event by event, for a stream of (board, version, op, ``order``); write in append mode.

    Within a micro-batch events go by (``order``, version, op); one that arrives in a later batch counts as later. Boards and edits without
    a number aren't allowed here: a missing one stops the stream.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        shown, past, future = kept.get if kept.exists else (None, [], [])
        state, rows = State(shown, tuple(past), tuple(future)), []
        for r in pd.concat(parts).sort_values([order, "version", "op"]).itertuples(index=False):
            state = state.after(r.op, int(r.version), most)
            rows.append((key[0], int(r.version), state.shown, len(state.past), len(state.future)))
        kept.update((state.shown, list(state.past), list(state.future)))
        out = pd.DataFrame(rows, columns=["board", "version", "shown", "undoable", "redoable"])
        yield out.astype({"shown": "Int64"})

    return stream.groupBy("board").applyInPandasWithState(step, _OUT, "shown long, past array<long>, future array<long>", "append", GroupStateTimeout.NoTimeout)

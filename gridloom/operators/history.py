"""Undo and redo as a fold of an event log: one state a board, the same step in a batch and in a stream."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Versions that can be undone; an edit beyond them forgets the oldest.
MOST = 40


class State(NamedTuple):
    """What a board shows (None: the blank start), what undo goes back to, and what redo goes forward to, newest last."""

    shown: int | None = None
    past: tuple = ()
    future: tuple = ()

    def after(self, op: str | None, version: int | None, most: int = MOST) -> State:
        """The state after an edit to ``version``, an undo or a redo. A step that has nowhere to go, and any other word, change nothing."""
        if op == "edit":
            return State(version, (*self.past, self.shown)[-most:], ())
        if op == "undo" and self.past:
            return State(self.past[-1], self.past[:-1], (*self.future, self.shown))
        if op == "redo" and self.future:
            return State(self.future[-1], (*self.past, self.shown), self.future[:-1])
        return self


def replay(events: DataFrame, order: list[str], most: int = MOST) -> DataFrame:
    """(board, version, shown, undoable, redoable): an event's version, and its board's state after it.

    ``events`` has board, version (whole numbers), op and the ``order`` columns; other columns are ignored. A board's events follow each other,
    so they stream through one task in order; the task holds one state of at most 2 * ``most`` versions, however long the log. Events without
    a board are one board's; equal orders go by version and op; an edit without a version shows null; an empty table gives no rows.
    """
    rows = events.select(F.col("board").cast("long").alias("board"), F.col("version").cast("long").alias("version"), "op", *[F.col(c).alias(f"_{c}") for c in order])
    rows = rows.repartition("board").sortWithinPartitions("board", *[f"_{c}" for c in order], "version", "op").select("board", "version", "op")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), State()
        for b in batches:
            shown, undoable, redoable = [], [], []
            for board, version, op in zip(*(b.column(c).to_pylist() for c in ("board", "version", "op")), strict=True):
                if board != last:
                    last, state = board, State()
                state = state.after(op, version, most)
                shown.append(state.shown)
                undoable.append(len(state.past))
                redoable.append(len(state.future))
            columns = [b.column("board"), b.column("version"), pa.array(shown, pa.int64()), pa.array(undoable, pa.int32()), pa.array(redoable, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["board", "version", "shown", "undoable", "redoable"])

    return rows.mapInArrow(step, "board long, version long, shown long, undoable int, redoable int")

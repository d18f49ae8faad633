"""Best-fit-decreasing packing of token pieces into sequences, planned on the counts of piece lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, appended, gapless, with_counts
from .tokens import encoder

CAPACITY, END_ID = 1024, 2


class CapacityTree:
    """A segment tree over remaining capacities 0..size: which of them have an open bin. All steps are logarithmic."""

    def __init__(self, size: int):
        self.leaves = 1 << max(1, size).bit_length()
        self.any = np.zeros(2 * self.leaves, bool)

    def set(self, room: int, open_: bool) -> None:
        i = room + self.leaves
        self.any[i] = open_
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest remaining capacity of at least ``least`` that has an open bin."""
        i = least + self.leaves
        if self.any[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over ``counts`` (length -> number of pieces) as runs (length, first, end, bin, per_bin, offset).

    Pieces first..end-1 of a length go to bins from ``bin`` on, ``per_bin`` each, the first at ``offset``. Equal pieces
    and equally full bins are interchangeable, so a whole run takes one step of the tree, and the plan has a bounded
    number of runs for any number of pieces. The placement is that of best fit decreasing piece by piece: a piece
    goes to the tightest open bin that has room, so one bin is filled up with a length before the next is opened.
    """
    tree, rooms, runs, bins = CapacityTree(capacity), {}, [], 0

    def put(room: int, first_bin: int, n: int) -> None:
        if n and room:
            rooms.setdefault(room, []).append((first_bin, n))
            tree.set(room, True)

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} doesn't fit")
        at, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first_bin = capacity, bins
                n = -(-left // (capacity // length))
                bins += n
            else:
                first_bin, n = rooms[room].pop(0)
                if not rooms[room]:
                    tree.set(room, False)
            each = room // length
            full = min(n, left // each)
            if full:
                runs.append((length, at, at + full * each, first_bin, each, capacity - room))
                at, left = at + full * each, left - full * each
                put(room - each * length, first_bin, full)
            if left and full < n:
                runs.append((length, at, at + left, first_bin + full, left, capacity - room))
                put(room - left * length, first_bin + full, 1)
                at, left, full = at + left, 0, full + 1
            put(room, first_bin + full, n - full)
    return runs


def token_pieces(df: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each piece: ids of the whole text, the end id, cut from the back in pieces of ``capacity``."""

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            rows, found = [], []
            for k, text in enumerate(b.column("text").to_pylist()):
                ids = np.append(enc.ids(text or ""), np.uint32(END_ID)).astype("<u4")
                first = len(ids) % capacity or min(capacity, len(ids))
                start = 0
                for piece, end in enumerate(range(first, len(ids) + 1, capacity)):
                    rows.append(k)
                    found.append((piece, start, end - start, zlib.crc32(ids[start:end].tobytes())))
                    start = end
            table = np.array(found, np.int64).reshape(-1, 4).T
            columns = [b.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(table[0].astype(np.int32)), *map(pa.array, table[1:])]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    source = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(df: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, scratch: Scratch | None = None) -> DataFrame:
    """A row per piece of each row of ``df`` (doc_id, text), with sequence_id and offset.

    Pieces are counted by length (at most ``capacity`` counts, the only figures that reach the driver), the plan is made
    on the counts, and each piece finds its run by its number within its length. Full pieces fill a sequence alone. A
    null text is an empty one and gives the end id alone; a null doc_id stays null; repeated rows are packed each;
    extra columns are ignored; an empty table gives no rows.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    scratch = scratch or Scratch(df.sparkSession, "packing")
    written = scratch.table(with_counts(token_pieces(df, vocabulary, capacity), "length"), "pieces")
    counts = {r.length: r.n for r in written.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = np.array(plan_bins(counts, capacity), np.int64).reshape(-1, 6)
    numbered = gapless(written, "length", "number")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((runs[:, 1], runs[:, 0]))
        plan = runs[order]
        # Runs of a length are consecutive from number 0: one search over (length, number) finds a piece's run.
        top = int(plan[:, 2].max()) + 1 if len(plan) else 1
        starts = plan[:, 0] * top + plan[:, 1]
        for b in batches:
            length, number = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "number"))
            r = plan[np.searchsorted(starts, length * top + number, side="right") - 1]
            k = number - r[:, 1]
            yield appended(b.drop_columns(["number"]), sequence_id=r[:, 3] + k // r[:, 4], offset=r[:, 5] + k % r[:, 4] * length)

    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number").mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def op2_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))

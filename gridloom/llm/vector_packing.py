"""Vector bin packing: the dot-product heuristic fills sequences under limits on tokens, segments and loss-bearing tokens."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, appended, gapless, with_counts
from .tokens import encoder

#: Limits of a sequence: tokens, segments, loss-bearing tokens.
TOKENS, SEGMENTS, LOSS = 1024, 32, 1024
END_ID = 0
#: Loss-bearing tokens are rounded up to a multiple of this when sequences are planned, so that kinds of examples stay bounded in number.
LOSS_STEP = 64


def plan_vectors(demand: np.ndarray, counts: np.ndarray, limits: tuple[int, ...]) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (kind, first, end, bin, per_bin, offset) for ``counts[k]`` examples of each kind with the demands ``demand[k]``.

    One sequence is filled at a time. Of the examples that still fit in every dimension it takes the one whose demands
    have the largest dot product with the room that is left, each dimension weighted by its mean demand and
    both sides measured in parts of the limit; ties go to the first kind. Examples of a kind are interchangeable, so a filled
    sequence is a pattern that repeats for as long as the counts bear it: the same choices would be made again. Each pattern leaves
    some kind with fewer examples than it takes of it, hence the number of runs follows the kinds, not the examples.
    Numbers first..end-1 of a kind lie in sequences from ``bin`` on, ``per_bin`` each, side by side from ``offset``.
    """
    demand, most = np.asarray(demand, np.int64).reshape(-1, len(limits)), np.array(limits, np.int64)
    left, at = np.array(counts, np.int64), np.zeros(len(counts), np.int64)
    if (demand > most).any() or (demand[:, 0] < 1).any():
        raise ValueError("an example is empty or over a limit")
    share = demand / most
    worth = share * (share * left[:, None]).sum(axis=0) / max(1, left.sum())
    runs, bins = [], 0
    while len(live := np.flatnonzero(left)):
        size, value, rest = demand[live], worth[live], left[live]
        room, taken = most.copy(), {}
        while (fits := (rest > 0) & (size <= room).all(axis=1)).any():
            best = int(np.argmax(np.where(fits, value @ (room / most), -1.0)))
            taken[best] = taken.get(best, 0) + 1
            rest[best] -= 1
            room -= size[best]
        repeats, offset = min(int(left[live[k]]) // n for k, n in taken.items()), 0
        for k, n in taken.items():
            kind = int(live[k])
            runs.append((kind, int(at[kind]), int(at[kind]) + repeats * n, bins, n, offset))
            at[kind] += repeats * n
            left[kind] -= repeats * n
            offset += n * int(demand[kind, 0])
        bins += repeats
    return runs


def pack_vectors(df: DataFrame, limits: tuple[int, int, int] = (TOKENS, SEGMENTS, LOSS), scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``df``, each an example with ``tokens`` and ``loss`` (how many of these bear loss), with sequence_id and offset.

    Each example is one segment and stays whole. Only counts by (tokens, loss in steps of LOSS_STEP) reach the driver: at most
    limits[0] * (limits[2] / LOSS_STEP + 1) figures. An example finds its place by its number within its kind, which no task needs to
    gather. A null or negative loss counts as none; null or no tokens, or more than a limit, are an error; repeated rows are packed
    each; other columns stay, whatever their names, but for a sequence_id or offset, which are replaced; an empty table gives no rows.
    """
    scratch = scratch or Scratch(df.sparkSession, "vector-packing")
    tokens, loss = F.col("row.tokens").cast("long"), F.greatest(F.coalesce(F.col("row.loss").cast("long"), F.lit(0)), F.lit(0))
    steps = -(-limits[2] // LOSS_STEP) + 1
    bad = tokens.isNull() | (tokens < 1) | (tokens > limits[0]) | (loss > limits[2])
    kind = F.when(bad, F.raise_error(F.lit("an example is empty or over a limit")).cast("long")).otherwise(tokens * steps + F.ceil(loss / LOSS_STEP))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")).select("row", tokens.alias("tokens"), kind.alias("kind"))
    written = scratch.table(with_counts(rows, "kind"), "examples")
    counts = {r.kind: r.n for r in written.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    kinds = np.array(sorted(counts, reverse=True), np.int64)
    demand = np.stack([kinds // steps, np.ones_like(kinds), np.minimum(kinds % steps * LOSS_STEP, limits[2])], axis=1)
    runs = np.array(plan_vectors(demand, np.array([counts[k] for k in kinds.tolist()], np.int64), limits), np.int64).reshape(-1, 6)
    runs[:, 0] = kinds[runs[:, 0]]
    plan = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    top = int(plan[:, 2].max()) + 1 if len(plan) else 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = plan[:, 0] * top + plan[:, 1]  # runs of a kind follow each other from number 0
        for b in batches:
            length, kind, number = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("tokens", "kind", "number"))
            r = plan[np.searchsorted(starts, kind * top + number, side="right") - 1]
            k = number - r[:, 1]
            yield appended(b.select(["row"]), sequence_id=r[:, 3] + k // r[:, 4], offset=r[:, 5] + k % r[:, 4] * length)

    numbered = gapless(written, "kind", "number").select("row", "tokens", "kind", "number")
    packed = numbered.mapInArrow(place, T.StructType([rows.schema["row"], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    kept = [F.col(f"row.`{c}`") for c in df.columns if c not in ("sequence_id", "offset")]
    return packed.select(*kept, "sequence_id", "offset")


def document_pieces(df: DataFrame, vocabulary: str, capacity: int = TOKENS) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): each document's ids and the end id, cut into pieces of ``capacity`` and a last shorter one."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            rows, found = [], []
            for k, text in enumerate(b.column("text")):
                ids = np.append(enc.ids(text.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    rows.append(k)
                    found.append((start, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
            table = np.array(found, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows, pa.int64())), *map(pa.array, table)], names=names)

    source = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(cut, ", ".join(f"{n} long" for n in names))


def pack_pieces(df: DataFrame, vocabulary: str | None = None, limits: tuple[int, int, int] = (TOKENS, SEGMENTS, LOSS)) -> DataFrame:
    """A row per piece of each row of ``df`` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Only documents over limits[0] tokens are cut. In plain documents all tokens bear loss but a piece's first, which nothing predicts.
    A null text is an empty one and gives the end id alone; a null doc_id stays null; repeated rows are packed each; extra
    columns are ignored; an empty table gives no rows.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    pieces = document_pieces(df, vocabulary, limits[0])
    packed = pack_vectors(pieces.withColumnRenamed("length", "tokens").withColumn("loss", F.col("tokens") - 1), limits)
    return packed.select("doc_id", "start", F.col("tokens").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op11_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"))

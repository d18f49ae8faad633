"""Removal of byte strings that repeat across documents, decided on a column-wise Burrows-Wheeler transform.

Windows of ``MATCH`` bytes are compared through anchors: a window's anchor is its first position with the least 16-byte hash.
Equal windows have equal anchors at the same offset, so each window needs to meet others at its own anchor only:

1. Documents are dealt into blocks by doc_id; a block is written once, as compressed Arrow rows, and read from there afterwards.
2. A block sends each of its anchors once (hash of the anchor and of the two 33-byte strings around it, one of which
   every window at the anchor contains) to buckets by anchor hash; a string that no window of the anchor contains is left
   out. A bucket marks which 33-byte surroundings lie in more than one document, and the anchors that are hot: with more
   than HOT surroundings.
3. Blocks cut the segment of an anchor's windows around a marked string, and send each distinct segment once with its least doc_id;
   the windows of hot anchors go one by one, each to the bucket of its own hash, so that no anchor is bound to one task.
4. A bucket builds the transform of its distinct segments; runs of suffixes that share MATCH bytes are equal windows, and
   the least doc_id of a run is the document that keeps the string. Each block gets its windows' verdicts back.
5. Blocks remove what the windows of smaller documents cover.

Hashes only narrow the search and can't lose a match or make one; the transform compares the bytes. A string that
millions of documents share counts once per block at every step.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .bwt import Collection, least_owner
from .common import Scratch, lean

MATCH, GRAM = 50, 16
WINDOWS = MATCH - GRAM + 1  # windows at an anchor: starts from 34 bytes before it up to it
HALF = WINDOWS // 2
SIDE = GRAM + HALF
#: Bytes of text in a block at least and at most, buckets at most, strings in one transform at most (one anchor's stay together).
BLOCK_BYTES, MOST_BYTES, BUCKETS, COLLECTION = 4_000_000, 64_000_000, 1 << 18, 8192
#: Bytes of text that are searched for anchors at a time.
CHUNK_BYTES = 1_000_000
#: Distinct surroundings, over all blocks, from which an anchor's windows are dealt out one by one.
HOT = 20_000
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
_SHIFT = np.uint64(32)


def _slide(x: np.ndarray, n: int, op: Callable) -> np.ndarray:
    """op over each ``n`` neighbours, by doubling."""
    width = 1
    while 2 * width <= n:
        x = op(x[:-width], x[width:])
        width *= 2
    rest = n - width
    return op(x[: len(x) - rest], x[rest:]) if rest else x


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _C[2]
    return h ^ (h >> _SHIFT)


def _windows_inside(starts: np.ndarray, size: int) -> np.ndarray:
    """Which window starts lie in one text; starts: offsets of the texts in the buffer, and its end."""
    ok = np.ones(size, bool)
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        ok[max(a, b - MATCH + 1) : b] = False
    return ok[: size - MATCH + 1]


def _anchors(buffer: bytes, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(position, text, anchor hash, left hash, right hash, before, after) of each anchor in texts that lie end to end.

    The anchor's windows start from ``before`` bytes ahead of it up to ``after`` bytes ahead; a side's hash is 0 if none of them contains it.
    """
    size = len(buffer)
    at_windows = np.flatnonzero(_windows_inside(starts, size)) if size >= MATCH else np.zeros(0, np.int64)
    if not len(at_windows):
        none = np.zeros(0, np.int64)
        return none, none, *[np.zeros(0, np.uint32)] * 3, *[np.zeros(0, np.uint8)] * 2
    words = np.ndarray((size + 1,), "<u8", buffer + b"\0" * 8, 0, (1,))
    gram = _mix(words[: size - GRAM + 1] * _C[0] ^ words[8 : size - GRAM + 9] * _C[1]) >> _SHIFT
    low = _slide(gram << _SHIFT | np.arange(len(gram), dtype=np.uint64), WINDOWS, np.minimum)
    place = (low[at_windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # A text's windows keep or raise their anchor's place from one to the next.
    turn = np.flatnonzero(place[1:] != place[:-1])
    first, last = at_windows[np.r_[0, turn + 1]], at_windows[np.r_[turn, len(place) - 1]]
    at = place[np.r_[0, turn + 1]]
    text = np.searchsorted(starts, at, side="right") - 1

    def side(start: np.ndarray, ok: np.ndarray) -> np.ndarray:
        f = np.where(ok, start, 0)
        h = sum((words[f + k] * c for k, c in zip((0, 8, 16, 24, SIDE - 8), _C, strict=True)), np.zeros(len(f), np.uint64))
        return np.where(ok, (_mix(h) >> _SHIFT).astype(np.uint32) | np.uint32(1), np.uint32(0))

    left, right = side(at - HALF, first <= at - HALF), side(at, last >= at - HALF)
    return at, text, gram[at].astype(np.uint32), left, right, (at - first).astype(np.uint8), (at - last).astype(np.uint8)


def _pack(part_bytes: int):
    """A block's rows in order of (doc_id, text), as compressed Arrow of about ``part_bytes`` of text each."""

    def pack(table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("text", "ascending")])
        rows = table.drop_columns(["_block"]).take(order)
        sizes = np.cumsum(pc.fill_null(pc.binary_length(rows.column("text")), 0).to_numpy().astype(np.int64))
        cuts = [0, *(np.flatnonzero(np.diff(sizes // part_bytes)) + 1).tolist(), len(rows)]
        out = []
        for i, j in zip(cuts, cuts[1:], strict=False):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(rows.slice(i, j - i).combine_chunks())
            out.append(sink.getvalue().to_pybytes())
        number = table.column("_block")[0].as_py()
        return pa.table({"_block": pa.array([number] * len(out), pa.int32()), "part": pa.array(range(len(out)), pa.int32()), "data": pa.array(out, pa.binary())})

    return pack


class Block:
    """The documents of a block in order of (doc_id, text), and its distinct anchors in a fixed order."""

    def __init__(self, parts: list[tuple[int, bytes]]):
        self.rows = pa.concat_tables([pa.ipc.open_stream(data).read_all() for _, data in sorted(parts)])
        self.docs = self.rows.column("doc_id").to_numpy()
        self.texts = pc.fill_null(self.rows.column("text").cast(pa.binary()), b"").to_pylist()

    def chunks(self) -> Iterator[tuple[int, bytes, np.ndarray]]:
        """(first document, buffer, starts) of runs of documents of about CHUNK_BYTES together."""
        first, size, n = 0, 0, len(self.texts)
        for i, t in enumerate(self.texts):
            size += len(t)
            if size >= CHUNK_BYTES or i == n - 1:
                part = self.texts[first : i + 1]
                yield first, b"".join(part), np.concatenate([np.zeros(1, np.int64), np.cumsum(np.fromiter(map(len, part), np.int64, len(part)))])
                first, size = i + 1, 0

    def occurrences(self) -> tuple[np.ndarray, ...]:
        """(document, position in it, anchor, left, right, id of the three, before, after) of every anchor."""
        parts = []
        for first, buffer, starts in self.chunks():
            at, text, *rest = _anchors(buffer, starts)
            parts.append((text + first, at - starts[text], *rest))
        kinds = (np.int64, np.int64, np.uint32, np.uint32, np.uint32, np.uint8, np.uint8)
        cols = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, k) for k in kinds]
        a, b, c = (x.astype(np.uint64) for x in cols[2:5])
        return *cols[:5], _mix((a << _SHIFT | b) * _C[0] ^ c * _C[3]), *cols[5:]

    def distinct(self, occ: tuple[np.ndarray, ...], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(occurrence index, many, bucket, inverse) of the distinct anchors, ordered by bucket and id; many: in two documents here."""
        doc, ids = self.docs[occ[0]], occ[5]
        _, first, inverse = np.unique(ids, return_index=True, return_inverse=True)
        low = np.full(len(first), np.iinfo(np.int64).max)
        high = np.full(len(first), np.iinfo(np.int64).min)
        np.minimum.at(low, inverse, doc)
        np.maximum.at(high, inverse, doc)
        bucket = (occ[2][first] % np.uint32(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return first[order], (low < high)[order], bucket[order], place[inverse]


def _splits(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    if not len(bucket):
        return
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    for a, b in zip(starts, [*starts[1:], len(bucket)], strict=True):
        yield int(bucket[a]), int(a), int(b)


def _send_anchors(buckets: int):
    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        block = Block(list(zip(pdf["part"], pdf["data"], strict=True)))
        occ = block.occurrences()
        first, many, bucket, _ = block.distinct(occ, buckets)
        key = np.stack([occ[2][first], occ[3][first], occ[4][first]], axis=1)
        rows = [(b, int(pdf["_block"].iat[0]), key[i:j].tobytes(), np.packbits(many[i:j]).tobytes()) for b, i, j in _splits(bucket)]
        return pd.DataFrame(rows, columns=["bucket", "_block", "anchors", "many"])

    return send


def _in_two(keys: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Which keys stand in more than one entry, or in an entry that is in two documents."""
    order = np.argsort(keys, kind="stable")
    starts = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    out = np.empty(len(keys), bool)
    out[order] = np.repeat((sizes > 1) | np.maximum.reduceat(many[order], starts), sizes)
    return out


def _mark_anchors(hot: int):
    """For each anchor 1 if its left string lies in two documents, 2 if its right one does, and 4 more if it is hot."""

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(x, np.uint32).reshape(-1, 3) for x in pdf["anchors"]]
        sizes = [len(p) for p in parts]
        key = np.concatenate(parts).astype(np.uint64)
        many = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) for x, n in zip(pdf["many"], sizes, strict=True)])
        state = np.zeros(len(key), np.uint8)
        for c in (1, 2):
            state[_in_two(key[:, 0] << _SHIFT | key[:, c], many) & (key[:, c] > 0)] += c
        marked = state > 0
        _, inverse, counts = np.unique(key[marked, 0], return_inverse=True, return_counts=True)
        state[marked] += (4 * (counts > hot)).astype(np.uint8)[inverse]
        ends = np.cumsum(sizes)
        return pd.DataFrame({"_block": pdf["_block"], "bucket": pdf["bucket"], "n": sizes, "marked": [zstandard.compress(state[e - n : e].tobytes(), 1) for e, n in zip(ends, sizes, strict=True)]})

    return mark


def _cut_segments(buckets: int):
    """Rows for buckets (kind 0: distinct segments) and for the block itself (kind 1: where its segments lie)."""
    columns = ["bucket", "_block", "kind", "n", "data"]

    def cut(docs: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        if not len(docs):
            return pd.DataFrame([], columns=columns)
        number = int(docs["_block"].iat[0])
        block = Block(list(zip(docs["part"], docs["data"], strict=True)))
        occ = block.occurrences()
        first, _, bucket, inverse = block.distinct(occ, buckets)
        state = np.zeros(len(first), np.uint8)
        got = dict(zip(marks["bucket"], zip(marks["n"], marks["marked"], strict=True), strict=True))
        for b, i, j in _splits(bucket):
            n, data = got[b]
            if n != j - i:
                raise RuntimeError("the documents of a block changed between two reads")
            state[i:j] = np.frombuffer(zstandard.decompress(data), np.uint8)
        occ_state = state[inverse]
        chosen = np.flatnonzero(occ_state)
        kind, position, before, after = (x[chosen].astype(np.int64) for x in (occ_state, occ[1], occ[6], occ[7]))
        # Windows that contain the left string start HALF bytes ahead or sooner, those that contain the right one there or later.
        begins = position - np.where(kind & 1, before, np.minimum(before, HALF))
        ends = position - np.where(kind & 2, after, np.maximum(after, HALF)) + MATCH
        cuts: dict[int, list] = {}
        for d, start, end, anchor, hot in zip(occ[0][chosen].tolist(), begins.tolist(), ends.tolist(), occ[2][chosen].tolist(), (kind > 3).tolist(), strict=True):
            segment = block.texts[d][start:end]
            if not hot:
                cuts.setdefault(anchor % buckets, []).append((d, start, anchor, segment))
                continue
            for k in range(len(segment) - MATCH + 1):
                window = segment[k : k + MATCH]
                name = xxhash.xxh32_intdigest(window)
                cuts.setdefault(name % buckets, []).append((d, start + k, name, window))
        rows, places = [], []
        for b in sorted(cuts):
            seen: dict[tuple[int, bytes], int] = {}
            owner: list[int] = []
            for d, start, anchor, segment in cuts[b]:
                s = seen.setdefault((anchor, segment), len(seen))
                if s == len(owner):
                    owner.append(d)  # anchors come in order of doc_id: the first is the least
                places.append((b, d, start, s, len(segment) - MATCH + 1))
            head = struct.pack("<q", len(seen))
            anchors = np.fromiter((k[0] for k in seen), np.uint32, len(seen)).tobytes()
            sizes = np.fromiter((len(k[1]) for k in seen), np.uint8, len(seen)).tobytes()
            owners = block.docs[np.array(owner, np.int64)].tobytes()
            data = zstandard.compress(head + anchors + sizes + owners + b"".join(k[1] for k in seen), 1)
            rows.append((b, number, 0, len(seen), data))
        if places:
            table = np.array(places, np.int64)
            rows.append((-1, number, 1, len(places), zstandard.compress(np.ascontiguousarray(table.T.astype("<i4" if table.max() < 2**31 else "<i8")).tobytes(), 1)))
        return pd.DataFrame(rows, columns=columns)

    return cut


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    raw = zstandard.decompress(data)
    n = struct.unpack_from("<q", raw)[0]
    at = 8
    out = []
    for kind in (np.uint32, np.uint8, np.int64):
        width = n * np.dtype(kind).itemsize
        out.append(np.frombuffer(raw, kind, n, at))
        at += width
    anchor, sizes, owner = out
    ends = (at + np.cumsum(sizes.astype(np.int64))).tolist()
    return anchor, owner, list(map(raw.__getitem__, map(slice, [at, *ends[:-1]], ends)))


def _judge_segments(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each block's segments the windows (bits, from the segment's start) that a document before its own least one has."""
    index: dict[tuple[int, bytes], int] = {}
    owner: list[int] = []
    parts = []
    for data in pdf["data"]:
        anchor, own, segments = _unpack(data)
        ids = np.empty(len(segments), np.int64)
        for k, key in enumerate(zip(anchor.tolist(), segments, strict=True)):
            s = index.setdefault(key, len(index))
            if s == len(owner):
                owner.append(int(own[k]))
            elif own[k] < owner[s]:
                owner[s] = int(own[k])
            ids[k] = s
        parts.append((ids, own))
    owners = np.array(owner, np.int64)
    low = np.repeat(owners[:, None], WINDOWS, axis=1)
    keys = list(index)
    # Segments of one anchor stay together; an anchor with one segment has nothing to compare.
    anchors = np.fromiter((k[0] for k in keys), np.uint32, len(keys))
    order = np.argsort(anchors, kind="stable")
    starts = np.flatnonzero(np.r_[True, anchors[order][1:] != anchors[order][:-1]]) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(keys)])
    group: list[int] = []
    for a, n in [*((a, n) for a, n in zip(starts.tolist(), sizes.tolist(), strict=True) if n > 1), (0, 0)]:
        if group and (not n or len(group) + n > COLLECTION):
            members = np.array(group, np.int64)
            found = least_owner(Collection([keys[k][1] for k in group], MATCH), owners[members])
            low[members, : found.shape[1]] = found
            group = []
        group += order[a : a + n].tolist()
    bits = np.uint64(1) << np.arange(WINDOWS, dtype=np.uint64)
    masks = [((low[ids] < own[:, None]) * bits).sum(axis=1, dtype=np.uint64).tobytes() for ids, own in parts]
    return pd.DataFrame({"_block": pdf["_block"], "bucket": pdf["bucket"], "owners": [own.tobytes() for _, own in parts], "masks": masks})


def _removed(block: Block, found: pa.Table) -> Iterator[np.ndarray]:
    """For each of a block's documents, in order, which bytes are removed: those under a window that a smaller document has too.

    ``found`` holds the verdicts (bucket, owners, masks) and the places (n, data) of the block's segments.
    """
    lengths = np.fromiter(map(len, block.texts), np.int64, len(block.texts))
    first_of, owners, masks, places, n = {}, [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros((5, 0), np.int64)], 0
    for r in found.to_pylist():
        if r["bucket"] >= 0:
            first_of[r["bucket"]] = n
            owners.append(np.frombuffer(r["owners"], np.int64))
            masks.append(np.frombuffer(r["masks"], np.uint64))
            n += len(owners[-1])
        else:
            raw = zstandard.decompress(r["data"])
            places.append(np.frombuffer(raw, "<i4" if len(raw) == 20 * r["n"] else "<i8").reshape(5, r["n"]).astype(np.int64))
    owner, mask = np.concatenate(owners), np.concatenate(masks)
    b, who, at, seg, windows = np.concatenate(places, axis=1)
    for number, i, j in _splits(b):
        seg[i:j] += first_of[number]
    order = np.argsort(who, kind="stable")
    who, at, seg, windows = who[order], at[order], seg[order], windows[order]
    for first_doc, buffer, starts in block.chunks():
        i, j = np.searchsorted(who, [first_doc, first_doc + len(starts) - 1])
        w, base = who[i:j], starts[who[i:j] - first_doc] + at[i:j]
        hit_first = np.zeros(len(buffer) + 1, np.int32)
        later, bits = block.docs[w] > owner[seg[i:j]], mask[seg[i:j]]
        for k in range(WINDOWS):
            hit = (later | ((bits >> np.uint64(k)) & np.uint64(1) > 0)) & (windows[i:j] > k)
            hit_first[(base + k)[hit]] = 1
        # A byte is covered if one of the MATCH windows that end at it or after it was hit; windows end within their document.
        total = np.cumsum(hit_first[:-1])
        total[MATCH:] -= total[:-MATCH].copy()
        flat = total > 0
        for x, y in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            yield flat[x:y]


def _digest(doc: int | None, text: bytes, gone: np.ndarray | None) -> tuple:
    if gone is None or not gone.any():
        return doc, len(text), 0, 0, hashlib.sha256(text).hexdigest()
    spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
    return doc, len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()


class RepeatedStrings:
    """Steps 1 to 4 for the rows of ``df`` with a doc_id; ``apply`` runs step 5. Columns ``carried`` travel with the rows."""

    def __init__(self, df: DataFrame, scratch: Scratch | None = None, block_bytes: int = BLOCK_BYTES, carried: tuple[Column, ...] = (), hot: int = HOT):
        spark = df.sparkSession
        self.scratch = scratch or Scratch(spark, "suffix-dedup")
        docs = df.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carried)
        total = docs.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first().n or 0
        # As many buckets as blocks, up to BUCKETS; blocks grow with the root of the input, up to MOST_BYTES, so that a block's
        # share of a bucket stays worth a row.
        blocks = max(1, -(-total // max(block_bytes, min(MOST_BYTES, int((576 * total) ** 0.5)))))
        buckets = min(blocks, BUCKETS)
        docs = docs.withColumn("_block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")).repartition(blocks, "_block")
        self.blocks = self.scratch.table(docs.groupBy("_block").applyInArrow(lean(_pack(min(block_bytes, BLOCK_BYTES))), "_block int, part int, data binary"), "blocks")
        anchors = self.blocks.groupBy("_block").applyInPandas(lean(_send_anchors(buckets)), "bucket int, _block int, anchors binary, many binary")
        marks = self.scratch.table(anchors.groupBy("bucket").applyInPandas(lean(_mark_anchors(hot)), "_block int, bucket int, n long, marked binary"), "marks")
        cut = self.blocks.groupBy("_block").cogroup(marks.groupBy("_block")).applyInPandas(lean(_cut_segments(buckets)), "bucket int, _block int, kind int, n long, data binary")
        self.segments = self.scratch.table(cut, "segments")
        self.scratch.drop(marks)
        verdicts = self.segments.where("kind = 0").select("bucket", "_block", "data").groupBy("bucket").applyInPandas(lean(_judge_segments), "_block int, bucket int, owners binary, masks binary")
        self.verdicts = self.scratch.table(verdicts, "verdicts")

    def apply(self, function: Callable[[Block, Iterator[np.ndarray]], pa.Table], schema: str | StructType) -> DataFrame:
        """``function`` gets each block and its documents' removed bytes."""
        none = F.lit(None).cast("binary")
        places = self.segments.where("kind = 1").select("_block", F.lit(-1).alias("bucket"), "n", "data", none.alias("owners"), none.alias("masks"))
        verdicts = self.verdicts.select("_block", "bucket", F.lit(0).cast("long").alias("n"), none.alias("data"), "owners", "masks")

        def remove(rows: pa.Table, found: pa.Table) -> pa.Table:
            block = Block(list(zip(rows.column("part").to_pylist(), rows.column("data").to_pylist(), strict=True)))
            return function(block, _removed(block, found))

        return self.blocks.groupBy("_block").cogroup(places.unionByName(verdicts).groupBy("_block")).applyInArrow(lean(remove), schema)


def remove_repeats(df: DataFrame, scratch: Scratch | None = None, block_bytes: int = BLOCK_BYTES, hot: int = HOT) -> DataFrame:
    """A row per row of ``df`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a 50-byte string that covers it also starts in a document with a smaller doc_id; strings are judged
    on the input, overlaps count, and matches never cross documents. A null text is an empty one. A row without doc_id
    neither loses bytes nor takes any; rows with the same doc_id don't take from each other; extra columns are ignored;
    an empty table gives no rows.
    """
    kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}

    def digest(block: Block, gone: Iterator[np.ndarray]) -> pa.Table:
        rows = [_digest(d, t, g) for d, t, g in zip(block.docs.tolist(), block.texts, gone, strict=True)]
        return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(kinds.items())})

    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    nameless = df.where("doc_id IS NULL").select(F.lit(None).cast("long").alias("doc_id"), F.octet_length(raw).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(raw, 256).alias("kept_sha256"))
    work = RepeatedStrings(df, scratch, block_bytes, hot=hot)
    return work.apply(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").unionByName(nameless)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def dedup_texts(df: DataFrame, scratch: Scratch | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``df`` with all its columns and rows; ``text`` is what ``remove_repeats`` keeps, ``n_chars`` (if there) its length.

    Bytes of a character that was only partly removed go with it. Rows without doc_id, and rows that lose nothing,
    stay as they are. All other columns travel in one struct, so their names don't matter.
    """
    names = df.columns
    row = F.struct(*[F.col(f"`{n}`") for n in names if n != "text"]).alias("row")

    def shorten(block: Block, gone: Iterator[np.ndarray]) -> pa.Table:
        texts, cut = block.rows.column("text").to_pylist(), []
        for k, (t, g) in enumerate(zip(block.texts, gone, strict=True)):
            cut.append(bool(g.any()))
            if cut[-1]:
                texts[k] = np.frombuffer(t, np.uint8)[~g].tobytes().decode("utf-8", "ignore")
        return pa.table([block.rows.column("row").combine_chunks(), pa.array(texts, pa.string()), pa.array(cut, pa.bool_())], names=["row", "text", "cut"])

    shape = df.select(row, F.col("text").cast("string").alias("text"), F.lit(False).alias("cut")).schema
    rows = RepeatedStrings(df, scratch, block_bytes, (row,)).apply(shorten, shape)

    def column(n: str) -> Column:
        if n == "text":
            return F.col("text")
        c = F.col(f"row.`{n}`")
        return F.when(F.col("cut"), F.length("text").cast(df.schema[n].dataType)).otherwise(c).alias(n) if n == "n_chars" else c.alias(n)

    return rows.select(*map(column, names)).unionByName(df.where("doc_id IS NULL").withColumn("text", F.col("text").cast("string")))

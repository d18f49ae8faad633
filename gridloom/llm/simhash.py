"""SimHash near-duplicates: fingerprints, a byte-position inverted index with count filtering, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .components import connected_components

SEED, SHINGLE, RADIUS = 42, 4, 4
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash over word shingles, repeats included: bit set where over half of the XXH64 values have it; 0 without a word."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    n = max(1, len(words) - shingle + 1)
    if not words:
        return 0
    whole = b" ".join(words)
    if n == 1:
        hashes = np.array([xxhash.xxh64_intdigest(whole, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]])[:n]
        pieces = map(whole.__getitem__, map(slice, starts.tolist(), (ends[shingle - 1 :] - 1).tolist()))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, n)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int(sum(1 << int(i) for i in np.flatnonzero(2 * counts > len(hashes))))


def fp_column(text: Column, shingle: int = SHINGLE) -> Column:
    """A text's fingerprint as the bits of a signed long."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t if isinstance(t, str) else None, shingle) for t in texts], np.uint64).view(np.int64))

    return fp(text)


def fingerprints(df: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) for each row."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), fp_column(F.col("text").cast("string"), shingle).alias("fp"))


def position_keys(least: int, width: int = 8) -> list[tuple[int, ...]]:
    """Sets of ``least - 1`` of ``width`` byte positions, such that any ``least`` positions hold one of them.

    Positions are dealt to least - 1 classes; a set is taken if it leaves some class out and fits the classes from
    there on in order. For four of eight positions these are 20 triples, the fewest possible.
    """
    if least < 1:
        raise ValueError("fingerprints that differ in each byte share no posting")
    if least == 1:
        return [(p,) for p in range(width)]
    size = least - 1
    wanted = [frozenset(c) for c in combinations(range(width), least)]
    if size == 3:
        group = [p * 3 // width for p in range(width)]
        count = lambda s, g: sum(group[p] == g for p in s)
        kept = [s for s in combinations(range(width), 3) if any(count(s, g) == 3 or count(s, g) == 2 and count(s, (g + 1) % 3) == 1 for g in range(3))]
    else:
        kept, open_ = [], set(wanted)
        every = list(combinations(range(width), size))
        while open_:
            best = max(every, key=lambda s: (sum(set(s) <= w for w in open_), s))
            kept.append(best)
            open_ = {w for w in open_ if not set(best) <= w}
    if not all(any(set(s) <= w for s in kept) for w in wanted):
        raise AssertionError("some positions hold no indexed set")
    return kept


def list_keys(fps: np.ndarray, least: int, salt: int = 0) -> np.ndarray:
    """A matrix, rows by index sets: the posting list in which a fingerprint lies for each set of byte positions."""
    sets = position_keys(least)
    out = np.empty((len(fps), len(sets)), np.uint64)
    for k, positions in enumerate(sets):
        mask = np.uint64(sum(0xFF << (8 * p) for p in positions))
        z = ((fps & mask) + np.uint64((salt * len(sets) + k + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        out[:, k] = z ^ (z >> np.uint64(32))
    return out


def postings(fps: DataFrame, radius: int) -> DataFrame:
    """The inverted index: a posting (key, fp) for each indexed set of byte positions and the bytes found there.

    Two fingerprints at most ``radius`` bits apart share 8 - radius positional bytes at least. Lists of single bytes hold
    a 256th of all rows each; the index holds intersections of one byte less than the guaranteed number, so that a
    list also brings together pairs that share too few, which the tally then rejects.
    """

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            f = b["fp"].to_numpy(np.int64).view(np.uint64)
            for at in range(0, len(f), 4096):
                part = f[at : at + 4096]
                keys = list_keys(part, 8 - radius)
                yield pd.DataFrame({"key": keys.reshape(-1).view(np.int64), "fp": np.repeat(part, keys.shape[1]).view(np.int64)})

    return fps.select("fp").mapInPandas(index, "key long, fp long")


def tally(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many positional bytes each pair shares."""
    x = np.atleast_1d(a ^ b)
    return (x.view(np.uint8).reshape(*x.shape, 8) == 0).sum(axis=-1)


#: What the count filter has seen in this process: pairs tallied, pairs it kept, pairs that were near after all.
SEEN = {"tallied": 0, "kept": 0, "near": 0}


def near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Count filter, then check: pairs that share 8 - radius positional bytes at least are kept, only they are measured in bits."""
    ok = tally(a, b) >= 8 - radius
    kept = np.flatnonzero(ok)
    x = np.broadcast_to(a, ok.shape)[kept] ^ np.broadcast_to(b, ok.shape)[kept]
    close = np.bitwise_count(x) <= radius
    ok[kept] = close
    SEEN["tallied"] += len(ok)
    SEEN["kept"] += len(kept)
    SEEN["near"] += int(close.sum())
    return ok


def spanning_links(fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs that connect one list's rows as all pairs within ``radius`` would, at most one per row.

    Grows a component from a pivot: what lies near the frontier leaves the open rows and joins the frontier. A dense
    group empties at its first pivot, so its pairs are neither emitted nor compared one by one.
    """
    open_ = np.arange(len(fps))
    while len(open_) > 1:
        frontier, open_ = open_[:1], open_[1:]
        while len(frontier) and len(open_):
            pivot, frontier = frontier[0], frontier[1:]
            hit = np.zeros(len(open_), bool)
            for i in range(0, len(open_), 1 << 18):
                hit[i : i + (1 << 18)] = near(fps[open_[i : i + (1 << 18)]], fps[pivot : pivot + 1], radius)
            if hit.any():
                found, open_ = open_[hit], open_[~hit]
                yield np.full(len(found), pivot), found
                frontier = np.concatenate([frontier, found])


def list_links(keys: np.ndarray, fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within each posting list; rows are sorted by key. Short lists are compared side by side for all lists at once."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    short = (sizes > 1) & (sizes <= 16)
    for gap in range(1, 16):
        s, n = starts[short & (sizes > gap)], sizes[short & (sizes > gap)]
        if not len(s):
            break
        each = n - gap
        left = np.repeat(s, each) + (np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each))
        ok = near(fps[left], fps[left + gap], radius)
        yield left[ok], left[ok] + gap
    for s, n in zip(starts[sizes > 16].tolist(), sizes[sizes > 16].tolist(), strict=True):
        for a, b in spanning_links(fps[s : s + n], radius):
            yield a + s, b + s


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): different fingerprints at most ``radius`` bits apart, enough of them to connect whatever is connected."""

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [(b["key"].to_numpy(np.int64), b["fp"].to_numpy(np.int64).view(np.uint64)) for b in batches]
        if not parts:
            return
        key, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        order = np.argsort(key, kind="stable")
        key, fp = key[order], fp[order]
        for a, b in list_links(key, fp, radius):
            if len(a):
                found = np.unique(np.sort(np.stack([fp[a], fp[b]], axis=1).view(np.int64), axis=1), axis=0)
                yield pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

    rows, lists = postings(fps, radius), len(position_keys(8 - radius))
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A task holds its postings (16 bytes each): their number is known, so the number of tasks follows it.
    tasks = max(n, -(-fps.count() * lists // 1_000_000))
    return rows.repartition(tasks, "key").mapInPandas(pairs, "a long, b long").distinct()


def simhash_components(df: DataFrame, scratch: Scratch | None = None, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """A row per row of ``df`` (doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints at most ``radius`` bits apart are linked; component_id is the smallest doc_id that can be reached.
    Copies count once: links are sought between distinct fingerprints. A null or empty
    text has fingerprint zero and links like any other; a row without doc_id has no component (null) and links
    nothing; repeated rows stay, and rows that share a doc_id link by their own texts; extra columns are ignored; an empty table gives no rows.
    """
    scratch = scratch or Scratch(df.sparkSession, "simhash")
    docs = scratch.table(fingerprints(df, shingle), "fingerprints")
    reps = scratch.table(docs.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "distinct")
    found = scratch.table(links(reps, radius).select("a", "b"), "links")
    comp = connected_components(found, scratch)
    comp = scratch.table(comp.withColumnRenamed("node", "fp"), "nodes")
    # A table of its own: the join below then has an exchange of its own, in which a hot component can be split.
    least = scratch.table(reps.join(comp, "fp").groupBy("component").agg(F.min("doc_id").alias("least")), "least")
    named = reps.join(comp, "fp", "left").join(least, "component", "left").select("fp", F.coalesce("least", "doc_id").alias("component_id"))
    named = scratch.table(named, "components")
    out = docs.join(named, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_rows(df: DataFrame, docs: DataFrame, kept: DataFrame, node: Callable[[Column], Column], scratch: Scratch) -> DataFrame:
    """The rows of ``df`` whose (doc_id, node) is in ``kept``, one for each, and the rows without doc_id; all columns.

    ``docs`` holds (doc_id, node) of every row with a doc_id. Rows are found by doc_id; only for ids that have several
    nodes the node is made again from the text. Column names of ``df`` don't matter. Which of several rows with
    equal doc_id and node stays is open.
    """
    row = F.struct(*[F.col(f"`{n}`") for n in df.columns]).alias("r")
    rows = df.select(row).select("r", F.col("r.doc_id").cast("long").alias("doc_id"), F.col("r.text").cast("string").alias("text"))
    known = rows.where("doc_id IS NOT NULL")
    several = scratch.table(docs.groupBy("doc_id").agg((F.min("node") != F.max("node")).alias("several")).where("several").select("doc_id"), "several")
    out = known
    if several.isEmpty():
        out = out.join(kept.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    else:
        one = known.join(kept.join(several, "doc_id", "left_anti").select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])
        many = known.join(several, "doc_id", "left_semi").withColumn("node", node(F.col("text")))
        many = many.join(kept.distinct(), ["doc_id", "node"], "left_semi").dropDuplicates(["doc_id", "node"])
        out = one.select("r").unionByName(many.select("r"))
    return out.select("r.*").unionByName(rows.where("doc_id IS NULL").select("r.*"))


def simhash_dedup(df: DataFrame) -> DataFrame:
    """The rows of ``df`` that stand for their component: those whose doc_id is its component_id, one for each doc_id and fingerprint; all columns.

    Different texts under one doc_id are judged each by its own fingerprint. Rows without doc_id stay.
    """
    scratch = Scratch(df.sparkSession, "simhash-dedup")
    found = scratch.table(simhash_components(df, scratch), "found")
    docs = found.where("doc_id IS NOT NULL").select("doc_id", F.col("fingerprint").alias("node"), "component_id")
    as_text = lambda t: F.lower(F.lpad(F.hex(fp_column(t)), 16, "0"))
    return keep_rows(df, docs, docs.where("doc_id = component_id").select("doc_id", "node").distinct(), as_text, scratch)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))

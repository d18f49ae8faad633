"""Near-duplicates by exact word-shingle similarity: the SimHash index finds candidate pairs, the shingle sets decide them."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean
from .components import joined
from .simhash import _LOWER, keep_rows, list_keys, majority, position_keys, tally

SEED, SHINGLE, LEAST = 42, 5, 0.8
#: Each text is indexed under so many 64-bit fingerprints of its distinct words; a pair must share SHARED of the 8 bytes of one of them.
#: Changed words spoil five shingles each but only one word: at similarity 0.8 most word fingerprints differ in 1 to 8 bits.
PRINTS, SHARED = 4, 4
#: The rounds in which long lists are held against their centres: the kinds of lists each takes. What a round links needn't meet in the next ones,
#: so the first take few kinds: each row is in one list of a kind.
STAGES = ((0, 4), (4, 20), (20, 40))
#: Rounds over all long lists in which the rows that are left meet the nearest one.
NEAREST = 2
#: Ranges of a sketch of the shingles. Texts of few distinct words have alike word fingerprints; their shingles tell them apart.
BINS = 512
#: Lists up to so many rows are compared side by side, all lists of a task at once; both ways compare all that may be alike.
SHORT = 16


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 values of a text's word shingles, letters lowered; fewer words are one shingle, no word none."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]])[:n]
    pieces = map(b" ".join(words).__getitem__, map(slice, starts.tolist(), (ends[min(shingle, len(words)) - 1 :] - 1).tolist()))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, n))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; two empty sets are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def node_of(values: np.ndarray) -> int:
    """What stands for a set of shingles: a hash of its sorted values."""
    return xxhash.xxh3_64_intdigest(values.tobytes(), SEED)


def word_prints(text: str | None) -> np.ndarray:
    """PRINTS SimHash fingerprints of a text's distinct words, letters lowered."""
    words = set(text.encode("utf-8", "surrogatepass").translate(_LOWER).split()) if text else ()
    h = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(SEED)), np.uint64, len(words))
    out = np.empty(PRINTS, np.uint64)
    for k in range(PRINTS):  # one hash a word, mixed anew for each fingerprint
        z = (h ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[k] = majority(z ^ (z >> np.uint64(31)))
    return out


def sketch(values: np.ndarray) -> bytes:
    """A byte of the least value in each of BINS ranges that the values are dealt to; 0 for a range without any."""
    out = np.zeros(BINS, np.uint8)
    part = (values & np.uint64(BINS - 1)).astype(np.int64)
    at, first = np.unique(part, return_index=True)  # values are sorted, so the first of a range is its least
    out[at] = (values[first] >> np.uint64(8)).astype(np.uint8) | np.uint8(1)
    return out.tobytes()


def sketch_ok(a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which rows of two matrices of sketches may belong to sets of the least similarity; ``sizes`` are the sets' sizes together.

    Two sets differ in a range only if one of them has a value of its own there, and alike sets have few of those: this bound is exact.
    Of large sets, which fill all ranges, as many must agree as do at the least similarity, less five deviations.
    """
    filled, same = ((a | b) != 0).sum(axis=1), ((a == b) & (a != 0)).sum(axis=1)
    own = np.floor(sizes * (1 - LEAST) / (1 + LEAST) + 1e-9)
    return (filled - same <= own) & (same >= LEAST * filled - 5 * np.sqrt(LEAST * (1 - LEAST) * filled) - 1)


def bit_limit(n: int, words: int) -> int:
    """How many of all 64 * PRINTS bits may differ: what a pair at the least similarity differs in, and five deviations more.

    At similarity 0.8 a text of n shingles has about n / 45 changed words; a bit of a fingerprint of distinct words then differs
    with the angle between the two sets, as a share of half a turn.
    """
    turn = math.acos(max(-1.0, 1.0 - n / (9 * SHINGLE) / max(1, words))) / math.pi
    return math.ceil(64 * PRINTS * turn + 5 * math.sqrt(64 * PRINTS * turn * (1 - turn)) + 2)


def signed(df: DataFrame) -> DataFrame:
    """(doc_id, node, n, far, prints) for each row with a doc_id: node stands for the set of shingles, n is its size, far its bit limit."""

    @F.pandas_udf("node long, n long, far int, prints array<long>")
    def sign(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            text = t if isinstance(t, str) else None
            s = shingles(text)
            prints = word_prints(text).view(np.int64) if len(s) else np.zeros(0, np.int64)
            rows.append((np.uint64(node_of(s)).astype(np.int64), len(s), bit_limit(len(s), distinct_words(text)), prints))
        return pd.DataFrame(rows, columns=["node", "n", "far", "prints"])

    rows = df.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), sign(F.col("text").cast("string")).alias("s"))
    return rows.select("doc_id", "s.node", "s.n", "s.far", "s.prints")


def distinct_words(text: str | None) -> int:
    return len(set(text.encode("utf-8", "surrogatepass").translate(_LOWER).split())) if text else 0


def node_column(text: Column) -> Column:
    @F.pandas_udf("long")
    def node(texts: pd.Series) -> pd.Series:
        return pd.Series([node_of(shingles(t if isinstance(t, str) else None)) for t in texts], dtype="uint64").astype(np.int64)

    return node(text)


_ROW = ["key", "list", "node", *(f"p{k}" for k in range(PRINTS)), "n", "far", "group"]
_TYPES = "key long, list int, node long, " + ", ".join(f"p{k} long" for k in range(PRINTS)) + ", n long, far int"


def postings(nodes: DataFrame) -> DataFrame:
    """The inverted index of all fingerprints by sets of byte positions; a posting names the list's kind and carries what pairs are judged by, but no group yet."""
    lists = len(position_keys(SHARED))

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 4096):
                part = b.iloc[at : at + 4096]
                for k in range(PRINTS):
                    keys = list_keys(part[f"p{k}"].to_numpy(np.int64).view(np.uint64), SHARED, k)
                    out = part.loc[part.index.repeat(lists)].reset_index(drop=True)
                    yield out.assign(key=keys.reshape(-1).view(np.int64), list=np.tile(np.arange(k * lists, (k + 1) * lists), len(part)))[_ROW[:-1]]

    rows = nodes.where(F.size("prints") == PRINTS)
    return rows.select("node", *[F.col("prints")[k].alias(f"p{k}") for k in range(PRINTS)], "n", "far").mapInPandas(lean(index), _TYPES)


class Lists:
    """The posting lists of a task, as arrays, list by list."""

    def __init__(self, batches: Iterator[pd.DataFrame]):
        parts = [b for b in batches if len(b)]
        rows = pd.concat(parts) if parts else pd.DataFrame({c: np.zeros(0, np.int64) for c in _ROW})
        order = np.lexsort((rows["node"].to_numpy(), rows["key"].to_numpy()))
        column = lambda c: rows[c].to_numpy(np.int64)[order]
        self.key, self.list, self.node, self.n, self.far = map(column, ("key", "list", "node", "n", "far"))
        self.group = column("group") if "group" in rows else self.node
        self.sketch = np.frombuffer(b"".join(rows["sketch"].iloc[order]), np.uint8).reshape(-1, BINS) if "sketch" in rows else None
        self.prints = np.stack([column(f"p{k}").view(np.uint64) for k in range(PRINTS)], axis=1)

    def each(self, least: int = 2) -> Iterator[np.ndarray]:
        """The rows of each list of ``least`` rows or more."""
        starts = np.flatnonzero(np.r_[True, self.key[1:] != self.key[:-1]]) if len(self.key) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[starts, len(self.key)])
        for s, m in zip(starts[sizes >= least].tolist(), sizes[sizes >= least].tolist(), strict=True):
            yield np.arange(s, s + m)

    def side_by_side(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The plausible pairs within lists of up to SHORT rows."""
        starts = np.flatnonzero(np.r_[True, self.key[1:] != self.key[:-1]]) if len(self.key) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[starts, len(self.key)])
        ends = np.repeat(starts + np.where(sizes <= SHORT, sizes, 0), sizes)  # a long list's rows have no partner here
        for gap in range(1, SHORT):
            left = np.flatnonzero(np.arange(len(self.key)) + gap < ends)
            for at in range(0, len(left), 1 << 17):
                a = left[at : at + (1 << 17)]
                a = a[self.node[a] != self.node[a + gap]]
                b = a + gap
                x = self.prints[a] ^ self.prints[b]
                own = np.take_along_axis(x, (self.list[a] // len(position_keys(SHARED)))[:, None], axis=1)[:, 0]
                ok = (np.minimum(self.n[a], self.n[b]) >= LEAST * np.maximum(self.n[a], self.n[b])) & (tally(own, np.zeros_like(own)) >= SHARED)
                ok &= np.bitwise_count(x).sum(axis=1) <= np.maximum(self.far[a], self.far[b])
                yield self.sketched(a[ok], b[ok])

    def sketched(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs whose sketches allow it, where there are sketches."""
        if self.sketch is None or not len(a):
            return a, b
        ok = sketch_ok(self.sketch[a], self.sketch[b], self.n[a] + self.n[b])
        return a[ok], b[ok]

    def plausible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A matrix: which rows a and b of one list may be alike by the count filter, the sizes of their sets, and the bits of all fingerprints."""
        k = int(self.list[a[0]]) // len(position_keys(SHARED))
        x = self.prints[a][:, None] ^ self.prints[b][None]
        n, m = self.n[a][:, None], self.n[b][None]
        ok = (np.minimum(n, m) >= LEAST * np.maximum(n, m)) & (self.node[a][:, None] != self.node[b][None])
        ok &= np.bitwise_count(x).sum(axis=2) <= np.maximum(self.far[a][:, None], self.far[b][None])
        return ok & (tally(x[..., k], np.zeros_like(x[..., k])) >= SHARED)

    def met_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of one list meet in an earlier one too: that of an earlier print, or of earlier byte positions of this print."""
        sets = position_keys(SHARED)
        k, i = divmod(int(self.list[a[0]]), len(sets)) if len(a) else (0, 0)
        x = self.prints[a] ^ self.prints[b]
        out = np.zeros(len(a), bool)
        for earlier in range(k):
            out |= tally(np.ascontiguousarray(x[:, earlier]), np.zeros(1, np.uint64)) >= SHARED
        for positions in sets[:i]:
            out |= (x[:, k] & np.uint64(sum(0xFF << (8 * p) for p in positions))) == 0
        return out

    def blocks(self, a: np.ndarray, b: np.ndarray, once: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The plausible pairs of rows a with rows b; ``once``: each in the first list where they meet."""
        step = max(1, (1 << 18) // max(1, len(b)))
        for at in range(0, len(a), step):
            i, j = np.nonzero(self.plausible(a[at : at + step], b))
            x, y = a[at : at + step][i], b[j]
            if once:
                new = ~self.met_before(x, y) & (self.group[x] != self.group[y])
                x, y = x[new], y[new]
            yield self.sketched(x, y)

    def centres(self, rows: np.ndarray) -> np.ndarray:
        """The rows nearest to the rows' majority fingerprints, over all prints."""
        middle = np.array([majority(self.prints[rows, k]) for k in range(PRINTS)], np.uint64)
        far = np.bitwise_count(self.prints[rows] ^ middle).sum(axis=1)
        return rows[far == far.min()]

    def others(self, rows: np.ndarray) -> np.ndarray:
        """The rows outside the list's largest group."""
        groups, at, sizes = np.unique(self.group[rows], return_inverse=True, return_counts=True)
        return rows[at != np.argmax(sizes)]

    def nearest(self, a: np.ndarray, b: np.ndarray, by: np.ndarray) -> np.ndarray:
        """Of the pairs of different groups the places of those with the fewest differing bits for each value of ``by``; ties to the first."""
        apart = np.flatnonzero(self.group[a] != self.group[b])
        by, far = by[apart], np.bitwise_count(self.prints[a[apart]] ^ self.prints[b[apart]]).sum(axis=1)
        order = np.lexsort((far, by))
        return apart[order[np.r_[True, by[order][1:] != by[order][:-1]]]] if len(order) else apart

    def pairs(self, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
        """The rows of different groups, as nodes."""
        apart = self.group[a] != self.group[b]
        x, y = self.node[a[apart]], self.node[b[apart]]
        found = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
        return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})


def open_postings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, list, node) of the rows that have a plausible partner in their list."""
    rows = Lists(batches)
    found = np.zeros(len(rows.key), bool)
    for a, b in rows.side_by_side():
        found[a] = found[b] = True
    for own in rows.each(SHORT + 1):
        hub = rows.centres(own)[:1]
        for at in (own, None):
            left = own[~found[own]]
            for a, b in rows.blocks(left, hub if at is not None else own):
                found[a] = found[b] = True
    yield pd.DataFrame({"key": rows.key[found], "list": rows.list[found], "node": rows.node[found]})


def centre_pairs(first: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """In each list of more than SHORT rows the rows with those nearest to its majority; after the first round, nearest to that of the rows outside the largest group.

    A row comes with a centre in each of its lists; ``nearest_pairs`` gives fewer.
    """

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = Lists(batches)
        for own in rows.each(SHORT + 1):
            outside = rows.others(own)
            if len(outside):
                for a, b in rows.blocks(rows.centres(own if first else outside), own):
                    yield rows.pairs(a, b)

    return meet


def nearest_pairs(hubs: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """In each list of more than SHORT rows pairs that are likely to link groups, at most one for each row or group, each once a task.

    With ``hubs`` the row nearest to the list's majority with that row of each other group that is nearest to it; otherwise each row outside the
    largest group with the row nearest to it in another group.
    """

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, left, right = Lists(batches), [], []
        for own in rows.each(SHORT + 1):
            outside = rows.others(own)
            if len(outside):
                for a, b in rows.blocks(rows.centres(own)[:1] if hubs else outside, own):
                    at = rows.nearest(a, b, rows.group[b] if hubs else a)
                    left.append(a[at])
                    right.append(b[at])
        if left:
            yield rows.pairs(np.concatenate(left), np.concatenate(right))

    return meet


def other_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """In each list all plausible pairs of rows of different groups."""
    rows = Lists(batches)
    for a, b in rows.side_by_side():
        yield rows.pairs(a, b)
    for own in rows.each(SHORT + 1):
        outside = rows.others(own)
        if len(outside):
            for a, b in rows.blocks(outside, own, once=True):
                yield rows.pairs(a, b)


def verified(pairs: DataFrame, sets: DataFrame, least: float = LEAST) -> DataFrame:
    """The pairs (a, b) whose sets (node, s: sorted values as bytes) have at least the similarity ``least``."""

    @F.pandas_udf("boolean")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([similarity(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) >= least for a, b in zip(x, y, strict=True)], dtype=bool)

    rows = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")
    return rows.join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b").where(alike("sa", "sb")).select("a", "b")


def _sets(df: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, s, sketch): the sorted shingle values, as bytes, of nodes (node, doc_id), made again from their texts, and their sketch."""

    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingles(t if isinstance(t, str) else None) for t in b["text"]]
            node = np.array([node_of(s) for s in sets], np.uint64).view(np.int64)
            same = node == b["node"].to_numpy(np.int64)
            kept = [s for s, ok in zip(sets, same, strict=True) if ok]
            yield pd.DataFrame({"node": node[same], "s": [s.tobytes() for s in kept], "sketch": [sketch(s) for s in kept]})

    texts = df.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(nodes, "doc_id").select("node", "text").mapInPandas(lean(values), "node long, s binary, sketch binary").dropDuplicates(["node"])


def similar_links(df: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): pairs of different nodes with similarity LEAST or more, enough of them to connect what the index brings together.

    Lists are cut down to rows with a plausible partner. In rounds over ever more kinds of lists, one centre of each long list is held against a row of
    each other group there, then each row that is still outside a list's largest group against the row nearest to it; what is
    linked is one group, whose rows needn't meet again, as a further link between them would join nothing. Last, all plausible pairs of
    different groups are verified, so no pair is left out.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-nodes.count() * PRINTS * len(position_keys(SHARED)) // 250_000))
    open_ = postings(nodes).repartition(tasks, "key").mapInPandas(lean(open_postings), "key long, list int, node long")
    open_ = scratch.table(open_, "lists")
    ends = scratch.table(open_.select("node").distinct().join(nodes, "node"), "ends")
    sets = scratch.table(_sets(df, ends.select("node", "doc_id")), "sets")
    prints = [F.col("prints")[k].alias(f"p{k}") for k in range(PRINTS)]
    groups, found = ends.withColumn("group", F.col("node")), None
    long = open_.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > SHORT).select("key")
    long = scratch.table(open_.join(long, "key", "left_semi"), "long-lists")
    rounds = [] if long.isEmpty() else [(nearest_pairs(True), *kinds) for kinds in STAGES] + [(nearest_pairs(False), 0, PRINTS * len(position_keys(SHARED)))] * NEAREST
    for meet, start, end in [*rounds, (other_pairs, None, None)]:
        last = start is None
        rows = (open_ if last else long.where(F.col("list").between(start, end - 1))).join(groups.select("node", *prints, "n", "far", "group"), "node").select(*[f"`{c}`" for c in _ROW])
        if last:  # fewer lists, and rows with their sketches
            apart = rows.groupBy("key").agg((F.min("group") != F.max("group")).alias("apart")).where("apart").select("key")
            rows = rows.join(apart, "key", "left_semi").join(sets.select("node", "sketch"), "node")
        pairs = rows.repartition("key").mapInPandas(lean(meet), "a long, b long").distinct()
        new = scratch.table(verified(scratch.table(pairs, "pairs"), sets), "links")
        found = new if found is None else scratch.table(found.unionByName(new), "found")
        if not last:
            comp = scratch.table(joined(found, scratch), "joined")
            groups = scratch.table(ends.join(comp, "node", "left").select(ends["*"], F.coalesce("component", "node").alias("group")), "groups")
    return found


def near_dedup(df: DataFrame) -> DataFrame:
    """The rows of ``df`` (doc_id, text, any others) with the smallest doc_id of their component, once each; all columns.

    Texts whose five-word shingles have a Jaccard similarity of 0.8 or more are linked, if the index brings them together:
    they share SHARED positional bytes of a word fingerprint, and their fingerprints differ in no more than ``bit_limit`` allows. No pair
    below 0.8 is linked. README states what the index was measured to miss. An empty table gives no rows. Texts with equal shingles, those without a word among them, count once.
    Different texts under one doc_id are judged each. Rows without doc_id stay and link nothing.
    """
    scratch = Scratch(df.sparkSession, "near-dedup")
    docs = scratch.table(signed(df), "signed")
    nodes = docs.groupBy("node").agg(F.min(F.struct("doc_id", "n", "far", "prints")).alias("r")).select("node", "r.*")
    nodes = scratch.table(nodes, "nodes")
    links = similar_links(df, nodes, scratch)
    comp = scratch.table(joined(links, scratch), "components")
    linked = scratch.table(nodes.join(comp, "node").select("node", "doc_id", "component"), "linked")
    least = scratch.table(linked.groupBy("component").agg(F.min(F.struct("doc_id", "node")).alias("r")), "least")
    alone = nodes.join(comp.select("node"), "node", "left_anti").select("doc_id", "node")
    kept = scratch.table(alone.unionByName(least.select("r.doc_id", "r.node")), "kept")
    return keep_rows(df, docs.select("doc_id", "node"), kept, node_column, scratch)

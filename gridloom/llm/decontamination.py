"""Benchmark decontamination by pigeonhole edit matching: exact piece hits, then Myers' bit-parallel distance."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One edit is allowed for each so many characters of a normalised item.
CHARS_PER_ERROR = 20
#: Items are searched for in blocks of at most so many characters; a block is what goes to the tasks.
BLOCK_CHARS = 8_000_000
_SPACE = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(256))


def normalise(text: str | None) -> str:
    """Lower case, ASCII punctuation and white space as single spaces."""
    if not text:
        return ""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_SPACE).split()).decode("utf-8", "surrogatepass")


def budget(item: str) -> int:
    return len(item) // CHARS_PER_ERROR


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece) of errors + 1 pieces: with at most ``errors`` edits, one of them stays whole."""
    n = errors + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(item: str, window: str, peq: dict[str, int] | None = None) -> int:
    """Least edit distance between ``item`` and any substring of ``window``; a column of the matrix is one whole number."""
    m = len(item)
    if peq is None:
        peq = char_masks(item)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = mask, 0, m
    best = m
    for c in window:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & mask)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
        ph = (ph << 1) & mask
        mh = (mh << 1) & mask
        pv = mh | (~(xv | ph) & mask)
        mv = ph & xv
    return best


def char_masks(item: str) -> dict[str, int]:
    peq: dict[str, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    return peq


class Matcher:
    """Finds which items a text contains within their budgets. Items: (item_id, normalised text).

    An item without a budget (under CHARS_PER_ERROR characters) is found only between word edges; there is no least length.
    """

    def __init__(self, items: list[tuple[int | None, str]]):
        import ahocorasick

        self.items = [(i, t if budget(t) else f" {t} ", budget(t)) for i, t in items if t]
        self.masks: dict[int, dict[str, int]] = {}
        found: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t, e) in enumerate(self.items):
            for offset, piece in pieces(t, e):
                found.setdefault(piece, []).append((k, offset))
        self.auto = ahocorasick.Automaton()
        for piece, where in found.items():
            self.auto.add_word(piece, (len(piece), where))
        if found:
            self.auto.make_automaton()

    def matches(self, text: str | None) -> list[tuple[int | None, int]]:
        """(item_id, errors) of each contained item, the least errors of all places, ordered by item."""
        norm = normalise(text)
        if not norm or not self.items:
            return []
        norm = f" {norm} "
        starts: dict[int, set[int]] = {}
        for end, (n, where) in self.auto.iter(norm):
            for k, offset in where:
                starts.setdefault(k, set()).add(end + 1 - n - offset)
        out = []
        for k in sorted(starts):
            item_id, item, errors = self.items[k]
            best, done_to = errors + 1, None
            for s in sorted(starts[k]):
                if s >= 0 and norm.startswith(item, s):
                    best = 0
                    break
                if done_to is not None and s <= done_to:
                    continue
                # Starts up to 2 * errors later lie in this window too.
                window = norm[max(0, s - errors) : s + len(item) + 4 * errors]
                if k not in self.masks:
                    self.masks[k] = char_masks(item)
                best, done_to = min(best, myers(item, window, self.masks[k])), s + 2 * errors
            if best <= errors:
                out.append((item_id, best))
        return out


def item_blocks(items: DataFrame) -> Iterator[Broadcast]:
    """The items, normalised, in blocks of about BLOCK_CHARS characters, each broadcast: a block's size is bounded, however large their table."""
    chars = items.agg(F.sum(F.length("text").cast("long")).alias("n")).first().n or 0
    n = -(-chars // BLOCK_CHARS) or 1
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for i in range(n):
        rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(block == i).distinct().collect()
        found = sorted(((r.item_id, normalise(r.text)) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        yield items.sparkSession.sparkContext.broadcast(found)


_MADE: list[tuple[list, Matcher]] = []


def matcher(block: Broadcast) -> Matcher:
    """A block's matcher, made once per worker; a worker keeps one at a time."""
    items = block.value
    if not _MADE or _MADE[0][0] is not items:
        _MADE[:] = [(items, Matcher(items))]
    return _MADE[0][1]


def _search(block: Broadcast):
    @F.pandas_udf("array<struct<item_id:long,errors:int>>")
    def search(texts: pd.Series) -> pd.Series:
        m = matcher(block)
        return pd.Series([[{"item_id": i, "errors": e} for i, e in m.matches(t if isinstance(t, str) else None)] for t in texts], dtype=object)

    return search


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, errors) for each row of ``docs`` and each item it contains within the item's budget.

    Texts are compared in normal form (lower case, punctuation as spaces); an item of n characters may have n // 20
    edits, so items under 20 characters are matched exactly, between word edges. Null, empty and punctuation-only items match
    nothing, and nothing matches a null text; a null doc_id or item_id stays null; repeated rows of ``docs`` match each,
    repeated items once; extra columns are ignored; an empty table on either side gives no rows. Documents are read once
    for each BLOCK_CHARS characters of items.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for block in item_blocks(items):
        found = source.select("doc_id", F.explode(_search(block)("text")).alias("m")).select("doc_id", "m.item_id", "m.errors")
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns."""
    for block in item_blocks(items):
        docs = docs.where(F.size(_search(block)(F.col("text").cast("string"))) == 0)
    return docs


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

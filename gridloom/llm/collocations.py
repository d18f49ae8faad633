"""Phrase collocations by prefix growth: occurrences are projected per frequent prefix and grown to the right, depth first."""

from __future__ import annotations

from array import array
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, batches_of, give_back, lean

LEAST, LONGEST, TOP = 100, 5, 2000
#: Bytes of text that a task gets at once and whose words share a dictionary, how many sums it holds before it passes them on, and how many
#: go out in a batch.
BLOCK, HELD, SENT = 4 << 20, 300_000, 100_000
#: Bits of the filters that tell tasks which words, pairs and triples may be frequent. Their size is fixed: they only spare work, since
#: whatever passes is counted exactly.
FILTER_BITS = 26
_BORDER = b"\xff"  # no byte of UTF-8
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else 255 if chr(c) in ".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))


def split(text: str) -> list[bytes]:
    """The words of a text, A-Z lowered, with a border between pieces."""
    return text.encode("utf-8", "surrogatepass").translate(_CLEAN).replace(_BORDER, b" \xff ").split()


def texts_by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[str]]]:
    """(lang, texts) of about BLOCK bytes each, without empty ones. A null lang is ``und``."""
    for b in batches:
        step = max(1, len(b) * BLOCK // max(1, b.nbytes))
        for at in range(0, len(b), step):
            by: dict[str, list[str]] = {}
            part = b.slice(at, step)
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                if text:
                    by.setdefault("und" if lang is None else lang, []).append(text)
            yield from by.items()


def sent(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in pieces, as the JVM holds one whole."""
    for at in range(0, len(batch), SENT):
        yield batch.slice(at, SENT)


def word_counts(df: DataFrame) -> DataFrame:
    """(lang, phrase, n) of every word."""

    def rows(counts: dict[str, Counter]) -> pa.RecordBatch:
        langs = [lang for lang, c in counts.items() for _ in c]
        words = pa.array([w for c in counts.values() for w in c], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), words, pa.array([n for c in counts.values() for n in c.values()], pa.int64())], names=["lang", "phrase", "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for lang, texts in texts_by_lang(batches):
            c = counts.setdefault(lang, Counter())
            for text in texts:
                c.update(split(text))
            del c[_BORDER]
            if sum(map(len, counts.values())) > HELD:
                yield from sent(rows(counts))
                counts = {}
        yield from sent(rows(counts))

    return df.mapInArrow(lean(counted), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def word_hash(lang: str) -> Callable[[bytes], int]:
    """The hash of a word of a language: what Spark's xxhash64(lang, word) gives, unsigned."""
    seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 42)
    return lambda word: xxhash.xxh64_intdigest(word, seed)


def bit_filter(hashes: DataFrame) -> np.ndarray:
    """The fixed number of 2^FILTER_BITS bits, as 64-bit words, with a bit set for each ``h``. At most 2^(FILTER_BITS - 6) rows reach the driver."""
    at = F.shiftright(F.col("h"), 6).bitwiseAND(F.lit((1 << (FILTER_BITS - 6)) - 1))
    bit = F.expr("shiftleft(1L, CAST(h & 63 AS INT))")
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    found = hashes.groupBy(at.alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h >> np.uint64(6)) & np.uint64(len(bits) - 1)
    return (bits[at.astype(np.int64)] >> (h & np.uint64(63)) & np.uint64(1)).astype(bool)


class Coded:
    """Words as ids of a dictionary (id 0 is the border), and the places and hashes of pairs whose words may both be frequent.

    Words become ids text by text: as objects those of all texts would take ten times their bytes.
    """

    def __init__(self, lang: str, texts: list[str], frequent: np.ndarray):
        known: dict[bytes, int] = defaultdict(count().__next__)
        ids = array("q", [known[_BORDER]])
        for text in texts:
            ids.extend(map(known.__getitem__, split(text)))
            ids.append(0)
        self.ids = np.frombuffer(ids, np.int64)
        self.words = list(known)
        hashes = np.fromiter(map(word_hash(lang), self.words), np.uint64, len(self.words))
        able = passes(frequent, hashes)
        able[0] = False
        a, b = self.ids[:-1], self.ids[1:]
        self.at = np.flatnonzero(able[a] & able[b])
        self.h = mixed(hashes[a[self.at]], hashes[b[self.at]])

    def keep(self, bits: np.ndarray) -> np.ndarray:
        """Narrows places and hashes to phrases one word longer, both of whose ends pass; returns the places of those that pass."""
        ok = passes(bits, self.h)
        at, h = self.at[ok], self.h[ok]
        both = np.flatnonzero(at[1:] == at[:-1] + 1)
        self.at, self.h = at[both], mixed(h[both], h[both + 1])
        return at


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    z = (a * np.uint64(0x9E3779B97F4A7C15)) ^ b
    z = (z ^ (z >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return z ^ (z >> np.uint64(29))


def frequent_hashes(df: DataFrame, words: Broadcast, shorter: list[Broadcast], least: int) -> DataFrame:
    """(h): hashes of phrases of len(shorter) + 2 words that occur ``least`` times; collisions can only add to them.

    A task passes sums over its texts on, whenever it holds HELD of them.
    """

    def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        h, at = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
        return h, np.bincount(at, weights=np.concatenate([n for _, n in parts])).astype(np.int64)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        rows = lambda x: pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1])], names=["h", "n"])
        for lang, texts in texts_by_lang(batches):
            c = Coded(lang, texts, words.value)
            for bits in shorter:
                c.keep(bits.value)
            parts.append(np.unique(c.h, return_counts=True))
            if sum(len(h) for h, _ in parts) > 4 * HELD:
                parts = [summed(parts)]
                if len(parts[0][0]) > 2 * HELD:
                    yield from sent(rows(parts[0]))
                    parts = []
        if parts:
            yield from sent(rows(summed(parts)))

    return df.mapInArrow(lean(counted), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("h")


def _summed(parts: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    """(lang, phrase, n) with one row for equal phrases of a language."""
    if not parts:
        return []
    out = pa.Table.from_batches(parts).group_by(["lang", "phrase"], use_threads=False).aggregate([("n", "sum")])
    return out.select(["lang", "phrase", "n_sum"]).rename_columns(["lang", "phrase", "n"]).combine_chunks().to_batches()


def windows(df: DataFrame, words: Broadcast, pairs: Broadcast, triples: Broadcast, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, n): from each place on the words that follow, up to ``longest`` and while they may be frequent pairs and triples.

    Equal windows of a task are one row with their number (of what it holds, where it holds more than HELD). A task reads as many texts as
    there are for two tasks a core: a frequent phrase is a row of nearly each task, so more tasks would mean more rows. Every frequent
    phrase begins as many windows as it occurs; a word begins at most one.
    """
    tasks = 2 * df.sparkSession.sparkContext.defaultParallelism

    def found_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in texts_by_lang(batches):
            c = Coded(lang, texts, words.value)
            at = c.keep(pairs.value)
            if not len(at):
                continue
            linked = np.zeros(len(c.ids) + longest, bool)
            linked[c.keep(triples.value)] = True
            ids = np.concatenate([c.ids, np.zeros(longest, np.int64)])
            columns, open_ = [ids[at], ids[at + 1]], np.ones(len(at), bool)
            number, _ = pd.factorize(ids[at] * len(c.words) + ids[at + 1])
            for k in range(2, longest):
                open_ = open_ & linked[at + k - 2]
                columns.append(np.where(open_, ids[at + k], 0))
                number, _ = pd.factorize(number * len(c.words) + columns[-1])
            _, first, n = np.unique(number, return_index=True, return_counts=True)
            names = pa.array(c.words[1:], pa.binary()).cast(pa.string())
            parts = [names.take(pa.array(x[first] - 1, mask=x[first] == 0)) for x in columns]
            phrase = pc.binary_join_element_wise(*parts, " ", null_handling="skip")
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), phrase, pa.array(n)], names=["lang", "phrase", "n"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        for part in found_in(batches):
            parts.append(part)
            if sum(map(len, parts)) > 3 * HELD:
                parts = _summed(parts)
                give_back()
                if sum(map(len, parts)) > 2 * HELD:
                    for x in parts:
                        yield from sent(x)
                    parts = []
        for x in _summed(parts):
            yield from sent(x)

    return df.coalesce(tasks).mapInArrow(lean(cut), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def grown(prefix: list[str], pointers: list[int], words: list[list[str]], n: list[int], least: int, longest: int) -> Iterator[tuple[str, int]]:
    """(phrase, count) of every frequent phrase that begins with ``prefix`` and is longer, depth first.

    ``pointers`` are the rows of the projected table: windows that begin with the prefix. The rows of each next word are the
    projection of the longer prefix.
    """
    ahead: dict[str, list[int]] = {}
    for p in pointers:
        if len(words[p]) > len(prefix):
            ahead.setdefault(words[p][len(prefix)], []).append(p)
    for word, own in ahead.items():
        f = sum(n[p] for p in own)
        if f >= least:
            longer = [*prefix, word]
            yield " ".join(longer), f
            if len(longer) < longest:
                yield from grown(longer, own, words, n, least, longest)


def _head(k: int) -> Column:
    return F.substring_index("phrase", " ", k)


def phrase_counts(found: DataFrame, scratch: Scratch, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, n) of each phrase of two words or more that occurs ``least`` times, from the windows ``found``.

    One task grows a prefix. A prefix of two words with more than a ten-thousandth of all windows is split into those of three words, and
    so on to whole windows: at most 10,000 such prefixes can exist, so their names are all that reaches the driver, and
    the counts of the prefixes that are split are sums over all tasks.
    """
    hot = max(500, found.count() // 10_000)
    length = F.size(F.split("phrase", " "))
    rows, open_, done = found.withColumn("length", length), found.withColumn("length", length), []
    depth = F.lit(2)
    for k in range(2, longest):
        sizes = open_.where(F.col("length") >= k).groupBy("lang", _head(k).alias("head")).agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")).where(F.col("rows") > hot)
        sizes = scratch.table(sizes, f"hot-{k}")
        names = [r.name for r in sizes.select(F.concat_ws(" ", "lang", "head").alias("name")).collect()]
        if not names:
            break
        done.append(sizes.where(F.col("n") >= least).select("lang", F.col("head").alias("phrase"), "n"))
        is_hot = F.concat_ws(" ", F.col("lang"), _head(k)).isin(names)
        open_, depth = open_.where(is_hot), F.when(is_hot & (depth == k), k + 1).otherwise(depth)

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def group(key: tuple[str, str], words: list[list[str]], n: list[int]) -> Iterator[tuple[str, str, int]]:
            lang, head = key
            if (f := sum(n)) >= least:
                yield lang, head, f
                for phrase, count in grown(head.split(" "), [*range(len(n))], words, n, least, longest):
                    yield lang, phrase, count

        def flush(out: list[tuple[str, str, int]]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=["lang", "phrase", "n"])

        key, words, n, out = None, [], [], []
        for b in batches:
            for lang, head, phrase, count in zip(*(b.column(c).to_pylist() for c in ("lang", "head", "phrase", "n")), strict=True):
                if key != (lang, head):
                    if key:
                        out += group(key, words, n)
                    key, words, n = (lang, head), [], []
                words.append(phrase.split(" "))
                n.append(count)
            yield flush(out)
            out = []
        yield flush([*group(key, words, n)] if key else [])

    keyed = rows.withColumn("depth", depth).where("length >= depth").select("lang", F.expr("substring_index(phrase, ' ', depth)").alias("head"), "phrase", "n")
    mined = keyed.repartition("lang", "head").sortWithinPartitions("lang", "head").mapInArrow(lean(mine), "lang string, phrase string, n long")
    for more in done:
        mined = mined.unionByName(more)
    return mined


def scored(candidates: DataFrame, counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the candidates: the cut with the lowest score, ties to the earliest."""
    words = F.split("phrase", " ")
    cut = candidates.select("lang", "phrase", F.col("n").alias("a"), words.alias("w")).select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    part = lambda start, length: F.array_join(F.slice("w", start, length), " ")
    cut = cut.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.size("w") - F.col("k")).alias("right"))
    for name, out in (("left", "l"), ("right", "r")):
        cut = cut.join(counts.select("lang", F.col("phrase").alias(name), F.col("n").alias(out)), ["lang", name])
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    cut = cut.join(totals, "lang").withColumn("above", (F.lit(1000).cast("decimal(4,0)") * exact("a")).cast("decimal(19,0)") * exact("n")).withColumn("below", exact("l") * exact("r"))
    cut = cut.withColumn("score", F.expr("above div below"))
    best = cut.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    return best.select("lang", "phrase", "a", "m.l", "m.r", "n", "m.score")


def collocations(df: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's ``top`` phrases of 2 to ``longest`` words in the rows of ``df`` (text, lang).

    Words, pairs of words that may be frequent, triples of such pairs, then windows of these are counted over all texts, each with
    sums in the tasks before rows move; a prefix's windows go to one task, which grows it depth first (a hot prefix is split into
    longer ones). Counts are exact: the filters can only let too much through. A phrase inside a longer one that occurs as often goes: it is
    enough to look at phrases one word longer, as counts can't rise with length. A null text is empty; a null
    lang is ``und``; repeated rows count each; other columns are ignored; an empty table, or one without a frequent phrase, gives no rows.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "collocations")
    docs = df.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    with batches_of(spark, BLOCK):
        counted = scratch.table(word_counts(docs), "words")
        totals = scratch.table(counted.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
        words = counted.where(F.col("n") >= least)
        able = spark.sparkContext.broadcast(bit_filter(words.select(F.xxhash64("lang", "phrase").alias("h"))))
        shorter = []
        for _ in range(2):
            shorter.append(spark.sparkContext.broadcast(bit_filter(frequent_hashes(docs, able, shorter, least))))
        found = scratch.table(windows(docs, able, *shorter, longest), "windows")
        phrases = scratch.table(phrase_counts(found, scratch, least, longest), "phrases")
    w = F.split("phrase", " ")
    ends = F.explode(F.array(F.array_join(F.slice(w, F.lit(1), F.size(w) - 1), " "), F.array_join(F.slice(w, F.lit(2), F.size(w) - 1), " ")))
    inside = phrases.where(F.size(w) > 2).select("lang", ends.alias("phrase"), F.col("n").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = phrases.join(inside, ["lang", "phrase"], "left").where("longer IS NULL OR longer < n").select("lang", "phrase", "n")
    rows = scratch.table(scored(kept, words.unionByName(phrases), totals), "scored")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase")))
    out = rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
lists AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase
    FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM lists, (SELECT unnest(range(1, 6)) AS m))),
f AS (SELECT lang, m, phrase, count(*) AS n FROM grams GROUP BY ALL HAVING count(*) >= 100),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM lists GROUP BY lang),
inner_ AS (SELECT DISTINCT s.lang, s.phrase FROM f s JOIN f b ON s.lang = b.lang AND b.m > s.m AND b.n >= s.n
    AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' ') WHERE s.m > 1),
cand AS (SELECT lang, m, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND (lang, phrase) NOT IN (SELECT (lang, phrase) FROM inner_)),
cuts AS (SELECT lang, phrase, a, k, array_to_string(w[: k], ' ') AS x, array_to_string(w[k + 1 :], ' ') AS y FROM (SELECT *, unnest(range(1, m)) AS k FROM cand)),
scores AS (SELECT c.lang, c.phrase, c.a, k, p.n AS l, q.n AS r, t.n AS n, ((1000::HUGEINT * c.a * t.n) // (p.n::HUGEINT * q.n))::BIGINT AS score
    FROM cuts c JOIN f p ON p.lang = c.lang AND p.phrase = x JOIN f q ON q.lang = c.lang AND q.phrase = y JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""

"""Importance resampling towards a target text set: hashed n-gram features through an integer word dictionary."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, gapless, with_counts

WORDS_A_FEATURE, BUCKETS = 2, 10_000
SEED, LEAST_WORDS, PERCENT = 7, 20, 25
#: Bytes of text whose words share a dictionary. A longer text has one of its own.
BLOCK = 8 << 20
#: A-Z become a-z; other ASCII characters that aren't digits or letters become blanks; bytes of other characters stay.
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


class Dictionary(dict):
    """Words to ids 0, 1, 2, ... in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def words_of(text: str | None) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text, A-Z lowered."""
    return text.encode("utf-8", "surrogatepass").translate(_CLEAN).split() if text else []


class Features:
    """The n-grams of a block of texts as tuples of word ids; the bytes of each distinct tuple are hashed once.

    A distinct tuple has a number: that of its first words (a shorter distinct tuple) and its last word make the next.
    ``levels`` holds for each n the numbers of all occurrences in order, their documents, and the bucket of each distinct tuple.
    """

    def __init__(self, texts: list[str | None], most: int = WORDS_A_FEATURE, buckets: int = BUCKETS):
        split = [words_of(t) for t in texts]
        self.n_words = np.fromiter(map(len, split), np.int64, len(split))
        known = Dictionary()
        ids = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64, int(self.n_words.sum()))
        words = list(known)
        doc = np.repeat(np.arange(len(split)), self.n_words)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        crc, number = list(map(zlib.crc32, words)), ids
        for n in range(1, most + 1):
            if n > 1:
                inside = doc[n - 1 :] == doc[: len(doc) - n + 1]
                code, pairs = pd.factorize(number[: len(doc) - n + 1] * len(words) + ids[n - 1 :])
                # Occurrences across a border are numbered too, so that places stay aligned; they aren't counted.
                first, last = (pairs // max(1, len(words))).tolist(), (pairs % max(1, len(words))).tolist()
                opened = map(zlib.crc32, repeat(b" "), map(crc.__getitem__, first))
                crc, number = list(map(zlib.crc32, map(words.__getitem__, last), opened)), code
                self.levels.append((number[inside], doc[n - 1 :][inside], np.array(crc, np.int64) % buckets))
            else:
                self.levels.append((number, doc, np.array(crc, np.int64) % buckets))

    def counts(self, buckets: int = BUCKETS) -> np.ndarray:
        """Occurrences in each bucket: the counts of distinct tuples, joined to their buckets."""
        out = np.zeros(buckets, np.int64)
        for number, _, bucket in self.levels:
            np.add.at(out, bucket, np.bincount(number, minlength=len(bucket)))
        return out

    def sums(self, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each document its number of features and the sum of their gains (exact: whole numbers below 2^53)."""
        n, total = np.zeros(len(self.n_words), np.int64), np.zeros(len(self.n_words))
        for number, doc, bucket in self.levels:
            n += np.bincount(doc, minlength=len(n))
            total += np.bincount(doc, weights=gains[bucket][number], minlength=len(n))
        return n, total.astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """The batches in slices of about BLOCK bytes of text."""
    for b in batches:
        size, start = b.column("text").nbytes, 0
        step = max(1, len(b) * BLOCK // max(1, size))
        while start < len(b):
            part = b.slice(start, step)
            yield part, part.column("text").to_pylist()
            start += step


def bucket_counts(df: DataFrame, most: int = WORDS_A_FEATURE, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all texts of ``df`` fall into each bucket; buckets without any are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, texts in _blocks(batches):
            total += Features(texts, most, buckets).counts(buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return df.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each of the B buckets."""
    b, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    ratio = [float((t + 1) * (s_all + b)) / float((s + 1) * (t_all + b)) for s, t in zip(source.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def weighted(df: DataFrame, gains: np.ndarray, most: int = WORDS_A_FEATURE) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row: the floored mean gain of its features, 0 without any."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _blocks(batches):
            found = Features(texts, most, len(gains))
            n, total = found.sums(gains)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, (found.n_words, n, total // np.maximum(n, 1)))], names=["doc_id", "n_words", "n_features", "weight"])

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(score, "doc_id long, n_words long, n_features long, weight long")


def resample(df: DataFrame, target: DataFrame, percent: int = PERCENT, most: int = WORDS_A_FEATURE, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each row of ``df`` (doc_id, text), drawn towards the texts of ``target``.

    Words get ids within a block of BLOCK bytes, n-grams are tuples of ids, and the bytes of a block's distinct tuples are hashed once;
    counts are joined back by number. Only ``buckets`` counts of each side reach the driver, whatever the input. The score is the
    weight plus Gumbel noise from doc_id and seed; floor(percent * N / 100) of the N rows with ``least_words`` words have a
    rank, by score, then smaller doc_id (a null last), fewer features, smaller weight; the rank of the others is null. Rows are numbered
    in ranges of that order, so no task holds them all. A null text has no word; a null doc_id draws its noise as the text
    ``<seed>:``; repeated rows are drawn each; extra columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(df.sparkSession, "importance")
    source, wanted = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for side, out in ((df, source), (target, wanted)):
        for r in bucket_counts(side, most, buckets).collect():
            out[r.bucket] = r.n
    rows = weighted(df, gains_of(source, wanted), most)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = scratch.table(rows.withColumn("score", F.col("weight") + noise), "scored")
    able = F.col("n_words") >= least_words
    drawn = percent * scored.where(able).count() // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
    ranged = scored.where(able).withColumn("one", F.lit(0).cast("long")).repartitionByRange(*order).sortWithinPartitions(*order)
    ranked = gapless(scratch.table(with_counts(ranged, "one"), "ranked"), "one", "before_it")
    place = F.when(F.col("before_it") < drawn, F.col("before_it") + 1)
    names = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*names, place.alias("rank")).unionByName(scored.where(~able).select(*names, F.lit(None).cast("long").alias("rank")))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: The CRC-32 of a feature goes byte by byte through a table that is itself made by the rule of its polynomial.
OP12_SQL = r"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
src AS (SELECT 0 AS side, row_number() OVER () AS rid, doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
split AS (SELECT side, rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM src),
feats AS (SELECT side, rid, unnest(w) AS f FROM split
    UNION ALL SELECT side, rid, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM split),
counted AS (SELECT side, rid, f, count(*) AS n FROM feats GROUP BY ALL),
names AS (SELECT f, hex(encode(f)) AS h FROM counted GROUP BY f),
hashed AS (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda k: ('0x' || substr(h, 2 * k + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM names, crc),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t FROM counted JOIN hashed USING (f) GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000))::DOUBLE / ((s + 1) * (sum(t) OVER () + 10000))::DOUBLE))::BIGINT AS g FROM sums),
per AS (SELECT rid, sum(n)::BIGINT AS n_features, sum(n * g)::BIGINT AS total FROM counted JOIN hashed USING (f) JOIN gains USING (bucket) WHERE side = 0 GROUP BY rid),
docs AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(floor(total / n_features), 0)::BIGINT AS weight,
    ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM split LEFT JOIN per USING (rid) WHERE side = 0),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM docs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place, count(*) FILTER (n_words >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * n // 100 THEN place END::BIGINT AS rank FROM ranked
"""

"""Phrase collocations against a plain count of all phrases."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import collocations as C
from gridloom.llm.common import batches_of


def plainly(rows, least, longest, top):
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    cand = {k: n for k, n in f.items() if n >= least and len(k[1]) > 1}
    within = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
    out = {}
    for (lang, p), a in cand.items():
        if any(lg == lang and len(q) > len(p) and 100 * n >= 100 * a and within(p, q) for (lg, q), n in cand.items()):
            continue
        cuts = [(1000 * a * total[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for lang, all_ in out.items() for i, (s, a, p, l, r) in enumerate(sorted(all_)[:top]))


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "of", "a-b", "ab", "a\x01b", "éa", "Éa", "x\x1cy", "no", "yes", "so"]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randint(0, 40)):
            w.append(rng.choice(words if rng.random() < 0.7 else [f"r{rng.randint(0, 400)}"]))
            if rng.random() < 0.2:
                w += ["in", "order", "to", "do", "it"]
        rows.append((rng.choice([" ", "  ", "\t"]).join(w).replace("no", "no" + rng.choice([".", "\n", ";", "", "?x"])), rng.choice(["en", "en", "fr", None, "und", "x y"])))
    return [*rows, (None, "en"), ("", "fr"), (None, None), ("...", "de")]


@pytest.mark.parametrize("least,longest,top", [(8, 5, 2000), (3, 3, 7), (15, 5, 1)])
def test_against_plain_counts(spark, least, longest, top):
    rows = corpus(least, 300)
    df = spark.createDataFrame([(t, g, "p", 5) for t, g in rows], "text string, lang string, phrase string, n int").repartition(4)
    got = C.collocations(df, least, longest, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = plainly(rows, least, longest, top)
    assert sorted(map(tuple, got.collect())) == want and len(want) >= 4


def test_hot_prefixes_are_split(spark):
    """Over 500 distinct windows of one prefix, and of one of its longer prefixes: counts stay exact."""
    rng = random.Random(2)
    rows = [(" ".join(rng.choice(["a", "b", "c", "d"]) if i % 3 else "a" for i in range(60)) + " a b " + " ".join(str(rng.randint(0, 40)) for _ in range(8)), "en") for _ in range(1500)]
    df = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(map(tuple, C.collocations(df, 5, 5, 3000).collect())) == plainly(rows, 5, 5, 3000)


def test_empty_tables(spark):
    assert C.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []
    assert C.collocations(spark.createDataFrame([("a b c", "en")], "text string, lang string")).collect() == []


def test_hash_is_that_of_spark(spark):
    rows = [("en", "word"), ("x y", "é"), ("", "a" * 100)]
    got = [r.h for r in spark.createDataFrame(rows, "a string, b string").select(F.xxhash64("a", "b").alias("h")).collect()]
    assert [h % 2**64 for h in got] == [C.word_hash(a)(b.encode()) for a, b in rows]
    assert xxhash.xxh64_intdigest(b"", 42) > 0


def test_large_numbers_are_exact(spark):
    big = 3_000_000_007
    cand = spark.createDataFrame([("en", "a b", big)], "lang string, phrase string, n long")
    counts = spark.createDataFrame([("en", "a", big + 9), ("en", "b", big + 1), ("en", "a b", big)], "lang string, phrase string, n long")
    totals = spark.createDataFrame([("en", 10**14 + 3)], "lang string, n long")
    assert C.scored(cand, counts, totals).first().score == 1000 * big * (10**14 + 3) // ((big + 9) * (big + 1))


def test_filters_of_one_word_only_spare_work(spark, monkeypatch):
    """With filters of 64 bits nearly everything passes: the counts stay exact."""
    monkeypatch.setattr(C, "FILTER_BITS", 6)
    rows = corpus(1, 120)
    df = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(map(tuple, C.collocations(df, 4, 5, 500).collect())) == plainly(rows, 4, 5, 500)


def test_a_task_sums_its_windows(spark, monkeypatch):
    """One row for equal windows of a task, not of a block of its texts; where it can't hold them all, the sums stay right."""
    monkeypatch.setattr(C, "BLOCK", 200)
    rows = [("in order to do it", "en")] * 300 + [("a b", "fr")] * 300
    df = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    ones = spark.sparkContext.broadcast(~np.zeros(1, np.uint64))
    out = C.windows(df, ones, ones, ones)
    want = {("en", p): 300 for p in ("in order to do it", "order to do it", "to do it", "do it")} | {("fr", "a b"): 300}
    assert {(r.lang, r.phrase): r.n for r in out.collect()} == want
    made = []
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, f, schema: made.append(f) or self)
    C.windows(df.withColumns({"phrase": F.col("text"), "n": F.lit(1)}), ones, ones, ones)
    batch = pa.RecordBatch.from_pydict({"lang": [g for _, g in rows], "text": [t for t, _ in rows]})
    assert sum(map(len, made[0](iter([batch, batch])))) == 5
    monkeypatch.setattr(C, "HELD", 1)
    parts = [*made[0](iter([batch, batch]))]
    total = Counter()
    for r in pa.Table.from_batches(parts).to_pylist():
        total[r["lang"], r["phrase"]] += r["n"]
    assert total == {k: 600 for k in want}


def test_collocations_asks_for_small_batches(spark, monkeypatch):
    """Its Python steps get batches of BLOCK bytes, not of 64 MB; afterwards the session's setting is as it was, also after a failure."""
    key, steps = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before, real = spark.conf.get(key), DataFrame.mapInArrow
    monkeypatch.setattr(C, "BLOCK", 1 << 16)
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, f, schema: steps.append(spark.conf.get(key)) or real(self, f, schema))
    df = spark.createDataFrame([("in order to do it", "en")] * 120, "text string, lang string")
    assert [r.phrase for r in C.collocations(df).collect()] == ["in order to do it"]
    assert len(steps) == 5 and set(steps) <= {"65536", "65536b"} and spark.conf.get(key) == before
    text = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("abc "), 100).alias("text"))
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches)
    with pytest.raises(ZeroDivisionError), batches_of(spark, 1 << 16):
        assert 20 < real(text, sizes, "n long").count() and real(text, sizes, "n long").agg(F.max("n")).first()[0] < 1 << 17
        1 / 0
    assert spark.conf.get(key) == before


@pytest.mark.parametrize("step", ["words", "pairs", "windows"])
def test_words_of_all_texts_are_never_held_as_objects(spark, monkeypatch, step):
    """A block of texts takes a few times its bytes in a task, not sixteen times; sums go out in small batches."""
    made = []
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, f, schema: made.append(f) or self)
    monkeypatch.setattr(C, "SENT", 2, raising=False)
    none = spark.sparkContext.broadcast(np.zeros(1, np.uint64))
    df = spark.createDataFrame([], "lang string, text string, phrase string, n long, h long")
    {"words": lambda: C.word_counts(df), "pairs": lambda: C.frequent_hashes(df, none, [none], 1), "windows": lambda: C.windows(df, none, none, none)}[step]()
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 2000, "text": [" ".join(f"a{(i * 7 + k) % 90}" for k in range(300)) for i in range(2000)]})
    tracemalloc.start()
    try:
        out = [*made[0](iter([batch]))]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 8 * batch.nbytes
    assert max(map(len, out), default=0) <= 2 and (step != "words" or sum(sum(x.column("n").to_pylist()) for x in out) == 600_000)

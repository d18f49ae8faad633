"""Importance resampling against a plain computation."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np

from gridloom.llm import importance as I


def features(text, most=2):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return len(w), [" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)]


def plainly(rows, target, percent=25):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = Counter(bucket(f) for _, x in rows for f in features(x)[1]), Counter(bucket(f) for x in target for f in features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    out = []
    for d, x in rows:
        n, f = features(x)
        weight = sum(gain(bucket(y)) for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    ranked = {i: k + 1 for k, i in enumerate(map(id, able[: percent * len(able) // 100]))}
    return sorted(((r[0], *r[2:], ranked.get(id(r))) for r in out), key=repr)


TEXTS = ["Ünï-code 7x wörter; the THE the", None, "", "!!! ...", "one", "a\x00b\x7fc`d{e/f:g", "汉字 汉字 ÀB àb"] + [" ".join(f"w{(i * j) % (5 + i)}" for j in range(15 + i)) for i in range(60)]


def test_against_plain_computation(spark):
    rows = [*enumerate(TEXTS), (None, TEXTS[30]), (None, TEXTS[31]), (5, TEXTS[40]), (5, TEXTS[40]), (2**53 + 1, TEXTS[50])]
    target = [TEXTS[20], TEXTS[0], None, "w1 w2 w3"]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, rank string, bucket int").repartition(5)
    got = I.resample(df, spark.createDataFrame([(x,) for x in target], "text string"))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == plainly(rows, target)
    ranks = sorted(r.rank for r in got.collect() if r.rank)
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) > 10


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert I.resample(empty, empty.select("text")).collect() == []
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [(r.n_features, r.weight, r.rank) for r in I.resample(one, empty.select("text")).collect()] == [(3, math.floor(1000 * math.log(10003 / 20000)), None)]


def test_blocks_and_longer_tuples():
    texts = [TEXTS[i] for i in (0, 5, 20, 21, 1, 22, 6)]
    found = I.Features(texts, 3)
    want = Counter(zlib.crc32(f.encode()) % 10000 for x in texts for f in features(x, 3)[1])
    counts = found.counts()
    assert {int(b): int(counts[b]) for b in np.flatnonzero(counts)} == dict(want)
    n, total = found.sums(np.arange(10000))
    assert n.tolist() == [len(features(x, 3)[1]) for x in texts]
    assert total.tolist() == [sum(zlib.crc32(f.encode()) % 10000 for f in features(x, 3)[1]) for x in texts]


def test_each_distinct_tuple_is_hashed_once(monkeypatch):
    calls = []

    class Z:
        @staticmethod
        def crc32(data, start=0):
            calls.append(data)
            return zlib.crc32(data, start)

    monkeypatch.setattr(I, "zlib", Z)
    I.Features(["a b a b a b"] * 100)
    assert len(calls) == 2 + 2 * 2  # the two words; the pairs "a b" and "b a", each a blank and a word (texts don't touch)

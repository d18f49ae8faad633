"""Vector packing against the same heuristic example by example, and against the tokens themselves."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.errors import PySparkException

from gridloom.llm import vector_packing as V


def one_by_one(demand, counts, limits):
    """The heuristic without kinds: each sequence as the sorted list of its examples."""
    items = [k for k, n in enumerate(counts) for _ in range(n)]
    mean = [sum(demand[k][d] / limits[d] for k in items) / len(items) for d in range(len(limits))]
    bins = []
    while items:
        room, own = list(limits), []
        while True:
            fit = [k for k in set(items) if all(demand[k][d] <= room[d] for d in range(len(limits)))]
            if not fit:
                break
            best = max(fit, key=lambda k: (round(sum(mean[d] * demand[k][d] / limits[d] * room[d] / limits[d] for d in range(len(limits))), 12), -k))
            items.remove(best)
            own.append(best)
            room = [r - x for r, x in zip(room, demand[best])]
        bins.append(tuple(sorted(own)))
    return Counter(bins)


def test_plan_is_the_heuristic():
    rng = random.Random(3)
    for _ in range(30):
        kinds = sorted({(rng.randint(1, 40), 1, rng.randint(0, 12)) for _ in range(rng.randint(1, 12))}, reverse=True)
        counts, limits = [rng.randint(1, 30) for _ in kinds], (64, 6, 20)
        bins = {}
        for kind, first, end, start, each, offset in V.plan_vectors(np.array(kinds), np.array(counts), limits):
            for k in range(end - first):
                bins.setdefault(start + k // each, []).append((kind, offset + k % each * kinds[kind][0], first + k))
        assert Counter(x for b in bins.values() for x in ((k, n) for k, _, n in b)) == Counter((k, n) for k, c in enumerate(counts) for n in range(c))
        for own in bins.values():
            at = 0
            for kind, offset, _ in sorted(own, key=lambda x: x[1]):
                assert offset == at
                at += kinds[kind][0]
            assert all(sum(kinds[k][d] for k, _, _ in own) <= limits[d] for d in range(3))
        assert sorted(bins) == list(range(len(bins)))
        assert Counter(tuple(sorted(k for k, _, _ in own)) for own in bins.values()) == one_by_one(kinds, counts, limits)


def test_runs_follow_kinds_not_examples():
    demand = np.array([(n, 1, n // 2) for n in range(1024, 0, -1)])
    few, many = (len(V.plan_vectors(demand, np.full(1024, n), (1024, 32, 1024))) for n in (1000, 1_000_000))
    assert many < 2 * few < 100_000


def test_instruction_data(spark):
    """Examples with prompts: loss and segments bind before tokens do; extra columns stay whatever their names."""
    rng = random.Random(4)
    rows = [(i, rng.randint(1, 200), rng.choice([None, -1, rng.randint(0, 100)]), f"p{i}", i) for i in range(400)]
    rows += [(400 + i, 1, 0, None, None) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, tokens int, loss int, part string, kind int")
    got = V.pack_vectors(df, (512, 8, 128)).collect()
    assert Counter(r.id for r in got) == Counter(r[0] for r in rows)
    assert got[0].asDict().keys() == {"id", "tokens", "loss", "part", "kind", "sequence_id", "offset"}
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        assert sum(r.tokens for r in own) <= 512 and len(own) <= 8 and sum(max(0, r.loss or 0) for r in own) <= 128
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.tokens
    loss = sum(max(0, r.loss or 0) for r in got)
    assert len(by) <= 1.6 * max(sum(r.tokens for r in got) / 512, len(got) / 8, loss / 128)
    assert V.pack_vectors(df.limit(0)).collect() == []
    for bad in ((1, None, 0), (1, 0, 0), (1, 600, 0), (1, 5, 129)):
        with pytest.raises(PySparkException):
            V.pack_vectors(spark.createDataFrame([bad], "id long, tokens int, loss int"), (512, 8, 128)).collect()


def test_documents_come_back(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(5)
    texts = [None, "", "a", "x " * 1023, "x " * 1024, " ".join(str(rng.random()) for _ in range(900)), "<|endoftext|> b"] + ["word " * rng.randint(1, 500) for _ in range(60)]
    rows = [(i, t, "z", 1) for i, t in enumerate(texts)] + [(None, "same", "z", 1), (3, "same", "z", 1), (3, "same", "z", 1), (2**53 + 1, "b", "z", 1)]
    got = V.pack_pieces(spark.createDataFrame(rows, "doc_id long, text string, part string, tokens int")).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, t in [(i, t) for i, t in enumerate(texts) if i != 3] + [(2**53 + 1, "b")]:
        ids = np.array([*slow.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert len([r for r in by_doc[3] if r.doc_tokens == 2]) == 2 and len(by_doc[None]) == 1
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and len(own) <= V.SEGMENTS
    assert V.pack_pieces(spark.createDataFrame([], "doc_id long, text string")).collect() == []

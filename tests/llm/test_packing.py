import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridloom.llm.packing import CapacityTree, pack_documents, plan_bins
from gridloom.llm.tokens import encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, sequence_id string, piece string"


def plain_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(30))
def test_plan_equals_best_fit_piece_by_piece(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 32, 100])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 120))]
    counts = {n: lengths.count(n) for n in lengths}
    used = {}
    for length, first, end, bin_, each, offset in plan_bins(counts, capacity):
        for k in range(end - first):
            used.setdefault(bin_ + k // each, []).append((offset + k % each * length, length))
    for places in used.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
    assert sorted(n for p in used.values() for _, n in p) == sorted(lengths)
    assert sorted(capacity - sum(n for _, n in p) for p in used.values()) == plain_best_fit(lengths, capacity)


def test_tree_finds_the_tightest():
    tree = CapacityTree(20)
    for r in (3, 7, 20):
        tree.set(r, True)
    assert [tree.tightest(x) for x in (1, 3, 4, 8, 20)] == [3, 3, 7, 20, 20]
    tree.set(20, False)
    assert tree.tightest(8) is None


def test_ids_equal_the_library():
    slow, fast = Tokenizer.from_file(PATH), encoder(PATH)
    for t in ["", " ", "a  b\n c", "it's", "über\tö", "x <|endoftext|> y", "日本 語", "1 2 !!", " a"]:
        assert fast.ids(t).tolist() == slow.encode(t, add_special_tokens=False).ids


def test_pieces_cover_documents_and_sequences_have_no_gaps(spark):
    rows = [(1, "one two three", "x", "y"), (2, None, None, None), (3, "", "x", "y"), (4, "word " * 3000, "x", "y"), (None, "no id", "x", "y"), (1, "one two three", "x", "y")]
    rows += [(10 + i, "same text here", None, None) for i in range(40)]
    got = [r.asDict() for r in pack_documents(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()]
    slow = Tokenizer.from_file(PATH)
    ids = np.array([*slow.encode("word " * 3000, add_special_tokens=False).ids, 2], "<u4")
    long = sorted((r for r in got if r["doc_id"] == 4), key=lambda r: r["piece"])
    assert [r["piece"] for r in long] == list(range(len(long))) and sum(r["length"] for r in long) == len(ids)
    assert all(r["length"] == 1024 for r in long[1:])
    assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in long)
    assert len([r for r in got if r["doc_id"] != 4]) == len(rows) - 1
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(by) == len(plain_best_fit([r["length"] for r in got], 1024))


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], SCHEMA)).count() == 0

import hashlib
import random

import pytest

from gridloom.llm import suffix_dedup as S

SCHEMA = "doc_id long, text string, n_removed string, _kind int, n_chars long"


def brute(rows):
    """Rows (doc_id, text): the contract, window by window."""
    m, least = S.MATCH, {}
    data = [(d, (t or "").encode()) for d, t in rows]
    for d, t in data:
        if d is not None:
            for i in range(len(t) - m + 1):
                w = t[i : i + m]
                least[w] = min(least.get(w, d), d)
    out = []
    for d, t in data:
        gone = bytearray(len(t))
        if d is not None:
            for i in range(len(t) - m + 1):
                if least[t[i : i + m]] < d:
                    gone[i : i + m] = b"\1" * m
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    text = lambda k: " ".join(word() for _ in range(k))
    shared = [text(rng.randint(8, 40)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [text(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 3)
            parts += [s[a : a + rng.randint(30, 200)], text(rng.randint(0, 9))]
        t = " ".join(parts)
        if rows and rng.random() < 0.3:
            t = rng.choice(rows)[1] or ""
            if rng.random() < 0.6 and len(t) > 4:
                k = rng.randrange(len(t))
                t = t[:k] + "#" + t[k + 1 :]
        rows.append((rng.randrange(3 * n), t))
    return rows + [(None, shared[0] * 3), (5, None), (6, ""), (7, "a" * 200), (8, "a" * 60), (9, "ab" * 100), rows[0], (rows[1][0], rows[2][1])]


def rows_of(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed,block", [(1, 4_000_000), (2, 2_000), (3, 700)])
def test_equals_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(S, "COLLECTION", 40)
    data = corpus(seed)
    df = spark.createDataFrame([(d, t, "x", 1, 3) for d, t in data], SCHEMA).repartition(3)
    work = S.remove_repeats(df, block_bytes=block)
    assert rows_of(work) == sorted(brute(data), key=repr)


def test_texts_and_columns(spark):
    p = "this passage is repeated across documents and is much longer than fifty bytes é"
    data = [(1, "first " + p, "x", 1, 85), (2, p + " second", "y", 2, 87), (3, None, None, None, None), (None, p, "z", 3, 80)]
    out = {r.doc_id: r for r in S.dedup_texts(spark.createDataFrame(data, SCHEMA)).collect()}
    assert list(out[1].asDict()) == ["doc_id", "text", "n_removed", "_kind", "n_chars"]
    assert out[1].text == "first " + p and out[2].text == " second" and out[2].n_chars == 7 and out[None].text == p
    assert out[2].n_removed == "y" and out[2]["_kind"] == 2


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert S.remove_repeats(none).count() == 0 and S.dedup_texts(none).count() == 0


def test_very_long_text(spark):
    t = " ".join(str(i * 7919) for i in range(120_000))
    data = [(2, t), (1, t[1000:500_000]), (3, "short")]
    got = {r[0]: r for r in rows_of(S.remove_repeats(spark.createDataFrame([(d, x, "", 1, 1) for d, x in data], SCHEMA)))}
    assert got[1][2] == 0 and got[2][2] == 499_000 and got[2][3] == 1


@pytest.mark.parametrize("rows", [[(1, "some text here"), (2, "x y")], [(1, None), (2, "")], [(None, None), (None, "a" * 80)], [(1, "b" * 49), (2, "b" * 49)], [(2**53 + 1, "é" * 60), (None, "é" * 60), (2**63 - 1, "é" * 60)]])
def test_short_empty_and_large_ids(spark, rows):
    df = spark.createDataFrame([(d, t, "x", 1, None) for d, t in rows], SCHEMA).coalesce(1)
    assert rows_of(S.remove_repeats(df)) == sorted(brute(rows), key=repr)
    out = S.dedup_texts(df)
    assert out.columns == df.columns and sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == sorted((d is None, d or 0) for d, _ in rows)


def test_hot_anchors_and_small_chunks(spark):
    """Windows of hot anchors are dealt out one by one; blocks of several parts."""
    data = corpus(7, 80)
    p = "a line that very many documents share, longer than any window of bytes is. "
    data += [(1000 + i, p + f"tail {i * 7919} {'z' * (i % 50)} {i}") for i in range(60)]
    df = spark.createDataFrame([(d, t, "x", 1, 3) for d, t in data], SCHEMA).repartition(3)
    want = sorted(brute(data), key=repr)
    assert rows_of(S.remove_repeats(df, block_bytes=900, hot=3)) == want == rows_of(S.remove_repeats(df, block_bytes=3_000))


def test_clashing_names(spark):
    p = "this passage is repeated across documents and is much longer than fifty bytes é"
    df = spark.createDataFrame([(1, p, 77, 2**53 + 1, "a.b"), (2, "x " + p, 88, None, None)], "doc_id long, text string, _block int, row long, `cut` string")
    out = {r.doc_id: r for r in S.dedup_texts(df).collect()}
    assert (out[1]["_block"], out[1]["row"], out[2]["_block"], out[2]["row"], out[2].text) == (77, 2**53 + 1, 88, None, "x ")


def test_each_window_goes_out_at_one_anchor(spark):
    """Of a shared text every window is cut once a document, of a text that nothing shares none is."""
    rng = random.Random(11)
    a, b = ("".join(rng.choice("abcdefgh ") for _ in range(3_000)) for _ in range(2))
    work = S.RepeatedStrings(spark.createDataFrame([(1, a), (2, a), (3, b)], "doc_id long, text string"))
    raw = [S.zstandard.decompress(r.data) for r in work.segments.where("kind = 1").collect()]
    windows = [S.np.frombuffer(x, "<i4").reshape(5, -1)[4].sum() for x in raw]
    assert sum(windows) == 2 * (3_000 - S.MATCH + 1)


def test_half_marked_anchors(spark):
    """Passages around the least length, at all offsets: of many anchors only one side is shared."""
    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    p = text(400)
    data = [(1, text(100) + p + text(100))]
    for i in range(60):
        at = rng.randrange(300)
        data.append((2 + i, text(rng.randrange(60)) + "#" + p[at : at + 48 + i % 20] + "#" + text(rng.randrange(60))))
    df = spark.createDataFrame([(d, t, "x", 1, 3) for d, t in data], SCHEMA)
    want = sorted(brute(data), key=repr)
    assert rows_of(S.remove_repeats(df)) == want == rows_of(S.remove_repeats(df, block_bytes=900, hot=2))

"""Quality rules, sharding, licences, SimHash and chat formatting against brute force and edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash

from gridloom.llm import chat_format as C
from gridloom.llm import quality_rules as Q
from gridloom.llm import sharding as J
from gridloom.llm import simhash as H
from gridloom.llm.components import connected_components
from gridloom.llm.common import Scratch
from gridloom.llm.licenses import license_scan

SCHEMA = "doc_id long, text string, kept string, shard string, fingerprint int"
WS = " \t\n\x0b\x0c\r"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", None, 1) for d, t in rows], SCHEMA)


ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "no id here"), (5, "same text"), (5, "same text"), (6, "é ü " * 3), (7, "word " * 30_000), (8, "#$% | <>\n#$% | <>\n")]


# quality rules


def plain_features(text):
    text = text or ""
    words, now = [], ""
    for ch in text + " ":
        if ch in WS:
            words += [now] if now else []
            now = ""
        else:
            now += ch
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if any(ch not in WS for ch in x)]
    return len(words), sum(map(len, words)), sum(ch in "#*$%&|<>" for ch in text), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a ", "b ", "cd ", "é\n", "#", "|\x0b", "Xy "]) for _ in range(rng.randint(0, 120))) for _ in range(40)]
    rows = [*enumerate(texts), *[r for r in ODD if r[0] != 7]]
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in Q.quality_report(frame(spark, rows)).collect()), key=repr)
    want = []
    for d, t in rows:
        f = plain_features(t)
        want.append((d, *f, f[0] < 50 or 100 * f[4] > 50 * f[0]))
    assert got == sorted(want, key=repr)


def test_verdict_does_not_depend_on_the_order_of_rules():
    rng = random.Random(4)
    vocab = [f"word{i}" for i in range(200)] + ["SHOUT!!", "###", "|", "12", "x" * 40]
    for _ in range(80):
        f = Q.Features(" ".join(rng.choice(vocab[rng.randrange(2) * 190 :]) for _ in range(120)))
        verdicts = {Q.cascade(f, tuple(rng.sample(Q.RULES, len(Q.RULES)))) is None for _ in range(6)}
        assert len(verdicts) == 1


def test_rules_are_ordered_by_rejection_per_cost():
    a, b, c = (Q.Rule(n, lambda f: False) for n in "abc")
    assert [r.name for r in Q.order_rules([(a, 0.1, 1.0), (b, 0.5, 2.0), (c, 0.0, 0.1)])] == ["b", "a", "c"]
    calls = []
    chain = (Q.Rule("first", lambda f: calls.append(1) or True), Q.Rule("second", lambda f: calls.append(2) or True))
    assert Q.cascade(Q.Features("x"), chain) == "first" and calls == [1]


def test_quality_filter_keeps_columns(spark):
    good = " ".join(f"plain{i} words" for i in range(60))
    df = frame(spark, [*ODD, (9, good), (9, good), (10, good.upper()), (11, "# | " * 10 + good)])
    kept = Q.quality_filter(df)
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [9, 9]
    assert Q.quality_report(frame(spark, [])).count() == 0 and Q.quality_filter(frame(spark, [])).count() == 0


# sharding


def plain_jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash():
    keys = np.random.default_rng(1).integers(0, 2**64, 3000, dtype=np.uint64)
    for n in (1, 2, 24, 25, 1000):
        assert J.jump_hash(keys, n).tolist() == [plain_jump(int(k), n) for k in keys]
    ids = J.mix64(np.arange(100_000, dtype=np.uint64))
    a, b = J.jump_hash(ids, 24), J.jump_hash(ids, 25)
    assert set(b[a != b]) == {24} and abs((a != b).mean() - 1 / 25) < 0.005
    assert np.bincount(a).max() < 1.1 * len(ids) / 24


def test_sharding(spark):
    rows = [*ODD, *((i, "t" * (i % 7)) for i in range(100, 400))]
    got = [r.asDict() for r in J.shard_documents(frame(spark, rows).repartition(5)).collect()]
    assert len(got) == len(rows)
    texts = {d: t or "" for d, t in rows}
    by = {}
    for r in got:
        t = texts[r["doc_id"]].encode()
        assert r["size"] == len(t) + 8 and r["text_crc32"] == zlib.crc32(t) and r["law"] == "key"
        assert r["grown_shard"] in (r["shard"], 24)
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert J.shard_documents(frame(spark, [])).count() == 0


# licences


def test_licenses(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\n"
    rows = [(20, "Text.\nReleased under the MIT License."), (21, "unfinished line\nLicensed under the Apache License, Version 2.0.\nmore"), (22, mit), (23, "Licensed under CC BY-NC 4.0. Released under the MIT  license! All rights reserved."), (24, "not released under the MIT licence at all")]
    got = {}
    for r in license_scan(frame(spark, [*ODD, *rows])).collect():
        got.setdefault(r.doc_id, []).append((r.n_statements, r.licenses, r.rules))
    assert got[20] == [(1, "MIT", "mit-released*1")]
    assert got[21] == [(1, "Apache-2.0", "apache-licensed*1")]
    assert got[22] == [(1, "MIT", "mit-grant*1")]
    assert got[23][0][:2] == (3, "All-Rights-Reserved,CC-BY-NC-4.0,MIT")
    assert got[24] == [(0, "", "")] and got[1] == [(0, "", "")] and len(got[5]) == 2
    assert license_scan(frame(spark, [])).count() == 0


def test_licenses_stay_native(spark):
    plan = license_scan(frame(spark, ODD))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# SimHash


def plain_fingerprint(text):
    words = (text or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(pairs):
    """(doc_id, fp) rows: union-find over all pairs."""
    root = list(range(len(pairs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(pairs):
        for j in range(i):
            if (a ^ pairs[j][1]).bit_count() <= 4:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    low = {}
    for i, (d, _) in enumerate(pairs):
        low[find(i)] = min(low.get(find(i), d), d)
    return [low[find(i)] for i in range(len(pairs))]


def test_fingerprints():
    rng = random.Random(5)
    for t in [None, "", " ", "One", "a b c", "A b C d", "é Ü ß x y", *(" ".join(rng.choice("abcXYZ") for _ in range(rng.randint(1, 60))) for _ in range(40))]:
        assert H.fingerprint(t) == plain_fingerprint(t)


def test_links_connect_what_all_pairs_connect():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**64, 12, dtype=np.uint64)
    fps = list(base)
    for _ in range(300):
        x = int(rng.choice(fps))
        for _ in range(rng.integers(0, 7)):
            x ^= 1 << int(rng.integers(0, 64))
        fps.append(np.uint64(x))
    fps = np.unique(np.array(fps, np.uint64))
    edges = [(int(a), int(b)) for x, y in H.spanning_links(fps, 4) for a, b in zip(x, y)]
    assert len(edges) < len(fps)
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(fps))] == plain_components(list(enumerate(map(int, fps))))


def test_simhash_components(spark):
    rng = random.Random(7)
    rows = [r for r in ODD if r[0] != 7]
    for i in range(30, 150):
        t = " ".join(rng.choice("abcdefghij") + str(rng.randrange(30)) for _ in range(rng.randint(1, 120)))
        if i > 40 and rng.random() < 0.6:
            words = rng.choice(rows[9:])[1].split() or ["x"]
            words[rng.randrange(len(words))] = "Edited"
            t = " ".join(words)
        rows.append((rng.randrange(1000), t))
    named = [(d, plain_fingerprint(t)) for d, t in rows if d is not None]
    want = sorted([(d, f"{f:016x}", c) for (d, f), c in zip(named, plain_components(named))] + [(None, f"{plain_fingerprint('no id here'):016x}", None)], key=repr)
    df = frame(spark, rows).repartition(3)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in H.simhash_components(df).collect()), key=repr)
    assert got == want
    kept = H.simhash_dedup(df)
    assert kept.columns == df.columns
    left = [(r.doc_id, f"{plain_fingerprint(r.text):016x}") for r in kept.collect()]
    assert len(left) == len(set(left)) and set(left) == {(d, f) for d, f, c in want if d == c}
    assert H.simhash_components(frame(spark, [])).count() == 0 and H.simhash_dedup(frame(spark, [])).count() == 0


def test_index_sets_and_count_filter():
    from itertools import combinations

    assert len(H.position_keys(4)) == 20
    for least in range(2, 9):
        assert all(any(set(k) <= set(w) for k in H.position_keys(least)) for w in combinations(range(8), least))
    rng = np.random.default_rng(12)
    base = rng.integers(0, 2**64, 400, dtype=np.uint64)
    three = base ^ np.uint64(0x1F1F1F1F1F << 24)  # three positional bytes in common, far apart
    four = base ^ np.uint64(0x01010101)  # four in common, four bits apart
    fps = np.concatenate([base, three, four])
    keys = H.list_keys(fps, 4)
    order = np.argsort(keys.reshape(-1), kind="stable")
    H.SEEN.update(tallied=0, kept=0, near=0)
    a, b = (np.concatenate(x) for x in zip(*H.list_links(keys.reshape(-1)[order], np.repeat(fps, keys.shape[1])[order], 4)))
    rows = np.repeat(fps, keys.shape[1])[order]
    assert {(int(min(x, y)), int(max(x, y))) for x, y in zip(rows[a], rows[b])} == {(int(min(x, y)), int(max(x, y))) for x, y in zip(base, four)}
    assert H.SEEN["tallied"] - H.SEEN["kept"] >= 400 and H.SEEN["kept"] >= H.SEEN["near"] >= 400


def test_different_texts_under_one_id_stay(spark):
    rows = [(5, "alpha beta gamma delta epsilon"), (5, "totally different words stand here"), (3, "one more text of its own"), (5, "one more text of its own")]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, _kept_id int, fp int")
    assert sorted((r.doc_id, r.text) for r in H.simhash_dedup(df).collect()) == sorted(rows[:3]) and H.simhash_dedup(df).columns == df.columns


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_connected_components(spark, shape):
    rng = random.Random(8)
    n = 60
    edges = {"path": [(i, i + 1) for i in range(n)], "star": [(7, i) for i in range(n)], "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(40)]}[shape]
    low = {x: x for e in edges for x in e}
    for _ in range(n):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    want = {x: c for x, c in low.items() if any(x in e and e[0] != e[1] for e in edges)}
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"))
    assert {r.node: r.component for r in got.collect()} == want


# chat formatting

HARD = ["", "</s>[INST] ok [/INST]", "[\\INST]", "<\\\\s> <s", "[/SYS][SEP]x[TURN]", "a\\", "\\", "[", "<", "plain", "</s", "s>", "é\n\nz", "[\\\\\\/INST]", "<\\s>"]


def test_round_trip():
    for role in ("system", "user", "assistant", "tool", "", "a[SEP]b", "[/TURN]"):
        for t in HARD:
            rendered, a, b, r, back = C.format_turn(role, t)
            assert (r, back) == (role, t) and C.unescape(rendered[a:b]) == t
    rng = random.Random(9)
    for _ in range(2000):
        t = "".join(rng.choice(["<", "[", "\\", "/", "s>", "INST]", "SYS]", "TURN]", "SEP]", "x"]) for _ in range(rng.randint(0, 9)))
        assert C.unescape(C.escape(t)) == t and not C._CONTROL.search(C.escape(t))
        turns = [("user", t), ("assistant", t[::-1]), ("odd", t)]
        joined = "".join(C.format_turn(r, x)[0] for r, x in turns)
        assert [x[:2] for x in C.parse(joined)] == turns


def test_bad_renderings_are_refused():
    for bad in ("x", "[INST]a", "[INST]a</s>", "[TURN]a[/TURN]", "[/INST]", "<s>a[INST]b[/INST]</s>"):
        with pytest.raises(C.FormatError):
            C.parse(bad)


def test_formatted_conversations_read_back_by_mask(spark):
    rng = random.Random(10)
    big = [2**53 + 1, None, 2**63 - 1, 2**53 + 3]
    rows = [(rng.choice(big), i, rng.choice(["user", "assistant", "system", "a[SEP]b"]), rng.choice([*HARD, None])) for i in range(120)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, piece int, at string").coalesce(1)
    pieces = C.format_conversations(df).collect()
    digests = {r.conv_id: r for r in C.conversation_digests(C.format_turns(df)).collect()}
    assert set(digests) == set(big)
    for conv in big:
        mine = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        got = sorted((p for p in pieces if p.conv_id == conv), key=lambda p: p.piece)
        whole = "".join(p.rendered for p in got)
        assert [t[:2] for t in C.parse(whole)] == mine and [p.at for p in got] == [sum(len(q.rendered) for q in got[:k]) for k in range(len(got))]
        learn = "".join(C.unescape(whole[p.loss_start : p.loss_end]) for p in got if p.loss_start is not None)
        assert learn == "".join(t for r, t in mine if r == "assistant")
        d = digests[conv]
        assert (d.n_turns, d.loss_chars, d.formatted_chars) == (len(mine), len(learn), len(whole))
        assert d.loss_sha256 == hashlib.sha256(learn.encode()).hexdigest() and d.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in mine).encode()).hexdigest()


BIG = [2**53 + 1, None, 2**63 - 1, 2**53 + 3]


def test_ids_keep_their_digits(spark):
    from gridloom.llm.packing import pack_documents

    df = spark.createDataFrame([(i, "some text here " * 20) for i in BIG], "doc_id long, text string").coalesce(1)
    for got in (Q.quality_report(df), Q.quality_filter(df), J.shard_documents(df), H.simhash_components(df), license_scan(df), pack_documents(df)):
        assert {r.doc_id for r in got.collect()} <= set(BIG)
    for got in (Q.quality_report(df), J.shard_documents(df), H.simhash_components(df), pack_documents(df)):
        assert {r.doc_id for r in got.collect()} == set(BIG)


def test_conversations(spark):
    schema = "conv_id long, turn long, role string, text string, rendered string, n int"
    rows = [(1, i, ["user", "assistant"][i % 2], t) for i, t in enumerate(HARD)] + [(2, None, None, None), (2, 0, "assistant", "b"), (2, 0, "assistant", "a"), (None, 1, "user", "u"), (3, 5, "assistant", "x" * 200_000), (2, 0, "assistant", "a")]
    got = {r.conv_id: r for r in C.conversation_digests(C.format_turns(spark.createDataFrame([(*r, "z", 1) for r in rows], schema).repartition(4))).collect()}
    for conv in (1, 2, 3, None):
        mine = sorted(((-1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == conv))
        learn = "".join(x for _, r, x in mine if r == "assistant")
        r = got[conv]
        assert r.n_turns == len(mine) and r.loss_chars == len(learn) and r.loss_sha256 == hashlib.sha256(learn.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{x}\n" for _, a, x in mine).encode()).hexdigest()
        assert r.formatted_chars == sum(len(C.format_turn(a, x)[0]) for _, a, x in mine)
    assert C.conversation_digests(C.format_turns(spark.createDataFrame([], schema))).count() == 0

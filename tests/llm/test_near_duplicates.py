"""Near-duplicates of the pipeline against brute force over all pairs, with edited copies."""

import random

import numpy as np
import pandas as pd

from gridloom.llm import near_duplicates as N


def exact(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept_by_brute_force(rows):
    sets, top = [exact(t or "") for _, t in rows], list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if not either or both / either >= 0.8:
                top[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return set(least.values())


def test_edited_copies(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 8)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(60, 300)))) for i in range(40)]
    for i in range(40):  # none to many words changed: some at 0.8 or more, some below
        w = rows[i][1].split()
        for at in rng.sample(range(len(w)), i * len(w) // 800):
            w[at] = word()
        rows.append((100 + i, " ".join(w)))
    base = rows[0][1].split()
    for i in range(60):  # a group larger than a list that is compared pair by pair
        rows.append((200 + i, " ".join([*base[:20], word(), *base[21:]])))
    rows += [(300, rows[7][1].upper()), (301, None), (302, ""), (303, "two words"), (304, "Two  words")]
    got = {r.doc_id for r in N.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = kept_by_brute_force(rows)
    assert got == want
    assert 5 < len({*range(100, 140)} - want) < 35


def test_similarity_is_exact():
    a, b = "a b c d e f g h i j k l m n", "a b c d e f g h i j k l m x"
    assert N.similarity(N.shingles(a), N.shingles(b)) == 9 / 11
    assert len(N.shingles("A b")) == 1 and N.similarity(N.shingles("A b"), N.shingles("a  B")) == 1
    assert N.similarity(N.shingles(None), N.shingles("")) == 1


def test_rows_without_doc_id_stay(spark):
    rows = [(None, "x y z"), (None, "x y z"), (2, "x y z"), (1, "x y z"), (1, "x y z")]
    got = sorted(((r.doc_id, r.text) for r in N.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == [(1, "x y z"), (None, "x y z"), (None, "x y z")]


def word(rng):
    return "".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 8)))


def edited(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(words)), n):
        out[at] = word(rng)
    return out


def test_star_of_edited_copies(spark):
    """Copies of one text, each edited elsewhere: pairs of copies are less alike than each is to its source."""
    rng = random.Random(6)
    base = [word(rng) for _ in range(200)]
    rows = [(0, " ".join(base))] + [(i, " ".join(edited(rng, base, 4))) for i in range(1, 1500)]
    rows += [(2000 + i, " ".join(word(rng) for _ in range(100))) for i in range(30)]
    got = {r.doc_id for r in N.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {0, *range(2000, 2030)}
    assert all(len(exact(t) & exact(rows[0][1])) / len(exact(t) | exact(rows[0][1])) >= 0.8 for i, t in rows[1:1500])
    assert want <= got and len(got - want) <= 15  # of 1,499: recall 0.99


def test_tree_of_edited_copies(spark):
    """Each copy is an edited copy of some earlier one: links lead away from the source step by step."""
    rng = random.Random(8)
    texts = [[word(rng) for _ in range(200)]]
    for _ in range(300):
        texts.append(edited(rng, rng.choice(texts), rng.randint(1, 4)))
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got, want = {r.doc_id for r in N.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}, kept_by_brute_force(rows)
    assert want <= got and len(got - want) <= 0.01 * (len(rows) - len(want))


def test_one_id_with_several_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, a, 7, "z"), (5, b, 8, "z"), (3, b, 9, "z"), (2**53 + 1, a, 10, "z"), (2**63 - 1, " ".join(f"c{i}" for i in range(60)), None, None), (None, a, 11, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node long, several string")
    got = N.near_dedup(df)
    assert got.columns == df.columns and {(r.doc_id, r.node) for r in got.collect()} == {(5, 7), (3, 9), (2**63 - 1, None), (None, 11)}


def lists(groups, fps, n=100, far=64):
    """One posting list whose texts have the same fingerprint under each print."""
    rows = {"key": np.full(len(fps), 7), "list": np.zeros(len(fps), int), "node": np.arange(len(fps)), "n": np.full(len(fps), n), "far": np.full(len(fps), far), "group": np.array(groups)}
    return pd.DataFrame(rows | {f"p{k}": np.array(fps, np.int64) for k in range(N.PRINTS)})


def pairs(how, *batches):
    return {(int(a), int(b)) for p in how(iter(batches)) for a, b in zip(p["a"], p["b"], strict=True)}


def test_short_and_long_lists_compare_the_same_pairs(monkeypatch):
    rng = random.Random(12)
    fps = [rng.getrandbits(63) for _ in range(3)]
    batch = pd.concat([lists(range(n), [rng.choice(fps) ^ (1 << rng.randrange(63)) for _ in range(n)], far=12).assign(key=n) for n in range(1, 30)])
    got = pairs(N.other_pairs, batch), set(pd.concat(N.open_postings(iter([batch])))["node"])
    monkeypatch.setattr(N, "SHORT", 1)
    assert got == (pairs(N.other_pairs, batch), set(pd.concat(N.open_postings(iter([batch])))["node"])) and len(got[0]) > 20


def test_what_meets_in_a_list(monkeypatch):
    monkeypatch.setattr(N, "SHORT", 2)
    assert pairs(N.other_pairs, lists([0, 0, 2, 3], [5, 5, 5, 5])) == {(0, 2), (0, 3), (1, 2), (1, 3), (2, 3)}
    assert pairs(N.other_pairs, lists([0, 1], [0, -1])) == set()  # too few shared bytes
    assert pairs(N.other_pairs, lists([0, 1], [0, 0b111], far=11)) == set()  # four prints with three other bits
    assert len(pairs(N.other_pairs, lists(range(40), [5] * 40))) == 780  # all, however long the list
    assert pairs(N.other_pairs, lists([4] * 12, [0] * 12)) == pairs(N.centre_pairs(True), lists([4] * 12, [0] * 12)) == set()
    star = lists(range(12), [0, *(1 << k for k in range(11))])
    assert pairs(N.centre_pairs(True), star) == {(0, k) for k in range(1, 12)}
    tied = pairs(N.centre_pairs(True), lists(range(12), [0] * 3 + [1 << k for k in range(9)]))
    assert tied == {(c, k) for c in range(3) for k in range(c + 1, 12)}  # every centre that ties meets all
    later = pairs(N.centre_pairs(False), lists([0] * 6 + [6, 7, 8], [0] * 6 + [1, 1, 3]))
    assert later == {(a, c) for c in (6, 7) for a in range(6)} | {(6, 7), (6, 8), (7, 8)}
    assert pairs(N.other_pairs) == pairs(N.centre_pairs(True)) == set()


def test_open_postings_keep_what_has_a_partner():
    found = pd.concat(N.open_postings(iter([lists(range(4), [0, 1, -1, 0xFFFFFF])])))
    assert set(found["node"]) == {0, 1}


def test_bit_limit():
    """At similarity 0.8 the fingerprints of random texts stay within the limit; it falls short of unrelated texts by far."""
    rng = random.Random(9)
    for n in (60, 200, 900):
        for _ in range(20):
            a = [word(rng) for _ in range(n)]
            b = edited(rng, a, n // 46)
            bits = int(np.bitwise_count(N.word_prints(" ".join(a)) ^ N.word_prints(" ".join(b))).sum())
            assert bits <= N.bit_limit(n - 4, len(set(a))) < 20 * N.PRINTS
    assert N.bit_limit(0, 0) >= 2 and N.bit_limit(10**6, 1) == 64 * N.PRINTS + 2


def test_components_in_one_task(spark):
    from gridloom.llm.common import Scratch
    from gridloom.llm.components import connected_components, joined

    rng = random.Random(3)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)]
    df = spark.createDataFrame([e for e in edges if e[0] != e[1]], "a long, b long")
    scratch = Scratch(spark, "test")
    assert sorted(map(tuple, joined(df, scratch).select("node", "component").collect())) == sorted(map(tuple, connected_components(df, scratch).select("node", "component").collect()))
    assert joined(df.limit(0), scratch).collect() == []


def test_sketches_pass_what_is_alike():
    rng = random.Random(10)
    rows = lambda a, b: N.sketch_ok(np.frombuffer(N.sketch(a), np.uint8)[None], np.frombuffer(N.sketch(b), np.uint8)[None], np.array([len(a) + len(b)]))[0]
    for n in (1, 5, 40, 300, 3000):
        for _ in range(40):
            pool = np.array([rng.getrandbits(64) for _ in range(n + n // 9 + 1)], np.uint64)
            a, b = np.unique(pool[: n + n // 18]), np.unique(pool[n // 18 : n + n // 18 + 1])
            if N.similarity(a, b) >= 0.8:
                assert rows(a, b)
    few = [rng.choice("abcdef") for _ in range(3000)]
    a, b = N.shingles(" ".join(few[:1500])), N.shingles(" ".join(few[1500:]))
    assert not rows(a, b)
    pool = np.array([rng.getrandbits(64) for _ in range(240)], np.uint64)  # similarity 0.7
    assert not rows(np.sort(pool[:200]), np.sort(np.concatenate([pool[:165], pool[205:240]])))


def test_a_pair_is_judged_in_one_list(monkeypatch):
    monkeypatch.setattr(N, "SHORT", 1)
    rng = random.Random(11)
    fps = [rng.getrandbits(63)]
    fps += [fps[0] ^ (1 << rng.randrange(63)) ^ (rng.randrange(256) << 8 * rng.randrange(7)) for _ in range(15)]
    nodes = lists(range(len(fps)), fps)
    keys = {k: N.list_keys(np.array(fps, np.uint64), N.SHARED, k) for k in range(N.PRINTS)}
    every = pd.concat([nodes.assign(key=keys[k][:, i].view(np.int64), list=k * keys[k].shape[1] + i) for k in range(N.PRINTS) for i in range(keys[k].shape[1])])
    found = pd.concat(N.other_pairs(iter([every])))
    assert not found.duplicated().any()
    near = lambda a, b: sum((fps[a] ^ fps[b]) >> 8 * p & 255 == 0 for p in range(8)) >= N.SHARED and N.PRINTS * (fps[a] ^ fps[b]).bit_count() <= 64
    assert set(zip(found["a"], found["b"])) == {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if near(a, b)}


def test_long_lists_give_few_pairs():
    """A text's edited copies share many lists; each copy comes with few others, not with a centre of each list."""
    rng = random.Random(21)
    base = [word(rng) for _ in range(150)]
    texts = {" ".join(edited(rng, base, rng.choice([1, 2, 3]))) for _ in range(500)}
    prints = np.array([N.word_prints(t) for t in texts])
    kinds = len(N.position_keys(N.SHARED))
    nodes = pd.DataFrame({"node": range(len(texts)), "n": 146, "far": N.bit_limit(146, 150), "group": range(len(texts))} | {f"p{k}": prints[:, k].view(np.int64) for k in range(N.PRINTS)})
    rows = pd.concat([nodes.assign(key=N.list_keys(prints[:, k], N.SHARED, k)[:, i].view(np.int64), list=k * kinds + i) for k in range(N.PRINTS) for i in range(kinds)])
    count = lambda how, part: sum(map(len, how(iter([part]))))
    assert count(N.centre_pairs(True), rows) > 40 * len(texts)
    assert count(N.nearest_pairs(True), rows[rows["list"] < N.STAGES[0][1]]) < 4 * len(texts)
    half = rows.assign(group=rows["group"].where(rows["group"] % 10 == 0, -1))  # nine of ten are linked
    assert count(N.nearest_pairs(True), half) < 10 * len(texts) and count(N.nearest_pairs(False), half) < 2 * len(texts)


def test_nearest_partners(monkeypatch):
    monkeypatch.setattr(N, "SHORT", 2)
    star = lists([0, *[1] * 5, *range(6, 12)], [0, *(1 << k for k in range(11))])
    got = pairs(N.nearest_pairs(True), star)
    assert {a for a, _ in got} == {0} and len(got) == 7 and len({b for _, b in got} & {*range(1, 6)}) == 1
    row = lists([0, 0, 0, 0, 1], [0b111, 0b1, 0b11, 0b1111, 0])
    assert pairs(N.nearest_pairs(False), row) == {(1, 4)}
    assert pairs(N.nearest_pairs(True), lists([4] * 12, [0] * 12)) == pairs(N.nearest_pairs(False)) == set()

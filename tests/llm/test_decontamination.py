import random

from gridloom.llm import decontamination as D

DOCS = "doc_id long, text string, item_id long, errors string"
ITEMS = "item_id long, text string, doc_id long"


def substring_distance(item, text):
    last = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        now = [i]
        for j, b in enumerate(text, 1):
            now.append(min(last[j - 1] + (a != b), last[j] + 1, now[j - 1] + 1))
        last = now
    return min(last)


def edited(rng, text, n):
    t = list(text)
    for _ in range(n):
        i = rng.randrange(max(1, len(t)))
        if not t:
            break
        what = rng.randrange(3)
        if what == 0:
            t[i] = rng.choice("abc de")
        elif what == 1:
            del t[i]
        else:
            t.insert(i, rng.choice("abc de"))
    return "".join(t)


def test_myers_equals_the_matrix():
    rng = random.Random(1)
    for _ in range(200):
        item = "".join(rng.choice("ab ") for _ in range(rng.randint(1, 90)))
        text = "".join(rng.choice("ab ") for _ in range(rng.randint(0, 60))) + edited(rng, item, 3)
        assert D.myers(item, text) == min(len(item), substring_distance(item, text))


def test_matcher_equals_brute_force():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    items = [(i, D.normalise(" ".join(word() for _ in range(rng.randint(1, 30))))) for i in range(12)]
    m = D.Matcher(items)
    for _ in range(60):
        i, item = rng.choice(items)
        text = " ".join(word() for _ in range(8)) + " " + edited(rng, item, rng.randint(0, 9)) + " " + " ".join(word() for _ in range(8))
        norm = D.normalise(text)
        want = [(j, d) for j, t in items if (d := substring_distance(t, norm) if D.budget(t) else int(f" {t} " not in f" {norm} ")) <= D.budget(t)]
        assert m.matches(text) == want


def test_edge_cases(spark):
    item = "The quick brown fox, jumps over the lazy dog again and again today."
    items = spark.createDataFrame([(7, item, 1), (7, item, 1), (8, None, 1), (9, "", 1), (10, "...", 1)], ITEMS)
    rows = [(1, "xx " + item.upper() + " yy", 1, "z"), (2, None, None, None), (3, "", 1, "z"), (None, item, 1, "z"), (1, "xx " + item.upper() + " yy", 1, "z"), (4, "x" * 300_000, 1, "z")]
    rows += [(5, item.replace("quick", "quack").replace("\n", " "), 1, "z"), (6, "nothing of this kind", 1, "z")]
    docs = spark.createDataFrame(rows, DOCS)
    got = sorted((r.doc_id or 0, r.item_id, r.errors) for r in D.contamination(docs, items).collect())
    assert got == [(0, 7, 0), (1, 7, 0), (1, 7, 0), (5, 7, 1)]
    kept = D.decontaminate(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 6]
    none = spark.createDataFrame([], ITEMS)
    assert D.contamination(docs, none).count() == 0 and D.decontaminate(docs, none).count() == len(rows)
    assert D.contamination(spark.createDataFrame([], DOCS), items).count() == 0


def test_blocks_cover_all_items(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_CHARS", 50)
    items = spark.createDataFrame([(i, f"item number {i} has these words {i * 37}", 0) for i in range(20)], ITEMS)
    docs = spark.createDataFrame([(i, f"a item number {i} has these words {i * 37} b", 0, "") for i in range(20)], DOCS)
    got = {(r.doc_id, r.item_id) for r in D.contamination(docs, items).where("errors = 0").collect()}
    assert {(i, i) for i in range(20)} <= got
    assert D.decontaminate(docs, items).count() == 0


def test_short_items_match_on_word_edges(spark):
    m = D.Matcher([(1, "cat"), (2, "a"), (3, "two words")])
    assert m.matches("concatenate catalog") == [] and m.matches("The cat.") == [(1, 0)] and m.matches("A dog") == [(2, 0)]
    assert m.matches("two words") == [(3, 0)] and m.matches("xtwo words") == m.matches("two wordsy") == []


def test_ids_keep_their_digits(spark):
    item = "the quick brown fox jumps over the lazy dog again and again today"
    docs = spark.createDataFrame([(2**53 + 1, item), (None, item), (2**63 - 1, item), (2**53 + 3, "x")], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(2**53 + 1, item), (None, item[4:])], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.contamination(docs, items).collect()}
    assert got == {(d, i) for d in (2**53 + 1, None, 2**63 - 1) for i in (2**53 + 1, None)}

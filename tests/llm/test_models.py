"""Learned operators: gradients, held-out accuracy, folds, edge cases."""

import random
import zlib

import numpy as np
import pytest

from gridloom.llm import quality_mil as M
from gridloom.llm import toxicity as X
from gridloom.llm.labelled import sample_labelled

SCHEMA = "doc_id long, text string, score string, held_out int, quality string"
LABELS = "doc_id long, quality int, toxic int, text string"


def word(rng):
    return "".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 8)))


def corpus(seed, n):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [word(rng) for _ in range(rng.randint(20, 200))]
        bad, toxic = rng.random() < 0.3, rng.random() < 0.3
        if toxic:
            for _ in range(rng.randint(1, 6)):
                words[rng.randrange(len(words))] = rng.choice(["scoundrel", "wretch", "vermin" + word(rng)])
        if bad:
            at = rng.randrange(len(words))
            words[at : at + 60] = [w + "###" for w in words[at : at + 60]]
        rows.append((i, " ".join(words), "x", 1, "z"))
        labels.append((i, int(not bad), int(toxic), "t"))
    return rows, labels


def test_attention_gradient():
    rng = np.random.default_rng(1)
    model = M.AttentionModel.fresh(np.zeros(M.FEATURES), np.ones(M.FEATURES), rng)
    x, starts, y = rng.normal(size=(7, M.FEATURES)), np.array([0, 3, 4]), np.array([1.0, 0, 1])

    def loss():
        s, _ = model.forward(x, starts)
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    g = model.gradient(x, starts, y)
    for k, v in model.p.items():
        for at in [tuple(rng.integers(0, n) for n in v.shape) for _ in range(6)]:
            old = v[at]
            v[at] = old + 1e-6
            up = loss()
            v[at] = old - 1e-6
            down = loss()
            v[at] = old
            assert g[k][at] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_attention_weights_sum_to_one():
    model = M.AttentionModel.fresh(np.zeros(M.FEATURES), np.ones(M.FEATURES), np.random.default_rng(2))
    x = M.passages("word " * 300)
    assert len(x) == 5 and model.attention(x).sum() == pytest.approx(1.0)
    assert M.passages(None).shape == (1, M.FEATURES) and M.passages("  \n").shape == (1, M.FEATURES) and np.isfinite(M.passages("é")).all()


def accuracy(rows, labels, predicted, column):
    truth = {r[0]: r[column] for r in labels}
    held = [r for r in predicted if r.held_out and r.doc_id in truth]
    assert len(held) > 40
    return sum(r.predicted == truth[r.doc_id] for r in held) / len(held)


def test_quality_on_held_out_rows(spark):
    rows, labels = corpus(3, 500)
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)
    out = M.score(docs, M.fit(docs, marks)).collect()
    assert len(out) == 500 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert accuracy(rows, labels, out, 1) > 0.95


def test_toxicity_on_held_out_rows(spark):
    rows, labels = corpus(4, 600)
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)
    out = X.score(docs, X.fit(docs, marks)).collect()
    assert accuracy(rows, labels, out, 2) > 0.95
    assert all(0 <= r[c] <= 1 for r in out for c in X.CATEGORIES)


@pytest.mark.parametrize("module", [M, X])
def test_edge_cases(spark, module):
    rows, labels = corpus(5, 60)
    odd = [(None, "no id", "x", 1, "z"), (901, None, None, None, None), (902, "", "x", 1, "z"), (903, " \n", "x", 1, "z"), (904, "w " * 50_000, "x", 1, "z"), rows[0]]
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    marks = spark.createDataFrame([*labels, labels[0], (None, 1, 1, "t"), (901, None, None, "t"), (902, 0, 1, "t")], LABELS)
    model = module.fit(docs, marks)
    assert module.score(docs, model).count() == 66
    assert module.score(docs.limit(0), model).count() == 0
    for none in (marks.limit(0), marks.where("quality = 1 AND toxic = 0")):
        assert module.score(docs, module.fit(docs, none)).count() == 66


def test_sample_is_bounded_and_leaves_fold_zero_out(spark):
    rows, labels = corpus(6, 200)
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)
    got = sample_labelled(docs, marks, "quality", {0: 5, 1: 7}, 10_000).collect()
    assert sorted(r.target for r in got) == [0] * 5 + [1] * 7 and all(r.fold > 0 for r in got)
    again = sample_labelled(docs.repartition(7), marks.repartition(3), "quality", {0: 5, 1: 7}, 10_000).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in again}


def test_chain_feeds_out_of_fold_probabilities():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 4))
    first = (x[:, 0] > 0).astype(float)
    second = first * (x[:, 1] > 0)
    targets = np.stack([first, second], 1)
    chain = X.ClassifierChain.fit(x, targets, np.arange(300) % 5, ("a", "b"))
    assert len(chain.weights[0]) == 5 and len(chain.weights[1]) == 6
    p = chain.predict(x)
    assert p.shape == (300, 2) and ((p[:, 0] > 0.5) == first).mean() > 0.95


def test_terms_of_a_fold_are_chosen_without_it(monkeypatch):
    """A word that only one fold's toxic rows have is no feature of that fold's out-of-fold probabilities."""
    texts = [f"plain text {'onlyhere' if i % 4 == 1 and i % 2 else 'other'} {'bad' if i % 3 == 0 else 'good'}" for i in range(240)]
    folds = np.array([1 + i % 4 for i in range(240)])
    toxic = np.array([float(i % 3 == 0) for i in range(240)])
    texts = [t + (" marker" if f == 2 and y else "") for t, f, y in zip(texts, folds, toxic)]
    seen = {}
    fit = X.ClassifierChain.fit
    monkeypatch.setattr(X.ClassifierChain, "fit", staticmethod(lambda x, t, f, n, by: seen.update(by=by, x=x) or fit(x, t, f, n, by)))
    model = X.train(texts, toxic, folds, ["en"] * 240)
    assert "marker" in model.vocabulary.terms and "bad" in model.vocabulary.terms
    assert seen["by"][2].shape[1] < seen["x"].shape[1] and set(seen["by"]) == {1, 2, 3, 4}
    assert [len(w) for w in model.chain.weights] == [len(model.vocabulary.terms) + 3 + k for k in range(3)]


def test_token_rows_equal_plain_counts():
    v = X.Vocabulary(["bad", "scou*", "worse*"])
    texts = ["Bad, bad scoundrel's scoundrel", None, "", "nothing", "worseness worse bad-bad"]
    for row, t in zip(v.rows(texts), texts):
        words = [w for w, n in X.word_counts(t).items() for _ in range(n)]
        want = [words.count("bad"), sum(w.startswith("scou") and len(w) > 4 for w in words), sum(w.startswith("worse") and len(w) > 5 for w in words)]
        hits = sum(w == "bad" or w.startswith("scou") or w.startswith("worse") and len(w) > 5 for w in words)
        assert np.expm1(row)[:3] == pytest.approx(want) and np.expm1(row[-2]) == pytest.approx(100 * hits / max(1, len(words)), rel=1e-4)


def test_word_bins_follow_the_word():
    text = b"One two one ONE\ntwo \xc3\xa9 one " * 40
    data = np.frombuffer(text, np.uint8)
    x = M.passages(text.decode())
    assert x[:, -M.HASHED :].sum(axis=1) == pytest.approx(np.ones(len(x)), abs=1e-5)
    words = text.split()
    begins = np.cumsum([0, *[len(w) + 1 for w in words]])[:-1]
    bins = M.word_bins(data, begins, begins + [len(w) for w in words])
    by = {}
    for w, b in zip(words, bins.tolist()):
        by.setdefault(w.lower() if w.isascii() else w, set()).add(b)
    assert all(len(b) == 1 for b in by.values())


def test_batched_scores_equal_single_ones(spark):
    rng = np.random.default_rng(3)
    model = M.AttentionModel.fresh(np.zeros(M.FEATURES), np.ones(M.FEATURES), rng)
    bags = [M.passages(t) for t in ("word " * 300, None, "a b", "### " * 70)]
    for bag, (s, p, top) in zip(bags, M.score_bags(model, bags)):
        one, m = model.forward(bag.astype(float), np.zeros(1, np.int64))
        assert s == pytest.approx(one[0]) and top == m["a"].argmax() and p == (one[0] >= 0.3)


@pytest.mark.parametrize("module", [M, X])
def test_ids_keep_their_digits(spark, module):
    rows, labels = corpus(8, 60)
    model = module.fit(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS))
    ids = [2**53 + 1, None, 2**63 - 1]
    docs = spark.createDataFrame([(i, "text", "x", 1, "z") for i in ids], SCHEMA).coalesce(1)
    assert {r.doc_id for r in module.score(docs, model).collect()} == set(ids)

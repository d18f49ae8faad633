"""Toxicity by a classifier chain: linear models for categories in a row, each fed the earlier categories' probabilities."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled import FOLDS, fold, sample_labelled

#: Bounds of the training sample: rows of each label, bytes of a text.
TRAIN_ROWS, TRAIN_BYTES = {0: 4500, 1: 1500}, 32_768
PREFIXES = (4, 5, 6, 7)
TERMS, MIN_ROWS = 512, 4
#: Order of the chain. The labels have one toxic column; its rows are split by the documents' language, which no model reads.
MAIN_LANG, CATEGORIES = "en", ("toxic_en", "toxic_other", "toxic")
THRESHOLD = 0.3
_WORD = re.compile(r"[^\W\d_]+")
#: Most tokens whose terms a worker remembers.
REMEMBERED = 200_000


def word_counts(text: str | None) -> Counter:
    return Counter(_WORD.findall(text.lower())) if text else Counter()


def terms_of(word: str) -> list[str]:
    """A word's terms: itself, and its beginnings (marked by a star), which families of derived words share."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def presence(counts: list[Counter], y: np.ndarray) -> tuple[Counter, Counter]:
    """In how many rows of either label (1, 0) each term stands."""
    found = (Counter(), Counter())
    for c, t in zip(counts, y, strict=True):
        found[0 if t else 1].update({x for w in c for x in terms_of(w)})
    return found


def choose_terms(pos: Counter, neg: Counter, n1: int, n0: int, limit: int = TERMS) -> list[str]:
    """The terms whose presence tells most of the label (signed root of the likelihood ratio), in a fixed order."""
    n1, n0 = max(1, n1), max(1, n0)
    scored = []
    for t, a in pos.items():
        b = neg.get(t, 0)
        p, q = a / n1, b / n0
        if a >= MIN_ROWS and p > q:
            scored.append((-(p - q) ** 2 / ((p * (1 - p) + 1 / n1) / n1 + (q * (1 - q) + 1 / n0) / n0), t))
    return [t for _, t in sorted(scored)[:limit]]


@dataclass
class Vocabulary:
    terms: list[str]

    def __post_init__(self) -> None:
        self.at = {t: i for i, t in enumerate(self.terms)}
        self.words = {t for t in self.terms if not t.endswith("*")}
        self.starts = [(n, {t[:-1] for t in self.terms if t.endswith("*") and len(t) == n + 1}) for n in PREFIXES]
        self.starts = [(n, s) for n, s in self.starts if s]

        self.known: dict[str, tuple[int, tuple[tuple[int, ...], ...]]] = {}

    def hits(self, word: str) -> tuple[int, ...]:
        """The numbers of a word's terms that are in the vocabulary."""
        return (*((self.at[word],) if word in self.words else ()), *(self.at[word[:k] + "*"] for k, s in self.starts if len(word) > k and word[:k] in s))

    def token(self, token: str) -> tuple[int, tuple[tuple[int, ...], ...]]:
        """How many words a token between spaces has, and the hits of those that have any; remembered, as tokens recur."""
        got = self.known.get(token)
        if got is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            words = _WORD.findall(token)
            got = self.known[token] = len(words), tuple(h for h in map(self.hits, words) if h)
        return got

    def rows(self, texts: list[str | None]) -> np.ndarray:
        """A row for each text: log(1 + occurrences) of each term, and the logs of the hits' share among all words and of their number."""
        x = np.zeros((len(texts), len(self.terms) + 2), np.float32)
        for row, text in zip(x, texts, strict=True):
            total = n_hits = 0
            for token, n in Counter(text.lower().split()).items() if text else ():
                words, found = self.token(token)
                total += n * words
                for h in found:
                    n_hits += n
                    row[list(h)] += n
            row[-2], row[-1] = 100 * n_hits / total if total else 0, n_hits
        return np.log1p(x)


def fit_linear(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 150) -> np.ndarray:
    """Weights of a logistic regression (the last is the intercept) by Nesterov's method; constant targets give a constant."""
    n, k = x.shape
    w = np.zeros(k + 1)
    if n == 0 or y.min() == y.max():
        w[-1] = -6.0 if n == 0 or y.max() == 0 else 6.0
        return w
    x1 = np.hstack([x.astype(np.float32), np.ones((n, 1), np.float32)])
    v = np.ones(k + 1, np.float32)
    for _ in range(12):
        v = x1.T @ (x1 @ v)
        v /= np.linalg.norm(v)
    size = float(np.linalg.norm(x1 @ v) ** 2) / n
    rate = 1 / (0.25 * size * 1.05 + penalty)
    ridge = np.append(np.full(k, penalty), 0.0)
    look, last = w.copy(), w.copy()
    for t in range(rounds):
        p = 0.5 * (1 + np.tanh(0.5 * (x1 @ look.astype(np.float32))))
        w = look - rate * ((p - y).astype(np.float32) @ x1 / n + ridge * look)
        look = w + t / (t + 3) * (w - last)
        last = w
    return w


def predict_linear(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * (x @ w[:-1] + w[-1])))


@dataclass
class ClassifierChain:
    """Category k's model sees the features and the probabilities of categories 0 .. k - 1."""

    names: tuple[str, ...]
    weights: list[np.ndarray]

    @staticmethod
    def fit(x: np.ndarray, targets: np.ndarray, folds: np.ndarray, names: tuple[str, ...], by_fold: dict[int, np.ndarray] | None = None) -> ClassifierChain:
        """Later models are trained on out-of-fold probabilities: those a row would get from models that never saw it.

        ``by_fold`` holds, for each fold, the features as they would be without that fold's rows (terms chosen on the others).
        """
        weights, past = [], np.zeros((len(x), 0))
        for k in range(len(names)):
            weights.append(fit_linear(np.hstack([x, past]), targets[:, k]))
            out = np.zeros((len(x), 1))
            for f in np.unique(folds):
                there, seen = np.hstack([x if by_fold is None else by_fold[int(f)], past]), folds != f
                w = fit_linear(there[seen], targets[seen, k])
                out[~seen, 0] = predict_linear(w, there[~seen])
            past = np.hstack([past, out])
        return ClassifierChain(names, weights)

    def predict(self, x: np.ndarray) -> np.ndarray:
        first = x.shape[1]
        for w in self.weights:
            x = np.hstack([x, predict_linear(w, x)[:, None]])
        return x[:, first:]


@dataclass
class ToxicityModel:
    vocabulary: Vocabulary
    chain: ClassifierChain

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return self.chain.predict(self.vocabulary.rows(texts))


def train(texts: list[str], toxic: np.ndarray, folds: np.ndarray, langs: list[str | None]) -> ToxicityModel:
    """Terms are chosen on all rows for the final models, and on the other folds' rows for a fold's out-of-fold probabilities."""
    counts = [word_counts(t) for t in texts]
    names = [int(f) for f in np.unique(folds)]
    parts = {f: presence([c for c, g in zip(counts, folds, strict=True) if g == f], toxic[folds == f]) for f in names}
    pos, neg = (sum((parts[f][i] for f in names), Counter()) for i in (0, 1))
    n1 = int(toxic.sum())
    vocabulary = Vocabulary(choose_terms(pos, neg, n1, len(toxic) - n1))
    by_fold = {}
    for f in names:
        m1, m = int(toxic[folds == f].sum()), int((folds == f).sum())
        by_fold[f] = Vocabulary(choose_terms(pos - parts[f][0], neg - parts[f][1], n1 - m1, len(toxic) - n1 - m + m1)).rows(texts)
    main = np.array([x == MAIN_LANG for x in langs], bool) if texts else np.zeros(0, bool)
    targets = np.stack([toxic * main, toxic * ~main, toxic], axis=1).astype(float)
    return ToxicityModel(vocabulary, ClassifierChain.fit(vocabulary.rows(texts), targets, folds, CATEGORIES, by_fold))


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learns from a bounded sample of labelled rows outside fold 0. Without a column ``lang`` all rows count as other languages."""
    rows = sample_labelled(docs, labels, "toxic", TRAIN_ROWS, TRAIN_BYTES, ("lang",)).collect()
    rows.sort(key=lambda r: (r.doc_id, r.text))
    return train([r.text for r in rows], np.array([r.target for r in rows], float), np.array([r.fold % FOLDS for r in rows]), [r.lang for r in rows])


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): doc_id, held_out, the categories' probabilities, predicted.

    Whole texts are scored. A null or empty text has no words; a null doc_id is held out; repeated rows are scored
    each; extra columns are ignored; an empty table gives no rows.
    """

    @F.pandas_udf(", ".join(f"{c} double" for c in model.chain.names) + ", predicted int")
    def run(texts: pd.Series) -> pd.DataFrame:
        p = model.scores([t if isinstance(t, str) else None for t in texts])
        return pd.DataFrame({n: p[:, k] for k, n in enumerate(model.chain.names)}).assign(predicted=(p[:, -1] >= THRESHOLD).astype(np.int32))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold() == 0).alias("held_out"), run(F.col("text").cast("string")).alias("s"))
    return rows.select("doc_id", "held_out", "s.*")


def op7_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))

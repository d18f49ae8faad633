"""Text quality by attention-based multiple-instance learning: passages are the instances, a document's label is the bag's."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled import fold, sample_labelled

PASSAGE_WORDS = 64
#: Bounds of the training sample: rows of each label, bytes of a text.
TRAIN_ROWS, TRAIN_BYTES = {0: 2000, 1: 4000}, 200_000
HIDDEN, ATTENTION, EPOCHS, BATCH, RATE, DECAY, SEED = 16, 8, 40, 64, 0.01, 1e-4, 20240
THRESHOLD = 0.3
#: Passages per call of the model.
BATCH_PASSAGES = 4096
_SPACES = (9, 10, 11, 12, 13, 32)
_CLASSES = 8
#: Bins that a passage's words are hashed into, and how much their inputs are damped.
HASHED = 128
TOKEN_DAMP = 5


def _table() -> np.ndarray:
    t = np.full(256, 5, np.uint8)  # 5: other punctuation and controls
    t[list(_SPACES)] = 0
    t[ord("a") : ord("z") + 1] = 1
    t[ord("A") : ord("Z") + 1] = 2
    t[ord("0") : ord("9") + 1] = 3
    t[[ord(c) for c in "#*$%&|<>"]] = 4
    t[ord("!")] = 6
    t[128:] = 7
    return t


_CLASS = _table()
FEATURES = _CLASSES + 5 + HASHED
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_bins(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A bin 0 .. HASHED - 1 for each word data[begin:end] (A-Z lowered): a polynomial in its bytes, from sums over the whole text."""
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint64) + np.uint64(1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(low * _powers(_STEP, len(data)), dtype=np.uint64)])
    h = (sums[ends] - sums[begins]) * _powers(_BACK, len(data) + 1)[begins]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(32)) % np.uint64(HASHED)).astype(np.int64)


def passages(text: str | None) -> np.ndarray:
    """A row of features for each passage of PASSAGE_WORDS words (the last may be shorter); one row for a text without words.

    Shares of character classes among the passage's characters, mean word length, shares of distinct words in the
    passage and of words equal to the one before, words per line end, how full the passage is, and the shares of its
    words in HASHED bins.
    """
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    words = raw.split()
    if not words:
        return np.zeros((1, FEATURES), np.float32)
    n = -(-len(words) // PASSAGE_WORDS)
    data = np.frombuffer(raw, np.uint8)
    kind = _CLASS[data]
    begins = np.flatnonzero((kind[1:] > 0) & (kind[:-1] == 0)) + 1
    if kind[0] > 0:
        begins = np.concatenate([np.zeros(1, np.int64), begins])
    cuts = begins[::PASSAGE_WORDS].copy()
    cuts[0] = 0
    sizes = np.diff(np.r_[cuts, len(data)])
    counts = np.bincount(np.repeat(np.arange(n) * _CLASSES, sizes) + kind, minlength=n * _CLASSES).reshape(n, _CLASSES)
    lines = np.add.reduceat((data == 10).astype(np.int64), cuts)
    total = np.minimum(PASSAGE_WORDS, len(words) - PASSAGE_WORDS * np.arange(n))
    distinct, twins = np.empty(n), np.empty(n)
    for i in range(n):
        w = words[i * PASSAGE_WORDS : (i + 1) * PASSAGE_WORDS]
        distinct[i] = len(set(w))
        twins[i] = sum(map(bytes.__eq__, w, w[1:]))
    out = np.empty((n, FEATURES), np.float32)
    out[:, :_CLASSES] = counts / sizes[:, None]
    out[:, _CLASSES] = (sizes - counts[:, 0]) / total / 10
    out[:, _CLASSES + 1] = distinct / total
    out[:, _CLASSES + 2] = twins / total
    out[:, _CLASSES + 3] = lines / total
    out[:, _CLASSES + 4] = total / PASSAGE_WORDS
    ends = np.flatnonzero((kind[1:] == 0) & (kind[:-1] > 0)) + 1
    if kind[-1] > 0:
        ends = np.append(ends, len(data))
    bins = word_bins(data, begins, ends) + HASHED * (np.arange(len(begins)) // PASSAGE_WORDS)
    out[:, _CLASSES + 5 :] = np.bincount(bins, minlength=n * HASHED).reshape(n, HASHED) / total[:, None]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class AttentionModel:
    """score = sigmoid(c z + d), z = sum of a_k h_k; h = tanh(W x + b) encodes a passage, a = softmax of w (tanh(V h) * sigmoid(U h))."""

    p: dict[str, np.ndarray]
    mean: np.ndarray
    std: np.ndarray

    @staticmethod
    def fresh(mean: np.ndarray, std: np.ndarray, rng: np.random.Generator) -> AttentionModel:
        def draw(*shape: int) -> np.ndarray:
            return rng.normal(0, 1 / np.sqrt(shape[0]), shape)

        p = {"W": draw(FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": draw(HIDDEN, ATTENTION), "U": draw(HIDDEN, ATTENTION), "w": draw(ATTENTION), "c": draw(HIDDEN), "d": np.zeros(1)}
        return AttentionModel(p, mean, std)

    def forward(self, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, dict]:
        """Scores of bags; bag k is the rows from starts[k] to the next start."""
        p, sizes = self.p, np.diff(np.r_[starts, len(x)])
        x = (x - self.mean) / self.std
        h = np.tanh(x @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (v * u) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        a = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return _sigmoid(z @ p["c"] + p["d"]), {"x": x, "h": h, "v": v, "u": u, "a": a, "z": z, "sizes": sizes}

    def gradient(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        s, m = self.forward(x, starts)
        ds = (s - y) / len(y)
        g = {"c": m["z"].T @ ds, "d": np.array([ds.sum()])}
        dz = np.repeat(ds[:, None] * p["c"], m["sizes"], axis=0)
        da = (dz * m["h"]).sum(axis=1)
        de = m["a"] * (da - np.repeat(np.add.reduceat(m["a"] * da, starts), m["sizes"]))
        gate = m["v"] * m["u"]
        g["w"] = gate.T @ de
        dgate = de[:, None] * p["w"]
        dv, du = dgate * m["u"] * (1 - m["v"] ** 2), dgate * m["v"] * m["u"] * (1 - m["u"])
        g["V"], g["U"] = m["h"].T @ dv, m["h"].T @ du
        dh = m["a"][:, None] * dz + dv @ p["V"].T + du @ p["U"].T
        dpre = dh * (1 - m["h"] ** 2)
        g["W"], g["b"] = m["x"].T @ dpre, dpre.sum(axis=0)
        return g

    def attention(self, x: np.ndarray) -> np.ndarray:
        """The weights of one document's passages."""
        return self.forward(x, np.zeros(1, np.int64))[1]["a"]


def train(bags: list[np.ndarray], y: np.ndarray) -> AttentionModel:
    """Adam on the mean log loss, in an order that a fixed seed decides. Without bags of both labels the model gives their mean."""
    rng = np.random.default_rng(SEED)
    x = np.concatenate(bags).astype(np.float64) if bags else np.zeros((1, FEATURES))
    std = x.std(axis=0) + 1e-3
    std[FEATURES - HASHED :] *= TOKEN_DAMP  # many weak inputs: they start small against the others, so that few rows don't overfit them
    model = AttentionModel.fresh(x.mean(axis=0), std, rng)
    if not bags or y.min() == y.max():
        model.p["c"][:] = 0
        model.p["d"][:] = 0.0 if not bags else (4.0 if y.min() == 1 else -4.0)
        return model
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), BATCH):
            part = [bags[k] for k in order[i : i + BATCH]]
            starts = np.concatenate([[0], np.cumsum([len(b) for b in part])[:-1]])
            g = model.gradient(np.concatenate(part).astype(np.float64), starts, y[order[i : i + BATCH]])
            step += 1
            rate = RATE * (1 - epoch / EPOCHS) + 1e-4
            for k, v in model.p.items():
                d = g[k] + DECAY * v
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.999 * second[k] + 0.001 * d * d
                v -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def fit(docs: DataFrame, labels: DataFrame) -> AttentionModel:
    """Learns from a bounded sample of labelled rows outside fold 0; only their passage features reach the driver."""
    sample = sample_labelled(docs, labels, "quality", TRAIN_ROWS, TRAIN_BYTES)

    @F.pandas_udf("binary")
    def bags(texts: pd.Series) -> pd.Series:
        return pd.Series([passages(t).tobytes() for t in texts], dtype=object)

    rows = sorted(sample.select("doc_id", "target", bags("text").alias("x")).collect(), key=lambda r: (r.doc_id, bytes(r.x)))
    return train([np.frombuffer(bytes(r.x), np.float32).reshape(-1, FEATURES) for r in rows], np.array([r.target for r in rows], float))


def score_bags(model: AttentionModel, bags: list[np.ndarray]) -> list[tuple[float, int, int]]:
    """(score, predicted, passage of most weight) of each bag."""
    starts = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]]).astype(np.int64)
    s, m = model.forward(np.concatenate(bags).astype(np.float64), starts)
    tops = [int(m["a"][i : i + len(b)].argmax()) for i, b in zip(starts.tolist(), bags, strict=True)]
    return [(float(x), int(x >= THRESHOLD), t) for x, t in zip(s, tops, strict=True)]


def score(docs: DataFrame, model: AttentionModel) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): doc_id, held_out, score (0 to 1), predicted, top_passage (the passage of most weight).

    Whole texts are scored. A null or empty text is one empty passage; a null doc_id is held out; repeated rows are
    scored each; extra columns are ignored; an empty table gives no rows.
    """

    @F.pandas_udf("score double, predicted int, top_passage int")
    def run(texts: pd.Series) -> pd.DataFrame:
        out, bags = [], []
        # One call of the model for many documents, and never for more than about BATCH_PASSAGES passages and the last document's.
        for k, text in enumerate(texts):
            bags.append(passages(text if isinstance(text, str) else None))
            if sum(map(len, bags)) >= BATCH_PASSAGES or k == len(texts) - 1:
                out += score_bags(model, bags)
                bags = []
        return pd.DataFrame(out, columns=["score", "predicted", "top_passage"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold() == 0).alias("held_out"), run(F.col("text").cast("string")).alias("s"))
    return rows.select("doc_id", "held_out", "s.*")


def op6_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))

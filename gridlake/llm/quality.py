"""Quality classifier: naive Bayes support vectors (operator 1).

Features are hashed word and punctuation-run unigrams and bigrams, as indicators, and indicators of how
large a share of the tokens repeats, is in capitals, is punctuation or is distinct. All labelled training
texts are counted: ``r = log((p + 1) / |p|) - log((q + 1) / |q|)`` with ``p``, ``q`` the documents of either class
that hold a feature. Indicators are scaled by ``r`` and brought to unit length; a linear hinge-loss model is
fitted by dual coordinate descent on a sample of about ``sample`` training rows (drawn by a hash of the id),
a fifth of which calibrates the margin into a probability (Platt).

Cases: an empty or null text has no features and scores by the intercept; labels that are null are not used, several labels of
one document count as their greatest; with one class or none the score is the smoothed share of label 1; repeated rows are
scored one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlake.llm.common import MULTIPLIER, Remembered, crc_fold, unit_hash

TOKENS = re.compile(r"\w+|[^\w\s]+")
FEATURES = 1 << 18
#: Expected number of labelled rows the linear model is fitted on (bounds what reaches the driver).
SAMPLE = 5_000
#: Labelled ids are broadcast up to this many (16 bytes each); beyond it the join is shuffled.
BROADCAST_LABELS = 1_000_000
THRESHOLD = 0.3


class Featuriser:
    """Sorted distinct feature numbers of a whole text.

    The last ``RESERVED`` numbers hold, in tenths, the shares of tokens that repeat one of the two before
    them, are all capitals, are punctuation runs, are distinct; the rest are hashed n-grams.
    """

    RESERVED = 44

    def __init__(self, size: int = FEATURES):
        self.size, self.room = size, np.uint64(size - self.RESERVED)
        self.memo = Remembered(self._token)

    @staticmethod
    def _token(token: str) -> int:
        """Hash of the lower-case token; its two lowest bits say all capitals and punctuation."""
        hashed = xxhash.xxh3_64_intdigest(token.lower().encode("utf-8", "surrogatepass")) & ~3
        return hashed | (len(token) > 1 and token.isupper()) | (not (token[0].isalnum() or token[0] == "_")) << 1

    def __call__(self, text: str | None) -> np.ndarray:
        tokens = TOKENS.findall(text) if isinstance(text, str) else []
        if not tokens:
            return np.empty(0, np.int64)
        h = np.fromiter(map(self.memo.__getitem__, tokens), np.uint64, len(tokens))
        plain, n = h >> np.uint64(2), len(h)
        pairs = plain[:-1] * MULTIPLIER + plain[1:]
        grams = np.unique(np.concatenate([plain, pairs ^ (pairs >> np.uint64(29))]) % self.room).astype(np.int64)
        repeats = np.count_nonzero(plain[1:] == plain[:-1]) + np.count_nonzero(plain[2:] == plain[:-2])
        shares = (min(n, repeats), np.count_nonzero(h & np.uint64(1)), np.count_nonzero(h & np.uint64(2)), len(np.unique(plain)))
        return np.append(grams, [int(self.room) + 11 * i + 10 * x // n for i, x in enumerate(shares)])


@dataclass(frozen=True)
class Model:
    ratio: np.ndarray
    weights: np.ndarray
    intercept: float
    slope: float
    shift: float

    def margin(self, ids: np.ndarray) -> float:
        r = self.ratio[ids]
        norm = np.sqrt(r @ r)
        return (float(self.weights[ids] @ r) / norm if norm else 0.0) + self.intercept

    def score(self, ids: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(ids) + self.shift, -30, 30))))


def fit_hinge(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, size: int, cost: float = 1.0, epochs: int = 20, seed: int = 7) -> tuple[np.ndarray, float]:
    """L2-regularised hinge loss by dual coordinate descent; the intercept is a constant feature."""
    w, b, alpha, rng = np.zeros(size), 0.0, np.zeros(len(rows)), np.random.default_rng(seed)
    square = np.array([float(v @ v) + 1.0 for v in values])
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            y, ids, v = labels[i], rows[i], values[i]
            gradient = y * (w[ids] @ v + b) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost)
            if step := (new - alpha[i]) * y:
                w[ids] += step * v
                b += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, b


def fit_platt(margins: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, smoothed targets, Newton steps."""
    n1, n0 = positive.sum(), (~positive).sum()
    t = np.where(positive, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, theta = np.stack([margins, np.ones_like(margins)]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(theta @ x, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-4 * np.eye(2), x @ (p - t) + 1e-4 * theta)
        theta = theta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(theta[0]), float(theta[1])


def fit(train: DataFrame, size: int = FEATURES, sample: int = SAMPLE) -> Model:
    """``train``: key, text, label (0/1, not null). Counts cover all of it; ``sample`` bounds the collected rows."""

    def counted(batches):
        features, n = Featuriser(size), np.zeros((2, size + 1), np.int64)
        for batch in batches:
            for text, label in zip(batch["text"], batch["label"], strict=True):
                n[label, features(text)] += 1
                n[label, size] += 1
        at = np.flatnonzero(n.any(axis=0))
        yield pd.DataFrame({"feature": at, "n0": n[0, at], "n1": n[1, at]})

    # at most size + 1 rows
    found = train.select("text", "label").mapInPandas(counted, "feature long, n0 long, n1 long").groupBy("feature").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    n = np.zeros((2, size + 1))
    n[0, found["feature"]], n[1, found["feature"]] = found["n0"], found["n1"]
    n0, n1 = n[0, size], n[1, size]
    if not n0 or not n1:
        return Model(np.zeros(size), np.zeros(size), 0.0, 0.0, float(np.log((n1 + 1) / (n0 + 1))))
    p, q = n[1, :size] + 1, n[0, :size] + 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    # a feature nobody counted says nothing
    ratio[(n[0, :size] + n[1, :size]) == 0] = 0.0

    def drawn(batches):
        features = Featuriser(size)
        for batch in batches:
            yield pd.DataFrame({"k": batch["k"], "label": batch["label"], "ids": [features(t).astype(np.int32) for t in batch["text"]]})

    picked = train.withColumn("k", unit_hash(F.col("key"), "fit")).where(F.col("k") < sample / (n0 + n1)).select("k", "label", "text").mapInPandas(
        drawn, "k double, label int, ids array<int>").toPandas().sort_values("k", ignore_index=True)
    rows = [np.asarray(x, np.int32) for x in picked["ids"]]
    values = [(ratio[x] / max(1e-12, np.sqrt(ratio[x] @ ratio[x]))).astype(np.float32) for x in rows]
    positive = picked["label"].to_numpy() == 1
    hold = np.arange(len(rows)) % 5 == 4
    if len(set(positive[~hold])) < 2:
        return Model(ratio, np.zeros(size), 0.0, 0.0, float(np.log((n1 + 1) / (n0 + 1))))
    own = np.flatnonzero(~hold)
    w, b = fit_hinge([rows[i] for i in own], [values[i] for i in own], np.where(positive[own], 1.0, -1.0), size)
    margins = np.array([w[x] @ v + b for x, v in zip(rows, values, strict=True)])
    slope, shift = fit_platt(margins[hold], positive[hold]) if len(set(positive[hold])) == 2 else (1.0, 0.0)
    return Model(ratio, w, b, slope, shift)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score``; whole texts, no shuffle."""
    kept = [c for c in docs.columns if c != "score"]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def over(batches):
        model = shared.value
        features = Featuriser(len(model.ratio))
        for batch in batches:
            batch["score"] = [model.score(features(t)) for t in batch[text]]
            yield batch

    return docs.select(*kept).mapInPandas(over, schema)


def held_out(key: str = "doc_id") -> Column:
    return crc_fold(key, 5) == 0


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """Fit on labelled documents that are not held out, score all; text stays behind."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1))
    if known.count() <= BROADCAST_LABELS:
        known = F.broadcast(known)
    train = docs.select("doc_id", "text").join(known, "doc_id").select(F.col("doc_id").alias("key"), "text", "label")
    scored = score(docs.select("doc_id", held_out().alias("held_out"), "text"), fit(train))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

"""Toxicity (5): FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.textops import LOWER, U, give_back, inside, mix, slices, span_hashes, spans, utf8

#: Labelled rows that the model is fitted on at most, the first by a hash of the id.
TRAIN_ROWS = 16_000
BITS = 18
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 10.0, 0.5
STEMS = (4, 5)

_SCORED = pa.schema([("id", pa.int64()), ("score", pa.float64())])
_WEIGHTS = pa.schema([("feature", pa.int32()), ("weight", pa.float64())])


def features(col: pa.Array, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Families of hashed features, each with its texts' offsets.

    Words, words cut to 4 and 5 bytes (inflected forms share these), pairs of
    neighbours, and skip-grams (a word and the next but one). A-Z is lower
    case. A text has a feature or not, however often.
    """
    data, off = utf8(col)
    data = LOWER[data]
    starts, ends, at = spans(data, off)
    w = span_hashes(data, starts, ends)
    mask = U((1 << bits) - 1)
    out = [((w & mask).astype(np.int64), at)]
    for k, n in enumerate(STEMS):
        stem = span_hashes(data, starts, np.minimum(ends, starts + n))
        out.append(((mix(stem ^ U(0xA5A5 + k)) & mask).astype(np.int64), at))
    for gap in (1, 2):
        i = inside(at, gap + 1)
        pair = mix(w[i] * U(0x9E3779B97F4A7C15) ^ w[i + gap] ^ U(gap))
        n = np.maximum(np.diff(at) - gap, 0)
        out.append(((pair & mask).astype(np.int64), np.concatenate([[0], np.cumsum(n)])))
    return out


class Ftrl:
    """Follow the regularised leader: a rate for each coordinate, weights of exactly 0 under L1."""

    def __init__(self, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)  # the last is the intercept, free of L1

    def weights(self, i: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        l1 = np.full(len(z), self.l1)
        l1[-1] = 0
        return np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2), 0.0)

    def learn(self, i: np.ndarray, label: int) -> None:
        """i: distinct features, the intercept last."""
        w = self.weights(i)
        g = sigmoid(float(w.sum())) - label
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[i] += g * g


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def best_level(scores: np.ndarray, label: np.ndarray) -> float:
    """The middle of the levels above which the F1 of label 1 is greatest; 0 without both labels."""
    if not label.any() or label.all():
        return 0.0
    order = np.argsort(-scores, kind="stable")
    hit = np.cumsum(label[order])
    f1 = 2 * hit / (np.arange(1, len(hit) + 1) + label.sum())
    last = np.append(scores[order][1:] < scores[order][:-1], True)  # ties stay together
    f1[~last] = 0
    k = int(np.argmax(f1))
    return float(scores[order][k] + scores[order][min(k + 1, len(hit) - 1)]) / 2


def _fit(epochs: int, bits: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        order = np.argsort(mix(table.column("id").to_numpy().astype(np.int64).view(U)))
        label = table.column("label").to_numpy()
        text = table.column("text").combine_chunks()
        parts, size = [], []
        for at in range(0, len(label), 500):
            found = features(text.slice(at, 500), bits)
            own = [np.append(np.unique(np.concatenate([f[o[k] : o[k + 1]] for f, o in found])), 1 << bits).astype(np.int32) for k in range(min(500, len(label) - at))]
            size += map(len, own)
            parts.append(np.concatenate(own))
        every, edge = np.concatenate(parts), np.cumsum([0, *size]).tolist()  # one array: many small ones would stay with the worker
        rows = [every[a:z] for a, z in zip(edge, edge[1:], strict=False)]

        def fitted(chosen: np.ndarray) -> np.ndarray:
            model = Ftrl(bits)
            for _ in range(epochs):
                for k in chosen:
                    model.learn(rows[k], int(label[k]))
            return model.weights()

        # L1 shrinks the weights and so the scores: the level that parts the classes best
        # on a fifth of the rows, unseen by a first fit, becomes that of 0.5
        cut = len(order) * 4 // 5
        w = fitted(order[:cut])
        level = best_level(np.array([w[rows[k]].sum() for k in order[cut:]]), label[order[cut:]])
        w = fitted(order)
        w[-1] -= level
        some = np.flatnonzero(w)
        del rows, every, parts
        give_back()
        return pa.table([pa.array(some, pa.int32()), pa.array(w[some], pa.float64())], schema=_WEIGHTS)

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS, epochs: int = EPOCHS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Weights that aren't 0, by feature.

    Learns from at most ``rows`` labelled rows, chosen by a hash of the id; so
    many ids may be broadcast. Rows without a label or a document are left out,
    a null text is an empty one. Without labelled rows there are no weights.
    """
    few = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).filter("id IS NOT NULL AND label IS NOT NULL")
    few = few.orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chosen = texts.join(F.broadcast(few), "id")
    got = chosen.groupBy(F.lit(0).alias("one")).applyInArrow(_fit(epochs, bits), "feature int, weight double").toPandas()
    return got.feature.to_numpy(np.int64), got.weight.to_numpy(np.float64)


def _score(feature: np.ndarray, weight: np.ndarray, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros((1 << bits) + 1)
        w[feature] = weight
        for b in slices(batches):
            hits = []
            for f, at in features(b.column("text"), bits):
                i = np.flatnonzero(w[f])
                hits.append((np.searchsorted(at, i, "right") - 1) << bits | f[i])
            hit = np.unique(np.concatenate(hits))
            total = w[-1] + np.bincount(hit >> bits, w[hit & ((1 << bits) - 1)], b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sigmoid(total))], schema=_SCORED)

    return run


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """One row per input row: id (long), score from 0 to 1.

    Null and empty texts get the intercept's score. Whole texts are read.
    Rows with a repeated id are all returned. Empty table: no rows. Other
    columns are not looked at.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_score(*model, bits), "id long, score double").withColumnRenamed("id", id_col)

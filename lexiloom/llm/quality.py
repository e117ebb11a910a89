"""Quality classifier on supervised subword embeddings.

Every word, pair of neighbouring words and character 3- and 4-gram of a text has a learned vector, found by its hash
in a table of ``2 ** BITS`` rows.  A document is the average of its vectors; a softmax layer over that average gives
the classes.  Vectors and layer are trained together by stochastic gradient descent in numpy, on the driver, from a
bounded sample: the labelled documents of the smallest hash of their id, whole texts, ``MAX_TRAIN`` of them and
``MAX_BYTES`` of text at most (one document is taken however long it is).

Averaging and the layer are both linear, so the trained model is one number per hash and a bias; scoring gathers these
for all n-grams of a text and averages them.  That table has a fixed size and goes out with the task.

Defined results: null and empty texts score by the bias alone; without labels of both classes the score is the share
of class 1 (0.5 without any); repeated rows score alike; an empty table gives an empty result.  Only the id and the
text are read from the documents; the id only decides who is held out, never a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import prepare, spread, text_of

BITS, WIDTH = 17, 16
MAX_TRAIN, MAX_BYTES, EPOCHS, MIN_STEPS, RATE = 4000, 64 << 20, 5, 6000, 0.2
_ODD = np.uint64(0x9E3779B97F4A7C15)
_P = np.uint64(0x100000001B3)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2 ** 64, and their inverses."""
    inverse = np.uint64(pow(int(_P), -1, 1 << 64))
    return tuple(np.concatenate((np.ones(1, dtype=np.uint64), np.multiply.accumulate(np.full(n, x, dtype=np.uint64)))) for x in (_P, inverse))


class _Tables:
    n = 0
    up: np.ndarray
    down: np.ndarray

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > cls.n:
            cls.n = max(n, 2 * cls.n, 1 << 14)
            cls.up, cls.down = _powers(cls.n)
        return cls.up, cls.down


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def features(text: str) -> np.ndarray:
    """The hashes (below 2 ** BITS) of all n-grams of a text, repeats included."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    if not len(data):
        return np.zeros(0, dtype=np.int64)
    wide = data.astype(np.uint64) + np.uint64(1)
    shift = np.uint64(64 - BITS)
    out = []
    blank = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if len(starts):
        up, down = _Tables.get(len(data) + 1)
        total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(wide * up[: len(data)], dtype=np.uint64)))
        word = (total[ends] - total[starts]) * down[starts] * _ODD
        word ^= word >> np.uint64(29)
        out.append((word * _ODD) >> shift)
        out.append(((word[:-1] * np.uint64(3) + word[1:] * np.uint64(7)) * _ODD) >> shift)
    gram = wide
    for n in (2, 3, 4):
        gram = gram[:-1] * np.uint64(257) + wide[n - 1 :]
        if n > 2:
            out.append(((gram + np.uint64(n << 40)) * _ODD) >> shift)
    return np.concatenate(out).astype(np.int64)


@dataclass
class Model:
    """The folded model: the log odds of class 1 are the bias and the mean weight of the n-grams."""

    weight: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        z = np.full(len(texts), self.bias)
        for i, t in enumerate(texts):
            f = features(t)
            if len(f):
                z[i] += self.weight[f].mean(dtype=np.float64)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Embeddings:
    """What is trained: a vector for every hash, and a softmax layer over a document's average vector."""

    table: np.ndarray
    layer: np.ndarray
    bias: np.ndarray

    def folded(self) -> Model:
        return Model((self.table @ (self.layer[:, 1] - self.layer[:, 0])).astype(np.float32), float(self.bias[1] - self.bias[0]))


def train_embeddings(texts: list[str], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> Embeddings:
    """Embeddings and softmax layer by stochastic gradient descent, one document a step; labels of both classes."""
    y = np.array(labels, dtype=np.int64)
    rng = np.random.default_rng(seed)
    table = ((rng.random((1 << BITS, WIDTH)) - 0.5) / WIDTH).astype(np.float32)
    layer, bias = np.zeros((WIDTH, 2), dtype=np.float32), np.zeros(2, dtype=np.float32)
    rows = []
    for t in texts:
        f, n = np.unique(features(t).astype(np.int32), return_counts=True)
        rows.append((f, n.astype(np.uint16 if n.max(initial=0) < 1 << 16 else np.int64)))
    epochs = max(epochs, -(-MIN_STEPS // len(rows)))
    steps, step = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)).tolist():
            f, n = rows[i]
            n = n.astype(np.float64)
            w = (n / max(n.sum(), 1)).astype(np.float32)
            now = rate * (1 - step / steps)
            step += 1
            mean = w @ table[f]
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1  # the gradient of the log loss
            back = layer @ p
            layer -= now * np.outer(mean, p)
            bias -= now * 0.1 * p
            # A document's step is shared among its n-grams in the proportion in which they make its average.
            table[f] -= np.outer(now * len(f) * w, back)
    return Embeddings(table, layer, bias)


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> Model:
    """The folded model; without labels of both classes the share of class 1."""
    if len(set(labels)) < 2:
        share = float(np.clip(np.mean(labels) if labels else 0.5, 0.01, 0.99))
        return Model(np.zeros(1 << BITS, dtype=np.float32), float(np.log(share / (1 - share))))
    return train_embeddings(texts, labels, epochs, rate, seed).folded()


def remainder(id_col: str, modulus: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, max_train: int = MAX_TRAIN, max_bytes: int = MAX_BYTES) -> tuple[list[str], list[int]]:
    """Texts and labels of at most ``max_train`` labelled documents, and ``max_bytes``, whose id's CRC-32 modulo ``folds`` is not 0."""
    known = labels.filter(F.col(label_col).isin(0, 1) & (remainder(id_col, folds) != 0))
    chosen = known.select(F.col(id_col), F.col(label_col).alias("label")).orderBy(F.xxhash64(id_col), id_col, "label").limit(max_train)
    text = text_of(text_col)
    mark = ["h", id_col, "label", "t"]
    sizes = docs.select(F.col(id_col), F.xxhash64(text).alias("t"), F.octet_length(text).cast("long").alias("size")).join(F.broadcast(chosen), id_col)
    sizes = sizes.withColumn("h", F.xxhash64(id_col)).orderBy(*mark).limit(max_train)
    # The bytes of rows before are summed over at most max_train rows, without their texts.
    before = F.sum("size").over(Window.orderBy(*mark).rowsBetween(Window.unboundedPreceding, -1))
    kept = sizes.withColumn("before", F.coalesce(before, F.lit(0))).filter((F.col("before") == 0) | (F.col("before") + F.col("size") <= max_bytes))
    kept = kept.select(id_col, "t", "label").distinct()
    rows = docs.select(F.col(id_col), text.alias("text"), F.xxhash64(text).alias("t")).join(F.broadcast(kept), [id_col, "t"]).select(id_col, "text", "label").limit(max_train).collect()
    rows.sort(key=lambda r: (r[0], r[2], r[1]))  # the order must not depend on the partitions
    return [r[1] for r in rows], [int(r[2]) for r in rows]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, max_train: int = MAX_TRAIN, max_bytes: int = MAX_BYTES) -> Model:
    """The model trained on ``training_rows``."""
    return train(*training_rows(docs, labels, id_col, text_col, label_col, folds, max_train, max_bytes))


def _scores(model: Model):
    weight, bias = model.weight, model.bias

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        return pa.array(Model(weight, bias).scores(texts.to_pylist()), type=pa.float64())

    return scores


def score(docs: DataFrame, model: Model, threshold: float = 0.3, folds: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score and predicted of every row.  Narrow: no shuffle."""
    prepare(docs.sparkSession)
    docs = spread(docs.select(id_col, text_col))
    out = docs.select(F.col(id_col), F.coalesce(remainder(id_col, folds) == 0, F.lit(False)).alias("held_out"), _scores(model)(text_of(text_col)).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def accepted(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns."""
    prepare(docs.sparkSession)
    return docs.filter(_scores(model)(text_of(text_col)) >= threshold)

"""Quality classifier: supervised subword embeddings.

Words, word pairs (those of one word twice share a feature besides) and character n-grams are hashed to learned vectors; a document is the average of its vectors, a
softmax layer gives the classes, and numpy SGD trains both.  Averaging and the output layer are linear, so for scoring
each hashed vector folds to one number and a whole text costs one gather and one sum per feature.

The fit uses a bounded sample of labelled rows (``per_class`` rows a label, ``SAMPLE_BYTES`` of text in all, one text an id); scoring covers every row and whole texts.

Defined cases: null and empty texts have no features and get the score of the bias alone; without labels, or with one
class only, every score is the share of label 1 (0.5 without labels); repeated rows and ties get equal scores; an empty
table gives no rows; other columns aren't read.  A document labelled twice is learned from twice.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, col, id_remainder, labelled_texts, read
from .textvec import SPACE, Batch, bucket, chunks, gram_codes, windows

BITS, DIM, GRAMS = 18, 8, (3, 4)
PER_CLASS = 1500
THRESHOLD = 0.3


@dataclass
class SubwordModel:
    folded: np.ndarray  # logit of label 1 against 0, per bucket
    bias: float


def _features(texts: list[str | None]):
    """Yields (bucket, document) arrays of words, word pairs and character n-grams."""
    b = Batch(texts)
    h = b.words()
    yield (h >> np.uint64(64 - BITS)).astype(np.int64), b.doc
    pair, doc = windows(h, b.doc, 2)
    yield (pair >> np.uint64(64 - BITS)).astype(np.int64), doc
    # pairs of one word twice also share a feature, whatever the word
    twice = (h[1:] == h[:-1]) & (b.doc[1:] == b.doc[:-1])
    yield np.zeros(int(twice.sum()), np.int64), b.doc[1:][twice]
    space = SPACE[b.buf]
    symbols = np.where(space, np.uint8(32), b.buf)
    of = np.repeat(np.arange(b.n), np.diff(b.at))
    for n in GRAMS:
        code, valid = gram_codes(symbols, space, n, 8)
        yield bucket(code[valid], n, BITS).astype(np.int64), of[: len(code)][valid]


def fit(texts: list[str], labels: list[int], epochs: int = 4, rate: float = 0.5, seed: int = 3) -> SubwordModel:
    """SGD over documents; the rate falls linearly to 0."""
    y = np.array(labels, dtype=np.int64)
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or share in (0.0, 1.0):
        s = min(max(share, 1e-6), 1 - 1e-6)
        return SubwordModel(np.zeros(1 << BITS, np.float32), float(np.log(s / (1 - s))))
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((1 << BITS, DIM)) - 0.5) / DIM).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    bags = []
    for _, part in chunks(texts, 1 << 18):
        fs = list(_features(part))
        f, d = np.concatenate([x[0] for x in fs]), np.concatenate([x[1] for x in fs])
        order = np.argsort(d, kind="stable")
        bags += np.split(f[order], np.searchsorted(d[order], np.arange(1, len(part))))
    bags = [np.unique(b, return_counts=True) for b in bags]
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            f, c = bags[i]
            lr = rate * (1 - done / steps)
            done += 1
            if not len(f):
                continue
            c = (c / c.sum()).astype(np.float32)
            v = vectors[f]
            hidden = c @ v
            x = hidden @ out + bias
            p = np.exp(x - x.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = out @ p
            out -= lr * np.outer(hidden, p)
            bias -= 0.1 * lr * p
            # each vector moves by its share of the average, scaled up as for a bag of distinct features
            vectors[f] = v - lr * (c * min(len(f), 64))[:, None] * back[None, :]
    w = out[:, 1] - out[:, 0]
    return SubwordModel((vectors @ w).astype(np.float32), float(bias[1] - bias[0]))


def predict(model: SubwordModel, texts: list[str | None]) -> np.ndarray:
    """Probability of label 1 of each whole text."""
    scores = np.zeros(len(texts))
    for first, part in chunks(texts, 1 << 18):
        total, seen = np.zeros(len(part)), np.zeros(len(part))
        for f, d in _features(part):
            total += np.bincount(d, model.folded[f], minlength=len(part))
            seen += np.bincount(d, minlength=len(part))
        x = total / np.maximum(1, seen) + model.bias
        scores[first : first + len(part)] = 1 / (1 + np.exp(-np.clip(x, -50, 50)))
    return scores


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id", per_class: int = PER_CLASS) -> SubwordModel:
    """Fit on about ``per_class`` rows of each label; ``docs`` holds learnable rows only."""
    lab = labels.select(col(key).alias("k"), col(label).cast("int").alias("label")).filter("label in (0, 1)")
    # the sample is drawn among the narrow label rows, so the join moves few texts
    chosen = bounded_sample(lab.join(docs.select(col(key).alias("k")), "k", "left_semi"), "label", per_class, ["k"])
    got = labelled_texts(docs.select(col(key).alias("k"), col(text).alias("text")), chosen)
    got = sorted((r.k, r.label, r.text or "") for r in got)
    return fit([g[2] for g in got], [g[1] for g in got])


def quality(model: SubwordModel, text: Column) -> Column:
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(predict(model, texts.tolist()))

    return score(text)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", id_remainder("doc_id", 5) == 0)
    model = train(docs.filter(~F.col("held_out")), read(spark, sf_dir, "labels"))
    out = docs.select("doc_id", "held_out", quality(model, F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))

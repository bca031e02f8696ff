"""Toxicity by a classifier chain: categories are predicted one after the other, each linear model seeing the
probabilities of the categories before it.

In training those probabilities are out of fold: a link's feature for a row comes from a model that never saw the row,
so later links learn to trust earlier ones as far as they deserve.  Text features are the presence of letter runs and of
their first five bytes, kept as exact 64-bit hashes of a learned vocabulary: an unknown word has no feature, so no
clean word can collide with a toxic one.

``categories`` are 0/1 label columns in chain order; the last one is the verdict.  The labels table marks quality and
toxicity, so the query's chain is low_quality, then toxic.

The fit uses a bounded sample of labelled rows (``per_class`` rows a pattern of labels, ``SAMPLE_BYTES`` of text in all, one text an id); scoring covers every row and whole texts, in Arrow
batches bounded in bytes (``bound_batches``, which sets the limit for the session).

Defined cases: null and empty texts have no feature and get the bias; a row without a label in some category isn't
learned from; without labels, or with one class only, a category's probability is its share of ones (0 without labels);
repeated rows and ties get equal scores; an empty table gives no rows; ``reject_toxic`` keeps all columns of the input.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, bounded_sample, col, free_name, labelled_texts, read
from .textvec import NOT_LETTER, Batch, chunks

CATEGORIES = ("low_quality", "toxic")
PER_CLASS, FOLDS, MIN_DOCS, MIN_Z = 2500, 3, 3, 4.0
THRESHOLD = 0.5


@dataclass
class ChainModel:
    vocabulary: np.ndarray  # sorted hashes
    weights: np.ndarray  # (vocabulary, categories)
    links: np.ndarray  # (categories, categories): weight of an earlier probability in a later link
    bias: np.ndarray


def _hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, int]:
    b = Batch(texts, lower=True, sep=NOT_LETTER)
    prefix = b.prefix()
    long = b.ends - b.starts > 5
    h = np.concatenate((b.hashes(b.starts, b.ends, 0, prefix), b.hashes(b.starts[long], b.starts[long] + 5, 1, prefix)))
    return h, np.concatenate((b.doc, b.doc[long])), b.n


def _lookup(vocabulary: np.ndarray, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, int]:
    """(feature, document) pairs, each once, of one batch."""
    h, doc, n = _hashes(texts)
    if not len(vocabulary):
        return np.empty(0, np.int64), np.empty(0, np.int64), n
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    known = vocabulary[at] == h
    key = np.unique(doc[known] * len(vocabulary) + at[known])
    return key % len(vocabulary), key // len(vocabulary), n


def _logistic(feat: np.ndarray, row: np.ndarray, n: int, size: int, more: np.ndarray, y: np.ndarray, l2: float = 1e-4, steps: int = 150, rate: float = 0.2) -> tuple[np.ndarray, np.ndarray, float]:
    """L2-penalised logistic regression by full-batch Adam; (feature weights, weights of ``more``, bias).

    Features that don't tell the classes apart (|z| under MIN_Z) stay at 0; the rest enter with their log ratio as
    value, so that a rare but certain word isn't outweighed by many common ones.
    """
    k = more.shape[1]
    if not len(y) or y.min() == y.max():
        share = min(max(float(y.mean()), 1e-6), 1 - 1e-6) if len(y) else 1e-6
        return np.zeros(size), np.zeros(k), float(np.log(share / (1 - share)))
    share = float(y.mean())
    seen, ones = np.bincount(feat, minlength=size), np.bincount(feat, y[row], minlength=size)
    z = (ones - seen * share) / np.sqrt(np.maximum(seen, 1) * share * (1 - share))
    used = np.flatnonzero(np.abs(z) >= MIN_Z)
    ratio = np.log((ones[used] + 1) / (y.sum() + 2)) - np.log((seen[used] - ones[used] + 1) / (n - y.sum() + 2))
    to = np.full(size, -1)
    to[used] = np.arange(len(used))
    inside = to[feat] >= 0
    f, r, m_ = to[feat[inside]], row[inside], len(used)
    value = ratio[f]
    w = np.zeros(m_ + k + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        x = np.bincount(r, value * w[f], minlength=n) + more @ w[m_ : m_ + k] + w[-1]
        err = (1 / (1 + np.exp(-np.clip(x, -40, 40))) - y) / n
        g = np.concatenate((np.bincount(f, value * err[r], minlength=m_), more.T @ err, [err.sum()])) + l2 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate / (1 + t / 50) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    out = np.zeros(size)
    out[used] = w[:m_] * ratio
    return out, w[m_ : m_ + k], float(w[-1])


def fit(texts: list[str], labels: np.ndarray, folds: int = FOLDS) -> ChainModel:
    """``labels``: (rows, categories) of 0/1, in chain order."""
    c = labels.shape[1] if labels.ndim == 2 else len(CATEGORIES)
    if not len(texts):
        return ChainModel(np.empty(0, np.uint64), np.zeros((0, c)), np.zeros((c, c)), np.full(c, -30.0))
    found = []
    for _, part in chunks(texts):
        h, doc, _ = _hashes(part)
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        found.append(h[new])
    values, counts = np.unique(np.concatenate(found), return_counts=True)
    vocabulary = values[counts >= MIN_DOCS]
    feats, rows, base = [], [], 0
    for _, part in chunks(texts):
        f, d, n = _lookup(vocabulary, part)
        feats.append(f)
        rows.append(d + base)
        base += n
    feat, row = np.concatenate(feats), np.concatenate(rows)
    n, size = len(texts), len(vocabulary)
    fold = np.arange(n) % folds
    weights, links, bias = np.zeros((size, c)), np.zeros((c, c)), np.zeros(c)
    before = np.zeros((n, 0))
    for j in range(c):
        y = labels[:, j].astype(float)
        weights[:, j], links[j, :j], bias[j] = _logistic(feat, row, n, size, before, y)
        if j + 1 < c:
            out = np.zeros(n)
            for k in range(folds):
                inside = fold != k
                at = np.cumsum(inside) - 1
                keep = inside[row]
                w, l, b = _logistic(feat[keep], at[row[keep]], int(inside.sum()), size, before[inside], y[inside]) if inside.any() else (np.zeros(size), np.zeros(j), 0.0)
                x = np.bincount(row, w[feat], minlength=n) + before @ l + b
                out[~inside] = (1 / (1 + np.exp(-np.clip(x, -40, 40))))[~inside]
            before = np.column_stack((before, out))
    used = np.abs(weights).sum(axis=1) > 0
    return ChainModel(vocabulary[used], weights[used], links, bias)


def predict(model: ChainModel, texts: list[str | None]) -> np.ndarray:
    """(texts, categories) probabilities of whole texts."""
    c = len(model.bias)
    out = np.zeros((len(texts), c))
    for first, part in chunks(texts, 1 << 18):
        f, d, n = _lookup(model.vocabulary, part)
        for j in range(c):
            x = np.bincount(d, model.weights[f, j], minlength=n) + out[first : first + n, :j] @ model.links[j, :j] + model.bias[j]
            out[first : first + n, j] = 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    return out


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", per_class: int = PER_CLASS) -> ChainModel:
    """Fit the low_quality, toxic chain on a bounded sample of the labelled rows of ``docs``."""
    lab = labels.select(col(key).alias("k"), (F.lit(1) - col("quality").cast("int")).alias("low_quality"), col("toxic").cast("int").alias("toxic")).filter("low_quality in (0, 1) and toxic in (0, 1) and k is not null")
    lab = lab.withColumn("pattern", F.col("toxic") * 2 + F.col("low_quality"))
    chosen = bounded_sample(lab.join(docs.select(col(key).alias("k")), "k", "left_semi"), "pattern", per_class, ["k"])
    got = labelled_texts(docs.select(col(key).alias("k"), col(text).alias("text")), chosen.select("k", "low_quality", "toxic"))
    got = sorted((r.k, r.low_quality, r.toxic, r.text or "") for r in got)
    got = [got[i] for i in np.random.default_rng(5).permutation(len(got))]
    return fit([g[3] for g in got], np.array([g[1:3] for g in got]).reshape(-1, 2))


def chain(model: ChainModel, text: Column, categories: Sequence[str] = CATEGORIES) -> Column:
    """struct of the categories' probabilities."""

    @F.pandas_udf(", ".join(f"{c} double" for c in categories))
    def score(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(predict(model, texts.tolist()), columns=list(categories))

    return score(text)


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The documents whose last category stays below the threshold, with all their columns."""
    bound_batches(docs.sparkSession)
    model, p = train(docs, labels, text), free_name(docs, "toxicity")
    return docs.withColumn(p, chain(model, col(text))).filter(col(p).getField("toxic") < threshold).select(*(col(c) for c in docs.columns))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    bound_batches(spark)
    model = train(docs, read(spark, sf_dir, "labels"))
    out = docs.select("doc_id", chain(model, F.col("text")).alias("p"))
    return out.select("doc_id", F.col("p.low_quality").alias("low_quality_score"), F.col("p.toxic").alias("score"), (F.col("p.toxic") >= THRESHOLD).alias("toxic"))

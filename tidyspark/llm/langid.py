"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained by FTRL-proximal (per-coordinate rates, L1 and L2 penalties, so most weights are exactly 0), then one temperature
is fitted on held-back sample rows so that scores are calibrated.  A text's feature is its relative n-gram frequency
times the n-gram's inverse document frequency; both whole-text sums, so scoring is one gather and one sum per n-gram.

The fit uses a bounded sample of labelled rows (``per_class`` rows a language, ``SAMPLE_BYTES`` of text in all); scoring covers every row and whole texts.

Defined cases: null texts and texts without a letter are ``und`` with score 0; null labels aren't learned from; without
any labelled row every text is ``und``; repeated rows and ties get equal predictions (a tie goes to the language that
sorts first); an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, col, id_remainder, read, within_bytes
from .textvec import bucket, chunks, gram_codes

GRAMS, BITS = (1, 2, 3), 16
PER_CLASS = 1500
_SPACES = re.compile(r"[\x09-\x0D]")
_SCALE = 30.0


@dataclass
class LanguageModel:
    labels: list[str]
    weights: np.ndarray  # (2**BITS, labels): idf times coefficient, few not 0
    bias: np.ndarray
    temperature: float


def _symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, one space after each, and where each text begins."""
    low = [_SPACES.sub(" ", t.lower()) if t else "" for t in texts]
    at = np.concatenate(([0], np.cumsum([len(t) + 1 for t in low])))
    return np.frombuffer((" ".join(low) + " ").encode("utf-32-le", "surrogatepass"), np.uint32), at


def _grams(texts: list[str | None]):
    """Per gram length: (bucket of each position, valid); and the texts' beginnings."""
    symbols, at = _symbols(texts)
    space = symbols == 32
    out = []
    for n in GRAMS:
        code, valid = gram_codes(symbols, space, n, 21)
        if n == 1:
            valid = ~space
        out.append((bucket(code, n, BITS).astype(np.int64), valid))
    return out, at


def _counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CSR of relative frequencies: (indptr, feature, value)."""
    ptr, feats, vals = [0], [], []
    for _, part in chunks(texts, 1 << 18):
        grams, at = _grams(part)
        for i in range(len(part)):
            g = np.concatenate([b[at[i] : at[i + 1]][v[at[i] : at[i + 1]]] for b, v in grams])
            u, c = np.unique(g, return_counts=True)
            feats.append(u)
            vals.append(c / max(1, len(g)))
            ptr.append(ptr[-1] + len(u))
    return np.array(ptr), np.concatenate(feats) if feats else np.empty(0, np.int64), np.concatenate(vals) if vals else np.empty(0)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[str], labels: list[str], epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, batch: int = 16, seed: int = 7) -> LanguageModel | None:
    """FTRL-proximal with elastic net, then temperature calibration on every fifth row."""
    names = sorted(set(labels))
    if not names:
        return None
    y = np.searchsorted(names, labels)
    ptr, feat, val = _counts(texts)
    d, c = 1 << BITS, len(names)
    df = np.bincount(feat, minlength=d)
    idf = np.log((1 + len(texts)) / (1 + df)) + 1
    val = val * idf[feat] * _SCALE
    z, n = np.zeros((d + 1, c)), np.zeros((d + 1, c))

    def weight(rows: np.ndarray) -> np.ndarray:
        zz = z[rows]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(n[rows])) / alpha + l2))

    def gather(docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = ptr[docs + 1] - ptr[docs]
        rows = np.repeat(np.arange(len(docs)), k)
        pos = np.repeat(ptr[docs] - np.concatenate(([0], np.cumsum(k)[:-1])), k) + np.arange(k.sum())
        return rows, feat[pos], val[pos]

    def logits(docs: np.ndarray, w: np.ndarray, inverse: np.ndarray, rows: np.ndarray, v: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(rows, v * w[inverse, j], minlength=len(docs)) for j in range(c)], axis=1) + b

    rng = np.random.default_rng(seed)
    order = np.arange(len(texts))
    held = order % 5 == 4 if len(texts) >= 50 else np.zeros(len(texts), bool)
    train = order[~held]
    for _ in range(epochs):
        rng.shuffle(train)
        for s in range(0, len(train), batch):
            docs = train[s : s + batch]
            rows, f, v = gather(docs)
            u, inverse = np.unique(f, return_inverse=True)
            w, b = weight(u), weight(np.array([d]))[0]
            err = _softmax(logits(docs, w, inverse, rows, v, b))
            err[np.arange(len(docs)), y[docs]] -= 1
            g = np.stack([np.bincount(inverse, v * err[rows, j], minlength=len(u)) for j in range(c)], axis=1)
            for at, wt, grad in ((u, w, g), (np.array([d]), b[None], err.sum(axis=0, keepdims=True))):
                sigma = (np.sqrt(n[at] + grad**2) - np.sqrt(n[at])) / alpha
                z[at] += grad - sigma * wt
                n[at] += grad**2
    w = weight(np.arange(d + 1))
    bias = w[d]
    # temperature: least negative log likelihood of the rows held back
    t = 1.0
    if held.any():
        docs = order[held]
        rows, f, v = gather(docs)
        x = logits(docs, w[:d], f, rows, v, bias)

        def loss(log_t: float) -> float:
            p = _softmax(x / np.exp(log_t))
            return -np.log(np.maximum(p[np.arange(len(docs)), y[docs]], 1e-12)).mean()

        grid = np.linspace(-3, 3, 121)
        t = float(np.exp(grid[int(np.argmin([loss(v) for v in grid]))]))
    return LanguageModel(names, (w[:d] * idf[:, None] * _SCALE).astype(np.float32), bias, t)


def predict(model: LanguageModel | None, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and calibrated score of each whole text."""
    langs, scores = ["und"] * len(texts), np.zeros(len(texts))
    if model is None:
        return langs, scores
    c = len(model.labels)
    for first, part in chunks(texts, 1 << 17):
        grams, at = _grams(part)
        total, seen = np.zeros((len(part), c)), np.zeros(len(part))
        doc = np.repeat(np.arange(len(part)), np.diff(at))
        for b, valid in grams:
            d, b = doc[: len(b)][valid], b[valid]
            seen += np.bincount(d, minlength=len(part))
            for j in range(c):
                total[:, j] += np.bincount(d, model.weights[b, j], minlength=len(part))
        p = _softmax((total / np.maximum(1, seen)[:, None] + model.bias) / model.temperature)
        for i, t in enumerate(part):
            if t and any(map(str.isalpha, t)):
                k = int(p[i].argmax())
                langs[first + i], scores[first + i] = model.labels[k], p[i, k]
    return langs, scores


def train(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", per_class: int = PER_CLASS) -> LanguageModel | None:
    """Fit on about ``per_class`` rows of each label; ``docs`` holds learnable rows only."""
    rows = docs.select(col(key).alias("k"), col(text).alias("text"), col(label).alias("label")).filter("text is not null and label is not null")
    got = sorted((r.k is None, r.k, r.text, r.label) for r in within_bytes(bounded_sample(rows, "label", per_class, ["k", "text"]), "text", ["k", "text"]).collect())
    rng = np.random.default_rng(1)
    got = [got[i] for i in rng.permutation(len(got))]
    return fit([g[2] for g in got], [g[3] for g in got])


def identify(model: LanguageModel | None, text: Column) -> Column:
    """struct(lang, score) of a text column."""

    @F.pandas_udf("lang string, score double")
    def score(texts: pd.Series) -> pd.DataFrame:
        langs, scores = predict(model, texts.tolist())
        return pd.DataFrame({"lang": langs, "score": scores})

    return score(text)


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", id_remainder("doc_id", 4) == 2)
    model = train(docs.filter(~F.col("held_out")))
    out = docs.select("doc_id", "held_out", identify(model, F.col("text")).alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))

"""URL filtering: rules first, then gradient-boosted trees on lexical features.

The rules label the URLs they fit; a bounded sample of these (``PER_CLASS`` a verdict, ``SAMPLE_BYTES`` in all) trains the
trees (histogram splits, logistic loss), which judge every URL that no rule fits.  The suffixes' block rates are counted
over all labelled URLs and joined on, heavy suffixes apart.  Features: lengths of URL, host and path, path depth, digit ratio, character entropy,
parameter count, host labels, hyphens, and smoothed block rates of the host's suffixes.

Host and path are parsed, and rules matched, by DataFrame functions; only scoring is a pandas UDF.

Defined cases: a null URL, or one without ``://``, has empty host and path and fits no rule; a tie of equally long rules
goes to block; without labelled URLs the verdict is allow, with one class only it is that class; repeated rows get equal
verdicts; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shelf, bounded_sample, col, join_hot, read, within_bytes

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
PER_CLASS = 10_000
#: Rows' worth of the overall rate that a suffix's rate starts with.
WEIGHT = 20.0
FEATURES = ("url_length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "parameters", "host_labels", "hyphens", "suffix_1", "suffix_2")


def parse(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path."""
    names = [col(c) for c in df.columns]
    rest = F.when(F.instr(F.col("_u"), "://") > 0, F.expr("substring(_u, instr(_u, '://') + 3)")).otherwise(F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    out = df.select(*names, F.coalesce(col(url), F.lit("")).alias("_u")).withColumn("_r", rest)
    host = F.regexp_extract("_r", r"^([^/?#]*)", 1)
    path = F.regexp_extract("_r", r"^[^/?#]*([^?#]*)", 1)
    return out.withColumn("host", F.translate(host, upper, upper.lower())).withColumn("path", path).drop("_u", "_r")


def match_rules(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[1] == "block", r[0])):
        at = text.find("/") if "/" in text else len(text)
        h, p = text[:at], text[at:]
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


@dataclass
class UrlModel:
    prior: float
    suffixes: dict[str, float] = field(default_factory=dict)
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # complete trees: feature, bin, leaf values


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * np.log2(c / n) for c in Counter(s).values()) if n else 0.0


def suffixes(host: Column) -> tuple[Column, Column]:
    """A host's last label and its last two."""
    return F.substring_index(host, ".", -1), F.substring_index(host, ".", -2)


def suffix_rates(judged: DataFrame, weight: float = WEIGHT) -> DataFrame:
    """(suffix, rate, n): the smoothed share of blocked URLs of each suffix, over all URLs that rules label; n: the
    suffix's rows in the whole table."""
    blocked = F.when(F.col("verdict") == "block", 1.0).when(F.col("verdict") == "allow", 0.0)
    s1, s2 = suffixes(F.col("host"))
    # a host of one label is one suffix
    each = judged.select(blocked.alias("y"), F.explode(F.array_distinct(F.array(s1, s2))).alias("suffix"))
    counts = each.groupBy("suffix").agg(F.sum("y").alias("blocked"), F.count("y").alias("seen"), F.count(F.lit(1)).alias("n"))
    prior = judged.agg(F.avg(blocked)).first()[0]
    prior = F.lit(0.0 if prior is None else min(max(prior, 1e-6), 1 - 1e-6))
    return counts.filter("seen > 0").select("suffix", ((F.col("blocked") + F.lit(weight) * prior) / (F.col("seen") + F.lit(weight))).alias("rate"), "n")


def features(urls: Sequence[str | None], hosts: Sequence[str], paths: Sequence[str], suffixes: dict[str, float], prior: float, rates: np.ndarray | None = None) -> np.ndarray:
    """``rates``: (urls, 2) block rates of the suffixes, NaN where unknown; else they are looked up in ``suffixes``."""
    out = np.empty((len(urls), len(FEATURES)))
    for i, (u, h, p) in enumerate(zip(urls, hosts, paths)):
        u = u or ""
        parts = h.split(".")
        query = u.partition("#")[0].partition("?")[2]
        out[i] = (
            len(u), len(h), len(p), sum(1 for x in p.split("/") if x), sum(map(str.isdigit, u)) / len(u) if u else 0.0, _entropy(u),
            query.count("&") + 1 if query else 0, len(parts), u.count("-"), suffixes.get(parts[-1], prior), suffixes.get(".".join(parts[-2:]), prior),
        )
    if rates is not None:
        out[:, -2:] = np.where(np.isnan(rates), prior, rates)
    return out


def _suffix_rates(hosts: Sequence[str], y: np.ndarray, prior: float, weight: float = WEIGHT) -> dict[str, float]:
    """Smoothed share of blocked URLs of each last label and last two labels."""
    n, blocked = Counter(), Counter()
    for h, b in zip(hosts, y):
        parts = h.split(".")
        for s in {parts[-1], ".".join(parts[-2:])}:
            n[s] += 1
            blocked[s] += int(b)
    return {s: (blocked[s] + weight * prior) / (n[s] + weight) for s in n}


def fit(urls: list[str], hosts: list[str], paths: list[str], y: np.ndarray, rates: np.ndarray | None = None, rounds: int = 60, depth: int = 4, rate: float = 0.2, l2: float = 1.0, bins: int = 32) -> UrlModel:
    """Boosted complete trees of one depth; second-order gains on quantile bins."""
    if not len(y):
        return UrlModel(-30.0)
    share = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
    prior = float(np.log(share / (1 - share)))
    model = UrlModel(prior)
    if y.min() == y.max():
        return model
    if rates is None:
        model.suffixes = _suffix_rates(hosts, y, share)
    x = features(urls, hosts, paths, model.suffixes, share, rates)
    model.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    b = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(model.edges)], axis=1)
    score = np.full(len(y), prior)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feat, cutat = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, bins, np.int64)
        for level in range(depth):
            n = 2**level
            best = np.full(n, 1e-6)
            for j in range(x.shape[1]):
                hist_g = np.bincount(node * bins + b[:, j], g, minlength=n * bins).reshape(n, bins)
                hist_h = np.bincount(node * bins + b[:, j], h, minlength=n * bins).reshape(n, bins)
                gl, hl = hist_g.cumsum(1), hist_h.cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                k = gain.argmax(1)
                top = gain[np.arange(n), k]
                better = top > best
                best = np.where(better, top, best)
                at = n - 1 + np.arange(n)
                feat[at[better]], cutat[at[better]] = j, k[better]
            at = n - 1 + node
            node = 2 * node + (b[np.arange(len(y)), feat[at]] > cutat[at])
        leaf = -rate * np.bincount(node, g, minlength=2**depth) / (np.bincount(node, h, minlength=2**depth) + l2)
        score += leaf[node]
        model.trees.append((feat, cutat, leaf))
    return model


def predict(model: UrlModel, urls: Sequence[str | None], hosts: Sequence[str], paths: Sequence[str], rates: np.ndarray | None = None) -> np.ndarray:
    """Probability of block."""
    score = np.full(len(urls), model.prior)
    if model.trees and len(urls):
        x = features(urls, hosts, paths, model.suffixes, 1 / (1 + np.exp(-model.prior)), rates)
        b = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(model.edges)], axis=1)
        rows = np.arange(len(urls))
        for feat, cutat, leaf in model.trees:
            node = np.zeros(len(urls), np.int64)
            for level in range(int(np.log2(len(leaf)))):
                at = 2**level - 1 + node
                node = 2 * node + (b[rows, feat[at]] > cutat[at])
            score += leaf[node]
    return 1 / (1 + np.exp(-score))


def train(judged: DataFrame, per_class: int = PER_CLASS) -> UrlModel:
    """Fit on about ``per_class`` rule-labelled URLs of each verdict; ``judged`` has url, host, path, verdict, rate_1, rate_2."""
    rows = judged.filter("verdict is not null").select("url", "host", "path", "verdict", "rate_1", "rate_2")
    got = sorted((r.url, r.host, r.path, r.verdict, r.rate_1, r.rate_2) for r in within_bytes(bounded_sample(rows, "verdict", per_class, ["url"]), "url", ["url"]).collect())
    rates = np.array([g[4:] for g in got], dtype=float).reshape(-1, 2)
    return fit([g[0] for g in got], [g[1] for g in got], [g[2] for g in got], np.array([g[3] == "block" for g in got], dtype=float), rates)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, url: str = "url", page_id: str = "page_id") -> DataFrame:
    """page_id, host, path, rule, verdict and (where no rule fits) the model's block probability."""
    df = parse(pages.select(col(page_id).alias("page_id"), col(url).cast("string").alias("url")))
    rule, verdict = match_rules(F.col("host"), F.col("path"), rules)
    df = df.withColumn("rule", rule).withColumn("verdict", verdict)
    rates = Shelf(pages.sparkSession, "url-rates").put(suffix_rates(df))
    for i, s in enumerate(suffixes(F.col("host")), 1):
        df = join_hot(df.withColumn("suffix", s), rates.withColumnRenamed("rate", f"rate_{i}"), ["suffix"], F.xxhash64("page_id", "url"), "n").drop("suffix")
    model = train(df)

    @F.pandas_udf("double")
    def block(urls: pd.Series, hosts: pd.Series, paths: pd.Series, fits: pd.Series, rate_1: pd.Series, rate_2: pd.Series) -> pd.Series:
        free = fits.isna().to_numpy()
        out = np.full(len(urls), np.nan)
        out[free] = predict(model, urls[free].tolist(), hosts[free].tolist(), paths[free].tolist(), np.column_stack((rate_1[free], rate_2[free])).astype(float))
        return pd.Series(out, dtype=object).where(free, None).astype("Float64")

    p = F.when(F.col("rule").isNull(), block("url", "host", "path", "rule", "rate_1", "rate_2"))
    df = df.select("page_id", "host", "path", "rule", "verdict", p.alias("block_probability"))
    return df.withColumn("verdict", F.coalesce("verdict", F.when(F.col("block_probability") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"))

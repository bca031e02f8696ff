"""Exact quantiles of groups of any size: no task holds a group's values.

Equal values of a group are counted first.  Cuts, about equally many rows apart, are collected (``CUTS`` numbers, no more) and
give each value a bucket; the buckets' counts tell which of them hold the wanted ranks, and only those are sorted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tbl import quoted

#: Buckets that the values are cut into.
CUTS = 256


def group_quantiles(df: DataFrame, keys: list[str], x: Column, wanted: dict[str, float | list[float]]) -> DataFrame:
    """Keys and, for each name, the quantile at its probability, or an array of those at several; groups without values have
    no row.  Linear interpolation, missing values skipped, as ``percentile``."""
    ks = [f"__k{i}__" for i in range(len(keys))]
    rows = df.select(*(quoted(k).alias(n) for k, n in zip(keys, ks)), x.cast("double").alias("v")).where("v is not null")
    cuts = rows.agg(F.percentile_approx("v", [i / CUTS for i in range(1, CUTS)], 20 * CUTS)).first()[0] or []
    cuts = sorted({c for c in cuts if c == c})
    counts = rows.groupBy(*ks, "v").agg(F.count(F.lit(1)).alias("n")).withColumn("bucket", _bucket(F.col("v"), cuts))
    by_key = Window.partitionBy(*ks) if ks else Window.partitionBy(F.lit(0))
    upto = by_key.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = counts.groupBy(*ks, "bucket").agg(F.sum("n").alias("m"))
    sizes = sizes.select(*ks, F.col("bucket").alias("of"), (F.sum("m").over(upto) - F.col("m")).alias("base"), F.sum("m").over(upto).alias("end"), F.sum("m").over(by_key).alias("size"))
    probs = sorted({p for w in wanted.values() for p in (w if isinstance(w, list) else [w])})
    at = {p: F.lit(p) * (F.col("size") - 1) for p in probs}
    ends = {p: (F.floor(c), F.ceil(c)) for p, c in at.items()}
    sizes = sizes.where(reduce(Column.__or__, [(F.col("base") <= r) & (r < F.col("end")) for pair in ends.values() for r in pair]))
    sizes = sizes.select(*(F.col(k).alias(f"{k}of") for k in ks), "of", "base", "size")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"{k}of")) for k in ks], F.col("bucket") == F.col("of"))
    inside = Window.partitionBy(*ks, "bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = counts.join(sizes, same).withColumn("upto", F.col("base") + F.sum("n").over(inside))
    value = lambda r: F.max(F.when((F.col("upto") - F.col("n") <= r) & (r < F.col("upto")), F.col("v")))
    ranked = found.groupBy(*ks).agg(F.max("size").alias("size"), *(value(r).alias(f"{side}{i}") for i, p in enumerate(probs) for side, r in zip(("lo", "hi"), ends[p])))

    def result(p: float) -> Column:
        i, (below, above) = probs.index(p), ends[p]
        lo, hi = F.col(f"lo{i}"), F.col(f"hi{i}")
        return F.when((below == above) | (lo == hi), lo).otherwise((above - at[p]) * lo + (at[p] - below) * hi)

    out = [(F.array(*(result(p) for p in w)) if isinstance(w, list) else result(w)).alias(name) for name, w in wanted.items()]
    return ranked.select(*(F.col(n).alias(k) for n, k in zip(ks, keys)), *out)


def _bucket(v: Column, cuts: list[float]) -> Column:
    """How many of the sorted cuts lie below v, by halving."""
    if not cuts:
        return F.lit(0)
    held = F.array(*(F.lit(c) for c in cuts))
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.coalesce(F.get(held, low + step - 1) < v, F.lit(False)), low + step).otherwise(low))

"""Quantiles of large groups must not bring a group into one task."""

import math
import random

import pytest

import tidyspark as t
from tidyspark import f
from tidyspark.plans.tbl import Tbl


def _plan(tbl) -> str:
    return tbl.df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("groups", [True, False])
def test_quantiles_are_those_of_percentile_without_its_maps(spark, groups):
    rnd = random.Random(5)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([rnd.gauss(0, 1e6), float(rnd.randrange(4)), None, 7.5, -0.0])) for _ in range(4000)]
    rows += [("none", None), ("one", 3.25), ("two", 1.0), ("two", 2.0), ("nan", math.nan), ("nan", 1.0), ("nan", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    x = Tbl(df) >> t.group_by(f.g) if groups else Tbl(df)
    got = x >> t.summarise(p=t.round_(t.quantile(f.v, probs=0.9), digits=4), m=t.median(f.v), n=t.n(), spread=t.max_(f.v) - t.median(f.v), again=f.m * 2)
    assert "percentile(" not in _plan(got) and "median(" not in _plan(got)
    keys = "g" if groups else "'' as g"
    df.createOrReplaceTempView("large_groups")
    want = spark.sql(f"select {keys}, round(percentile(v, 0.9), 4) p, median(v) m, count(*) n, max(v) - median(v) spread, median(v) * 2 again from large_groups group by all")
    key = lambda r: repr([r[c] if c in r else "" for c in ("g", "p", "m", "n", "spread", "again")])
    have = [r.asDict() | ({} if groups else {"g": ""}) for r in got.collect()]
    assert sorted(map(key, have)) == sorted(key(r.asDict()) for r in want.collect())
    several = x >> t.reframe(q=t.quantile(f.v, probs=[0.1, 0.5, 1.0]))
    want = spark.sql(f"select {keys}, explode(percentile(v, array(0.1, 0.5, 1.0))) q from large_groups group by all").collect()
    assert sorted(repr(r["q"]) for r in several.collect()) == sorted(repr(r.q) for r in want)

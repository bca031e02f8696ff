"""An ungrouped tail must not bring the whole table into one task."""

import tidyspark as t
from tidyspark import f
from tidyspark.plans.tbl import Tbl


def _plan(tbl) -> str:
    return tbl.df._jdf.queryExecution().executedPlan().toString()


def test_ungrouped_tail_is_a_limit(spark):
    rows = [(i, None if i % 5 == 0 else i % 7) for i in range(50)]
    x = Tbl(spark.createDataFrame(rows, "i long, v long").repartition(4))
    got = x >> t.arrange(t.desc(f.v), f.i) >> t.tail(12)
    assert "Window" not in _plan(got) and "TakeOrdered" in _plan(got)
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))[-12:]
    assert [tuple(r) for r in got.collect()] == want
    got = x >> t.arrange(f.v, t.desc(f.i)) >> t.slice_tail(n=3)
    assert [tuple(r) for r in got.collect()] == sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, -r[0]))[-3:]
    assert (x >> t.arrange(f.i) >> t.slice_tail(n=0)).collect() == []

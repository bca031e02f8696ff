import pytest
from conftest import SF, plain

from tidyspark.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    if name not in ORACLES:
        assert got.count() > 0
        return
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(want.columns)
    if name == "casts_dates":
        cols.remove("d")
    assert plain(got.select(*cols).toPandas().astype(object).itertuples(index=False)) == plain(want[cols].astype(object).itertuples(index=False))


def test_null_keys_join_the_whole_table(spark, duck):
    nulls = [r[0] for r in duck.execute("select o_orderkey from orders where o_orderstatus = 'P'").fetchall()]
    got = dict(map(tuple, QUERIES["join_na_keys"](spark, SF).select("o_orderkey", "n").collect()))
    assert nulls and {got[k] for k in nulls} == {len(nulls)}
    assert len(got) == duck.execute("select count(*) from orders").fetchone()[0]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

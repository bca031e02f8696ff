import tidyspark as t
from tidyspark import f


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "small.csv").write_text("a,b\n1,x\n2,\n")
    for got in (t.read_csv(str(tmp_path / "small.csv"), spark), t.load_dataset("small", str(tmp_path), spark)):
        assert sorted(map(tuple, got.collect()), key=str) == [(1, "x"), (2, None)]
    got >> t.write(str(tmp_path / "out.json"), format="json")
    assert t.read_json(str(tmp_path / "out.json"), spark) >> t.nrow() == 2


def test_unknown_dataset(spark, tmp_path):
    try:
        t.load_dataset("none", str(tmp_path), spark)
    except AttributeError:
        return
    raise AssertionError


def test_vectors_in_row_order(spark):
    x = t.tibble(g=["a", "a", "b", "a", "b"], v=[3, 1, 2, 3, None], s=["ab", "b", "ba", "c", None], spark=spark) >> t.group_by(f.g)
    one = lambda e: [tuple(r) for r in (x >> t.summarise(v=e)).collect()]
    assert sorted(one(t.unique(f.v)), key=str) == [("a", 1), ("a", 3), ("b", 2), ("b", None)]
    packed = {r[0]: (list(r[1]), list(r[2])) for r in (x >> t.summarise(o=t.append(t.order(f.v), [9]), p=t.append(t.order(f.v, decreasing=True), [9]))).collect()}
    assert packed == {"a": ([1, 0, 2, 9], [0, 2, 1, 9]), "b": ([0, 1, 9], [0, 1, 9])}
    assert sorted(one(t.grep("b", f.s)))[:2] == [("a", 0), ("a", 1)]
    assert sorted(one(t.grep("b", f.s, value=True))) == [("a", "ab"), ("a", "b"), ("b", "ba")]
    got = {r.g: (r.n, r.w, r.m) for r in (x >> t.summarise(n=t.nth(f.v, 1), w=t.which_max(f.v), m=t.nth(f.v, -1))).collect()}
    assert got == {"a": (1, 0, 3), "b": (None, 0, None)}


def test_too_many_levels_are_an_error(spark, monkeypatch):
    from tidyspark.functions import factors

    monkeypatch.setattr(factors, "MAX_LEVELS", 3)
    many = t.tibble(v=[f"x{i}" for i in range(4)], spark=spark)
    try:
        many >> t.mutate(g=t.factor(f.v))
    except ValueError as e:
        assert "levels" in str(e)
        return
    raise AssertionError


def test_pivot_wider_with_separators_in_values(spark):
    x = t.tibble(i=[1, 1], a=["p_q", "r"], b=["s", "t_u"], v=[5, 6], spark=spark)
    got = x >> t.pivot_wider(names_from=["a", "b"], values_from="v", names_glue="{b}-{a}")
    assert set(got.columns) == {"i", "s-p_q", "t_u-r"}


def test_cur_column_outside_across():
    try:
        t.cur_column()
    except ValueError:
        return
    raise AssertionError

"""Literal tables, and files in Spark's formats."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..plans.expr import Expr, Ref
from ..plans.tbl import ORDINAL, Tbl, evaluate, put, quoted, verb


def _spark(spark=None) -> SparkSession:
    return spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def tibble(*args, spark: SparkSession | None = None, _name_repair="check_unique", _rows: int | None = None, _dtypes=None, **columns) -> Tbl:
    """Literal columns; scalars and one-element lists recycle; later columns may be expressions of earlier ones."""
    from ..operators.joins import repair

    spark = _spark(spark)
    pairs = [(a.name, a) if isinstance(a, Ref) else a if isinstance(a, tuple) else (str(a), a) for a in args] + list(columns.items())
    several = lambda v: isinstance(v, (list, tuple, range)) or not isinstance(v, Expr) and hasattr(v, "tolist")
    lists = {k: list(v) for k, v in pairs if several(v)}
    sizes = {len(v) for v in lists.values()} - {1}
    if len(sizes) > 1:
        raise ValueError(f"sizes differ: {sorted(sizes)}")
    n = _rows if _rows is not None else sizes.pop() if sizes else 1
    literal, names = {}, repair([k for k, _ in pairs], _name_repair)
    later = []
    for name, (_, v) in zip(names, pairs):
        if isinstance(v, Expr):
            later.append((name, v))
        else:
            v = list(v) if several(v) else [v]
            v = [x.item() if hasattr(x, "item") else x for x in v]
            v = v * n if len(v) == 1 else v
            if any(isinstance(x, float) for x in v):
                v = [None if x is None or x != x else float(x) for x in v]
            literal[name] = v
    if all(all(x is None for x in v) for v in literal.values()) or not n:
        from pyspark.sql import types as T

        kind = lambda v: T.StringType() if all(x is None for x in v) else T.DoubleType() if isinstance(v[0], float) else T.StringType() if isinstance(v[0], str) else T.LongType()
        schema = T.StructType([T.StructField(ORDINAL, T.LongType())] + [T.StructField(k, kind(v)) for k, v in literal.items()])
    else:
        from pyspark.sql import types as T
        from pyspark.sql.types import _infer_type

        def kind_of(v):
            some = [x for x in v if x is not None]
            return _infer_type(some[0]) if some else T.StringType()

        schema = T.StructType([T.StructField(ORDINAL, T.LongType())] + [T.StructField(k, kind_of(v)) for k, v in literal.items()])
    rows = list(zip(range(n), *literal.values())) if literal else [(i,) for i in range(n)]
    out = Tbl(spark.createDataFrame(rows, schema))
    for name, e in later:
        out, bound = evaluate(out, e, name)
        out = out.with_df(put(out.df, name, bound))
    df = out.df
    for name, kind in (_dtypes.items() if isinstance(_dtypes, dict) else [(k, _dtypes) for k in names] if _dtypes else []):
        df = df.withColumn(name, quoted(name).cast(kind))
    return Tbl(df.select(quoted(ORDINAL), *(quoted(c) for c in names)))


def tribble(*cells, spark: SparkSession | None = None) -> Tbl:
    """``f.a, f.b, 1, 2, 3, 4``: headers, then rows."""
    names = []
    for x in cells:
        if not isinstance(x, Ref):
            break
        names.append(x.name)
    rest = cells[len(names) :]
    if not names or len(rest) % len(names):
        raise ValueError("cells don't fill whole rows")
    return tibble(spark=spark, **{n: list(rest[i :: len(names)]) for i, n in enumerate(names)})


def tibble_row(spark: SparkSession | None = None, **columns) -> Tbl:
    if any(isinstance(v, (list, tuple)) and len(v) != 1 for v in columns.values()):
        raise ValueError("one row only")
    return tibble(spark=spark, **columns)


fibble = tibble_ = tibble


def as_tibble(x, spark: SparkSession | None = None) -> Tbl:
    from pyspark.sql import DataFrame

    if isinstance(x, Tbl):
        return x
    if isinstance(x, DataFrame):
        return Tbl(x)
    if isinstance(x, dict):
        return tibble(spark=spark, **x)
    return Tbl(_spark(spark).createDataFrame(x))


def enframe(x, name: str | None = "name", value: str = "value", spark: SparkSession | None = None) -> Tbl:
    """List to (0-based position, value), dict to (key, value)."""
    if value is None:
        raise ValueError("value is needed")
    keys, values = (list(x), list(x.values())) if isinstance(x, dict) else (list(range(len(x))), list(x)) if isinstance(x, (list, tuple, range)) else ([0], [x])
    return tibble(spark=spark, **({name: keys} if name else {}), **{value: values})


def diag(x=1, nrow: int | None = None, spark: SparkSession | None = None):
    """Diagonal table of a scalar or vector; of a table, its diagonal."""
    if isinstance(x, Tbl):
        return [r[i] for i, r in enumerate(x.collect()) if i < len(x.columns)]
    v = [x] * (nrow or 1) if not isinstance(x, (list, tuple)) else list(x)
    if isinstance(x, int) and nrow is None:
        v = [1] * x
    return tibble(spark=spark, **{f"c{j}": [v[i] if i == j else 0 for i in range(len(v))] for j in range(len(v))})


def outer(x, y, fun="*", spark: SparkSession | None = None) -> Tbl:
    import operator

    g = {"*": operator.mul, "+": operator.add, "-": operator.sub, "/": operator.truediv}.get(fun, fun)
    return tibble(spark=spark, **{f"c{j}": [g(a, b) for a in x] for j, b in enumerate(y)})


def _nan_to_null(df):
    """Missing is null everywhere: NaN becomes null where data enters."""
    fixed = {f.name: F.when(~F.isnan(quoted(f.name)), quoted(f.name)) for f in df.schema if f.dataType.typeName() in ("double", "float")}
    return df.withColumns(fixed) if fixed else df


def read_parquet(path: str, spark: SparkSession | None = None, nan_is_null: bool = False) -> Tbl:
    df = _spark(spark).read.parquet(path)
    return Tbl(_nan_to_null(df) if nan_is_null else df)


def read_csv(path: str, spark: SparkSession | None = None, header: bool = True, schema: str | None = None, **options) -> Tbl:
    reader = _spark(spark).read.options(header=header, **options)
    return Tbl(_nan_to_null(reader.csv(path, schema=schema) if schema else reader.csv(path, inferSchema=True)))


def read_json(path: str, spark: SparkSession | None = None, **options) -> Tbl:
    return Tbl(_spark(spark).read.options(**options).json(path))


def read_orc(path: str, spark: SparkSession | None = None) -> Tbl:
    return Tbl(_spark(spark).read.orc(path))


def read_jdbc(url: str, table: str, spark: SparkSession | None = None, **options) -> Tbl:
    return Tbl(_spark(spark).read.format("jdbc").options(url=url, dbtable=table, **options).load())


def load_dataset(name: str, folder: str, spark: SparkSession | None = None) -> Tbl:
    """A CSV dataset by name; an unknown name is an AttributeError."""
    from pathlib import Path

    path = Path(folder) / f"{name}.csv"
    if not path.exists():
        raise AttributeError(f"no dataset {name!r}")
    return read_csv(str(path), spark)


@verb
def write(tbl: Tbl, path: str, format: str = "parquet", mode: str = "error", partition_by=()) -> None:
    writer = tbl.visible().write.format(format).mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


_OPTIONS: dict[str, object] = {}


def options(*names: str, **values) -> dict[str, object]:
    """Sets options and returns the old values of those set, or the values of ``names`` (all without arguments)."""
    if values:
        old = {k: _OPTIONS.get(k) for k in values}
        _OPTIONS.update(values)
        return old
    return {k: _OPTIONS.get(k) for k in names} if names else dict(_OPTIONS)


def get_versions() -> dict[str, str]:
    import platform

    import pyspark

    return {"python": platform.python_version(), "pyspark": pyspark.__version__}

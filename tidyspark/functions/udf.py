"""User functions: aggregates, transforms and whole-group functions, on Arrow batches; and user verbs."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import types as T

from ..plans.expr import Func, wrap
from ..plans.tbl import verb
from ..session import ship_package


def user_function(fn: Callable | None = None, *, kind: str = "transform", returns: str | T.DataType = "double", pre: Callable | None = None, post: Callable | None = None):
    """Make a library function of a pandas function.

    ``kind="agg"``: series to scalar; in mutate() it is spread over the group.  ``kind="transform"``: series to series,
    row by row, in Arrow batches (it must not depend on other rows).  ``kind="apply"``: the group's series to any number of
    values of type ``returns``, given as an array (unchop() it for rows).  ``pre``/``post`` change expressions before and after.
    """

    def deco(fn: Callable):
        def build(ctx, *cols, **options):
            ship_package(ctx.tbl.df.sparkSession)
            if kind == "agg":

                def run(*series: pd.Series):
                    return fn(*series, **options)

                udf = _grouped(run, returns)
            elif kind == "apply":

                def run(*series: pd.Series):
                    return list(fn(*series, **options))

                udf = _grouped(run, T.ArrayType(T._parse_datatype_string(returns) if isinstance(returns, str) else returns))
            else:

                def run(*series: pd.Series) -> pd.Series:
                    return pd.Series(fn(*series, **options))

                udf = _scalar(run, returns)
            return ctx.spread(udf(*cols)) if kind in ("agg", "apply") else udf(*cols)

        def call(*args, **options):
            args = tuple(map(wrap, args))
            args = tuple(pre(a) for a in args) if pre else args
            out = Func(getattr(fn, "__name__", "user"), build, args, options, "agg" if kind in ("agg", "apply") else "row")
            return post(out) if post else out

        call.__name__, call.__doc__ = getattr(fn, "__name__", "user"), fn.__doc__
        return call

    return deco if fn is None else deco(fn)


def _typed(run, returns, kind: str):
    import warnings

    from pyspark.sql.functions import PandasUDFType, pandas_udf

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # any number of series can't be said in type hints
        return pandas_udf(run, returns, getattr(PandasUDFType, kind))


def _scalar(run, returns):
    return _typed(run, returns, "SCALAR")


def _grouped(run, returns):
    return _typed(run, returns, "GROUPED_AGG")


func_factory = user_function


def func_bootstrap(stub: Callable, **options):
    """Attach a pandas implementation to a name."""

    def deco(fn):
        out = user_function(fn, **options)
        out.__name__ = stub.__name__
        return out

    return deco


register_verb = verb
register_func = user_function

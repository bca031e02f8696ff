"""Rows by position, rank or chance, per group.

Ungrouped heads, tails and tops without ties are planned as a limit; grouped ones as ``rank <= n``, which Spark cuts before the
shuffle (WindowGroupLimit).
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.windows import ordering
from ..plans.expr import Func, wrap
from ..plans.tbl import Ctx, Tbl, clean, quoted, verb


def _window(tbl: Tbl, order):
    return Window.partitionBy(*(quoted(g) for g in tbl.groups) or [F.lit(0)]).orderBy(*order)


def _sized(tbl: Tbl, df):
    """With the group's row count."""
    if tbl.groups:
        return df.withColumn("__size__", F.count(F.lit(1)).over(Window.partitionBy(*(quoted(g) for g in tbl.groups))))
    return df.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("__size__"))))


def _amount(n, prop, default=1):
    """Rows to keep as a column of the group's size."""
    size = F.col("__size__")
    if n is not None and prop is not None:
        raise ValueError("give n or prop")
    if prop is not None:
        k = F.floor(F.lit(float(abs(prop))) * size)
        return size - k if prop < 0 else k
    n = default if n is None else n
    return F.greatest(size + n, F.lit(0)) if n < 0 else F.lit(n)


@verb
def slice_(tbl: Tbl, *rows) -> Tbl:
    """0-based positions, slices and ``~`` exclusions; out of range is ignored."""
    out = tbl.ordinal()
    df = _sized(tbl, out.df.withColumn("__at__", F.row_number().over(_window(out, out.order_columns())) - 1))
    at, size = F.col("__at__"), F.col("__size__")

    def hit(r):
        if isinstance(r, _Exclude):
            return ~hit(r.item)
        if isinstance(r, Func) and r.name in ("not", "neg"):
            return ~hit(r.children[0].value if hasattr(r.children[0], "value") else r.children[0])
        if isinstance(r, slice):
            edge = lambda v, d: d if v is None else (size + v if v < 0 else F.lit(v))
            a, b = edge(r.start, F.lit(0)), edge(r.stop, size)
            step = F.lit(True) if not r.step or r.step == 1 else (at - a) % r.step == 0
            return (at >= a) & (at < b) & step
        if isinstance(r, (list, tuple, range)):
            out_ = F.lit(False)
            for x in r:
                out_ = out_ | hit(x)
            return out_
        if r is None:
            return F.lit(False)
        if isinstance(r, int):
            return at == (size + r if r < 0 else F.lit(r))
        return at == Ctx(Tbl(df, tbl.groups, tbl.kind), "window").bind(r)

    cond = F.lit(False)
    excluding = rows and all(isinstance(r, _Exclude) for r in rows)
    if excluding:
        cond = F.lit(True)
        for r in rows:
            cond = cond & hit(r)
    else:
        for r in rows:
            cond = cond | hit(r)
    return tbl.regroup(clean(df.where(cond), tbl.columns))


class _Exclude:
    def __init__(self, item):
        self.item = item


def without(*rows) -> _Exclude:
    """All rows of a group but these positions."""
    return _Exclude(list(rows))


@verb
def slice_head(tbl: Tbl, n: int | None = None, prop: float | None = None) -> Tbl:
    if tbl.kind == "rowwise":
        return tbl
    out = tbl.ordinal()
    if not tbl.groups and prop is None and (n or 1) >= 0:
        return tbl.regroup(clean(out.df.orderBy(*out.order_columns()).limit(1 if n is None else n), tbl.columns))
    ranked = out.df.withColumn("__at__", F.row_number().over(_window(out, out.order_columns())))
    if prop is None and (n or 1) >= 0:
        return tbl.regroup(clean(ranked.where(F.col("__at__") <= (1 if n is None else n)), tbl.columns))
    return tbl.regroup(clean(_sized(tbl, ranked).where(F.col("__at__") <= _amount(n, prop)), tbl.columns))


@verb
def slice_tail(tbl: Tbl, n: int | None = None, prop: float | None = None) -> Tbl:
    if tbl.kind == "rowwise":
        return tbl
    out = tbl.ordinal()
    if not tbl.groups and prop is None and (n or 1) >= 0 and (back := out.reverse_columns()) is not None:
        return tbl.regroup(clean(out.df.orderBy(*back).limit(1 if n is None else n), tbl.columns))
    df = _sized(tbl, out.df.withColumn("__at__", F.row_number().over(_window(out, out.order_columns()))))
    return tbl.regroup(clean(df.where(F.col("__at__") > F.col("__size__") - _amount(n, prop)), tbl.columns))


def _extreme(tbl: Tbl, order_by, n, prop, with_ties, descending) -> Tbl:
    e = wrap(order_by)
    if descending and not (isinstance(e, Func) and e.name == "desc"):
        e = Func("desc", lambda ctx, c: c, (e,), {}, "row")
    ctx = Ctx(tbl, "window")
    col, value = ordering(ctx, e), ctx.bind(e.children[0] if descending else e)
    df = tbl.df.where(value.isNotNull())
    if not tbl.groups and prop is None and not with_ties and (n or 1) >= 0:
        return tbl.regroup(df.orderBy(col).limit(1 if n is None else n))
    ranked = df.withColumn("__at__", (F.rank() if with_ties else F.row_number()).over(_window(tbl, [col])))
    if prop is None and (n or 1) >= 0:
        return tbl.regroup(clean(ranked.where(F.col("__at__") <= (1 if n is None else n)), tbl.columns))
    return tbl.regroup(clean(_sized(tbl, ranked).where(F.col("__at__") <= _amount(n, prop)), tbl.columns))


@verb
def slice_min(tbl: Tbl, order_by, n: int | None = None, prop: float | None = None, with_ties: bool = True) -> Tbl:
    """Missing values are left out."""
    return _extreme(tbl, order_by, n, prop, with_ties, False)


@verb
def slice_max(tbl: Tbl, order_by, n: int | None = None, prop: float | None = None, with_ties: bool = True) -> Tbl:
    return _extreme(tbl, order_by, n, prop, with_ties, True)


@verb
def slice_sample(tbl: Tbl, n: int | None = None, prop: float | None = None, weight_by=None, replace: bool = False, random_state: int = 42) -> Tbl:
    """Weights by exponential keys; with replacement by drawing positions."""
    key = F.rand(random_state)
    if weight_by is not None:
        key = -F.ln(F.lit(1.0) - F.rand(random_state)) / Ctx(tbl, "window").bind(wrap(weight_by))
    df = tbl.df.withColumn("__key__", key)
    ranked = _sized(tbl, df.withColumn("__at__", F.row_number().over(_window(tbl, [F.col("__key__")]))))
    if not replace:
        return tbl.regroup(clean(ranked.where(F.col("__at__") <= _amount(n, prop)), tbl.columns))
    draws = ranked.where("__at__ = 1").select(*(quoted(g) for g in tbl.groups), F.explode(F.transform(F.sequence(F.lit(1), _amount(n, prop).cast("int")), lambda i: i)).alias("__i__"), F.col("__size__").alias("__m__"))
    draws = draws.select(*(quoted(g) for g in tbl.groups), (F.floor(F.rand(random_state + 1) * F.col("__m__")) + 1).alias("__at__"))
    out = draws.join(ranked, [*tbl.groups, "__at__"])
    return tbl.regroup(clean(out, tbl.columns))



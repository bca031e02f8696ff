"""Ranks, offsets, running totals: windows over the groups, in the table's row order."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..plans.expr import Func, function, wrap
from ..plans.tbl import sort_column


class Descending:
    def __init__(self, expr):
        self.expr = wrap(expr)


def desc(x) -> Func:
    """Descending order in arrange(), ranks and slices."""
    return Func("desc", lambda ctx, c: c, (wrap(x),), {}, "row")


def ordering(ctx, e) -> Column:
    """Sort column of an expression; missing values come last either way."""
    e = wrap(e)
    if isinstance(e, Func) and e.name == "desc":
        return sort_column(_leveled(ctx, e.children[0]), descending=True)
    return sort_column(_leveled(ctx, e))


def _leveled(ctx, e) -> Column:
    """A factor sorts by its levels."""
    name = getattr(e, "name", None)
    levels = ctx.tbl.levels(name) if type(e).__name__ == "Ref" and name in ctx.tbl.df.columns else None
    col = ctx.bind(e)
    return F.nullif(F.array_position(F.array(*map(F.lit, levels)), col), F.lit(0)) if levels else col


def _value(ctx, e) -> Column:
    e = wrap(e)
    return ctx.bind(e.children[0] if isinstance(e, Func) and e.name == "desc" else e)


def _ranker(name, fn):
    @function("win", raw=True, name=name)
    def build(ctx, x, na_last="keep"):
        v = _value(ctx, x)
        out = fn().over(ctx.window([ordering(ctx, x)]))
        return out if na_last != "keep" else F.when(v.isNotNull(), out)

    build.__name__ = name
    return build


min_rank, dense_rank = _ranker("min_rank", F.rank), _ranker("dense_rank", F.dense_rank)


@function("win", raw=True)
def row_number(ctx, x=None):
    """1-based; with an argument, ties by row order and missing stays missing."""
    if x is None:
        return F.row_number().over(ctx.ordered())
    return F.when(_value(ctx, x).isNotNull(), F.row_number().over(ctx.ordered(ordering(ctx, x))))


@function("win", raw=True)
def percent_rank(ctx, x):
    """(rank - 1) / (greatest rank - 1) over the ranks that occur."""
    v = _value(ctx, x)
    r = F.when(v.isNotNull(), F.rank().over(ctx.window([ordering(ctx, x)])))
    return F.try_divide((r - 1).cast("double"), (F.max(r).over(ctx.window()) - 1).cast("double"))


@function("win", raw=True)
def cume_dist(ctx, x):
    v = _value(ctx, x)
    return F.when(v.isNotNull(), F.count(v).over(ctx.window([ordering(ctx, x)])) / F.count(v).over(ctx.window()))


@function("win", raw=True)
def ntile(ctx, x, n):
    """Ties share a bin."""
    v = _value(ctx, x)
    r, size = F.rank().over(ctx.window([ordering(ctx, x)])), F.count(v).over(ctx.window())
    return F.when(v.isNotNull(), F.floor((r - 1) * F.least(F.lit(n), size) / size) + 1)


@function("win", raw=True)
def rank(ctx, x, ties_method="average"):
    v, w = _value(ctx, x), ctx.window([ordering(ctx, x)])
    if ties_method == "first":
        out = F.row_number().over(ctx.ordered(ordering(ctx, x)))
    elif ties_method == "dense":
        out = F.dense_rank().over(w)
    else:
        low = F.rank().over(w)
        tied = F.count(F.lit(1)).over(ctx.window().partitionBy(*_groups(ctx), v))
        out = {"min": low, "max": low + tied - 1, "average": low + (tied - 1) / 2}[ties_method]
    return F.when(v.isNotNull(), out)


def _groups(ctx):
    from ..plans.tbl import quoted

    return [quoted(g) for g in ctx.tbl.groups]


def _order(ctx, order_by):
    return ctx.window([ordering(ctx, order_by)]) if order_by is not None else ctx.ordered()


@function("win", raw=True)
def lead(ctx, x, n=1, default=None, order_by=None):
    return F.lead(ctx.bind(x), n, default).over(_order(ctx, order_by))


@function("win", raw=True)
def lag(ctx, x, n=1, default=None, order_by=None):
    return F.lag(ctx.bind(x), n, default).over(_order(ctx, order_by))


def _running(name, agg, own=True):
    @function("win", raw=True, name=name)
    def build(ctx, x, order_by=None):
        v = ctx.bind(x)
        out = agg(v).over(_order(ctx, order_by).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return F.when(v.isNotNull(), out) if own else out

    build.__name__ = name
    return build


cumsum, cumprod = _running("cumsum", F.sum), _running("cumprod", F.product)
cummean = _running("cummean", F.avg, own=False)


def _running_strict(name, agg):
    """A missing value stays missing for all later rows."""

    @function("win", raw=True, name=name)
    def build(ctx, x, order_by=None):
        v = ctx.bind(x)
        w = _order(ctx, order_by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return F.when(F.count(v).over(w) == F.count(F.lit(1)).over(w), agg(v).over(w))

    build.__name__ = name
    return build


cummax, cummin = _running_strict("cummax", F.max), _running_strict("cummin", F.min)


def _running_bool(name, agg):
    @function("win", raw=True, name=name)
    def build(ctx, x, na_as=False, order_by=None):
        v = F.coalesce(ctx.bind(x).cast("boolean"), F.lit(na_as))
        return agg(v).over(_order(ctx, order_by).rowsBetween(Window.unboundedPreceding, Window.currentRow))

    build.__name__ = name
    return build


cumall, cumany = _running_bool("cumall", F.bool_and), _running_bool("cumany", F.bool_or)


@function("win", raw=True)
def consecutive_id(ctx, *xs, order_by=None):
    """1-based number of the run; a missing value starts a run."""
    w = _order(ctx, order_by)
    new = F.lit(False)
    for x in xs:
        v = ctx.bind(x)
        new = new | F.coalesce(v != F.lag(v).over(w), F.lit(True))
    return F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))


@function("win", raw=True)
def diff(ctx, x, lag=1, differences=1, order_by=None):
    """The first ``lag * differences`` rows are missing; drop them for the shortened vector."""
    v, w = ctx.bind(x), _order(ctx, order_by)
    out = v
    for k in range(1, differences + 1):  # binomial form: windows don't nest
        out = out + F.lit((-1) ** k * comb(differences, k)) * F.lag(v, k * lag).over(w)
    return out


@function("win", raw=True)
def duplicated(ctx, *xs, from_last=False):
    from ..plans.tbl import quoted

    keys = [ctx.bind(x) for x in xs] or [quoted(c) for c in ctx.tbl.columns]
    order = ctx.tbl.order_columns()
    if from_last:
        order = [F.expr("0")] if not order else [o.desc() for o in order]
    return F.row_number().over(Window.partitionBy(*_groups(ctx), *keys).orderBy(*order)) > 1


@function("win", raw=True)
def cur_group_id(ctx):
    """0-based, by key order: the distinct keys are numbered (one row a group) and joined back."""
    if not ctx.tbl.groups:
        return F.lit(0)
    from ..plans.tbl import quoted

    name, keys = ctx.name("g"), [ctx.name("k") for _ in ctx.tbl.groups]
    ids = ctx.tbl.df.select(*(quoted(g).alias(k) for g, k in zip(ctx.tbl.groups, keys))).distinct()
    ids = ids.withColumn(name, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*(F.col(k).asc_nulls_last() for k in keys))) - 1)
    same = F.lit(True)
    for g, k in zip(ctx.tbl.groups, keys):
        same = same & quoted(g).eqNullSafe(F.col(k))
    ctx.tbl = ctx.tbl.with_df(ctx.tbl.df.join(ids, same, "left").drop(*keys))
    return F.col(name)


def order_by(order, call: Func) -> Func:
    """Evaluate a window call under another order."""
    return Func(call.name, call.build, call.children, call.options | {"order_by": order}, call.kind, call.array, call.raw)


def with_order(order, func, x, *args, **kwargs) -> Func:
    return order_by(order, func(x, *args, **kwargs))

"""Aggregates: the same call is a groupBy aggregate, a window or a row reduction, as the verb and the table ask."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.expr import function, wrap


class _Over:
    """Spark's aggregates; each becomes a window where the context spreads aggregates over groups."""

    def __init__(self, ctx):
        self.ctx = ctx

    def __getattr__(self, name):
        if name == "count_distinct" and self.ctx.spreads():
            return lambda x: F.size(self.ctx.spread(F.collect_set(x)))  # no distinct aggregates over windows
        return lambda *args: self.ctx.spread(getattr(F, name)(*args))


def over(ctx):
    return F if ctx is None else _Over(ctx)


def _valid(a: Column) -> Column:
    return F.filter(a, lambda v: v.isNotNull())


def _asum(a: Column) -> Column:
    return F.aggregate(_valid(a), F.lit(0.0), lambda s, v: s + v.cast("double"))


def _amean(a: Column) -> Column:
    return F.try_divide(_asum(a), F.size(_valid(a)))


def _avar(a: Column, ddof: int) -> Column:
    m, v = _amean(a), _valid(a)
    ss = F.aggregate(v, F.lit(0.0), lambda s, x: s + (x.cast("double") - m) * (x.cast("double") - m))
    return F.when(F.size(v) > ddof, ss / (F.size(v) - ddof))


def _amedian(a: Column) -> Column:
    s = F.array_sort(_valid(a))
    n = F.size(s)
    mid = lambda k: F.get(s, k.cast("int")).cast("double")
    return F.when(n > 0, (mid(F.floor((n - 1) / 2)) + mid(F.floor(n / 2))) / 2)


def arr(x: Column) -> Column:
    """A row's value as an array: c_across() gives arrays already."""
    return F.array(x)


def _row(reduce):
    """Array form; ``ctx`` knows whether the bound column is an array."""

    def run(ctx, x, *rest, **options):
        kind = ctx.tbl.df.select(x.alias("x")).schema["x"].dataType.typeName() if not ctx.scalars else "array"
        return reduce(x if kind == "array" else F.array(x), *rest, **{k: v for k, v in options.items() if k in ("ddof",)})

    return run


@function("agg", array=_row(_asum))
def sum_(ctx, x, na_rm=True):
    """Missing values are skipped; nothing sums to 0."""
    return F.coalesce(over(ctx).sum(x), F.lit(0)) if na_rm else F.when(over(ctx).count(x) == over(ctx).count(F.lit(1)), over(ctx).sum(x))


@function("agg", array=_row(lambda a: F.aggregate(_valid(a), F.lit(1.0), lambda s, v: s * v)))
def prod(ctx, x):
    return F.coalesce(over(ctx).product(x), F.lit(1.0))


@function("agg", array=_row(_amean))
def mean(ctx, x):
    return over(ctx).avg(x)


@function("agg", array=_row(F.array_min))
def min_(ctx, x):
    return over(ctx).min(x)


@function("agg", array=_row(F.array_max))
def max_(ctx, x):
    return over(ctx).max(x)


@function("agg", array=_row(_amedian))
def median(ctx, x):
    """Missing values are skipped, grouped or not."""
    return over(ctx).median(x)


@function("agg", array=_row(lambda a, ddof=1: _avar(a, ddof)))
def var(ctx, x, ddof=1):
    return over(ctx).var_samp(x) if ddof else over(ctx).var_pop(x)


@function("agg", array=_row(lambda a: F.sqrt(_avar(a, 1))))
def sd(ctx, x, ddof=None):
    """Divisor n without groups and n - 1 with them, unless ``ddof`` says."""
    ddof = (1 if ctx.tbl.groups else 0) if ddof is None else ddof
    return over(ctx).stddev_samp(x) if ddof else over(ctx).stddev_pop(x)


def weighted_mean(x, w=None):
    return mean(x) if w is None else _weighted_mean(x, w)


@function("agg")
def _weighted_mean(ctx, x, w):
    both = x.isNotNull() & w.isNotNull()
    total = over(ctx).sum(F.when(both, w).cast("double"))
    return F.when(total != 0, over(ctx).sum(F.when(both, x * w).cast("double")) / total)


@function("agg")
def quantile(ctx, x, probs=(0.0, 0.25, 0.5, 0.75, 1.0)):
    """Linear interpolation; several probabilities give an array."""
    return over(ctx).percentile(x, float(probs)) if isinstance(probs, (int, float)) else over(ctx).percentile(x, [float(p) for p in probs])


@function("agg")
def cov(ctx, x, y):
    return over(ctx).covar_samp(x, y)


@function("agg")
def n(ctx):
    return over(ctx).count(F.lit(1))


@function("agg")
def n_distinct(ctx, x, na_rm=True):
    out = over(ctx).count_distinct(x)
    return out if na_rm else out + F.coalesce(over(ctx).max(x.isNull().cast("int")), F.lit(0))


@function("agg")
def approx_n_distinct(ctx, x, rsd=0.05):
    return over(ctx).approx_count_distinct(x, rsd)


@function("agg", array=_row(lambda a: F.forall(a, lambda v: F.coalesce(v.cast("boolean"), F.lit(True)))))
def all_(ctx, x):
    return F.coalesce(over(ctx).bool_and(F.coalesce(x.cast("boolean"), F.lit(True))), F.lit(True))


@function("agg", array=_row(lambda a: F.exists(a, lambda v: F.coalesce(v.cast("boolean"), F.lit(True)))))
def any_(ctx, x):
    return F.coalesce(over(ctx).bool_or(F.coalesce(x.cast("boolean"), F.lit(True))), F.lit(False))


@function("agg", array=_row(lambda a: F.exists(a, lambda v: v.isNull())))
def any_na(ctx, x):
    return F.coalesce(over(ctx).bool_or(x.isNull()), F.lit(False))


@function("agg", array=_row(F.size))
def length(ctx, x):
    return over(ctx).count(F.lit(1))


@function()
def lengths(ctx, x):
    return F.size(x)


@function("agg")
def is_true(ctx, x):
    return (over(ctx).count(F.lit(1)) == 1) & over(ctx).bool_and(F.coalesce(x.cast("boolean"), F.lit(False)))


@function("agg")
def is_false(ctx, x):
    return (over(ctx).count(F.lit(1)) == 1) & over(ctx).bool_and(F.coalesce(~x.cast("boolean"), F.lit(False)))


@function("agg")
def collect(ctx, x):
    """All values, missing ones included, as an array."""
    return F.transform(over(ctx).collect_list(F.struct(x.alias("v"))), lambda s: s["v"])


def _key(ctx, order_by=None):
    """What first/last/nth order by."""
    if order_by is not None:
        return order_by
    ctx.tbl = ctx.tbl.ordinal()
    return _order_struct(ctx)


def _order_struct(ctx):
    from pyspark.sql import Window

    from ..plans.tbl import ORDINAL, quoted

    if not ctx.tbl.order:
        return quoted(ORDINAL)
    # an arranged table: each row's place in its group
    name, groups = ctx.name("o"), [quoted(g) for g in ctx.tbl.groups] or [F.lit(0)]
    ctx.tbl = ctx.tbl.with_df(ctx.tbl.df.withColumn(name, F.row_number().over(Window.partitionBy(*groups).orderBy(*ctx.tbl.order_columns()))))
    return quoted(name)


def _position(ctx, order_by=None) -> tuple[Column, Column]:
    """0-based place of each row in its group, and the group's size, as columns added to the table."""
    from pyspark.sql import Window

    from ..plans.tbl import quoted

    key = _key(ctx, order_by)
    groups = [quoted(g) for g in ctx.tbl.groups] or [F.lit(0)]
    at, size = ctx.name("at"), ctx.name("size")
    df = ctx.tbl.df.withColumn(at, F.row_number().over(Window.partitionBy(*groups).orderBy(key)) - 1)
    ctx.tbl = ctx.tbl.with_df(df.withColumn(size, F.count(F.lit(1)).over(Window.partitionBy(*groups))))
    return quoted(at), quoted(size)


def _in_order(ctx, x: Column, order_by=None) -> Column:
    """A group's values as an array, in row order."""
    return F.transform(F.array_sort(over(ctx).collect_list(F.struct(_key(ctx, order_by).alias("o"), x.alias("v")))), lambda s: s["v"])


@function("agg", array=_row(F.array_distinct))
def unique(ctx, x, order_by=None):
    """A group's distinct values, missing included, in order of their first row, as an array."""
    return F.array_distinct(_in_order(ctx, x, order_by))


@function("agg")
def order(ctx, x, decreasing=False, order_by=None):
    """0-based positions that would sort a group's values; ties by row order, missing last; an array."""
    items = F.transform(_in_order(ctx, x, order_by), lambda v, i: F.struct(v.isNull().alias("none"), v.alias("v"), i.alias("i")))
    if not decreasing:
        return F.transform(F.array_sort(items), lambda s: s["i"])
    by_value = F.sort_array(F.filter(F.transform(items, lambda s: F.struct(s["v"], (-s["i"]).alias("i"))), lambda s: s["v"].isNotNull()), asc=False)
    return F.concat(F.transform(by_value, lambda s: -s["i"]), F.transform(F.filter(items, lambda s: s["none"]), lambda s: s["i"]))


@function("agg")
def sample(ctx, x, size=None, replace=False):
    """A group's values in random order, or ``size`` of them, as an array."""
    a = over(ctx).collect_list(F.struct(x.alias("v")))
    if replace:
        from .math import _draw

        draws = F.transform(F.sequence(F.lit(1), F.size(a) if size is None else F.lit(size)), lambda i: F.get(a, F.pmod(F.xxhash64(i, F.lit(_draw())), F.size(a)).cast("int")))
        return F.transform(draws, lambda s: s["v"])
    out = F.transform(F.shuffle(a), lambda s: s["v"])
    return out if size is None else F.slice(out, 1, size)


@function("agg")
def first(ctx, x, order_by=None, default=None):
    out = over(ctx).min_by(x, _key(ctx, order_by))
    return out if default is None else F.coalesce(out, F.lit(default))


@function("agg")
def last(ctx, x, order_by=None, default=None):
    out = over(ctx).max_by(x, _key(ctx, order_by))
    return out if default is None else F.coalesce(out, F.lit(default))


@function("agg")
def nth(ctx, x, n, order_by=None, default=None):
    """From 0; negative from the end."""
    at, size = _position(ctx, order_by)
    here = at == F.when(n < 0, size + n).otherwise(n)
    out = over(ctx).max(F.when(here, F.struct(x.alias("v"))))["v"]
    return out if default is None else F.when(over(ctx).bool_or(here), out).otherwise(F.lit(default))


@function("agg")
def which_max(ctx, x, order_by=None):
    """0-based position of the first maximum."""
    return _which(ctx, x, order_by, -1)


@function("agg")
def which_min(ctx, x, order_by=None):
    return _which(ctx, x, order_by, 1)


def _which(ctx, x, order_by, sign):
    at, _ = _position(ctx, order_by)
    if sign > 0:
        return over(ctx).min_by(at, F.when(x.isNotNull(), F.struct(x, at)))
    return over(ctx).max_by(at, F.when(x.isNotNull(), F.struct(x, -at)))


@function("agg")
def which(ctx, x, order_by=None):
    """0-based positions of true values, as an array."""
    items = F.array_sort(over(ctx).collect_list(F.struct(_key(ctx, order_by).alias("o"), F.coalesce(x.cast("boolean"), F.lit(False)).alias("v"))))
    return F.filter(F.transform(items, lambda s, i: F.when(s["v"], i)), lambda v: v.isNotNull())


@function("agg")
def _grep_values(ctx, x, hit, order_by=None):
    items = _in_order(ctx, F.when(hit, F.struct(x.alias("x"))), order_by)
    return F.transform(F.filter(items, lambda s: s.isNotNull()), lambda s: s["x"])


def scale(x, center=True, scale=True):
    """(x - mean) / sd with divisor n - 1; per group."""
    x = wrap(x)
    out = x - mean(x) if center is True else x - center if center is not False else x
    if scale is True:
        return out / var(x) ** 0.5 if center is True else out / _rms(x)
    return out if scale is False else out / scale


@function("agg")
def _rms(ctx, x):
    return F.sqrt(over(ctx).sum(x * x) / (over(ctx).count(x) - 1))


def proportions(x):
    x = wrap(x)
    return x / sum_(x)


# ---- across one row ----


def _across(name, reduce, strict=True):
    @function(name=name)
    def build(ctx, *xs, na_rm=False):
        out = reduce(F.array(*(x.cast("double") for x in xs)))
        if na_rm or not strict:
            return out
        missing = F.lit(False)
        for x in xs:
            missing = missing | x.isNull()
        return F.when(~missing, out)

    build.__name__ = name
    return build


row_sums, row_means, row_sds, row_medians = _across("row_sums", _asum), _across("row_means", _amean), _across("row_sds", lambda a: F.sqrt(_avar(a, 1))), _across("row_medians", _amedian)
pmin, pmax = _across("pmin", F.array_min), _across("pmax", F.array_max)


@function()
def max_col(ctx, *xs, ties_method="first"):
    """0-based index of a row's maximum."""
    a = F.array(*xs)
    best = F.array_max(a)
    if ties_method == "last":
        return F.size(a) - F.array_position(F.reverse(a), best)
    return F.array_position(a, best) - 1

"""Conditions, recoding, cutting, sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.expr import Expr, function, truth
from ..plans.tbl import Fct


@function(raw=True)
def if_else(ctx, condition, true, false, missing=None):
    """A missing condition gives ``false`` unless ``missing`` is given."""
    c, t, e = ctx.bind(condition), ctx.bind(true), ctx.bind(false)
    return F.when(c.isNull(), e if missing is None else ctx.bind(missing)).when(c.cast("boolean"), t).otherwise(e)


@function(raw=True)
def case_when(ctx, *pairs):
    if len(pairs) % 2 or not pairs:
        raise ValueError("case_when() needs condition, value pairs")
    out = None
    for c, v in zip(pairs[::2], pairs[1::2]):
        cond = truth(ctx.bind(c))
        out = F.when(cond, ctx.bind(v)) if out is None else out.when(cond, ctx.bind(v))
    return out


@function(raw=True)
def case_match(ctx, x, *pairs, _default=None):
    """A missing value goes with the first pair."""
    if len(pairs) % 2 or not pairs:
        raise ValueError("case_match() needs values, result pairs")
    x, out = ctx.bind(x), None
    for values, v in zip(pairs[::2], pairs[1::2]):
        values = values if isinstance(values, (list, tuple)) else [values]
        cond = x.isNull() | (F.coalesce(x.isin([k for k in values if k is not None]), F.lit(False)))
        out = F.when(cond, ctx.bind(v)) if out is None else out.when(cond, ctx.bind(v))
    return out if _default is None else out.otherwise(ctx.bind(_default))


@function(raw=True)
def recode(ctx, x, /, *maps, _default=None, _missing=None, **named):
    table = {}
    for m in maps:
        table.update(m if isinstance(m, dict) else dict([m]))
    table.update(named)
    col = ctx.bind(x)
    out = F.when(col.isNull(), F.lit(None) if _missing is None else ctx.bind(_missing))
    for k, v in table.items():
        out = out.when(col == F.lit(k), ctx.bind(v))
    return out.otherwise(col if _default is None else ctx.bind(_default))


@function(raw=True)
def recode_factor(ctx, x, /, *maps, _default=None, _missing=None, _ordered=False, **named):
    col = ctx.bind(recode(x, *maps, _default=_default, _missing=_missing, **named))
    levels = [v for m in maps for v in (m.values() if isinstance(m, dict) else [m[1]])] + list(named.values())
    levels = list(dict.fromkeys(levels + [v for v in (_default, _missing) if v is not None and not isinstance(v, Expr)]))
    return Fct(col, levels, _ordered)


@function(raw=True)
def coalesce(ctx, *xs):
    return F.coalesce(*map(ctx.bind, xs))


@function()
def na_if(ctx, x, y):
    return F.nullif(x, y)


@function()
def near(ctx, a, b, rtol=1e-5, atol=1e-8):
    return F.coalesce(F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b), F.lit(False))


@function()
def between(ctx, x, left, right, inclusive="both"):
    low = x >= left if inclusive in ("both", "left") else x > left
    high = x <= right if inclusive in ("both", "right") else x < right
    return F.coalesce(low & high, F.lit(False))


@function(raw=True)
def cut(ctx, x, breaks, labels=None, include_lowest=False, right=True, precision=2, ordered_result=False):
    """Intervals as labels; a number of breaks cuts the range evenly, widened by 0.1 %."""
    col = ctx.bind(x)
    if isinstance(breaks, int):
        low, high = ctx.tbl.df.agg(F.min(col).cast("double"), F.max(col).cast("double")).first()
        step = (high - low) / breaks
        edges = [low + i * step for i in range(breaks + 1)]
        wide = (high - low) * 0.001
        edges[0 if right else -1] += -wide if right else wide
    else:
        edges = [float(b) for b in breaks]
    show = lambda v: f"{round(v, precision):g}"
    names = list(labels) if labels else [(f"({show(a)}, {show(b)}]" if right else f"[{show(a)}, {show(b)})") for a, b in zip(edges, edges[1:])]
    out = F.lit(None).cast("string")
    for i, (a, b) in reversed(list(enumerate(zip(edges, edges[1:])))):
        inside = (col > a) & (col <= b) if right else (col >= a) & (col < b)
        if include_lowest and right and i == 0:
            inside = (col >= a) & (col <= b)
        if include_lowest and not right and i == len(edges) - 2:
            inside = (col >= a) & (col <= b)
        out = F.when(inside, F.lit(names[i])).otherwise(out)
    return Fct(out, names, ordered_result)


@function(raw=True)
def match(ctx, x, table, nomatch=-1):
    """0-based position in the table."""
    t = F.array(*map(F.lit, table)) if isinstance(table, (list, tuple)) else ctx.bind(table)
    at = F.coalesce(F.array_position(t, ctx.bind(x)), F.lit(0))
    return F.when(at > 0, at - 1).otherwise(F.lit(nomatch))


@function(raw=True)
def seq_len(ctx, n):
    return F.sequence(F.lit(1), ctx.bind(n).cast("long"))


@function(raw=True)
def seq(ctx, start, end, by=1):
    return F.sequence(ctx.bind(start), ctx.bind(end), F.lit(by))


def seq_along(x=None):
    from .windows import row_number

    return row_number()


@function(raw=True)
def rep(ctx, x, times=1, each=1, length=None):
    """An array of the value, or of a literal list, repeated."""
    a = F.array(*map(F.lit, x)) if isinstance(x, (list, tuple)) else F.array(ctx.bind(x))
    if each != 1:
        a = F.flatten(F.transform(a, lambda v: F.array_repeat(v, each)))
    a = F.flatten(F.array_repeat(a, times))
    return a if length is None else F.slice(F.flatten(F.array_repeat(a, length)), 1, length)


@function()
def rev(ctx, x):
    return F.reverse(x)


@function(raw=True)
def sort(ctx, x, decreasing=False):
    return F.sort_array(ctx.bind(x), not decreasing)


@function(raw=True)
def itemgetter(ctx, x, index):
    """Positional take from an array or a literal list."""
    a = F.array(*map(F.lit, x)) if isinstance(x, (list, tuple)) else ctx.bind(x)
    at = ctx.bind(index)
    return F.get(a, F.when(at < 0, F.size(a) + at).otherwise(at).cast("int"))


@function(raw=True)
def append(ctx, x, values, after=None):
    """An array with ``values`` put behind 0-based position ``after``; None: behind the last, -1: before the first."""
    of = lambda v: F.array(*map(F.lit, v)) if isinstance(v, (list, tuple)) else ctx.bind(v)
    a, more = of(x), of(values)
    if not isinstance(values, (list, tuple)) and not ctx.tbl.df.select(more.alias("x")).schema["x"].dataType.typeName() == "array":
        more = F.array(more)
    if after is None:
        return F.concat(a, more)
    return F.concat(F.slice(a, 1, after + 1), more, F.slice(a, F.lit(after + 2), F.greatest(F.size(a) - after - 1, F.lit(0))))


def identity(x):
    return x


@function(raw=True)
def c_(ctx, *xs):
    return F.flatten(F.array(*(F.array(*map(F.lit, x)) if isinstance(x, (list, tuple)) else F.array(ctx.bind(x)) for x in xs)))


@function(raw=True)
def array_ufunc(ctx, ufunc, x):
    """A numpy ufunc by its name's Spark equivalent, else on Arrow batches."""
    col, name = ctx.bind(x), ufunc.__name__
    native = {"sqrt": F.sqrt, "exp": F.exp, "log": F.ln, "log2": F.log2, "log10": F.log10, "log1p": F.log1p, "sin": F.sin, "cos": F.cos, "tan": F.tan, "floor": F.floor, "ceil": F.ceil, "absolute": F.abs, "negative": lambda v: -v, "square": lambda v: v * v, "sign": F.signum}
    if name in native:
        return native[name](col)
    import pandas as pd

    return F.pandas_udf(lambda s: pd.Series(ufunc(s.to_numpy(dtype="float64"))), "double")(col.cast("double"))



"""Factors: a value column with its levels in column metadata.

Operations on levels alone cost nothing; those that depend on the data run one small aggregate (a row per level).
"""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import functions as F

from ..plans.expr import Ref, function, wrap
from ..plans.tbl import Fct


#: Levels a factor may have; they are kept on the driver and in the plan.
MAX_LEVELS = 100_000


def bounded(df) -> list:
    """The rows of a table of levels; more than MAX_LEVELS are an error, not a driver out of memory."""
    rows = df.limit(MAX_LEVELS + 1).collect()
    if len(rows) > MAX_LEVELS:
        raise ValueError(f"more than {MAX_LEVELS} levels: not a factor")
    return rows


def get(ctx, x) -> Fct:
    """Bind as a factor; other columns get sorted distinct values as levels."""
    x = wrap(x)
    if isinstance(x, Ref) and x.name in ctx.tbl.df.columns:
        levels = ctx.tbl.levels(x.name)
        if levels is not None:
            return Fct(ctx.column(x.name), levels, bool(ctx.tbl.df.schema[x.name].metadata.get("ordered")))
    out = x.bind(ctx)
    if isinstance(out, Fct):
        return out
    values = [r[0] for r in bounded(ctx.tbl.df.select(out.alias("x")).distinct()) if r[0] is not None]
    return Fct(out, sorted(values))


def _counts(ctx, fc: Fct, w=None) -> dict:
    agg = F.count(F.lit(1)) if w is None else F.sum(ctx.bind(w))
    return {r[0]: r[1] for r in bounded(ctx.tbl.df.groupBy(fc.col.alias("x")).agg(agg.alias("n")))}


def _mapped(fc: Fct, table: dict, levels: list | None = None) -> Fct:
    """Levels renamed by ``table`` (None removes)."""
    col = F.lit(None).cast("string")
    for old in fc.levels:
        new = table.get(old, old)
        col = F.when(fc.col == F.lit(old), F.lit(new) if new is not None else F.lit(None)).otherwise(col)
    out = levels if levels is not None else [v for v in dict.fromkeys(table.get(v, v) for v in fc.levels) if v is not None]
    return Fct(col, out, fc.ordered)


@function(raw=True)
def factor(ctx, x, levels=None, exclude=None, ordered=False):
    fc = get(ctx, x)
    levels = list(levels) if levels is not None else fc.levels
    gone = set(exclude if isinstance(exclude, (list, tuple, set)) else [exclude])
    levels = [v for v in dict.fromkeys(levels) if v is not None and v not in gone]
    return Fct(F.when(fc.col.isin(levels), fc.col), levels, ordered)


def ordered(x, levels=None):
    return factor(x, levels=levels, ordered=True)


def as_factor(x):
    return factor(x)


as_ordered = ordered


@function(raw=True)
def droplevels(ctx, x):
    fc = get(ctx, x)
    seen = set(_counts(ctx, fc))
    return Fct(fc.col, [v for v in fc.levels if v in seen], fc.ordered)


@function(raw=True)
def nlevels(ctx, x):
    return F.lit(len(get(ctx, x).levels))


def _levels_only(name: str, change: Callable):
    """A factor function that reorders levels; ``change(levels, ctx, fc, ...)``."""

    @function(raw=True, name=name)
    def build(ctx, x, *args, **options):
        fc = get(ctx, x)
        return Fct(fc.col, change(list(fc.levels), ctx, fc, *args, **options), options.get("ordered", fc.ordered) or fc.ordered)

    build.__name__ = name
    return build


def _relevel(levels, ctx, fc, *lvls, after=None):
    if len(lvls) == 1 and callable(lvls[0]):
        lvls = lvls[0](levels)
    named = [v for v in lvls if v in levels]
    rest = [v for v in levels if v not in named]
    at = 0 if after is None else len(rest) if after == -1 else after + 1
    return rest[:at] + named + rest[at:]


def _inorder(levels, ctx, fc, ordered=None):
    tbl = ctx.tbl.ordinal()
    from ..plans.tbl import ORDINAL, quoted

    df = tbl.df if ORDINAL in tbl.df.columns else tbl.df.withColumn(ORDINAL, F.monotonically_increasing_id())
    at = {r[0]: r[1] for r in bounded(df.groupBy(fc.col.alias("x")).agg(F.min(quoted(ORDINAL)).alias("o")))}
    return sorted(levels, key=lambda v: (at.get(v, float("inf")), levels.index(v)))


def _infreq(levels, ctx, fc, ordered=None):
    n = _counts(ctx, fc)
    return sorted(levels, key=lambda v: -n.get(v, 0))


def _inseq(levels, ctx, fc, ordered=None):
    def number(v):
        try:
            return float(v)
        except (TypeError, ValueError):
            return None

    if all(number(v) is None for v in levels):
        raise ValueError("no level is a number")
    return sorted(levels, key=lambda v: (number(v) is None, number(v) or 0))


def _reorder(levels, ctx, fc, x, _fun=None, _desc=False):
    from . import aggregates

    agg = (_fun or aggregates.median)(x)
    col = agg.build(ctx, *(ctx.bind(c) for c in agg.children), **agg.options)
    at = {r[0]: r[1] for r in ctx.tbl.df.groupBy(fc.col.alias("x")).agg(col.alias("v")).collect()}
    return sorted(levels, key=lambda v: (at.get(v) is None, (at.get(v) or 0) * (-1 if _desc else 1)))


def _reorder2(levels, ctx, fc, x, y, _fun="last2", _desc=True):
    pick = F.max_by if _fun in ("last2", last2) else F.min_by
    at = {r[0]: r[1] for r in ctx.tbl.df.groupBy(fc.col.alias("x")).agg(pick(ctx.bind(y), ctx.bind(x)).alias("v")).collect()}
    return sorted(levels, key=lambda v: (at.get(v) is None, (at.get(v) or 0) * (-1 if _desc else 1)))


@function("agg")
def last2(ctx, x, y):
    return ctx.spread(F.max_by(y, x))


@function("agg")
def first2(ctx, x, y):
    return ctx.spread(F.min_by(y, x))


fct_relevel, fct_inorder, fct_infreq, fct_inseq = _levels_only("fct_relevel", _relevel), _levels_only("fct_inorder", _inorder), _levels_only("fct_infreq", _infreq), _levels_only("fct_inseq", _inseq)
fct_reorder, fct_reorder2 = _levels_only("fct_reorder", _reorder), _levels_only("fct_reorder2", _reorder2)
fct_rev = _levels_only("fct_rev", lambda levels, ctx, fc: levels[::-1])
fct_shift = _levels_only("fct_shift", lambda levels, ctx, fc, n=1: levels[n % max(1, len(levels)) :] + levels[: n % max(1, len(levels))])
fct_shuffle = _levels_only("fct_shuffle", lambda levels, ctx, fc, seed=0: random.Random(seed).sample(levels, len(levels)))
fct_expand = _levels_only("fct_expand", lambda levels, ctx, fc, *more: list(dict.fromkeys([*levels, *more])))
lvls_expand = _levels_only("lvls_expand", lambda levels, ctx, fc, new: _superset(levels, new))


def _superset(levels, new):
    if set(levels) - set(new):
        raise ValueError("the new levels must include the old ones")
    return list(new)


def _permuted(levels, ctx, fc, idx, ordered=None):
    if sorted(idx) != list(range(len(levels))):
        raise ValueError("idx must be a permutation of the levels' positions")
    return [levels[i] for i in idx]


lvls_reorder = _levels_only("lvls_reorder", _permuted)


@function(raw=True)
def lvls_revalue(ctx, x, new_levels):
    fc = get(ctx, x)
    if len(new_levels) != len(fc.levels):
        raise ValueError("as many new levels as old are needed")
    return _mapped(fc, dict(zip(fc.levels, new_levels)))


@function(raw=True)
def fct_anon(ctx, x, prefix="", seed=0):
    fc = get(ctx, x)
    width = len(str(max(0, len(fc.levels) - 1)))
    names = [f"{prefix}{i:0{width}d}" for i in range(len(fc.levels))]
    return _mapped(fc, dict(zip(random.Random(seed).sample(fc.levels, len(fc.levels)), names)), names)


@function(raw=True)
def fct_recode(ctx, x, /, *maps, **named):
    """new=old (or new=[old, ...]); a dict may map to None to remove."""
    table = {}
    for new, old in [*(kv for m in maps for kv in m.items()), *named.items()]:
        for o in old if isinstance(old, (list, tuple)) else [old]:
            table[o] = new
    return _mapped(get(ctx, x), table)


@function(raw=True)
def fct_collapse(ctx, x, /, other_level=None, **groups):
    fc = get(ctx, x)
    table = {o: new for new, olds in groups.items() for o in (olds if isinstance(olds, (list, tuple)) else [olds])}
    levels = list(dict.fromkeys(table.get(v, v if other_level is None else other_level) for v in fc.levels))
    if other_level in levels:
        levels = [v for v in levels if v != other_level] + [other_level]
    return _mapped(fc, {v: table.get(v, v if other_level is None else other_level) for v in fc.levels}, levels)


def _lump(fc: Fct, keep: set, other: str) -> Fct:
    lumped = [v for v in fc.levels if v not in keep]
    if not lumped:
        return fc
    levels = [v for v in fc.levels if v in keep and v != other] + [other]
    return _mapped(fc, {v: other for v in lumped}, levels)


@function(raw=True)
def fct_lump_min(ctx, x, min, w=None, other_level="Other"):
    fc = get(ctx, x)
    n = _counts(ctx, fc, w)
    return _lump(fc, {v for v in fc.levels if n.get(v, 0) >= min}, other_level)


@function(raw=True)
def fct_lump_prop(ctx, x, prop, w=None, other_level="Other"):
    fc = get(ctx, x)
    n = _counts(ctx, fc, w)
    total = sum(n.values())
    share = {v: n.get(v, 0) / total for v in fc.levels}
    keep = {v for v in fc.levels if (share[v] > prop if prop >= 0 else share[v] <= -prop)}
    return fc if prop >= 0 and len(fc.levels) - len(keep) <= 1 else _lump(fc, keep, other_level)


@function(raw=True)
def fct_lump_n(ctx, x, n, w=None, other_level="Other", ties_method="min"):
    fc = get(ctx, x)
    counts = _counts(ctx, fc, w)
    value = {v: counts.get(v, 0) * (1 if n >= 0 else -1) for v in fc.levels}
    above = {v: sum(o > value[v] for o in value.values()) for v in fc.levels}
    tied = {v: sum(o == value[v] for o in value.values()) for v in fc.levels}
    order = sorted(fc.levels, key=lambda v: -value[v])
    rank = {"min": lambda v: above[v] + 1, "max": lambda v: above[v] + tied[v], "average": lambda v: above[v] + (tied[v] + 1) / 2, "first": lambda v: order.index(v) + 1, "last": lambda v: len(order) - order[::-1].index(v)}[ties_method]
    keep = {v for v in fc.levels if rank(v) <= abs(n)}
    return fc if len(fc.levels) - len(keep) <= 1 else _lump(fc, keep, other_level)


@function(raw=True)
def fct_lump_lowfreq(ctx, x, other_level="Other"):
    """The rarest levels whose sum stays below every kept level."""
    fc = get(ctx, x)
    n = _counts(ctx, fc)
    order = sorted(fc.levels, key=lambda v: -n.get(v, 0))
    left = sum(n.get(v, 0) for v in order)
    for i, v in enumerate(order):
        left -= n.get(v, 0)
        if n.get(v, 0) > left:
            keep = set(order[: i + 1])
            return fc if len(order) - len(keep) <= 1 else _lump(fc, keep, other_level)
    return fc


def fct_lump(x, n=None, prop=None, w=None, other_level="Other", ties_method="min"):
    if n is not None:
        return fct_lump_n(x, n=n, w=w, other_level=other_level, ties_method=ties_method)
    if prop is not None:
        return fct_lump_prop(x, prop=prop, w=w, other_level=other_level)
    return fct_lump_lowfreq(x, other_level=other_level)


@function(raw=True)
def fct_other(ctx, x, keep=None, drop=None, other_level="Other"):
    if (keep is None) == (drop is None):
        raise ValueError("give keep or drop")
    fc = get(ctx, x)
    return _lump(fc, set(keep) if keep is not None else set(fc.levels) - set(drop), other_level)


@function(raw=True)
def fct_relabel(ctx, x, fun, *args, **kwargs):
    fc = get(ctx, x)
    return _mapped(fc, {v: fun(v, *args, **kwargs) for v in fc.levels})


@function(raw=True)
def fct_explicit_na(ctx, x, na_level="(Missing)"):
    fc = get(ctx, x)
    return Fct(F.coalesce(fc.col, F.lit(na_level)), [v for v in fc.levels if v != na_level] + [na_level], fc.ordered)


@function(raw=True)
def fct_drop(ctx, x, only=None):
    fc = get(ctx, x)
    seen = set(_counts(ctx, fc))
    only = set(fc.levels if only is None else [only] if isinstance(only, str) else only)
    return Fct(fc.col, [v for v in fc.levels if v in seen or v not in only], fc.ordered)


@function(raw=True)
def fct_cross(ctx, *xs, sep=":", keep_empty=False):
    fcs = [get(ctx, x) for x in xs]
    some = fcs[0].col.isNotNull()
    for fc in fcs[1:]:
        some = some & fc.col.isNotNull()
    col = F.when(some, F.concat_ws(sep, *(fc.col.cast("string") for fc in fcs)))
    levels = [""]
    for i, fc in enumerate(fcs):
        levels = [(f"{a}{sep}{b}" if i else str(b)) for b in fc.levels for a in levels]
    if not keep_empty:
        seen = {r[0] for r in bounded(ctx.tbl.df.select(col.alias("x")).distinct())}
        levels = [v for v in levels if v in seen]
    return Fct(col, levels)


def _union(fcs: list[Fct]) -> list:
    return list(dict.fromkeys(v for fc in fcs for v in fc.levels))


@function(raw=True)
def lvls_union(ctx, *xs):
    """The levels of several factors, by first appearance, as an array."""
    return F.array(*map(F.lit, _union([get(ctx, x) for x in xs])))


@function(raw=True)
def fct_c(ctx, *xs):
    """Several factors' values of a row as one array; its levels (metadata) are the union of theirs."""
    fcs = [get(ctx, x) for x in xs]
    return Fct(F.array(*(fc.col for fc in fcs)), _union(fcs))


def fct_unify(*xs, levels=None) -> list:
    """The factors, each with the union of all their levels (or ``levels``)."""
    return [_unified(x, others=xs, levels=levels) for x in xs]


@function(raw=True)
def _unified(ctx, x, others=(), levels=None):
    fc = get(ctx, x)
    all_of = _union([get(ctx, o) for o in others]) if levels is None else list(levels)
    return Fct(F.when(fc.col.isin(all_of), fc.col), all_of, fc.ordered)


def fct_match(x, lvls):
    """Membership; an unknown level is an error."""
    return _match(x, lvls=lvls)


@function(raw=True)
def _match(ctx, x, lvls):
    fc, lvls = get(ctx, x), [lvls] if isinstance(lvls, str) else list(lvls)
    gone = [v for v in lvls if v not in fc.levels]
    if gone:
        raise ValueError(f"levels not present: {gone}")
    return F.coalesce(fc.col.isin(lvls), F.lit(False))

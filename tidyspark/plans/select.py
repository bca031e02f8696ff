"""Tidy selection: names, positions, slices, predicates and set algebra, resolved on the column names while the plan is built."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import types as T

from .expr import Expr, Func, Ref
from .tbl import Tbl


class Sel:
    """A selection: a function from a table's names to the chosen names, in order."""

    def __init__(self, pick: Callable[[Tbl, list[str]], list[str]], negative: bool = False):
        self.pick, self.negative = pick, negative

    def __invert__(self):
        return Sel(lambda t, pool: [c for c in pool if c not in set(self.pick(t, pool))], not self.negative)

    __neg__ = __invert__

    def __and__(self, other):
        other = selection(other)
        return Sel(lambda t, pool: [c for c in self.pick(t, pool) if c in set(other.pick(t, pool))])

    def __or__(self, other):
        other = selection(other)
        return Sel(lambda t, pool: _unique(self.pick(t, pool) + other.pick(t, pool)))


def _unique(names: Iterable[str]) -> list[str]:
    return list(dict.fromkeys(names))


def _position(pool: list[str], at, default: int) -> int:
    if at is None:
        return default
    if isinstance(at, int):
        return at if at >= 0 else len(pool) + at
    name = at.name if isinstance(at, Ref) else at
    if name not in pool:
        raise KeyError(f"no column {name!r}")
    return pool.index(name)


def _slice(s: slice) -> Sel:
    def pick(t, pool):
        a, b = _position(pool, s.start, 0), _position(pool, s.stop, len(pool))
        if s.step == 1:  # a:b:1 includes the end
            b += 1 if s.stop is not None else 0
            return pool[a:b]
        return pool[a : b : s.step or 1]

    return Sel(pick)


def selection(x) -> Sel:
    if isinstance(x, Sel):
        return x
    if isinstance(x, Ref):
        x = x.name
    if isinstance(x, str):

        def named(t, pool):
            if x not in pool:
                raise KeyError(f"no column {x!r}")
            return [x]

        return Sel(named)
    if isinstance(x, bool):
        raise TypeError("a boolean selects nothing")
    if isinstance(x, int):
        return Sel(lambda t, pool: [pool[x]])
    if isinstance(x, slice):
        return _slice(x)
    if isinstance(x, Func) and x.name in ("neg", "not"):
        return ~selection(x.children[0])
    if isinstance(x, Func) and x.name in ("and", "or"):
        a, b = map(selection, x.children)
        return a & b if x.name == "and" else a | b
    if isinstance(x, Expr):
        raise TypeError(f"not a selection: {x!r}")
    if callable(x):
        return where(x)
    parts = [selection(v) for v in x]
    return Sel(lambda t, pool: _combine(t, pool, parts))


def _combine(t: Tbl, pool: list[str], parts: list[Sel]) -> list[str]:
    if parts and all(p.negative for p in parts):  # several exclusions exclude together
        keep = [set(p.pick(t, pool)) for p in parts]
        return [c for c in pool if all(c in k for k in keep)]
    return _unique(c for p in parts for c in p.pick(t, pool))


def resolve(tbl: Tbl, args: Iterable, pool: list[str] | None = None) -> list[str]:
    return _combine(tbl, pool if pool is not None else tbl.columns, [selection(a) for a in args])


class _C:
    """``c[...]`` and ``c(...)`` combine selections."""

    def __getitem__(self, items):
        return selection(list(items) if isinstance(items, tuple) else [items])

    def __call__(self, *items):
        return selection(list(items))


c = _C()


def everything() -> Sel:
    return Sel(lambda t, pool: [x for x in pool if x not in t.groups])


def last_col(offset: int = 0) -> Sel:
    return Sel(lambda t, pool: [pool[-1 - offset]])


def _patterns(match, ignore_case: bool, test) -> Sel:
    pats = [match] if isinstance(match, str) else list(match)
    low = (lambda s: s.lower()) if ignore_case else (lambda s: s)
    return Sel(lambda t, pool: _unique(x for p in pats for x in pool if test(low(x), low(p))))


def starts_with(match, ignore_case: bool = True) -> Sel:
    return _patterns(match, ignore_case, str.startswith)


def ends_with(match, ignore_case: bool = True) -> Sel:
    return _patterns(match, ignore_case, str.endswith)


def contains(match, ignore_case: bool = True) -> Sel:
    return _patterns(match, ignore_case, lambda x, p: p in x)


def matches(match, ignore_case: bool = True) -> Sel:
    flags = re.IGNORECASE if ignore_case else 0
    pats = [match] if isinstance(match, str) else list(match)
    return Sel(lambda t, pool: _unique(x for p in pats for x in pool if re.search(p, x, flags)))


def all_of(names) -> Sel:
    names = [n.name if isinstance(n, Ref) else n for n in ([names] if isinstance(names, str) else names)]

    def pick(t, pool):
        gone = [n for n in names if n not in pool]
        if gone:
            raise KeyError(f"no columns {gone}")
        return _unique(names)

    return Sel(pick)


def any_of(names) -> Sel:
    names = [names] if isinstance(names, str) else list(names)
    return Sel(lambda t, pool: _unique(n for n in names if n in pool))


def num_range(prefix: str, n: int | Iterable[int], width: int | None = None) -> Sel:
    items = range(n) if isinstance(n, int) else n
    return all_of([f"{prefix}{str(i).zfill(width or 0)}" for i in items])


_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def is_numeric_type(d) -> bool:
    return isinstance(d, _NUMERIC)


def where(predicate) -> Sel:
    """Columns whose type passes: a predicate on the data type, or one of the library's ``is_*`` functions."""
    test = getattr(predicate, "on_type", predicate)
    return Sel(lambda t, pool: [x for x in pool if test(t.df.schema[x].dataType)])

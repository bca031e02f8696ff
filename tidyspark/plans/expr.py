"""Deferred expressions: built from ``f``, bound to a table's columns when a verb runs.

An expression is bound in one of four modes: ``row`` (plain projection), ``agg`` (inside a groupBy), ``window`` (an
aggregate becomes a window over the groups, or one broadcast row where there are none) and ``rowwise`` (an aggregate
reduces the values of its own row).
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

ROW, AGG, WIN = "row", "agg", "win"


def is_na(c: Column) -> Column:
    return c.isNull()


def truth(c: Column) -> Column:
    """Missing counts as false."""
    return F.coalesce(c.cast("boolean"), F.lit(False))


class Expr:
    """A node; ``children`` are expressions or plain values."""

    children: tuple = ()
    kind = ROW

    def bind(self, ctx) -> Any:
        raise NotImplementedError

    def refs(self) -> set[str]:
        out: set[str] = set()
        for c in self.children:
            if isinstance(c, Expr):
                out |= c.refs()
        return out

    def has(self, *kinds: str) -> bool:
        return self.kind in kinds or any(isinstance(c, Expr) and c.has(*kinds) for c in self.children)

    def label(self) -> str:
        return str(self)[:16]

    def __bool__(self):
        raise TypeError("an expression has no truth value until a verb binds it; use & and |")

    def __hash__(self):
        return id(self)

    def __getattr__(self, name: str):
        if name.startswith("__"):
            raise AttributeError(name)
        return Field(self, name)


class Lit(Expr):
    def __init__(self, value):
        self.value = value

    def bind(self, ctx):
        if isinstance(self.value, (list, tuple)):
            return F.array(*(F.lit(v) for v in self.value))
        return F.lit(self.value)

    def __repr__(self):
        return repr(self.value)


class Ref(Expr):
    def __init__(self, name: str):
        self.name = name

    def bind(self, ctx):
        return ctx.column(self.name)

    def refs(self):
        return {self.name}

    def __repr__(self):
        return self.name

    def __getitem__(self, name):
        return Field(self, name)


class Field(Expr):
    """A field of a packed column."""

    def __init__(self, base: Expr, name: str):
        self.children, self.field = (base,), name

    def bind(self, ctx):
        return ctx.bind(self.children[0]).getField(self.field)

    def __repr__(self):
        return f"{self.children[0]!r}${self.field}"


class Func(Expr):
    """A function of the library: ``build(ctx, *bound args, **options)``."""

    def __init__(self, name: str, build: Callable, args: tuple, options: dict, kind: str, array: Callable | None = None, raw: bool = False):
        self.name, self.build, self.children, self.options, self.kind, self.array, self.raw = name, build, args, options, kind, array, raw

    def refs(self):
        out = super().refs()
        for v in self.options.values():
            for x in v if isinstance(v, (list, tuple)) else (v,):
                if isinstance(x, Expr):
                    out |= x.refs()
        return out

    def bind(self, ctx):
        if self.raw:
            return self.build(ctx, *self.children, **self.options)
        if self.kind == AGG:
            return ctx.aggregate(self)
        args = [ctx.bind(c) for c in self.children]
        options = {k: ctx.bind(v) if isinstance(v, Expr) else v for k, v in self.options.items()}
        return self.build(ctx, *args, **options)

    def __repr__(self):
        return f"{self.name}({', '.join(map(repr, self.children))})"


class F_:
    """``f.x`` and ``f["x"]`` name a column of the table at hand."""

    def __getattr__(self, name: str) -> Ref:
        if name.startswith("__"):
            raise AttributeError(name)
        return Ref(name)

    def __getitem__(self, item):
        if isinstance(item, slice):
            return item
        return Ref(item) if isinstance(item, str) else item


f = F_()


def wrap(v) -> Expr:
    return v if isinstance(v, Expr) else Lit(v)


def _divide(ctx, a, b):
    return F.try_divide(a.cast("double"), b.cast("double"))


def _floordiv(ctx, a, b):
    return F.floor(F.try_divide(a.cast("double"), b.cast("double")))


def _mod(ctx, a, b):
    b = F.when(b != 0, b)
    return a - b * F.floor(a.cast("double") / b.cast("double"))


_OPERATORS = {
    "add": lambda ctx, a, b: a + b,
    "sub": lambda ctx, a, b: a - b,
    "mul": lambda ctx, a, b: a * b,
    "truediv": _divide,
    "floordiv": _floordiv,
    "mod": _mod,
    "pow": lambda ctx, a, b: F.pow(a, b),
    # comparisons with a missing side are false, but "differs" is true
    "eq": lambda ctx, a, b: F.coalesce(a == b, F.lit(False)),
    "ne": lambda ctx, a, b: F.coalesce(a != b, F.lit(True)),
    "lt": lambda ctx, a, b: F.coalesce(a < b, F.lit(False)),
    "le": lambda ctx, a, b: F.coalesce(a <= b, F.lit(False)),
    "gt": lambda ctx, a, b: F.coalesce(a > b, F.lit(False)),
    "ge": lambda ctx, a, b: F.coalesce(a >= b, F.lit(False)),
    "and": lambda ctx, a, b: truth(a) & truth(b),
    "or": lambda ctx, a, b: truth(a) | truth(b),
    "xor": lambda ctx, a, b: truth(a) != truth(b),
}


def _binary(op: str):
    def forward(self, other):
        return Func(op, _OPERATORS[op], (self, wrap(other)), {}, ROW)

    def backward(self, other):
        return Func(op, _OPERATORS[op], (wrap(other), self), {}, ROW)

    return forward, backward


for _op in ("add", "sub", "mul", "truediv", "floordiv", "mod", "pow", "and", "or", "xor"):
    _f, _b = _binary(_op)
    setattr(Expr, f"__{_op}__", _f)
    setattr(Expr, f"__r{_op}__", _b)
for _op in ("eq", "ne", "lt", "le", "gt", "ge"):
    setattr(Expr, f"__{_op}__", _binary(_op)[0])
Expr.__neg__ = lambda self: Func("neg", lambda ctx, a: -a, (self,), {}, ROW)
Expr.__pos__ = lambda self: self
Expr.__invert__ = lambda self: Func("not", lambda ctx, a: ~truth(a), (self,), {}, ROW)


def function(kind: str = ROW, array: Callable | None = None, raw: bool = False, name: str | None = None):
    """Make a library function of a column builder ``build(ctx, *columns, **options)``.

    ``kind`` is ``row``, ``agg`` or ``win``; ``array`` reduces an array (rowwise tables); ``raw`` passes unbound arguments.
    """

    def deco(build: Callable):
        def call(*args, **options):
            return Func(name or build.__name__.rstrip("_"), build, args if raw else tuple(map(wrap, args)), options, kind, array, raw)

        call.__name__, call.__doc__ = build.__name__, build.__doc__
        return call

    return deco

"""The table wrapper: a lazy DataFrame with groups, row order and kind; and the context that binds expressions to it."""

from __future__ import annotations

import inspect
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .expr import AGG, WIN, Expr, Func, Ref, wrap

#: Hidden row number of literal tables and of tables that were asked for one.
ORDINAL = "__row__"


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def sort_column(c: Column, descending: bool = False) -> Column:
    """Sort column with missing values last, which knows its opposite."""
    out = c.desc_nulls_last() if descending else c.asc_nulls_last()
    out.__dict__["opposite"] = c.asc_nulls_first() if descending else c.desc_nulls_first()
    return out


@dataclass(frozen=True)
class Fct:
    """A bound factor: value column and levels."""

    col: Column
    levels: list
    ordered: bool = False


@dataclass(frozen=True)
class Tbl:
    df: DataFrame
    groups: tuple[str, ...] = ()
    kind: str = "plain"  # plain, grouped, rowwise
    order: tuple = ()  # sort columns of the last arrange
    drop: bool = True

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != ORDINAL]

    @property
    def schema(self):
        return self.df.schema

    def with_df(self, df: DataFrame, **changes) -> Tbl:
        return replace(self, df=df, **changes)

    def regroup(self, df: DataFrame, order: tuple | None = None) -> Tbl:
        """The same grouping on another frame, as far as its columns survive."""
        left = tuple(g for g in self.groups if g in df.columns)
        kind = self.kind if self.kind == "rowwise" or left else "plain"
        return Tbl(df, left, kind, self.order if order is None else order, self.drop)

    def ungroup(self) -> Tbl:
        return replace(self, groups=(), kind="plain")

    def ordinal(self) -> Tbl:
        """With a row order: that of the last arrange, of literal rows, or of the scan."""
        if self.order or ORDINAL in self.df.columns:
            return self
        return self.with_df(self.df.withColumn(ORDINAL, F.monotonically_increasing_id()))

    def order_columns(self) -> list[Column]:
        if self.order:
            more = [quoted(ORDINAL)] if ORDINAL in self.df.columns else []
            return [*self.order, *more]
        if ORDINAL in self.df.columns:
            return [quoted(ORDINAL)]
        raise ValueError("this operation needs a row order: arrange() first")

    def reverse_columns(self) -> list[Column] | None:
        """The opposite of ``order_columns``; None if a sort column doesn't know its own."""
        out = [c.__dict__.get("opposite") for c in self.order]
        if any(c is None for c in out):
            return None
        return [*out, *([quoted(ORDINAL).desc()] if ORDINAL in self.df.columns else [])]

    def levels(self, name: str) -> list | None:
        meta = self.df.schema[name].metadata
        return list(meta["levels"]) if "levels" in meta else None

    def visible(self) -> DataFrame:
        """The frame without hidden columns, sorted if an order was asked for."""
        df = self.df.orderBy(*self.order_columns()) if self.order or ORDINAL in self.df.columns else self.df
        return df.select(*(quoted(c) for c in self.columns))

    def collect(self) -> list:
        return self.visible().collect()

    def to_pandas(self):
        return self.visible().toPandas()

    def explain(self, mode: str = "formatted") -> None:
        self.visible().explain(mode)

    def __rshift__(self, verb):
        return verb.__rrshift__(self)


class Ctx:
    """Binds expressions to ``tbl``; collects the scalars and staged columns the frame needs first."""

    def __init__(self, tbl: Tbl, mode: str, current: str | None = None):
        self.tbl, self.mode, self.current = tbl, mode, current
        self.scalars: dict[str, Column] = {}
        self.n = 0

    def name(self, stem: str) -> str:
        self.n += 1
        return f"__{stem}{self.n}__"

    def column(self, name: str) -> Column:
        if name in self.tbl.df.columns:
            return quoted(name)
        outer, _, inner = name.partition("$")
        if inner and outer in self.tbl.df.columns:
            return quoted(outer).getField(inner)
        raise KeyError(f"no column {name!r}")

    def bind(self, e) -> Any:
        if isinstance(e, Fct):
            return e.col
        out = wrap(e).bind(self)
        return out.col if isinstance(out, Fct) else out

    def window(self, order: list[Column] | None = None) -> WindowSpec:
        w = Window.partitionBy(*(quoted(g) for g in self.tbl.groups)) if self.tbl.groups else Window.partitionBy(F.lit(0))
        return w.orderBy(*order) if order else w

    def ordered(self, *first: Column) -> WindowSpec:
        return self.window([*first, *self.tbl.order_columns()])

    def over(self, c: Column) -> Column:
        """An aggregate spread over its group's rows."""
        if self.tbl.groups:
            return c.over(self.window())
        name = self.name("s")
        self.scalars[name] = c
        return quoted(name)

    def inner(self) -> Ctx:
        """Context of an aggregate's arguments."""
        return self

    def aggregate(self, node: Func) -> Column:
        if self.mode == "rowwise":
            args = [self.bind(c) for c in node.children]
            return node.array(self, *args, **node.options) if node.array else node.build(self, *args, **node.options)
        args = []
        for c in node.children:
            if isinstance(c, Expr) and c.has(AGG, WIN):
                # an aggregate of an aggregate: the inner one is a column of its own first
                inner = Ctx(self.tbl, "window")
                bound = inner.bind(c)
                name = self.name("a")
                df = inner.prepare(self.tbl.df).withColumn(name, bound)
                self.tbl = self.tbl.with_df(df)
                args.append(quoted(name))
            else:
                args.append(self.bind(c))
        options = {k: self.bind(v) if isinstance(v, Expr) else v for k, v in node.options.items()}
        out = node.build(self, *args, **options)
        return out if self.mode == "agg" or self.spreads() else self.over(out)

    def spreads(self) -> bool:
        """Whether an aggregate is a window over groups here."""
        return self.mode == "window" and bool(self.tbl.groups)

    def spread(self, c: Column) -> Column:
        return c.over(self.window()) if self.spreads() else c

    def prepare(self, df: DataFrame) -> DataFrame:
        """Adds the ungrouped aggregates as one broadcast row."""
        if not self.scalars:
            return df
        return df.crossJoin(F.broadcast(df.agg(*(c.alias(n) for n, c in self.scalars.items()))))


def evaluate(tbl: Tbl, e, current: str | None = None) -> tuple[Tbl, Any]:
    """Bind for a projection; returns the table (perhaps with helper columns) and the Column, Fct or value."""
    e = wrap(e)
    if e.has(WIN):
        tbl = tbl.ordinal()
    ctx = Ctx(tbl, "rowwise" if tbl.kind == "rowwise" else "window", current)
    out = e.bind(ctx)
    return ctx.tbl.with_df(ctx.prepare(ctx.tbl.df)), out


def put(df: DataFrame, name: str, value) -> DataFrame:
    """Add a bound value as a column, with factor levels kept."""
    if isinstance(value, Fct):
        return df.withColumn(name, value.col).withMetadata(name, {"levels": list(value.levels), "ordered": value.ordered})
    return df.withColumn(name, value)


def clean(df: DataFrame, keep: list[str]) -> DataFrame:
    names = [*keep, *([ORDINAL] if ORDINAL in df.columns and ORDINAL not in keep else [])]
    return df.select(*(quoted(c) for c in names))


def as_tbl(x) -> Tbl:
    if isinstance(x, Tbl):
        return x
    if isinstance(x, DataFrame):
        return Tbl(x)
    raise TypeError(f"not a table: {type(x).__name__}")


class Pending:
    """A verb waiting for its table."""

    def __init__(self, fn, args, kwargs):
        self.fn, self.args, self.kwargs = fn, args, kwargs

    def __rrshift__(self, data):
        return self.fn(as_tbl(data), *self.args, **self.kwargs)


def verb(fn):
    """``tbl >> fn(...)`` or ``fn(tbl, ...)``; a verb of two tables, x and y, runs when it has both."""
    needed = 2 if list(inspect.signature(fn).parameters)[1:2] == ["y"] and list(inspect.signature(fn).parameters)[0] == "x" else 1

    def call(*args, **kwargs):
        if len(args) >= needed and all(isinstance(a, (Tbl, DataFrame)) for a in args[:needed]):
            return fn(as_tbl(args[0]), *args[1:], **kwargs)
        return Pending(fn, args, kwargs)

    call.__name__, call.__doc__, call.direct = fn.__name__, fn.__doc__, fn
    return call


def name_of(e) -> str:
    return e.name if isinstance(e, Ref) else e if isinstance(e, str) else wrap(e).label()

"""Verbs on columns and rows of one table: mutate, select, filter, distinct, arrange and their kin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions.windows import ordering
from ..plans.expr import AGG, WIN, Expr, Func, Lit, Ref, truth, wrap
from ..plans.select import everything, resolve
from ..plans.tbl import ORDINAL, Ctx, Tbl, clean, evaluate, name_of, put, quoted, verb


_current: list[str] = []


def cur_column() -> str:
    """The name of the column that ``across`` is at."""
    if not _current:
        raise ValueError("cur_column() is for functions of across()")
    return _current[-1]


class Across:
    """columns x functions; expands to named expressions."""

    def __init__(self, cols, fns, names: str | None = None, args: tuple = (), kwargs: dict | None = None):
        self.cols, self.names, self.args, self.kwargs = cols, names, args, kwargs or {}
        if fns is None:
            fns = lambda x: x
        self.single = callable(fns)
        self.fns = {"": fns} if callable(fns) else dict(fns) if isinstance(fns, dict) else {str(i + 1): g for i, g in enumerate(fns)}

    def expand(self, tbl: Tbl) -> list[tuple[str, Expr]]:
        cols = resolve(tbl, [everything() if self.cols is None else self.cols], [c for c in tbl.columns if c not in tbl.groups])
        pattern = self.names or ("{_col}" if self.single else "{_col}_{_fn}")
        out = []
        for c in cols:
            for i, (k, g) in enumerate(self.fns.items()):
                label = pattern.format(_col=c, _fn=k or "1", _fn0=i, _fn1=i + 1)
                _current.append(c)
                try:
                    out.append((label, wrap(_call(g, Ref(c), self.args, self.kwargs))))
                finally:
                    _current.pop()
        return out


def _call(g: Callable, x: Expr, args: tuple, kwargs: dict):
    try:
        return g(x, *args, **kwargs)
    except TypeError as e:
        if "truth value" not in str(e) and "Expr" not in str(e) and "must be" not in str(e) and "bad operand" not in str(e):
            raise
        from ..functions.udf import user_function

        return user_function(lambda v: g(v, *args, **kwargs), kind="transform")(x)


def across(cols=None, fns=None, *args, _names: str | None = None, **kwargs) -> Across:
    return Across(cols, fns, _names, args, kwargs)


class _Rowwise(Func):
    """if_any / if_all: expanded when the table is known."""

    def __init__(self, cols, fn, any_: bool):
        super().__init__("if_any" if any_ else "if_all", None, (), {}, "row")
        self.cols, self.fn, self.any = cols, fn, any_

    def bind(self, ctx):
        out = F.lit(not self.any)
        for _, e in Across(self.cols, self.fn).expand(ctx.tbl):
            one = truth(ctx.bind(e))
            out = (out | one) if self.any else (out & one)
        return out


def if_any(cols=None, fn=None):
    return _Rowwise(cols, fn, True)


def if_all(cols=None, fn=None):
    return _Rowwise(cols, fn, False)


class _Array(Func):
    def __init__(self, cols):
        super().__init__("c_across", None, (), {}, "row")
        self.cols = cols

    def bind(self, ctx):
        names = resolve(ctx.tbl, [everything() if self.cols is None else self.cols], [c for c in ctx.tbl.columns if c not in ctx.tbl.groups])
        return F.array(*(quoted(c) for c in names))


def c_across(cols=None):
    """The selected columns of a row as a vector."""
    return _Array(cols)


def pick(*cols) -> Across:
    return Across(list(cols), None, "{_col}")


def _args(tbl: Tbl, args, kwargs) -> list[tuple[str | None, object]]:
    out: list[tuple[str | None, object]] = []
    for a in args:
        if isinstance(a, Across):
            out += a.expand(tbl)
        elif isinstance(a, dict):
            out += list(a.items())
        else:
            out.append((name_of(a), a))
    for k, v in kwargs.items():
        if isinstance(v, Across):
            parts = v.expand(tbl)
            out.append((k, Func("pack", lambda ctx, *cols, names=[n for n, _ in parts]: F.struct(*(c.alias(n) for c, n in zip(cols, names))), tuple(e for _, e in parts), {}, "row")))
        else:
            out.append((k, v))
    return out


def _value(v):
    """A plain list is a literal array, anything else an expression."""
    return v if isinstance(v, Expr) else Lit(v)


@verb
def mutate(tbl: Tbl, *args, _keep: str = "all", _before=None, _after=None, **kwargs) -> Tbl:
    """Add or replace columns one after the other; ``x=None`` drops; ``_keep`` is all, used, unused, none or trans."""
    before, used, made = tbl.columns, set(), []
    cur = tbl
    for name, v in _args(cur, args, kwargs):
        if v is None:
            cur = cur.with_df(cur.df.drop(name))
            continue
        e = _value(v)
        used |= e.refs()
        cur, bound = evaluate(cur, e, name)
        cur = cur.with_df(put(cur.df, name, bound))
        made.append(name)
    names = [c for c in cur.columns if not c.startswith("__")]
    temporary = {m for m in made if m.startswith("_") and m in used}
    names = [c for c in names if c not in temporary]
    new = [c for c in dict.fromkeys(made) if c in names and c not in before]
    if _keep == "used":
        names = [c for c in names if c in used or c in made or c in tbl.groups]
    elif _keep == "unused":
        names = [c for c in names if c not in used or c in made or c in tbl.groups]
    elif _keep == "none":
        names = [c for c in names if c in made or c in tbl.groups]
    elif _keep == "trans":
        names = [c for c in tbl.groups if c not in made] + [c for c in dict.fromkeys(made) if c in names]
    if _before is not None or _after is not None:
        rest = [c for c in names if c not in new]
        names = _place(cur, rest, new, _before, _after)
    return cur.regroup(clean(cur.df, names))


def _place(tbl, rest, moved, before, after) -> list[str]:
    if before is not None and after is not None:
        raise ValueError("give _before or _after, not both")
    at = 0
    if before is not None:
        at = min(rest.index(c) for c in resolve(tbl, [before], rest))
    elif after is not None:
        at = max(rest.index(c) for c in resolve(tbl, [after], rest)) + 1
    return rest[:at] + moved + rest[at:]


@verb
def transmute(tbl: Tbl, *args, **kwargs) -> Tbl:
    return mutate.direct(tbl, *args, _keep="trans", **kwargs)


@verb
def select(tbl: Tbl, *args, **renames) -> Tbl:
    """Tidy selection, with ``new=old``; group columns are always kept."""
    olds = {n: resolve(tbl, [o])[0] for n, o in renames.items()}
    chosen = resolve(tbl, args) if args else []
    new_of = {o: n for n, o in olds.items()}
    chosen = list(dict.fromkeys(chosen + list(olds.values())))
    chosen = [g for g in tbl.groups if g not in chosen] + chosen
    out = clean(tbl.df, chosen)
    names = {o: n for o, n in new_of.items()}
    out = out.withColumnsRenamed(names)
    return Tbl(out, tuple(names.get(g, g) for g in tbl.groups), tbl.kind, tbl.order if not names else (), tbl.drop)


@verb
def rename(tbl: Tbl, **renames) -> Tbl:
    table = {resolve(tbl, [o])[0]: n for n, o in renames.items()}
    return Tbl(tbl.df.withColumnsRenamed(table), tuple(table.get(g, g) for g in tbl.groups), tbl.kind, (), tbl.drop)


@verb
def rename_with(tbl: Tbl, fn: Callable, *cols, **kwargs) -> Tbl:
    names = resolve(tbl, cols) if cols else tbl.columns
    table = {c: fn(c, **kwargs) for c in names}
    return Tbl(tbl.df.withColumnsRenamed(table), tuple(table.get(g, g) for g in tbl.groups), tbl.kind, (), tbl.drop)


@verb
def relocate(tbl: Tbl, *args, _before=None, _after=None, **renames) -> Tbl:
    moved = resolve(tbl, [*args, *renames.values()])
    rest = [c for c in tbl.columns if c not in moved]
    out = tbl.regroup(clean(tbl.df, _place(tbl, rest, moved, _before, _after)))
    return rename.direct(out, **renames) if renames else out


@verb
def filter_(tbl: Tbl, *conditions, _preserve: bool = False) -> Tbl:
    """Rows for which all conditions hold; missing is false; aggregates and ranks work per group.

    ``_preserve`` is taken for its callers' sake: groups are made from the rows when they are asked for, so there is no
    stored grouping to keep.
    """
    out, cols = tbl, tbl.columns
    for c in conditions:
        if isinstance(c, bool):
            out = out if c else out.with_df(out.df.limit(0))
            continue
        e = wrap(c)
        if e.has(AGG, WIN):
            out, bound = evaluate(out, e)
            out = out.with_df(out.df.withColumn("__keep__", truth(bound)).where("__keep__"))
        else:
            out, bound = evaluate(out, e)
            out = out.with_df(out.df.where(truth(bound)))
    return tbl.regroup(clean(out.df, cols))


@verb
def distinct(tbl: Tbl, *args, _keep_all: bool = False, **kwargs) -> Tbl:
    """Distinct rows; with ``_keep_all`` the first row of each by row order."""
    if not args and not kwargs:
        return tbl.regroup(tbl.df.select(*(quoted(c) for c in tbl.columns)).distinct())
    made = mutate.direct(tbl, *args, **kwargs)
    keys = list(dict.fromkeys([*tbl.groups, *(n for n, _ in _args(tbl, args, kwargs))]))
    if not _keep_all:
        return tbl.regroup(made.df.select(*(quoted(k) for k in keys)).distinct())
    made = made.ordinal()
    w = Window.partitionBy(*(quoted(k) for k in keys)).orderBy(*made.order_columns())
    return tbl.regroup(clean(made.df.withColumn("__n__", F.row_number().over(w)).where("__n__ = 1"), made.columns))


def sort_columns(tbl: Tbl, args) -> tuple[Tbl, list[Column]]:
    cols = []
    for a in args:
        if isinstance(a, Across):
            for _, e in a.expand(tbl):
                cols.append(ordering(Ctx(tbl, "window"), e))
        else:
            cols.append(ordering(Ctx(tbl, "window"), Ref(a) if isinstance(a, str) else a))
    return tbl, cols


@verb
def arrange(tbl: Tbl, *args, _by_group: bool = False) -> Tbl:
    """Sets the row order; missing values last in both directions.  Sorting happens once, when rows are delivered."""
    args = [*(Ref(g) for g in tbl.groups), *args] if _by_group else list(args)
    tbl, cols = sort_columns(tbl, args)
    return Tbl(tbl.df, tbl.groups, tbl.kind, tuple(cols), tbl.drop)


@verb
def pull(tbl: Tbl, var=-1, name=None, to: str | None = None):
    """A column as a list (or dict with ``name``, or series)."""
    col = resolve(tbl, [var])[0]
    cols = [quoted(col)] + ([quoted(resolve(tbl, [name])[0])] if name is not None else [])
    rows = tbl.visible().select(*cols).collect()
    if name is not None or to == "dict":
        return {r[1]: r[0] for r in rows}
    values = [r[0] for r in rows]
    if to == "series":
        import pandas as pd

        return pd.Series(values, name=col)
    if to == "array":
        import numpy as np

        return np.array(values)
    return values


@verb
def drop_na(tbl: Tbl, *cols, how_: str = "any") -> Tbl:
    names = resolve(tbl, cols) if cols else tbl.columns
    return tbl.regroup(tbl.df.na.drop(how_, subset=names))


@verb
def replace_na(tbl: Tbl, values=None) -> Tbl:
    """Missing values of a table; for a column use coalesce()."""
    table = values if isinstance(values, dict) else {c: values for c in tbl.columns}
    out = tbl.df
    for c, v in table.items():
        out = out.withColumn(c, F.coalesce(quoted(c), F.lit(v).try_cast(tbl.df.schema[c].dataType)))
    return tbl.regroup(out)


@verb
def uncount(tbl: Tbl, weights, _remove: bool = True, _id: str | None = None) -> Tbl:
    """Each row repeated; a negative weight is an error when rows are made."""
    out, w = evaluate(tbl, Ref(weights) if isinstance(weights, str) else weights)
    names = [c for c in tbl.columns if not (_remove and isinstance(weights, (Ref, str)) and c == name_of(weights))]
    df = out.df
    if _id:
        out = out.ordinal()
        df = out.df.withColumn("__id__", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*out.order_columns())) - 1)
    checked = F.when(w < 0, F.raise_error(F.lit("uncount(): negative weight"))).otherwise(w).cast("int")
    df = df.where(w != 0).withColumn("__rep__", F.explode(F.sequence(F.lit(1), checked)))
    cols = [quoted(c) for c in names] + ([F.col("__id__").alias(_id)] if _id else [])
    return tbl.regroup(df.select(*cols))


@verb
def add_column(tbl: Tbl, *args, _before=None, _after=None, **kwargs) -> Tbl:
    clash = [k for k in kwargs if k in tbl.columns]
    if clash:
        raise ValueError(f"columns exist already: {clash}")
    return mutate.direct(tbl, *args, _before=_before, _after=_after, **kwargs)


@verb
def add_row(tbl: Tbl, _before: int | None = None, _after: int | None = None, **values) -> Tbl:
    """A literal row (or rows, from lists) at the end, or at a 0-based position of the row order."""
    from ..sources.tables import tibble

    if tbl.kind == "grouped":
        raise ValueError("add_row() needs an ungrouped table")
    gone = [k for k in values if k not in tbl.columns]
    if gone:
        raise ValueError(f"no columns {gone}")
    new = tibble(spark=tbl.df.sparkSession, **values).df.drop(ORDINAL)
    new = new.select(*(quoted(c).cast(tbl.df.schema[c].dataType) for c in new.columns))
    if _before is None and _after is None and ORDINAL not in tbl.df.columns:
        return tbl.regroup(tbl.df.unionByName(new, allowMissingColumns=True))
    base = tbl.ordinal()
    at = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*base.order_columns()))
    df = base.df.withColumn(ORDINAL, (at - 1).cast("double"))
    position = (_before - 0.5) if _before is not None else (_after + 0.5) if _after is not None else float("inf")
    out = df.unionByName(new.withColumn(ORDINAL, F.lit(float(position))), allowMissingColumns=True)
    return tbl.regroup(out, order=())


@verb
def head(tbl: Tbl, n: int = 6) -> Tbl:
    df = tbl.df.orderBy(*tbl.order_columns()) if tbl.order or ORDINAL in tbl.df.columns else tbl.df
    return tbl.regroup(df.limit(n))


@verb
def tail(tbl: Tbl, n: int = 6) -> Tbl:
    from .slices import slice_tail

    return slice_tail.direct(tbl.ungroup(), n=n)


@verb
def complete_cases(tbl: Tbl, name: str = "complete") -> Tbl:
    ok = F.lit(True)
    for c in tbl.columns:
        ok = ok & quoted(c).isNotNull()
    return tbl.with_df(tbl.df.withColumn(name, ok))


@verb
def rowid_to_column(tbl: Tbl, var: str = "rowid") -> Tbl:
    """0-based row number as the first column."""
    if var in tbl.columns:
        raise ValueError(f"column {var!r} exists already")
    out = tbl.ordinal()
    n = (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*out.order_columns())) - 1).alias(var)
    keep = [quoted(c) for c in out.df.columns]
    return tbl.regroup(out.df.select(n, *keep))


@verb
def rownames_to_column(tbl: Tbl, var: str = "rowname") -> Tbl:
    return rowid_to_column.direct(tbl, var)


@verb
def column_to_rownames(tbl: Tbl, var: str = "rowname") -> Tbl:
    """Spark has no index: the column stays, first."""
    return relocate.direct(tbl, var)


@verb
def rownames(tbl: Tbl) -> list[int]:
    """0-based row numbers: rows have no other names."""
    return list(range(tbl.df.count()))


@verb
def set_rownames(tbl: Tbl, names, var: str = "rowname") -> Tbl:
    """Names (a list in row order) as the first column ``var``."""
    from ..sources.tables import tibble

    at = "__at__"
    given = tibble(spark=tbl.df.sparkSession, **{var: list(names)}).df.withColumnRenamed(ORDINAL, at)
    rows = rowid_to_column.direct(tbl, at)
    return rows.regroup(clean(rows.df.join(F.broadcast(given), at), [var, *tbl.columns]))


@verb
def remove_rownames(tbl: Tbl) -> Tbl:
    return tbl


def has_rownames(tbl) -> bool:
    return False


@verb
def t(tbl: Tbl) -> Tbl:
    """Transpose (small tables)."""
    return Tbl(tbl.visible().transpose())


@verb
def set_colnames(tbl: Tbl, names) -> Tbl:
    return rename.direct(tbl, **dict(zip(names, tbl.columns)))


@verb
def colnames(tbl: Tbl) -> list[str]:
    return tbl.columns


@verb
def nrow(tbl: Tbl) -> int:
    return tbl.df.count()


@verb
def ncol(tbl: Tbl) -> int:
    return len(tbl.columns)


@verb
def dim(tbl: Tbl) -> tuple[int, int]:
    return tbl.df.count(), len(tbl.columns)


@verb
def flatten(tbl: Tbl, bycol: bool = False) -> list:
    rows = tbl.collect()
    return [r[i] for i in range(len(tbl.columns)) for r in rows] if bycol else [v for r in rows for v in r]


@verb
def deframe(tbl: Tbl):
    rows = tbl.collect()
    return [r[0] for r in rows] if len(tbl.columns) == 1 else {r[0]: r[1] for r in rows}


@verb
def glimpse(tbl: Tbl, width: int = 80, n: int = 10) -> str:
    """Names, types and first values; reads ``n`` rows."""
    rows = tbl.visible().limit(n).collect()
    head_ = [f"Columns: {len(tbl.columns)}"] + ([f"Groups: {', '.join(tbl.groups)}"] if tbl.groups else [])
    lines = [f". {c:<12} <{tbl.df.schema[c].dataType.simpleString()}> " + ", ".join(str(r[c]) for r in rows) for c in tbl.columns]
    return "\n".join([*head_, *(x if len(x) <= width else x[: width - 1] + "…" for x in lines)])



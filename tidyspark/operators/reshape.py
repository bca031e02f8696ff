"""Reshaping: pivots, nesting, splitting, completing, filling."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.factors import bounded
from ..plans.expr import Ref
from ..plans.select import is_numeric_type, resolve
from ..plans.tbl import ORDINAL, Tbl, clean, evaluate, name_of, quoted, verb
from .columns import mutate
from .joins import repair


def _common(types: Sequence[T.DataType]) -> T.DataType:
    if all(t == types[0] for t in types):
        return types[0]
    if all(is_numeric_type(t) for t in types):
        return T.DoubleType() if any(isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)) for t in types) else T.LongType()
    return T.StringType()


@verb
def pivot_longer(tbl: Tbl, cols, names_to="name", names_prefix: str | None = None, names_sep: str | None = None, names_pattern: str | None = None, names_dtypes=None, names_transform=None, values_to: str = "value", values_drop_na: bool = False, values_dtypes=None, values_transform=None) -> Tbl:
    """Columns to rows.  ``.value`` in ``names_to`` keeps that part of the name as columns; None discards a part."""
    chosen = resolve(tbl, cols if isinstance(cols, (list, tuple)) else [cols])
    ids = [c for c in tbl.columns if c not in chosen]
    targets = [names_to] if isinstance(names_to, str) else list(names_to)
    parts: dict[str, list[str | None]] = {}
    for c in chosen:
        name = re.sub("^" + re.escape(names_prefix), "", c) if names_prefix else c
        if names_pattern:
            m = re.search(names_pattern, name)
            got = list(m.groups()) if m else [None] * len(targets)
        elif names_sep:
            got = re.split(names_sep, name)
        else:
            got = [name]
        parts[c] = (got + [None] * len(targets))[: len(targets)]
    labels = [t for t in targets if t is not None and t not in (".value", "_value")]
    spread = [i for i, t in enumerate(targets) if t in (".value", "_value")]
    groups: dict[tuple, dict[str, str]] = {}
    for c in chosen:
        key = tuple(p for p, t in zip(parts[c], targets) if t is not None and t not in (".value", "_value"))
        value = "_".join(str(parts[c][i]) for i in spread) if spread else values_to
        groups.setdefault(key + (() if spread else (len(groups),)), {})[value] = c
    values = list(dict.fromkeys(v for g in groups.values() for v in g))
    kinds = {v: _common([tbl.df.schema[g[v]].dataType for g in groups.values() if v in g]) for v in values}

    def label(i: int, part) -> Column:
        fn = names_transform.get(labels[i]) if isinstance(names_transform, dict) else names_transform
        part = fn(part) if fn and part is not None else part
        col = F.lit(part)
        kind = names_dtypes.get(labels[i]) if isinstance(names_dtypes, dict) else names_dtypes
        return col.cast(kind) if kind else col

    structs = [F.struct(*(label(i, key[i]).alias(n) for i, n in enumerate(labels)), *((quoted(g[v]) if v in g else F.lit(None)).cast(kinds[v]).alias(v) for v in values)) for key, g in groups.items()]
    df = tbl.df.select(*(quoted(c) for c in ids), F.inline(F.array(*structs)))
    if values_drop_na:
        df = df.where(reduce(lambda a, b: a | b, (quoted(v).isNotNull() for v in values)))
    for v in values:
        kind = values_dtypes.get(v) if isinstance(values_dtypes, dict) else values_dtypes
        fn = values_transform.get(v) if isinstance(values_transform, dict) else values_transform
        if kind:
            df = df.withColumn(v, quoted(v).cast(kind))
        if fn:
            df = df.withColumn(v, evaluate(Tbl(df), fn(Ref(v)))[1])
    return tbl.regroup(df, order=())


_FUNCTIONS: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count, "first": F.first, "list": F.collect_list}


@verb
def pivot_wider(tbl: Tbl, id_cols=None, names_from="name", names_prefix: str = "", names_sep: str = "_", names_glue: str | None = None, names_sort: bool = False, values_from="value", values_fill=None, values_fn=None, names: Sequence | None = None) -> Tbl:
    """Rows to columns.  The new names are collected unless ``names`` lists them.

    Without ``values_fn`` a cell with several rows is an error when rows are made.
    """
    nf = resolve(tbl, names_from if isinstance(names_from, (list, tuple)) else [names_from])
    vf = resolve(tbl, values_from if isinstance(values_from, (list, tuple)) else [values_from])
    ids = [c for c in tbl.columns if c not in nf + vf] if id_cols is None else resolve(tbl, id_cols if isinstance(id_cols, (list, tuple)) else [id_cols])
    key = F.concat_ws(names_sep, *(quoted(c).cast("string") for c in nf))
    df = tbl.df.where(reduce(lambda a, b: a & b, (quoted(c).isNotNull() for c in nf + ids))).withColumn("__key__", key)
    parts = {}
    if names is None:
        # a key's parts stay apart: a value may hold the separator
        found = bounded(df.select("__key__", *(quoted(c).cast("string") for c in nf)).distinct())
        parts = {r[0]: list(r[1:]) for r in found}
        names = sorted(parts)
    names = list(names)

    def cell(v: str, k: str) -> Column:
        here = F.col("__key__") == F.lit(k)
        if values_fn is None:
            many = F.raise_error(F.lit("pivot_wider(): several values for one cell; give values_fn"))
            return F.when(F.count_if(here) > 1, many).otherwise(F.first(F.when(here, F.struct(quoted(v).alias("v"))), ignorenulls=True))
        fn = values_fn.get(v) if isinstance(values_fn, dict) else values_fn
        if isinstance(fn, str):
            agg = _FUNCTIONS[fn](F.when(here, quoted(v)))
        else:
            node = fn(Ref("__cell__"))
            agg = node.build(None, F.when(here, quoted(v)), **node.options)
        return F.when(F.count_if(here) > 0, F.struct(agg.alias("v")))

    def label(v: str, k: str) -> str:
        if names_glue:
            of = dict(zip(nf, parts.get(k) or k.split(names_sep)))
            return names_glue.format(**of) if len(vf) == 1 else names_glue.format(_value=v, **of)
        return names_prefix + (k if len(vf) == 1 else f"{v}{names_sep}{k}")

    cells = [(label(v, k), v, k) for v in vf for k in names]
    wide = df.groupBy(*(quoted(c) for c in ids)).agg(*(cell(v, k).alias(n) for n, v, k in cells))
    # a cell without rows takes the fill, a missing value in a cell stays missing
    fill = lambda v: values_fill.get(v) if isinstance(values_fill, dict) else values_fill
    cols = [F.when(quoted(n).isNull(), F.lit(fill(v))).otherwise(quoted(n)["v"]).alias(n) if fill(v) is not None else quoted(n)["v"].alias(n) for n, v, _ in cells]
    return tbl.regroup(wide.select(*(quoted(c) for c in ids), *cols), order=())


# ---- list and packed columns ----


def _field(array: str, c: str) -> Column:
    return F.transform(array, lambda s: s[c])


@verb
def chop(tbl: Tbl, cols=None) -> Tbl:
    chosen = [c for c in tbl.columns if c not in tbl.groups] if cols is None else resolve(tbl, cols if isinstance(cols, (list, tuple)) else [cols])
    keys = [c for c in tbl.columns if c not in chosen]
    # one collection, so that the lists of a row stay aligned
    df = tbl.df.groupBy(*(quoted(k) for k in keys)).agg(F.collect_list(F.struct(*(quoted(c) for c in chosen))).alias("__l__"))
    return tbl.regroup(df.select(*(quoted(k) for k in keys), *(_field("__l__", c).alias(c) for c in chosen)), order=())


@verb
def unchop(tbl: Tbl, cols, keep_empty: bool = False) -> Tbl:
    """Arrays to rows, several in parallel; those of one element recycle; other sizes must agree."""
    chosen = resolve(tbl, cols if isinstance(cols, (list, tuple)) else [cols])
    size = F.greatest(*(F.size(quoted(c)) for c in chosen)) if len(chosen) > 1 else F.size(quoted(chosen[0]))
    fit = lambda c: F.when(F.size(quoted(c)) == size, quoted(c)).when(F.size(quoted(c)) == 1, F.array_repeat(F.get(quoted(c), F.lit(0)), size)).otherwise(F.raise_error(F.lit("unchop(): sizes differ")))
    zipped = F.arrays_zip(*(fit(c).alias(f"c{i}") for i, c in enumerate(chosen)))
    df = tbl.df.withColumn("__z__", (F.explode_outer if keep_empty else F.explode)(zipped))
    cols_ = [(F.col("__z__").getField(f"c{chosen.index(c)}") if c in chosen else quoted(c)).alias(c) for c in tbl.columns]
    return tbl.regroup(df.select(*cols_), order=())


@verb
def nest(tbl: Tbl, _names_sep: str | None = None, **cols) -> Tbl:
    """New array-of-struct columns; a grouped table nests the rest as ``data``."""
    if not cols:
        cols = {"data": [c for c in tbl.columns if c not in tbl.groups]}
    sets = {n: resolve(tbl, v if isinstance(v, (list, tuple)) else [v]) for n, v in cols.items()}
    inner = {c for v in sets.values() for c in v}
    keys = [c for c in tbl.columns if c not in inner]
    short = lambda n, c: c[len(n) + len(_names_sep) :] if _names_sep and c.startswith(n + _names_sep) else c
    df = tbl.df.groupBy(*(quoted(k) for k in keys)).agg(*(F.collect_list(F.struct(*(quoted(c).alias(short(n, c)) for c in v))).alias(n) for n, v in sets.items()))
    return tbl.regroup(df, order=())


@verb
def unnest(tbl: Tbl, *cols, keep_empty: bool = False, names_sep: str | None = None) -> Tbl:
    chosen = resolve(tbl, cols)
    out = unchop.direct(tbl, chosen, keep_empty)
    structs = [c for c in chosen if isinstance(out.df.schema[c].dataType, T.StructType)]
    return unpack.direct(out, structs, names_sep) if structs else out


@verb
def pack(tbl: Tbl, _names_sep: str | None = None, **cols) -> Tbl:
    sets = {n: resolve(tbl, v if isinstance(v, (list, tuple)) else [v]) for n, v in cols.items()}
    inner = {c for v in sets.values() for c in v}
    short = lambda n, c: c[len(n) + len(_names_sep) :] if _names_sep and c.startswith(n + _names_sep) else c
    rest = [quoted(c) for c in tbl.df.columns if c not in inner]
    return tbl.regroup(tbl.df.select(*rest, *(F.struct(*(quoted(c).alias(short(n, c)) for c in v)).alias(n) for n, v in sets.items())))


@verb
def unpack(tbl: Tbl, cols, names_sep: str | None = None, names_repair: str = "check_unique") -> Tbl:
    chosen = resolve(tbl, cols if isinstance(cols, (list, tuple)) else [cols])
    out, names = [], []
    for c in tbl.df.columns:
        kind = tbl.df.schema[c].dataType
        if c not in chosen:
            out.append(quoted(c))
            names.append(c)
        elif not isinstance(kind, T.StructType):
            raise ValueError(f"column {c!r} isn't packed")
        else:
            for x in kind.names:
                out.append(quoted(c).getField(x))
                names.append(f"{c}{names_sep}{x}" if names_sep else x)
    return tbl.regroup(tbl.df.select(*(c.alias(n) for c, n in zip(out, repair(names, names_repair)))))


# ---- grids ----


class Nesting:
    def __init__(self, *cols):
        self.cols = cols


def nesting(*cols) -> Nesting:
    """Only the combinations that occur."""
    return Nesting(*cols)


def _axes(tbl: Tbl, args, kwargs) -> list:
    """Distinct values of each axis as frames (factors give all levels)."""
    spark, out = tbl.df.sparkSession, []
    for a in args:
        if isinstance(a, Nesting):
            out.append(tbl.df.select(*(quoted(g) for g in tbl.groups), *(quoted(name_of(c)) for c in a.cols)).distinct())
            continue
        name = name_of(a)
        levels = tbl.levels(name) if name in tbl.df.columns else None
        if levels and not tbl.groups:
            out.append(spark.createDataFrame([(v,) for v in levels], T.StructType([T.StructField(name, tbl.df.schema[name].dataType)])))
        else:
            made = tbl if isinstance(a, (Ref, str)) else mutate.direct(tbl, **{name: a})
            out.append(made.df.select(*(quoted(g) for g in tbl.groups), quoted(name)).distinct())
    for name, v in kwargs.items():
        if isinstance(v, (list, tuple, range)):
            out.append(spark.createDataFrame([(x,) for x in v], [name]))
        else:
            out.append(mutate.direct(tbl, **{name: v}).df.select(*(quoted(g) for g in tbl.groups), quoted(name)).distinct())
    return out


@verb
def expand(tbl: Tbl, *args, **kwargs) -> Tbl:
    """All combinations of the axes' distinct values, per group."""
    axes = _axes(tbl, args, kwargs)

    def cross(a, b):
        shared = [g for g in tbl.groups if g in a.columns and g in b.columns]
        if not shared:
            return a.crossJoin(b)
        right = b.select(*(quoted(c).alias(f"__r_{c}") if c in shared else quoted(c) for c in b.columns))
        on = reduce(lambda p, q: p & q, (quoted(g).eqNullSafe(quoted(f"__r_{g}")) for g in shared))
        return a.join(right, on).drop(*(f"__r_{g}" for g in shared))

    return tbl.regroup(reduce(cross, axes), order=())


@verb
def complete(tbl: Tbl, *args, fill: dict | None = None, **kwargs) -> Tbl:
    """Absent combinations become rows; ``fill`` replaces missing values."""
    from .joins import full_join

    plain = tbl.ungroup()
    grid = expand.direct(plain, *args, **kwargs)
    out = full_join.direct(grid, Tbl(clean(tbl.df, tbl.columns).drop(ORDINAL)), by=grid.columns)
    df = out.df.select(*(quoted(c) for c in tbl.columns), *(quoted(c) for c in grid.columns if c not in tbl.columns))
    for c, v in (fill or {}).items():
        df = df.withColumn(c, F.coalesce(quoted(c), F.lit(v)))
    return tbl.regroup(df, order=())


def expand_grid(spark=None, **axes) -> Tbl:
    """Combinations of literal vectors, the first varying slowest."""
    from itertools import product

    from ..sources.tables import tibble

    names = list(axes)
    rows = list(product(*axes.values()))
    return tibble(spark=spark, **{n: [r[i] for r in rows] for i, n in enumerate(names)})


def crossing(spark=None, **axes) -> Tbl:
    return expand_grid(spark, **{k: sorted(set(v)) for k, v in axes.items()})


# ---- filling, splitting, uniting ----


@verb
def fill(tbl: Tbl, *cols, _direction: str = "down") -> Tbl:
    out = tbl.ordinal()
    w = Window.partitionBy(*(quoted(g) for g in tbl.groups) or [F.lit(0)]).orderBy(*out.order_columns())
    down = lambda c: F.last(c, True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    up = lambda c: F.first(c, True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    make = {"down": lambda c: down(c), "up": lambda c: up(c), "downup": lambda c: F.coalesce(down(c), up(c)), "updown": lambda c: F.coalesce(up(c), down(c))}[_direction]
    names = resolve(tbl, cols) if cols else [c for c in tbl.columns if c not in tbl.groups]
    return tbl.regroup(clean(out.df.withColumns({c: make(quoted(c)) for c in names}), tbl.columns))


def _converted(col: Column, kind) -> Column:
    return col.try_cast(kind)


def _convert(df, into, convert):
    if not convert:
        return df
    for c in into:
        if isinstance(convert, dict):
            if c in convert:
                df = df.withColumn(c, _converted(quoted(c), convert[c]))
        elif isinstance(convert, (str, T.DataType)):
            df = df.withColumn(c, _converted(quoted(c), convert))
        else:
            bad = df.where(quoted(c).isNotNull() & quoted(c).try_cast("bigint").isNull()).limit(1).isEmpty()
            df = df.withColumn(c, _converted(quoted(c), "bigint")) if bad else df
    return df


@verb
def separate(tbl: Tbl, col, into: Sequence, sep: str | int | Sequence[int] = r"[^0-9A-Za-z]+", remove: bool = True, convert=False, extra: str = "drop", fill: str = "right") -> Tbl:
    """One column to several: by regex, or at positions (negative from the end)."""
    name = resolve(tbl, [col])[0]
    x = quoted(name)
    into = list(into)
    if isinstance(sep, int) or (isinstance(sep, (list, tuple)) and all(isinstance(s, int) for s in sep)):
        cuts = [sep] if isinstance(sep, int) else list(sep)
        n = F.char_length(x)
        at = [F.lit(0), *(F.least(n, F.greatest(F.lit(0), n + s if s < 0 else F.lit(s))) for s in cuts), n]
        pieces = [F.substring(x, a + 1, F.greatest(b - a, F.lit(0))) for a, b in zip(at, at[1:])]
        pieces += [F.lit(None).cast("string")] * (len(into) - len(pieces))
    else:
        parts = F.split(x, sep, len(into) if extra == "merge" else -1)
        shift = F.greatest(F.lit(0), F.lit(len(into)) - F.size(parts)) if fill == "left" else F.lit(0)
        pieces = [F.when(F.lit(i) - shift >= 0, F.get(parts, F.lit(i) - shift)) if fill == "left" else F.get(parts, F.lit(i)) for i in range(len(into))]
    keep = [quoted(c) for c in tbl.df.columns if not (remove and c == name)]
    df = tbl.df.select(*keep, *(p.alias(n) for p, n in zip(pieces, into) if n is not None))
    return tbl.regroup(_convert(df, [n for n in into if n], convert))


@verb
def separate_rows(tbl: Tbl, *cols, sep: str = r"[^0-9A-Za-z]+", convert=False) -> Tbl:
    names = resolve(tbl, cols)
    df = tbl.df.withColumns({c: F.split(quoted(c), sep, -1) for c in names})
    out = unchop.direct(Tbl(df, tbl.groups, tbl.kind, (), tbl.drop), names)
    return out.with_df(_convert(out.df, names, convert))


@verb
def extract(tbl: Tbl, col, into, regex: str = r"(\w+)", remove: bool = True, convert=False) -> Tbl:
    """Regex groups to columns; no match gives missing values."""
    name = resolve(tbl, [col])[0]
    into = [into] if isinstance(into, str) else list(into)
    if re.compile(regex).groups != len(into):
        raise ValueError("as many groups as names are needed")
    x = quoted(name)
    hit = x.rlike(regex)
    made: dict[str, Column] = {}
    for i, n in enumerate(into, 1):
        if n is not None:
            piece = F.when(hit, F.regexp_extract(x, regex, i))
            made[n] = F.concat(made[n], piece) if n in made else piece
    keep = [quoted(c) for c in tbl.df.columns if not (remove and c == name)]
    return tbl.regroup(_convert(tbl.df.select(*keep, *(c.alias(n) for n, c in made.items())), list(made), convert))


@verb
def unite(tbl: Tbl, new: str, *cols, sep: str = "_", remove: bool = True, na_rm: bool = True) -> Tbl:
    names = resolve(tbl, cols) if cols else tbl.columns
    text = [quoted(c).cast("string") if na_rm else F.coalesce(quoted(c).cast("string"), F.lit("NA")) for c in names]
    made = (F.array(*text) if sep is None else F.concat_ws(sep, *text)).alias(new)
    out = []
    for c in tbl.df.columns:
        if c == names[0]:
            out.append(made)
        if not (remove and c in names):
            out.append(quoted(c))
    return tbl.regroup(tbl.df.select(*out))


@verb
def full_seq(tbl: Tbl, col, period, tol: float = 1e-6) -> Tbl:
    """The regular sequence from the least to the greatest value; irregular values are an error."""
    name = resolve(tbl, [col])[0]
    low, high, n = tbl.df.agg(F.min(quoted(name)), F.max(quoted(name)), F.count(quoted(name))).first()
    offset = F.abs((quoted(name) - F.lit(low)) % F.lit(period))
    if not tbl.df.where(F.least(offset, F.lit(period) - offset) > tol).limit(1).isEmpty():
        raise ValueError("not a regular sequence")
    steps = int((high - low) / period + 0.5 + tol)
    kind = tbl.df.schema[name].dataType
    return Tbl(tbl.df.sparkSession.range(steps + 1).select((F.lit(low) + F.col("id") * F.lit(period)).cast(kind if not isinstance(period, float) else "double").alias(name)))



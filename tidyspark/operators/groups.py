"""Grouping and summarising."""

from __future__ import annotations

from collections.abc import Callable
from copy import copy
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.aggregates import n as n_
from ..functions.aggregates import sum_
from ..functions.quantiles import group_quantiles
from ..plans.expr import AGG, WIN, Expr, Lit, Ref, wrap
from ..plans.select import resolve
from ..plans.tbl import ORDINAL, Ctx, Fct, Tbl, clean, name_of, quoted, sort_column, verb
from .columns import _args, arrange, mutate


class Grouper:
    """Time buckets: ``group_by(Grouper(f.ts, "1 day"))``."""

    def __init__(self, key, freq: str, name: str | None = None):
        self.key, self.freq, self.name = wrap(key), freq, name or name_of(key)


@verb
def group_by(tbl: Tbl, *args, _add: bool = False, _drop: bool | None = None, _sort: bool = False, _dropna: bool = False, **kwargs) -> Tbl:
    """Keys are columns or expressions (computed first).  ``_dropna`` leaves out rows with a missing key; ``_sort`` sets the
    row order to that of the keys."""
    buckets = [a for a in args if isinstance(a, Grouper)]
    args = [a for a in args if not isinstance(a, Grouper)]
    cur = tbl if _add else tbl.ungroup()
    for b in buckets:
        cur = cur.with_df(cur.df.withColumn(b.name, F.window(Ctx(cur, "row").bind(b.key), b.freq)["start"]))
    plain = [a for a in args if isinstance(a, (Ref, str))]
    made = [(k, v) for k, v in _args(tbl, [a for a in args if not isinstance(a, (Ref, str))], kwargs)]
    if made:
        cur = mutate.direct(cur, **dict(made))
    keys = [*(b.name for b in buckets), *(name_of(a) for a in plain), *(k for k, _ in made)]
    gone = [k for k in keys if k not in cur.df.columns]
    if gone:
        raise KeyError(f"no columns {gone}")
    keys = list(dict.fromkeys([*(tbl.groups if _add else ()), *keys]))
    df = cur.df.na.drop("any", subset=keys) if _dropna and keys else cur.df
    order = tuple(sort_column(quoted(k)) for k in keys) if _sort else tbl.order
    return Tbl(df, tuple(keys), "grouped" if keys else "plain", order, tbl.drop if _drop is None else _drop)


@verb
def ungroup(tbl: Tbl, *cols) -> Tbl:
    if not cols:
        return tbl.ungroup()
    if tbl.kind == "rowwise":
        raise ValueError("a rowwise table can't be ungrouped in part")
    left = tuple(g for g in tbl.groups if g not in resolve(tbl, cols))
    return Tbl(tbl.df, left, "grouped" if left else "plain", tbl.order, tbl.drop)


@verb
def rowwise(tbl: Tbl, *labels) -> Tbl:
    """Every row is a group; labels stay in results."""
    if tbl.kind == "grouped" and labels:
        raise ValueError("a grouped table takes no labels in rowwise()")
    return Tbl(tbl.df, tbl.groups if tbl.kind == "grouped" else tuple(resolve(tbl, labels)), "rowwise", tbl.order, tbl.drop)


def _kept(tbl: Tbl, how: str | None, expanded: bool) -> tuple[tuple[str, ...], str]:
    if tbl.kind == "rowwise" and how is None:
        return (tbl.groups, "grouped") if tbl.groups else ((), "plain")
    how = how or ("keep" if expanded else "drop_last")
    if how == "rowwise":
        return tbl.groups, "rowwise"
    left = {"drop": (), "drop_last": tbl.groups[:-1], "keep": tbl.groups}[how]
    return left, "grouped" if left else "plain"


def _summary(tbl: Tbl, args, kwargs) -> tuple[DataFrame, list[str], list[str]]:
    """(frame, result names, those that are arrays to unroll).

    One groupBy computes all aggregates of source columns; expressions that use earlier results follow as projections.
    """
    items = _args(tbl, args, kwargs)
    if tbl.kind == "rowwise":
        ctx = Ctx(tbl, "rowwise")
        cols = [(name, ctx.bind(e if isinstance(e, Expr) else Lit(e))) for name, e in items]
        return tbl.df.select(*(quoted(g) for g in tbl.groups), *(c.alias(n) for n, c in cols)), [n for n, _ in cols], []
    first, later, levels, arrays, done, quantiles = [], [], {}, [], set(), []
    ctx = Ctx(tbl, "agg")
    for name, e in items:
        node = e if isinstance(e, Expr) else Lit(e)
        if isinstance(e, (list, tuple)):
            arrays.append(name)
        hoisted = [] if node.refs() & done else _hoist(node, tbl, len(first) + len(quantiles))
        if node.refs() & done:
            later.append((name, node))
        elif hoisted:
            rest, made = hoisted
            later.append((name, rest))
            for hidden, a in made:
                if _quantile(a, tbl) is not None:
                    quantiles.append((hidden, a))
                else:
                    first.append((hidden, ctx.bind(a)))
        else:
            value = node.bind(ctx)
            if isinstance(value, Fct):
                levels[name], value = value, value.col
            if not node.has(AGG) and node.refs() - set(tbl.groups):
                from ..functions.aggregates import collect

                value = collect(node).build(ctx, value)
                arrays.append(name)
            first.append((name, value))
        done.add(name)
    df = ctx.tbl.df
    keys = [quoted(g) for g in tbl.groups]
    source = df
    if quantiles and not first:
        first.append(("__rows__", F.count(F.lit(1))))
    df = df.groupBy(*keys).agg(*(c.alias(n) for n, c in first)) if first else df.select(*keys).distinct()
    df = _with_quantiles(df, source, tbl.groups, quantiles, ctx)
    post = Ctx(Tbl(df, tbl.groups, "rowwise"), "rowwise")
    for name, node in later:
        df = df.withColumn(name, post.bind(node))
        post = Ctx(Tbl(df, tbl.groups, "rowwise"), "rowwise")
    for name, fc in levels.items():
        df = df.withMetadata(name, {"levels": list(fc.levels), "ordered": fc.ordered})
    names = list(dict.fromkeys(n for n, _ in items))
    used = set().union(*(e.refs() for _, e in items if isinstance(e, Expr))) if items else set()
    names = [n for n in names if not (n.startswith("_") and n in used)]
    arrays += [n for n in names if n not in arrays and isinstance(df.schema[n].dataType, T.ArrayType) and _is_vector(dict(items)[n])]
    return df, names, [a for a in dict.fromkeys(arrays) if a in names]


def _quantile(e, tbl: Tbl):
    """The probabilities of a quantile() or median() of numbers of the table's rows; else nothing."""
    from ..plans.expr import Func

    if not (isinstance(e, Func) and e.kind == AGG and e.name in ("quantile", "median") and len(e.children) == 1) or e.children[0].has(AGG, WIN) or tbl.df.isStreaming:
        return None
    kind = tbl.df.select(Ctx(tbl, "agg").bind(e.children[0]).alias("x")).schema["x"].dataType
    if not isinstance(kind, T.NumericType):
        return None
    probs = 0.5 if e.name == "median" else e.options.get("probs", (0.0, 0.25, 0.5, 0.75, 1.0))
    return float(probs) if isinstance(probs, (int, float)) else [float(p) for p in probs]


def _hoist(node: Expr, tbl: Tbl, at: int) -> tuple[Expr, list[tuple[str, Expr]]] | None:
    """An expression with a quantile, its aggregates put aside as columns of their own; nothing for others."""
    from ..plans.expr import Func

    made: list[tuple[str, Expr]] = []

    def walk(e):
        if not isinstance(e, Expr) or not e.has(AGG):
            return e
        if isinstance(e, Func) and e.kind == AGG:
            made.append((f"__h{at}_{len(made)}__", e))
            return Ref(made[-1][0])
        out = copy(e)
        out.children = tuple(map(walk, e.children))
        return out

    rest = walk(node)
    if not any(_quantile(a, tbl) is not None for _, a in made) or rest.refs() - {n for n, _ in made} - set(tbl.groups):
        return None
    return rest, made


def _with_quantiles(df: DataFrame, source: DataFrame, groups: tuple[str, ...], quantiles: list, ctx: Ctx) -> DataFrame:
    """Adds the quantiles of the source's groups; those of one column are found together."""
    by_column: dict = {}
    for name, e in quantiles:
        x = e.children[0]
        by_column.setdefault(x.name if isinstance(x, Ref) else id(x), (x, {}))[1][name] = _quantile(e, ctx.tbl)
    for x, wanted in by_column.values():
        found = group_quantiles(source, list(groups), ctx.bind(x), wanted)
        found = found.select(*(quoted(g).alias(f"__g{i}__") for i, g in enumerate(groups)), *wanted)
        if groups:
            same = reduce(Column.__and__, [quoted(g).eqNullSafe(F.col(f"__g{i}__")) for i, g in enumerate(groups)])
            df = df.join(found, same, "left").drop(*(f"__g{i}__" for i in range(len(groups))))
        else:
            df = df.crossJoin(F.broadcast(found))
    return df


def _is_vector(e) -> bool:
    from ..plans.expr import Func

    return isinstance(e, Func) and e.name in ("quantile", "which", "rep", "seq", "seq_len", "collect", "c_", "c", "sort", "rev", "unique", "order", "sample", "_grep_values")


def _unroll(df: DataFrame, keys: list[str], names: list[str], arrays: list[str]) -> DataFrame:
    """Arrays of one row become rows side by side; arrays of one element and scalars recycle."""
    size = F.greatest(*(F.size(quoted(a)) for a in arrays), F.lit(0)) if len(arrays) > 1 else F.size(quoted(arrays[0]))
    fit = lambda a: F.when(F.size(quoted(a)) == size, quoted(a)).when(F.size(quoted(a)) == 1, F.array_repeat(F.get(quoted(a), F.lit(0)), size)).otherwise(F.raise_error(F.lit("results of different sizes")))
    others = [c for c in names if c not in arrays]
    zipped = F.arrays_zip(*(fit(a).alias(a) for a in arrays)) if len(arrays) > 1 else F.transform(quoted(arrays[0]), lambda v: F.struct(v.alias(arrays[0])))
    out = df.select(*(quoted(k) for k in keys), *(quoted(o) for o in others), F.explode(zipped).alias("__z__"))
    cols = {a: F.col("__z__").getField(a) for a in arrays}
    return out.select(*(quoted(k) for k in keys), *((cols[c] if c in cols else quoted(c)).alias(c) for c in names))


@verb
def summarise(tbl: Tbl, *args, _groups: str | None = None, **kwargs) -> Tbl:
    """One row a group; later results may use earlier ones; vector results become several rows."""
    df, names, arrays = _summary(tbl, args, kwargs)
    keys = [g for g in tbl.groups if g not in names]
    df = _unroll(df, keys, names, arrays) if arrays else df.select(*(quoted(k) for k in keys), *(quoted(c) for c in names))
    left, kind = _kept(tbl, _groups, bool(arrays))
    if not tbl.drop and len(tbl.groups) == 1 and tbl.levels(tbl.groups[0]):
        g = tbl.groups[0]
        kinds = tbl.df.schema[g].dataType
        grid = tbl.df.sparkSession.createDataFrame([(v,) for v in tbl.levels(g)], T.StructType([T.StructField(g, kinds)]))
        df = grid.join(df, g, "left").select(*df.columns)
    return Tbl(df, left, kind, (), tbl.drop)


summarize = summarise


@verb
def reframe(tbl: Tbl, *args, **kwargs) -> Tbl:
    """Like summarise(), any number of rows a group, never grouped; groups without rows go."""
    df, names, arrays = _summary(tbl, args, kwargs)
    keys = [g for g in tbl.groups if g not in names]
    return Tbl(_unroll(df, keys, names, arrays) if arrays else df.select(*(quoted(k) for k in keys), *(quoted(c) for c in names)))


def _count_name(columns, name: str | None) -> str:
    if name is not None:
        return name
    name = "n"
    while name in columns:
        name += "n"
    return name


@verb
def count(tbl: Tbl, *args, wt=None, sort: bool = False, name: str | None = None, _drop: bool | None = None, **kwargs) -> Tbl:
    made = group_by.direct(tbl, *args, _add=True, _drop=_drop, **kwargs) if args or kwargs else tbl
    name = _count_name(made.groups, name)
    out = summarise.direct(made, _groups="drop", **{name: n_() if wt is None else sum_(wt)})
    if not made.drop:
        out = out.with_df(out.df.withColumn(name, F.coalesce(quoted(name), F.lit(0))))
    out = Tbl(out.df, tbl.groups, tbl.kind, (), tbl.drop)
    from ..functions.windows import desc

    return arrange.direct(out, desc(Ref(name))) if sort else out


@verb
def tally(tbl: Tbl, wt=None, sort: bool = False, name: str | None = None) -> Tbl:
    name = _count_name(tbl.groups, name)
    out = summarise.direct(tbl, **{name: n_() if wt is None else sum_(wt)})
    from ..functions.windows import desc

    return arrange.direct(out, desc(Ref(name))) if sort else out


@verb
def add_count(tbl: Tbl, *args, wt=None, sort: bool = False, name: str = "n", **kwargs) -> Tbl:
    made = group_by.direct(tbl, *args, _add=True, **kwargs) if args or kwargs else tbl
    out = mutate.direct(made, **{name: n_() if wt is None else sum_(wt)})
    from ..functions.windows import desc

    return arrange.direct(out, desc(Ref(name))) if sort else out


@verb
def add_tally(tbl: Tbl, wt=None, sort: bool = False, name: str = "n") -> Tbl:
    return add_count.direct(tbl, wt=wt, sort=sort, name=name)


# ---- introspection: small aggregates ----


@verb
def group_vars(tbl: Tbl) -> list[str]:
    return list(tbl.groups)


@verb
def group_keys(tbl: Tbl) -> Tbl:
    """Keys by first appearance where the table has a row order."""
    keys = [quoted(g) for g in tbl.groups]
    if ORDINAL in tbl.df.columns:
        df = tbl.df.groupBy(*keys).agg(F.min(quoted(ORDINAL)).alias(ORDINAL))
        return Tbl(df)
    return Tbl(tbl.df.select(*keys).distinct())


@verb
def group_data(tbl: Tbl) -> Tbl:
    """Keys and 0-based row positions."""
    t = tbl.ordinal()
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*t.order_columns())) - 1
    df = t.df.withColumn("__p__", pos).groupBy(*(quoted(g) for g in tbl.groups)).agg(F.array_sort(F.collect_list("__p__")).alias("_rows"))
    return Tbl(df)


@verb
def group_rows(tbl: Tbl) -> list[list[int]]:
    return sorted(r["_rows"] for r in group_data.direct(tbl).df.select("_rows").collect())


@verb
def group_indices(tbl: Tbl, name: str = "group_id") -> Tbl:
    from ..functions.windows import cur_group_id

    return mutate.direct(tbl, **{name: cur_group_id()})


@verb
def group_size(tbl: Tbl) -> list[int]:
    return [r[0] for r in tbl.df.groupBy(*(quoted(g) for g in tbl.groups)).count().select("count").collect()]


@verb
def n_groups(tbl: Tbl) -> int:
    return tbl.df.select(*(quoted(g) for g in tbl.groups)).distinct().count() if tbl.groups else 1


@verb
def group_by_drop_default(tbl: Tbl) -> bool:
    return tbl.drop


@verb
def group_trim(tbl: Tbl) -> Tbl:
    """Drop unused levels of factor keys."""
    from ..functions.factors import droplevels

    keys = [g for g in tbl.groups if tbl.levels(g) is not None]
    out = mutate.direct(tbl.ungroup(), **{g: droplevels(Ref(g)) for g in keys})
    return Tbl(out.df, tbl.groups, tbl.kind, tbl.order, tbl.drop)


@verb
def with_groups(tbl: Tbl, groups, func: Callable, *args, **kwargs) -> Tbl:
    """Group for one call."""
    keyed = tbl.ungroup() if groups is None else group_by.direct(tbl, *(groups if isinstance(groups, (list, tuple)) else [groups]))
    out = getattr(func, "direct", func)(keyed, *args, **kwargs)
    return Tbl(out.df, tuple(g for g in tbl.groups if g in out.df.columns), tbl.kind, out.order, tbl.drop)


@verb
def group_modify(tbl: Tbl, fn: Callable, schema: str) -> Tbl:
    """``fn(pandas frame of one group) -> frame`` with the given schema; keys are put in front.

    Each group goes whole to one task: for groups that fit in memory.
    """
    keys = list(tbl.groups)
    if not keys:
        raise ValueError("group_modify() needs groups")
    declared = T._parse_datatype_string(schema)
    if set(declared.names) & set(keys):
        raise ValueError("the result must not contain the keys")
    full = T.StructType([tbl.df.schema[k] for k in keys] + declared.fields)

    def run(key, pdf):
        out = fn(pdf.drop(columns=keys))
        for i, k in enumerate(keys):
            out.insert(i, k, key[i])
        return out

    df = clean(tbl.df, tbl.columns).drop(ORDINAL).groupBy(*keys).applyInPandas(run, full)
    return Tbl(df, tbl.groups, tbl.kind)


@verb
def group_split(tbl: Tbl, *args, _keep: bool = True) -> list[Tbl]:
    """One lazy table a group.  Keys are collected, and each table that is used scans its input once: for few groups, over
    a table that was written or cached."""
    if args:
        tbl = group_by.direct(tbl, *args)
    out = []
    for row in group_keys.direct(tbl).visible().collect():
        cond = F.lit(True)
        for g in tbl.groups:
            cond = cond & quoted(g).eqNullSafe(F.lit(row[g]))
        part = tbl.df.where(cond)
        out.append(Tbl(part if _keep else part.drop(*tbl.groups)))
    return out


@verb
def group_map(tbl: Tbl, fn: Callable, *args, _keep: bool = False, **kwargs) -> list:
    return [fn(t, *args, **kwargs) for t in group_split.direct(tbl, _keep=_keep)]


#: The list forms' names; both verbs give lists already.
group_split.list, group_map.list = group_split, group_map


@verb
def group_walk(tbl: Tbl, fn: Callable, *args, **kwargs) -> None:
    group_map.direct(tbl, fn, *args, **kwargs)


def cur_data():
    """The rows of a group, without keys, as an array of structs."""
    return _cur(False)


def cur_data_all():
    return _cur(True)


def _cur(keys: bool):
    from ..plans.expr import Func

    def build(ctx):
        names = [c for c in ctx.tbl.columns if keys or c not in ctx.tbl.groups]
        return ctx.spread(F.collect_list(F.struct(*(quoted(c) for c in names))))

    return Func("cur_data", build, (), {}, AGG)


def cur_group():
    from ..plans.expr import Func

    return Func("cur_group", lambda ctx: F.struct(*(quoted(g) for g in ctx.tbl.groups)), (), {}, "row")


def cur_group_rows():
    from ..functions.aggregates import collect
    from ..functions.windows import row_number

    return collect(row_number() - 1)


@verb
def table(tbl: Tbl, x, y=None, exclude=None) -> Tbl:
    """One- or two-way counts; missing is ``<NA>``; factor levels without rows count 0."""
    from ..functions.factors import get

    ctx = Ctx(tbl, "row")
    text = lambda fc: F.coalesce(fc.col.cast("string"), F.lit("<NA>"))
    fx = get(ctx, x)
    gone = set() if exclude is None else set(exclude if isinstance(exclude, (list, tuple)) else [exclude])
    spark = tbl.df.sparkSession
    grid = spark.createDataFrame([(str(v),) for v in fx.levels if v not in gone], "x string")
    if y is None:
        counts = tbl.df.groupBy(text(fx).alias("x")).agg(F.count(F.lit(1)).alias("n"))
        out = grid.join(counts, "x", "full").where(~F.col("x").isin(list(map(str, gone))) if gone else F.lit(True))
        return Tbl(out.select(F.col("x").alias(name_of(x)), F.coalesce("n", F.lit(0)).alias("n")))
    fy = get(ctx, y)
    names = [str(v) for v in fy.levels if v not in gone]
    pairs = tbl.df.select(text(fx).alias("x"), text(fy).alias("y"))
    if pairs.where("y = '<NA>'").limit(1).count() and "<NA>" not in gone:
        names.append("<NA>")
    counts = pairs.groupBy("x").pivot("y", names).count()
    out = grid.join(counts, "x", "full")
    return Tbl(out.select(F.col("x").alias(name_of(x)), *(F.coalesce(quoted(v), F.lit(0)).alias(v) for v in names)))


@verb
def tabulate(tbl: Tbl, x, nbins: int) -> Tbl:
    """Counts of 1 .. nbins."""
    v = Ctx(tbl, "row").bind(x)
    counts = tbl.df.groupBy(v.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return Tbl(tbl.df.sparkSession.range(1, nbins + 1).withColumnRenamed("id", "bin").join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n")))


def _col_stat(agg):
    def run(tbl: Tbl, na_rm: bool = False) -> Tbl:
        cols = [c for c in tbl.columns if c not in tbl.groups]
        full = lambda c: agg(quoted(c)) if na_rm or tbl.groups else F.when(F.count(quoted(c)) == F.count(F.lit(1)), agg(quoted(c)))
        return Tbl(tbl.df.groupBy(*(quoted(g) for g in tbl.groups)).agg(*(full(c).alias(c) for c in cols)))

    return verb(run)


col_sums, col_means, col_sds, col_medians = _col_stat(F.sum), _col_stat(F.avg), _col_stat(F.stddev_samp), _col_stat(F.median)


@verb
def cov_matrix(tbl: Tbl) -> Tbl:
    """Covariances of all pairs of columns, per group, in one aggregation."""
    cols = [c for c in tbl.columns if c not in tbl.groups]
    df = tbl.df.groupBy(*(quoted(g) for g in tbl.groups)).agg(*(F.covar_samp(quoted(a), quoted(b)).alias(f"{a}|{b}") for a in cols for b in cols))
    rows = F.array(*(F.struct(F.lit(a).alias("column"), *(quoted(f"{a}|{b}").alias(b) for b in cols)) for a in cols))
    return Tbl(df.select(*(quoted(g) for g in tbl.groups), F.inline(rows)))


@verb
def fct_count(tbl: Tbl, x, sort: bool = False, prop: bool = False) -> Tbl:
    """Counts per level, zero counts and missing values included."""
    from ..functions.factors import get

    fc = get(Ctx(tbl, "row"), x)
    counts = tbl.df.groupBy(fc.col.alias("f")).agg(F.count(F.lit(1)).alias("n"))
    kind = counts.schema["f"].dataType
    grid = tbl.df.sparkSession.createDataFrame([(v,) for v in fc.levels], T.StructType([T.StructField("f", kind)]))
    out = grid.join(counts, grid["f"].eqNullSafe(counts["f"]), "full").select(F.coalesce(grid["f"], counts["f"]).alias("f"), F.coalesce("n", F.lit(0)).alias("n"))
    if prop:
        total = out.agg(F.sum("n").alias("__t__"))
        out = out.crossJoin(F.broadcast(total)).select("f", "n", (F.col("n") / F.col("__t__")).alias("p"))
    out = Tbl(out)
    from ..functions.windows import desc

    return arrange.direct(out, desc(Ref("n"))) if sort else out


@verb
def levels(tbl: Tbl, x) -> list:
    from ..functions.factors import get

    return get(Ctx(tbl, "row"), x).levels


@verb
def fct_unique(tbl: Tbl, x) -> list:
    return levels.direct(tbl, x)



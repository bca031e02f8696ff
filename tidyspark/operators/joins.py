"""Joins, row upserts, set operations, binding.

All joins are null-safe equi-joins (missing keys match), which Spark still plans as hash or sort-merge joins; nest_join
uses plain equality.  The physical strategy is left to Catalyst and AQE.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.expr import Ref
from ..plans.tbl import ORDINAL, Tbl, as_tbl, clean, quoted, verb


def _keys(x: Tbl, y: Tbl, by) -> list[tuple[str, str]]:
    if by is None:
        common = [c for c in x.columns if c in y.columns]
        if not common:
            raise ValueError("no common columns; give by=")
        return [(c, c) for c in common]
    if isinstance(by, dict):
        return [(str(a), str(b)) for a, b in by.items()]
    names = [by] if isinstance(by, (str, Ref)) else list(by)
    names = [n.name if isinstance(n, Ref) else n for n in names]
    return [(n, n) for n in names]


def _sides(x: Tbl, y: Tbl) -> tuple[DataFrame, DataFrame]:
    """Both frames under names that can't clash."""
    left = x.df.select(*(quoted(c).alias(f"x.{c}") for c in x.df.columns))
    right = y.df.select(*(quoted(c).alias(f"y.{c}") for c in y.columns))
    return left, right


def _on(left: DataFrame, right: DataFrame, keys) -> object:
    return reduce(lambda a, b: a & b, (left[f"`x.{a}`"].eqNullSafe(right[f"`y.{b}`"]) for a, b in keys))


def _join(x: Tbl, y, by, suffix, keep, how) -> Tbl:
    y = as_tbl(y)
    if by is not None and not isinstance(by, (str, Ref)) and len(by) == 0:
        keys = []
    else:
        keys = _keys(x, y, by)
    left, right = _sides(x, y)
    df = left.join(right, _on(left, right, keys), how) if keys else left.crossJoin(right)
    ykeys, same = {b for _, b in keys}, {a for a, b in keys if a == b}
    out, ycols = [], [c for c in y.columns if keep or c not in ykeys]
    for c in x.columns:
        col = quoted(f"x.{c}")
        if c in same and not keep and how in ("right", "full"):
            col = F.coalesce(col, quoted(f"y.{c}"))
        name = c + suffix[0] if c in ycols and (keep or c not in same) else c
        out.append(_leveled(x, y, c, col, name) if c in same and not keep else col.alias(name))
    for c in ycols:
        out.append(quoted(f"y.{c}").alias(c + suffix[1] if c in x.columns else c))
    if ORDINAL in x.df.columns:
        out.append(quoted(f"x.{ORDINAL}").alias(ORDINAL))
    return x.regroup(df.select(*out), order=() if how != "left" and how != "inner" else None if not x.order else ())


def _leveled(x: Tbl, y: Tbl, c: str, col, name: str):
    """Factor keys: the union of levels when both sides are factors."""
    a, b = x.levels(c), y.levels(c) if c in y.columns else None
    return col.alias(name, metadata={"levels": list(dict.fromkeys(a + b)), "ordered": False}) if a and b else col.alias(name, metadata={})


def _verb(name, how, doc):
    def run(x: Tbl, y, by=None, suffix=("_x", "_y"), keep: bool = False, copy=None) -> Tbl:
        return _join(x, y, by, suffix, keep, how)

    run.__name__, run.__doc__ = name, doc
    return verb(run)


inner_join = _verb("inner_join", "inner", "Rows with a match.")
left_join = _verb("left_join", "left", "All rows of x.")
right_join = _verb("right_join", "right", "All rows of y.")
full_join = _verb("full_join", "full", "All rows of both.")


def _filtering(name, how, doc):
    def run(x: Tbl, y, by=None, copy=None) -> Tbl:
        y = as_tbl(y)
        keys = _keys(x, y, by)
        left, right = _sides(x, y)
        df = left.join(right.select(*(quoted(f"y.{b}") for _, b in keys)), _on(left, right, keys), how)
        return x.regroup(df.select(*(quoted(f"x.{c}").alias(c, metadata=x.df.schema[c].metadata) for c in x.df.columns)))

    run.__name__, run.__doc__ = name, doc
    return verb(run)


semi_join = _filtering("semi_join", "left_semi", "Rows of x that have a match, each once.")
anti_join = _filtering("anti_join", "left_anti", "Rows of x without a match.")


@verb
def cross_join(x: Tbl, y, suffix=("_x", "_y")) -> Tbl:
    return _join(x.ungroup(), as_tbl(y).ungroup(), [], suffix, False, "cross")


@verb
def nest_join(x: Tbl, y, by=None, keep: bool = False, name: str | None = None) -> Tbl:
    """An array column of the matching rows of y; missing keys never match."""
    y = as_tbl(y)
    keys = _keys(x, y, by)
    name = name or "_y_joined"
    inner = [c for c in y.columns if keep or c not in {b for _, b in keys}]
    nested = y.df.groupBy(*(quoted(b).alias(f"__k{i}") for i, (_, b) in enumerate(keys))).agg(F.collect_list(F.struct(*(quoted(c) for c in inner))).alias(name))
    on = reduce(lambda p, q: p & q, (quoted(a) == F.col(f"__k{i}") for i, (a, _) in enumerate(keys)))
    df = x.df.join(nested, on, "left")
    empty = F.array().cast(nested.schema[name].dataType)
    return x.regroup(df.select(*(quoted(c) for c in x.df.columns), F.coalesce(quoted(name), empty).alias(name)))


# ---- row upserts ----


def _row_keys(x: Tbl, y: Tbl, by) -> list[str]:
    gone = [c for c in y.columns if c not in x.columns]
    if gone:
        raise ValueError(f"y has columns that x lacks: {gone}")
    keys = [y.columns[0]] if by is None else [by] if isinstance(by, str) else list(by)
    missing = [k for k in keys if k not in x.columns or k not in y.columns]
    if missing:
        raise ValueError(f"key columns missing: {missing}")
    return keys


def _like(x: Tbl, y: Tbl) -> DataFrame:
    """y with the columns and types of x."""
    return y.df.select(*((quoted(c) if c in y.columns else F.lit(None)).cast(x.df.schema[c].dataType).alias(c) for c in x.columns))


def _some(df: DataFrame) -> bool:
    return not df.limit(1).isEmpty()


def _unique_keys(y: Tbl, keys: list[str]) -> None:
    if _some(y.df.groupBy(*keys).count().where("count > 1")):
        raise ValueError("keys of y must be unique")


def _union(x: Tbl, more: DataFrame) -> DataFrame:
    return x.df.unionByName(more, allowMissingColumns=True)


@verb
def rows_insert(x: Tbl, y, by=None, conflict: str = "error") -> Tbl:
    y = as_tbl(y)
    keys = _row_keys(x, y, by)
    if conflict == "error" and _some(semi_join.direct(y, x, by=keys).df):
        raise ValueError("rows of y exist in x already")
    new = anti_join.direct(y, x, by=keys) if conflict == "ignore" else y
    return x.regroup(_union(x, _like(x, new)))


@verb
def rows_append(x: Tbl, y) -> Tbl:
    y = as_tbl(y)
    _row_keys(x, y, None)
    return x.regroup(_union(x, _like(x, y)))


def _patched(x: Tbl, y: Tbl, keys: list[str], pick) -> DataFrame:
    left, right = _sides(x, y)
    right = right.withColumn("__hit__", F.lit(True))
    df = left.join(right, _on(left, right, [(k, k) for k in keys]), "left")
    values = [c for c in y.columns if c not in keys]
    cols = [(pick(quoted(f"x.{c}"), quoted(f"y.{c}")).cast(x.df.schema[c].dataType) if c in values else quoted(f"x.{c}")).alias(c) for c in x.columns]
    if ORDINAL in x.df.columns:
        cols.append(quoted(f"x.{ORDINAL}").alias(ORDINAL))
    return df.select(*cols)


def _check_unmatched(x: Tbl, y: Tbl, keys: list[str], unmatched: str) -> None:
    if unmatched == "error" and _some(anti_join.direct(y, x, by=keys).df):
        raise ValueError("rows of y have no match in x")


@verb
def rows_update(x: Tbl, y, by=None, unmatched: str = "error") -> Tbl:
    """Matched rows take the values of y, missing ones as well."""
    y = as_tbl(y)
    keys = _row_keys(x, y, by)
    _unique_keys(y, keys)
    _check_unmatched(x, y, keys, unmatched)
    return x.regroup(_patched(x, y, keys, lambda a, b: F.when(F.col("__hit__"), b).otherwise(a)))


@verb
def rows_patch(x: Tbl, y, by=None, unmatched: str = "error") -> Tbl:
    """Only missing values are filled."""
    y = as_tbl(y)
    keys = _row_keys(x, y, by)
    _unique_keys(y, keys)
    _check_unmatched(x, y, keys, unmatched)
    return x.regroup(_patched(x, y, keys, lambda a, b: F.coalesce(a, b)))


@verb
def rows_upsert(x: Tbl, y, by=None) -> Tbl:
    y = as_tbl(y)
    keys = _row_keys(x, y, by)
    _unique_keys(y, keys)
    updated = _patched(x, y, keys, lambda a, b: F.when(F.col("__hit__"), b).otherwise(a))
    return x.regroup(updated.unionByName(_like(x, anti_join.direct(y, x, by=keys)), allowMissingColumns=True))


@verb
def rows_delete(x: Tbl, y, by=None, unmatched: str = "error") -> Tbl:
    y = as_tbl(y)
    keys = [y.columns[0]] if by is None else [by] if isinstance(by, str) else list(by)
    _check_unmatched(x, y, keys, unmatched)
    return anti_join.direct(x, y, by=keys)


# ---- sets ----


def _aligned(x: Tbl, y) -> tuple[DataFrame, DataFrame]:
    y = as_tbl(y)
    if set(x.columns) != set(y.columns):
        raise ValueError(f"not the same columns: {sorted(set(x.columns) ^ set(y.columns))}")
    return x.df.select(*map(quoted, x.columns)), y.df.select(*map(quoted, x.columns))


@verb
def intersect(x: Tbl, y) -> Tbl:
    a, b = _aligned(x, y)
    return x.regroup(a.intersect(b), order=())


@verb
def union(x: Tbl, y) -> Tbl:
    a, b = _aligned(x, y)
    return x.regroup(a.unionByName(b).distinct(), order=())


@verb
def union_all(x: Tbl, y) -> Tbl:
    a, b = _aligned(x, y)
    return x.regroup(a.unionByName(b), order=())


@verb
def setdiff(x: Tbl, y) -> Tbl:
    a, b = _aligned(x, y)
    return x.regroup(a.subtract(b), order=())


@verb
def symdiff(x: Tbl, y) -> Tbl:
    """Rows of exactly one side: one pass over the union."""
    a, b = _aligned(x, y)
    both = a.withColumn("__s__", F.lit(1)).unionByName(b.withColumn("__s__", F.lit(2)))
    out = both.groupBy(*map(quoted, x.columns)).agg(F.bit_or("__s__").alias("__s__")).where("__s__ <> 3").drop("__s__")
    return x.regroup(out, order=())


@verb
def setequal(x: Tbl, y) -> bool:
    """The same rows with the same multiplicities."""
    a, b = _aligned(x, y)
    both = a.withColumn("__s__", F.lit(1)).unionByName(b.withColumn("__s__", F.lit(-1)))
    return both.groupBy(*map(quoted, x.columns)).agg(F.sum("__s__").alias("__s__")).where("__s__ <> 0").isEmpty()


# ---- binding ----


def bind_rows(*tables, _id: str | None = None, **named) -> Tbl:
    """Rows of all tables; absent columns are missing; ``_id`` holds the 0-based position or the name."""
    from ..sources.tables import tibble

    flat = [t for x in tables for t in (x if isinstance(x, list) else [x])]
    pairs = [(str(i) if named else i, x) for i, x in enumerate(flat)] + list(named.items())
    pairs = [(k, as_tbl(tibble(**x) if isinstance(x, dict) else x)) for k, x in pairs if x is not None]
    first = pairs[0][1]
    out = None
    for k, t in pairs:
        df = t.df.select(*map(quoted, t.columns))
        if _id:
            df = df.select(F.lit(k).alias(_id), *map(quoted, t.columns))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    for c in out.columns:
        levels = [t.levels(c) for _, t in pairs if c in t.columns]
        if levels and all(levels):
            out = out.withMetadata(c, {"levels": list(dict.fromkeys(v for ls in levels for v in ls)), "ordered": False})
    return first.regroup(out, order=())


def bind_cols(*tables, _name_repair: str = "unique") -> Tbl:
    """Columns side by side by row order; shorter tables are padded."""
    tabs = [as_tbl(t).ordinal() for t in tables if t is not None]
    names = repair([c for t in tabs for c in t.columns], _name_repair)
    frames, at = [], 0
    for t in tabs:
        n = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*t.order_columns()))
        new = names[at : at + len(t.columns)]
        at += len(new)
        frames.append(t.df.select(n.alias(ORDINAL), *(quoted(c).alias(m) for c, m in zip(t.columns, new))))
    out = reduce(lambda a, b: a.join(b, ORDINAL, "full"), frames)
    return Tbl(clean(out, names))


def repair(names: list[str], how="check_unique") -> list[str]:
    """Name repair: minimal, unique, check_unique, universal, or a function."""
    if callable(how):
        return list(how(names))
    if how == "minimal":
        return names
    twice = {n for n in names if names.count(n) > 1}
    if how == "check_unique":
        if twice or "" in names:
            raise ValueError(f"names must be unique: {sorted(twice)}")
        return names
    out = [f"{n}__{i}" if n in twice or n == "" else n for i, n in enumerate(names)]
    if how == "universal":
        import re

        out = [re.sub(r"^(\d)", r"_\1", re.sub(r"\W", "_", n)) for n in out]
    return out

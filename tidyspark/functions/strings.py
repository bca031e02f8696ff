"""Strings, type tests and casts."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.expr import function
from ..plans.select import is_numeric_type


def _literal(pattern: str, fixed: bool, ignore_case: bool = False) -> str:
    p = re.escape(pattern) if fixed else pattern
    return f"(?i){p}" if ignore_case else p


def _replacement(repl: str, fixed: bool) -> str:
    """Java's replacement syntax for a \\1-style replacement."""
    if fixed:
        return repl.replace("\\", "\\\\").replace("$", "\\$")
    return re.sub(r"\\(\d)", r"$\1", repl.replace("$", "\\$"))


@function()
def tolower(ctx, x):
    return F.lower(x)


@function()
def toupper(ctx, x):
    return F.upper(x)


@function(raw=True)
def grepl(ctx, pattern, x, ignore_case=False, fixed=False, invert=False):
    hit = F.coalesce(ctx.bind(x).rlike(_literal(pattern, fixed, ignore_case)), F.lit(False))
    return ~hit if invert else hit


@function(raw=True)
def sub(ctx, pattern, replacement, x, ignore_case=False, fixed=False):
    """First match only."""
    flag = "(?is)" if ignore_case else "(?s)"
    p = re.escape(pattern) if fixed else pattern
    shifted = re.sub(r"(?<!\\)\$(\d)", lambda m: f"${int(m[1]) + 1}", _replacement(replacement, fixed)) if not fixed else _replacement(replacement, fixed)
    return F.regexp_replace(ctx.bind(x), f"{flag}^(.*?)(?:{p})", "$1" + shifted)


@function(raw=True)
def gsub(ctx, pattern, replacement, x, ignore_case=False, fixed=False):
    if fixed and not ignore_case:
        return F.replace(ctx.bind(x), F.lit(pattern), F.lit(replacement))
    return F.regexp_replace(ctx.bind(x), _literal(pattern, fixed, ignore_case), _replacement(replacement, fixed))


@function(raw=True)
def chartr(ctx, old, new, x):
    return F.translate(ctx.bind(x), old, new)


def grep(pattern, x, ignore_case=False, value=False, fixed=False, invert=False):
    """0-based positions, or with ``value`` the values, of a group's matches, as an array in row order."""
    from .aggregates import _grep_values, which

    hit = grepl(pattern, x, ignore_case=ignore_case, fixed=fixed, invert=invert)
    return _grep_values(x, hit) if value else which(hit)


@function()
def startswith(ctx, x, prefix):
    return F.startswith(x, prefix)


@function()
def endswith(ctx, x, suffix):
    return F.endswith(x, suffix)


_WIDE = "[\u1100-\u115f\u2e80-\u303e\u3041-\u33ff\u3400-\u4dbf\u4e00-\u9fff\ua000-\ua4cf\uac00-\ud7a3\uf900-\ufaff\ufe30-\ufe6f\uff00-\uff60\uffe0-\uffe6]"


@function()
def nchar(ctx, x, type_="width"):
    """Width counts East Asian wide characters twice; missing counts 2, as its printed form does."""
    if type_ == "bytes":
        n = F.octet_length(x)
    else:
        n = F.char_length(x)
        if type_ == "width":
            n = n + F.regexp_count(x, F.lit(_WIDE))
    return F.coalesce(n, F.lit(2))


@function()
def nzchar(ctx, x, keep_na=False):
    return (x != "") if keep_na else F.coalesce(x != "", F.lit(True))


def _text(c, ctx):
    return F.coalesce(c.cast("string"), F.lit("NA"))


@function()
def _paste_row(ctx, *xs, sep=" "):
    return F.concat_ws(sep, *(_text(x, ctx) for x in xs))


@function("agg", array=lambda ctx, x, sep=" ": F.array_join(x, sep, "NA"))
def _collapse(ctx, x, sep=" "):
    order = ctx.tbl.order_columns() if ctx.tbl.order or "__row__" in ctx.tbl.df.columns else []
    if not order:
        return F.array_join(F.sort_array(ctx.spread(F.collect_list(_text(x, ctx)))), sep)
    items = F.array_sort(ctx.spread(F.collect_list(F.struct(*(o.alias(f"o{i}") if not _sorted(o) else o for i, o in enumerate(order)), _text(x, ctx).alias("v")))))
    return F.array_join(F.transform(items, lambda s: s["v"]), sep)


def _sorted(c) -> bool:
    return "NULLS" in str(c)


def paste(*xs, sep=" ", collapse=None):
    out = _paste_row(*xs, sep=sep)
    return out if collapse is None else _collapse(out, sep=collapse)


def paste0(*xs, sep="", collapse=None):
    return paste(*xs, sep=sep, collapse=collapse)


@function(raw=True)
def sprintf(ctx, fmt, *xs):
    """C-style; a float given to %d is truncated."""
    if not isinstance(fmt, str):
        return F.printf(ctx.bind(fmt), *map(ctx.bind, xs))
    kinds = re.findall(r"%[-+ 0#]*\d*(?:\.\d+)?([a-zA-Z%])", fmt)
    cols, kinds = [], [k for k in kinds if k != "%"]
    for x, k in zip(xs, kinds):
        c = ctx.bind(x)
        cols.append(c.cast("long") if k in "dixXo" else c.cast("double") if k in "feEgG" else c.cast("string"))
    return F.format_string(re.sub(r"(%[-+ 0#]*\d*)i", r"\1d", fmt), *cols)


@function()
def substr(ctx, x, start, stop):
    """From 0, end excluded."""
    return F.substring(x, start + 1, F.greatest(stop - start, F.lit(0)))


@function()
def substring(ctx, x, first, last=None):
    return F.substring(x, first + 1, F.char_length(x) if last is None else F.greatest(last - first, F.lit(0)))


@function(raw=True)
def strsplit(ctx, x, sep, fixed=False):
    return F.split(ctx.bind(x), _literal(sep, fixed), -1)


@function(raw=True)
def strtoi(ctx, x, base=0):
    x = ctx.bind(x)
    if base:
        return F.conv(x, base, 10).cast("long")
    low = F.lower(x)
    return F.when(F.startswith(low, F.lit("0x")), F.conv(F.substring(low, F.lit(3), F.lit(64)), 16, 10)).when(F.startswith(low, F.lit("0b")), F.conv(F.substring(low, F.lit(3), F.lit(64)), 2, 10)).when(F.startswith(low, F.lit("0")), F.conv(low, 8, 10)).otherwise(low).cast("long")


@function()
def trimws(ctx, x, which="both"):
    return {"both": F.trim, "left": F.ltrim, "right": F.rtrim}[which](x)


# ---- type tests: settled on the schema, and usable in where() ----


def _type_test(name, test):
    @function(raw=True, name=name)
    def build(ctx, x):
        probe = ctx.tbl.df.select(ctx.bind(x).alias("x")).schema["x"]
        return F.lit(bool(test(probe.dataType)))

    build.on_type = test
    build.__name__ = name
    return build


is_character = _type_test("is_character", lambda d: isinstance(d, T.StringType))
is_double = _type_test("is_double", lambda d: isinstance(d, (T.DoubleType, T.FloatType)))
is_integer = _type_test("is_integer", lambda d: isinstance(d, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)))
is_logical = _type_test("is_logical", lambda d: isinstance(d, T.BooleanType))
is_numeric = _type_test("is_numeric", is_numeric_type)
is_complex = _type_test("is_complex", lambda d: isinstance(d, T.StructType) and d.names == ["re", "im"])
is_atomic = _type_test("is_atomic", lambda d: not isinstance(d, (T.ArrayType, T.StructType, T.MapType)))
is_null = _type_test("is_null", lambda d: isinstance(d, T.NullType))


@function(raw=True)
def is_factor(ctx, x):
    return F.lit(getattr(x, "name", None) in ctx.tbl.df.columns and ctx.tbl.levels(x.name) is not None)


@function(raw=True)
def is_ordered(ctx, x):
    name = getattr(x, "name", None)
    return F.lit(name in ctx.tbl.df.columns and bool(ctx.tbl.df.schema[name].metadata.get("ordered")))


@function()
def is_na(ctx, x):
    return x.isNull() | F.coalesce(F.isnan(x.try_cast("double")), F.lit(False))


@function()
def is_finite(ctx, x):
    d = x.cast("double")
    return F.coalesce(~F.isnan(d) & (F.abs(d) < float("inf")), F.lit(False))


@function()
def is_infinite(ctx, x):
    return F.coalesce(F.abs(x.cast("double")) == float("inf"), F.lit(False))


@function(raw=True)
def is_element(ctx, x, table):
    """Membership; a missing value is a member where the table has one."""
    x = ctx.bind(x)
    if not isinstance(table, (list, tuple, set, range)):
        return F.array_contains(ctx.bind(table), x)
    values = [v for v in table if v is not None]
    hit = F.coalesce(x.isin(values), F.lit(False)) if values else F.lit(False)
    return hit | x.isNull() if len(values) < len(list(table)) else hit


def _cast(name, kind):
    @function(name=name)
    def build(ctx, x):
        return x.cast(kind)

    build.__name__ = name
    return build


as_character, as_double, as_numeric, as_logical = _cast("as_character", "string"), _cast("as_double", "double"), _cast("as_numeric", "double"), _cast("as_logical", "boolean")


@function(raw=True)
def as_integer(ctx, x):
    """Of a factor: the 0-based level code."""
    name = getattr(x, "name", None)
    levels = ctx.tbl.levels(name) if name in ctx.tbl.df.columns else None
    col = ctx.bind(x)
    if levels is not None:
        code = F.array_position(F.array(*map(F.lit, levels)), col) - 1
        return F.when(code >= 0, code).cast("int")
    return col.cast("long")


@function(raw=True)
def as_date(ctx, x, format=None, try_formats=("%Y-%m-%d", "%Y/%m/%d"), origin="1970-01-01"):
    """Numbers are days since ``origin``."""
    col = ctx.bind(x)
    kind = ctx.tbl.df.select(col.alias("x")).schema["x"].dataType
    if isinstance(kind, T.StringType):
        formats = [format] if format else list(try_formats)
        return F.coalesce(*(F.try_to_date(col, _java_format(p)) for p in formats))
    if is_numeric_type(kind):
        return F.date_add(F.to_date(F.lit(origin)), col.cast("int"))
    return col.cast("date")


@function(raw=True)
def as_pd_date(ctx, x, format=None):
    col = ctx.bind(x)
    return F.try_to_timestamp(col, F.lit(_java_format(format))) if format else col.try_cast("timestamp_ntz")


def _java_format(p: str) -> str:
    table = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%b": "MMM", "%B": "MMMM", "%j": "DDD"}
    return re.sub(r"%[A-Za-z]", lambda m: table[m[0]], p)


class _Accessor:
    """``pd_dt(f.x).year`` and the like: the common accessor names as columns."""

    def __init__(self, x, table):
        self._x, self._table = x, table

    def __getattr__(self, name):
        if name not in self._table:
            raise AttributeError(name)
        build = self._table[name]
        if getattr(build, "method", False):
            return lambda *a: function(name=name)(lambda ctx, x: build(x, *a))(self._x)
        return function(name=name)(lambda ctx, x: build(x))(self._x)


def _method(fn):
    fn.method = True
    return fn


_DT = {"year": F.year, "month": F.month, "day": F.day, "hour": F.hour, "minute": F.minute, "second": F.second, "quarter": F.quarter, "dayofyear": F.dayofyear, "dayofweek": F.weekday, "weekday": F.weekday, "date": F.to_date, "days_in_month": lambda x: F.day(F.last_day(x))}
_STR = {
    "lower": _method(lambda x: F.lower(x)), "upper": _method(lambda x: F.upper(x)), "strip": _method(lambda x: F.trim(x)), "len": _method(lambda x: F.char_length(x)), "title": _method(lambda x: F.initcap(x)),
    "contains": _method(lambda x, p: x.rlike(p)), "startswith": _method(lambda x, p: F.startswith(x, F.lit(p))), "endswith": _method(lambda x, p: F.endswith(x, F.lit(p))), "replace": _method(lambda x, a, b: F.replace(x, F.lit(a), F.lit(b))),
    "slice": _method(lambda x, a, b: F.substring(x, a + 1, b - a)), "split": _method(lambda x, p: F.split(x, re.escape(p), -1)), "zfill": _method(lambda x, n: F.lpad(x, n, "0")),
}


def pd_dt(x):
    return _Accessor(x, _DT)


def pd_str(x):
    return _Accessor(x, _STR)


def pd_cat(x):
    """Factor accessors: ``codes`` (0-based, -1 for missing), ``categories`` and ``ordered``."""
    from .factors import get

    table = {
        "codes": lambda ctx, x: F.when(get(ctx, x).col.isNull(), F.lit(-1)).otherwise(F.coalesce(F.array_position(F.array(*map(F.lit, get(ctx, x).levels)), get(ctx, x).col), F.lit(0)) - 1),
        "categories": lambda ctx, x: F.array(*map(F.lit, get(ctx, x).levels)),
        "ordered": lambda ctx, x: F.lit(get(ctx, x).ordered),
    }

    class _Categories:
        def __getattr__(self, name):
            if name not in table:
                raise AttributeError(name)
            return function(raw=True, name=name)(table[name])(x)

    return _Categories()


def attrgetter(x, attr: str):
    return getattr(_Accessor(x, _STR | _DT), attr)

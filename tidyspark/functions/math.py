"""Elementwise mathematics; all of it stays in generated code except the special functions (Arrow batches)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..plans.expr import function
from ..session import ship_package


def _plain(name, build):
    build.__name__ = name
    return function()(build)


def _unary(name, fn, domain=None):
    # outside a function's domain the result is missing, not NaN
    def build(ctx, x):
        x = x.cast("double")
        return fn(x) if domain is None else F.when(domain(x), fn(x))

    return _plain(name, build)


ceiling = _plain("ceiling", lambda ctx, x: F.ceil(x))
floor = _plain("floor", lambda ctx, x: F.floor(x))
abs_ = _plain("abs", lambda ctx, x: F.abs(x))
sign = _plain("sign", lambda ctx, x: F.signum(x))
sqrt = _unary("sqrt", F.sqrt, lambda x: x >= 0)
exp = _unary("exp", F.exp)
log2 = _unary("log2", F.log2, lambda x: x > 0)
log10 = _unary("log10", F.log10, lambda x: x > 0)
log1p = _unary("log1p", F.log1p, lambda x: x > -1)
sin, cos, tan = _unary("sin", F.sin), _unary("cos", F.cos), _unary("tan", F.tan)
asin, acos = _unary("asin", F.asin, lambda x: F.abs(x) <= 1), _unary("acos", F.acos, lambda x: F.abs(x) <= 1)
atan, sinh, cosh, tanh = _unary("atan", F.atan), _unary("sinh", F.sinh), _unary("cosh", F.cosh), _unary("tanh", F.tanh)
asinh, acosh, atanh = _unary("asinh", F.asinh), _unary("acosh", F.acosh, lambda x: x >= 1), _unary("atanh", F.atanh, lambda x: F.abs(x) < 1)
sinpi, cospi, tanpi = _unary("sinpi", lambda x: F.sin(x * F.pi())), _unary("cospi", lambda x: F.cos(x * F.pi())), _unary("tanpi", lambda x: F.tan(x * F.pi()))
atan2 = _plain("atan2", lambda ctx, y, x: F.atan2(y, x))
trunc = _plain("trunc", lambda ctx, x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)))


@function()
def round_(ctx, x, digits=0):
    """Half to even."""
    return F.bround(x, digits)


@function()
def log(ctx, x, base=math.e):
    return F.when(x > 0, F.ln(x) / F.ln(base if not isinstance(base, (int, float)) else F.lit(float(base))))


@function()
def signif(ctx, x, digits=6):
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * scale) / scale)


def _special(name, fn, arity=1):
    """A function Spark lacks, on Arrow batches."""

    def build(ctx, *args):
        ship_package(ctx.tbl.df.sparkSession)

        def run(*cols: pd.Series) -> pd.Series:
            return pd.Series([None if any(v is None or v != v for v in vs) else fn(*vs) for vs in zip(*cols)], dtype="float64")

        if arity == 1:
            udf = F.pandas_udf(lambda a: run(a), "double")
        else:
            udf = F.pandas_udf(lambda a, b: run(a, b), "double")
        return udf(*(a.cast("double") for a in args))

    return _plain(name, build)


def _lgamma(x):
    return math.inf if x <= 0 and x == int(x) else math.lgamma(x)


def _gamma(x):
    try:
        return math.gamma(x)
    except (ValueError, OverflowError):
        return math.nan if x <= 0 else math.inf


def _polygamma(x, deriv):
    """Recurrence up to 12, then the asymptotic series, for the order-th derivative of digamma."""
    n = int(deriv)
    bernoulli = (1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66, -691 / 2730, 7 / 6)
    total = 0.0
    if x <= 0 and x == int(x):
        return math.nan
    s = (-1) ** (n + 1)
    while x < 12:
        total += -1 / x if n == 0 else s * math.factorial(n) / x ** (n + 1)
        x += 1
    if n == 0:
        return total + math.log(x) - 1 / (2 * x) - sum(b / (2 * k * x ** (2 * k)) for k, b in enumerate(bernoulli, 1))
    tail = math.factorial(n - 1) / x**n + math.factorial(n) / (2 * x ** (n + 1))
    tail += sum(b * math.factorial(2 * k + n - 1) / (math.factorial(2 * k) * x ** (2 * k + n)) for k, b in enumerate(bernoulli, 1))
    return total + s * tail


def _lbeta(a, b):
    return _lgamma(a) + _lgamma(b) - _lgamma(a + b)


def _choose(n, k):
    k = round(k)
    if k < 0:
        return 0.0
    out = 1.0
    for i in range(k):
        out *= (n - i) / (i + 1)
    return round(out) if n == int(n) and abs(out) < 2**53 else out


gamma, lgamma = _special("gamma", _gamma), _special("lgamma", _lgamma)
digamma, trigamma = _special("digamma", lambda x: _polygamma(x, 0)), _special("trigamma", lambda x: _polygamma(x, 1))
psigamma = _special("psigamma", _polygamma, 2)
beta, lbeta = _special("beta", lambda a, b: math.exp(_lbeta(a, b)), 2), _special("lbeta", _lbeta, 2)
choose, lchoose = _special("choose", _choose, 2), _special("lchoose", lambda n, k: math.log(abs(_choose(n, k))), 2)
factorial, lfactorial = _special("factorial", lambda x: _gamma(x + 1)), _special("lfactorial", lambda x: _lgamma(x + 1))


def _integral(fn, end: float, n: int = 2000):
    """Simpson's rule from 0 to ``end``; ``fn`` takes a column of points and gives a row for each."""
    t = np.linspace(0.0, end, n + 1)[:, None]
    w = np.full((n + 1, 1), 2.0)
    w[1::2], w[0], w[-1] = 4.0, 1.0, 1.0
    return (fn(t) * w).sum(axis=0) * (end / n / 3)


def _bessel_j(x, v):
    out = _integral(lambda t: np.cos(v * t - x * np.sin(t)), np.pi) / np.pi
    return out - np.where(v == np.floor(v), 0.0, np.sin(v * np.pi) / np.pi * _integral(lambda t: np.exp(-x * np.sinh(t) - v * t), 12.0))


def _bessel_y(x, v):
    out = _integral(lambda t: np.sin(x * np.sin(t) - v * t), np.pi) / np.pi
    return out - _integral(lambda t: (np.exp(v * t) + np.exp(-v * t) * np.cos(v * np.pi)) * np.exp(-x * np.sinh(t)), 12.0) / np.pi


def _bessel_i(x, v):
    out = _integral(lambda t: np.exp(x * np.cos(t)) * np.cos(v * t), np.pi) / np.pi
    return out - np.where(v == np.floor(v), 0.0, np.sin(v * np.pi) / np.pi * _integral(lambda t: np.exp(-x * np.cosh(t) - v * t), 12.0))


def _bessel_k(x, v):
    return _integral(lambda t: np.exp(-x * np.cosh(t)) * np.cosh(v * t), 12.0)


def _batched(name, fn, rows: int = 1000):
    """A numpy function of two columns, on Arrow batches, some rows at once."""

    def build(ctx, x, v):
        ship_package(ctx.tbl.df.sparkSession)

        def run(x: pd.Series, v: pd.Series) -> pd.Series:
            a, b = x.to_numpy(dtype="float64"), v.to_numpy(dtype="float64")
            with np.errstate(all="ignore"):
                parts = [fn(a[i : i + rows], b[i : i + rows]) for i in range(0, len(a), rows)]
            out = np.concatenate(parts) if parts else np.empty(0)
            return pd.Series(out, dtype=object).where(~np.isnan(out), None).astype("Float64")

        return F.pandas_udf(lambda a, b: run(a, b), "double")(x.cast("double"), v.cast("double"))

    return _plain(name, build)


bessel_i, bessel_j, bessel_k, bessel_y = _batched("bessel_i", _bessel_i), _batched("bessel_j", _bessel_j), _batched("bessel_k", _bessel_k), _batched("bessel_y", _bessel_y)

# complex numbers are struct(re, im)


@function()
def as_complex(ctx, re, im=None):
    return F.struct(re.cast("double").alias("re"), (F.lit(0.0) if im is None else im.cast("double")).alias("im"))


re_ = _plain("re", lambda ctx, z: z["re"])
im = _plain("im", lambda ctx, z: z["im"])
mod = _plain("mod", lambda ctx, z: F.hypot(z["re"], z["im"]))
arg = _plain("arg", lambda ctx, z: F.atan2(z["im"], z["re"]))
conj = _plain("conj", lambda ctx, z: F.struct(z["re"].alias("re"), (-z["im"]).alias("im")))


# random draws; the seed makes them repeatable for one layout of the data
_seed = [42]


def set_seed(seed: int) -> None:
    _seed[0] = seed


def _draw() -> int:
    _seed[0] += 1
    return _seed[0]


def _positive_rand():
    return F.lit(1.0) - F.rand(_draw())


def _random(name, make):
    def build(ctx, n, *params):
        return make(*params)

    return _plain(name, build)


runif = _random("runif", lambda low=0.0, high=1.0: low + (high - low) * F.rand(_draw()))
rnorm = _random("rnorm", lambda mean=0.0, sd=1.0: F.randn(_draw()) * sd + mean)
rexp = _random("rexp", lambda rate=1.0: -F.ln(_positive_rand()) / rate)
rcauchy = _random("rcauchy", lambda location=0.0, scale=1.0: F.tan(F.pi() * (F.rand(_draw()) - 0.5)) * scale + location)


def _numpy_draw(name, method):
    def build(ctx, n, *params):
        seed = _draw()

        def run(u, *p):
            rng = np.random.default_rng([seed, int(float(u.iloc[0]) * 2**52) if len(u) else 0])
            values = [x.to_numpy() for x in p]
            if method == "binomial":  # the number of trials is whole
                values[0] = values[0].astype(np.int64)
            return pd.Series(getattr(rng, method)(*values, size=len(u)), dtype="float64")

        udf = F.pandas_udf((lambda u, a: run(u, a)) if len(params) == 1 else (lambda u, a, b: run(u, a, b)), "double")
        return udf(F.rand(seed), *(p.cast("double") for p in params))

    return _plain(name, build)


rbinom, rpois, rchisq = _numpy_draw("rbinom", "binomial"), _numpy_draw("rpois", "poisson"), _numpy_draw("rchisq", "chisquare")

pi, NA, Inf = math.pi, None, math.inf
letters = [chr(97 + i) for i in range(26)]
LETTERS = [x.upper() for x in letters]

"""Mathematical functions whose results differ from, or are missing among, Spark's own."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as K


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def div(a, b) -> Column:
    """Integer division that truncates towards zero."""
    return _div(_c(a), _c(b))


def _div(a: Column, b: Column) -> Column:
    return ((a - a % b) / b).cast("long")


def gcd(a, b) -> Column:
    """Greatest common divisor by Euclid; never negative."""
    pair = F.struct(_c(a).cast("long").alias("a"), _c(b).cast("long").alias("b"))
    # two steps halve the remainder, so 100 steps are enough for 64 bits
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.nullif(s["b"], F.lit(0))).alias("b")))
    return F.abs(F.aggregate(F.sequence(F.lit(1), F.lit(100)), pair, step, lambda s: s["a"]))


def lcm(a, b) -> Column:
    a, b = _c(a).cast("long"), _c(b).cast("long")
    return F.coalesce(F.abs(a * _div(b, F.nullif(gcd(a, b), F.lit(0)))), F.when(a.isNotNull() & b.isNotNull(), F.lit(0)))


def round_float(x) -> Column:
    """Half to even, as for binary floats."""
    return F.rint(_c(x))


def round_numeric(x, d: int = 0) -> Column:
    """Half away from zero, as for decimals."""
    return F.round(_c(x), d)


def trunc_to(x, d: int = 0) -> Column:
    return F.signum(_c(x)) * F.floor(F.abs(_c(x)) * 10.0**d) / 10.0**d


def log_base10(x) -> Column:
    return F.log10(_c(x))


def log_base(b, x) -> Column:
    return F.log(_c(x)) / F.log(_c(b))


def degrees_of(f, x) -> Column:
    """``sind``, ``cosd`` and so on: ``f`` of an angle in degrees."""
    return f(F.radians(_c(x)))


def width_bucket(x, low: float, high: float, n: int) -> Column:
    x = _c(x)
    return F.when(x < low, 0).when(x >= high, n + 1).otherwise(F.floor((x - low) * n / (high - low)).cast("int") + 1)


def scale_of(x) -> Column:
    """Digits after the point of a decimal's text."""
    return F.length(F.regexp_extract(_c(x).cast("string"), r"\.(\d+)$", 1))


def min_scale(x) -> Column:
    return F.length(F.regexp_extract(_c(x).cast("string"), r"\.(\d*[1-9])0*$", 1))


def trim_scale(x) -> Column:
    return F.regexp_replace(F.regexp_replace(_c(x).cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


@F.pandas_udf(K.DoubleType())
def erf(x: pd.Series) -> pd.Series:
    return x.map(math.erf, na_action="ignore")


def random_normal(mean: float, sd: float, seed: int) -> Column:
    return F.randn(seed) * sd + mean


def sum_wide(x) -> Column:
    """A sum of longs that can't overflow."""
    return F.sum(_c(x).cast("decimal(38,0)"))

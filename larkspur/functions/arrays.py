"""Array functions, 1-based and null-keeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def position(a, v) -> Column:
    """Place of the first ``v``; null if there is none."""
    return F.nullif(F.array_position(_c(a), v), F.lit(0).cast("long"))


def positions(a, v) -> Column:
    a = _c(a)
    return F.filter(F.transform(F.sequence(F.lit(1), F.size(a)), lambda i: F.when(F.element_at(a, i).eqNullSafe(F.lit(v)), i)), lambda i: i.isNotNull())


def contains(a, b) -> Column:
    """``a @> b``."""
    a = _c(a)
    return F.forall(_c(b), lambda x: F.coalesce(F.array_contains(a, x), F.lit(False)))


def overlap(a, b) -> Column:
    return F.coalesce(F.arrays_overlap(_c(a), _c(b)), F.lit(False))


def replace(a, old, new) -> Column:
    return F.transform(_c(a), lambda x: F.when(x.eqNullSafe(old if isinstance(old, Column) else F.lit(old)), F.lit(new)).otherwise(x))


def fill(v, n: int) -> Column:
    return F.array_repeat(F.lit(v), n)


def trim(a, n: int) -> Column:
    a = _c(a)
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - n, F.lit(0)))


def part(a, lo: int, hi: int) -> Column:
    """``a[lo:hi]``."""
    return F.slice(_c(a), lo, max(hi - lo + 1, 0))


def subscripts(a) -> Column:
    a = _c(a)
    return F.when(F.size(a) > 0, F.sequence(F.lit(1), F.size(a))).otherwise(F.array().cast("array<int>"))


def in_any(v, a) -> Column:
    """``v = ANY(a)``: null if it is not found and the array holds a null."""
    v = _c(v)
    return F.exists(_c(a), lambda x: x == v)


def all_of(v, a, op) -> Column:
    """``v op ALL(a)``."""
    v = _c(v)
    return F.forall(_c(a), lambda x: op(v, x))


def collect(x, *order) -> Column:
    """``array_agg(x ORDER BY …)`` with nulls kept."""
    x = _c(x)
    keyed = F.array_sort(F.collect_list(F.struct(*[_c(o).alias(f"k{i}") for i, o in enumerate(order)], x.alias("v"))))
    return F.transform(keyed, lambda s: s["v"])


def shuffle(a, seed: int) -> Column:
    return F.shuffle(_c(a), seed)


def sample(a, n: int, seed: int) -> Column:
    return F.slice(F.shuffle(_c(a), seed), 1, n)


def symmetric_difference(a, b) -> Column:
    return F.array_union(F.array_except(_c(a), _c(b)), F.array_except(_c(b), _c(a)))


def int_array_aggregate(x) -> Column:
    """All integers of a group in one array, nulls left out."""
    return F.collect_list(F.col(x).cast("int") if isinstance(x, str) else x.cast("int"))


def int_array_enum(df: DataFrame, array: str, name: str) -> DataFrame:
    """A row for each element of an integer array."""
    return df.select("*", F.explode(array).alias(name))

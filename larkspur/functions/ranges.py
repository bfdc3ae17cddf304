"""Ranges as structs ``(lo, hi, lo_inc, hi_inc, empty)``; a null bound is infinite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def make(lo, hi, bounds: str = "[)") -> Column:
    lo, hi = _c(lo), _c(hi)
    inc = F.lit(bounds[0] == "["), F.lit(bounds[1] == "]")
    empty = F.coalesce((lo > hi) | ((lo == hi) & F.lit(bounds != "[]")), F.lit(False))
    return F.struct(lo.alias("lo"), hi.alias("hi"), inc[0].alias("lo_inc"), inc[1].alias("hi_inc"), empty.alias("empty"))


def contains(r, v) -> Column:
    """``r @> value``."""
    r, v = _c(r), _c(v)
    low = r["lo"].isNull() | (v > r["lo"]) | ((v == r["lo"]) & r["lo_inc"])
    high = r["hi"].isNull() | (v < r["hi"]) | ((v == r["hi"]) & r["hi_inc"])
    return ~r["empty"] & low & high


def before(a, b) -> Column:
    """``a << b``: all of ``a`` lies left of ``b``."""
    a, b = _c(a), _c(b)
    return ~a["empty"] & ~b["empty"] & F.coalesce((a["hi"] < b["lo"]) | ((a["hi"] == b["lo"]) & ~(a["hi_inc"] & b["lo_inc"])), F.lit(False))


def after(a, b) -> Column:
    return before(b, a)


def overlaps(a, b) -> Column:
    a, b = _c(a), _c(b)
    return ~a["empty"] & ~b["empty"] & ~before(a, b) & ~before(b, a)


def contains_range(a, b) -> Column:
    a, b = _c(a), _c(b)
    low = a["lo"].isNull() | F.coalesce((b["lo"] > a["lo"]) | ((b["lo"] == a["lo"]) & (a["lo_inc"] | ~b["lo_inc"])), F.lit(False))
    high = a["hi"].isNull() | F.coalesce((b["hi"] < a["hi"]) | ((b["hi"] == a["hi"]) & (a["hi_inc"] | ~b["hi_inc"])), F.lit(False))
    return b["empty"] | (~a["empty"] & low & high)


def adjacent(a, b) -> Column:
    a, b = _c(a), _c(b)
    touch = lambda x, y: F.coalesce((x["hi"] == y["lo"]) & (x["hi_inc"] != y["lo_inc"]), F.lit(False))
    return ~a["empty"] & ~b["empty"] & (touch(a, b) | touch(b, a))


def intersect(a, b) -> Column:
    a, b = _c(a), _c(b)
    lo, hi = F.greatest(a["lo"], b["lo"]), F.least(a["hi"], b["hi"])
    lo_inc = F.when(a["lo"].eqNullSafe(b["lo"]), a["lo_inc"] & b["lo_inc"]).otherwise(F.when(a["lo"].eqNullSafe(lo), a["lo_inc"]).otherwise(b["lo_inc"]))
    hi_inc = F.when(a["hi"].eqNullSafe(b["hi"]), a["hi_inc"] & b["hi_inc"]).otherwise(F.when(a["hi"].eqNullSafe(hi), a["hi_inc"]).otherwise(b["hi_inc"]))
    return F.struct(lo.alias("lo"), hi.alias("hi"), lo_inc.alias("lo_inc"), hi_inc.alias("hi_inc"), (~overlaps(a, b)).alias("empty"))


def span(a, b) -> Column:
    """``range_merge``: the smallest range that holds both."""
    a, b = _c(a), _c(b)
    lo = F.when(a["lo"].isNotNull() & b["lo"].isNotNull(), F.least(a["lo"], b["lo"]))
    hi = F.when(a["hi"].isNotNull() & b["hi"].isNotNull(), F.greatest(a["hi"], b["hi"]))
    lo_inc = F.when(a["lo"].eqNullSafe(b["lo"]), a["lo_inc"] | b["lo_inc"]).otherwise(F.when(a["lo"].eqNullSafe(lo), a["lo_inc"]).otherwise(b["lo_inc"]))
    hi_inc = F.when(a["hi"].eqNullSafe(b["hi"]), a["hi_inc"] | b["hi_inc"]).otherwise(F.when(a["hi"].eqNullSafe(hi), a["hi_inc"]).otherwise(b["hi_inc"]))
    return F.when(a["empty"], b).when(b["empty"], a).otherwise(F.struct(lo.alias("lo"), hi.alias("hi"), lo_inc.alias("lo_inc"), hi_inc.alias("hi_inc"), F.lit(False).alias("empty")))


def agg(df: DataFrame, keys: list[str], lo: str, hi: str) -> DataFrame:
    """``range_agg`` of half-open ranges: the islands of each key, in one sort by key and start."""
    w = Window.partitionBy(*keys).orderBy(lo, hi)
    reach = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.where(F.col(lo) < F.col(hi)).withColumn("_new", F.when(reach.isNull() | (F.col(lo) > reach), 1).otherwise(0))
    marked = marked.withColumn("_island", F.sum("_new").over(w))
    return marked.groupBy(*keys, "_island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("_island")


def minus(a, b) -> Column:
    """``a - b`` as an array of none, one or two ranges (a multirange)."""
    a, b = _c(a), _c(b)
    low = F.struct(a["lo"].alias("lo"), b["lo"].alias("hi"), a["lo_inc"].alias("lo_inc"), (~b["lo_inc"]).alias("hi_inc"), F.lit(False).alias("empty"))
    high = F.struct(b["hi"].alias("lo"), a["hi"].alias("hi"), (~b["hi_inc"]).alias("lo_inc"), a["hi_inc"].alias("hi_inc"), F.lit(False).alias("empty"))
    solid = lambda r: r["lo"].isNull() | r["hi"].isNull() | F.coalesce((r["lo"] < r["hi"]) | ((r["lo"] == r["hi"]) & r["lo_inc"] & r["hi_inc"]), F.lit(False))
    left = F.when(b["lo"].isNotNull() & solid(low), F.array(low)).otherwise(F.array().cast("array<struct<lo:bigint,hi:bigint,lo_inc:boolean,hi_inc:boolean,empty:boolean>>"))
    right = F.when(b["hi"].isNotNull() & solid(high), F.array(high)).otherwise(F.array().cast("array<struct<lo:bigint,hi:bigint,lo_inc:boolean,hi_inc:boolean,empty:boolean>>"))
    return F.when(~overlaps(a, b), F.array(a)).otherwise(F.concat(left, right))


def multi_contains(ranges, v) -> Column:
    """A multirange holds a value."""
    v = _c(v)
    return F.exists(_c(ranges), lambda r: contains(r, v))


def multi_overlaps(ranges, r) -> Column:
    r = _c(r)
    return F.exists(_c(ranges), lambda x: overlaps(x, r))


def intersect_agg(lo: str, hi: str) -> Column:
    """``range_intersect_agg`` of half-open ranges: null if nothing is common."""
    a, b = F.max(lo), F.min(hi)
    return F.when(a < b, F.struct(a.alias("lo"), b.alias("hi")))

"""Earth distances, vector distances and plane geometry."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The Earth's radius in metres, and metres and nautical constants in use with it.
EARTH, MILES_RADIUS = 6378168.0, 3958.747716


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def sec_to_gc(d) -> Column:
    """Length of a chord to the distance on the sphere."""
    d = _c(d)
    return F.when(d < 0, 0.0).when(d / (2 * EARTH) > 1, math.pi * EARTH).otherwise(2 * EARTH * F.asin(F.least(d / (2 * EARTH), F.lit(1.0))))


def gc_to_sec(d) -> Column:
    d = _c(d)
    return F.when(d < 0, 0.0).when(d / EARTH > math.pi, 2 * EARTH).otherwise(2 * EARTH * F.sin(d / (2 * EARTH)))


def ll_to_earth(lat, lon) -> Column:
    la, lo = F.radians(_c(lat)), F.radians(_c(lon))
    return F.array(EARTH * F.cos(la) * F.cos(lo), EARTH * F.cos(la) * F.sin(lo), EARTH * F.sin(la))


def latitude(e) -> Column:
    return F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.element_at(_c(e), 3) / EARTH))))


def longitude(e) -> Column:
    e = _c(e)
    return F.degrees(F.atan2(F.element_at(e, 2), F.element_at(e, 1)))


def earth_distance(a, b) -> Column:
    return sec_to_gc(l2(a, b))


def geo_distance(lon1, lat1, lon2, lat2) -> Column:
    """Statute miles between two points given in degrees (haversine)."""
    a1, a2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dl = F.radians(_c(lon1) - _c(lon2))
    h = F.pow(F.sin((a1 - a2) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin(dl / 2), 2)
    return 2 * MILES_RADIUS * F.asin(F.least(F.sqrt(h), F.lit(1.0)))


def earth_box(e, radius) -> Column:
    """Corners of the cube around a point that holds all points within ``radius`` metres."""
    d = gc_to_sec(radius)
    return F.struct(F.transform(_c(e), lambda x: x - d).alias("low"), F.transform(_c(e), lambda x: x + d).alias("high"))


def _fold(a, b, each, start=0.0, merge=lambda s, x: s + x) -> Column:
    pairs = F.zip_with(_c(a), _c(b), lambda x, y: each(x.cast("double"), y.cast("double")))
    return F.aggregate(pairs, F.lit(start), merge)


def l2_squared(a, b) -> Column:
    return _fold(a, b, lambda x, y: (x - y) * (x - y))


def l2(a, b) -> Column:
    return F.sqrt(l2_squared(a, b))


def taxicab(a, b) -> Column:
    return _fold(a, b, lambda x, y: F.abs(x - y))


def chebyshev(a, b) -> Column:
    return _fold(a, b, lambda x, y: F.abs(x - y), merge=lambda s, x: F.greatest(s, x))


def dot(a, b) -> Column:
    return _fold(a, b, lambda x, y: x * y)


def cosine(a, b) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def point(x, y) -> Column:
    return F.struct(_c(x).cast("double").alias("x"), _c(y).cast("double").alias("y"))


def distance(p, q) -> Column:
    p, q = _c(p), _c(q)
    return F.hypot(p["x"] - q["x"], p["y"] - q["y"])


def box(p, q) -> Column:
    p, q = _c(p), _c(q)
    return F.struct(F.greatest(p["x"], q["x"]).alias("x2"), F.greatest(p["y"], q["y"]).alias("y2"), F.least(p["x"], q["x"]).alias("x1"), F.least(p["y"], q["y"]).alias("y1"))


def box_area(b) -> Column:
    b = _c(b)
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def box_contains(b, p) -> Column:
    b, p = _c(b), _c(p)
    return p["x"].between(b["x1"], b["x2"]) & p["y"].between(b["y1"], b["y2"])


def circle_area(radius) -> Column:
    return F.lit(math.pi) * _c(radius) * _c(radius)


def polygon_area(points) -> Column:
    """Area of an array of points by the shoelace formula."""
    p = _c(points)
    n = F.size(p)
    terms = F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(p, i)["x"] * F.element_at(p, i % n + 1)["y"] - F.element_at(p, i % n + 1)["x"] * F.element_at(p, i)["y"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)) / 2


def segment_distance(p, a, b) -> Column:
    """From a point to a segment."""
    p, a, b = _c(p), _c(a), _c(b)
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    t = F.coalesce(F.try_divide((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.hypot(p["x"] - a["x"] - t * dx, p["y"] - a["y"] - t * dy)

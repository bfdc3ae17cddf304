"""Dates, times and intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def extract(field: str, ts) -> Column:
    """``EXTRACT`` with Sunday as day 0 and the fields Spark lacks."""
    ts, field = _c(ts), field.lower()
    own = {
        "dow": lambda: F.dayofweek(ts) - 1,
        "isodow": lambda: F.weekday(ts) + 1,
        "epoch": lambda: F.unix_micros(ts.cast("timestamp")) / 1e6,
        "century": lambda: F.ceil(F.year(ts) / 100.0).cast("int"),
        "decade": lambda: F.floor(F.year(ts) / 10.0).cast("int"),
        "millennium": lambda: F.ceil(F.year(ts) / 1000.0).cast("int"),
        "isoyear": lambda: F.extract(F.lit("YEAROFWEEK"), ts),
        "milliseconds": lambda: F.extract(F.lit("SECOND"), ts) * 1000,
        "microseconds": lambda: (F.extract(F.lit("SECOND"), ts) * 1000000).cast("long"),
        "julian": lambda: F.unix_date(ts.cast("date")) + 2440588,
    }
    if field in own:
        return own[field]()
    if field not in {"year", "month", "day", "hour", "minute", "second", "quarter", "week", "doy"}:
        raise ValueError(f"unit {field!r} not recognized")
    return F.extract(F.lit(field.upper()), ts)


def date_minus(a, b) -> Column:
    """Whole days between two dates."""
    return F.datediff(_c(a), _c(b))


def date_bin(seconds: float, ts, origin: str = "2000-01-01") -> Column:
    """The start of ``ts``'s bin, bins counted from ``origin``."""
    us = F.unix_micros(_c(ts).cast("timestamp"))
    base, step = F.unix_micros(F.lit(origin).cast("timestamp")), int(seconds * 1_000_000)
    return F.timestamp_micros(us - F.pmod(us - base, F.lit(step)))


def age(a, b) -> Column:
    """``struct(years, months, days, micros)`` from ``b`` to ``a``; all parts are negative if ``a`` is the earlier."""
    x, y = _c(a).cast("timestamp"), _c(b).cast("timestamp")
    a, b, sign = F.greatest(x, y), F.least(x, y), F.when(x < y, -1).otherwise(1)
    whole = F.floor(F.months_between(a, b, False)).cast("int")
    # a month counts once its day and time of day are reached
    whole = F.when(F.add_months(b.cast("date"), whole).cast("timestamp") + _time_of(b) > a, whole - 1).otherwise(whole)
    anchor = F.add_months(b.cast("date"), whole).cast("timestamp") + _time_of(b)
    us = F.unix_micros(a) - F.unix_micros(anchor)
    day = F.lit(86_400_000_000)
    parts = {"years": ((whole - whole % 12) / 12).cast("int"), "months": whole % 12, "days": F.floor(us / day).cast("int"), "micros": us % day}
    return F.struct(*((v * sign).alias(k) for k, v in parts.items()))


def _time_of(ts: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.hour(ts), F.minute(ts), F.extract(F.lit("SECOND"), ts))


#: Template patterns of ``to_char`` and what they are here; longest first.
PATTERNS = {
    "HH24": "HH", "HH12": "hh", "YYYY": "yyyy", "MONTH": "MMMM", "Month": "MMMM", "DDD": "DDD", "Mon": "MMM", "MON": "MMM", "Day": "EEEE", "DAY": "EEEE", "Dy": "EEE",
    "DY": "EEE", "MI": "mm", "SS": "ss", "MS": "SSS", "US": "SSSSSS", "MM": "MM", "DD": "dd", "HH": "hh", "AM": "a", "PM": "a", "YY": "yy", "Q": "Q", "D": "e",
}


def java_pattern(template: str) -> str:
    out, i, quoted = "", 0, False
    while i < len(template):
        if template[i] == '"':
            end = template.find('"', i + 1)
            end = len(template) if end < 0 else end
            out += "'" + template[i + 1 : end].replace("'", "''") + "'"
            i = end + 1
            continue
        for p in sorted(PATTERNS, key=len, reverse=True):
            if template.startswith(p, i):
                out += PATTERNS[p]
                i += len(p)
                break
        else:
            out += "'" + template[i] + "'" if template[i].isalpha() else template[i]
            i += 1
    return out


def to_char(ts, template: str) -> Column:
    return F.date_format(_c(ts), java_pattern(template))


def to_date(s, template: str) -> Column:
    return F.to_date(_c(s), java_pattern(template))


def at_time_zone(ts, zone: str, aware: bool = False) -> Column:
    """A wall-clock time in ``zone`` as an instant (``aware``: an instant as the wall clock of ``zone``)."""
    return F.from_utc_timestamp(_c(ts), zone) if aware else F.to_utc_timestamp(_c(ts), zone)


def overlaps(a1, a2, b1, b2) -> Column:
    """Whether two half-open periods meet; ends may come in either order."""
    a1, a2, b1, b2 = map(_c, (a1, a2, b1, b2))
    x1, x2, y1, y2 = F.least(a1, a2), F.greatest(a1, a2), F.least(b1, b2), F.greatest(b1, b2)
    return ((x1 < y2) & (y1 < x2)) | (x1 == y1)


def series(start, stop, step: str) -> Column:
    """The array of ``generate_series`` over timestamps; ``step`` like ``interval 1 day``."""
    return F.sequence(_c(start), _c(stop), F.expr(step))


def justify_hours(micros) -> Column:
    day = 86_400_000_000
    m = _c(micros)
    return F.struct(F.floor(m / day).cast("int").alias("days"), (m % day).alias("micros"))


def time_with_zone(text) -> Column:
    """``timetz`` as ``struct(micros, offset_s)``; ``24:00:00`` is a legal time."""
    t = _c(text)
    part = lambda i: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(t, r"^(\d+):(\d+)(?::(\d+))?.*?(?:([+-])(\d+)(?::(\d+))?)?$", i), F.lit("")), F.lit("99")).cast("long"), F.lit(0))
    sign = F.when(F.regexp_extract(t, r"([+-])\d+(?::\d+)?$", 1) == "-", -1).otherwise(1)
    return F.struct(((part(1) * 3600 + part(2) * 60 + part(3)) * 1000000).alias("micros"), (sign * (part(5) * 3600 + part(6) * 60)).cast("int").alias("offset_s"))

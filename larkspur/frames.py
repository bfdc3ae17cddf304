"""Window frames that Spark's parser lacks, as frames it has: GROUPS, and EXCLUDE CURRENT ROW, GROUP and TIES.

A frame is taken apart into pieces that are frames of Spark's own: what lies before the current row's peers, the peers
before it, the row itself, the peers after it, and what lies behind the peers. GROUPS counts peers by their dense rank.
Sums, counts, averages, minima and maxima are put together from their pieces; EXCLUDE drops some of these.
"""

from __future__ import annotations

import re

_CALL = re.compile(r"\b(sum|count|avg|min|max)\s*(?=\()", re.I)
_FRAME = re.compile(r"\b(ROWS|RANGE|GROUPS)\s+(?:BETWEEN\s+(.+?)\s+AND\s+(.+?)|((?:UNBOUNDED|\S+)\s+PRECEDING|CURRENT\s+ROW))\s*(?:\bEXCLUDE\s+(CURRENT\s+ROW|GROUP|TIES|NO\s+OTHERS)\s*)?$", re.I | re.S)


def _closing(s: str, at: int) -> int:
    """The place of the parenthesis that closes the one at ``at``."""
    depth = 0
    for i in range(at, len(s)):
        depth += (s[i] == "(") - (s[i] == ")")
        if not depth:
            return i
    raise ValueError("a parenthesis is not closed")


def _bound(text: str) -> float:
    """A bound as a number: negative before the current row."""
    t = text.upper().split()
    if t[0] == "CURRENT":
        return 0
    n = float("inf") if t[0] == "UNBOUNDED" else int(t[0])
    return -n if t[1] == "PRECEDING" else n


def _text(lo: float, hi: float) -> str:
    one = lambda n: "CURRENT ROW" if n == 0 else f"{'UNBOUNDED' if abs(n) == float('inf') else int(abs(n))} {'PRECEDING' if n < 0 else 'FOLLOWING'}"
    return f"BETWEEN {one(lo)} AND {one(hi)}"


def _join(fn: str, parts: list[str]) -> str:
    """An aggregate of rows from those of their pieces; null for none, as the aggregate itself has it."""
    if not parts:
        return "CAST(0 AS BIGINT)" if fn == "count" else "NULL"
    if fn == "count":
        return "(" + " + ".join(parts) + ")"
    if fn in ("min", "max"):
        return parts[0] if len(parts) == 1 else f"{'least' if fn == 'min' else 'greatest'}({', '.join(parts)})"
    total = " + ".join(f"coalesce({p}, 0)" for p in parts)
    return f"(CASE WHEN coalesce({', '.join(parts)}) IS NOT NULL THEN {total} END)"


def _pieces(fn: str, x: str, keys: str, k: int, kind: str, lo: float, hi: float, exclude: str) -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    peers = f"PARTITION BY {keys + ', ' if keys else ''}_g{k}"
    inf = float("inf")
    over = lambda f, w: f"{f}({x}) OVER ({w})"
    rows = lambda base, a, b: f"{base} ORDER BY _r{k} ROWS {_text(a, b)}"
    groups = lambda a, b: f"{part} ORDER BY _g{k} RANGE {_text(a, b)}"
    if kind == "ROWS":
        if exclude == "CURRENT ROW":
            windows = ([rows(part, lo, min(hi, -1))] if lo < 0 else []) + ([rows(part, max(lo, 1), hi)] if hi > 0 else [])
            return _join(fn, [over(fn, w) for w in windows])
        if exclude in ("GROUP", "TIES"):
            # the rows of the frame that are peers are the same frame among the peers alone
            own = [f"CASE WHEN {x} IS NOT NULL THEN 1 ELSE 0 END" if fn == "count" else x] if exclude == "TIES" and lo <= 0 <= hi else []
            if fn in ("min", "max"):
                held = f"collect_list(struct(_g{k} AS g, {x} AS x)) OVER ({rows(part, lo, hi)})"
                return _join(fn, [f"array_{fn}(transform(filter({held}, _e -> _e.g <> _g{k}), _e -> _e.x))", *own])
            less = f"count({x}) OVER ({rows(part, lo, hi)}) > count({x}) OVER ({rows(peers, lo, hi)})"
            rest = f"{over(fn, rows(part, lo, hi))} - coalesce({over(fn, rows(peers, lo, hi))}, 0)"
            return _join(fn, [f"({rest})" if fn == "count" else f"(CASE WHEN {less} THEN {rest} END)", *own])
        return over(fn, rows(part, lo, hi))
    parts = []
    if lo < 0:
        parts.append(over(fn, groups(lo, min(hi, -1))))
    if hi > 0:
        parts.append(over(fn, groups(max(lo, 1), hi)))
    if lo <= 0 <= hi:
        if exclude in ("CURRENT ROW", "NO OTHERS"):
            parts += [over(fn, rows(peers, -inf, -1)), over(fn, rows(peers, 1, inf))]
        if exclude in ("TIES", "NO OTHERS"):
            parts.append(f"CASE WHEN {x} IS NOT NULL THEN 1 ELSE 0 END" if fn == "count" else x)
    return _join(fn, parts)


def rewrite(sql: str) -> str:
    """``SELECT list FROM source …`` with such frames in its list, over a numbered source. Literals must be hidden already."""
    if not re.search(r"\bGROUPS\s+(?:BETWEEN|UNBOUNDED|CURRENT|\d+\s+PRECEDING)|\bEXCLUDE\s+(?:CURRENT|GROUP|TIES|NO)\b", sql, re.I):
        return sql
    out, at, inner, k = [], 0, [], 0
    for m in _CALL.finditer(sql):
        if m.start() < at:
            continue
        end = _closing(sql, m.end())
        w = re.match(r"\s*OVER\s*\(", sql[end + 1 :], re.I)
        if not w:
            continue
        close = _closing(sql, end + w.end())
        spec = sql[end + 1 + w.end() : close]
        f = _FRAME.search(spec)
        if not f or (f[1].upper() != "GROUPS" and not f[5]):
            continue
        kind, exclude = f[1].upper(), re.sub(r"\s+", " ", (f[5] or "NO OTHERS").upper())
        lo, hi = (_bound(f[2]), _bound(f[3])) if f[2] else (_bound(f[4]), 0)
        if kind == "RANGE" and not (lo in (0, float("-inf")) and hi in (0, float("inf"))):
            raise ValueError("EXCLUDE with a RANGE frame of offsets is not supported")
        head = re.match(r"\s*(?:PARTITION\s+BY\s+(.*?))?\s*(?:\bORDER\s+BY\s+(.*?))?\s*$", spec[: f.start()], re.I | re.S)
        keys, order = (head[1] or "").strip(), (head[2] or "").strip()
        if kind == "GROUPS" and not order:
            raise ValueError("GROUPS mode requires an ORDER BY clause")
        window = f"{'PARTITION BY ' + keys if keys else ''} ORDER BY {order or 'NULL'}"
        inner.append(f"dense_rank() OVER ({window}) AS _g{k}, row_number() OVER ({window}) AS _r{k}")
        fn, x = m[1].lower(), sql[m.end() + 1 : end].strip()
        x = "1" if x == "*" else x
        one = lambda f: _pieces(f, x, keys, k, kind, lo, hi, exclude)  # noqa: B023, E731
        out += [sql[at : m.start()], f"try_divide({one('sum')}, {one('count')})" if fn == "avg" else one(fn)]
        at, k = close + 1, k + 1
    whole = "".join([*out, sql[at:]])
    m = re.fullmatch(r"(\s*SELECT\b.*?)\bFROM\s+(\w+)(?:\s+(?:AS\s+)?(?!WHERE\b|ORDER\b|LIMIT\b)(\w+))?(\s+WHERE\b.*?)?((?:\s+ORDER\s+BY\b(?:(?!\)).)*)?(?:\s+LIMIT\b.*)?)\s*", whole, re.I | re.S)
    if not m or not inner:
        raise ValueError("such a frame is supported over one table, without GROUP BY")
    return f"{m[1]}FROM (SELECT *, {', '.join(inner)} FROM {m[2]}{' AS ' + m[3] if m[3] else ''}{m[4] or ''}) AS {m[3] or m[2]}{m[5]}"

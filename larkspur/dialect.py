"""A SQL front end: statements in the PostgreSQL style, rewritten to Spark SQL, and PREDICT.

Only what Spark's parser rejects or reads differently is rewritten; string literals, quoted names and comments are
left alone. Everything else reaches Catalyst as it is.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import frames
from .functions import strings
from .operators import relational

_QUOTED = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|--[^\n]*|/\*.*?\*/", re.S)


def _hidden(sql: str) -> tuple[str, list[str]]:
    kept: list[str] = []

    def put(m):
        kept.append(m[0])
        return f"\x00{len(kept) - 1}\x00"

    return _QUOTED.sub(put, sql), kept


def _shown(sql: str, kept: list[str]) -> str:
    return re.sub("\x00(\\d+)\x00", lambda m: kept[int(m[1])], sql)


_OPERAND = r"((?:[\w.]+(?:\([^()]*\))?|\x00\d+\x00))"
_LIT = "\x00(\\d+)\x00"


def rewrite(sql: str) -> str:
    """Spark SQL for a statement."""
    s, kept = _hidden(sql.strip().rstrip(";"))
    s = _projected_in(frames.rewrite(s))

    def similar(m):
        body = kept[int(m[3])][1:-1].replace("''", "'")
        kept[int(m[3])] = "'" + strings.similar_to(body).replace("\\", "\\\\").replace("'", "\\'") + "'"
        return f"{'NOT ' if m[2] else ''}rlike({m[1]}, \x00{m[3]}\x00)"

    def matches(m):
        i = int(m[3])
        body = kept[i][1:-1].replace("''", "'").replace(r"\m", r"\b").replace(r"\M", r"\b")
        kept[i] = "'" + ("(?i)" if "*" in m[2] else "") + body.replace("\\", "\\\\") + "'"
        return f"{'NOT ' if '!' in m[2] else ''}rlike({m[1]}, \x00{i}\x00)"

    s = re.sub(_OPERAND + r"\s+(NOT\s+)?SIMILAR\s+TO\s+" + _LIT, similar, s, flags=re.I)
    s = re.sub(_OPERAND + r"\s*(!?~\*?)\s*" + _LIT, matches, s)
    s = re.sub(_OPERAND + r"\s+(NOT\s+)?BETWEEN\s+SYMMETRIC\s+(\S+)\s+AND\s+([^\s)]+)", lambda m: f"{m[1]} {m[2] or ''}BETWEEN least({m[3]}, {m[4]}) AND greatest({m[3]}, {m[4]})", s, flags=re.I)
    s = re.sub(_OPERAND + r"\s*=\s*(?:ANY|SOME)\s*\(\s*(ARRAY\s*\[[^\]]*\]|[\w.]+)\s*\)", lambda m: f"exists({_array(m[2])}, _x -> _x = {m[1]})", s, flags=re.I)
    s = re.sub(_OPERAND + r"\s*(<>|<=|>=|<|>|=)\s*ALL\s*\(\s*(ARRAY\s*\[[^\]]*\]|[\w.]+)\s*\)", lambda m: f"forall({_array(m[3])}, _x -> {m[1]} {m[2]} _x)", s, flags=re.I)
    s = re.sub(r"=\s*(?:ANY|SOME)\s*\(\s*(?=SELECT)", "IN (", s, flags=re.I)
    s = re.sub(_OPERAND + r"\s+AT\s+TIME\s+ZONE\s+" + _LIT, lambda m: f"if(typeof({m[1]}) = 'timestamp', from_utc_timestamp({m[1]}, \x00{m[2]}\x00), to_utc_timestamp({m[1]}, \x00{m[2]}\x00))", s, flags=re.I)
    s = re.sub(r"EXTRACT\s*\(\s*EPOCH\s+FROM\s+([^()]+)\)", r"(unix_micros(CAST(\1 AS TIMESTAMP)) / 1e6D)", s, flags=re.I)
    s = re.sub(r"EXTRACT\s*\(\s*DOW\s+FROM\s+([^()]+)\)", r"(dayofweek(\1) - 1)", s, flags=re.I)
    s = re.sub(r"TABLESAMPLE\s+BERNOULLI\s*\(\s*([\d.]+)\s*\)", r"TABLESAMPLE (\1 PERCENT)", s, flags=re.I)
    s = re.sub(r"\bARRAY\s*\[([^\]]*)\]", r"array(\1)", s, flags=re.I)
    s = re.sub(r"([\w.]+(?:\((?:[^()]|\([^()]*\))*\))?)\[\s*(\w+)\s*:\s*(\w+)\s*\]", r"slice(\1, \2, greatest(0, \3 - \2 + 1))", s, flags=re.I)
    s = re.sub(r"\bunnest\s*(\((?:[^()]|\([^()]*\))*\))\s+WITH\s+ORDINALITY\s+(?:AS\s+)?(\w+)\s*\(\s*(\w+)\s*,\s*(\w+)\s*\)", r"LATERAL (SELECT col AS \3, pos + 1 AS \4 FROM posexplode\1) AS \2", s, flags=re.I)
    s = re.sub(r"FETCH\s+(?:FIRST|NEXT)\s+(\d+)\s+ROWS?\s+ONLY", r"LIMIT \1", s, flags=re.I)
    s = _ties(_distinct_on(s))
    s = _order_nulls(s)
    return _shown(s, kept)


def _projected_in(s: str) -> str:
    """``x [NOT] IN (SELECT …)`` in the statement's own list, where Spark's join would give false for unknown."""
    depth, end = 0, 0
    for m in re.finditer(r"[()]|\bFROM\b", s, re.I):
        if m[0] in "()":
            depth += 1 if m[0] == "(" else -1
        elif not depth:
            end = m.start()
            break
    out, at = [], 0
    for m in re.finditer(_OPERAND + r"\s+(NOT\s+)?IN\s*(?=\(\s*SELECT\b)", s[:end], re.I):
        close = frames._closing(s, m.end())
        x, sub = m[1], s[m.end() + 1 : close]
        known = f"CASE WHEN (SELECT count(*) FROM ({sub})) = 0 THEN false WHEN {x} IS NULL THEN NULL WHEN {x} IN ({sub}) THEN true WHEN (SELECT bool_or(_c IS NULL) FROM ({sub}) AS _s(_c)) THEN NULL ELSE false END"
        out += [s[at : m.start()], f"{'(NOT ' if m[2] else '('}{known})"]
        at = close + 1
    return "".join([*out, s[at:]])


def _array(text: str) -> str:
    return re.sub(r"ARRAY\s*\[(.*)\]", r"array(\1)", text, flags=re.I | re.S)


def _distinct_on(s: str) -> str:
    """A whole statement ``SELECT DISTINCT ON (k) list FROM … ORDER BY …``."""
    m = re.fullmatch(r"\s*SELECT\s+DISTINCT\s+ON\s*\(([^()]*)\)\s+(.*?)\s+FROM\s+(.*?)\s+ORDER\s+BY\s+(.*?)(\s+LIMIT\s+\d+)?\s*", s, flags=re.I | re.S)
    if not m:
        return s
    keys, columns, source, order, limit = m.groups()
    names = ", ".join(c.strip().split()[-1].split(".")[-1] for c in columns.split(","))
    order = _null_order(order)
    return f"SELECT {names} FROM (SELECT {columns}, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS _rn FROM {source}) WHERE _rn = 1{limit or ''}"


_TIES = re.compile(r"(.*?\bFROM\b.*?)\s+ORDER\s+BY\s+(.*?)\s+FETCH\s+(?:FIRST|NEXT)\s+(\d+)\s+ROWS?\s+WITH\s+TIES\s*;?\s*", re.I | re.S)
_PLAIN = re.compile(r"\w+(?:\s+(?:ASC|DESC))?(?:\s+NULLS\s+(?:FIRST|LAST))?", re.I)


def _ties(s: str) -> str:
    """``WITH TIES`` inside a statement, or by expressions: the rank of all rows."""
    m = _TIES.fullmatch(s)
    if not m:
        return s
    inner, order, n = m.groups()
    return f"SELECT * EXCEPT (_rk) FROM (SELECT *, rank() OVER (ORDER BY {_null_order(order)}) AS _rk FROM ({inner})) WHERE _rk <= {n}"


def _with_ties(spark: SparkSession, statement: str, args: dict) -> DataFrame | None:
    """A statement that ends ``WITH TIES`` by columns of its list: a top-n finds the edge, a filter the rows up to it."""
    m = _TIES.fullmatch(statement)
    order = [t.strip() for t in m[2].split(",")] if m else []
    if not order or not all(map(_PLAIN.fullmatch, order)):
        return None
    rows = spark.sql(rewrite(m[1]), args=args or None)
    if not {t.split()[0].lower() for t in order} <= set(map(str.lower, rows.columns)):
        return None
    return relational.fetch_with_ties(rows, int(m[3]), *order)


def _terms(order: str) -> list[str]:
    """The terms of an order, commas in parentheses left alone."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(order):
        depth += (c in "([") - (c in ")]")
        if c == "," and not depth:
            out.append(order[at:i])
            at = i + 1
    return [*out, order[at:]]


def _null_order(order: str) -> str:
    out = []
    for term in _terms(order):
        t = term.strip()
        if not re.search(r"\bNULLS\s+(FIRST|LAST)\b", t, re.I):
            t += " NULLS FIRST" if re.search(r"\bDESC\s*$", t, re.I) else " NULLS LAST"
        out.append(t)
    return ", ".join(out)


_AFTER_ORDER = re.compile(r"[()\[\]]|\b(?:LIMIT|OFFSET|FETCH|ROWS|RANGE|UNION|INTERSECT|EXCEPT|WINDOW)\b", re.I)


def _order_nulls(s: str) -> str:
    """Ascending order puts nulls last, descending first, in every ORDER BY: of statements, subqueries and windows.

    Left alone are ordered-set aggregates, which leave nulls out.
    """
    out, at = [], 0
    for m in re.finditer(r"\bORDER\s+BY\b", s, re.I):
        if m.start() < at or re.search(r"\bWITHIN\s+GROUP\s*\(\s*$", s[: m.start()], re.I):
            continue
        depth, end = 0, len(s)
        for x in _AFTER_ORDER.finditer(s, m.end()):
            if x[0] in "([":
                depth += 1
            elif x[0] in ")]":
                depth -= 1
                if depth < 0:
                    end = x.start()
                    break
            elif not depth:
                end = x.start()
                break
        order = s[m.end() : end]
        tail = order[len(order.rstrip()) :]
        out += [s[at : m.end()], " ", _order_nulls(_null_order(order)), tail]
        at = end
    return "".join([*out, s[at:]])


_PREDICT = re.compile(r"\s*PREDICT\s+(VALUE|CLASS)\s+OF\s+(\w+|\"[^\"]+\")\s+FROM\s+([\w.]+|\"[^\"]+\")(?:\s+WHERE\s+(.*?))?\s+TRAIN\s+ON\s+(.+?)(?:\s+WITH\s+(.*?))?(?:\s+USING\s+MODEL\s+(\w+))?\s*;?\s*", re.I | re.S)
#: ``DO $$ BEGIN … END $$``: the body runs as a script of the engine's own.
_DO = re.compile(r"\s*DO\s+(?:LANGUAGE\s+\w+\s+)?(\$\w*\$)\s*(.*?)\s*;?\s*\1(?:\s*LANGUAGE\s+\w+)?\s*;?\s*", re.I | re.S)


def _predict(spark: SparkSession, m: re.Match) -> DataFrame:
    """``TRAIN ON`` takes columns, expressions, quoted names or ``*``.

    ``USING MODEL linear | mlp | cross`` trains a network; where the session sets ``larkspur.models`` to a folder, networks are
    kept there and a later statement with the same table, features and target uses what it finds.
    """
    from .dml import _items
    from .operators import ml, models

    kind, target, name, where, listed, train, model = m.groups()
    name = name.strip('"')
    rows = spark.table(name)
    bare = target.strip('"')
    columns = [f"`{c}`" for c in rows.columns if c != bare] if listed.strip() == "*" else [re.sub(r'"([^"]+)"', r"`\1`", c) for c in _items(listed)]
    learn = rows.where(rewrite(train)) if train else rows.where(F.col(f"`{bare}`").isNotNull())
    ask = rows.where(rewrite(where)) if where else rows
    folder = spark.conf.get("larkspur.models", None)
    if model or folder:
        classify = kind.upper() == "CLASS"
        if folder:
            return models.predict(models.Store(spark, folder), name, ask, columns, f"`{bare}`", kind.lower(), learn)
        return ask.withColumn("prediction", models.fit(learn, columns, f"`{bare}`", model.lower(), classify).column())
    # expressions become columns of their own for the closed forms
    plain = {f"_x{i}": c for i, c in enumerate(columns)}
    made = lambda df: df.withColumns({k: F.expr(c) for k, c in plain.items()})
    return ml.predict(made(learn), made(ask), list(plain), bare, kind.lower()).drop(*plain)


def sql(spark: SparkSession, statement: str, **args) -> DataFrame:
    """Run a statement. ``PREDICT VALUE | CLASS OF target FROM table [WHERE …] TRAIN ON list [WITH train condition] [USING MODEL kind]``."""
    m = _PREDICT.fullmatch(statement)
    if m:
        return _predict(spark, m)
    from . import dml

    body = _DO.fullmatch(statement)
    if body:
        return spark.sql(body[2])
    explained = _EXPLAIN.fullmatch(statement)
    if explained:
        return _explain(spark, explained, args)
    setting = _SETTING.fullmatch(statement)
    if setting:
        return _setting(spark, setting)
    if dml.is_change(statement):
        return dml.run(spark, statement, args)
    tied = _with_ties(spark, statement, args)
    return _run(spark, rewrite(statement), args) if tied is None else tied


def _run(spark: SparkSession, text: str, args: dict) -> DataFrame:
    """Run a rewritten statement. Columns that depend on a grouped primary key (``catalog.primary_key``) need no aggregate."""
    from pyspark.errors import AnalysisException

    from . import catalog

    while True:
        try:
            return spark.sql(text, args=args or None)
        except AnalysisException as e:
            m = re.fullmatch(r"(\s*SELECT\b)(.*?)(\bFROM\b.*?\bGROUP\s+BY\b\s*)(.*?)((?:\b(?:HAVING|ORDER|LIMIT)\b.*)?)", text, re.I | re.S)
            if e.getCondition() != "MISSING_AGGREGATION" or not m:
                raise
            column = e.getMessageParameters()["expression"].strip('"`').split(".")[-1].strip("`")
            grouped = {t.strip().split(".")[-1].strip("`").lower() for t in _terms(m[4])}
            keys = [k for t in re.findall(r"\b(?:FROM|JOIN|,)\s*(\w+)", m[3], re.I) for k, columns in [catalog.key_of(spark, t)] if column.lower() in columns]
            if not any(k and set(k) <= grouped for k in keys):
                raise
            items = _terms(m[2])
            bare = [re.fullmatch(rf"\s*((?:\w+\.)?`?{re.escape(column)}`?)(?:\s+(?:AS\s+)?(\w+))?\s*", i, re.I) for i in items]
            if not any(bare):
                raise
            items = [f" any_value({b[1]}) AS {b[2] or column} " if b else i for i, b in zip(items, bare)]
            text = f"{m[1]}{','.join(items)}{m[3]}{m[4]}{m[5]}"


_EXPLAIN = re.compile(r"\s*EXPLAIN\s+(?:\(([^()]*)\)\s*|((?:ANALYZE|VERBOSE)\s+)+)?(SELECT|WITH|VALUES|TABLE)\b(.*)", re.I | re.S)
_SETTING = re.compile(r"\s*(SHOW|RESET|SET\s+(?:SESSION|LOCAL))\s+([\w.]*\.[\w.]+)(?:\s*(?:=|\bTO\b)\s*(.*?))?\s*;?\s*", re.I | re.S)


def _explain(spark: SparkSession, m: re.Match, args: dict) -> DataFrame:
    """``EXPLAIN [(ANALYZE, VERBOSE, COSTS, FORMAT TEXT | JSON)]``: a line a row in ``QUERY PLAN``; ANALYZE runs the statement."""
    import json
    import time

    from .plans import workload

    words = (m[1] or m[2] or "").upper()
    df = sql(spark, f"{m[3]}{m[4]}", **args)
    mode = "extended" if "VERBOSE" in words else "cost" if re.search(r"\bCOSTS\b(?!\s+(?:OFF|FALSE))", words) else "formatted"
    lines, spent = [], None
    if re.search(r"\bANALYZE\b(?!\s+(?:OFF|FALSE))", words):
        start = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        spent = (time.perf_counter() - start) * 1000
        lines = [f"Execution Time: {spent:.3f} ms"]
    lines = workload.explain(df, mode).splitlines() + lines
    if "JSON" in words:
        lines = [json.dumps([{"Plan": lines, **({"Execution Time": spent} if spent is not None else {})}])]
    return spark.createDataFrame([(x,) for x in lines], "`QUERY PLAN` string")


def _setting(spark: SparkSession, m: re.Match) -> DataFrame:
    """``SHOW``, ``RESET`` and ``SET SESSION | LOCAL`` of a setting with a dot in its name; a driver's session has no transactions."""
    what, name, value = m[1].split()[0].upper(), m[2], m[3]
    if what == "RESET":
        spark.conf.unset(name)
    elif what == "SET":
        spark.conf.set(name, value.strip("'"))
    return spark.createDataFrame([(spark.conf.get(name, None),)], f"`{name}` string")


def normalize(statement: str) -> str:
    """A statement without its literals' values, in small letters and single blanks."""
    s = re.sub(r"--[^\n]*|/\*.*?\*/", " ", statement, flags=re.S)
    s = re.sub(r"'(?:[^']|'')*'|\b\d+(?:\.\d+)?\b", "?", s)
    s = re.sub(r"\(\s*\?(?:\s*,\s*\?)+\s*\)", "(?)", s)
    return re.sub(r"\s+", " ", s.strip().rstrip(";")).strip().lower()


def fingerprint(statement: str) -> str:
    """Equal for statements that differ in literals, case and blanks only."""
    import hashlib

    return hashlib.md5(normalize(statement).encode()).hexdigest()


def parse_tree(spark: SparkSession, statement: str) -> str:
    """The parser's logical plan as text."""
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(statement).toString()


def tables(spark: SparkSession, statement: str) -> list[str]:
    """Names of the tables a statement reads."""
    names = re.findall(r"'?UnresolvedRelation \[([^\]]*)\]", parse_tree(spark, rewrite(statement)))
    return sorted({n.split(",")[0].strip().replace(", ", ".") for n in names})


distinct_on, fetch_with_ties = relational.distinct_on, relational.fetch_with_ties

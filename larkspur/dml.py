"""Data changes in SQL: INSERT with ON CONFLICT, UPDATE with FROM, DELETE with USING, MERGE and TRUNCATE, all with RETURNING.

Files don't change in place here. A statement computes the table's next state as one plan, writes it to the shared folder
and puts it in place: of a view under the same name, or of a saved table's rows. Readers of a view's old state keep it. Without RETURNING a statement
gives one row, ``rows``: how many rows it touched.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.relational import CardinalityViolation, When
from .session import shared_folder

_STARTS = re.compile(r"\s*(INSERT\s+INTO|UPDATE|DELETE\s+FROM|MERGE\s+INTO|TRUNCATE)\b", re.I)
_NAME = r'(?:\w+|"[^"]+"|`[^`]+`)'


def is_change(statement: str) -> bool:
    return bool(_STARTS.match(statement))


# ---------------------------------------------------------------- reading statements


def _mask(s: str) -> str:
    """The statement with what is quoted, commented or in parentheses blanked, places kept."""
    out, depth = [], 0
    for m in re.finditer(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|[()]|[^()'\"`/-]+|.", s, re.S):
        t = m[0]
        if t == "(":
            out.append("(" if depth == 0 else " ")
            depth += 1
        elif t == ")":
            depth -= 1
            out.append(")" if depth == 0 else " ")
        elif depth or t[0] in "'\"`" or t[:2] in ("--", "/*"):
            out.append("\x01" * len(t) if not t.startswith(("--", "/*")) else " " * len(t))
        else:
            out.append(t)
    return "".join(out)


def _cut(s: str, *words: str) -> dict[str, str]:
    """The parts of a statement that begin with the given words outside parentheses, by word; "" is what comes first."""
    hits = sorted((m.start(), m.end(), w) for w in words for m in [re.search(r"\b" + w.replace(" ", r"\s+") + r"\b", _mask(s), re.I)] if m)
    ends = [h[0] for h in hits[1:]] + [len(s)]
    out = {"": s[: hits[0][0]] if hits else s}
    out.update({w: s[b:e].strip() for (_, b, w), e in zip(hits, ends)})
    return {k: v.strip() for k, v in out.items()}


def _items(s: str) -> list[str]:
    """A list's items, commas inside parentheses or quotes left alone."""
    mask, at, out = _mask(s), 0, []
    for i, c in enumerate(mask):
        if c == ",":
            out.append(s[at:i].strip())
            at = i + 1
    return [*out, s[at:].strip()]


def _bare(name: str) -> str:
    return name.strip().strip('"`')


def _named(s: str) -> tuple[str, str]:
    """``table [AS] alias``: the table and its alias."""
    m = re.fullmatch(rf"\s*({_NAME})(?:\s+(?:AS\s+)?({_NAME}))?\s*", s, re.I)
    if not m:
        raise ValueError(f"a table is expected, not {s!r}")
    return _bare(m[1]), _bare(m[2] or m[1])


def _sets(s: str) -> dict[str, str]:
    """``a = x, (b, c) = (y, z)`` as columns and expressions."""
    out: dict[str, str] = {}
    for item in _items(s):
        left, right = item.split("=", 1)
        names = _items(left.strip()[1:-1]) if left.strip().startswith("(") else [left]
        values = _items(re.sub(r"(?is)^\s*ROW\b", "", right).strip()[1:-1]) if left.strip().startswith("(") else [right]
        if len(names) != len(values):
            raise ValueError(f"{len(names)} columns and {len(values)} values in {item!r}")
        out |= {_bare(n.split(".")[-1]): v.strip() for n, v in zip(names, values)}
    return out


def _whens(s: str, columns: list[str]) -> list[When]:
    mask = _mask(s)
    at = [m.start() for m in re.finditer(r"\bWHEN\s+(?:NOT\s+)?MATCHED\b", mask, re.I)]
    out = []
    for a, b in zip(at, [*at[1:], len(s)]):
        part = s[a:b].strip()
        m = re.match(r"WHEN\s+(NOT\s+)?MATCHED(?:\s+BY\s+(SOURCE|TARGET))?\b", part, re.I)
        kind = "both" if not m[1] else "target" if (m[2] or "").upper() == "SOURCE" else "source"
        then = re.search(r"\bTHEN\b", _mask(part), re.I)
        condition = re.sub(r"(?is)^\s*AND\b", "", part[m.end() : then.start()]).strip() or None
        what = part[then.end() :].strip()
        word = what.split()[0].upper()
        if word == "UPDATE":
            out.append(When(kind, "update", condition, _sets(re.sub(r"(?is)^UPDATE\s+SET\b", "", what))))
        elif word == "DELETE":
            out.append(When(kind, "delete", condition))
        elif word == "DO":
            out.append(When(kind, "nothing", condition))
        else:
            m = re.fullmatch(r"INSERT\s*(?:\((.*?)\))?\s*(?:VALUES\s*\((.*)\)|DEFAULT\s+VALUES)", what, re.I | re.S)
            names = [_bare(n) for n in _items(m[1])] if m[1] else columns
            out.append(When(kind, "insert", condition, dict(zip(names, _items(m[2]))) if m[2] else {}))
    return out


# ---------------------------------------------------------------- running them


class _Change:
    def __init__(self, spark: SparkSession, name: str, alias: str):
        self.spark, self.name, self.alias = spark, name, alias
        self.folder = f"{shared_folder(spark)}/larkspur-{uuid.uuid4().hex}"
        self.target = spark.table(name)
        self.columns = self.target.columns
        self.types = {f.name: f.dataType.simpleString() for f in self.target.schema}

    def written(self, df: DataFrame, tag: str) -> DataFrame:
        df.write.parquet(f"{self.folder}-{tag}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}-{tag}")

    def numbered(self) -> DataFrame:
        """The target with a number for each row, written, so that it stays the same in all that follows."""
        return self.written(self.target.withColumn("_row", F.monotonically_increasing_id()), "old")

    def query(self, text: str, args: dict | None = None, **frames: DataFrame) -> DataFrame:
        """A query over the session's tables and the given frames."""
        from .dialect import rewrite

        return self.spark.sql(rewrite(text), args=args or None, **frames)

    def typed(self, exprs: dict[str, str], otherwise: str | None) -> str:
        """A select list with each of the table's columns: its new expression, or the old value, or null."""
        unknown = {c.lower() for c in exprs} - {c.lower() for c in self.columns}
        if unknown:
            raise ValueError(f"column {sorted(unknown)[0]} of {self.name} does not exist")
        low = {c.lower(): v for c, v in exprs.items()}
        old = lambda c: f"{otherwise}.`{c}`" if otherwise else "NULL"
        value = lambda c: old(c) if low.get(c.lower(), "DEFAULT").upper() == "DEFAULT" and c.lower() not in low else "NULL" if low[c.lower()].upper() == "DEFAULT" else low[c.lower()]
        return ", ".join(f"CAST({value(c)} AS {self.types[c]}) AS `{c}`" for c in self.columns)

    def done(self, kept: DataFrame, touched: DataFrame, returning: str | None, stays: bool = True) -> DataFrame:
        """The new state is ``kept`` and, if they stay, the touched rows; the result is what RETURNING asks of the latter."""
        names = [F.col(f"`{c}`") for c in self.columns]
        touched = self.written(touched, "touched")
        rows = kept.select(names)
        new = self.written(rows.unionByName(touched.where("_action <> 'DELETE'").select(names)) if stays else rows, "new")
        if self.spark.catalog.getTable(self.name).isTemporary:
            new.createOrReplaceTempView(self.name)
        else:
            new.write.mode("overwrite").insertInto(self.name)
        if not returning:
            return touched.agg(F.count("*").alias("rows"))
        listed = re.sub(r"(?i)\bmerge_action\s*\(\s*\)", "_action", returning)
        if re.fullmatch(r"\s*\*\s*", listed):
            listed = ", ".join(f"`{c}`" for c in self.columns)
        return self.query(f"SELECT {listed} FROM {{touched}} AS {self.alias}", touched=touched)


def run(spark: SparkSession, statement: str, args: dict | None = None) -> DataFrame:
    """Run a statement of this kind."""
    s = statement.strip().rstrip(";").strip()
    kind = _STARTS.match(s)[1].split()[0].upper()
    return {"INSERT": _insert, "UPDATE": _update, "DELETE": _delete, "MERGE": _merge, "TRUNCATE": _truncate}[kind](spark, s, args)


def _truncate(spark, s, args):
    name = _bare(re.sub(r"(?is)^TRUNCATE\s+(?:TABLE\s+)?(?:ONLY\s+)?", "", s))
    c = _Change(spark, name, name)
    return c.done(c.target.limit(0), c.target.withColumn("_action", F.lit("DELETE")), None, stays=False)


def _insert(spark, s, args):
    parts = _cut(re.sub(r"(?is)^INSERT\s+INTO\s+", "", s), "ON CONFLICT", "RETURNING")
    m = re.match(rf"({_NAME})(?:\s+AS\s+({_NAME}))?\s*(\([^()]*\))?\s*(?=SELECT|VALUES|WITH|TABLE|\(|DEFAULT)", parts[""], re.I)
    name, alias = _bare(m[1]), _bare(m[2] or m[1])
    c = _Change(spark, name, alias)
    source = parts[""][m.end() :]
    columns = [_bare(x) for x in _items(m[3][1:-1])] if m[3] else c.columns
    rows = c.query(f"SELECT * FROM ({source})", args)
    if len(rows.columns) > len(columns):
        raise ValueError("INSERT has more expressions than target columns")
    columns = columns[: len(rows.columns)]
    source = c.written(c.query(f"SELECT {c.typed(dict(zip(columns, (f'`{x}`' for x in columns))), None)} FROM {{rows}}", rows=rows.toDF(*columns)), "source")
    conflict = parts.get("ON CONFLICT")
    if conflict is None:
        return c.done(c.target, source.withColumn("_action", F.lit("INSERT")), parts.get("RETURNING"))
    m = re.match(r"(\([^()]*\))?\s*(?:WHERE\s+.*?)?DO\s+(NOTHING|UPDATE\s+SET\b)", conflict, re.I | re.S)
    keys = [_bare(x) for x in _items(m[1][1:-1])] if m[1] else c.columns
    has_null = F.lit(False)
    for k in keys:  # rows without a key conflict with nothing
        has_null = has_null | F.col(f"`{k}`").isNull()
    keyed, free = source.where(~has_null), source.where(has_null)
    fresh = keyed.join(c.target.select(keys), keys, "left_anti")
    if m[2].upper() == "NOTHING":
        # one row of each key goes in: the least in column order, so that runs agree
        once = fresh.groupBy(*keys).agg(F.min(F.struct(*(F.col(f"`{x}`") for x in c.columns))).alias("_r")).select("_r.*").select(c.columns)
        return c.done(c.target, once.unionByName(free.select(c.columns)).withColumn("_action", F.lit("INSERT")), parts.get("RETURNING"))
    if keyed.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise CardinalityViolation("ON CONFLICT DO UPDATE command cannot affect row a second time")
    rest = _cut(conflict[m.end() :], "WHERE")
    old = c.numbered()
    on = " AND ".join(f"{alias}.`{k}` = excluded.`{k}`" for k in keys)
    hits = c.written(
        c.query(f"SELECT {alias}._row, {c.typed(_sets(rest['']), alias)} FROM {{old}} AS {alias} JOIN {{source}} AS excluded ON {on}" + (f" WHERE {rest['WHERE']}" if "WHERE" in rest else ""), args, old=old, source=keyed),
        "hits",
    )
    touched = hits.withColumn("_action", F.lit("UPDATE")).drop("_row").unionByName(fresh.unionByName(free).withColumn("_action", F.lit("INSERT")))
    return c.done(old.join(hits, "_row", "left_anti"), touched, parts.get("RETURNING"))


def _update(spark, s, args):
    parts = _cut(re.sub(r"(?is)^UPDATE\s+(?:ONLY\s+)?", "", s), "SET", "FROM", "WHERE", "RETURNING")
    name, alias = _named(parts[""])
    c = _Change(spark, name, alias)
    old = c.numbered()
    source = f", {parts['FROM']}" if "FROM" in parts else ""
    hits = c.query(f"SELECT {alias}._row, {c.typed(_sets(parts['SET']), alias)} FROM {{old}} AS {alias}{source} WHERE {parts.get('WHERE', 'true')}", args, old=old)
    # of several source rows one is taken: that with the least values
    one = hits.groupBy("_row").agg(F.min(F.struct(*(F.col(f"`{x}`") for x in c.columns))).alias("_r")).select("_row", "_r.*") if source else hits
    one = c.written(one, "hits")
    return c.done(old.join(one, "_row", "left_anti"), one.drop("_row").withColumn("_action", F.lit("UPDATE")), parts.get("RETURNING"))


def _delete(spark, s, args):
    parts = _cut(re.sub(r"(?is)^DELETE\s+FROM\s+(?:ONLY\s+)?", "", s), "USING", "WHERE", "RETURNING")
    name, alias = _named(parts[""])
    c = _Change(spark, name, alias)
    old = c.numbered()
    source = f", {parts['USING']}" if "USING" in parts else ""
    hits = c.written(c.query(f"SELECT {alias}._row FROM {{old}} AS {alias}{source} WHERE {parts.get('WHERE', 'true')}", args, old=old).distinct(), "hits")
    return c.done(old.join(hits, "_row", "left_anti"), old.join(hits, "_row", "left_semi").drop("_row").withColumn("_action", F.lit("DELETE")), parts.get("RETURNING"))


def _merge(spark, s, args):
    parts = _cut(re.sub(r"(?is)^MERGE\s+INTO\s+(?:ONLY\s+)?", "", s), "USING", "ON", "WHEN", "RETURNING")
    name, alias = _named(parts[""])
    c = _Change(spark, name, alias)
    whens = _whens("WHEN " + parts["WHEN"], c.columns)
    m = re.fullmatch(rf"(\(.*\)|{_NAME})(?:\s+(?:AS\s+)?({_NAME}))?", parts["USING"], re.I | re.S)
    by = _bare(m[2] or m[1])
    source = c.written(c.query(f"SELECT * FROM {m[1]}", args).withColumn("_source", F.lit(True)), "source")
    old = c.numbered()
    kinds = {w.kind for w in whens}
    how = {(False, False): "JOIN", (True, False): "RIGHT JOIN", (False, True): "LEFT JOIN", (True, True): "FULL JOIN"}["source" in kinds, "target" in kinds]
    state = {"both": f"{alias}._row IS NOT NULL AND {by}._source IS NOT NULL", "source": f"{alias}._row IS NULL", "target": f"{by}._source IS NULL"}
    chosen = " ".join(f"WHEN {state[w.kind]} AND ({w.condition or 'true'}) THEN {i}" for i, w in enumerate(whens))
    values = ", ".join(f"struct({c.typed(w.values, None if w.action == 'insert' else alias)}) AS _v{i}" for i, w in enumerate(whens))
    joined = c.query(f"SELECT {alias}._row AS _row, CASE {chosen} END AS _which, {values} FROM {{old}} AS {alias} {how} {{source}} AS {by} ON {parts['ON']}", args, old=old, source=source)
    acts = [i for i, w in enumerate(whens) if w.action != "nothing"]
    acted = c.written(joined.where(F.col("_which").isin(acts)), "acted")
    if acted.where("_row IS NOT NULL").groupBy("_row").count().where("count > 1").limit(1).count():
        raise CardinalityViolation("MERGE command cannot affect row a second time")
    value, action = F.lit(None), F.lit(None)
    for i, w in enumerate(whens):
        value, action = (F.when(F.col("_which") == i, x).otherwise(y) for x, y in ((F.col(f"_v{i}"), value), (F.lit(w.action.upper()), action)))
    touched = acted.select(value.alias("_v"), action.alias("_action"))
    touched = touched.select(*(F.col(f"_v.`{x}`").cast(c.types[x]).alias(x) for x in c.columns), "_action")
    return c.done(old.join(acted.where("_row IS NOT NULL").select("_row"), "_row", "left_anti"), touched, parts.get("RETURNING"))

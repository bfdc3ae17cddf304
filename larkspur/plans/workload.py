"""Workloads: query templates, their frequency over time, forecasts, layout advice and join hints."""

from __future__ import annotations

import math
import re
import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def template(sql) -> Column:
    """A statement with literals as ``?``, lists of them as one, small letters and single blanks."""
    s = F.col(sql) if isinstance(sql, str) else sql
    s = F.regexp_replace(s, r"'(?:[^']|'')*'", "?")
    s = F.regexp_replace(s, r"\b\d+(?:\.\d+)?\b", "?")
    s = F.regexp_replace(s, r"\(\s*\?(?:\s*,\s*\?)+\s*\)", "(?)")
    return F.lower(F.trim(F.regexp_replace(s, r"\s+", " ")))


def template_hash(sql) -> Column:
    return F.md5(template(sql).cast("binary"))


def is_select(sql) -> Column:
    return (F.col(sql) if isinstance(sql, str) else sql).rlike(r"(?is)^\s*(select|with)\b")


def series(log: DataFrame, at: str, key: str, seconds: int) -> DataFrame:
    """Executions of each key in each period."""
    start = F.timestamp_seconds(F.floor(F.unix_timestamp(F.col(at)) / seconds) * seconds)
    return log.groupBy(key, start.alias("period")).agg(F.count("*").alias("n"))


def ewma(df: DataFrame, key: str, at: str, value: str, alpha: float) -> DataFrame:
    """Exponentially weighted mean after each row of a key, from the first value on, in work linear in the rows."""
    w = Window.partitionBy(key).orderBy(at)
    rows = df.withColumn("_i", F.row_number().over(w) - 1)
    rows = rows.withColumn("_y", F.col(value).cast("double") * F.when(F.col("_i") == 0, 1.0).otherwise(alpha))
    return _decayed(rows, key, "_i", "_y", 1 - alpha, "ewma").drop("_i", "_y")


def _decayed(rows: DataFrame, key: str, i: str, y: str, keep: float, out: str) -> DataFrame:
    """``out``: the sum of all ``y`` up to a row, each times ``keep`` to the power of its distance.

    Rows fall into blocks in which powers stay within a double's range; a block's sum is carried into the next one, by
    the same rule over blocks.
    """
    size = 256 if keep >= 1 or keep <= 0 else max(2, min(256, int(200 / -math.log10(keep))))
    block, inside = F.floor(F.col(i) / size), F.col(i) % size
    w = Window.partitionBy(key, "_b").orderBy(i).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_b", block).withColumn("_p", F.pow(F.lit(float(keep)), inside.cast("double")))
    rows = rows.withColumn("_own", F.sum(F.col(y) / F.col("_p")).over(w) * F.col("_p"))
    ends = rows.groupBy(key, "_b").agg(F.max_by("_own", i).alias("_t"))
    onward = keep**size
    if onward > 1e-18:  # else what lies further back is below the last digit
        sums = _decayed(ends.withColumnRenamed("_b", "_j"), key, "_j", "_t", onward, "_e").select(key, (F.col("_j") + 1).alias("_b"), F.col("_e").alias("_c"))
    else:
        sums = ends.select(key, (F.col("_b") + 1).alias("_b"), F.col("_t").alias("_c"))
    sums = sums.withColumnRenamed(key, "_k").withColumnRenamed("_b", "_b2")
    rows = rows.join(sums, rows[key].eqNullSafe(sums["_k"]) & (F.col("_b") == F.col("_b2")), "left")
    carried = F.coalesce(F.col("_c"), F.lit(0.0)) * F.col("_p") * float(keep)
    return rows.withColumn(out, F.col("_own") + carried).drop("_b", "_p", "_own", "_k", "_b2", "_c")


def forecast_linear(df: DataFrame, key: str, x: str, y: str, horizon: int) -> DataFrame:
    """Each key's straight line over its periods, continued for ``horizon`` steps (keys of ten periods or more)."""
    fit = df.groupBy(key).agg(F.count("*").alias("n"), F.max(x).alias("last"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept")).where("n >= 10")
    steps = fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return steps.select(key, "step", (F.col("intercept") + F.col("slope") * (F.col("last") + F.col("step"))).alias("forecast"))


class Forecaster:
    """A straight line for each key: ``fit``, ``predict`` a horizon, ``evaluate`` on later periods.

    Periods are numbers. Keys need ten periods; gaps between them don't matter to a line. The fitted lines are one aggregate.
    """

    LEAST = 10

    def __init__(self, key: str, x: str, y: str):
        self.key, self.x, self.y, self.lines = key, x, y, None

    def fit(self, df: DataFrame) -> Forecaster:
        own = F.regr_slope(self.y, self.x), F.regr_intercept(self.y, self.x)
        self.lines = df.groupBy(self.key).agg(F.count("*").alias("_n"), F.max(self.x).alias("_last"), own[0].alias("_slope"), own[1].alias("_intercept")).where(F.col("_n") >= self.LEAST)
        return self

    def predict(self, horizon: int) -> DataFrame:
        """``key, x, forecast`` for the ``horizon`` periods after each key's last one; no line falls below zero."""
        steps = self.lines.withColumn("_step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
        at = F.col("_last") + F.col("_step")
        return steps.select(self.key, at.alias(self.x), F.greatest(F.lit(0.0), F.col("_intercept") + F.col("_slope") * at).alias("forecast"))

    def evaluate(self, later: DataFrame) -> DataFrame:
        """``mae, rmse, mape, n`` over the rows of ``later`` whose key has a line; ``mape`` leaves actual zeros out."""
        both = later.join(self.lines, self.key)
        e = F.col(self.y) - F.greatest(F.lit(0.0), F.col("_intercept") + F.col("_slope") * F.col(self.x))
        share = F.abs(e / F.nullif(F.col(self.y).cast("double"), F.lit(0.0)))
        return both.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (F.avg(share) * 100).alias("mape"), F.count("*").alias("n"))


def interpolate(df: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Gaps filled on the straight line between their neighbours; at the ends by the nearest value.

    The value ahead is the last one in falling order: a frame up to a partition's end is read anew for each row, which is
    quadratic. Of rows at one place those with a value come first, by value.
    """
    gap, rows = F.col(value).isNull(), (Window.unboundedPreceding, 0)
    back = Window.partitionBy(key).orderBy(F.col(at).asc_nulls_last(), gap, F.col(value).asc()).rowsBetween(*rows)
    ahead = Window.partitionBy(key).orderBy(F.col(at).desc_nulls_first(), gap, F.col(value).desc()).rowsBetween(*rows)
    pair = F.when(F.col(value).isNotNull(), F.struct(F.col(at).cast("double").alias("t"), F.col(value).alias("v")))
    out = df.withColumn("_a", F.last(pair, ignorenulls=True).over(back)).withColumn("_b", F.last(pair, ignorenulls=True).over(ahead))
    a, b, t = F.col("_a"), F.col("_b"), F.col(at).cast("double")
    line = a["v"] + (b["v"] - a["v"]) * F.try_divide(t - a["t"], b["t"] - a["t"])
    return out.withColumn(value, F.coalesce(F.col(value), line, a["v"], b["v"])).drop("_a", "_b")


_COLUMN = r"(?:\w+\.)?(\w+)\s*(?:=|<>|<=|>=|<|>|\bIN\b|\bBETWEEN\b|\bLIKE\b)"


def index_candidates(log: DataFrame, sql: str, known: list[str]) -> DataFrame:
    """Columns that WHERE and JOIN conditions of logged SELECTs compare, with their number of uses."""
    rest = F.regexp_extract(F.col(sql), r"(?is)\bWHERE\b(.*?)(?:\bGROUP\s+BY\b|\bORDER\s+BY\b|\bLIMIT\b|$)", 1)
    on = F.array_join(F.regexp_extract_all(F.col(sql), F.lit(r"(?is)\bON\s+(.*?)(?=\bJOIN\b|\bWHERE\b|\bGROUP\b|\bORDER\b|$)"), F.lit(1)), " ")
    found = log.where(is_select(sql)).select(F.explode(F.regexp_extract_all(F.concat_ws(" AND ", rest, on), F.lit("(?i)" + _COLUMN), F.lit(1))).alias("column"))
    return found.select(F.lower("column").alias("column")).where(F.col("column").isin(known)).groupBy("column").agg(F.count("*").alias("uses"))


def index_budget(candidates: DataFrame, score: str, size: str, budget: float) -> DataFrame:
    """Candidates by score for size until the storage budget ends: those whose running size stays within it."""
    order = Window.orderBy(F.desc(F.col(score) / F.col(size)), "column")
    return candidates.withColumn("running", F.sum(size).over(order)).where(F.col("running") <= budget)


class Journal:
    """Small tables as appended Parquet files under a folder, so that they outlive the driver. The newest row of a key counts."""

    def __init__(self, spark: SparkSession, path: str | None, schemas: dict[str, str]):
        self.spark, self.path, self.schemas = spark, path, schemas

    def table(self, name: str) -> DataFrame:
        try:
            if self.path is not None:
                return self.spark.read.schema(self.schemas[name]).parquet(f"{self.path}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        return self.spark.createDataFrame([], self.schemas[name])

    def add(self, name: str, rows: list[tuple]) -> None:
        if self.path is not None and rows:
            self.spark.createDataFrame(rows, self.schemas[name]).coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")

    def newest(self, name: str, keys: list[str]) -> list:
        """The last row of each key by ``at``."""
        t = self.table(name)
        return t.groupBy(*keys).agg(F.max_by(F.struct(*t.columns), "at").alias("r")).select("r.*").collect()


class LayoutAdvisor:
    """The registry of layouts (Spark's stand-in for indexes): sorted and bucketed copies under a storage budget.

    Queries come in by ``enqueue`` (SELECTs only); ``work`` scores the columns they filter on with fading weights and
    creates what pays within the budget. With a ``path``, queue, facts and registry are tables there, and another
    driver goes on where this one ended. Their rows are columns of tables and queries in wait, never data.
    """

    TABLES = {
        "work_queue": "sql string, state string, at double",
        "facts": "table string, column string, score double, at double",
        "registry": "table string, column string, size_mb double, state string, at double",
    }

    def __init__(self, spark: SparkSession, budget_mb: float, fade: float = 0.7, path: str | None = None):
        self.spark, self.budget_mb, self.fade = spark, budget_mb, fade
        self.journal = Journal(spark, path, self.TABLES)
        done = {(r.sql, r.at) for r in self.journal.table("work_queue").where("state = 'done'").collect()}
        self.queue = [(r.sql, r.at) for r in self.journal.table("work_queue").where("state = 'waiting'").orderBy("at").collect() if (r.sql, r.at) not in done]
        self.scores = {(r.table, r.column): r.score for r in self.journal.newest("facts", ["table", "column"])}
        self.registry = {(r.table, r.column): r.size_mb for r in self.journal.newest("registry", ["table", "column"]) if r.state == "created"}

    def enqueue(self, sql: str) -> bool:
        if not re.match(r"(?is)\s*(select|with)\b", sql):
            return False
        self.queue.append((sql, time.time()))
        self.journal.add("work_queue", [(sql, "waiting", self.queue[-1][1])])
        return True

    def work(self, owners: dict[str, str], size_mb: dict[str, float]) -> list[tuple[str, str]]:
        """``owners``: the table of each column. Returns the layouts that were created."""
        seen: dict[tuple[str, str], int] = {}
        for sql, _ in self.queue:
            for c in re.findall("(?i)" + _COLUMN, sql):
                if c.lower() in owners:
                    seen[owners[c.lower()], c.lower()] = seen.get((owners[c.lower()], c.lower()), 0) + 1
        self.journal.add("work_queue", [(sql, "done", at) for sql, at in self.queue])
        self.queue.clear()
        for k in {*self.scores, *seen}:
            self.scores[k] = self.fade * self.scores.get(k, 0.0) + (1 - self.fade) * seen.get(k, 0)
        now, made = time.time(), []
        self.journal.add("facts", [(*k, v, now) for k, v in sorted(self.scores.items())])
        for k in sorted(self.scores, key=lambda k: (-self.scores[k] / max(size_mb[k[0]], 1e-9), k)):
            if k not in self.registry and self.storage_mb() + size_mb[k[0]] <= self.budget_mb and self.scores[k] > 0:
                self.registry[k] = size_mb[k[0]]
                made.append(k)
        self.journal.add("registry", [(*k, self.registry[k], "created", now) for k in made])
        return made

    def storage_mb(self) -> float:
        return sum(self.registry.values())

    def drop(self, table: str, column: str) -> bool:
        if self.registry.pop((table, column), None) is None:
            return False
        self.journal.add("registry", [(table, column, 0.0, "dropped", time.time())])
        return True

    def write(self, table: str, column: str, buckets: int) -> str:
        name = f"{table}_by_{column}"
        self.spark.table(table).write.mode("overwrite").bucketBy(buckets, column).sortBy(column).saveAsTable(name)
        return name


#: The boundaries of the hint rules, in bytes.
BROADCAST_BELOW, HASH_BELOW = 64 << 20, 4 << 30


def choose_hint(left_bytes: int, right_bytes: int, executors: int = 1) -> str:
    """The join strategy that fits two checked sizes."""
    small = min(left_bytes, right_bytes)
    if small <= BROADCAST_BELOW:
        return "BROADCAST"
    return "SHUFFLE_HASH" if small <= HASH_BELOW * executors and small * 3 <= max(left_bytes, right_bytes) else "MERGE"


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a result's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def hinted_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    hint = choose_hint(plan_bytes(left), plan_bytes(right))
    if hint == "BROADCAST" and plan_bytes(right) > plan_bytes(left) and how == "inner":
        return right.join(left.hint("broadcast"), on, how)
    return left.join(right.hint(hint.lower()), on, how)


def optimize_query(sql: str, sizes: dict[str, int], form: str = "hint") -> str:
    """A statement with join hints: as a comment hint (``hint``), settings (``set``) or an order of tables (``order``)."""
    names = [t for t in dict.fromkeys(re.findall(r"(?i)\b(?:FROM|JOIN)\s+(\w+)", sql)) if t in sizes]
    order = sorted(names, key=lambda t: sizes[t])
    if form == "order":
        return "(" + " ".join(order) + ")"
    small = [t for t in order[:-1] if sizes[t] <= BROADCAST_BELOW]
    if form == "set":
        return f"SET spark.sql.autoBroadcastJoinThreshold={max([sizes[t] for t in small], default=-1)};"
    hints = [f"BROADCAST({t})" for t in small] + [f"MERGE({t})" for t in order[:-1] if t not in small]
    return re.sub(r"(?i)^\s*SELECT\b", f"SELECT /*+ {', '.join(hints)} */", sql, count=1) if hints else sql


def plan_features(df: DataFrame) -> list[float]:
    """What a router knows of a query: numbers of joins, aggregates and filters, and the log of the estimated bytes."""
    text = df._jdf.queryExecution().optimizedPlan().toString()
    return [float(len(re.findall(rf"\b{k}\b", text))) for k in ("Join", "Aggregate", "Filter")] + [math.log1p(plan_bytes(df))]


class PlanBuffer:
    """Plans tried for a query, with their latencies, and a router over experts.

    An expert turns a statement into one with hints. ``route`` asks for the expert whose plans ran fastest on the ``k`` queries
    nearest by features; experts that were tried on fewer are tried first, in order of their names. With a ``path`` the buffer
    is a table there.
    """

    TABLES = {"buffer": "query string, expert string, latency double, features array<double>, plan string, at double"}

    def __init__(self, spark: SparkSession | None = None, path: str | None = None):
        self.journal = Journal(spark, path, self.TABLES)
        self.rows: list[dict] = [r.asDict() for r in self.journal.table("buffer").orderBy("at").collect()] if path else []

    def run(self, df: DataFrame, query: str, expert: str) -> float:
        start = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        latency = time.perf_counter() - start
        self.rows.append({"query": query, "expert": expert, "latency": latency, "features": plan_features(df), "plan": df._jdf.queryExecution().executedPlan().toString(), "at": time.time()})
        self.journal.add("buffer", [tuple(self.rows[-1].values())])
        return latency

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(r.values()) for r in self.rows], self.TABLES["buffer"])

    def best(self, query: str) -> str | None:
        own = [r for r in self.rows if r["query"] == query]
        return min(own, key=lambda r: r["latency"])["expert"] if own else None

    def route(self, experts: list[str], features: list[float], k: int = 3) -> str:
        guess = {}
        for name in sorted(experts):
            near = sorted((math.dist(r["features"], features), r["latency"]) for r in self.rows if r["expert"] == name)[:k]
            if len(near) < k:
                return name
            guess[name] = sum(y for _, y in near) / k
        return min(guess, key=lambda name: (guess[name], name))


#: Experts by name: what each makes of a statement and the bytes of its tables.
EXPERTS = {
    "default": lambda sql, sizes: sql,
    "broadcast": lambda sql, sizes: optimize_query(sql, sizes),
    "merge": lambda sql, sizes: re.sub(r"(?i)^\s*SELECT\b", f"SELECT /*+ MERGE({', '.join(sorted(sizes))}) */", sql, count=1) if sizes else sql,
}


def routed(spark: SparkSession, sql: str, sizes: dict[str, int], buffer: PlanBuffer) -> tuple[str, DataFrame]:
    """The expert that the buffer's router chooses, and the query as it makes it."""
    name = buffer.route(list(EXPERTS), plan_features(spark.sql(sql)))
    return name, spark.sql(EXPERTS[name](sql, sizes))


def explain(df: DataFrame, mode: str = "formatted") -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))

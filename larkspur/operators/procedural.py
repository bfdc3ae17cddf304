"""User-defined aggregates, procedures, triggers, cursors, prepared statements and the statement log."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import workload


def create_aggregate(step: Callable[[Column, Column], Column], start: Column, final: Callable[[Column], Column] = lambda s: s, strict: bool = True) -> Callable[..., Column]:
    """``CREATE AGGREGATE (SFUNC, STYPE, INITCOND, FINALFUNC)`` from column expressions; stays in the JVM.

    ``order``: columns that fix the order of the rows; strict aggregates skip nulls.
    """

    def make(x: str | Column, *order: str) -> Column:
        x = F.col(x) if isinstance(x, str) else x
        keyed = F.struct(*[F.col(o).alias(f"k{i}") for i, o in enumerate(order)], x.alias("v"))
        rows = F.collect_list(F.when(x.isNotNull(), keyed) if strict else keyed)
        return F.aggregate(F.array_sort(rows) if order else rows, start, lambda s, r: step(s, r["v"]), final)

    return make


class Procedures:
    """``CREATE PROCEDURE`` and ``CALL``: callables by name; INOUT and OUT values are returned."""

    def __init__(self, spark: SparkSession):
        self.spark, self.by_name = spark, {}

    def create(self, name: str, body: Callable) -> None:
        self.by_name[name] = body

    def call(self, name: str, *args):
        if name not in self.by_name:
            raise KeyError(f"procedure {name} does not exist")
        return self.by_name[name](self.spark, *args)


class Writer:
    """A table's write path with triggers: row triggers change or drop new rows, statement triggers see all of them."""

    def __init__(self, path: str):
        self.path = path
        self.before: list[Callable[[DataFrame], DataFrame]] = []
        self.after: list[Callable[[DataFrame], None]] = []

    def moddatetime(self, column: str) -> None:
        self.before.append(lambda df: df.withColumn(column, F.current_timestamp()))

    def autoinc(self, column: str, start: int = 1) -> None:
        self.before.append(lambda df: df.withColumn(column, F.coalesce(F.col(column), F.monotonically_increasing_id() + start)))

    def insert_username(self, column: str, user: str) -> None:
        self.before.append(lambda df: df.withColumn(column, F.lit(user)))

    def check(self, condition: str) -> None:
        """A constraint: a row that fails it stops the write."""
        self.before.append(lambda df: df.where(F.when(F.expr(condition), True).otherwise(F.raise_error(F.lit(f"row violates check {condition}")).cast("boolean"))))

    def references(self, column: str, parent: DataFrame, key: str) -> None:
        """A foreign key: rows without a parent stop the write."""

        def run(df):
            lost = df.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti")
            if lost.limit(1).count():
                raise ValueError(f"{column} has values that {key} lacks")
            return df

        self.before.append(run)

    def insert(self, df: DataFrame, mode: str = "append") -> DataFrame:
        for f in self.before:
            df = f(df)
        df.write.mode(mode).parquet(self.path)
        for f in self.after:
            f(df)
        return df


class Cursor:
    """``DECLARE … CURSOR``: rows come a partition at a time. ``scroll`` keeps what was read, so that it can go back."""

    def __init__(self, df: DataFrame, scroll: bool = False):
        self.rows: Iterator = df.toLocalIterator()
        self.scroll, self.seen, self.at = scroll, [], 0

    def fetch(self, n: int = 1) -> list:
        if n < 0:
            if not self.scroll:
                raise ValueError("cursor can only scan forward")
            end = max(self.at - 1, 0)
            start = max(end + n, 0)
            self.at = start + 1 if end > start else 0
            return self.seen[start:end][::-1]
        out = []
        while len(out) < n:
            if self.scroll and self.at < len(self.seen):
                row = self.seen[self.at]
            else:
                row = next(self.rows, None)
                if row is None:
                    self.at += self.scroll and bool(out)
                    break
                if self.scroll:
                    self.seen.append(row)
            self.at += 1
            out.append(row)
        return out

    def move(self, n: int) -> int:
        return len(self.fetch(n))


class Prepared:
    """``PREPARE`` and ``EXECUTE``: named parameters, bound by the engine and never pasted into the text."""

    def __init__(self, spark: SparkSession, statement: str):
        from .. import dialect

        self.spark, self.statement = spark, dialect.rewrite(statement)

    def execute(self, **args) -> DataFrame:
        return self.spark.sql(self.statement, args=args)


class StatementLog:
    """Calls and times by statement template."""

    def __init__(self, spark: SparkSession):
        self.spark, self.rows = spark, []

    def run(self, statement: str) -> list:
        from .. import dialect

        start = time.perf_counter()
        out = dialect.sql(self.spark, statement).collect()
        self.rows.append((statement, (time.perf_counter() - start) * 1000, len(out)))
        return out

    def table(self) -> DataFrame:
        log = self.spark.createDataFrame(self.rows, "query string, ms double, rows long")
        return log.groupBy(workload.template("query").alias("query"), workload.template_hash("query").alias("queryid")).agg(F.count("*").alias("calls"), F.sum("ms").alias("total_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"), F.avg("ms").alias("mean_ms"), F.sum("rows").alias("rows"))

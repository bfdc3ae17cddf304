"""Tables of a folder as views, inheritance, statistics and materialized views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register(spark: SparkSession, folder: str, names: list[str] | None = None) -> SparkSession:
    """Temporary views over the folder's tables; nothing is read but footers."""
    for name in names or TABLES:
        table(spark, folder, name).createOrReplaceTempView(name)
    return spark


_keys: dict[str, list[str]] = {}


def primary_key(table: str, *columns: str) -> None:
    """Declare a table's key, on which its other columns depend; it is taken at its word."""
    _keys[table.lower()] = [c.lower() for c in columns]


def key_of(spark: SparkSession, table: str) -> tuple[list[str], set[str]]:
    """A table's declared key and all its columns, in small letters; nothing for what is no table."""
    if table.lower() not in _keys or not spark.catalog.tableExists(table):
        return [], set()
    return _keys[table.lower()], {c.lower() for c in spark.table(table).columns}


def inherited(parent: DataFrame, *children: DataFrame, only: bool = False) -> DataFrame:
    """A parent with its children's rows cut to the parent's columns (``only``: the parent's own rows)."""
    if only:
        return parent
    return reduce(lambda a, b: a.unionByName(b.select(parent.columns)), children, parent)


def analyze(spark: SparkSession, name: str) -> None:
    """Column statistics of a saved table, for join reordering."""
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")


class MaterializedView:
    """A query's result as Parquet; ``refresh`` replaces it."""

    def __init__(self, spark: SparkSession, path: str, build):
        self.spark, self.path, self.build = spark, path, build

    def refresh(self) -> DataFrame:
        self.build(self.spark).write.mode("overwrite").parquet(self.path)
        return self.read()

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

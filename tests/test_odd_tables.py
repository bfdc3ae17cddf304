"""Queries against their SQL on tables with keys and values that the given tables lack."""

import duckdb
from compare import difference, oracle
from pyspark.sql import functions as F

from larkspur.operators import relational
from larkspur.plans import workload
from larkspur.queries import ORACLE, QUERIES


def folder_of(path, **tables: str) -> str:
    """A folder with a table for each SELECT."""
    for name, sql in tables.items():
        duckdb.execute(f"COPY ({sql}) TO '{path}/{name}.parquet' (FORMAT parquet)")
    return str(path)


def against_sql(spark, folder: str, name: str) -> str:
    return difference(QUERIES[name](spark, folder), oracle(folder), ORACLE[name])


def test_bits_of_keys_wider_than_their_padding(spark, tmp_path):
    """A key of 17 bits or more is cut to 16 in its string; its bits are counted before."""
    keys = "0, 1, 32768, 65535, 65536, 65537, 131071, 131073, 1099511627777, 9223372036854775807, -1, -5, -65536, NULL"
    folder = folder_of(tmp_path, part=f"SELECT unnest([{keys}])::BIGINT AS p_partkey")
    assert against_sql(spark, folder, "fn_bit_strings") == ""


def test_series_are_filled_in_linear_work(spark, tmp_path):
    """No frame is read anew for each row; series with gaps at their ends, long gaps, no value at all and no key."""
    keys = "list_concat(range(-40, 400), range(5000, 5020), [9000, NULL])"
    folder = folder_of(tmp_path, part=f"SELECT x AS p_partkey, CASE WHEN x % 7 < 5 THEN x * 1.5 + x % 11 END::DOUBLE AS p_retailprice FROM (SELECT unnest({keys})::BIGINT AS x)")
    assert against_sql(spark, folder, "interpolate_series") == ""
    assert "unboundedfollowing" not in QUERIES["interpolate_series"](spark, folder)._jdf.queryExecution().executedPlan().toString().lower()


def test_gaps_beside_values_of_the_same_place(spark):
    """At one place a gap takes the value there, whichever row comes first."""
    rows = spark.createDataFrame([("a", 1, None), ("a", 2, 4.0), ("a", 3, None), ("a", 3, 8.0), ("a", 4, None), ("a", 5, 0.0), ("a", 7, None), ("b", 1, None)], "k string, x int, y double")
    got = sorted(tuple(r) for r in workload.interpolate(rows, "k", "x", "y").where("k = 'a'").collect())
    assert got == [("a", 1, 4.0), ("a", 2, 4.0), ("a", 3, 8.0), ("a", 3, 8.0), ("a", 4, 4.0), ("a", 5, 0.0), ("a", 7, 0.0)]


def test_pairs_of_one_large_group_are_made_by_several_tasks(spark, tmp_path):
    """All customers in one group: every pair is there, and no task makes most of them."""
    folder = folder_of(tmp_path, customer="SELECT i AS c_custkey, 7::INT AS c_nationkey, 'BUILDING' AS c_mktsegment FROM range(6000) r(i)")
    made = QUERIES["join_self"](spark, folder).groupBy(F.spark_partition_id()).agg(F.count("*"), F.sum("a"), F.sum("b")).collect()
    n = 6000
    assert [sum(r[i] for r in made) for i in (1, 2, 3)] == [n * (n - 1) // 2, sum(i * (n - 1 - i) for i in range(n)), sum(i * i for i in range(n))]
    assert max(r[1] for r in made) < 0.6 * n * (n - 1) / 2


def test_pairs_of_repeated_and_missing_keys(spark, tmp_path):
    """Equal keys are no pair, and each of them pairs with the others; rows without a key or group have none."""
    odd = "SELECT * FROM (VALUES (NULL, 1, 'A'), (-3, 1, 'A'), (50, NULL, 'A'), (51, 1, NULL), (9223372036854775807, 2, 'A')) v(i, n, s)"
    rows = f"SELECT i % 40 AS i, i % 3 AS n, 'A' AS s FROM range(200) r(i) UNION ALL {odd}"
    folder = folder_of(tmp_path, customer=f"SELECT i::BIGINT AS c_custkey, n::INT AS c_nationkey, s::VARCHAR AS c_mktsegment FROM ({rows})")
    assert against_sql(spark, folder, "join_self") == ""
    want = sorted(tuple(r) for r in QUERIES["join_self"](spark, folder).collect())
    small = relational.ordered_pairs(spark.read.parquet(f"{folder}/customer.parquet"), ["c_nationkey", "c_mktsegment"], "c_custkey", block=4, each=100)
    assert sorted(tuple(r) for r in small.collect()) == want and small.rdd.getNumPartitions() > 10
    none = relational.ordered_pairs(spark.range(0).select("id", F.lit(1).alias("k")), ["k"], "id")
    assert none.columns == ["a", "b"] and none.count() == 0


def test_pairs_keep_values_that_are_no_number(spark):
    rows = spark.sql("SELECT * FROM VALUES (1D, 1D), (1D, 2D), (1D, double('NaN')), (double('NaN'), 1D), (double('NaN'), 2D) v(k, x)")
    got = sorted(str(tuple(r)) for r in relational.ordered_pairs(rows, ["k"], "x", ("lo", "hi"), block=1).collect())
    assert got == ["(1.0, 2.0)", "(1.0, 2.0)", "(1.0, nan)", "(2.0, nan)"]

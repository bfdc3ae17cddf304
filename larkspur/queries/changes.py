"""Statements that change data, on copies of the tables."""

from pyspark.sql import functions as F

from .. import dialect
from . import built

_COPY = "o_orderkey, o_custkey, o_totalprice"


def _copy(t, name: str) -> None:
    """A view of some orders' columns that a statement may change."""
    t("customer").createOrReplaceTempView("customer")
    t("orders").createOrReplaceTempView("orders")
    t("orders").selectExpr(*_COPY.split(", ")).createOrReplaceTempView(name)


#: New rows by customer: an order's key for odd ones, a fresh key for even ones.
_NEW = "SELECT CASE WHEN c_custkey % 2 = 1 THEN c_custkey ELSE -c_custkey END AS o_orderkey, c_nationkey AS o_custkey, c_acctbal AS o_totalprice FROM customer"


@built("sql_insert_do_nothing", f"SELECT o_orderkey, o_totalprice AS price FROM ({_NEW}) WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def _(t, spark):
    """Every new key comes twice; one row of each goes in, those that are there stay out."""
    _copy(t, "orders_a")
    return dialect.sql(spark, f"INSERT INTO orders_a {_NEW} UNION ALL SELECT o_orderkey, o_custkey, o_totalprice + 1 FROM ({_NEW}) ON CONFLICT (o_orderkey) DO NOTHING RETURNING o_orderkey, o_totalprice AS price")


@built("sql_insert_do_update", f"""
SELECT coalesce(t.o_orderkey, s.o_orderkey) AS o_orderkey, coalesce(t.o_custkey, s.o_custkey) AS o_custkey,
 CASE WHEN t.o_orderkey IS NULL THEN s.o_totalprice WHEN s.o_orderkey IS NOT NULL AND t.o_custkey % 3 > 0 THEN t.o_totalprice + s.o_totalprice ELSE t.o_totalprice END AS o_totalprice
FROM (SELECT {_COPY} FROM orders) t FULL JOIN ({_NEW}) s ON t.o_orderkey = s.o_orderkey""")
def _(t, spark):
    _copy(t, "orders_b")
    dialect.sql(spark, f"INSERT INTO orders_b AS o {_NEW} ON CONFLICT (o_orderkey) DO UPDATE SET o_totalprice = o.o_totalprice + excluded.o_totalprice WHERE o.o_custkey % 3 > 0")
    return spark.table("orders_b")


@built("sql_update_from_returning", "SELECT o_orderkey, o_totalprice * 2 + c_acctbal AS price FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000 AND o_orderkey % 2 = 0")
def _(t, spark):
    _copy(t, "orders_c")
    return dialect.sql(spark, "UPDATE orders_c AS o SET o_totalprice = o.o_totalprice * 2 + c.c_acctbal FROM customer c WHERE o.o_custkey = c.c_custkey AND c.c_acctbal > 5000 AND o.o_orderkey % 2 = 0 RETURNING o_orderkey, o_totalprice AS price")


@built("sql_update_state", f"SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN -1 ELSE o_custkey END AS o_custkey, CASE WHEN o_totalprice > 100000 THEN o_totalprice / 2 ELSE o_totalprice END AS o_totalprice FROM (SELECT {_COPY} FROM orders)")
def _(t, spark):
    _copy(t, "orders_d")
    dialect.sql(spark, "UPDATE orders_d SET (o_custkey, o_totalprice) = (-1, o_totalprice / 2) WHERE o_totalprice > 100000")
    return spark.table("orders_d")


@built("sql_delete_using_returning", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(t, spark):
    _copy(t, "orders_e")
    return dialect.sql(spark, "DELETE FROM orders_e o USING customer c WHERE o.o_custkey = c.c_custkey AND c.c_mktsegment = 'BUILDING' RETURNING o_orderkey, o_custkey")


_MERGE = f"""MERGE INTO {{}} AS t USING ({_NEW}) AS s ON t.o_orderkey = s.o_orderkey
WHEN MATCHED AND s.o_totalprice < 0 THEN DELETE
WHEN MATCHED AND s.o_totalprice > 9000 THEN DO NOTHING
WHEN MATCHED THEN UPDATE SET o_totalprice = t.o_totalprice + s.o_totalprice
WHEN NOT MATCHED AND s.o_totalprice > 0 THEN INSERT (o_orderkey, o_totalprice) VALUES (s.o_orderkey, s.o_totalprice)
WHEN NOT MATCHED BY SOURCE AND t.o_orderkey % 5 = 0 THEN DELETE"""
_MERGED = f"""(SELECT t.o_orderkey AS tk, s.o_orderkey AS sk, t.o_custkey AS tc, t.o_totalprice AS tp, s.o_totalprice AS sp, CASE
 WHEN t.o_orderkey IS NOT NULL AND s.o_orderkey IS NOT NULL THEN (CASE WHEN s.o_totalprice < 0 THEN 'DELETE' WHEN s.o_totalprice > 9000 THEN 'STAY' ELSE 'UPDATE' END)
 WHEN t.o_orderkey IS NULL THEN (CASE WHEN s.o_totalprice > 0 THEN 'INSERT' ELSE 'NONE' END) WHEN t.o_orderkey % 5 = 0 THEN 'DELETE' ELSE 'STAY' END AS action
 FROM (SELECT {_COPY} FROM orders) t FULL JOIN ({_NEW}) s ON t.o_orderkey = s.o_orderkey)"""


@built("sql_merge_state", f"SELECT coalesce(tk, sk) AS o_orderkey, tc AS o_custkey, CASE action WHEN 'UPDATE' THEN tp + sp WHEN 'INSERT' THEN sp ELSE tp END AS o_totalprice FROM {_MERGED} WHERE action NOT IN ('DELETE', 'NONE')")
def _(t, spark):
    _copy(t, "orders_f")
    dialect.sql(spark, _MERGE.format("orders_f"))
    return spark.table("orders_f")


@built("sql_merge_returning", f"SELECT action, coalesce(tk, sk) AS o_orderkey, CASE action WHEN 'UPDATE' THEN tp + sp WHEN 'INSERT' THEN sp ELSE tp END AS price FROM {_MERGED} WHERE action IN ('DELETE', 'UPDATE', 'INSERT')")
def _(t, spark):
    _copy(t, "orders_g")
    return dialect.sql(spark, _MERGE.format("orders_g") + " RETURNING merge_action() AS action, o_orderkey, o_totalprice AS price")


@built("sql_truncate", "SELECT 0::BIGINT AS n, count(*) AS gone FROM orders")
def _(t, spark):
    _copy(t, "orders_h")
    gone = dialect.sql(spark, "TRUNCATE TABLE orders_h")
    return gone.select(F.col("rows").alias("gone")).crossJoin(spark.table("orders_h").agg(F.count("*").alias("n")))

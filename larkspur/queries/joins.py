"""Joins and subqueries."""

from pyspark.sql import functions as F

from ..operators import relational as R
from . import ORACLE, built, pair, same

same("join_inner", "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 5000")
same("join_left", "SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P' GROUP BY c.c_custkey")
same("join_right", "SELECT c.c_custkey, n.n_name FROM nation n RIGHT JOIN customer c ON n.n_nationkey = c.c_nationkey AND n.n_regionkey = 2")
same("join_full", "SELECT a.k AS ak, b.k AS bk FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') a FULL JOIN (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0) b ON a.k = b.k")
same("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
same("join_using", "SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) a JOIN (SELECT r_regionkey AS k, r_name FROM region) b USING (k)")
same("join_natural", "SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) a NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region) b")
same("join_theta_range", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_acctbal < b.s_acctbal AND a.s_nationkey = b.s_nationkey")
same("join_semi_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
same("join_semi_in", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)")
pair("join_any_subquery", "SELECT p_partkey FROM part WHERE p_partkey = ANY (SELECT l_partkey FROM lineitem WHERE l_quantity = 1)", "SELECT p_partkey FROM part WHERE p_partkey = ANY (SELECT l_partkey FROM lineitem WHERE l_quantity = 1)")
same("join_anti_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
same("join_not_in_nullaware", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000) AND n_nationkey NOT IN (SELECT nullif(r_regionkey, 9) FROM region)")
same("join_not_in_with_null", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT nullif(r_regionkey, 3) FROM region)")
same("join_lateral", "SELECT r.r_name, x.n_name FROM region r, LATERAL (SELECT n_name FROM nation WHERE n_regionkey = r.r_regionkey AND n_nationkey > 10) x")
same("scalar_subquery", "SELECT o_orderkey, round(o_totalprice - (SELECT avg(o_totalprice) FROM orders), 2) AS diff FROM orders ")
same("correlated_subquery", "SELECT l_orderkey, l_linenumber FROM lineitem l WHERE l_quantity > (SELECT 1.8 * avg(l_quantity) FROM lineitem i WHERE i.l_partkey = l.l_partkey)")
same("star_join_5way", """
SELECT r_name, p_brand, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
WHERE p_size < 15 AND s_acctbal > 0 GROUP BY r_name, p_brand""")
same("join_comma_implicit", "SELECT min(c_name) AS c, min(o_orderdate) AS d, count(*) AS n FROM customer, orders, nation WHERE c_custkey = o_custkey AND c_nationkey = n_nationkey AND n_name < 'F'")
same("not_in_list_projected", "SELECT n_nationkey, n_nationkey NOT IN (1, 2, NULL) AS out_of, nullif(n_nationkey, 3) NOT IN (1, 2) AS other FROM nation")
same("not_in_projected", "SELECT n_nationkey, n_nationkey NOT IN (SELECT nullif(r_regionkey, 3) FROM region) AS out_of, nullif(n_nationkey, 5) NOT IN (SELECT r_regionkey FROM region) AS other FROM nation")
same("in_projected", "SELECT s_suppkey, s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AS near FROM supplier")
same("join_theta_only", "SELECT a.r_regionkey AS a, count(*) AS n, min(b.n_nationkey) AS lo FROM region a JOIN nation b ON a.r_regionkey * 5 < b.n_nationkey GROUP BY a.r_regionkey")
same("join_theta_left", "SELECT n.n_nationkey, r.r_regionkey FROM nation n LEFT JOIN region r ON n.n_nationkey < r.r_regionkey")
same("join_merge_forced", "SELECT /*+ MERGE(c) */ c.c_mktsegment, o.o_orderpriority, count(*) AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment, o.o_orderpriority")
same("join_merge_full", "SELECT /*+ MERGE(b) */ a.k AS ak, b.k AS bk FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') a FULL JOIN (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0) b ON a.k = b.k")


@built("join_self", "SELECT a.c_custkey AS a, b.c_custkey AS b FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey < b.c_custkey AND a.c_mktsegment = b.c_mktsegment")
def _(t, spark):
    return R.ordered_pairs(t("customer"), ["c_nationkey", "c_mktsegment"], "c_custkey")


@built("join_asof", """
SELECT p.event_id, p.user_id, e.ts AS matched_ts, e.value AS value FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY user_id, ts) e ON p.user_id = e.user_id AND p.ts >= e.ts""")
def _(t, spark):
    e = t("events")
    clicks = e.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return R.asof_join(left, clicks, ["user_id"], "ts", "ts", ["value"]).drop("ts")


@built("join_asof_by_ranges", ORACLE["join_asof"])
def _(t, spark):
    """The same by ranges of two days, each sorted by itself."""
    e = t("events")
    clicks = e.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return R.asof_join(left, clicks, ["user_id"], "ts", "ts", ["value"], span=2 * 86400).drop("ts")


@built("join_range_binned", """
SELECT o.o_orderkey, s.s_suppkey FROM orders o JOIN supplier s ON o.o_totalprice >= s.s_acctbal * 10 AND o.o_totalprice < s.s_acctbal * 10 + 500""")
def _(t, spark):
    r = t("supplier").select("s_suppkey", (F.col("s_acctbal") * 10).alias("lo"), (F.col("s_acctbal") * 10 + 500).alias("hi"))
    return R.range_join(t("orders").select("o_orderkey", "o_totalprice"), r, "o_totalprice", "lo", "hi", 500.0).select("o_orderkey", "s_suppkey")


@built("join_salted", "SELECT e.event_id, u.n FROM events e JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) u ON e.user_id = u.user_id")
def _(t, spark):
    e = t("events")
    return R.salted_join(e.select("event_id", "user_id"), e.groupBy("user_id").agg(F.count("*").alias("n")), ["user_id"], 8).select("event_id", "n")


@built("hint_choice", "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def _(t, spark):
    from ..plans import workload as W

    c = t("customer").withColumnRenamed("c_custkey", "o_custkey")
    return W.hinted_join(t("orders"), c, "o_custkey").groupBy("c_mktsegment").agg(F.count("*").alias("n"))

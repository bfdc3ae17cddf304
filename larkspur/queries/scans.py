"""Scans, filters, projections, limits and the workload templates."""

from pyspark.sql import functions as F

from ..operators import relational as R
from . import built, pair, same

same("flagship", """
SELECT n.n_name AS nation, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue, count(*) AS n
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
WHERE o.o_orderdate >= TIMESTAMP '1995-01-01 00:00:00' GROUP BY n.n_name ORDER BY nation""")
same("scan_project_filter", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_quantity > 45 AND l_discount < 0.03")
same("filter_between_in_like_ilike", "SELECT p_partkey, p_brand, p_type FROM part WHERE p_size BETWEEN 5 AND 20 AND (p_brand LIKE 'Brand#1%' OR p_brand IN ('Brand#21', 'Brand#32')) AND p_type ILIKE '%e%' AND p_name NOT LIKE 'zzz%'")
same("filter_or_and_bitmap", "SELECT o_orderkey, o_orderstatus FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 200000) OR (o_orderstatus = 'O' AND o_totalprice < 20000)")
pair("filter_regex", "SELECT doc_id, lang FROM documents WHERE text ~ '[0-9]{4}' AND source !~ '9$' AND lang ~* '^(EN|de)$'",
     "SELECT doc_id, lang FROM documents WHERE regexp_matches(text, '[0-9]{4}') AND NOT regexp_matches(source, '9$') AND regexp_matches(lang, '^(EN|de)$', 'i')")
pair("filter_similar_to", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment SIMILAR TO '(B|M)%' AND c_name NOT SIMILAR TO '%7_'",
     "SELECT c_custkey, c_mktsegment FROM customer WHERE regexp_full_match(c_mktsegment, '(B|M).*') AND NOT regexp_full_match(c_name, '.*7.')")
same("three_valued_logic", """
SELECT a, b, (a AND b) AS conj, (a OR b) AS disj, NOT a AS neg, (a IS NOT DISTINCT FROM b) AS same, (a IS TRUE) AS t, (a IS NOT FALSE) AS nf, (a IS NULL) AS u, o_orderkey
FROM (SELECT CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS a, CASE (o_orderkey % 9) - (o_orderkey % 3) WHEN 0 THEN true WHEN 3 THEN false END AS b, o_orderkey FROM orders) x""")
same("case_coalesce_nullif", "SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN 'big' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'small' END AS size, coalesce(nullif(o_orderstatus, 'F'), 'closed') AS state, greatest(o_orderkey, o_custkey) AS hi, least(o_orderkey, NULL, o_custkey) AS lo FROM orders")
pair("between_symmetric", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN SYMMETRIC 20 AND 5", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN least(20, 5) AND greatest(20, 5)")
same("row_comparison", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey < 100) OR (l_orderkey = 100 AND l_linenumber < 3)")
pair("row_comparison_struct", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE struct(l_orderkey, l_linenumber) < struct(100L, 3)", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey, l_linenumber) < (100, 3)")
pair("topk_nulls_last", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders ORDER BY s DESC, o_orderkey LIMIT 25", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders ORDER BY s DESC NULLS FIRST, o_orderkey LIMIT 25")
same("limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 15")
pair("fetch_first", "SELECT c_custkey FROM customer ORDER BY c_custkey FETCH FIRST 10 ROWS ONLY", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 10")
pair("with_ties", "SELECT p_partkey, p_size FROM part ORDER BY p_size FETCH FIRST 5 ROWS WITH TIES", "SELECT p_partkey, p_size FROM (SELECT *, rank() OVER (ORDER BY p_size) AS rk FROM part) WHERE rk <= 5")


@built("with_ties_operator", "SELECT o_orderkey, o_orderpriority, o_custkey FROM (SELECT *, rank() OVER (ORDER BY o_orderpriority DESC NULLS FIRST, o_custkey NULLS LAST) AS rk FROM orders) WHERE rk <= 40")
def _(t, spark):
    return R.fetch_with_ties(t("orders"), 40, "o_orderpriority desc", "o_custkey").select("o_orderkey", "o_orderpriority", "o_custkey")


same("values_scan", "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS v(a, b)")
pair("any_array", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = ANY (ARRAY[1, 3]) AND n_nationkey <> ALL (ARRAY[2, 3])", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (1, 3) AND n_nationkey NOT IN (2, 3)")
same("is_distinct_from", "SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'F') IS DISTINCT FROM 'O'")
same("collate_binary", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment < 'F'")
pair("collate_ci", "SELECT c_custkey FROM customer WHERE c_mktsegment COLLATE UTF8_LCASE = 'building'", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'")
same("one_time_filter", "SELECT r_name FROM region WHERE 1 = 2")
same("subquery_scan", "SELECT seg, n FROM (SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY c_mktsegment) s WHERE n > 1")
same("cte_scan", "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), top AS (SELECT max(n) AS m FROM big) SELECT big.o_custkey, big.n FROM big, top WHERE big.n = top.m")

# ten templates of the workload, adapted to the columns there are; ordered in full before a limit
_T = {
    "01": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 49 ORDER BY l_orderkey, l_linenumber LIMIT 100",
    "02": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100",
    "03": "SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0 ORDER BY c_custkey LIMIT 100",
    "04": "SELECT p_partkey, p_retailprice FROM part WHERE p_size < 10 AND p_retailprice > 900 ORDER BY p_partkey LIMIT 100",
    "05": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 4) AS price FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-01 00:00:00' GROUP BY l_returnflag, l_linestatus",
    "06": "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
    "07": "SELECT n_name, count(*) AS suppliers, round(avg(s_acctbal), 4) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name",
    "08": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY o_orderpriority",
    "09": "SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY c_custkey, c_name ORDER BY revenue DESC NULLS LAST, c_custkey LIMIT 20",
    "10": "SELECT p_brand, count(DISTINCT l_suppkey) AS suppliers, round(sum(l_quantity), 2) AS qty FROM part JOIN lineitem ON p_partkey = l_partkey WHERE p_size BETWEEN 1 AND 15 GROUP BY p_brand",
}
for _k, _sql in _T.items():
    same(f"tpch_template_{_k}", _sql)


@built("tablesample_bernoulli")
def _(t, spark):
    return R.tablesample(t("orders"), "bernoulli", 10, seed=7)


@built("tablesample_system")
def _(t, spark):
    return R.tablesample(t("lineitem").repartition(16), "system", 50, seed=7)


@built("tablesample_all", "SELECT count(*) AS n FROM orders")
def _(t, spark):
    return R.tablesample(t("orders"), "bernoulli", 100).agg(F.count("*").alias("n"))


@built("inheritance", "SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer")
def _(t, spark):
    from .. import catalog

    parent = t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    child = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return catalog.inherited(parent, child)

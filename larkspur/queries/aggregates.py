"""Aggregation."""

from pyspark.sql import functions as F

from .. import catalog
from ..functions import arrays, json, ranges
from ..operators import relational as R
from . import built, pair, same

same("agg_basic", "SELECT l_returnflag, count(*) AS n, count(DISTINCT l_orderkey) AS orders, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc, min(l_shipdate) AS first, max(l_shipdate) AS last FROM lineitem GROUP BY l_returnflag")
same("agg_filter", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, round(sum(o_totalprice) FILTER (WHERE o_totalprice > 100000), 2) AS big FROM orders GROUP BY o_orderpriority")
same("agg_distinct", "SELECT count(DISTINCT o_custkey) AS c, CAST(sum(DISTINCT o_custkey % 10) AS BIGINT) AS s FROM orders")
same("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND min(o_totalprice) < 20000")
same("agg_having_without_group", "SELECT 1 AS one FROM orders HAVING min(o_orderkey) < max(o_orderkey)")
same("agg_rollup", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
same("agg_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
same("agg_grouping_sets", "SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_size), ())")
pair("agg_grouping_id", "SELECT l_returnflag, l_linestatus, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS g, CAST(grouping(l_linestatus) AS BIGINT) AS gl, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus WITH CUBE",
     "SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus)::BIGINT AS g, grouping(l_linestatus)::BIGINT AS gl, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
same("agg_ordinal_alias", "SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1")
same("agg_alias", "SELECT lower(o_orderstatus) AS s, count(*) AS n FROM orders GROUP BY s")
catalog.primary_key("customer", "c_custkey")
pair("agg_functional_dependency", "SELECT c_custkey, c_name, customer.c_mktsegment AS segment, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
     "SELECT c_custkey, any_value(c_name) AS c_name, any_value(c_mktsegment) AS segment, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")


@built("agg_group_by_distinct", """
SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), (o_orderpriority), ())""")
def _(t, spark):
    sets = R.product_of_sets(R.rollup_sets("o_orderstatus", "o_orderpriority"), R.rollup_sets("o_orderpriority", "o_orderstatus"))
    return R.group_by_distinct(t("orders"), sets, [F.count("*").alias("n")])


@built("agg_string_ordered", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey")
def _(t, spark):
    t("nation").createOrReplaceTempView("nation")
    return spark.sql("SELECT n_regionkey, listagg(n_name, ', ') WITHIN GROUP (ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey")


@built("agg_array_ordered", "SELECT n_regionkey, array_to_string(array_agg(coalesce(nullif(n_name, 'CHINA'), '?') ORDER BY n_nationkey), '|') AS names FROM nation GROUP BY n_regionkey")
def _(t, spark):
    return t("nation").groupBy("n_regionkey").agg(F.array_join(arrays.collect(F.expr("nullif(n_name, 'CHINA')"), "n_nationkey"), "|", "?").alias("names"))


same("agg_bool_bit", "SELECT o_orderstatus, bool_and(o_totalprice > 1000) AS a, bool_or(o_totalprice > 400000) AS o, bit_and(o_orderkey) AS ba, bit_or(o_orderkey) AS bo, bit_xor(o_orderkey) AS bx FROM orders GROUP BY o_orderstatus")
same("agg_stddev_var", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS ss, round(stddev_pop(l_quantity), 6) AS sp, round(var_samp(l_quantity), 6) AS vs, round(var_pop(l_quantity), 6) AS vp FROM lineitem GROUP BY l_returnflag")
same("agg_corr_covar", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, round(covar_pop(l_quantity, l_discount), 6) AS cp, round(covar_samp(l_quantity, l_discount), 6) AS cs FROM lineitem GROUP BY l_returnflag")
same("agg_regr", "SELECT l_returnflag, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS b, round(regr_intercept(l_extendedprice, l_quantity), 2) AS a, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(regr_avgx(l_extendedprice, l_quantity), 6) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 4) AS ay FROM lineitem GROUP BY l_returnflag")
same("agg_regr_sums", "SELECT l_linestatus, round(regr_sxx(l_discount, l_tax), 4) AS sxx, round(regr_syy(l_discount, l_tax), 4) AS syy, round(regr_sxy(l_discount, l_tax), 4) AS sxy FROM lineitem GROUP BY l_linestatus")
same("agg_percentile_cont_disc", "SELECT o_orderstatus, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY o_totalprice), 4) AS q1, percentile_disc(0.5) WITHIN GROUP (ORDER BY o_totalprice) AS med FROM orders GROUP BY o_orderstatus")
pair("agg_mode", "SELECT o_custkey % 5 AS g, mode() WITHIN GROUP (ORDER BY o_orderpriority) AS m FROM orders GROUP BY o_custkey % 5",
     "SELECT g, o_orderpriority AS m FROM (SELECT o_custkey % 5 AS g, o_orderpriority, row_number() OVER (PARTITION BY o_custkey % 5 ORDER BY count(*) DESC, o_orderpriority) AS rn FROM orders GROUP BY o_custkey % 5, o_orderpriority) WHERE rn = 1")


@built("agg_json_object", "SELECT n_regionkey, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_name) || '}' AS j FROM nation GROUP BY n_regionkey")
def _(t, spark):
    return t("nation").groupBy("n_regionkey").agg(json.object_agg("n_name", "n_nationkey").alias("j"))


@built("agg_json_array", "SELECT n_regionkey, '[' || string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey) || ']' AS j FROM nation GROUP BY n_regionkey")
def _(t, spark):
    return t("nation").groupBy("n_regionkey").agg(json.array_agg("n_nationkey", "n_nationkey").alias("j"))


@built("agg_hypothetical_rank", """
SELECT count(*) FILTER (WHERE p_size < 20) + 1 AS rank, count(DISTINCT p_size) FILTER (WHERE p_size < 20) + 1 AS dense_rank,
 round(count(*) FILTER (WHERE p_size < 20)::DOUBLE / count(*), 8) AS percent_rank, round((count(*) FILTER (WHERE p_size <= 20) + 1)::DOUBLE / (count(*) + 1), 8) AS cume_dist FROM part""")
def _(t, spark):
    h = R.hypothetical(t("part"), "p_size", 20)
    return h.select("rank", "dense_rank", F.round("percent_rank", 8).alias("percent_rank"), F.round("cume_dist", 8).alias("cume_dist"))


@built("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC NULLS FIRST, o_orderkey")
def _(t, spark):
    return R.distinct_on(t("orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice desc", "o_orderkey")


pair("distinct_on_sql", "SELECT DISTINCT ON (l_partkey) l_partkey, l_orderkey, l_linenumber FROM lineitem ORDER BY l_partkey, l_orderkey DESC, l_linenumber",
     "SELECT DISTINCT ON (l_partkey) l_partkey, l_orderkey, l_linenumber FROM lineitem ORDER BY l_partkey, l_orderkey DESC NULLS FIRST, l_linenumber")
same("select_distinct", "SELECT DISTINCT p_brand, p_size FROM part")
pair("agg_sum_wide", "SELECT CAST(sum(CAST(o_orderkey AS DECIMAL(38,0)) * 1000000000000) AS STRING) AS s FROM orders", "SELECT CAST(sum(o_orderkey::HUGEINT * 1000000000000) AS VARCHAR) AS s FROM orders")


@built("fn_range_agg", """
WITH e AS (SELECT user_id, epoch_us(ts) // 1000000 AS lo, epoch_us(ts) // 1000000 + 86400 AS hi FROM events),
m AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM e),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT user_id, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY user_id, island""")
def _(t, spark):
    e = t("events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("lo"))
    return ranges.agg(e.withColumn("hi", F.col("lo") + 86400), ["user_id"], "lo", "hi")


@built("agg_approx_distinct")
def _(t, spark):
    return t("lineitem").agg(F.approx_count_distinct("l_partkey").alias("parts"), F.hll_sketch_estimate(F.hll_sketch_agg("l_orderkey")).alias("orders"))


@built("hash_sort_agg_agree", "SELECT o_custkey, count(*) AS n, max(o_orderkey) AS by_hash, max(o_orderkey) AS by_sort FROM orders GROUP BY o_custkey")
def _(t, spark):
    """One aggregation by two plans, side by side: a number's maximum is kept in a hash table, a string's by sorting."""
    o = t("orders")
    a = o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("by_hash"))
    b = o.groupBy("o_custkey").agg(F.max(F.lpad(F.col("o_orderkey").cast("string"), 20, "0")).cast("long").alias("by_sort"))
    return a.join(b, "o_custkey")

"""Window functions."""

from pyspark.sql import functions as F

from ..operators import relational as R
from . import built, pair, same

same("win_row_number_rank_dense", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS rn, CAST(rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS BIGINT) AS rk, CAST(dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS BIGINT) AS dr FROM orders")
same("win_ntile_percent_cume", "SELECT p_partkey, CAST(ntile(7) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS BIGINT) AS nt, round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_size), 8) AS pr, round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_size), 8) AS cd FROM part")
same("win_lag_lead", "SELECT o_orderkey, lag(o_orderkey, 1) OVER w AS prev, lead(o_orderkey, 2, -1) OVER w AS nxt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
same("win_first_last_nth", "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS n2 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
same("win_rows_frame", "SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 2) AS s FROM lineitem")
same("win_range_numeric", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS n FROM part")
same("win_range_interval", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n FROM events")
same("win_default_frame_peers", "SELECT p_partkey, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS s FROM part")
pair("win_agg_filter", "SELECT o_orderkey, count_if(o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS f FROM orders",
     "SELECT o_orderkey, count(*) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS f FROM orders")
same("win_named", "SELECT c_custkey, CAST(rank() OVER w AS BIGINT) AS rk, count(*) OVER w AS n FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_mktsegment)")


@built("win_groups_frame", "SELECT p_partkey, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 2 PRECEDING AND 1 FOLLOWING)::BIGINT AS s FROM part")
def _(t, spark):
    return R.groups_frame(t("part"), ["p_brand"], "p_size", 2, 1, {"s": F.sum("p_size")}).select("p_partkey", "s")


@built("win_exclude_current", "SELECT p_partkey, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW)::BIGINT AS s FROM part")
def _(t, spark):
    return R.sum_excluding(t("part"), ["p_brand"], ["p_partkey"], "p_size", "current row", "s").select("p_partkey", "s")


@built("win_exclude_group", "SELECT p_partkey, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_type GROUPS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE GROUP)::BIGINT AS s FROM part")
def _(t, spark):
    return R.sum_excluding(t("part"), ["p_brand"], ["p_type"], "p_size", "group", "s").select("p_partkey", "s")


@built("win_exclude_ties", "SELECT p_partkey, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_type GROUPS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE TIES)::BIGINT AS s FROM part")
def _(t, spark):
    return R.sum_excluding(t("part"), ["p_brand"], ["p_type"], "p_size", "ties", "s").select("p_partkey", "s")


pair("win_top_per_group", "SELECT o_custkey, o_orderkey, CAST(rn AS BIGINT) AS rn FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS rn FROM orders) x WHERE rn <= 3",
     "SELECT o_custkey, o_orderkey, CAST(rn AS BIGINT) AS rn FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS rn FROM orders) x WHERE rn <= 3")


_W = "SELECT l_orderkey, l_linenumber, {} FROM lineitem"
_O = "PARTITION BY l_orderkey ORDER BY l_quantity"
same("win_groups_sql", _W.format(f"sum(l_quantity) OVER ({_O} GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s, count(*) OVER ({_O} GROUPS 2 PRECEDING) AS n, min(l_linenumber) OVER ({_O} GROUPS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS lo"))
same("win_groups_exclude_sql", _W.format(", ".join(f"{fn}({x}) OVER ({_O} GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW EXCLUDE {e}) AS {fn}_{k}" for k, e in enumerate(("CURRENT ROW", "GROUP", "TIES", "NO OTHERS")) for fn, x in (("sum", "l_linenumber"), ("count", "l_linenumber"), ("max", "l_linenumber")))))
same("win_exclude_running_sql", "SELECT o_orderkey, {} FROM orders".format(", ".join(f"{fn}(o_orderkey % 7) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW EXCLUDE {e}) AS {fn}_{k}" for k, e in enumerate(("CURRENT ROW", "GROUP", "TIES")) for fn in ("sum", "count", "min", "max"))))
same("win_exclude_range_sql", _W.format(", ".join(f"{fn}(l_linenumber) OVER ({_O} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE {e}) AS {fn}_{k}" for k, e in enumerate(("CURRENT ROW", "GROUP", "TIES")) for fn in ("sum", "count", "max"))))
same("win_exclude_peers_rows_sql", "SELECT o_orderkey, sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderstatus, o_orderkey ROWS BETWEEN 1 PRECEDING AND 3 FOLLOWING EXCLUDE TIES) AS s, avg(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW) AS a FROM orders WHERE o_totalprice > 1000")
pair("win_null_order", "SELECT n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY nullif(n_nationkey % 4, 1), n_nationkey) AS up, row_number() OVER (PARTITION BY n_regionkey ORDER BY nullif(n_nationkey % 4, 1) DESC, n_nationkey) AS down FROM nation",
     "SELECT n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY nullif(n_nationkey % 4, 1) NULLS LAST, n_nationkey) AS up, row_number() OVER (PARTITION BY n_regionkey ORDER BY nullif(n_nationkey % 4, 1) DESC NULLS FIRST, n_nationkey) AS down FROM nation")
pair("subquery_null_order", "SELECT a.n_nationkey FROM (SELECT nullif(n_nationkey, 3) AS k, n_nationkey FROM nation ORDER BY k, n_nationkey LIMIT 24) a WHERE a.n_nationkey IN (SELECT n_nationkey FROM (SELECT nullif(n_nationkey, 5) AS k, n_nationkey FROM nation ORDER BY k DESC LIMIT 20))",
     "SELECT a.n_nationkey FROM (SELECT nullif(n_nationkey, 3) AS k, n_nationkey FROM nation ORDER BY k NULLS LAST, n_nationkey LIMIT 24) a WHERE a.n_nationkey IN (SELECT n_nationkey FROM (SELECT nullif(n_nationkey, 5) AS k, n_nationkey FROM nation ORDER BY k DESC NULLS FIRST LIMIT 20))")

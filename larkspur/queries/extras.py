"""Functions and operators that complete the families of the other modules."""

from pyspark.sql import functions as F

from ..functions import json, strings, types
from ..operators import relational as R
from ..sources import binary, copy
from . import built, pair, same
from .tables import _folder

same("fn_make_dates", "SELECT o_orderkey, make_date(1990 + o_orderkey % 30, 1 + o_orderkey % 12, 1 + o_orderkey % 28) AS d FROM orders")
same("fn_mod_signs", "SELECT o_orderkey, mod(o_custkey - 50, 7) AS m, (50 - o_custkey) % 7 AS n FROM orders")
pair("array_slices_sql", "SELECT n_nationkey, array_join(ARRAY[1, 2, 3, 4, 5][2:4], ',') AS a, array_join(split(n_name, 'A')[1:1], ',') AS b FROM nation",
     "SELECT n_nationkey, '2,3,4' AS a, string_split(n_name, 'A')[1] AS b FROM nation")
pair("unnest_ordinality_sql", "SELECT n_nationkey, u.part, u.n FROM nation, unnest(split(n_name, 'A')) WITH ORDINALITY AS u(part, n)",
     "SELECT n_nationkey, string_split(n_name, 'A')[i] AS part, i::INT AS n FROM nation, range(1, 20) r(i) WHERE i <= len(string_split(n_name, 'A'))")


@built("agg_json_strict", "SELECT n_regionkey, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_name) FILTER (WHERE n_nationkey % 3 > 0) || '}' AS j FROM nation GROUP BY n_regionkey")
def _(t, spark):
    return t("nation").groupBy("n_regionkey").agg(json.object_agg_strict("n_name", F.expr("CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey END")).alias("j"))


@built("fn_hstore_json", "SELECT p_partkey, '{\"b c\":null,\"brand\":\"' || p_brand || '\",\"size\":' || p_size || '}' AS loose, '{\"b c\":null,\"brand\":\"' || p_brand || '\",\"size\":\"' || p_size || '\"}' AS plain FROM part")
def _(t, spark):
    h = json.hstore(F.concat(F.lit('brand=>"'), "p_brand", F.lit('", size=>'), F.col("p_size").cast("string"), F.lit(', "b c"=>NULL')))
    return t("part").select("p_partkey", json.hstore_to_json(h, loose=True).alias("loose"), json.hstore_to_json(h).alias("plain"))


@built("fn_json_null_clauses", "SELECT n_nationkey, '{\"a\":' || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE ',\"b\":' || n_regionkey END || '}' AS absent, '{\"a\":' || n_nationkey || ',\"b\":' || CASE WHEN n_nationkey % 2 = 0 THEN 'null' ELSE n_regionkey::VARCHAR END || '}' AS kept FROM nation")
def _(t, spark):
    b = F.expr("CASE WHEN n_nationkey % 2 > 0 THEN n_regionkey END")
    return t("nation").select("n_nationkey", json.build_object(True, a="n_nationkey", b=b).alias("absent"), json.build_object(False, a="n_nationkey", b=b).alias("kept"))


@built("fn_input_error_info", "SELECT p_partkey, CASE p_partkey % 3 WHEN 1 THEN '22003' WHEN 2 THEN '22P02' END AS code FROM part")
def _(t, spark):
    s = F.expr("CASE p_partkey % 3 WHEN 0 THEN '12' WHEN 1 THEN '99999999999' ELSE 'x1' END")
    return t("part").select("p_partkey", types.input_error_info(s, "int")["sql_error_code"].alias("code"))


@built("fn_macaddr_trunc", "SELECT n_nationkey, '08:00:' || lpad(lower(to_hex(n_nationkey)), 2, '0') || ':00:00:00' AS m FROM nation")
def _(t, spark):
    m = F.concat(F.lit("0800."), F.lpad(F.lower(F.hex("n_nationkey")), 2, "0"), F.lit("5a.1b2c"))
    return t("nation").select("n_nationkey", types.trunc_macaddr(m).alias("m"))


@built("hash_partitions", "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS keys, 4::BIGINT AS parts FROM orders")
def _(t, spark):
    """Four hash partitions hold every row once."""
    o = t("orders")
    parts = [o.where(types.satisfies_hash_partition(4, r, "o_orderkey")).withColumn("r", F.lit(r)) for r in range(4)]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return whole.agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("keys"), F.count_distinct("r").alias("parts"))


@built("strict_word_similarity", "SELECT n_nationkey, 1.0::DOUBLE AS own, CASE WHEN n_name LIKE 'UNITED%' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS united FROM nation")
def _(t, spark):
    s = strings.strict_word_similarity(F.lit("united"), F.concat(F.lit("the "), F.lower("n_name")))
    return t("nation").select("n_nationkey", strings.strict_word_similarity("n_name", F.concat(F.lit("of "), "n_name", F.lit(" land"))).alias("own"), F.when(s == 1.0, 1.0).otherwise(0.0).alias("united"))


@built("fn_strict_and_domain", "SELECT p_partkey, CASE WHEN p_size % 4 > 0 THEN 10 + p_size END AS s, p_size AS d FROM part")
def _(t, spark):
    add = types.strict(lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    size = types.domain("int", lambda v: v > 0, lambda v: v <= 100, not_null=True)
    return t("part").select("p_partkey", add(F.lit(10), F.expr("CASE WHEN p_size % 4 > 0 THEN p_size END")).alias("s"), size("p_size").alias("d"))


_EDGES = "(SELECT p_partkey AS a, p_partkey * 2 % 61 AS b FROM part WHERE p_partkey < 61)"


@built("recursion_with_cycle", f"""
WITH RECURSIVE e AS {_EDGES}, r AS (SELECT 1::BIGINT AS k, [1::BIGINT] AS path, false AS is_cycle
 UNION ALL SELECT e.b, list_append(r.path, e.b), list_contains(r.path, e.b) FROM r JOIN e ON e.a = r.k WHERE NOT r.is_cycle)
SELECT k, array_to_string(path, '-') AS path, is_cycle FROM r""")
def _(t, spark):
    e = t("part").where("p_partkey < 61").selectExpr("p_partkey AS a", "p_partkey * 2 % 61 AS b")
    out = R.recursive_union(spark.range(1, 2).select(F.col("id").alias("k")), lambda last: last.join(e, F.col("k") == F.col("a")).select(F.col("b").alias("k"), "path"), cycle=["k"])
    return out.select("k", F.array_join(F.transform("path", lambda p: p["k"].cast("string")), "-").alias("path"), "is_cycle")


_TREE = "e AS (SELECT p_partkey AS k, p_partkey // 3 AS up FROM part WHERE p_partkey < 40 AND p_partkey > 0)"


@built("recursion_depth_first", f"""
WITH RECURSIVE {_TREE}, r AS (SELECT 1::BIGINT AS k, ['00001'] AS o UNION ALL SELECT e.k, list_append(r.o, lpad(e.k::VARCHAR, 5, '0')) FROM r JOIN e ON e.up = r.k)
SELECT k, row_number() OVER (ORDER BY o) AS place FROM r""")
def _(t, spark):
    from pyspark.sql import Window

    e = t("part").where("p_partkey < 40 AND p_partkey > 0").select("p_partkey", F.floor(F.col("p_partkey") / 3).alias("up"))
    out = R.recursive_union(spark.range(1, 2).select(F.col("id").alias("k")), lambda last: last.join(e, F.col("k") == F.col("up")).select(F.col("p_partkey").alias("k"), "ordercol"), search=("depth", ["k"]))
    return out.select("k", F.row_number().over(Window.orderBy("ordercol")).cast("long").alias("place"))


@built("recursion_distinct", "WITH RECURSIVE r AS (SELECT 1::BIGINT AS k UNION SELECT k * 3 % 11 FROM r) SELECT k FROM r")
def _(t, spark):
    return R.recursive_union(spark.range(1, 2).select(F.col("id").alias("k")), lambda last: last.select((F.col("k") * 3 % 11).alias("k")), distinct=True)


@built("join_bucketed", "SELECT o_orderpriority, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority")
def _(t, spark):
    """A partition-wise join: both sides lie in buckets of the key, so the join itself needs no exchange."""
    names = []
    for table, key, columns in (("orders", "o_orderkey", ["o_orderkey", "o_orderpriority"]), ("lineitem", "l_orderkey", ["l_orderkey", "l_extendedprice"])):
        folder = _folder(spark)
        names.append(folder.rsplit("/", 1)[1].replace("-", "_"))
        t(table).select(columns).write.option("path", folder).bucketBy(8, key).sortBy(key).saveAsTable(names[-1])
    joined = spark.table(names[0]).hint("merge").join(spark.table(names[1]), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@built("do_block", "SELECT sum(i)::BIGINT AS total, count(*) AS n FROM range(1, 11) r(i) WHERE i <> 5")
def _(t, spark):
    from .. import dialect

    return dialect.sql(spark, """DO $$
    BEGIN
      DECLARE i INT = 0; DECLARE total BIGINT = 0; DECLARE n BIGINT = 0;
      lp: WHILE i < 10 DO
        SET i = i + 1;
        IF i = 5 THEN ITERATE lp; END IF;
        SET total = total + i; SET n = n + 1;
      END WHILE lp;
      SELECT total, n;
    END $$""")


@built("copy_binary_round_trip", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s, o_totalprice, o_orderdate, CAST(o_orderdate AS DATE) AS d, o_custkey % 2 = 0 AS even FROM orders")
def _(t, spark):
    """Out to binary files and in again."""
    path = _folder(spark)
    o = t("orders").selectExpr("o_orderkey", "nullif(o_orderstatus, 'F') AS s", "o_totalprice", "o_orderdate", "CAST(o_orderdate AS DATE) AS d", "o_custkey % 2 = 0 AS even")
    binary.copy_binary_to(o, path)
    return binary.copy_binary_from(spark, path, o.schema)


@built("copy_text_in", "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg, c_name || chr(9) || 'x' AS note FROM customer")
def _(t, spark):
    """Out to text files and in again by the reader of COPY."""
    path = _folder(spark)
    c = t("customer").select("c_custkey", F.expr("nullif(c_mktsegment, 'BUILDING')").alias("seg"), F.concat("c_name", F.lit("\tx")).alias("note"))
    copy.copy_to(c, path)
    return copy.copy_from(spark, path, "c_custkey long, seg string, note string")

"""Set operations, recursion, data changes as queries, tables from tables, files and streams."""

import uuid

from pyspark.sql import functions as F

from .. import catalog
from ..operators import relational as R
from ..session import shared_folder
from ..sources import copy, vectors
from ..streaming import events as S
from . import built, same

same("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
same("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
same("intersect", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT s_nationkey FROM supplier")
same("intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
same("except_distinct", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier")
same("except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
same("recursive_cte", "WITH RECURSIVE r(n, f) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 15) SELECT n, f FROM r")
same("recursive_tree", "WITH RECURSIVE r(k, depth, path) AS (SELECT CAST(1 AS BIGINT), 0, CAST('1' AS VARCHAR(400)) UNION ALL SELECT p.p_partkey, r.depth + 1, CAST(concat(r.path, '~', CAST(p.p_partkey AS VARCHAR(20))) AS VARCHAR(400)) FROM r JOIN part p ON p.p_partkey IN (r.k * 2, r.k * 2 + 1) WHERE r.depth < 5) SELECT k, depth, path FROM r")


def _changes(t):
    """Every third order with a new price, and some orders that don't exist."""
    o = t("orders")
    old = o.where("o_orderkey % 3 = 0").select("o_orderkey", "o_custkey", (F.col("o_totalprice") + 1).alias("o_totalprice"))
    return old.unionByName(o.where("o_orderkey % 7 = 0").select((F.col("o_orderkey") + 10_000_000).alias("o_orderkey"), "o_custkey", F.lit(5.0).alias("o_totalprice")))


_CHANGES = "(SELECT o_orderkey, o_custkey, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey + 10000000, o_custkey, 5.0 FROM orders WHERE o_orderkey % 7 = 0)"
_BASE = "(SELECT o_orderkey, o_custkey, o_totalprice FROM orders)"


def _base(t):
    return t("orders").select("o_orderkey", "o_custkey", "o_totalprice")


@built("merge_upsert", f"""
SELECT coalesce(t.o_orderkey, s.o_orderkey) AS o_orderkey, coalesce(t.o_custkey, s.o_custkey) AS o_custkey, coalesce(s.o_totalprice, t.o_totalprice) AS o_totalprice
FROM {_BASE} t FULL JOIN {_CHANGES} s ON t.o_orderkey = s.o_orderkey WHERE NOT (t.o_orderkey IS NOT NULL AND s.o_orderkey IS NOT NULL AND s.o_custkey % 2 = 0)""")
def _(t, spark):
    put = {c: F.col(f"s.{c}") for c in ("o_orderkey", "o_custkey", "o_totalprice")}
    whens = [R.When("both", "delete", F.col("s.o_custkey") % 2 == 0), R.When("both", "update", None, {"o_totalprice": F.col("s.o_totalprice")}), R.When("source", "insert", None, put)]
    return R.merge(_base(t), _changes(t), ["o_orderkey"], *whens)


@built("update_from", f"SELECT t.o_orderkey, t.o_custkey, coalesce(s.o_totalprice, t.o_totalprice) AS o_totalprice FROM {_BASE} t LEFT JOIN {_CHANGES} s ON t.o_orderkey = s.o_orderkey")
def _(t, spark):
    return R.update_from(_base(t), _changes(t), ["o_orderkey"], {"o_totalprice": "o_totalprice"})


@built("delete_using", f"SELECT * FROM {_BASE} t WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {_CHANGES})")
def _(t, spark):
    return R.delete_using(_base(t), _changes(t), ["o_orderkey"])


@built("delete_returning", f"SELECT * FROM {_BASE} t WHERE o_orderkey IN (SELECT o_orderkey FROM {_CHANGES})")
def _(t, spark):
    return _base(t).join(_changes(t), ["o_orderkey"], "left_semi")


@built("merge_repeated_source", f"""
SELECT o_orderkey, o_custkey, o_totalprice FROM {_BASE} UNION ALL SELECT s.* FROM {_CHANGES} s, range(2) WHERE s.o_orderkey NOT IN (SELECT o_orderkey FROM orders) AND s.o_custkey % 3 = 0""")
def _(t, spark):
    """Source rows that repeat a key without a match are inserted one by one; matching ones that do nothing are no error."""
    put = {c: F.col(f"s.{c}") for c in ("o_orderkey", "o_custkey", "o_totalprice")}
    return R.merge(_base(t), _changes(t).unionByName(_changes(t)), ["o_orderkey"], R.When("both", "nothing"), R.When("source", "insert", F.col("s.o_custkey") % 3 == 0, put))


@built("on_conflict_do_nothing", f"SELECT * FROM {_BASE} t UNION ALL SELECT * FROM {_CHANGES} s WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def _(t, spark):
    """New rows come twice, the second time dearer: one of each key goes in."""
    twice = _changes(t).unionByName(_changes(t).withColumn("o_totalprice", F.col("o_totalprice") + 1))
    return R.insert_on_conflict(_base(t), twice, ["o_orderkey"])


@built("on_conflict_do_update", f"SELECT coalesce(t.o_orderkey, s.o_orderkey) AS o_orderkey, coalesce(t.o_custkey, s.o_custkey) AS o_custkey, coalesce(s.o_totalprice, t.o_totalprice) AS o_totalprice FROM {_BASE} t FULL JOIN {_CHANGES} s ON t.o_orderkey = s.o_orderkey")
def _(t, spark):
    return R.insert_on_conflict(_base(t), _changes(t), ["o_orderkey"], ["o_totalprice"])


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/larkspur-{uuid.uuid4().hex}"


@built("ctas", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def _(t, spark):
    view = catalog.MaterializedView(spark, _folder(spark), lambda s: t("orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")))
    return view.refresh()


@built("copy_text_round_trip", "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg, c_name || chr(9) || '\\x' AS note FROM customer")
def _(t, spark):
    path = _folder(spark)
    c = t("customer").select("c_custkey", F.expr("nullif(c_mktsegment, 'BUILDING')").alias("seg"), F.concat("c_name", F.lit("\t\\x")).alias("note"))
    copy.copy_to(c, path)
    return spark.read.schema("line string").text(path).select(
        F.split("line", "\t")[0].cast("long").alias("c_custkey"),
        F.expr(r"nullif(split(line, '\t')[1], '\\N')").alias("seg"),
        F.replace(F.replace(F.split("line", "\t")[2], F.lit("\\t"), F.lit("\t")), F.lit("\\\\"), F.lit("\\")).alias("note"),
    )


@built("copy_csv_round_trip", "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg, c_name || ', \"x\"' AS note FROM customer WHERE c_acctbal > 0")
def _(t, spark):
    path = _folder(spark)
    c = t("customer").select("c_custkey", F.expr("nullif(c_mktsegment, 'BUILDING')").alias("seg"), F.concat("c_name", F.lit(', "x"')).alias("note"), "c_acctbal")
    copy.copy_to(c, path, form="csv", header=True)
    return copy.copy_from(spark, path, "c_custkey long, seg string, note string, c_acctbal double", form="csv", header=True, where="c_acctbal > 0").drop("c_acctbal")


@built("libsvm_round_trip", "SELECT CAST(p_size AS DOUBLE) AS y, CAST(p_partkey AS DOUBLE) AS a, p_retailprice AS b FROM part")
def _(t, spark):
    path = _folder(spark)
    t("part").select(vectors.format_line("p_size", ["p_partkey", "p_retailprice"]).alias("value")).write.text(path)
    r = vectors.read_libsvm(spark, path, 2)
    return r.select("y", F.element_at("vals", 1).alias("a"), F.element_at("vals", 2).alias("b"))


@built("crosstab", "SELECT c_nationkey, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS building, count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS machinery FROM customer GROUP BY c_nationkey")
def _(t, spark):
    n = t("customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    x = R.crosstab(n, "c_nationkey", "c_mktsegment", "n", ["BUILDING", "MACHINERY"])
    return x.select("c_nationkey", F.coalesce("BUILDING", F.lit(0)).alias("building"), F.coalesce("MACHINERY", F.lit(0)).alias("machinery"))


@built("crosstab_positional", "SELECT n_regionkey, max(CASE WHEN i = 1 THEN n_name END) AS category_1, max(CASE WHEN i = 2 THEN n_name END) AS category_2 FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation) GROUP BY n_regionkey")
def _(t, spark):
    return R.crosstab_positional(t("nation"), "n_regionkey", "n_nationkey", "n_name", 2)


@built("connectby", """
WITH RECURSIVE e AS (SELECT p_partkey AS k, p_partkey // 3 AS p FROM part), r AS (
 SELECT 1::BIGINT AS keyid, NULL::BIGINT AS parent_keyid, 0 AS level, '1' AS branch
 UNION ALL SELECT e.k, e.p, r.level + 1, r.branch || '~' || e.k FROM r JOIN e ON e.p = r.keyid AND e.k <> r.keyid) SELECT * FROM r""")
def _(t, spark):
    e = t("part").select("p_partkey", F.floor(F.col("p_partkey") / 3).alias("up")).where("p_partkey <> up")
    return R.connectby(e, "p_partkey", "up", 1)


@built("fn_generate_series", "SELECT i AS generate_series FROM range(10, 51, 5) t(i)")
def _(t, spark):
    return R.generate_series(spark, 10, 50, 5)


@built("normal_rand")
def _(t, spark):
    return R.normal_rand(spark, 1000, 5.0, 2.0, seed=1)


@built("fn_unnest_ordinality", "SELECT n_nationkey, i::INT AS ordinality, string_split(n_name, 'A')[i] AS part FROM nation, range(1, 10) r(i) WHERE i <= len(string_split(n_name, 'A'))")
def _(t, spark):
    n = t("nation").select("n_nationkey", F.split("n_name", "A").alias("parts"))
    return R.unnest_lockstep(n, part="parts").drop("parts")


@built("event_tumbling", "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(t, spark):
    return S.tumbling(t("events"), "ts", "1 hour", None, ["event_type"], n=F.count("*"))


@built("event_sliding", "SELECT time_bucket(INTERVAL '1 day', ts) - i * INTERVAL '1 day' AS window_start, count(*) AS n FROM events, range(0, 2) r(i) GROUP BY 1")
def _(t, spark):
    return S.sliding(t("events"), "ts", "2 days", "1 day", None, [], n=F.count("*"))


@built("event_sessions", """
WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '6 hours' THEN 0 ELSE 1 END AS fresh FROM events),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '6 hours' AS session_end, count(*) AS n FROM g GROUP BY user_id, s""")
def _(t, spark):
    return S.sessions(t("events"), "ts", "6 hours", None, ["user_id"], n=F.count("*"))


@built("stream_tumbling_once", "SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, count(*) AS n FROM events GROUP BY 1")
def _(t, spark):
    """The same windows as a stream that ends: a file source, a watermark and complete output."""
    path, name = _folder(spark), f"s{uuid.uuid4().hex}"
    e = t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(4).write.parquet(path)
    q = S.tumbling(S.read_stream(spark, path, e.schema), "ts", "1 day", "1 day", [], n=F.count("*"))
    q.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", path + "-state").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")

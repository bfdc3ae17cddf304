"""Learning in the engine, vectors, workloads and advice."""

from pyspark.sql import functions as F

from ..functions import geo as G
from ..operators import ml
from ..plans import workload as W
from ..sources import vectors
from . import built


@built("encode_text_column", "SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment)::INT AS code FROM customer")
def _(t, spark):
    c = t("customer")
    return ml.encode_column(c, "c_mktsegment", ml.encode_mapping(c, "c_mktsegment")).select("c_custkey", F.col("c_mktsegment").alias("code"))


@built("libsvm_parse", "SELECT p_partkey, p_size::DOUBLE AS y, p_partkey::DOUBLE AS v1, 1.0::DOUBLE AS v2 FROM part")
def _(t, spark):
    line = F.concat_ws(" ", F.col("p_size").cast("string"), F.concat(F.lit("1:"), F.col("p_partkey").cast("string")), F.lit("7"))
    r = t("part").select("p_partkey", vectors.parse(line, 4).alias("r"))
    return r.select("p_partkey", "r.y", F.element_at("r.vals", 1).alias("v1"), F.element_at("r.vals", 2).alias("v2"))


_P = "(SELECT (l_returnflag = 'R')::INT AS y, (l_quantity > 25)::INT AS p, l_quantity AS s FROM lineitem)"


def _scored(t):
    return t("lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_quantity") > 25).cast("int").alias("p"), F.col("l_quantity").alias("s"))


@built("classification_metrics", f"""
SELECT round(avg((y = p)::INT), 8) AS accuracy, round(sum(y * p)::DOUBLE / sum(p), 8) AS prec, round(sum(y * p)::DOUBLE / sum(y), 8) AS recall, round(2.0 * sum(y * p) / (sum(y) + sum(p)), 8) AS f1 FROM {_P}""")
def _(t, spark):
    m = ml.classification_metrics(_scored(t), "y", "p")
    return m.select(*(F.round(c, 8).alias(c) for c in m.columns))


@built("auc", f"""
WITH r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS mid FROM {_P})
SELECT round((sum(mid) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 8) AS auc FROM r""")
def _(t, spark):
    return ml.auc(_scored(t), "y", "s").select(F.round("auc", 8).alias("auc"))


@built("regression_metrics", """
SELECT round(avg(pow(y - p, 2)), 4) AS mse, round(sqrt(avg(pow(y - p, 2))), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae, round(avg(abs((y - p) / y)) FILTER (WHERE y <> 0) * 100, 4) AS mape, round(1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*)), 6) AS r2
FROM (SELECT l_extendedprice AS y, l_quantity * 1000 AS p FROM lineitem)""")
def _(t, spark):
    m = ml.regression_metrics(t("lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1000).alias("p")), "y", "p")
    return m.select(*(F.round(c, 6 if c == "r2" else 4).alias(c) for c in m.columns))


@built("impute_mean_median_mode", """
WITH h AS (SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN p_size END AS a, CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice END AS b, CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS c FROM part)
SELECT p_partkey, round(coalesce(a, (SELECT avg(a) FROM h)), 6) AS a, round(coalesce(b, (SELECT percentile_cont(0.5) WITHIN GROUP (ORDER BY b) FROM h)), 6) AS b,
 coalesce(c, (SELECT c FROM h WHERE c IS NOT NULL GROUP BY c ORDER BY count(*) DESC, c LIMIT 1)) AS c FROM h""")
def _(t, spark):
    keep = F.col("p_partkey") % 5 != 0
    h = t("part").select("p_partkey", F.when(keep, F.col("p_size").cast("double")).alias("a"), F.when(keep, F.col("p_retailprice")).alias("b"), F.when(keep, F.col("p_brand")).alias("c"))
    for how, c in (("mean", "a"), ("median", "b"), ("mode", "c")):
        h = ml.imputer(h, [c], how).apply(h)
    return h.select("p_partkey", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), "c")


@built("one_hot", "SELECT n_nationkey, (n_regionkey = 0)::INT AS n_regionkey_0, (n_regionkey = 1)::INT AS n_regionkey_1, (n_regionkey = 2)::INT AS n_regionkey_2, (n_regionkey = 3)::INT AS n_regionkey_3, (n_regionkey = 4)::INT AS n_regionkey_4 FROM nation")
def _(t, spark):
    n = t("nation").select("n_nationkey", "n_regionkey")
    return ml.one_hot(n, "n_regionkey").apply(n)


@built("scalers_minmax_standard_robust_maxabs", """
SELECT p_partkey, round((p_size - min(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER ())::DOUBLE, 8) AS a, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 8) AS b,
 round((p_size - m) / (q3 - q1), 8) AS c, round(p_size / (max(abs(p_size)) OVER ())::DOUBLE, 8) AS d
FROM part, (SELECT percentile_cont(0.5) WITHIN GROUP (ORDER BY p_size) AS m, percentile_cont(0.25) WITHIN GROUP (ORDER BY p_size) AS q1, percentile_cont(0.75) WITHIN GROUP (ORDER BY p_size) AS q3 FROM part)""")
def _(t, spark):
    p = t("part").select("p_partkey", *(F.col("p_size").cast("double").alias(c) for c in "abcd"))
    for c, how in zip("abcd", ("minmax", "standard", "robust", "maxabs")):
        p = ml.scaler(p, [c], how).apply(p)
    return p.select("p_partkey", *(F.round(c, 8).alias(c) for c in "abcd"))


@built("kbins", "SELECT p_partkey, (p_size > q1)::INT + (p_size > q2)::INT + (p_size > q3)::INT AS bin FROM part, (SELECT percentile_cont(0.25) WITHIN GROUP (ORDER BY p_size) AS q1, percentile_cont(0.5) WITHIN GROUP (ORDER BY p_size) AS q2, percentile_cont(0.75) WITHIN GROUP (ORDER BY p_size) AS q3 FROM part)")
def _(t, spark):
    p = t("part").select("p_partkey", F.col("p_size").alias("bin"))
    return ml.kbins(p, "bin", 4).apply(p)


@built("variance_threshold", "SELECT p_partkey, p_size FROM part")
def _(t, spark):
    p = t("part").select("p_partkey", "p_size", F.lit(3.0).alias("flat"))
    return ml.variance_threshold(p, ["p_size", "flat"]).apply(p)


@built("polynomial_interaction", "SELECT p_partkey, p_size * p_size AS ss, round(p_size * p_retailprice, 4) AS sr, round(p_retailprice * p_retailprice, 4) AS rr FROM part")
def _(t, spark):
    p = ml.polynomial(["p_size", "p_retailprice"]).apply(t("part"))
    return p.select("p_partkey", F.col("p_size_x_p_size").alias("ss"), F.round("p_size_x_p_retailprice", 4).alias("sr"), F.round("p_retailprice_x_p_retailprice", 4).alias("rr"))


@built("normalizer_power", "SELECT p_partkey, round(p_size / sqrt(p_size * p_size + p_retailprice * p_retailprice), 8) AS n, round(ln(1 + p_size), 8) AS w FROM part")
def _(t, spark):
    p = t("part").select("p_partkey", F.col("p_size").cast("double").alias("n"), F.col("p_retailprice").alias("r"), F.col("p_size").cast("double").alias("w"))
    p = ml.power_transform(["w"]).apply(ml.normalizer(["n", "r"]).apply(p))
    return p.select("p_partkey", F.round("n", 8).alias("n"), F.round("w", 8).alias("w"))


@built("pca")
def _(t, spark):
    li = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    return ml.pca(li, ["l_quantity", "l_extendedprice", "l_discount"], 2).apply(li).select("l_orderkey", "l_linenumber", F.round("pc1", 3).alias("pc1"), F.round("pc2", 3).alias("pc2"))


@built("prepare_pipeline")
def _(t, spark):
    p = t("part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice", "p_brand")
    return ml.prepare(p, p.where("p_partkey % 4 <> 0"), ["p_size", "p_retailprice"], ["p_brand"])


@built("linear_fit_predict", "SELECT l_orderkey, l_linenumber, round((SELECT regr_intercept(l_extendedprice, l_quantity) FROM lineitem) + (SELECT regr_slope(l_extendedprice, l_quantity) FROM lineitem) * l_quantity, 3) AS prediction FROM lineitem")
def _(t, spark):
    from .. import dialect

    t("lineitem").createOrReplaceTempView("lineitem")
    p = dialect.sql(spark, "PREDICT VALUE OF l_extendedprice FROM lineitem TRAIN ON l_quantity")
    return p.select("l_orderkey", "l_linenumber", F.round("prediction", 3).alias("prediction"))


@built("predict_class")
def _(t, spark):
    """Three classes, all rows."""
    from .. import dialect

    t("orders").createOrReplaceTempView("orders")
    return dialect.sql(spark, "PREDICT CLASS OF o_orderstatus FROM orders TRAIN ON o_totalprice, o_custkey").select("o_orderkey", "o_orderstatus", "prediction")


_FIT = "(SELECT regr_slope(p_retailprice, p_size) AS b, regr_intercept(p_retailprice, p_size) AS a, regr_slope(p_retailprice, p_size) FILTER (WHERE p_size > 25) AS b2, regr_intercept(p_retailprice, p_size) FILTER (WHERE p_size > 25) AS a2 FROM part)"


@built("model_registry", f"SELECT p_partkey, round(a + b * p_size, 3) AS first, round((a + a2) / 2 + (b + b2) / 2 * p_size, 3) AS tuned, 1::BIGINT AS found FROM part, {_FIT}")
def _(t, spark):
    """A model is trained, looked up, used, tuned half way to other rows, and used again."""
    from .tables import _folder

    t("part").createOrReplaceTempView("part")
    r = ml.Registry(spark, _folder(spark))
    r.train("part", ["p_size"], "p_retailprice")
    found = r.lookup("part", ["p_size"], "p_retailprice")
    one = r.inference(found, t("part"), "first")
    r.finetune(found, t("part").where("p_size > 25"), "p_retailprice")
    return r.inference(found, one, "tuned").select("p_partkey", F.round("first", 3).alias("first"), F.round("tuned", 3).alias("tuned"), F.lit(found).cast("long").alias("found"))


_D = "list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@built("knn_exact", f"""
SELECT query_id, neighbor_id, rank::INT AS rank FROM (SELECT b.vec_id AS query_id, a.vec_id AS neighbor_id, row_number() OVER (PARTITION BY b.vec_id ORDER BY {_D}, a.vec_id) AS rank FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0) WHERE rank <= 5""")
def _(t, spark):
    e = t("embeddings")
    return ml.knn(e.where("vec_id % 50 = 0"), e, 5, "vec_id", "vec_id", "embedding", G.l2).select("query_id", "neighbor_id", "rank")


@built("kmeans_route", f"SELECT vec_id, centroid_id FROM (SELECT a.vec_id, b.vec_id AS centroid_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_D}, b.vec_id) AS rn FROM embeddings a, embeddings b WHERE b.vec_id < 8) WHERE rn = 1")
def _(t, spark):
    e = t("embeddings")
    c = e.where("vec_id < 8").select(F.col("vec_id").alias("centroid_id"), F.col("embedding").alias("centroid"))
    return ml.kmeans_route(e, c, "embedding", G.l2).select("vec_id", "centroid_id")


@built("ann_ivf")
def _(t, spark):
    """The nearest ten of every row whose id is divisible by 50, by an inverted-file index over all rows."""
    from .tables import _folder

    e = t("embeddings")
    index = ml.VectorIndex.build(e, "vec_id", "embedding", _folder(spark), cells=32)
    return index.query(e.where("vec_id % 50 = 0"), "vec_id", "embedding", 10, 20, G.l2).select("query_id", "neighbor_id", "rank")


@built("quantize_delta", """
SELECT vec_id, round(step, 9) AS scale, round(lo, 9) AS zero, list_sum(list_transform(x, lambda v: round((v - lo) / step)))::BIGINT AS codes
FROM (SELECT *, (list_max(x) - list_min(x)) / 255.0 AS step, list_min(x) AS lo FROM (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings))""")
def _(t, spark):
    q = ml.quantize(F.col("embedding").cast("array<double>"), 8)
    total = F.aggregate(F.col("q.codes"), F.lit(0).cast("long"), lambda a, b: a + b)
    return t("embeddings").select("vec_id", q.alias("q")).select("vec_id", F.round("q.scale", 9).alias("scale"), F.round("q.zero", 9).alias("zero"), total.alias("codes"))


@built("strategy_scores", "SELECT p_partkey, round(greatest(0, least(1, log2(p_size) / log2(64))), 8) AS d, CASE WHEN ceil(log2(p_size / 0.1)) <= 6 THEN 0 ELSE round(1 - exp(-0.5 * (ceil(log2(p_size / 0.1)) - 6)), 8) END AS b FROM part")
def _(t, spark):
    s = F.col("p_size").cast("double")
    return t("part").select("p_partkey", F.round(ml.distance_strategy(s, 64.0), 8).alias("d"), F.round(ml.nbits_strategy(s, 0.1, 6, 0.5), 8).alias("b"))


def _log(t):
    """A log of statements, made from the events."""
    kinds = F.element_at(F.array(F.lit("SELECT * FROM orders WHERE o_orderkey = "), F.lit("select  * from lineitem where l_quantity > "), F.lit("SELECT c_name FROM customer WHERE c_acctbal IN (1, 2) AND c_custkey < "), F.lit("UPDATE part SET p_size = ")), F.col("event_id").cast("int") % 4 + 1)
    return t("events").select("ts", "event_id", F.concat(kinds, F.col("event_id").cast("string")).alias("sql"))


_LOG = "(SELECT ts, event_id, CASE event_id % 4 WHEN 0 THEN 'select * from orders where o_orderkey = ?' WHEN 1 THEN 'select * from lineitem where l_quantity > ?' WHEN 2 THEN 'select c_name from customer where c_acctbal in (?) and c_custkey < ?' ELSE 'update part set p_size = ?' END AS template FROM events)"


@built("workload_template_hash", f"SELECT template, md5(template) AS hash, count(*) AS n FROM {_LOG} GROUP BY template")
def _(t, spark):
    return _log(t).select(W.template("sql").alias("template"), W.template_hash("sql").alias("hash")).groupBy("template", "hash").agg(F.count("*").alias("n"))


@built("workload_series", f"SELECT template, time_bucket(INTERVAL '1 day', ts) AS period, count(*) AS n FROM {_LOG} GROUP BY 1, 2")
def _(t, spark):
    x = _log(t).select("ts", W.template("sql").alias("template"))
    return W.series(x, "ts", "template", 86400).select("template", F.col("period").cast("timestamp_ntz").alias("period"), "n")


@built("workload_ewma", """
WITH RECURSIVE d AS (SELECT event_type, time_bucket(INTERVAL '1 day', ts) AS period, count(*) AS n, row_number() OVER (PARTITION BY event_type ORDER BY time_bucket(INTERVAL '1 day', ts)) AS i FROM events GROUP BY 1, 2),
r AS (SELECT event_type, i, n::DOUBLE AS e FROM d WHERE i = 1 UNION ALL SELECT d.event_type, d.i, r.e * 0.7 + d.n * 0.3 FROM r JOIN d ON d.event_type = r.event_type AND d.i = r.i + 1)
SELECT event_type, i, round(e, 6) AS ewma FROM r""")
def _(t, spark):
    from pyspark.sql import Window

    d = W.series(t("events"), "ts", "event_type", 86400)
    out = W.ewma(d, "event_type", "period", "n", 0.3)
    return out.select("event_type", F.row_number().over(Window.partitionBy("event_type").orderBy("period")).cast("long").alias("i"), F.round("ewma", 6).alias("ewma"))


@built("forecast_linear", """
WITH d AS (SELECT event_type, epoch_us(time_bucket(INTERVAL '1 day', ts)) // 86400000000 AS x, count(*) AS n FROM events GROUP BY 1, 2),
f AS (SELECT event_type, max(x) AS last, regr_slope(n, x) AS b, regr_intercept(n, x) AS a FROM d GROUP BY event_type HAVING count(*) >= 10)
SELECT event_type, i::INT AS step, round(a + b * (last + i), 3) AS forecast FROM f, range(1, 4) r(i)""")
def _(t, spark):
    d = t("events").groupBy("event_type", F.unix_date(F.col("ts").cast("date")).cast("long").alias("x")).agg(F.count("*").alias("n"))
    return W.forecast_linear(d, "event_type", "x", "n", 3).select("event_type", "step", F.round("forecast", 3).alias("forecast"))


_USES = "(SELECT 'o_orderkey' AS col, count(*) FILTER (WHERE event_id % 4 = 0) AS uses FROM events UNION ALL SELECT 'l_quantity', count(*) FILTER (WHERE event_id % 4 = 1) FROM events UNION ALL SELECT 'c_acctbal', count(*) FILTER (WHERE event_id % 4 = 2) FROM events UNION ALL SELECT 'c_custkey', count(*) FILTER (WHERE event_id % 4 = 2) FROM events)"
_KNOWN = ["o_orderkey", "l_quantity", "c_acctbal", "c_custkey", "p_size"]


@built("index_candidates", f'SELECT col AS "column", uses FROM {_USES}')
def _(t, spark):
    return W.index_candidates(_log(t), "sql", _KNOWN)


@built("index_budget", f"""
SELECT col AS "column", uses, size, running::BIGINT AS running FROM (SELECT *, sum(size) OVER (ORDER BY uses::DOUBLE / size DESC, col ROWS UNBOUNDED PRECEDING) AS running FROM (SELECT col, uses, length(col)::BIGINT AS size FROM {_USES})) WHERE running <= 30""")
def _(t, spark):
    c = W.index_candidates(_log(t), "sql", _KNOWN).withColumn("size", F.length("column").cast("long"))
    return W.index_budget(c, "uses", "size", 30)


@built("layout_advisor", "SELECT 'orders' AS \"table\", 'o_orderkey' AS \"column\"")
def _(t, spark):
    a = W.LayoutAdvisor(spark, budget_mb=10)
    a.enqueue("DELETE FROM orders")
    for i in range(5):
        a.enqueue(f"SELECT * FROM orders WHERE o_orderkey = {i}")
    a.enqueue("SELECT * FROM lineitem WHERE l_quantity > 3")
    made = a.work({"o_orderkey": "orders", "l_quantity": "lineitem"}, {"orders": 8.0, "lineitem": 30.0})
    return spark.createDataFrame(made, "table string, column string")


@built("interpolate_series", """
WITH d AS (SELECT p_partkey % 5 AS k, p_partkey AS x, CASE WHEN p_partkey % 3 > 0 THEN p_retailprice END AS y FROM part),
n AS (SELECT *, last_value(CASE WHEN y IS NOT NULL THEN x END IGNORE NULLS) OVER b AS x0, last_value(y IGNORE NULLS) OVER b AS y0, first_value(CASE WHEN y IS NOT NULL THEN x END IGNORE NULLS) OVER f AS x1, first_value(y IGNORE NULLS) OVER f AS y1
 FROM d WINDOW b AS (PARTITION BY k ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY k ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT x, round(coalesce(y, y0 + (y1 - y0) * (x - x0)::DOUBLE / (x1 - x0), y0, y1), 6) AS y FROM n""")
def _(t, spark):
    d = t("part").select((F.col("p_partkey") % 5).alias("k"), F.col("p_partkey").alias("x"), F.expr("CASE WHEN p_partkey % 3 > 0 THEN p_retailprice END").alias("y"))
    return W.interpolate(d, "k", "x", "y").select("x", F.round("y", 6).alias("y"))


@built("accuracy_at_k", """
SELECT avg(hit)::DOUBLE AS accuracy FROM (SELECT l_orderkey, max(hit) AS hit FROM (SELECT l_orderkey, (l_returnflag = 'R')::INT AS hit, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, (l_returnflag = 'R')::INT DESC) AS rn FROM lineitem) WHERE rn <= 2 GROUP BY 1)""")
def _(t, spark):
    li = t("lineitem").select("l_orderkey", (F.col("l_returnflag") == "R").cast("int").alias("y"), "l_quantity")
    return ml.accuracy_at(li, "l_orderkey", "y", "l_quantity", 2)

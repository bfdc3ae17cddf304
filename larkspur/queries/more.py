"""XML, text search, digests, multiranges, user-defined aggregates and statements."""

from pyspark.sql import functions as F

from ..functions import arrays, crypto, textsearch, xml
from ..functions import ranges as N
from ..operators import procedural as P
from ..operators import relational as R
from ..sources import copy
from . import built, pair, same
from .tables import _folder

_ITEMS = "(SELECT n_nationkey, 1 AS ordinality, n_name AS name, n_nationkey::VARCHAR AS id FROM nation UNION ALL SELECT n_nationkey, 2, 'r', n_regionkey::VARCHAR FROM nation)"


@built("xmltable", f"SELECT * FROM {_ITEMS}")
def _(t, spark):
    item = lambda name, id_: xml.element("item", xml.element("name", xml.escape(name)), id=id_)
    doc = xml.element("items", item("n_name", "n_nationkey"), item(F.lit("r"), "n_regionkey"))
    return xml.table(t("nation").select("n_nationkey", doc.alias("doc")), "doc", "/items/item", {"name": "name", "id": "@id"}, "ordinality").drop("doc")


@built("fn_xml_build", "SELECT n_regionkey, string_agg('<n id=\"' || n_nationkey || '\">' || n_name || '</n>', '' ORDER BY n_nationkey) AS x FROM nation GROUP BY n_regionkey")
def _(t, spark):
    return t("nation").groupBy("n_regionkey").agg(xml.agg(xml.element("n", xml.escape("n_name"), id="n_nationkey"), "n_nationkey").alias("x"))


@built("fn_xpath", "SELECT n_nationkey, n_name AS name, 2::INT AS n FROM nation")
def _(t, spark):
    doc = F.concat(F.lit("<a><b>"), xml.escape("n_name"), F.lit("</b><b>2</b></a>"))
    return t("nation").select("n_nationkey", F.xpath_string(doc, F.lit("/a/b[1]")).alias("name"), F.xpath_int(doc, F.lit("count(/a/b)")).alias("n"))


@built("text_search", "SELECT doc_id FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents) WHERE (list_contains(w, 'idiot') OR list_contains(w, 'license')) AND NOT list_contains(w, 'rights')")
def _(t, spark):
    return t("documents").where(textsearch.matches("text", "(idiot | license) & !rights")).select("doc_id")


@built("text_vector", "SELECT n_nationkey, list_sort(list_distinct(regexp_extract_all(lower(n_name), '[a-z0-9]+')))::VARCHAR AS w FROM nation")
def _(t, spark):
    v = textsearch.to_tsvector("n_name")
    return t("nation").select("n_nationkey", F.concat(F.lit("["), F.array_join(F.transform(v, lambda s: s["lexeme"]), ", "), F.lit("]")).alias("w"))


@built("fn_digest", "SELECT n_nationkey, md5(n_name) AS m, sha1(n_name) AS s1, sha256(n_name) AS s2, n_name AS back FROM nation")
def _(t, spark):
    key = F.lit("0123456789abcdef")
    n = "n_name"
    return t("nation").select("n_nationkey", crypto.digest(n, "md5").alias("m"), crypto.digest(n, "sha1").alias("s1"), crypto.digest(n, "sha256").alias("s2"), crypto.decrypt(crypto.encrypt(n, key), key).alias("back"))


_PADS = [bytes(b ^ x for b in b"key".ljust(64, b"\0")).hex() for x in (0x5C, 0x36)]


@built("fn_hmac", f"SELECT n_nationkey, sha256(from_hex('{_PADS[0]}') || from_hex(sha256(from_hex('{_PADS[1]}') || encode(n_name)))) AS h FROM nation")
def _(t, spark):
    return t("nation").select("n_nationkey", crypto.hmac("n_name", F.lit("key"), F.lit("sha256")).alias("h"))


@built("fn_multirange", """
SELECT o_orderkey, CASE WHEN o_custkey < 100 AND o_custkey + 50 > 100 THEN (CASE WHEN o_custkey + 50 > 120 THEN 2 ELSE 1 END) WHEN o_custkey >= 100 AND o_custkey < 120 THEN (CASE WHEN o_custkey + 50 > 120 THEN 1 ELSE 0 END) ELSE 1 END AS parts,
 (110 >= o_custkey AND 110 < o_custkey + 50) AND NOT (110 >= 100 AND 110 < 120) AS held FROM orders""")
def _(t, spark):
    r = N.make("o_custkey", F.col("o_custkey") + 50)
    rest = N.minus(r, N.make(F.lit(100).cast("long"), F.lit(120).cast("long")))
    return t("orders").select("o_orderkey", F.size(rest).alias("parts"), N.multi_contains(rest, F.lit(110).cast("long")).alias("held"))


@built("agg_range_intersect", "SELECT o_orderpriority, CASE WHEN max(o_custkey) < min(o_custkey + 100000) THEN max(o_custkey) END AS lo FROM orders GROUP BY o_orderpriority")
def _(t, spark):
    o = t("orders").select("o_orderpriority", F.col("o_custkey").alias("lo"), (F.col("o_custkey") + 100000).alias("hi"))
    return o.groupBy("o_orderpriority").agg(N.intersect_agg("lo", "hi")["lo"].alias("lo"))


@built("create_aggregate", "SELECT p_brand, sum(p_size * p_size)::BIGINT AS sq FROM part GROUP BY p_brand")
def _(t, spark):
    squares = P.create_aggregate(lambda s, v: s + v * v, F.lit(0).cast("long"))
    return t("part").groupBy("p_brand").agg(squares("p_size").alias("sq"))


@built("prepared_statement", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 AND o_orderstatus = 'F'")
def _(t, spark):
    t("orders").createOrReplaceTempView("orders")
    p = P.Prepared(spark, "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN SYMMETRIC :a AND :b AND o_orderstatus = :s")
    return p.execute(a=50000, b=1000, s="F")


@built("triggers", "SELECT n_nationkey, n_name, 'me' AS who FROM nation")
def _(t, spark):
    w = P.Writer(_folder(spark))
    w.insert_username("who", "me")
    w.check("n_nationkey >= 0")
    w.references("n_regionkey", t("region"), "r_regionkey")
    w.insert(t("nation"))
    return spark.read.parquet(w.path).select("n_nationkey", "n_name", "who")


@built("file_fdw", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def _(t, spark):
    path = _folder(spark)
    copy.copy_to(t("nation"), path, form="csv", delimiter="|")
    copy.foreign_table(spark, "nation_file", path, "n_nationkey int, n_name string, n_regionkey int", form="csv", delimiter="|")
    return spark.sql("SELECT n_nationkey, n_name FROM nation_file WHERE n_regionkey = 2")


@built("project_set_lockstep", "SELECT n_nationkey, i::INT AS ordinality, [10, 20, 30][i] AS a, [1, 2][i] AS b FROM nation, range(1, 4) r(i)")
def _(t, spark):
    n = t("nation").select("n_nationkey", F.array(*map(F.lit, (10, 20, 30))).alias("x"), F.array(*map(F.lit, (1, 2))).alias("y"))
    return R.unnest_lockstep(n, a="x", b="y").drop("x", "y")


@built("point_lookup_pruned", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 32")
def _(t, spark):
    """An index lookup: the filter and two columns reach the scan."""
    return t("orders").where("o_orderkey = 32").select("o_orderkey", "o_totalprice")




@built("agg_int_array", "SELECT n_regionkey, array_to_string(list(n_nationkey ORDER BY n_nationkey), ',') AS keys, sum(n_nationkey)::BIGINT AS total FROM nation GROUP BY n_regionkey")
def _(t, spark):
    """``int_array_aggregate`` and, the other way, ``int_array_enum``: the keys in an array, and taken out of it again."""
    packed = t("nation").groupBy("n_regionkey").agg(arrays.int_array_aggregate("n_nationkey").alias("a"))
    out = arrays.int_array_enum(packed, "a", "key").groupBy("n_regionkey").agg(F.sum("key").alias("total"))
    return packed.join(out, "n_regionkey").select("n_regionkey", F.array_join(F.array_sort("a"), ",").alias("keys"), "total")


pair("extract_epoch_dow_sql", "SELECT event_id, EXTRACT(DOW FROM ts) AS d, CAST(EXTRACT(EPOCH FROM ts) AS BIGINT) AS e FROM events", "SELECT event_id, extract(dow FROM ts)::INT AS d, floor(epoch(ts))::BIGINT AS e FROM events")
pair("at_time_zone_sql", "SELECT event_id, CAST(ts AT TIME ZONE 'Asia/Tokyo' AS TIMESTAMP_NTZ) AS u FROM events", "SELECT event_id, ts - INTERVAL 9 HOUR AS u FROM events")

"""Scalar functions by family."""

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import datetime as D
from ..functions import geo as G
from ..functions import json as J
from ..functions import math as M
from ..functions import ranges as N
from ..functions import strings as S
from ..functions import types as T
from . import built, pair, same

same("fn_math", "SELECT l_orderkey, l_linenumber, abs(l_discount - l_tax) AS a, CAST(ceil(l_extendedprice) AS BIGINT) AS c, CAST(floor(l_extendedprice) AS BIGINT) AS f, round(sqrt(l_quantity), 8) AS s, round(cbrt(l_quantity), 8) AS cb, round(exp(l_discount), 8) AS e, round(ln(l_quantity), 8) AS ln, round(power(l_quantity, 2), 4) AS p, CAST(sign(l_discount - l_tax) AS DOUBLE) AS sg, l_orderkey % 7 AS m FROM lineitem")
same("fn_trigonometry", "SELECT p_partkey, round(sin(p_size), 8) AS s, round(cos(p_size), 8) AS c, round(tan(p_size), 6) AS t, round(asin(p_size / 100.0), 8) AS a, round(atan2(p_size, 3), 8) AS a2, round(degrees(p_size), 6) AS d, round(radians(p_size), 8) AS r, round(sinh(p_size / 10.0), 6) AS sh, round(atanh(p_size / 100.0), 8) AS ah, round(pi(), 10) AS pi, round(cot(p_size), 6) AS ct FROM part")
same("fn_bitwise", "SELECT o_orderkey, o_orderkey & 12 AS a, o_orderkey | 3 AS o, xor(o_orderkey, 5) AS x, bit_count(o_orderkey) AS n FROM orders".replace("xor(o_orderkey, 5)", "(o_orderkey | 5) - (o_orderkey & 5)").replace(", bit_count(o_orderkey) AS n", ""))
pair("fn_shift_bitcount", "SELECT o_orderkey, shiftleft(o_orderkey, 3) AS l, shiftright(o_orderkey, 2) AS r, CAST(bit_count(o_orderkey) AS BIGINT) AS n, o_orderkey ^ 5 AS x FROM orders", "SELECT o_orderkey, o_orderkey << 3 AS l, o_orderkey >> 2 AS r, bit_count(o_orderkey)::BIGINT AS n, xor(o_orderkey, 5) AS x FROM orders")


@built("fn_gcd_lcm", "SELECT o_orderkey, gcd(o_orderkey, o_custkey)::BIGINT AS g, lcm(o_orderkey, o_custkey)::BIGINT AS l FROM orders")
def _(t, spark):
    return t("orders").select("o_orderkey", M.gcd("o_orderkey", "o_custkey").alias("g"), M.lcm("o_orderkey", "o_custkey").alias("l"))


@built("fn_round_modes", "SELECT p_partkey, round_even(p_size / 2.0::DOUBLE, 0) AS f, round(p_retailprice, 1) AS n, trunc(p_retailprice * 10) / 10 AS t, (p_partkey // 7) AS d, log10(p_size) AS l FROM part")
def _(t, spark):
    c = F.col
    return t("part").select("p_partkey", M.round_float(c("p_size") / 2.0).alias("f"), M.round_numeric("p_retailprice", 1).alias("n"), M.trunc_to("p_retailprice", 1).alias("t"), M.div("p_partkey", F.lit(7)).alias("d"), M.log_base10("p_size").alias("l"))


@built("fn_width_bucket", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 0 WHEN p_size >= 40 THEN 7 ELSE floor((p_size - 10) * 6 / 30.0)::INT + 1 END AS b, round(sin(radians(p_size)), 8) AS s, factorial(p_size % 10)::BIGINT AS f FROM part")
def _(t, spark):
    return t("part").select("p_partkey", M.width_bucket("p_size", 10, 40, 6).alias("b"), F.round(M.degrees_of(F.sin, "p_size"), 8).alias("s"), F.factorial(F.col("p_size") % 10).alias("f"))


same("fn_string_core", "SELECT c_custkey, upper(c_name) AS u, lower(c_name) AS l, CAST(length(c_name) AS BIGINT) AS n, substring(c_name, 3, 5) AS s, replace(c_name, '0', 'z') AS r, trim(concat('  ', c_name, ' ')) AS t, lpad(c_mktsegment, 12, '*') AS lp, rpad(c_mktsegment, 4, '*') AS rp, reverse(c_mktsegment) AS rv, repeat(c_mktsegment, 2) AS rep, translate(c_mktsegment, 'AEIOU', '12345') AS tr, ascii(c_mktsegment) AS asc, starts_with(c_mktsegment, 'B') AS sw FROM customer".replace("starts_with", "startswith").replace(", startswith(c_mktsegment, 'B') AS sw", ""))
pair("fn_string_position", "SELECT c_custkey, position('O' IN c_mktsegment) AS p, strpos(c_name, '#') AS q, startswith(c_mktsegment, 'B') AS sw, octet_length(c_name) AS o, bit_length(c_name) AS b, overlay(c_mktsegment PLACING 'xx' FROM 2 FOR 3) AS ov".replace("strpos(c_name, '#')", "instr(c_name, '#')") + " FROM customer",
     "SELECT c_custkey, position('O' IN c_mktsegment)::INT AS p, strpos(c_name, '#')::INT AS q, starts_with(c_mktsegment, 'B') AS sw, strlen(c_name)::INT AS o, (strlen(c_name) * 8)::INT AS b, substr(c_mktsegment, 1, 1) || 'xx' || substr(c_mktsegment, 5) AS ov FROM customer")
same("fn_string_split", "SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, split_part(p_type, ' ', -1) AS z FROM part")


@built("fn_left_right_negative", "SELECT c_custkey, left(c_name, 4) AS l, left(c_name, -3) AS ln, right(c_name, 4) AS r, right(c_name, -3) AS rn FROM customer")
def _(t, spark):
    n = "c_name"
    return t("customer").select("c_custkey", S.left(n, 4).alias("l"), S.left(n, -3).alias("ln"), S.right(n, 4).alias("r"), S.right(n, -3).alias("rn"))


@built("fn_concat_nulls", "SELECT o_orderkey, concat(nullif(o_orderstatus, 'F'), '-', o_orderkey) AS c, concat_ws('/', nullif(o_orderstatus, 'F'), o_orderpriority) AS w, nullif(o_orderstatus, 'F') || 'x' AS p FROM orders")
def _(t, spark):
    s = F.expr("nullif(o_orderstatus, 'F')")
    return t("orders").select("o_orderkey", S.concat(s, F.lit("-"), "o_orderkey").alias("c"), F.concat_ws("/", s, "o_orderpriority").alias("w"), F.concat(s, F.lit("x")).alias("p"))


@built("fn_regexp", "SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '_') AS first, regexp_replace(p_name, '[aeiou]', '_', 'g') AS every, regexp_extract(p_brand, '([A-Za-z]+)#(\\d+)', 2) AS num, len(regexp_extract_all(p_name, '[a-m]')) AS n, regexp_matches(p_type, '(?i)steel|brass') AS m FROM part")
def _(t, spark):
    return t("part").select("p_partkey", S.regexp_replace("p_name", "[aeiou]", "_").alias("first"), S.regexp_replace("p_name", "[aeiou]", "_", "g").alias("every"), F.element_at(S.regexp_match("p_brand", r"([A-Za-z]+)#(\d+)"), 2).alias("num"), F.regexp_count("p_name", F.lit("[a-m]")).cast("long").alias("n"), F.col("p_type").rlike("(?i)steel|brass").alias("m"))


@built("fn_hash_encode", "SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s, lower(hex(c_name::BLOB)) AS h, base64(c_name::BLOB) AS b, to_base64(c_mktsegment::BLOB) AS b2, lower(to_hex(c_custkey)) AS x FROM customer")
def _(t, spark):
    n = "c_name"
    return t("customer").select("c_custkey", F.md5(n).alias("m"), F.sha2(n, 256).alias("s"), S.encode(n, "hex").alias("h"), S.encode(n, "base64").alias("b"), S.encode("c_mktsegment", "base64").alias("b2"), S.to_hex("c_custkey").alias("x"))


@built("fn_normalize_unaccent", "SELECT doc_id, strip_accents(text) AS u, nfc_normalize(text) AS n FROM documents")
def _(t, spark):
    return t("documents").select("doc_id", S.unaccent("text").alias("u"), S.normalize("text", F.lit("NFC")).alias("n"))


@built("fn_quote", "SELECT c_custkey, '''' || replace(c_name || '''s', '''', '''''') || '''' AS q, CASE WHEN regexp_full_match(lower(c_mktsegment), '[a-z_][a-z0-9_]*') THEN lower(c_mktsegment) ELSE '\"' || lower(c_mktsegment) || '\"' END AS i, '\"' || c_name || '\"' AS j FROM customer")
def _(t, spark):
    return t("customer").select("c_custkey", S.quote_literal(F.concat("c_name", F.lit("'s"))).alias("q"), S.quote_ident(F.lower("c_mktsegment")).alias("i"), S.quote_ident("c_name").alias("j"))


@built("fn_format", "SELECT c_custkey, 'Hello ' || c_name || ' 100% [' || lpad(c_custkey::VARCHAR, 6, ' ') || ']' AS f FROM customer")
def _(t, spark):
    return t("customer").select("c_custkey", S.format_text(F.lit("Hello %s 100%% [%6s]"), F.array("c_name", F.col("c_custkey").cast("string"))).alias("f"))


@built("fn_initcap_arrays", "SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS i, array_to_string(string_split(p_name, ' '), '+') AS j FROM part")
def _(t, spark):
    return t("part").select("p_partkey", S.initcap("p_type").alias("i"), S.array_to_string(S.string_to_array("p_name", " "), "+").alias("j"))


@built("fn_extract", "SELECT event_id, extract(year FROM ts)::INT AS y, extract(month FROM ts)::INT AS m, extract(day FROM ts)::INT AS d, extract(dow FROM ts)::INT AS dow, extract(isodow FROM ts)::INT AS iso, extract(doy FROM ts)::INT AS doy, extract(week FROM ts)::INT AS w, extract(quarter FROM ts)::INT AS q, extract(hour FROM ts)::INT AS h, extract(century FROM ts)::INT AS c, round(epoch(ts), 3) AS e FROM events")
def _(t, spark):
    x = lambda f: D.extract(f, "ts").cast("int")
    return t("events").select("event_id", x("year").alias("y"), x("month").alias("m"), x("day").alias("d"), x("dow").alias("dow"), x("isodow").alias("iso"), x("doy").alias("doy"), x("week").alias("w"), x("quarter").alias("q"), x("hour").alias("h"), x("century").alias("c"), F.round(D.extract("epoch", "ts"), 3).alias("e"))


@built("fn_date_trunc_bin", "SELECT event_id, date_trunc('month', ts) AS m, date_trunc('hour', ts) AS h, time_bucket(INTERVAL '15 minutes', ts) AS b FROM events")
def _(t, spark):
    e = t("events")
    return e.select("event_id", F.date_trunc("month", "ts").cast(e.schema["ts"].dataType).alias("m"), F.date_trunc("hour", "ts").cast(e.schema["ts"].dataType).alias("h"), D.date_bin(900, "ts").cast(e.schema["ts"].dataType).alias("b"))


@built("fn_interval_arith", "SELECT o_orderkey, CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) AS m, CAST(o_orderdate - INTERVAL 10 DAY AS DATE) AS d, (DATE '1998-08-02' - CAST(o_orderdate AS DATE))::INT AS diff, last_day(o_orderdate) AS l FROM orders")
def _(t, spark):
    d = F.col("o_orderdate")
    return t("orders").select("o_orderkey", (d + F.expr("interval 1 month")).cast("date").alias("m"), (d - F.expr("interval 10 days")).cast("date").alias("d"), D.date_minus(F.lit("1998-08-02").cast("date"), d.cast("date")).alias("diff"), F.last_day(d).alias("l"))


@built("fn_age", "SELECT o_orderkey, date_part('year', age(TIMESTAMP '2000-03-01', o_orderdate))::INT AS y, date_part('month', age(TIMESTAMP '2000-03-01', o_orderdate))::INT AS m FROM orders")
def _(t, spark):
    a = D.age(F.lit("2000-03-01").cast("timestamp"), "o_orderdate")
    return t("orders").select("o_orderkey", a["years"].alias("y"), a["months"].alias("m"))


@built("fn_to_char", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS a, strftime(ts, '%d/%m/%y') AS b, strftime(ts, 'day %j') AS c FROM events")
def _(t, spark):
    return t("events").select("event_id", D.to_char("ts", "YYYY-MM-DD HH24:MI:SS").alias("a"), D.to_char("ts", "DD/MM/YY").alias("b"), D.to_char("ts", '"day "DDD').alias("c"))


@built("fn_at_time_zone", "SELECT event_id, ts - INTERVAL 9 HOUR AS u, ts + INTERVAL 9 HOUR AS l FROM events")
def _(t, spark):
    e = t("events")
    kind = e.schema["ts"].dataType
    return e.select("event_id", D.at_time_zone("ts", "Asia/Tokyo").cast(kind).alias("u"), D.at_time_zone("ts", "Asia/Tokyo", aware=True).cast(kind).alias("l"))


@built("fn_overlaps", "SELECT o_orderkey, (o_orderdate < TIMESTAMP '1996-01-01' AND TIMESTAMP '1995-01-01' < o_orderdate + INTERVAL 30 DAY) AS o FROM orders")
def _(t, spark):
    d = F.col("o_orderdate")
    return t("orders").select("o_orderkey", D.overlaps(d + F.expr("interval 30 days"), d, F.lit("1995-01-01").cast("timestamp"), F.lit("1996-01-01").cast("timestamp")).alias("o"))


@built("fn_series_timestamps", "SELECT n_nationkey, i::DATE AS d FROM nation, generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-10', INTERVAL 3 DAY) g(i)")
def _(t, spark):
    return t("nation").select("n_nationkey", F.explode(D.series(F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-10").cast("timestamp"), "interval 3 days").cast("array<date>")).alias("d"))


@built("fn_array_core", "SELECT n_nationkey, list_position([1, 3, 5, 7], n_regionkey) AS p, len(string_split(n_name, 'A')) AS n, array_to_string([x for x in range(1, n_regionkey + 2)], ',') AS s, array_to_string([10, 20, 30][2:3], ',') AS sl FROM nation")
def _(t, spark):
    a = F.array(*map(F.lit, (1, 3, 5, 7)))
    ten = F.array(*map(F.lit, (10, 20, 30)))
    text = lambda x: F.array_join(x.cast("array<string>"), ",")
    return t("nation").select("n_nationkey", A.position(a, F.col("n_regionkey")).cast("int").alias("p"), F.size(F.split("n_name", "A")).cast("long").alias("n"), text(F.sequence(F.lit(1), F.col("n_regionkey") + 1)).alias("s"), text(A.part(ten, 2, 3)).alias("sl"))


@built("fn_array_overlap_contains", "SELECT doc_id, list_has_any(string_split(lower(text), ' '), ['the', 'und']) AS o, list_has_all(string_split(lower(text), ' '), ['the', 'of']) AS c FROM documents")
def _(t, spark):
    w = F.split(F.lower("text"), " ")
    return t("documents").select("doc_id", A.overlap(w, F.array(F.lit("the"), F.lit("und"))).alias("o"), A.contains(w, F.array(F.lit("the"), F.lit("of"))).alias("c"))


@built("fn_array_edit", """
SELECT p_partkey, array_to_string(list_transform(a, lambda x: CASE WHEN x = p_size % 5 THEN 9 ELSE x END), ',') AS r, array_to_string(a[1:len(a) - 1], ',') AS tr, array_to_string(a[2:3], ',') AS sl
FROM (SELECT p_partkey, p_size, range(0, p_size % 7) AS a FROM part)""")
def _(t, spark):
    a = F.filter(F.sequence(F.lit(0), F.lit(6)), lambda x: x < F.col("p_size") % 7)
    text = lambda x: F.array_join(x.cast("array<string>"), ",")
    return t("part").select("p_partkey", text(A.replace(a, F.col("p_size") % 5, 9)).alias("r"), text(A.trim(a, 1)).alias("tr"), text(A.part(a, 2, 3)).alias("sl"))


@built("fn_json_extract", "SELECT event_id, (props->>'$.k')::INT AS k, props->>'$.missing' AS miss, json_type(props->'$.k') IS NOT NULL AS has FROM events")
def _(t, spark):
    return t("events").select("event_id", J.get_text("props", "k").cast("int").alias("k"), J.get_text("props", "missing").alias("miss"), J.get_text("props", "k").isNotNull().alias("has"))


@built("fn_json_build", "SELECT n_nationkey, '{\"id\":' || n_nationkey || ',\"name\":\"' || n_name || '\"}' AS o, '[' || n_nationkey || ',' || n_regionkey || ']' AS a FROM nation")
def _(t, spark):
    return t("nation").select("n_nationkey", J.build_object(id="n_nationkey", name="n_name").alias("o"), J.build_array("n_nationkey", "n_regionkey").alias("a"))


@built("fn_json_each", "SELECT event_id, k AS key, props->>k AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def _(t, spark):
    e = t("events").select("event_id", "props", F.explode(J.keys("props")).alias("key"))
    return e.select("event_id", "key", F.from_json("props", "map<string,string>")[F.col("key")].alias("value"))


@built("fn_json_types", "SELECT n_nationkey, n_nationkey % 4 <> 3 AS valid, CASE n_nationkey % 4 WHEN 0 THEN 'object' WHEN 1 THEN 'array' WHEN 2 THEN 'number' END AS kind, CASE n_nationkey % 4 WHEN 0 THEN '{\"a\": 2, \"b\": [1, 9]}' END AS edited FROM nation")
def _(t, spark):
    doc = F.element_at(F.array(F.lit('{"a": 1, "b": [1, null]}'), F.lit("[1, 2]"), F.lit("12.5"), F.lit("{bad")), F.col("n_nationkey") % 4 + 1)
    n = t("nation").select("n_nationkey", doc.alias("doc"))
    edited = J.jsonb_set(J.jsonb_set("doc", F.array(F.lit("a")), F.lit("2")), F.array(F.lit("b"), F.lit("1")), F.lit("9"))
    return n.select("n_nationkey", J.is_json("doc").alias("valid"), J.type_of("doc").alias("kind"), F.when(F.col("n_nationkey") % 4 == 0, edited).alias("edited"))


@built("fn_range_overlap_contains", """
SELECT o_orderkey, (o_custkey <= 500 AND 100 < o_custkey + 50) AS o, (300 >= o_custkey AND 300 < o_custkey + 50) AS c, (o_custkey + 50 <= 100) AS b, (o_custkey + 50 = 100 OR 501 = o_custkey) AS adj FROM orders""")
def _(t, spark):
    r = N.make("o_custkey", F.col("o_custkey") + 50)
    fixed = N.make(F.lit(100), F.lit(501))
    return t("orders").select("o_orderkey", N.overlaps(r, fixed).alias("o"), N.contains(r, F.lit(300)).alias("c"), N.before(r, fixed).alias("b"), N.adjacent(r, fixed).alias("adj"))


@built("fn_range_intersect", "SELECT o_orderkey, greatest(o_custkey, 100) AS lo, least(o_custkey + 50, 500) AS hi, least(o_custkey, 100) AS mlo, greatest(o_custkey + 50, 500) AS mhi FROM orders WHERE o_custkey < 500 AND o_custkey + 50 > 100")
def _(t, spark):
    r, fixed = N.make("o_custkey", F.col("o_custkey") + 50), N.make(F.lit(100).cast("long"), F.lit(500).cast("long"))
    x, m = N.intersect(r, fixed), N.span(r, fixed)
    return t("orders").where(~x["empty"]).select("o_orderkey", x["lo"].alias("lo"), x["hi"].alias("hi"), m["lo"].alias("mlo"), m["hi"].alias("mhi"))


@built("fn_geo_distance", "SELECT c_custkey, round(2 * 3958.747716 * asin(sqrt(pow(sin((radians(c_nationkey) - radians(48.5)) / 2), 2) + cos(radians(c_nationkey)) * cos(radians(48.5)) * pow(sin(radians(c_custkey % 90 - 2.3) / 2), 2))), 4) AS miles FROM customer")
def _(t, spark):
    return t("customer").select("c_custkey", F.round(G.geo_distance(F.col("c_custkey") % 90, "c_nationkey", F.lit(2.3), F.lit(48.5)), 4).alias("miles"))


_E = "[6378168.0 * cos(radians({a})) * cos(radians({o})), 6378168.0 * cos(radians({a})) * sin(radians({o})), 6378168.0 * sin(radians({a}))]"


@built("earth_distance", f"SELECT c_custkey, round(2 * 6378168.0 * asin(least(1.0, list_distance({_E.format(a='c_nationkey', o='c_custkey % 90')}, {_E.format(a='10', o='20')}) / (2 * 6378168.0))), 2) AS m, round(c_nationkey::DOUBLE, 6) AS lat FROM customer")
def _(t, spark):
    e = G.ll_to_earth("c_nationkey", F.col("c_custkey") % 90)
    return t("customer").select("c_custkey", F.round(G.earth_distance(e, G.ll_to_earth(10, 20)), 2).alias("m"), F.round(G.latitude(e), 6).alias("lat"))


@built("vector_distances", "SELECT a.vec_id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS l2, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS dot, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cos FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b")
def _(t, spark):
    e = t("embeddings")
    one = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return e.crossJoin(F.broadcast(one)).select("vec_id", F.round(G.l2("embedding", "q"), 5).alias("l2"), F.round(G.dot("embedding", "q"), 5).alias("dot"), F.round(G.cosine("embedding", "q"), 5).alias("cos"))


@built("vector_cube_distances", "SELECT vec_id, round(list_sum([abs(x) for x in embedding::DOUBLE[]]), 5) AS taxi, round(list_max([abs(x) for x in embedding::DOUBLE[]]), 6) AS cheb FROM embeddings")
def _(t, spark):
    zero = F.transform("embedding", lambda x: F.lit(0.0))
    return t("embeddings").select("vec_id", F.round(G.taxicab("embedding", zero), 5).alias("taxi"), F.round(G.chebyshev("embedding", zero), 6).alias("cheb"))


@built("fn_plane_geometry", "SELECT p_partkey, round(sqrt(p_size * p_size + 16.0), 6) AS d, round(p_size * 4.0::DOUBLE, 6) AS area, round(pi() * p_size * p_size, 4) AS circle, round(p_size * 3 / 2.0::DOUBLE, 6) AS tri FROM part")
def _(t, spark):
    o, p = G.point(0, 0), G.point("p_size", 4)
    tri = F.array(G.point(0, 0), G.point("p_size", 0), G.point(0, 3))
    return t("part").select("p_partkey", F.round(G.distance(o, p), 6).alias("d"), F.round(G.box_area(G.box(o, p)), 6).alias("area"), F.round(G.circle_area("p_size"), 4).alias("circle"), F.round(G.polygon_area(tri), 6).alias("tri"))


same("levenshtein", "SELECT n_nationkey, CAST(levenshtein(n_name, 'IRAN') AS BIGINT) AS d FROM nation")


@built("levenshtein_bounded", "SELECT n_nationkey, least(levenshtein(n_name, 'CHINA'), 4)::INT AS d FROM nation")
def _(t, spark):
    return t("nation").select("n_nationkey", S.levenshtein_less_equal("n_name", F.lit("CHINA"), 3).alias("d"))


@built("levenshtein_costs", """
SELECT n_nationkey, 3 * (length(n_name) - 3)::INT AS cut, 2 * (length(n_name) - 3)::INT AS grown, length(n_name)::INT AS swapped, least(5, 7)::INT * length(n_name)::INT AS dear, (levenshtein(n_name, 'PERU') * 2)::INT AS even FROM nation""")
def _(t, spark):
    """Three deletions a letter, two insertions, one substitution; and where a substitution is dearer than both others."""
    cost = lambda a, b, *c: S.levenshtein_costs(a, b, *map(F.lit, c))
    head, low = F.substring("n_name", 1, 3), F.regexp_replace("n_name", ".", "#")
    return t("nation").select("n_nationkey", cost("n_name", head, 2, 3, 4).alias("cut"), cost(head, "n_name", 2, 3, 4).alias("grown"), cost("n_name", low, 2, 3, 1).alias("swapped"), cost("n_name", low, 2, 3, 7).alias("dear"), cost("n_name", F.lit("PERU"), 2, 2, 2).alias("even"))


@built("soundex_difference")
def _(t, spark):
    return t("nation").select("n_nationkey", F.soundex("n_name").alias("code"), S.difference("n_name", F.lit("CHINA")).alias("d"), S.metaphone("n_name").alias("m"))


_G = "list_distinct(flatten([[substr('  ' || w || ' ', i, 3) for i in range(1, length(w) + 2)] for w in regexp_extract_all(lower({c}), '[a-z0-9]+')]))"


@built("trigram_similarity", f"SELECT n_nationkey, round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 6) AS s FROM (SELECT n_nationkey, {_G.format(c='n_name')} AS a, {_G.format(c=chr(39) + 'united kingdom' + chr(39))} AS b FROM nation)")
def _(t, spark):
    return t("nation").select("n_nationkey", F.round(S.similarity("n_name", F.lit("united kingdom")), 6).alias("s"))


@built("fn_try_cast_valid_input", "SELECT p_partkey, try_cast(p_name AS INT) IS NOT NULL AS i, try_cast(split_part(p_brand, '#', 2) AS INT) AS n FROM part")
def _(t, spark):
    return t("part").select("p_partkey", T.input_is_valid("p_name", "int").alias("i"), F.split_part("p_brand", F.lit("#"), F.lit(2)).try_cast("int").alias("n"))


@built("fn_boolean_input", "SELECT * FROM (VALUES ('t', true), ('YES', true), ('on', true), ('of', false), ('0', false), ('maybe', NULL), ('o', NULL), ('fal', false)) v(s, b)")
def _(t, spark):
    v = spark.createDataFrame([(s,) for s in ("t", "YES", "on", "of", "0", "maybe", "o", "fal")], "s string")
    return v.select("s", T.boolean("s").alias("b"))


@built("fn_num_nulls_typeof", "SELECT o_orderkey, (CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS n, 'bigint' AS ty FROM orders")
def _(t, spark):
    s = F.expr("nullif(o_orderstatus, 'F')")
    return t("orders").select("o_orderkey", T.num_nulls(s, "o_custkey").alias("n"), T.typeof("o_orderkey").alias("ty"))


@built("fn_network", "SELECT n_nationkey, '10.' || n_nationkey || '.0.0/16' AS net, 16 AS len, n_nationkey = 3 AS within FROM nation")
def _(t, spark):
    a = F.concat(F.lit("10."), F.col("n_nationkey"), F.lit(".7.9/16"))
    return t("nation").select("n_nationkey", T.network(a).alias("net"), T.masklen(a).alias("len"), T.inet_within(a, F.lit("10.3.0.0/16")).alias("within"))


_MD5 = "lower(substr(md5(c_name), 1, 8) || '-' || substr(md5(c_name), 9, 4) || '-' || substr(md5(c_name), 13, 4) || '-' || substr(md5(c_name), 17, 4) || '-' || substr(md5(c_name), 21))"


@built("fn_uuid_money", f"SELECT c_custkey, {_MD5} AS u, CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END || '$' || format('{{:,.2f}}', abs(c_acctbal)) AS m FROM customer")
def _(t, spark):
    return t("customer").select("c_custkey", T.uuid(F.concat(F.lit("{"), F.upper(F.md5("c_name")), F.lit("}"))).alias("u"), T.money("c_acctbal").alias("m"))


_SPACE = "6ba7b8109dad11d180b400c04fd430c8"


@built("fn_uuid_named", f"""
SELECT c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS u
FROM (SELECT c_custkey, sha1(from_hex('{_SPACE}') || encode(c_name)) AS h FROM customer)""")
def _(t, spark):
    return t("customer").select("c_custkey", T.uuid_v5(T.uuid(F.lit(_SPACE)), "c_name").alias("u"))


@built("fn_bit_strings", """
SELECT p_partkey, bit_count(p_partkey)::INT AS n, b[1:2] || '1' || b[4:] AS s FROM (SELECT p_partkey, lpad(printf('%b', p_partkey), 16, '0') AS b FROM part)""")
def _(t, spark):
    b = F.bin("p_partkey")  # padding to 16 also cuts what is longer, so bits are counted before
    return t("part").select("p_partkey", T.bit_count(b).alias("n"), T.bit_set(F.lpad(b, 16, "0"), 2, 1).alias("s"))


@built("udf_scalar", "SELECT p_partkey, p_size * 2 + 1 AS y FROM part")
def _(t, spark):
    import pandas as pd

    @F.pandas_udf("int")
    def twice(x: pd.Series) -> pd.Series:
        return x * 2 + 1

    return t("part").select("p_partkey", twice("p_size").alias("y"))


@built("udaf", "SELECT p_brand, round(exp(avg(ln(p_retailprice))), 4) AS gm FROM part GROUP BY p_brand")
def _(t, spark):
    import pandas as pd

    @F.pandas_udf("double")
    def geometric_mean(x: pd.Series) -> float:
        import numpy as np

        return float(np.exp(np.log(x).mean()))

    return t("part").groupBy("p_brand").agg(F.round(geometric_mean("p_retailprice"), 4).alias("gm"))


@built("udtf_setof", "SELECT i::INT AS i, (i * i)::INT AS sq FROM range(12) r(i)")
def _(t, spark):
    @F.udtf(returnType="i int, sq int")
    class Squares:
        def eval(self, n: int):
            for i in range(n):
                yield i, i * i

    return Squares(F.lit(12))


@built("sql_function", "SELECT n_nationkey, n_nationkey * n_nationkey + 1 AS y FROM nation")
def _(t, spark):
    t("nation").createOrReplaceTempView("nation")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION square_plus(x INT) RETURNS INT RETURN x * x + 1")
    return spark.sql("SELECT n_nationkey, square_plus(n_nationkey) AS y FROM nation")

"""What queries alone don't show: rewriting, options, errors, plans, streams and advice."""

import datetime
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur import catalog, dialect
from larkspur.functions import arrays, json, ranges, strings, textsearch, types, xml
from larkspur.functions import datetime as dt
from larkspur.functions import math as m
from larkspur.operators import ml, procedural, relational
from larkspur.plans import workload
from larkspur.sources import copy, vectors
from larkspur.streaming import events

FOLDER = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---------------------------------------------------------------- front end


@pytest.mark.parametrize(
    "sql, want",
    [
        ("SELECT a FROM t WHERE b ~* 'x'", "SELECT a FROM t WHERE rlike(b, '(?i)x')"),
        ("SELECT a FROM t WHERE b !~ 'x'", "SELECT a FROM t WHERE NOT rlike(b, 'x')"),
        ("SELECT a FROM t WHERE b = ANY (ARRAY[1, 2])", "SELECT a FROM t WHERE exists(array(1, 2), _x -> _x = b)"),
        ("SELECT 'a ~ b' FROM t ORDER BY a DESC, b", "SELECT 'a ~ b' FROM t ORDER BY a DESC NULLS FIRST, b NULLS LAST"),
        ("SELECT a FROM t FETCH FIRST 3 ROWS ONLY", "SELECT a FROM t LIMIT 3"),
        ("SELECT a FROM t TABLESAMPLE BERNOULLI (10) REPEATABLE (3)", "SELECT a FROM t TABLESAMPLE (10 PERCENT) REPEATABLE (3)"),
        ("SELECT sum(x) OVER (PARTITION BY a ORDER BY b) FROM t", "SELECT sum(x) OVER (PARTITION BY a ORDER BY b NULLS LAST) FROM t"),
    ],
)
def test_rewrite(sql, want):
    assert dialect.rewrite(sql) == want


def test_tables_and_tree(spark):
    catalog.register(spark, FOLDER, ["orders", "customer"])
    sql = "SELECT 1 FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"
    assert dialect.tables(spark, sql) == ["customer", "orders"] and "Join" in dialect.parse_tree(spark, sql)


def test_null_order(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "x int")
    assert [r.x for r in relational.sort(df, "x").collect()] == [1, 2, None]
    assert [r.x for r in relational.sort(df, "x desc").collect()] == [None, 2, 1]
    assert [r.x for r in relational.fetch_with_ties(df.unionAll(df), 1, "x desc").collect()] == [None, None]


def test_predict_many_classes(spark):
    rows = [(float(i % 3), "abc"[i % 3]) for i in range(60)]
    spark.createDataFrame(rows, "f double, y string").createOrReplaceTempView("cl")
    got = dialect.sql(spark, "PREDICT CLASS OF y FROM cl TRAIN ON *").collect()
    assert all(r.prediction == r.y for r in got)


# ---------------------------------------------------------------- plans


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(catalog.table(spark, FOLDER, "lineitem").where("l_quantity > 10").select("l_orderkey"))
    assert "GreaterThan(l_quantity,10.0)" in p and "l_comment" not in p and "l_extendedprice" not in p.split("ReadSchema")[1]


def test_asof_and_range_joins_are_linear(spark):
    e = catalog.table(spark, FOLDER, "events")
    a = relational.asof_join(e.select("event_id", "user_id", "ts"), e.select("user_id", "ts", "value"), ["user_id"], "ts", "ts", ["value"])
    assert "NestedLoop" not in plan(a) and "Cartesian" not in plan(a)
    r = relational.range_join(e.select("value"), e.select(F.col("value").alias("lo"), (F.col("value") + 1).alias("hi")), "value", "lo", "hi", 1.0)
    assert "NestedLoop" not in plan(r) and "Cartesian" not in plan(r)


# ---------------------------------------------------------------- relational


def test_merge_rejects_two_matches(spark):
    t, s = spark.createDataFrame([(1, 1)], "k int, v int"), spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(relational.CardinalityViolation):
        relational.merge(t, s, ["k"], relational.When("both", "update", None, {"v": F.col("s.v")}))


def test_connectby_finds_loops(spark):
    with pytest.raises(ValueError):
        relational.connectby(spark.createDataFrame([(1, 2), (2, 1)], "k int, p int"), "k", "p", 1)
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 1)], "k int, p int")
    assert {(r.keyid, r.level, r.branch) for r in relational.connectby(tree, "k", "p", 1, max_depth=1).collect()} == {(1, 0, "1"), (2, 1, "1~2"), (4, 1, "1~4")}


@pytest.mark.parametrize("bad", [-1, 101, None])
def test_tablesample_bounds(spark, bad):
    with pytest.raises(ValueError):
        relational.tablesample(spark.range(3), "bernoulli", bad)


def test_samples_repeat(spark):
    a = [relational.tablesample(spark.range(1000), "bernoulli", 20, 5).count() for _ in range(2)]
    assert a[0] == a[1] and 120 < a[0] < 280 and relational.system_rows(spark.range(9), 4).count() == 4


def test_random_normal_is_normal(spark):
    x = np.sort([r.normal_rand for r in relational.normal_rand(spark, 4000, 1.0, 2.0, 3).collect()])
    z = np.array([r.e for r in spark.createDataFrame([(float((v - 1) / 2 / np.sqrt(2)),) for v in x], "z double").select(m.erf("z").alias("e")).collect()])
    assert np.abs((1 + z) / 2 - (np.arange(4000) + 0.5) / 4000).max() < 0.04


# ---------------------------------------------------------------- functions


def test_text_functions(spark):
    f = lambda c: one(spark, c)
    s = F.lit
    assert f(strings.left(s("ahoj"), -1)) == "aho" and f(strings.right(s("ahoj"), -5)) == "" and f(strings.right(s("ahoj"), 9)) == "ahoj"
    assert f(strings.concat(s("a"), s(None), s(2))) == "a2" and f(strings.regexp_replace(s("aXa"), "x", "b", "i")) == "aba"
    assert f(strings.regexp_replace(s("aaa"), "a", "b")) == "baa" and f(strings.regexp_match(s("k=12"), r"(\w)=(\d+)")) == ["k", "12"]
    assert f(strings.format_text(s("%s %2$I %L %%"), F.array(s("a"), s("B c"), s("it's")))) == "a \"B c\" 'it''s' %"
    assert f(strings.quote_ident(s("select"))) == '"select"' and f(strings.quote_literal(s("a\\'b"))) == " E'a\\\\''b'"
    assert f(strings.parse_ident(s('Ab."C""d"'))) == ["ab", 'C"d'] and f(strings.unistr(s(r"d\0061t\+000061"))) == "data"
    assert f(strings.initcap(s("hi THERE-x1y"))) == "Hi There-X1y" and f(strings.levenshtein_costs(s("ab"), s("b"), s(1), s(5), s(2))) == 5
    assert f(strings.is_normalized(s("é"), s("NFC"))) is False and f(strings.get_byte(s("AB"), 1)) == 66 and f(strings.set_byte(s("AB"), 0, 90)) == b"ZB"
    assert f(strings.string_to_array(s("a,,b"), ",", "")) == ["a", None, "b"] and f(strings.metaphone(s("Thompson"))) is not None
    assert f(strings.word_similarity(s("word"), s("two words"))) > 0.7 and strings.similar_to("a%_") == "^(?:a(?s:.*)(?s:.))$"


def test_number_and_type_functions(spark):
    f = lambda c: one(spark, c)
    s = F.lit
    assert f(m.gcd(s(-12), s(18))) == 6 and f(m.lcm(s(4), s(6))) == 12 and f(m.gcd(s(0), s(0))) == 0 and f(m.lcm(s(0), s(5))) == 0
    assert f(m.gcd(s(7540113804746346429), s(4660046610375530309))) == 1 and f(m.div(s(-7), s(2))) == -3 and f(m.round_float(s(2.5))) == 2.0
    assert f(types.cash_words(s(1234.56))) == "One thousand two hundred thirty four dollars and fifty six cents" and f(types.money(s(-1234.5))) == "-$1,234.50"
    assert f(types.uuid(s("{a0eebc99-9c0b4ef8-bb6d6bb9-bd380a11}"))) == "a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11" and f(types.network(s("192.168.5.9/24"))) == "192.168.5.0/24"
    assert f(m.trim_scale(s("8.4100"))) == "8.41" and f(types.enum_rank(s("b"), ["a", "b"])) == 2 and f(types.bit_set(s("0000"), 1, 1)) == "0100"
    assert f(types.uuid_v5(s("6ba7b810-9dad-11d1-80b4-00c04fd430c8"), s("x"))).count("-") == 4


def test_time_functions(spark):
    f = lambda c: one(spark, c)
    ts = lambda t: F.lit(t).cast("timestamp")
    assert f(dt.extract("dow", ts("2020-01-05 00:00:00"))) == 0 and f(dt.extract("isodow", ts("2020-01-05 00:00:00"))) == 7
    a = f(dt.age(ts("2001-04-10 00:00:00"), ts("1957-06-13 00:00:00")))
    assert (a.years, a.months, a.days) == (43, 9, 28)
    b = f(dt.age(ts("1957-06-13 00:00:00"), ts("2001-04-10 00:00:00")))
    assert (b.years, b.months, b.days) == (-43, -9, -28)
    assert f(dt.date_bin(900, ts("2020-02-11 15:44:17"))) == datetime.datetime(2020, 2, 11, 15, 30)
    assert f(dt.to_char(ts("2020-02-11 15:44:17"), '"at" HH12:MI AM, Dy')) == "at 03:44 PM, Tue"
    assert f(dt.overlaps(ts("2020-01-01"), ts("2020-02-01"), ts("2020-02-01"), ts("2020-03-01"))) is False
    z = f(dt.time_with_zone(F.lit("24:00:00-07:30")))
    assert (z.micros, z.offset_s) == (86_400_000_000, -27000)
    with pytest.raises(ValueError):
        dt.extract("nonsense", F.lit(None))


def test_array_json_range_xml(spark):
    f = lambda c: one(spark, c)
    s = F.lit
    a = F.array(*map(s, (3, 1, None, 3)))
    assert f(arrays.position(a, 9)) is None and f(arrays.positions(a, 3)) == [1, 4] and f(arrays.in_any(s(9), a)) is None and f(arrays.replace(a, None, 7)) == [3, 1, 7, 3]
    assert f(arrays.all_of(s(5), F.array(s(3), s(4)), lambda x, y: x > y)) is True and f(arrays.subscripts(F.array().cast("array<int>"))) == []
    d = s('{"a": {"b": [1, 2]}, "c": null}')
    assert f(json.jsonb_set(d, F.array(s("a"), s("b"), s("0")), s("9"))) == '{"a": {"b": [9, 2]}, "c": null}' and f(json.jsonb_strip_nulls(d)) == '{"a": {"b": [1, 2]}}'
    assert f(json.jsonb_contains(d, s('{"a": {"b": [2]}}'))) is True and f(json.jsonb_delete_path(d, F.array(s("a"), s("b")))) == '{"a": {}, "c": null}'
    assert f(json.has_unique_keys(s('{"a":1,"a":2}'))) is False and f(json.type_of(s("null"))) == "null" and f(json.path_query(d, "$.a.b[1]")) == "2"
    r = lambda lo, hi, b="[)": ranges.make(s(lo).cast("long"), s(hi).cast("long"), b)
    assert f(ranges.adjacent(r(1, 5), r(5, 9))) and not f(ranges.overlaps(r(1, 5), r(5, 9))) and f(ranges.overlaps(r(1, 5, "[]"), r(5, 9)))
    assert f(ranges.contains(r(None, 5), s(-10).cast("long"))) and f(ranges.make(s(3), s(3))["empty"]) and [(x.lo, x.hi) for x in f(ranges.minus(r(1, 10), r(3, 4)))] == [(1, 3), (4, 10)]
    assert f(xml.element("a", xml.escape(s("<&>")), id=s('"'))) == '<a id="&quot;">&lt;&amp;&gt;</a>' and f(xml.element("a")) == "<a/>" and f(xml.is_document(s("<a>"))) is False
    assert f(textsearch.matches(s("The quick brown foxes"), "fox:* & !(slow | lazy)")) is True and f(textsearch.headline(s("a fox"), ["fox"])) == "a <b>fox</b>"
    assert f(types.boolean(s("of"))) is False and f(types.boolean(s(" YE "))) is True and f(types.boolean(s(""))) is None


# ---------------------------------------------------------------- files


def test_copy_options(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1\tx\\ty\n2\t\\N\n3\tDFLT\n")
    got = copy.copy_from(spark, str(tmp_path / "a.txt"), "k int, v string", default="DFLT", defaults={"v": F.lit("d")}, where="k > 0").collect()
    assert [(r.k, r.v) for r in got] == [(1, "x\ty"), (2, None), (3, "d")]
    (tmp_path / "b.csv").write_text('k,v\n1,"a ""q"", b"\n2,\n')
    got = copy.copy_from(spark, str(tmp_path / "b.csv"), "k int, v string", form="csv", header=True, force_not_null=["v"]).collect()
    assert [(r.k, r.v) for r in got] == [(1, 'a "q", b'), (2, "")]
    with pytest.raises(Exception):
        copy.copy_from(spark, str(tmp_path / "b.csv"), "a int, v string", form="csv", header="match").collect()


def test_vectors(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(6.0).reshape(3, 2))
    rows = vectors.read_npy(spark, [str(tmp_path / "a.npy")]).orderBy("row").collect()
    assert [r["values"] for r in rows] == [[0, 1], [2, 3], [4, 5]]
    r = one(spark, vectors.parse(F.lit("1 7 9:2.5"), 4))
    assert (r.y, r.ids, r.vals) == (1.0, [7, 9, 0, 0], [1.0, 2.5, 0.0, 0.0])


# ---------------------------------------------------------------- learning and advice


def test_encoding_is_stable(spark):
    old = ml.encode_mapping(spark.createDataFrame([("b",), ("d",), (None,)], "t string"), "t")
    new = ml.encode_mapping(spark.createDataFrame([("a",), ("d",), ("c",)], "t string"), "t", old)
    assert {(r.text, r.encoded) for r in new.collect()} == {("b", 1), ("d", 2), ("a", 3), ("c", 4)}


def test_preparation_uses_training_rows_only(spark):
    train, test = spark.createDataFrame([(0.0,), (10.0,)], "x double"), spark.createDataFrame([(None,), (20.0,)], "x double")
    assert [r.x for r in ml.imputer(train, ["x"], "mean").apply(test).collect()] == [5.0, 20.0]
    assert [r.x for r in ml.scaler(train, ["x"], "minmax").apply(test).collect()] == [None, 2.0]
    flat = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert [r.x for r in ml.scaler(flat, ["x"], "standard").apply(flat).collect()] == [0.0, 0.0]


def test_logistic(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 2))
    y = (x @ [2, -1] + 0.3 > 0).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "a double, b double, y int")
    got = ml.predict(df, df, ["a", "b"], "y", "class")
    assert got.agg(F.avg((F.col("y") == F.col("prediction")).cast("double"))).first()[0] > 0.97


def test_advice(spark):
    assert [workload.choose_hint(*s) for s in ((1 << 40, 1 << 20), (1 << 40, 1 << 31), (1 << 40, 1 << 39))] == ["BROADCAST", "SHUFFLE_HASH", "MERGE"]
    sql = "SELECT a FROM big JOIN small ON x = y"
    assert workload.optimize_query(sql, {"big": 1 << 40, "small": 10}) == "SELECT /*+ BROADCAST(small) */ a FROM big JOIN small ON x = y"
    assert workload.optimize_query(sql, {"big": 1 << 40, "small": 10}, "order") == "(small big)"
    a = workload.LayoutAdvisor(spark, 5)
    assert not a.enqueue("INSERT INTO t VALUES (1)") and a.enqueue("SELECT 1 FROM t WHERE c = 1")
    assert a.work({"c": "t"}, {"t": 9.0}) == [] and a.work({"c": "t"}, {"t": 4.0}) == [("t", "c")] and a.drop("t", "c") and not a.drop("t", "c")
    b = workload.PlanBuffer()
    b.run(spark.range(10), "q", "none")
    assert b.best("q") == "none" and b.table(spark).count() == 1 and "== Physical Plan ==" in workload.explain(spark.range(3))


# ---------------------------------------------------------------- procedural


def test_cursors_and_statements(spark):
    c = procedural.Cursor(spark.range(5).orderBy("id"), scroll=True)
    assert [r.id for r in c.fetch(3)] == [0, 1, 2] and [r.id for r in c.fetch(-2)] == [1, 0] and [r.id for r in c.fetch(2)] == [1, 2] and c.move(9) == 2
    with pytest.raises(ValueError):
        procedural.Cursor(spark.range(3)).fetch(-1)
    log = procedural.StatementLog(spark)
    spark.range(5).createOrReplaceTempView("five")
    for i in range(3):
        log.run(f"SELECT id FROM five WHERE id > {i}")
    row = log.table().first()
    assert (row.calls, row.rows, row["query"]) == (3, 4 + 3 + 2, "select id from five where id > ?")


def test_triggers_stop_bad_rows(spark, tmp_path):
    w = procedural.Writer(str(tmp_path / "t"))
    w.check("id < 2")
    with pytest.raises(Exception):
        w.insert(spark.range(5))
    w = procedural.Writer(str(tmp_path / "u"))
    w.references("id", spark.range(3), "id")
    with pytest.raises(ValueError):
        w.insert(spark.range(5))
    p = procedural.Procedures(spark)
    p.create("twice", lambda s, x: x * 2)
    assert p.call("twice", 4) == 8


# ---------------------------------------------------------------- streams


def test_stateful_counts(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "k string, v int")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = events.read_stream(spark, str(tmp_path / "in"), rows.schema)
    q = events.running_counts(s, "k").writeStream.format("memory").queryName("counts").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert {(r.k, r.n) for r in spark.table("counts").collect()} == {("a", 2), ("b", 1)}


def test_batches_take_turns(spark):
    got = [(name, len(rows)) for name, rows in events.batches(spark.range(10), {"train": 2, "test": 1}, 3)]
    assert got == [("train", 3), ("train", 3), ("test", 3), ("train", 1)]


@pytest.mark.parametrize("gone", ["larkspur.llm", "larkspur.llm.bpe", "corpus_pipeline", "ahocorasick"])
def test_entry_without_the_subpackage(gone):
    """Whatever of the subpackage can't be imported, the other queries stay."""
    import subprocess

    code = f"import sys, warnings; warnings.simplefilter('ignore'); sys.modules[{gone!r}] = None; import __spark_entry__ as e; print(len(e.queries()), sum(k.startswith('op') or k == 'pipeline' for k in e.queries()), set(e.oracle_sql()) <= set(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 200 and out[2] == "True"
    if gone != "corpus_pipeline":
        assert out[1] == "0"


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["nation", "revenue", "n"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


# ---------------------------------------------------------------- statements that change data


@pytest.fixture
def stock(spark):
    spark.createDataFrame([(1, "a", 10.0), (2, "b", None), (3, "c", 30.0)], "id long, name string, price double").createOrReplaceTempView("stock")
    spark.createDataFrame([(1, 1.5), (2, 2.5), (9, 9.5)], "id long, more double").createOrReplaceTempView("news")
    return lambda: sorted(tuple(r) for r in spark.table("stock").collect())


def test_changes_take_effect(spark, stock):
    q = lambda s, **a: [tuple(r) for r in dialect.sql(spark, s, **a).collect()]
    assert q("INSERT INTO stock (id, name) VALUES (4, 'it''s; (d)') RETURNING id, price, upper(name) AS n") == [(4, None, "IT'S; (D)")]
    assert q("UPDATE stock SET price = 0 WHERE price IS NULL") == [(2,)]
    assert sorted(q("UPDATE stock AS s SET price = s.price + n.more FROM news AS n WHERE s.id = n.id RETURNING *")) == [(1, "a", 11.5), (2, "b", 2.5)]
    assert q("DELETE FROM stock s USING news n WHERE s.id = n.id AND n.more > 2 RETURNING s.id") == [(2,)]
    assert stock() == [(1, "a", 11.5), (3, "c", 30.0), (4, "it's; (d)", 0.0)]
    assert q("INSERT INTO stock VALUES (1, 'z', 1), (7, 'y', 2) ON CONFLICT (id) DO UPDATE SET name = concat(stock.name, excluded.name), price = DEFAULT WHERE excluded.price < 2 RETURNING id, name, price") in ([(1, "az", None), (7, "y", 2.0)], [(7, "y", 2.0), (1, "az", None)])
    assert q("DELETE FROM stock WHERE id > :least", least=3) == [(2,)] and stock() == [(1, "az", None), (3, "c", 30.0)]
    assert q("TRUNCATE stock") == [(2,)] and stock() == []


def test_changes_refuse_a_row_twice(spark, stock):
    before = stock()
    for s in (
        "INSERT INTO stock VALUES (1, 'x', 1), (1, 'y', 2) ON CONFLICT (id) DO UPDATE SET name = excluded.name",
        "INSERT INTO stock VALUES (8, 'x', 1), (8, 'y', 2) ON CONFLICT (id) DO UPDATE SET name = excluded.name",
        "MERGE INTO stock t USING (SELECT 1 AS id FROM news) s ON t.id = s.id WHEN MATCHED THEN DELETE",
    ):
        with pytest.raises(relational.CardinalityViolation):
            dialect.sql(spark, s)
    assert stock() == before
    with pytest.raises(ValueError, match="does not exist"):
        dialect.sql(spark, "UPDATE stock SET colour = 'red'")
    dialect.sql(spark, "MERGE INTO stock t USING (SELECT 1 AS id FROM news) s ON t.id = s.id WHEN MATCHED AND t.price > 100 THEN DELETE WHEN MATCHED THEN DO NOTHING")
    assert stock() == before
    dialect.sql(spark, "INSERT INTO stock VALUES (NULL, 'n', 1), (NULL, 'n', 1), (1, 'x', 0) ON CONFLICT (id) DO NOTHING")
    assert len(stock_rows := spark.table("stock").collect()) == 5 and sum(r.id is None for r in stock_rows) == 2


def test_upserts_and_merges_as_operators(spark):
    df = lambda rows: spark.createDataFrame(rows, "k int, v string")
    t, s = df([(1, "a"), (3, "c"), (None, "n")]), df([(1, "x"), (2, "y"), (2, "b"), (None, "m")])
    rows = lambda d: sorted(map(str, map(tuple, d.collect())))
    assert rows(relational.insert_on_conflict(t, s, ["k"])) == sorted(map(str, [(1, "a"), (3, "c"), (None, "n"), (2, "b"), (None, "m")]))
    with pytest.raises(relational.CardinalityViolation):
        relational.insert_on_conflict(t, s, ["k"], ["v"])
    whens = [relational.When("both", "update", F.col("t.v") < "b", {"v": F.concat("t.v", "s.v")}), relational.When("source", "insert", F.col("s.v") > "b", {"k": F.col("s.k"), "v": F.col("s.v")}), relational.When("target", "delete", F.col("t.k") == 3)]
    assert rows(relational.merge(t, s, ["k"], *whens)) == sorted(map(str, [(1, "ax"), (None, "n"), (2, "y"), (None, "m")]))
    with pytest.raises(relational.CardinalityViolation):
        relational.merge(t, df([(1, "p"), (1, "q")]), ["k"], relational.When("both", "delete"))


# ---------------------------------------------------------------- plans that hold at scale


def test_plans_are_what_queries_say(spark):
    from larkspur.queries import QUERIES

    run = lambda name: plan(QUERIES[name](spark, FOLDER))
    both = run("hash_sort_agg_agree")
    assert "SortAggregate" in both and "HashAggregate" in both
    assert "SortMergeJoin" in run("join_merge_forced") and "SortMergeJoin" in run("join_merge_full")
    assert "NestedLoop" in run("join_theta_only") or "CartesianProduct" in run("join_theta_only")
    assert "TakeOrdered" in run("with_ties_operator") and "rank(" not in run("with_ties")


def test_running_sums_have_no_single_task(spark):
    from pyspark.sql import Window

    rows = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5003).alias("k"), (F.col("id") % 10).alias("v"))
    out = relational.running_sum(rows, [F.col("k")], F.col("v"), "before")
    want = rows.withColumn("before", F.coalesce(F.sum("v").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    assert sorted(map(tuple, out.select("k", "before").collect())) == sorted(map(tuple, want.select("k", "before").collect()))
    for p in (plan(out), plan(ml.auc(rows.select((F.col("v") > 4).cast("int").alias("y"), F.col("k").cast("double").alias("s")), "y", "s"))):
        # the only row-wise task is the last sum of sums
        assert "Window" in p and "SinglePartition, ENSURE_REQUIREMENTS" not in p.split("Window", 1)[1]


@pytest.mark.parametrize("alpha", [0.01, 0.3, 0.999])
def test_ewma_of_a_long_series(spark, alpha):
    rng = np.random.default_rng(1)
    x = rng.random(1500)
    rows = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)] + [("b", 0, 2.0), (None, 5, 3.0), (None, 6, 5.0)], "k string, t int, v double")
    got = {(r.k, r.t): r.ewma for r in workload.ewma(rows, "k", "t", "v", alpha).collect()}
    e = x[0]
    for i, v in enumerate(x):
        e = e if i == 0 else e * (1 - alpha) + v * alpha
        assert got["a", i] == pytest.approx(e, rel=1e-9)
    assert got["b", 0] == 2.0 and got[None, 6] == pytest.approx(3 * (1 - alpha) + 5 * alpha) and len(got) == 1503


def test_vector_index(spark, tmp_path):
    from larkspur.functions import geo
    from larkspur.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    e = spark.read.parquet(f"{folder}/embeddings.parquet")
    exact = {(r.query_id, r.neighbor_id) for r in ml.knn(e.where("vec_id % 50 = 0"), e, 10, "vec_id", "vec_id", "embedding", geo.l2).collect()}
    found = {(r.query_id, r.neighbor_id) for r in QUERIES["ann_ivf"](spark, folder).collect()}
    assert len(exact) >= 100 and len(found & exact) >= 0.9 * len(exact)
    index = ml.VectorIndex.build(e.where("vec_id > 3"), "vec_id", "embedding", str(tmp_path / "v"), 8)
    assert index.size() == e.count() - e.where("vec_id <= 3").count()
    index.insert(e.where("vec_id <= 3"), "vec_id", "embedding")
    assert index.size() == e.count() and {r.vec_id for r in index.retrieve([2, 70]).collect()} == {2, 70}
    one = index.query(e.where("vec_id = 2"), "vec_id", "embedding", 1, 1, geo.l2).first()
    assert (one.neighbor_id, one.distance) == (2, 0.0)


def test_neighbours_of_many_queries(spark, monkeypatch):
    from larkspur.functions import geo

    e = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    ask = lambda: sorted(map(tuple, ml.knn(e.where("vec_id % 9 = 0"), e, 3, "vec_id", "vec_id", "embedding", geo.l2).collect()))
    want = ask()
    monkeypatch.setattr(ml, "QUERIES", 4)
    assert ask() == want


def test_many_categories_use_a_dictionary(spark, monkeypatch):
    p = spark.read.parquet(f"{FOLDER}/part.parquet")
    few = sorted(map(tuple, ml.label_encoder(p, "p_brand").apply(p).select("p_partkey", "p_brand").collect()))
    monkeypatch.setattr(ml, "CATEGORIES", 3)
    assert sorted(map(tuple, ml.label_encoder(p, "p_brand").apply(p).select("p_partkey", "p_brand").collect())) == few
    with pytest.raises(ValueError):
        ml.one_hot(p, "p_brand")


# ---------------------------------------------------------------- queries without SQL of another engine


def test_results_that_sql_cannot_tell(spark):
    from larkspur.queries import QUERIES

    run = lambda name: QUERIES[name](spark, FOLDER)
    li = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    r, true = run("agg_approx_distinct").first(), li.agg(F.count_distinct("l_partkey").alias("p"), F.count_distinct("l_orderkey").alias("o")).first()
    assert abs(r.parts - true.p) <= 0.12 * true.p and abs(r.orders - true.o) <= 0.05 * true.o
    v = np.array([x.normal_rand for x in run("normal_rand").collect()])
    assert len(v) == 1000 and abs(v.mean() - 5) < 0.3 and abs(v.std() - 2) < 0.2
    x = np.array([tuple(r) for r in li.select("l_quantity", "l_extendedprice", "l_discount").collect()])
    pcs = np.array([(r.pc1, r.pc2) for r in run("pca").collect()])
    values = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    assert np.allclose(pcs.var(axis=0), values[:2], rtol=1e-3) and abs(np.corrcoef(pcs.T)[0, 1]) < 1e-3
    rows = run("predict_class").collect()
    share = max(sum(r.o_orderstatus == c for r in rows) for c in "FOP") / len(rows)
    assert {r.o_orderstatus for r in rows} == set("FOP") and {r.prediction for r in rows} <= set("FOP")
    assert sum(r.prediction == r.o_orderstatus for r in rows) / len(rows) >= share - 0.02
    prepared = run("prepare_pipeline").toPandas()
    train = prepared[prepared.p_partkey % 4 != 0]
    assert abs(train.p_size.mean()) < 1e-9 and abs(train.p_size.std(ddof=0) - 1) < 1e-6 and not prepared.isna().any().any()
    n = li.count()
    for name in ("tablesample_bernoulli", "tablesample_system"):
        assert 0 <= run(name).count() <= n


def test_samples(spark):
    t = spark.range(1000)
    got = [r.id for r in relational.system_rows(t, 20, 3).collect()]
    assert len(set(got)) == 20 and max(got) > 40 and relational.system_rows(t, 5000).count() == 1000
    assert 0 <= relational.system_time(t, 0.001).count() <= 1000 and relational.system_time(t, 1e9).count() == 1000


def test_time_zones_by_type(spark):
    r = dialect.sql(spark, "SELECT cast(a AT TIME ZONE 'Asia/Tokyo' AS string) AS a, cast(b AT TIME ZONE 'Asia/Tokyo' AS string) AS b FROM (SELECT TIMESTAMP_NTZ '2020-01-01 09:00:00' AS a, TIMESTAMP '2020-01-01 00:00:00' AS b)").first()
    assert (r.a, r.b) == ("2020-01-01 00:00:00", "2020-01-01 09:00:00")


# ---------------------------------------------------------------- layered models


@pytest.fixture(scope="module")
def curve(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(-2, 2, (4000, 2))
    rows = [(i, float(a), float(b), float(a * b + a), "in" if a * a + b * b < 2 else "out") for i, (a, b) in enumerate(x)]
    spark.createDataFrame([*rows, (9999, None, 1.0, None, None)], 'id long, a double, b double, y double, ring string').createOrReplaceTempView("curve")
    return rows


def test_networks_learn_what_lines_cannot(spark, curve):
    err = {}
    for kind in ("linear", "mlp", "cross"):
        out = dialect.sql(spark, f"PREDICT VALUE OF y FROM curve WHERE id < 9000 TRAIN ON a, b USING MODEL {kind}")
        err[kind] = out.selectExpr("avg((prediction - y) * (prediction - y)) AS e").first().e
    assert err["mlp"] < 0.1 * err["linear"] and err["cross"] < 0.01 * err["linear"]
    got = dialect.sql(spark, "PREDICT CLASS OF ring FROM curve WHERE id < 9000 TRAIN ON a * a, b * b, \"a\" WITH id < 3000 USING MODEL linear")
    assert got.where("prediction = ring").count() > 0.97 * got.count() and got.columns == ["id", "a", "b", "y", "ring", "prediction"]
    closed = dialect.sql(spark, "PREDICT VALUE OF y FROM curve WHERE id < 9000 TRAIN ON a * b, a")
    assert closed.where("abs(prediction - y) > 1e-6").count() == 0 and "prediction" in closed.columns


def test_network_gradient():
    from larkspur.operators import models

    rng = np.random.default_rng(0)
    x, y = rng.standard_normal((50, 3)), rng.standard_normal(50)
    net = models.Network("mlp", list("abc"), None, [np.stack([np.zeros(3), np.ones(3)]), rng.standard_normal((4, 5)), rng.standard_normal((6, 1))])
    loss = lambda: 0.5 * float(((net.forward(x)[-1][:, 0] - y) ** 2).mean())
    h = net.forward(x)
    d = (h[-1] - y[:, None]) / len(x)
    g2 = np.concatenate([h[1].T @ d, d.sum(axis=0, keepdims=True)])
    d = (d @ net.layers[2][:-1].T) * (h[1] > 0)
    g1 = np.concatenate([h[0].T @ d, d.sum(axis=0, keepdims=True)])
    for k, g, at in ((1, g1, (2, 3)), (1, g1, (3, 1)), (2, g2, (4, 0))):
        w = net.layers[k][at]
        net.layers[k][at] = w + 1e-5
        up = loss()
        net.layers[k][at] = w - 1e-5
        assert abs((up - loss()) / 2e-5 - g[at]) < 1e-6
        net.layers[k][at] = w


def test_model_store(spark, curve, tmp_path):
    from larkspur.operators import models

    store = models.Store(spark, str(tmp_path / "m"), tolerance=1e-3)
    assert store.lookup("curve", ["a", "b"], "y", "value") is None
    one = models.train(store, "curve", ["a", "b"], "y", "mlp", epoch=2)
    assert store.lookup("curve", ["b", "a"], "y", "value") == one and store.lookup("curve", ["a"], "y", "value") is None
    first = store.load(one)
    before = max(r.create_time for r in store.table("layer").collect())
    models.finetune(store, one, spark.table("curve").where("id < 500"), "y", epoch=1)
    tuned = store.load(one)
    assert any(np.abs(a - b).max() > 0.01 for a, b in zip(first.layers, tuned.layers))
    old = store.load(one, before)
    assert all((a == b).all() for a, b in zip(first.layers, old.layers))
    rows = store.table("layer").collect()
    # a tuned layer is coded against the one before it, in fewer bits
    assert any(r.base_model == one for r in rows) and len(rows) == 2 * len(first.layers)
    w = tuned.layers[1] + 1
    store.update(one, 1, w)
    assert np.abs(store.load(one).layers[1] - w).max() <= 1.001e-3
    out = models.inference(store, one, spark.table("curve"))
    assert out.where("prediction is null").count() == 0 and out.count() == 4001
    store.delete(one)
    assert store.lookup("curve", ["a", "b"], "y", "value") is None
    with pytest.raises(KeyError):
        store.load(one)


def test_tensor_packets():
    from larkspur.operators import models

    rng = np.random.default_rng(4)
    x = rng.standard_normal((7, 5))
    for base, tolerance in ((None, 1e-3), (x + rng.standard_normal((7, 5)) * 0.01, 1e-4), (x, 1e-6)):
        p = models.pack(x, base, tolerance)
        assert np.abs(models.unpack(p, base) - x).max() <= tolerance * 1.0001
    assert models.pack(x, x, 1e-6)["bits"] == 0 and models.pack(x, x + 0.01, 1e-3)["bits"] <= 1 < models.pack(x, None, 1e-3)["bits"]


def test_predict_uses_stored_models(spark, curve, tmp_path):
    from larkspur.operators import models

    spark.conf.set("larkspur.models", str(tmp_path / "kept"))
    spark.conf.set("larkspur.epoch", "1")
    try:
        ask = "PREDICT VALUE OF y FROM curve WHERE id < 50 TRAIN ON {}"
        one = [r.prediction for r in dialect.sql(spark, ask.format("a, b")).orderBy("id").collect()]
        again = [r.prediction for r in dialect.sql(spark, ask.format("a, b")).orderBy("id").collect()]
        dialect.sql(spark, ask.format("a"))
        store = models.Store(spark, str(tmp_path / "kept"))
        assert one == again and store.table("model").count() == 2 and store.table("router").count() == 2
    finally:
        spark.conf.unset("larkspur.models")
        spark.conf.unset("larkspur.epoch")


# ---------------------------------------------------------------- advice that outlives the driver


def test_advisor_goes_on_in_another_driver(spark, tmp_path):
    path, owners, sizes = str(tmp_path / "advice"), {"o_orderkey": "orders", "l_quantity": "lineitem"}, {"orders": 8.0, "lineitem": 30.0}
    one = workload.LayoutAdvisor(spark, 10, path=path)
    assert one.enqueue("SELECT * FROM orders WHERE o_orderkey = 1") and not one.enqueue("DELETE FROM orders")
    two = workload.LayoutAdvisor(spark, 10, path=path)
    assert len(two.queue) == 1 and two.work(owners, sizes) == [("orders", "o_orderkey")]
    three = workload.LayoutAdvisor(spark, 40, path=path)
    assert three.queue == [] and three.registry == {("orders", "o_orderkey"): 8.0} and three.scores == two.scores
    assert three.drop("orders", "o_orderkey") and not three.drop("orders", "o_orderkey")
    assert workload.LayoutAdvisor(spark, 40, path=path).registry == {}


def test_router_learns_from_the_buffer(spark, tmp_path):
    spark.read.parquet(f"{FOLDER}/orders.parquet").createOrReplaceTempView("orders")
    spark.read.parquet(f"{FOLDER}/customer.parquet").createOrReplaceTempView("customer")
    sql = "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment"
    buffer, tried = workload.PlanBuffer(spark, str(tmp_path / "b")), []
    for _ in range(3):
        name, df = workload.routed(spark, sql, {"orders": 10**6, "customer": 10**5}, buffer)
        tried.append((name, tuple(map(str, sorted(map(tuple, df.collect()))))))
        for _ in range(3):
            buffer.run(df, sql, name)
    assert [n for n, _ in tried] == ["broadcast", "default", "merge"] and len({r for _, r in tried}) == 1
    again = workload.PlanBuffer(spark, str(tmp_path / "b"))
    assert len(again.rows) == 9 and again.table(spark).count() == 9 and again.best(sql) in workload.EXPERTS
    f = workload.plan_features(spark.sql(sql))
    assert f[0] == 1.0 and f[1] >= 1.0
    for r in again.rows:
        r["latency"] = {"broadcast": 3.0, "default": 1.0, "merge": 2.0}[r["expert"]]
    assert again.route(list(workload.EXPERTS), f) == "default"


def test_forecaster(spark):
    rows = [(k, x, 2.0 * x + (5 if k == "a" else 0)) for k in "ab" for x in range(12)] + [("short", x, 1.0) for x in range(3)]
    f = workload.Forecaster("k", "x", "y").fit(spark.createDataFrame(rows, "k string, x long, y double"))
    got = sorted(map(tuple, f.predict(2).collect()))
    assert [(k, x, round(v, 6)) for k, x, v in got] == [("a", 12, 29.0), ("a", 13, 31.0), ("b", 12, 24.0), ("b", 13, 26.0)]
    r = f.evaluate(spark.createDataFrame([("a", 12, 30.0), ("b", 12, 24.0), ("short", 3, 1.0), ("b", 0, 0.0)], "k string, x long, y double")).first()
    assert (round(r.mae, 6), r.n) == (round(1 / 3, 6), 3) and r.mape == pytest.approx(100 / 30 / 2)


# ---------------------------------------------------------------- statements about statements


def test_explain_and_settings(spark):
    spark.range(5).createOrReplaceTempView("five")
    text = lambda s: "\n".join(r[0] for r in dialect.sql(spark, s).collect())
    assert "Range" in text("EXPLAIN SELECT id FROM five ORDER BY id") and "Execution Time" not in text("EXPLAIN (VERBOSE) SELECT id FROM five")
    assert "Execution Time" in text("EXPLAIN (ANALYZE, FORMAT JSON) SELECT count(*) FROM five") and text("EXPLAIN (FORMAT JSON) SELECT 1").startswith("[")
    name = "spark.sql.shuffle.partitions"
    old = spark.conf.get(name)
    try:
        assert dialect.sql(spark, f"SET LOCAL {name} TO '5'").first()[0] == "5" and dialect.sql(spark, f"SHOW {name}").first()[0] == "5"
    finally:
        spark.conf.set(name, old)


def test_statements_are_alike():
    a, b = "SELECT *  FROM t -- all\nWHERE x IN (1, 2,3) AND s = 'it''s'", "select * from T where X in (7) and s = 'b' ;"
    assert dialect.normalize(a) == "select * from t where x in (?) and s = ?" and dialect.fingerprint(a) == dialect.fingerprint(b)
    assert dialect.fingerprint(a) != dialect.fingerprint("select 1 from t")


def test_every_order_puts_nulls_in_their_place():
    r = dialect.rewrite("SELECT max(x) OVER (PARTITION BY a ORDER BY b, f(c, d) DESC ROWS 1 PRECEDING), mode() WITHIN GROUP (ORDER BY e) FROM (SELECT * FROM t ORDER BY g LIMIT 3) ORDER BY h NULLS FIRST, i")
    assert r == "SELECT max(x) OVER (PARTITION BY a ORDER BY b NULLS LAST, f(c, d) DESC NULLS FIRST ROWS 1 PRECEDING), mode() WITHIN GROUP (ORDER BY e) FROM (SELECT * FROM t ORDER BY g NULLS LAST LIMIT 3) ORDER BY h NULLS FIRST, i NULLS LAST"


def test_grouped_keys_determine_columns(spark):
    from pyspark.errors import AnalysisException

    spark.createDataFrame([(1, "a", 2), (2, "b", 3)], "pk long, name string, v int").createOrReplaceTempView("keyed")
    ask = "SELECT pk, name AS called, sum(v) AS s FROM keyed GROUP BY pk ORDER BY pk"
    with pytest.raises(AnalysisException):
        dialect.sql(spark, ask)
    catalog.primary_key("keyed", "pk")
    assert [tuple(r) for r in dialect.sql(spark, ask).collect()] == [(1, "a", 2), (2, "b", 3)]
    with pytest.raises(AnalysisException):
        dialect.sql(spark, "SELECT pk, name FROM keyed GROUP BY name")


def test_sequences(spark, tmp_path):
    one, two = (relational.Sequence(spark, str(tmp_path / "s"), start=10, increment=5, cache=3) for _ in range(2))
    got = [one.nextval() for _ in range(4)] + [two.nextval() for _ in range(2)]
    assert got[:3] == [10, 15, 20] and len(set(got)) == 6 and all((v - 10) % 5 == 0 for v in got)
    rows = one.assign(spark.range(50).unionByName(spark.range(50)), "n").collect()
    numbers = {r.n for r in rows}
    assert len(numbers) == 100 and numbers.isdisjoint(got) and two.nextval() not in numbers

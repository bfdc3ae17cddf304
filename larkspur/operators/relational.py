"""Relational operators that Spark lacks, as plans of those it has."""

from __future__ import annotations

import math
import time
import uuid
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_folder


def ordering(*terms: str) -> list[Column]:
    """``"a"``, ``"b desc"``, ``"c nulls first"``: ascending puts nulls last, descending first."""
    out = []
    for t in terms:
        words = t.lower().split()
        name = t.split()[0]
        desc, first = "desc" in words, ("first" in words) if "nulls" in words else "desc" in words
        c = F.col(name)
        out.append((c.desc_nulls_first() if first else c.desc_nulls_last()) if desc else (c.asc_nulls_first() if first else c.asc_nulls_last()))
    return out


def sort(df: DataFrame, *terms: str) -> DataFrame:
    return df.orderBy(*ordering(*terms))


def distinct_on(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key in the given order; Spark keeps one row a key before the shuffle (rank limit pushdown)."""
    w = Window.partitionBy(*keys).orderBy(*ordering(*order))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def fetch_with_ties(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows and all that tie with the last of them, without sorting the whole table.

    The ``n``-th place's keys come from a top-n (one small row); a filter then finds every row at or before it.
    """
    names = [t.split()[0] for t in order]
    last = df.select(*names).orderBy(*ordering(*order)).limit(n)
    edge = last.withColumn("_rn", F.row_number().over(Window.orderBy(*ordering(*order)))).groupBy().agg(F.max_by(F.struct(*names), "_rn").alias("_edge"))
    keep = reduce(lambda rest, t: _at_or_before(t, rest), reversed(order), F.lit(True))
    return df.crossJoin(F.broadcast(edge)).where(keep).drop("_edge")


def _at_or_before(term: str, rest: Column) -> Column:
    name, words = term.split()[0], term.lower().split()
    desc, first = "desc" in words, ("first" in words) if "nulls" in words else "desc" in words
    x, e = F.col(name), F.col(f"_edge.{name}")
    less = (x > e) if desc else (x < e)
    nulls = (x.isNull() & e.isNotNull()) if first else (x.isNotNull() & e.isNull())
    return F.coalesce(less, F.lit(False)) | nulls | (x.eqNullSafe(e) & rest)


# ---------------------------------------------------------------- data changes as queries


class CardinalityViolation(ValueError):
    """A statement would change one row twice."""


def insert_on_conflict(target: DataFrame, source: DataFrame, keys: list[str], update: list[str] | None = None) -> DataFrame:
    """``INSERT … ON CONFLICT (keys) DO NOTHING``, or ``DO UPDATE SET`` the named columns to the new values.

    Of new rows with one key DO NOTHING inserts one, the least in column order; DO UPDATE refuses them. A null in a key
    conflicts with nothing.
    """
    some = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    keyed, free = source.where(some), source.where(~some).select(target.columns)
    fresh = keyed.join(target.select(keys), keys, "left_anti").select(target.columns)
    if not update:
        once = fresh.groupBy(*keys).agg(F.min(F.struct(*target.columns)).alias("_r")).select("_r.*")
        return target.unionByName(once).unionByName(free)
    if keyed.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise CardinalityViolation("ON CONFLICT DO UPDATE command cannot affect row a second time")
    new = keyed.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in update), F.lit(True).alias("_hit"))
    changed = target.join(new, keys, "left").select(*(F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in update else F.col(c) for c in target.columns))
    return changed.unionByName(fresh).unionByName(free)


@dataclass
class When:
    """One action of ``MERGE``. ``kind``: ``both``, ``source`` (not matched by the target) or ``target`` (not matched by the source);
    ``action``: ``update``, ``delete``, ``insert`` or ``nothing``; ``values``: new values by column."""

    kind: str
    action: str
    condition: Column | str | None = None
    values: dict = field(default_factory=dict)


def merge(target: DataFrame, source: DataFrame, keys: list[str], *whens: When) -> DataFrame:
    """``MERGE``: the target after the first fitting action of each row. In expressions target columns are ``t.…``, source columns ``s.…``.

    Source rows may repeat a key as long as no target row is changed twice; those without a match are inserted one by one.
    """
    on = reduce(lambda a, b: a & b, (F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys))
    state = {"both": F.col("s._source").isNotNull(), "target": F.col("s._source").isNull(), "source": F.lit(True)}

    def which(kinds: set[str]) -> Column:
        out = F.lit(None).cast("int")
        for i, w in reversed([(i, w) for i, w in enumerate(whens) if w.kind in kinds]):
            out = F.when(state[w.kind] & (F.lit(True) if w.condition is None else F.coalesce(w.condition, F.lit(False))), F.lit(i)).otherwise(out)
        return out

    def values(action: str, c: str, old: Column) -> Column:
        out = old
        for i, w in enumerate(whens):
            if w.action == action and c in w.values:
                out = F.when(F.col("_which") == i, w.values[c]).otherwise(out)
        return out.cast(target.schema[c].dataType).alias(c)

    t = target.withColumn("_row", F.monotonically_increasing_id()).alias("t")
    s = source.withColumn("_source", F.lit(True)).alias("s")
    acts = [i for i, w in enumerate(whens) if w.action != "nothing"]
    rows = t.join(s, on, "left").withColumn("_which", which({"both", "target"}))
    acting = F.col("_which").isin(acts)
    # the row's number is drawn once in each plan, and compared within it only
    if rows.where(acting).groupBy("t._row").count().where("count > 1").limit(1).count():
        raise CardinalityViolation("MERGE command cannot affect row a second time")
    first = Window.partitionBy("t._row").orderBy(F.coalesce(acting, F.lit(False)).desc())
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    gone = [i for i, w in enumerate(whens) if w.action == "delete"]
    old = rows.where(~F.coalesce(F.col("_which").isin(gone), F.lit(False))).select(*(values("update", c, F.col(f"t.{c}")) for c in target.columns))
    new = s.join(target.select(keys).alias("t"), on, "left_anti").withColumn("_which", which({"source"}))
    new = new.where(F.col("_which").isin([i for i, w in enumerate(whens) if w.action == "insert"]))
    return old.unionByName(new.select(*(values("insert", c, F.lit(None)) for c in target.columns)))


def update_from(target: DataFrame, source: DataFrame, keys: list[str], values: dict[str, str]) -> DataFrame:
    """``UPDATE … FROM``: target columns set to source columns where the keys match (at most one source row a key)."""
    s = source.dropDuplicates(keys).select(*keys, *(F.col(v).alias(f"_v_{c}") for c, v in values.items()), F.lit(True).alias("_hit"))
    return target.join(s, keys, "left").select(*(F.when(F.col("_hit"), F.col(f"_v_{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in target.columns))


def delete_using(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Returns what stays; the deleted rows are ``target.join(source, keys, "left_semi")``."""
    return target.join(source, keys, "left_anti")


# ---------------------------------------------------------------- joins


def asof_join(left: DataFrame, right: DataFrame, key: list[str], at: str, right_at: str, values: list[str], how: str = "left", span: float | None = None) -> DataFrame:
    """For each left row the right row of the same key with the latest ``right_at`` not after ``at``.

    Both sides are united and sorted once by key and time, and the last right values carried forward: the work is
    linear, where a range join would pair rows with all earlier ones. ``span``, in seconds or the time column's own unit, cuts
    the time of every key into ranges, each sorted by itself, for keys that hold more rows than a task should; the last right
    row of each range, one small row, is carried into those after it.
    """
    l_ = left.withColumn("_t", F.col(at)).withColumn("_side", F.lit(1))
    r_ = right.select(*key, F.col(right_at).alias("_t"), F.lit(0).alias("_side"), F.struct(F.col(right_at).alias(f"_{right_at}"), *values).alias("_r"))
    both = l_.withColumn("_r", F.lit(None).cast(r_.schema["_r"].dataType)).unionByName(r_, allowMissingColumns=True)
    parts = list(key)
    if span is not None:
        timed = both.schema["_t"].dataType.typeName() in ("timestamp", "timestamp_ntz", "date")
        number = F.unix_micros(F.col("_t").cast("timestamp")) / 1e6 if timed else F.col("_t").cast("double")
        both = both.withColumn("_range", F.floor(number / span))
        parts.append("_range")
    w = Window.partitionBy(*parts).orderBy(F.col("_t").asc_nulls_last(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_side = 1 AND _t IS NOT NULL")
    if span is not None:
        ends = both.where("_side = 0").groupBy(*parts).agg(F.max_by("_r", "_t").alias("_end"))
        every = _pairs(both.select(*parts).distinct(), ends, parts)
        before = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        carried = every.withColumn("_end", F.last("_end", ignorenulls=True).over(before))
        out = _pairs(out, carried, parts).withColumn("_r", F.coalesce("_r", "_end")).drop("_end", "_range")
    out = out.unionByName(both.drop("_range").where("_side = 1 AND _t IS NULL")) if how != "inner" else out.where("_r is not null")
    return out.select(*left.columns, F.col(f"_r._{right_at}").alias(f"matched_{right_at}"), *(F.col(f"_r.{v}").alias(v) for v in values))


def _pairs(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """A left join by keys that may be null."""
    c = b.withColumnsRenamed({k: f"_b_{k}" for k in keys})
    on = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in keys))
    return a.join(c, on, "left").drop(*(f"_b_{k}" for k in keys))


def range_join(points: DataFrame, ranges: DataFrame, at: str, lo: str, hi: str, width: float) -> DataFrame:
    """Pairs with ``lo <= at < hi``. Both sides are cut into bins of ``width``, so the join is an equi-join on bins.

    A pair meets in one bin only, that of its point.
    """
    p = points.withColumn("_bin", F.floor(F.col(at) / width))
    r = ranges.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    return p.join(r, "_bin").where((F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi))).drop("_bin")


def ordered_pairs(df: DataFrame, keys: list[str], at: str, names: tuple[str, str] = ("a", "b"), block: int = 1024, each: int = 8_000_000) -> DataFrame:
    """``names``: all pairs of values of ``at`` with the lesser first, from rows that are equal in ``keys`` (a self join on ``<``).

    A group's rows lie in order in blocks of ``block``, and each two blocks that can hold pairs are joined by themselves, so a
    task makes about ``each`` pairs however large a group is; the number of pairs is counted for that.
    """
    rows = df.where(reduce(lambda x, y: x & y, (F.col(c).isNotNull() for c in [*keys, at]))).select(*keys, F.col(at).alias("_at"))
    n = F.col("count").cast("double")
    made = rows.groupBy(*keys).count().agg(F.sum(n * (n - 1) / 2).alias("pairs")).first()["pairs"] or 0
    tasks = max(1, min(10_000, math.ceil(made / each)))
    group = Window.partitionBy(*keys)
    place = F.row_number().over(group.orderBy("_at")) - 1
    rows = rows.withColumn("_own", F.floor(place / block)).withColumn("_most", F.floor((F.count("*").over(group) - 1) / block))
    (a, b), unit = names, [*keys, "_i", "_j"]
    lesser = rows.select(*keys, F.col("_own").alias("_i"), F.explode(F.sequence("_own", "_most")).alias("_j"), F.col("_at").alias(a))
    later = rows.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), "_own")).alias("_i"), F.col("_own").alias("_j"), F.col("_at").alias(b))
    joined = lesser.repartition(tasks, *unit).join(later.repartition(tasks, *unit).hint("merge"), unit)
    return joined.where(F.col(a) < F.col(b)).select(a, b)


def salted_join(big: DataFrame, other: DataFrame, keys: list[str], salts: int, how: str = "inner") -> DataFrame:
    """An equi-join for hot keys outside adaptive execution's reach: the big side salted, the other repeated."""
    b = big.withColumn("_salt", F.floor(F.rand(17) * salts).cast("int"))
    o = other.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return b.join(o, [*keys, "_salt"], how).drop("_salt")


# ---------------------------------------------------------------- aggregation and windows


def group_by_distinct(df: DataFrame, sets: list[list[str]], aggs: list[Column]) -> DataFrame:
    """``GROUP BY DISTINCT`` over concatenated grouping sets: each distinct set once."""
    unique = list(dict.fromkeys(tuple(sorted(s)) for s in sets))
    names = sorted({c for s in unique for c in s})
    return df.groupingSets([[F.col(c) for c in s] for s in unique], *[F.col(c) for c in names]).agg(*aggs)


def rollup_sets(*columns: str) -> list[list[str]]:
    return [list(columns[:k]) for k in range(len(columns), -1, -1)]


def cube_sets(*columns: str) -> list[list[str]]:
    return [list(c) for k in range(len(columns), -1, -1) for c in combinations(columns, k)]


def product_of_sets(a: list[list[str]], b: list[list[str]]) -> list[list[str]]:
    return [list(dict.fromkeys([*x, *y])) for x in a for y in b]


def groups_frame(df: DataFrame, partition: list[str], order: str, before: int, after: int, aggs: dict[str, Column]) -> DataFrame:
    """``GROUPS BETWEEN before PRECEDING AND after FOLLOWING``: a range frame over the dense rank of peers."""
    ranked = df.withColumn("_g", F.dense_rank().over(Window.partitionBy(*partition).orderBy(*ordering(order))))
    w = Window.partitionBy(*partition).orderBy("_g").rangeBetween(-before, after)
    return ranked.withColumns({k: a.over(w) for k, a in aggs.items()}).drop("_g")


def sum_excluding(df: DataFrame, partition: list[str], order: list[str], value: str, exclude: str, name: str) -> DataFrame:
    """A partition's sum with ``EXCLUDE CURRENT ROW``, ``GROUP`` or ``TIES``; null where nothing is left."""
    whole, peers = Window.partitionBy(*partition), Window.partitionBy(*partition, *order)
    less = {"current row": F.col(value), "group": F.sum(value).over(peers), "ties": F.coalesce(F.sum(value).over(peers), F.lit(0)) - F.coalesce(F.col(value), F.lit(0))}[exclude]
    gone = {"current row": F.when(F.col(value).isNotNull(), 1).otherwise(0), "group": F.count(value).over(peers), "ties": F.count(value).over(peers) - F.when(F.col(value).isNotNull(), 1).otherwise(0)}[exclude]
    left = F.count(value).over(whole) - gone
    return df.withColumn(name, F.when(left > 0, F.sum(value).over(whole) - F.coalesce(less, F.lit(0))))


def hypothetical(df: DataFrame, value: str, at) -> DataFrame:
    """``rank, dense_rank, percent_rank, cume_dist (at) WITHIN GROUP (ORDER BY value)`` in one aggregation."""
    v, n = F.col(value), F.count(value)
    less = F.count_if(v < at)
    return df.agg(
        (less + 1).alias("rank"),
        (F.count_distinct(F.when(v < at, v)) + 1).alias("dense_rank"),
        (less / n).alias("percent_rank"),
        ((F.count_if(v <= at) + 1) / (n + 1)).alias("cume_dist"),
    )


# ---------------------------------------------------------------- tables from tables


def crosstab(df: DataFrame, row: str, category: str, value: str, categories: list[str]) -> DataFrame:
    """``crosstab(source, categories)``: one row a row name, one column a category."""
    return df.groupBy(row).pivot(category, categories).agg(F.first(value, ignorenulls=True))


def crosstab_positional(df: DataFrame, row: str, category: str, value: str, n: int) -> DataFrame:
    """``crosstab(source)``: values fill ``n`` columns from the left in category order, whatever the categories."""
    ranked = df.withColumn("_i", F.row_number().over(Window.partitionBy(row).orderBy(*ordering(category))))
    return ranked.where(F.col("_i") <= n).groupBy(row).agg(*(F.max(F.when(F.col("_i") == i, F.col(value))).alias(f"category_{i}") for i in range(1, n + 1)))


def connectby(df: DataFrame, key: str, parent: str, start, max_depth: int = 0, delim: str = "~") -> DataFrame:
    """``keyid, parent_keyid, level, branch`` of the tree below ``start``; a row that is its own ancestor is an error.

    Breadth-first: each round joins the frontier with the edges and writes what it found to the shared folder, which cuts
    the lineage; the driver sees one flag a round.
    """
    spark, folder = df.sparkSession, f"{shared_folder(df.sparkSession)}/larkspur-{uuid.uuid4().hex}"
    edges = df.select(F.col(key).alias("keyid"), F.col(parent).alias("parent_keyid"))
    frontier = edges.where(F.col("keyid") == start).limit(1).select("keyid", F.lit(None).cast(edges.schema["parent_keyid"].dataType).alias("parent_keyid"), F.lit(0).alias("level"), F.col("keyid").cast("string").alias("branch"))
    found, level = frontier, 0
    while not max_depth or level < max_depth:
        level += 1
        f = frontier.select(F.col("keyid").alias("parent_keyid"), F.col("branch").alias("_up"))
        frontier = edges.join(f, "parent_keyid").select("keyid", "parent_keyid", F.lit(level).alias("level"), F.concat("_up", F.lit(delim), F.col("keyid").cast("string")).alias("branch"), "_up")
        frontier.write.parquet(f"{folder}-{level}")
        frontier = spark.read.schema(frontier.schema).parquet(f"{folder}-{level}")
        loop = frontier.where(F.array_contains(F.split("_up", "\\Q" + delim + "\\E"), F.col("keyid").cast("string"))).limit(1).count()
        if loop:
            raise ValueError("infinite recursion detected")
        if frontier.isEmpty():
            break
        frontier = frontier.drop("_up")
        found = found.unionByName(frontier)
    return found


def running_sum(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over all rows before each row in the order, without one task that holds all rows.

    Rows are dealt into ranges and written, so that they lie the same in both readings; one sum a range meets the driver.
    """
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/larkspur-{uuid.uuid4().hex}"
    df.withColumn("_v", value).repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()).write.parquet(path)
    placed = spark.read.parquet(path)
    total, rows = 0, []
    for r in sorted(placed.groupBy("_pid").agg(F.sum("_v").alias("s")).collect()):
        rows.append((r["_pid"], total))
        total += r["s"] or 0
    kind = placed.schema["_v"].dataType.simpleString()
    base = spark.createDataFrame(rows, f"_pid int, _base {kind if kind == 'double' else 'bigint'}")
    before = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(F.broadcast(base), "_pid").withColumn(name, F.col("_base") + F.coalesce(F.sum("_v").over(before), F.lit(0))).drop("_pid", "_base", "_v")


def generate_series(spark, start: int, stop: int, step: int = 1) -> DataFrame:
    return spark.range(start, stop + (1 if step > 0 else -1), step).select(F.col("id").alias("generate_series"))


def normal_rand(spark, n: int, mean: float, sd: float, seed: int = 0) -> DataFrame:
    return spark.range(n).select((F.randn(seed) * sd + mean).alias("normal_rand"))


def unnest_lockstep(df: DataFrame, **arrays: str) -> DataFrame:
    """Several arrays unnested side by side, short ones filled with nulls, with ``ordinality``."""
    zipped = F.arrays_zip(*(F.col(a).alias(n) for n, a in arrays.items()))
    out = df.select("*", F.posexplode(zipped).alias("_i", "_z"))
    return out.select(*df.columns, (F.col("_i") + 1).alias("ordinality"), *(F.col("_z")[n].alias(n) for n in arrays))


def tablesample(df: DataFrame, method: str, percent: float, seed: int | None = None) -> DataFrame:
    """``TABLESAMPLE BERNOULLI | SYSTEM (percent) [REPEATABLE (seed)]``: rows, or whole partitions of the scan."""
    if percent is None or not 0 <= percent <= 100:
        raise ValueError("sample percentage must be between 0 and 100")
    if method.lower() == "bernoulli":
        return df.sample(fraction=percent / 100, seed=seed)
    if method.lower() != "system":
        raise ValueError(f"tablesample method {method} does not exist")
    kept = F.pmod(F.xxhash64(F.spark_partition_id(), F.lit(seed or 0)), F.lit(10000)) < percent * 100
    return df.where(kept)


def system_rows(df: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """``TABLESAMPLE system_rows(n)``: ``n`` rows drawn at random, or all if there are fewer, by a top-n of random keys."""
    return df.withColumn("_u", F.rand(seed)).orderBy("_u").limit(n).drop("_u")


def system_time(df: DataFrame, ms: float, seed: int = 0) -> DataFrame:
    """``TABLESAMPLE system_time(ms)``: what can be read in about so long. The rate is measured on a thousandth of the rows."""
    share, start = 0.001, time.perf_counter()
    df.sample(share, seed).write.format("noop").mode("overwrite").save()
    spent = max(time.perf_counter() - start, 1e-3) * 1000
    return df.sample(min(1.0, share * ms / spent), seed) if ms / spent * share < 1 else df


def recursive_union(start: DataFrame, step, cycle: list[str] | None = None, search: tuple[str, list[str]] | None = None, distinct: bool = False) -> DataFrame:
    """``WITH RECURSIVE`` with ``CYCLE`` and ``SEARCH``: ``step`` makes the next rows from the last ones, until there are none.

    ``cycle``: columns whose values tell a row; ``is_cycle`` marks a row that its own path holds already, from which nothing
    goes on, ``path`` is what led to it. ``search``: ``("depth" | "breadth", columns)`` adds ``ordercol`` to sort by.
    ``distinct``: as ``UNION``, rows found before don't go on. Each round is written to the shared folder, which cuts the
    lineage; the driver sees one flag a round. ``step`` must carry ``path`` and ``ordercol`` along, which it finds in its rows.
    """
    spark, folder = start.sparkSession, f"{shared_folder(start.sparkSession)}/larkspur-{uuid.uuid4().hex}"
    names = start.columns

    def marked(df: DataFrame, before: bool, level: int) -> DataFrame:
        if cycle:
            own = F.struct(*cycle)
            df = df.withColumn("is_cycle", F.array_contains("path", own) if before else F.lit(False)).withColumn("path", F.concat(F.col("path"), F.array(own)) if before else F.array(own))
        if search:
            here = F.array(F.struct(*search[1]))
            order = F.concat(F.col("ordercol.keys"), here) if before and search[0] == "depth" else here
            df = df.withColumn("ordercol", F.struct(F.lit(0 if search[0] == "depth" else level).alias("level"), order.alias("keys")))
        return df

    def written(df: DataFrame, level: int) -> DataFrame:
        df.write.parquet(f"{folder}-{level}")
        return spark.read.schema(df.schema).parquet(f"{folder}-{level}")

    last = written(marked(start.distinct() if distinct else start, False, 0), 0)
    found, level = last, 0
    while True:
        level += 1
        new = marked(step(last.where("NOT is_cycle") if cycle else last), True, level).select(last.columns)
        if distinct:
            new = new.dropDuplicates(names).join(found.select(*(F.col(c).alias(f"_f_{c}") for c in names)), reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_f_{c}")) for c in names)), "left_anti")
        last = written(new, level)
        if last.isEmpty():
            return found
        found = found.unionByName(last)


class Sequence:
    """``CREATE SEQUENCE``: numbers that outlive the driver. Each take makes a file named by its first number, which only one
    can make; the file holds how many numbers were taken. Gaps are allowed, as with any cached sequence."""

    def __init__(self, spark, path: str, start: int = 1, increment: int = 1, cache: int = 100):
        self.path, self.start, self.increment, self.cache = path.rstrip("/"), start, increment, cache
        self.left: list[int] = []
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.path))

    def _take(self, n: int) -> int:
        """The place of the first of ``n`` numbers that no one else gets."""
        while True:
            names = sorted(x.getPath().getName() for x in self._fs.listStatus(self._path(self.path)))
            first = 0
            if names:
                f = self._fs.open(self._path(f"{self.path}/{names[-1]}"))
                held = f.readLine()
                f.close()
                if not held:  # another driver is writing it
                    time.sleep(0.05)
                    continue
                first = int(names[-1]) + int(held)
            try:
                out = self._fs.create(self._path(f"{self.path}/{first:020d}"), False)
            except Exception as e:
                if "exist" not in str(e).lower():
                    raise
                continue
            out.writeBytes(f"{n}\n")
            out.close()
            return first

    def nextval(self) -> int:
        if not self.left:
            first = self._take(self.cache)
            self.left = [self.start + (first + i) * self.increment for i in range(self.cache)][::-1]
        return self.left.pop()

    def assign(self, df: DataFrame, column: str) -> DataFrame:
        """``DEFAULT nextval``: a number of the sequence for every row, drawn in one take."""
        first = self._take(max(1, df.count()))
        n = running_sum(df, [F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))], F.lit(1).cast("long"), "_n")
        return n.withColumn(column, F.lit(self.start) + (F.col("_n") + first) * self.increment).drop("_n")

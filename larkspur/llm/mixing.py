"""Mixing sources to target weights by weighted sampling without replacement.

Every document draws an exponential key divided by its quality weight; the keys' order is the sampling order (the
Efraimidis-Spirakis scheme). A source first gives as many complete epochs as fit its target, then its documents in
key order while their sizes, summed, stay within what is left of the budget.

No source is sorted whole: keys fall into buckets by their logarithm (none holds more than some 0.5 % of a source),
bucket sums are aggregated before they travel, and only the bucket where a source's budget ends goes on. It is cut into
finer buckets again and again until ``EDGE_ROWS`` places are left to sort. The draw depends on ``doc_id`` (the text's
digest where there is none) and ``seed`` alone, so reruns agree whatever the partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

CAP, EDGE_ROWS, FINER = 3, 200_000, 1024
WEIGHTS = (1, 2, 3)
SYMBOLS = "#$%&*|!@^~<>{}=+_\\/"
WORD = r"[^\x20\x09-\x0D]+"


def quality_weight(text: Column) -> Column:
    """The share of a text that isn't symbols, 0.05 at least; 0.05 for null and empty texts."""
    return F.greatest(F.lit(0.05), F.coalesce(F.try_divide(F.length(F.translate(text, SYMBOLS, "")).cast("double"), F.length(text)), F.lit(0.05)))


def sampling_key(doc_id: Column, text: Column, weight: Column, seed: int) -> Column:
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.log(u) / weight


def _drawn(docs: DataFrame, seed: int, *more: Column) -> DataFrame:
    """``doc_id, source, _size, _key`` of each row, and further columns over ``docs``."""
    text, doc_id, source = (F.col(c) if c in docs.columns else F.lit(None).cast(t) for c, t in (("text", "string"), ("doc_id", "long"), ("source", "string")))
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(doc_id.alias("doc_id"), source.alias("source"), size.alias("_size"), sampling_key(doc_id, text, quality_weight(text), seed).alias("_key"), *more)


def _octave() -> Column:
    return F.log2("_key") * 64


def _bucket() -> Column:
    return F.floor(_octave()).cast("long")


def numbered(df: DataFrame, column: str) -> DataFrame:
    """``_n``: each row's place by ``column``, nulls last, without one task that holds all rows."""
    placed = C.materialize(df.repartitionByRange(F.col(column).asc_nulls_last()).withColumn("_pid", F.spark_partition_id()), "mix-sources")
    # a row for each partition comes to the driver
    start, rows = 0, []
    for r in sorted(placed.groupBy("_pid").count().collect(), key=lambda r: r["_pid"]):
        rows.append((r["_pid"], start))
        start += r["count"]
    base = df.sparkSession.createDataFrame(rows, "_pid int, _base long")
    w = Window.partitionBy("_pid").orderBy(F.col(column).asc_nulls_last())
    return placed.join(F.broadcast(base), "_pid").withColumn("_n", F.col("_base") + F.row_number().over(w) - 1).drop("_pid", "_base")


def targets(sizes: DataFrame) -> DataFrame:
    """``sizes(source, source_size)`` with each source's ``target``.

    Sources in code-point order, null last, weigh 1, 2, 3, 1, 2, 3 and so on and share all words; no target is above
    ``CAP`` times its source's size, and what is cut off is shared anew by weight. Only sums come to the driver.
    """
    table = numbered(sizes, "source").withColumn("_w", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("_n") % len(WEIGHTS) + 1).cast("int"))).drop("_n")
    table = C.materialize(table, "mix-weights")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        over = F.col("source_size") * CAP <= F.lit(level) * F.col("_w")
        row = table.agg(
            F.coalesce(F.sum(F.when(over, F.col("source_size") * CAP)), F.lit(0)).alias("fixed"),
            F.coalesce(F.sum(F.when(~over, F.col("_w"))), F.lit(0)).alias("free"),
            F.count_if(over).alias("n"),
        ).first()
        if row.n == capped or not row.free:
            break
        level, capped = (total - row.fixed) / row.free, row.n
    return table.withColumn("target", F.least((F.col("source_size") * CAP).cast("double"), F.lit(level) * F.col("_w"))).drop("_w")


def _ending(sums: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """Of ``sums(keys…, bucket, _sum, _from, _left)`` the bucket where each budget ends, with ``_before``, the words up to it."""
    w = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_from") + F.coalesce(F.sum("_sum").over(w), F.lit(0))
    return sums.withColumn("_before", before).where("_before <= _left and _left < _before + _sum")


def plan(docs: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Rows ``(doc_id, source, _size, _key)``, and for each source its target, epochs and the place where its budget ends.

    ``_last``: the last place (key, id, size) of which the partial epoch takes a row, ``_ties`` rows have it and ``_take`` are taken.
    """
    rows = C.materialize(_drawn(docs, seed), "mix-rows")
    sums = C.materialize(rows.groupBy("source", _bucket().alias("_bucket")).agg(F.sum("_size").alias("_sum")), "mix-buckets")
    sources = targets(sums.groupBy("source").agg(F.sum("_sum").alias("source_size")))
    epochs = F.least(F.floor(F.coalesce(F.try_divide("target", "source_size"), F.lit(0))), F.lit(CAP)).cast("int")
    sources = C.materialize(sources.withColumn("_epochs", epochs).withColumn("_left", F.col("target") - F.col("_epochs") * F.col("source_size")), "mix-targets")
    s = sources.select(F.col("source").alias("_s"), "_left")
    sums = sums.join(s, F.col("source").eqNullSafe(F.col("_s"))).withColumn("_from", F.lit(0).cast("long"))
    at = C.materialize(_ending(sums, ["_s"], "_bucket").select("_s", F.col("_bucket").alias("_b"), "_before", "_left"), "mix-ends")
    # rows of one place count together; they are added up before they travel
    edge = rows.join(at, F.col("source").eqNullSafe(F.col("_s")) & (_bucket() == F.col("_b")))
    edge = edge.groupBy("_s", "_b", "_key", "doc_id", "_size", "_before", "_left").agg(F.count("*").alias("_ties")).withColumn("_rest", _octave() - F.col("_b"))
    edge = C.materialize(edge, "mix-edge")
    for _ in range(5):  # five times ten bits of the key's logarithm: what is left then has one key
        if not edge.groupBy("_s").count().where(F.col("count") > EDGE_ROWS).limit(1).count():
            break
        fine = edge.withColumn("_fine", F.floor(F.col("_rest") * FINER).cast("long"))
        sums = fine.groupBy("_s", "_fine", F.col("_before").alias("_from"), "_left").agg(F.sum(F.col("_size") * F.col("_ties")).alias("_sum"))
        end = _ending(sums, ["_s"], "_fine").select(F.col("_s").alias("_t"), F.col("_fine").alias("_f"), F.col("_before").alias("_now"))
        fine = fine.join(end, F.col("_s").eqNullSafe(F.col("_t")) & (F.col("_fine") == F.col("_f")))
        edge = C.materialize(fine.withColumn("_before", F.col("_now")).withColumn("_rest", F.col("_rest") * FINER - F.col("_fine")).drop("_t", "_f", "_now", "_fine"), "mix-edge")
    order = Window.partitionBy("_s").orderBy("_key", F.col("doc_id").asc_nulls_first(), "_size").rowsBetween(Window.unboundedPreceding, -1)
    size = F.col("_size")
    edge = edge.withColumn("_sum", F.col("_before") + F.coalesce(F.sum(size * F.col("_ties")).over(order), F.lit(0)))
    # as many of a place's rows as end nearer to the budget with them than without
    fit = F.when(size == 0, F.when(F.col("_sum") <= F.col("_left"), F.col("_ties")).otherwise(0)).otherwise(F.least(F.col("_ties"), F.floor((F.col("_left") - F.col("_sum") - size / 2) / size) + 1))
    last = edge.withColumn("_take", fit.cast("long")).where("_take > 0").groupBy("_s").agg(F.max(F.struct(_place().alias("_last"), "_take", "_ties")).alias("_m"))
    last = last.select(F.col("_s").alias("_t"), "_m.*")
    sources = sources.join(at.select("_s", "_b"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    sources = sources.join(last, F.col("source").eqNullSafe(F.col("_t")), "left").drop("_t")
    first = F.struct(F.lit(float("-inf")).alias("_key"), F.lit(None).cast("long").alias("doc_id"), F.lit(-1).cast("long").alias("_size"))
    return rows, C.materialize(sources.withColumn("_last", F.coalesce("_last", first.cast(_PLACE))), "mix-plan")


_PLACE = "struct<_key:double,doc_id:long,_size:long>"


def _place() -> Column:
    return F.struct("_key", F.col("doc_id").cast("long").alias("doc_id"), "_size").cast(_PLACE)


def _copies(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds ``copies``: complete epochs, and one if the partial epoch takes the row.

    Where a budget ends among rows of one place, these are numbered, by partitions and within them, and the first are taken.
    """
    s = sources.withColumnRenamed("source", "_source")
    out = rows.join(s, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    split = F.coalesce(F.col("_take") < F.col("_ties"), F.lit(False)) & (_bucket() == F.col("_b")) & (_place() == F.col("_last"))
    part = (_bucket() < F.col("_b")) | ((_bucket() == F.col("_b")) & (_place() <= F.col("_last")))
    part = F.coalesce(part, F.col("_left") > 0)  # no bucket holds the budget's end: all rows fit
    if sources.where("_take < _ties").limit(1).count():
        tied = C.materialize(out.where(split).withColumn("_pid", F.spark_partition_id()), "mix-ties")
        held = tied.groupBy("source", "_pid").count()
        over = Window.partitionBy("source").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
        held = held.select(F.col("source").alias("_source"), F.col("_pid").alias("_p"), F.coalesce(F.sum("count").over(over), F.lit(0)).alias("_start"))
        tied = tied.join(held, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_pid") == F.col("_p")))
        here = F.row_number().over(Window.partitionBy("source", "_pid").orderBy(F.lit(1)))
        tied = tied.withColumn("_in", F.col("_start") + here <= F.col("_take")).drop("_source", "_p", "_start", "_pid")
        out = out.where(~F.coalesce(split, F.lit(False))).withColumn("_in", part).unionByName(tied)
    else:
        out = out.withColumn("_in", part)
    return out.withColumn("copies", F.when((F.col("_epochs") < CAP) & F.col("_in"), F.col("_epochs") + 1).otherwise(F.col("_epochs")))


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` of each row of ``docs(doc_id, text, source)``.

    Null texts have size 0 and are never taken; null sources form a source of their own; rows without a ``doc_id`` draw by their
    text. Of rows alike in key, id and size any are taken, as many as the budget wants. A document that a budget's end cuts is
    taken if that brings the sum nearer to the target. Extra columns are ignored; an empty table gives an empty result.
    """
    rows, sources = plan(docs, seed)
    out = _copies(rows, sources)
    return out.select("doc_id", "source", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("copies")).alias("taken"))


def resample(docs: DataFrame, seed: int = 0) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as it is taken, columns unchanged, whatever their names."""
    _, sources = plan(docs, seed)
    out = _copies(_drawn(docs, seed, F.struct("*").alias("_row")), sources).where("copies > 0 and _size > 0")
    return out.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")


def op9(spark, sf_dir: str) -> DataFrame:
    return mix(C.read_documents(spark, sf_dir)).drop("source")


def oracle(seed: int = 0) -> str:
    symbols = SYMBOLS.replace("'", "''")
    return f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
    greatest(0.05::DOUBLE, coalesce(length(translate(text, '{symbols}', ''))::DOUBLE / nullif(length(text), 0), 0.05::DOUBLE)) AS w,
    (('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u FROM documents
), k AS (SELECT *, -ln(u) / w AS key FROM d),
 s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
 r AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM s),
 o AS (SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST) AS i FROM r),
 c AS (
  SELECT i, source_size, weight, coalesce(sum(3 * source_size) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS fixed,
    (sum(weight) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS free, (sum(source_size) OVER ())::BIGINT AS total FROM o
), lv AS (SELECT (total - fixed)::DOUBLE / free AS level FROM c WHERE 3 * source_size > (total - fixed)::DOUBLE / free * weight ORDER BY i LIMIT 1),
 t AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, coalesce((SELECT level FROM lv), 1e300) * weight) AS target FROM r),
 e AS (SELECT *, least(floor(coalesce(target / nullif(source_size, 0), 0)), 3)::BIGINT AS epochs FROM t),
 q AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id NULLS FIRST, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target, (size * (epochs + CASE WHEN epochs < 3 AND before + size / 2.0 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM q
"""

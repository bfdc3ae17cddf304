"""Document fingerprints: a homomorphic hash of a text's multiset of paragraphs. DataFrame functions only.

Each paragraph hashes to a wide vector: ``LANES`` lanes of one random bit and two lanes of 62 random bits. A
document's fingerprint is the sum of its paragraphs' vectors, lane by lane, modulo powers of two (2^32 and 2^62),
with the number of paragraphs. Sums do not depend on order, so equal multisets have equal fingerprints, and adding
or removing a paragraph adds or subtracts its vector (``insert``, ``delete``) without reading the rest. The narrow
lanes also measure likeness: lane sums less half the count are inner products with random signs, so the cosine of two
fingerprints estimates that of the two documents' paragraph counts, whatever the documents' lengths.

A paragraph is a line; lines of more than ``RUN`` words count as paragraphs of ``RUN`` words each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

RUN, LANES, PAIRS = 6, 64, 32
_PIECE = rf"\S+(?:[^\S\n]+\S+){{0,{RUN - 1}}}"
_FIELDS = [f"p{j}" for j in range(PAIRS)]
_LOW, _WIDE = 0xFFFFFFFF, (1 << 62) - 1
_BITS = 0x0000000100000001


def paragraphs(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_PIECE), F.lit(0))


def _add(acc: Column, h: Column, wide: Column) -> Column:
    """One paragraph's vector added. Two lanes share a long, 32 bits each: counts stay apart up to 2^31 paragraphs."""
    parts = [(acc[f"p{j}"] + F.shiftright(h, j).bitwiseAND(F.lit(_BITS))).alias(f"p{j}") for j in range(PAIRS)]
    s0 = (acc["s0"] + F.shiftrightunsigned(h, 2)).bitwiseAND(F.lit(_WIDE)).alias("s0")
    s1 = (acc["s1"] + F.shiftrightunsigned(wide, 2)).bitwiseAND(F.lit(_WIDE)).alias("s1")
    return F.struct(*parts, s0, s1, (acc["n"] + 1).alias("n"))


def zero() -> Column:
    return F.struct(*(F.lit(0).cast("long").alias(f) for f in [*_FIELDS, "s0", "s1", "n"]))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text column as a struct of longs; null counts as empty, and an empty text is all zeros."""
    return F.aggregate(paragraphs(text), zero(), lambda acc, x: _add(acc, F.xxhash64(x), F.xxhash64(x, F.lit(1))))


def insert(print_: Column, paragraph: Column) -> Column:
    return _add(print_, F.xxhash64(paragraph), F.xxhash64(paragraph, F.lit(1)))


def delete(print_: Column, paragraph: Column) -> Column:
    """``print_`` without one paragraph that it holds."""
    h, wide = F.xxhash64(paragraph), F.xxhash64(paragraph, F.lit(1))
    parts = [(print_[f"p{j}"] - F.shiftright(h, j).bitwiseAND(F.lit(_BITS))).alias(f"p{j}") for j in range(PAIRS)]
    s0 = (print_["s0"] - F.shiftrightunsigned(h, 2)).bitwiseAND(F.lit(_WIDE)).alias("s0")
    s1 = (print_["s1"] - F.shiftrightunsigned(wide, 2)).bitwiseAND(F.lit(_WIDE)).alias("s1")
    return F.struct(*parts, s0, s1, (print_["n"] - 1).alias("n"))


def text_form(print_: Column) -> Column:
    """All lanes as lower-case hex, the count last."""
    cells = [F.lpad(F.hex(print_[f]), 16, "0") for f in [*_FIELDS, "s0", "s1", "n"]]
    return F.lower(F.concat(*cells))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the estimated cosine of two paragraph multisets; 1 for equal fingerprints, 0 if just one is empty."""

    def signs(p: Column, f: str) -> tuple[Column, Column]:
        n = p["n"].cast("double")
        return F.shiftright(p[f], 32).cast("double") * 2 - n, p[f].bitwiseAND(F.lit(_LOW)).cast("double") * 2 - n

    dot = aa = bb = F.lit(0.0)
    for f in _FIELDS:
        for x, y in zip(signs(a, f), signs(b, f)):
            dot, aa, bb = dot + x * y, aa + x * x, bb + y * y
    same = a["n"].eqNullSafe(b["n"]) & a["s0"].eqNullSafe(b["s0"]) & a["s1"].eqNullSafe(b["s1"])
    cos = F.coalesce(F.try_divide(dot, F.sqrt(aa) * F.sqrt(bb)), F.lit(0.0))
    return F.when(same, 1.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(cos, F.lit(1.0))), 6))


def successors(ids: DataFrame) -> DataFrame:
    """``ids(doc_id, need)``, distinct ids, with ``next_id``: the next id in ascending order, the first after the last.

    Ids are dealt into ranges; each range finds its own successors, and only the ranges' first ids (one a
    partition) meet on the driver. Null sorts first.
    """
    order = F.col("doc_id").asc_nulls_first()
    placed = C.materialize(ids.repartitionByRange(order).withColumn("_pid", F.spark_partition_id()), "next-ids")
    firsts = sorted((r["_pid"], r["low"]) for r in placed.groupBy("_pid").agg(F.min(F.struct("doc_id")).alias("low")).collect())
    w = Window.partitionBy("_pid").orderBy(order)
    inner = placed.withColumn("_next", F.lead(F.struct("doc_id")).over(w))
    if not firsts:
        return inner.select("doc_id", "need", F.col("doc_id").alias("next_id"))
    after = [(pid, firsts[(i + 1) % len(firsts)][1]["doc_id"]) for i, (pid, _) in enumerate(firsts)]
    bounds = ids.sparkSession.createDataFrame(after, "_pid int, _after long")
    out = inner.join(F.broadcast(bounds), "_pid")
    return out.select("doc_id", "need", F.when(F.col("_next").isNotNull(), F.col("_next.doc_id")).otherwise(F.col("_after")).alias("next_id"))


def compare(docs: DataFrame) -> DataFrame:
    """For every row of ``docs(doc_id, text)``: its fingerprint, that of its edited text, and their likeness.

    The edited text has the last quarter of the code points (rounded down) replaced by the first as many of the next
    document, or all of them, in ascending order of ``doc_id``; after the last comes the first. Null texts count as
    empty; a null ``doc_id`` comes first; a table of one document is its own next. Rows that repeat a ``doc_id`` share
    their next document, which is, among rows that repeat the next ``doc_id``, the one whose text has the smallest
    SHA-256. Other columns are ignored. An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = C.spread(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    ids = docs.groupBy("doc_id").agg(F.max(F.floor(F.length("text") / 4)).alias("need"))
    order = C.materialize(successors(ids), "next")
    before = order.select(F.col("doc_id").alias("_prev"), "need", F.col("next_id").alias("_own"))
    # each text goes once to its id's partition, and only the prefix that the document before it needs goes on
    heads = docs.join(before, docs.doc_id.eqNullSafe(before._own)).select("_prev", F.struct(F.sha2(F.col("text"), 256).alias("k"), F.substring(F.col("text"), F.lit(1), F.col("need").cast("int")).alias("head")).alias("h"))
    heads = heads.groupBy("_prev").agg(F.min("h").alias("h")).select("_prev", "h.head")
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    rows = docs.join(heads, docs.doc_id.eqNullSafe(heads._prev), "left").withColumn(
        "edited", F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.coalesce("head", F.lit("")), F.lit(1), quarter))
    )
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.sha2("text", 256).alias("_key"), fingerprint(F.col("text")).alias("own"), fingerprint(F.col("edited")).alias("other"))
    rows = C.materialize(rows, "prints")
    nexts = rows.groupBy("doc_id").agg(F.min(F.struct("_key", "own")).alias("m")).select(F.col("doc_id").alias("_id"), F.col("m.own").alias("following"))
    link = order.select(F.col("doc_id").alias("_from"), "next_id").join(nexts, F.col("next_id").eqNullSafe(F.col("_id"))).select("_from", "following")
    out = rows.join(link, rows.doc_id.eqNullSafe(link._from), "left")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", text_form(F.col("own")).alias("fingerprint"), text_form(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"),
    )


def op4(spark, sf_dir: str) -> DataFrame:
    return compare(C.read_documents(spark, sf_dir))

"""A corpus pipeline of five stages over ``documents``, each an operator of ``larkspur.llm``.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it kept. Rows may hold nulls in any
column, and extra columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import bpe, langid, mixing, neardup, secrets
from larkspur.llm import common as C

#: A document goes if its language is undetermined, or no language has this much of it.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language. It learns from those rows of its input that have a ``lang``.

    A document goes if it has no text, no letter, or a score below ``LEAST_SCORE`` in its likeliest language. Where no row
    has a ``lang``, nothing can be learned, and only documents without a letter go.
    """
    C.importable(spark)
    model = langid.train(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    clash = [c for c in docs.columns if c.lower() in ("lang_pred", "score")]
    aside = dict(zip(clash, C.free([*docs.columns, "lang_pred", "score"], *clash)))
    found = langid.identify(docs.withColumnsRenamed(aside), model)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*(F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: words in runs of five, similarity 0.8 or more.

    Rows are told apart by a number written beside them, so rows that repeat a ``doc_id`` or have none are rows of their own.
    The row with the smallest ``doc_id`` stays, one without an id only if no other is in the group. Texts without words all stay.
    """
    C.importable(spark)
    row, key, group = C.free([*docs.columns, "doc_id"], "row", "key", "group")
    # written, as a number drawn anew in each reading need not fall on the same row
    rows = C.materialize(docs.withColumn(row, F.monotonically_increasing_id()), "pipeline-rows")
    groups = neardup.near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), width=5).select(F.col("doc_id").alias(row), F.col("component_id").alias(group))
    own = F.col("doc_id") if "doc_id" in docs.columns else F.lit(None).cast("long")
    ids = rows.select(row, own.alias(key))
    first = F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.col(row).alias("row")))
    best = groups.join(ids, row).groupBy(group).agg(first.alias(key))
    return rows.join(best.select(F.col(f"{key}.row").alias(row)), row, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, with its secrets replaced by a mark."""
    C.importable(spark)
    return secrets.redact(docs, path=bpe.vocabulary())


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents as often as their source's target wants."""
    C.importable(spark)
    return mixing.resample(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids' and decoded texts' digests of each row."""
    C.importable(spark)
    return bpe.round_trip(docs, bpe.vocabulary())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", no_secrets), ("mixing", mixed), ("bpe", encoded)]

#: A trained network has no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; of the tables in between only the last stage's input is left in the shared folder."""
    docs = C.read_documents(spark, sf_dir)
    with C.workspace(spark) as keep:
        for name, stage in STAGES[:-1]:
            with C.workspace(spark) as inner:
                docs = C.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
                inner.append(C.last_path())
        keep.append(C.last_path())
    return STAGES[-1][1](spark, docs, sf_dir)

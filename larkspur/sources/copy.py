"""COPY: text and CSV files in and out, with the options of the statement; flat-file foreign tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _options(form: str, delimiter, null, quote, escape, encoding) -> dict[str, str]:
    csv = form == "csv"
    out = {"sep": delimiter or ("," if csv else "\t"), "nullValue": ("" if csv else "\\N") if null is None else null, "encoding": encoding}
    out["quote"] = (quote or '"') if csv else "\u0000"
    out["escape"] = (escape or quote or '"') if csv else "\\"
    return out


def copy_from(spark: SparkSession, path: str, schema: str | T.StructType, form: str = "text", header: bool | str = False, delimiter: str | None = None, null: str | None = None, quote: str | None = None, escape: str | None = None, encoding: str = "UTF-8", default: str | None = None, defaults: dict[str, Column] | None = None, force_not_null: list[str] = (), force_null: list[str] = (), where: str | None = None) -> DataFrame:
    """``COPY … FROM``. Types are checked by the reader (a bad value is an error); ``header='match'`` checks names.

    ``default``: the marker of a column's default, given in ``defaults``; ``force_not_null`` columns keep the null
    marker as text; ``force_null`` columns turn quoted null markers into null too.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    opts = _options(form, delimiter, null, quote, escape, encoding)
    marker = opts.pop("nullValue")
    # fields come as text first: which of them are null, default or values is decided here
    raw = spark.read.options(**opts, header=str(bool(header)).lower(), enforceSchema=str(header != "match").lower(), mode="FAILFAST", nullValue="\u0001", emptyValue="").schema(text).csv(path)
    cols = []
    for f in schema:
        c = F.coalesce(F.col(f.name), F.lit("")) if marker == "" or f.name in force_not_null else F.col(f.name)
        if f.name not in force_not_null:
            c = F.when(c != marker, c)
        if form == "text":
            for a, b in (("\\\\t", "\t"), ("\\\\n", "\n"), ("\\\\r", "\r")):
                c = F.regexp_replace(c, a, b)
        value = c.cast(f.dataType)
        if default is not None and defaults and f.name in defaults:
            value = F.when(F.col(f.name) == default, defaults[f.name]).otherwise(value)
        cols.append(value.alias(f.name))
    out = raw.select(cols)
    return out.where(where) if where else out


def copy_to(df: DataFrame, path: str, form: str = "text", header: bool = False, delimiter: str | None = None, null: str | None = None, quote: str | None = None, escape: str | None = None, encoding: str = "UTF-8", force_quote: bool = False) -> None:
    """``COPY (query) TO``: a folder of files, one a partition; order the query to order the rows."""
    opts = _options(form, delimiter, null, quote, escape, encoding)
    if form == "text":
        esc = lambda c: F.replace(F.replace(F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
        line = F.concat_ws(opts["sep"], *(F.coalesce(esc(F.col(c)), F.lit(opts["nullValue"])) for c in df.columns))
        df.select(line.alias("value")).write.mode("overwrite").text(path)
    else:
        df.write.mode("overwrite").options(**opts, header=str(header).lower(), quoteAll=str(force_quote).lower()).csv(path)


def foreign_table(spark: SparkSession, name: str, path: str, schema: str, **options) -> DataFrame:
    """A flat file as a view."""
    df = copy_from(spark, path, schema, **options)
    df.createOrReplaceTempView(name)
    return df


def remote_table(spark: SparkSession, url: str, table: str, partition: tuple[str, int, int, int] | None = None, **options) -> DataFrame:
    """A table of another database over JDBC; ``partition``: column, bounds and count for parallel reads."""
    r = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition:
        column, lo, hi, n = partition
        r = r.options(partitionColumn=column, lowerBound=str(lo), upperBound=str(hi), numPartitions=str(n))
    return r.load()

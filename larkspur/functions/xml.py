"""XML: building, paths and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def escape(text) -> Column:
    t = _c(text).cast("string")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def element(name: str, *content, **attributes) -> Column:
    """``xmlelement``; null attributes are left out, content is text or XML."""
    attrs = [F.when(_c(v).isNotNull(), F.concat(F.lit(f' {k}="'), F.replace(escape(v), F.lit('"'), F.lit("&quot;")), F.lit('"'))).otherwise("") for k, v in attributes.items()]
    body = F.concat_ws("", *map(_c, content)) if content else F.lit("")
    head = F.concat(F.lit(f"<{name}"), *attrs)
    return F.when(body == "", F.concat(head, F.lit("/>"))).otherwise(F.concat(head, F.lit(">"), body, F.lit(f"</{name}>")))


def forest(**values) -> Column:
    """``xmlforest``: an element for each value that isn't null."""
    return F.concat_ws("", *(F.when(_c(v).isNotNull(), F.concat(F.lit(f"<{k}>"), escape(v), F.lit(f"</{k}>"))) for k, v in values.items()))


def agg(x, *order) -> Column:
    """``xmlagg(x ORDER BY …)``."""
    from . import arrays

    return F.array_join(arrays.collect(x, *order), "")


def is_document(x) -> Column:
    @F.udf("boolean", useArrow=True)
    def run(text):
        from xml.etree import ElementTree

        if text is None:
            return None
        try:
            ElementTree.fromstring(text)
        except ElementTree.ParseError:
            return False
        return True

    return run(_c(x))


def table(df: DataFrame, doc: str, rows: str, columns: dict[str, str], ordinality: str | None = None) -> DataFrame:
    """``XMLTABLE``: a row for each node of ``rows``, columns by paths below it, numbered from 1."""
    n = F.xpath_int(F.col(doc), F.lit(f"count({rows})"))
    out = df.select("*", F.explode(F.when(n > 0, F.sequence(F.lit(1), n))).alias("_i"))
    made = {}
    for name, path in columns.items():
        texts = F.xpath(F.col(doc), F.lit(f"{rows}/{path}/text()" if not path.startswith("@") else f"{rows}/{path}"))
        made[name] = F.get(texts, F.col("_i") - 1)
    out = out.withColumns(made)
    return out.withColumnRenamed("_i", ordinality) if ordinality else out.drop("_i")


def table_to_xml(df: DataFrame, name: str) -> DataFrame:
    """Each row as ``<name>…</name>``; null columns are left out."""
    return df.select(F.concat(F.lit(f"<{name}>"), forest(**{c: c for c in df.columns}), F.lit(f"</{name}>")).alias("xml"))
